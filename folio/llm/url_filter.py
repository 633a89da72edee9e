"""URL filters: host and path rules, then a weighted vocabulary.

Method: an Aho-Corasick automaton finds the vocabulary's terms in the whole lower-cased url, its query and fragment
included; a hit counts only where neither neighbour is a letter or digit of ASCII. A term is a word, its plural too, or
two words that stand together or joined by one sign. Each distinct term counts once, by its weight, and a url is rejected
when the weights reach ``REJECT``: one strict term does, two distinct soft ones do, or more of the faint ones, which mostly
stand in harmless addresses. Terms of a context that explains such words ("addiction", "education", "punk") take away as much
as a strict term adds, once each; what has no harmless use weighs twice as much, so that one such context doesn't excuse it.

Rules come first: a rule fits its host and all subdomains where the url's path starts with the rule's; the longest wins.

Defined results: a null url has an empty host and path and is allowed; one without ``://`` has both empty and is searched
as it stands; repeated rows are judged each; very long urls are searched whole; without any term none is rejected but by
a rule; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import python_ready

REJECT = 4
# The vocabulary by weight. Words with their plurals, and pairs of words.
HARD, STRICT_WEIGHT, SOFT_WEIGHT, FAINT_WEIGHT, CONTEXT_WEIGHT = 2 * REJECT, REJECT, REJECT // 2, REJECT // 4, -REJECT
PLAIN = (
    "bestiality", "blowjob", "camgirl", "camslut", "creampie", "cumshot", "deepthroat", "gangbang", "handjob", "hentai", "keygen", "milf", "onlyfans", "porn",
    "porno", "pornstar", "pornhub", "sexting", "upskirt", "warez", "xnxx", "xvideos",
)
STRICT = (
    "baccarat", "blackjack", "bookie", "bookmaker", "casino", "cialis", "erotica", "escort", "gambling", "hardcore", "levitra", "nudity", "pornography", "roulette",
    "softcore", "sportsbook", "striptease", "stripper", "tramadol", "viagra", "xxx",
)
SOFT = (
    "betting", "bingo", "clickbait", "cracked", "doorway", "erotic", "fetish", "hookup", "jackpot", "lingerie", "lottery", "malware", "naked", "nude", "nsfw",
    "payday", "phishing", "poker", "sex", "sexy", "spam", "spyware", "swinger", "torrent", "wager", "webcam", "xanax",
)
FAINT = ("adult", "bonus", "cheap", "crack", "dating", "discount", "pill", "pharmacy", "replica", "serial", "singles", "slot", "steroid", "viral", "winner")
PAIRS = (
    ("ad", "server"), ("ad", "tracker"), ("ads", "track"), ("ads", "tracking"), ("adult", "chat"), ("adult", "content"), ("adult", "dating"), ("adult", "movies"),
    ("adult", "only"), ("adult", "video"), ("adult", "videos"), ("adult", "x"), ("bet", "bonus"), ("buy", "followers"), ("casino", "bonus"), ("cheap", "loans"),
    ("cheap", "meds"), ("cheap", "pills"), ("cheap", "replica"), ("click", "farm"), ("crack", "download"), ("crack", "serial"), ("diet", "pills"), ("fake", "id"),
    ("free", "bet"), ("free", "bets"), ("free", "nudes"), ("free", "sex"), ("free", "spins"), ("hot", "girls"), ("instant", "loan"), ("instant", "loans"),
    ("license", "crack"), ("link", "farm"), ("live", "sex"), ("loan", "shark"), ("online", "bets"),
    ("online", "pharmacy"), ("online", "slots"), ("payday", "loan"), ("payday", "loans"), ("penis", "enlargement"), ("replica", "watches"), ("serial", "crack"),
    ("sex", "cam"), ("sex", "chat"), ("sex", "shop"), ("sex", "video"), ("sex", "videos"), ("slot", "machines"), ("spam", "farm"),
    ("win", "cash"), ("x", "rated"),
)
CONTEXT = (
    "addiction", "analysis", "anatomy", "archive", "archaeology", "art", "awareness", "ballet", "ban", "biology", "carbon", "chromosome", "clinic", "commission", "compliance", "court",
    "counselling", "counseling", "curve", "detection", "detector", "disease", "disorder", "education", "encyclopedia", "ethics", "filter", "ford", "fossil", "gender", "grammar",
    "harm", "health", "help", "helpline", "history", "inhaler", "journal", "law", "legislation", "library", "lung", "mathematics", "medicine", "mission", "museum",
    "painting", "parliament", "patient", "policy", "prevention", "psychology", "punk", "recovery", "regulation", "regulator", "research",
    "royale", "ruling", "safety", "science", "skeleton", "statistic", "study", "studies", "superbowl", "symptom", "therapy", "treatment", "university", "wiki",
)
SIGNS = ("", "-", "_", ".", "+", "%20")
WEIGHTS = {
    **dict.fromkeys(FAINT, FAINT_WEIGHT), **dict.fromkeys(SOFT, SOFT_WEIGHT), **dict.fromkeys(STRICT, STRICT_WEIGHT), **dict.fromkeys(PLAIN, HARD),
    **{f"{a} {b}": STRICT_WEIGHT for a, b in PAIRS}, **dict.fromkeys(CONTEXT, CONTEXT_WEIGHT),
}
#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def spellings(term: str) -> list[str]:
    """How a term may stand: a word and its plural, or two words with a sign between them or none."""
    words = term.split(" ")
    return [term, f"{term}s"] if len(words) == 1 else [sign.join(words) for sign in SIGNS]


@lru_cache(4)
def automaton(weights: tuple[tuple[str, int], ...]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for term, weight in weights:
        for own in spellings(term):
            out.add_word(own, (term, weight, len(own)))
    out.make_automaton()
    return out


def _open(text: str, at: int) -> bool:
    """No letter or digit of ASCII there."""
    return not (0 <= at < len(text) and text[at].isascii() and text[at].isalnum())


def hits(machine, text: str) -> dict[str, int]:
    """The distinct terms at boundaries and their weights."""
    found = {}
    for end, (term, weight, size) in machine.iter(text):
        if term not in found and _open(text, end + 1) and _open(text, end - size):
            found[term] = weight
    return found


def parts(url) -> tuple:
    """Host and path as column expressions."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    authority = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(authority) + F.lit(1)), r"^[^?#]*", 0)
    return F.translate(authority, UPPER, LOWER), path


def judge(pages: DataFrame, rules=RULES, weights: dict[str, int] | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, weight (of distinct terms) for every row of ``pages``."""
    weights = tuple(sorted((WEIGHTS if weights is None else weights).items()))
    host, path = parts(F.col("url"))
    cut = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"), F.translate(F.coalesce("url", F.lit("")), UPPER, LOWER).alias("seen"))
    rule = ruled = F.lit(None).cast("string")
    for verdict, at, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r), reverse=False):
        fits = ((F.col("host") == at) | F.endswith(F.col("host"), F.lit(f".{at}"))) & F.startswith(F.col("path"), F.lit(start))
        rule = F.when(fits, F.lit(at + start)).otherwise(rule)
        ruled = F.when(fits, F.lit(verdict)).otherwise(ruled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(weights) if weights else None
        for batch in batches:
            ruled = batch.column(4).to_pylist()
            weight = [sum(hits(machine, t).values()) if machine else 0 for t in batch.column(5).to_pylist()]
            verdict = [r or ("block" if w >= REJECT else "allow") for r, w in zip(ruled, weight)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(verdict, pa.string()), pa.array(weight, pa.int64())],
                ["page_id", "host", "path", "rule", "verdict", "weight"],
            )

    python_ready(pages.sparkSession)
    return cut.select("page_id", "host", "path", rule.alias("rule"), ruled.alias("ruled"), "seen").mapInArrow(
        run, "page_id bigint, host string, path string, rule string, verdict string, weight bigint"
    )


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _oracle() -> str:
    sign = "(" + "|".join(x.replace(".", "[.]").replace("+", "[+]") for x in SIGNS[1:]) + ")?"
    term = lambda t: t.replace(" ", sign) if " " in t else f"{t}s?"
    found = " + ".join(
        f"CASE WHEN regexp_matches(seen, '(^|[^a-z0-9]){term(t)}($|[^a-z0-9])') THEN {w} ELSE 0 END" for t, w in sorted(WEIGHTS.items())
    )
    fits = lambda at, start: f"(host = '{at}' OR ends_with(host, '.{at}')) AND starts_with(path, '{start}')"
    ordered = sorted(RULES, key=lambda r: (len(r[1] + r[2]), r), reverse=True)
    rule = " ".join(f"WHEN {fits(a, p)} THEN '{a}{p}'" for _, a, p in ordered)
    ruled = " ".join(f"WHEN {fits(a, p)} THEN '{v}'" for v, a, p in ordered)
    return f"""
WITH r AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, url, rest, regexp_extract(rest, '^[^/?#]*') AS authority FROM r
), p AS (
  SELECT page_id, url, translate(authority, '{UPPER}', '{LOWER}') AS host,
         regexp_extract(substr(rest, length(authority) + 1), '^[^?#]*') AS path FROM h
), s AS (
  SELECT *, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') AS seen FROM p
), w AS (
  SELECT *, {found} AS weight FROM s
)
SELECT page_id, host, path, CASE {rule} END AS rule,
       CASE {ruled} WHEN weight >= {REJECT} THEN 'block' ELSE 'allow' END AS verdict, CAST(weight AS BIGINT) AS weight
FROM w
"""


ORACLE = _oracle()
