"""Personal data with offsets, also where it is disguised.

Method: plain identifiers are found in the text as it is. Then transducers rewrite what disguises them: look-alike
characters to ASCII, invisible characters to nothing, ``at`` and ``dot`` in brackets or between words to their signs (dots
in hosts, in local parts and between digits), and, for numbers only, spelled digits to digits. Each character of the
rewritten text keeps the source span it came from, the same detectors run again, and a span that holds a rewritten
character is mapped back and added, unless a plain one covers it. One spelled digit beside a whole number is prose.

A plain ``at`` between words is a disguise only before a host with a disguised dot ("look at example.com" is prose), and not
where grammar says that it is prose: after a verb or an adverb of ``LOCAL_PROSE``, after a noun or verb that an article or a
pronoun stands before ("the map at big dot de"), or before a word of ``HOST_PROSE``. In brackets, or as a sign between spaces,
it is one before any host. Spaces around a host's dot are taken for a disguise after a sign only, before a known last label. A
host whose labels were disguised ends with its last known label (and a country's two letters after it), so a sentence that
goes on after it isn't swallowed. Two letters after a disguised dot are a country's, but for words that aren't one's, and for
words that may be one's where the sentence goes on after them.

Defined results: a null or empty text has no spans; offsets are code points of the source, end exclusive; the counts
n_email, n_ip, n_card and n_phone and base_sha256 are of the plain identifiers, spans and n_added hold those the
transducers added too; every detector reads a text once and single characters are rewritten by array, so very long texts
cost in proportion, whatever their script; repeated rows and other columns change nothing; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from folio.llm.common import documents, lean, python_ready, steps, text_rows, utf8

KINDS = ("email", "ip", "card", "phone")
STEP = 1 << 21
Span = tuple[str, int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match that fails at the head of a run of digits fails within it too, so only heads are tried.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_TOKEN = re.compile(r"[^\W_]+")
_FIGURES = frozenset("0123456789")
_SPACED = r"\x20{1,2}\.\x20{1,2}"
_SENTENCE_GOES_ON = re.compile(r"\x20{1,2}\w")
_WORD_BEFORE = re.compile(r"([A-Za-z]+)\x20{1,2}$")
_BRACKETED = re.compile(r"[\[({<]\x20{0,2}\.")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def plain(text: str) -> list[Span]:
    """Identifiers as they stand, by kind and then start."""
    found: list[Span] = []
    at, last = text.find("@"), 0
    while at >= 0:  # the local part is the whole run before the sign, back to the last match
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append(("email", start, m.end()))
            last = m.end()
            at = text.find("@", last)
        else:
            at = text.find("@", at + 1)
    if not _DIGITS.search(text):
        return found
    if "." in text:
        found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := re.sub(r"[\x20-]", "", m.group())) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m.group())) <= 15]
    return found


# Look-alikes of ASCII letters outside compatibility forms, as pairs.
LOOK_ALIKES = "аaеeоoрpсcхxуyіiјjѕsԁdһhӏlԛqԝwАAВBЕEЅSІIЈJКKМMНHОOРPСCТTХXУYοoνvιiαaρpκkΟOΑAΒBΕEΖZΗHΙIΚKΜMΝNΡPΤTΥYΧX"
INVISIBLE = "­​‌‍⁠﻿"
SIGNS = {"‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "﹣": "-", "∙": ".", "․": ".", "。": ".", "｡": "."}
#: Digits as they are spelled in English, German, French and Spanish.
SPELLED = {
    "zero": 0, "oh": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "null": 0, "eins": 1, "zwei": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}
#: The last labels of a host that make ``at`` and ``dot`` between plain words a disguise, beside two letters.
LABELS = ("com", "org", "net", "edu", "gov", "mil", "info", "biz", "dev", "app", "xyz", "io", "de", "fr", "es", "uk", "eu")
#: Words of two letters that are no country's label, and such that are one's but mostly words.
NO_COUNTRY = frozenset("an go he hi if of oh ok on or ox up we".split())
MOSTLY_WORDS = frozenset("am as at be by do in is it me my no so to us".split())
#: Words before a plain ``at`` that are no one's name, words before such a word that make it a noun or a verb,
#: and words after ``at`` that begin a phrase of place or time.
LOCAL_PROSE = frozenset(
    """aim aimed all am and are arrive arrived arrives back be been began begins being but closed closes down ended ends even
    found gather gathered glance glanced held her here him home is it just laugh laughed live lived lives look looked looking
    looks me meet meeting meetings meets met not now off once only open opens or out over park parked point pointed points
    sat seen shout shouted sit sits sitting smile smiled stand standing stands stare stared start started starts stay stayed
    stays still stood stop stopped stops that them then there these they this those turn turned up us wait waited was we were
    work worked works you""".split()
)
NOUN_OR_VERB_AFTER = frozenset("a an are been being each every he her his i is it its my no one our she some that the their these they this those was we were who you your".split())
HOST_PROSE = frozenset("a all an any dawn dusk each every first her his home last least midnight most my night no noon once our polka school some that the their these this those your".split())


@lru_cache(1)
def glyphs() -> dict[str, str]:
    """What single characters are rewritten to: compatibility forms and digits by Unicode's own rule, then the tables."""
    table = {}
    for point in (*range(0x250, 0x3100), *range(0xA620, 0xAC00), *range(0xFE50, 0xFFF0), *range(0x104A0, 0x104AA), *range(0x1D400, 0x1D800), *range(0x1FBF0, 0x1FBFA)):
        ch = chr(point)
        plain_form = unicodedata.normalize("NFKC", ch)
        if (d := unicodedata.decimal(ch, None)) is not None:
            table[ch] = str(d)
        elif len(plain_form) == 1 and plain_form.isascii() and (plain_form.isalnum() or plain_form in "@.%+-_()"):
            table[ch] = plain_form
    table |= dict(zip(LOOK_ALIKES[::2], LOOK_ALIKES[1::2]))
    return table | SIGNS | dict.fromkeys(INVISIBLE, "")


GONE = 0xFFFFFFFF


@lru_cache(1)
def points() -> np.ndarray:
    """For every code point, the one it is rewritten to, or GONE."""
    table = np.arange(0x110000, dtype=np.uint32)
    for ch, instead in glyphs().items():
        table[ord(ch)] = ord(instead) if instead else GONE
    return table


@lru_cache(1)
def machines() -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    word = "|".join(sorted(SPELLED, key=len, reverse=True))
    figure = rf"(?:{word}|[0-9]++)(?!\w)"
    run = re.compile(rf"(?<!\w)(?P<plus>plus[\x20-]{{1,2}})?{figure}(?:[\x20,.-]{{1,3}}{figure})*+", re.I)
    dot = r"(?:\x20{0,2}[\[({<]\x20{0,2}(?:dot|\.)\x20{0,2}[\])}>]\x20{0,2}|\x20{1,2}dot\x20{1,2})"
    at = r"(?:\x20{0,2}[\[({<]\x20{0,2}(?:at|@)\x20{0,2}[\])}>]\x20{0,2}|\x20{1,2}at\x20{1,2}|\x20{0,2}@\x20{0,2})"
    label = "[a-z0-9-]{1,63}"
    mail = re.compile(
        rf"(?P<at>{at})(?=(?P<host>{label}(?:(?:{dot}|{_SPACED}|\.){label}){{1,8}}))", re.I
    )
    return run, mail, re.compile(dot, re.I)


Edit = tuple[int, int, str]
#: A rewritten text; of each of its characters, where in the source it begins and ends, and whether it is rewritten.
Now = tuple[str, np.ndarray, np.ndarray, np.ndarray]


def _drawn(text: str) -> Now:
    """The transducer of single characters, over the whole text at once."""
    at = np.arange(len(text))
    if not beyond_latin(text):
        return text, at, at + 1, np.zeros(len(text), bool)
    raw = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    drawn = points()[raw]
    new, gone = drawn != raw, drawn == GONE
    if gone.any():  # what precedes something invisible, or else follows it, holds a rewritten character too
        before = np.append(new[1:] & gone[1:], False)
        new |= before
        new[: int(gone.argmin()) + 1] |= gone[0]
        at, drawn, new = at[~gone], drawn[~gone], new[~gone]
    return drawn.tobytes().decode("utf-32-le"), at, at + 1, new


def _edited(edits: Iterable[Edit], text: str, starts: np.ndarray, ends: np.ndarray, new: np.ndarray) -> Now:
    """One transducer: ``edits`` (start, end, instead; in order, an overlapping one is skipped) are made; positions follow."""
    out, s, e, n, last = [], [], [], [], 0
    for a, b, instead in edits:
        if a < last:
            continue
        out += [text[last:a], instead]
        s += [starts[last:a], np.full(len(instead), starts[a])]
        e += [ends[last:a], np.full(len(instead), ends[b - 1])]
        n += [new[last:a], np.ones(len(instead), bool)]
        last = b
    if not out:
        return text, starts, ends, new
    return "".join([*out, text[last:]]), *(np.concatenate([*x, y[last:]]) for x, y in ((s, starts), (e, ends), (n, new)))


def _dotted(low: str) -> bool:
    return "dot" in low or _BRACKETED.search(low) is not None


def _host_end(host: str, after: str, dot: re.Pattern, sure: bool) -> int | None:
    """Where a disguised host ends: after its last known label; without one it is whole if it is ``sure`` to be a host.

    ``after`` is what follows it.
    """
    joints = [(m.start(), m.end()) for m in re.finditer(f"{dot.pattern}|{_SPACED}|\\.", host, re.I)]
    begin, ends = [0, *(b for _, b in joints)], [*(a for a, _ in joints), len(host)]
    raw = [host[a:b] for a, b in zip(begin, ends)]

    def known(i: int) -> bool:
        label, joint = raw[i].lower(), host[slice(*joints[i - 1])]
        if label in LABELS:
            return True
        if not re.fullmatch("[a-z]{2}", label) or label in NO_COUNTRY or joint.strip() == "." != joint:
            return False
        if joint == "." and (i + 1 < len(raw) or not raw[i].islower()):
            return False  # after a plain dot a country's label ends the host
        return label not in MOSTLY_WORDS or i + 1 == len(raw) and not _SENTENCE_GOES_ON.match(after)

    last = next((i for i in range(len(raw) - 1, 0, -1) if known(i)), None)
    if last is None:
        spaced = [i for i, (a, b) in enumerate(joints) if host[a:b].strip() == "." != host[a:b]]
        labels = spaced[0] + 1 if spaced else len(raw)
        return ends[labels - 1] if sure and labels > 1 else None
    if last + 1 < len(raw) and re.fullmatch("[a-z]{2}", raw[last + 1]) and raw[last + 1] not in NO_COUNTRY | MOSTLY_WORDS:
        last += 1
    return ends[last]


def _prose(text: str, at: int, host: str, dots: dict[int, int]) -> bool:
    """Whether a plain ``at`` stands in a sentence and joins no name to a host."""
    if host.lower() in HOST_PROSE:
        return True
    head = at
    while head > 0 and at - head < 64 and text[head - 1] in _LOCAL:
        head -= 1
    local = text[head:at]
    if head in dots or not local.isalpha():
        return False
    before = _WORD_BEFORE.search(text, max(0, head - 24), head)
    return local.lower() in LOCAL_PROSE or before is not None and before[1].lower() in NOUN_OR_VERB_AFTER


def _signs(text: str, mail: re.Pattern, dot: re.Pattern) -> list[Edit]:
    """Disguised signs of addresses, the dots in their hosts and local parts, and dots between digits."""
    dots = {m.end(): m.start() for m in dot.finditer(text)} if _dotted(text.lower()) else {}
    edits = {a: (b, ".") for b, a in dots.items() if a and text[a - 1] in _FIGURES and text[b : b + 1] in _FIGURES}
    spaced = re.compile(f"{dot.pattern}|{_SPACED}", re.I)
    for m in mail.finditer(text):
        host, between = m["host"], m["at"].strip().lower()
        inner, joints = list(dot.finditer(host)), list(spaced.finditer(host))
        if m["at"] != "@" or joints:
            sure = between[0] in "[({<" or (between == "@" and bool(inner))
            if between == "at" and (not inner or _prose(text, m.start(), re.match("[A-Za-z0-9-]*", host)[0], dots)):
                continue
            end = _host_end(host, text[m.end("host") : m.end("host") + 3], dot, sure)
            if end is None:
                continue
            if m["at"] != "@":
                edits[m.start()] = (m.end(), "@")
            edits |= {m.start("host") + d.start(): (m.start("host") + d.end(), ".") for d in joints if d.end() < end}
            if end < len(host):  # the sentence goes on
                edits[m.start("host") + end] = (m.start("host") + end, "\n")
        start = m.start()
        while start > 0:  # the local part, back over its disguised dots
            head = start
            while head > 0 and start - head < 64 and text[head - 1] in _LOCAL:
                head -= 1
            if head == start or (at := dots.get(head)) is None:
                break
            edits[at] = (head, ".")
            start = at
    return [(a, b, instead) for a, (b, instead) in sorted(edits.items())]


def _figures(text: str, run: re.Pattern) -> Iterator[Edit]:
    """Spelled digits, whatever their number, among spelled and written ones; what stands between two of them goes."""
    for m in run.finditer(text):
        first = m.end("plus") if m["plus"] else m.start()
        tokens = [(t.start(), t.end(), SPELLED.get(t.group().lower())) for t in _TOKEN.finditer(text, first, m.end())]
        if all(digit is None for *_, digit in tokens):
            continue
        if m["plus"]:
            yield m.start(), first, "+"
        gaps = [text[x:y] for (_, x, _), (y, _, _) in zip(tokens, tokens[1:])]
        numeric = gaps.count(".") == 3  # an ip's dots
        for i, (a, b, digit) in enumerate(tokens):
            if i and not (numeric and gaps[i - 1] == ".") and not (digit is None and tokens[i - 1][2] is None):
                if digit is not None and tokens[i - 1][2] is not None:
                    a -= len(gaps[i - 1])
                elif gaps[i - 1] not in (" ", "-"):
                    yield a - len(gaps[i - 1]), a, " "
            if digit is not None:
                yield a, b, str(digit)


def _few(low: str) -> bool:
    """No spelled digit, or too few digits for any kind."""
    spelled = sum(map(SPELLED.__contains__, _TOKEN.findall(low)))
    return not spelled or spelled < 4 and spelled + len(_DIGITS.findall(low)) < 4


def disguised(text: str, known: list[Span]) -> list[Span]:
    """Spans that only the transducers find, in positions of the source."""
    run, mail, dot = machines()
    now = _drawn(text)
    low = now[0].lower()
    signs = "@" in low or "at" in low or _dotted(low)
    spelled = not _few(low)
    signed = _edited(_signs(now[0], mail, dot), *now) if signs else now
    lists = [_by_kind(known)]
    own = _found(signed, lists)
    if spelled:  # emails keep their words
        figures = _edited(_figures(now[0], run), *now)
        figures = _edited(_signs(figures[0], mail, dot), *figures) if signs else figures
        lists.append(_by_kind(own))
        own += [s for s in _found(figures, lists) if s[0] != "email" and not _one_word_more(text, s, lists)]
    return own


#: Spans of each kind that don't overlap, in order.
ByKind = dict[str, list[tuple[int, int]]]


def _by_kind(spans: list[Span]) -> ByKind:
    out: ByKind = {}
    for kind, a, b in sorted(spans):
        out.setdefault(kind, []).append((a, b))
    return out


def _one_word_more(text: str, span: Span, lists: list[ByKind]) -> bool:
    """A number that is known and one spelled digit beside it, which is prose."""
    kind, a, b = span
    for spans in (known.get(kind, ()) for known in lists):
        i = bisect_left(spans, (a, a))
        if i < len(spans) and spans[i][1] <= b and len(_TOKEN.findall(text[a : spans[i][0]]) + _TOKEN.findall(text[spans[i][1] : b])) == 1:
            return True
    return False


def _found(now: tuple[str, np.ndarray, np.ndarray, np.ndarray], lists: list[ByKind]) -> list[Span]:
    """Spans that hold a rewritten character and that no known one covers."""
    rewritten, starts, ends, new = now
    if not new.any():
        return []
    own = []
    marks = np.append(0, np.cumsum(new))
    for kind, a, b in plain(rewritten):
        if marks[b] == marks[a]:
            continue
        lo, hi = int(starts[a]), int(ends[b - 1])
        for spans in (known.get(kind, ()) for known in lists):
            i = bisect_right(spans, (lo, len(starts) + hi)) - 1
            if i >= 0 and hi <= spans[i][1]:
                break
        else:
            own.append((kind, lo, hi))
    return own


def beyond_latin(text: str) -> bool:
    """Whether characters are there that the tables of look-alikes may hold."""
    if text.isascii():
        return False
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return True
    return "\xad" in text


def spans_of(text: str) -> tuple[list[Span], list[Span]]:
    """Plain spans and all spans, by kind as listed and then start."""
    base = plain(text)
    rank = lambda s: (KINDS.index(s[0]), s[1], s[2])
    added = disguised(text, base)
    return base, sorted({*base, *added}, key=rank) if added else base


def written_out(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with its spans replaced by their kinds; spans that overlap become one."""
    merged: list[list] = []
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    out, last = [], 0
    for kind, a, b in merged:
        out += [text[last:a], f"<{kind}>"]
        last = b
    return "".join([*out, text[last:]])


def _small(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """Batches of about ``STEP`` bytes of text, or of one row: texts become Python strings, which take several times that."""
    for batch in batches:
        for lo, hi in steps(utf8(batch.column(text))[1], STEP):
            yield batch.slice(lo, hi - lo)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts and digest of plain spans, all spans and how many of them the transducers added, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches, 1):
            counts, digest, listed, added = [[] for _ in KINDS], [], [], []
            for text in batch.column(1).to_pylist():
                base, spans = spans_of(text or "")
                for own, kind in zip(counts, KINDS):
                    own.append(sum(s[0] == kind for s in base))
                digest.append(hashlib.sha256(written_out(base).encode()).hexdigest())
                listed.append(written_out(spans))
                added.append(len(spans) - len(base))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digest, pa.string()), pa.array(listed, pa.string()), pa.array(added, pa.int64())],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"],
            )

    python_ready(docs.sparkSession)
    return text_rows(docs).mapInArrow(lean(run), f"doc_id bigint, {', '.join(f'n_{k} bigint' for k in KINDS)}, base_sha256 string, spans string, n_added bigint")


def redacted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with personal data replaced in ``text`` (and ``n_chars``, where there is one, renewed)."""
    names = [f.name for f in docs.schema.fields]
    at, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches, at):
            texts = batch.column(at).to_pylist()
            new = [redact(t, s) if t and (s := spans_of(t)[1]) else t for t in texts]
            columns = list(batch.columns)
            columns[at] = pa.array(new, pa.string())
            if chars is not None:
                kind = columns[chars].type
                columns[chars] = pa.array([c if a == b else len(b) for a, b, c in zip(texts, new, columns[chars].to_pylist())], kind)
            yield pa.RecordBatch.from_arrays(columns, names)

    python_ready(docs.sparkSession)
    return docs.mapInArrow(lean(run), docs.schema)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redacted(docs)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(documents(spark, sf_dir))
