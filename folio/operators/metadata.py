"""Conservative document metadata from a path and a document's first lines."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folio.operators import markdown

TOP_LINES = 40
# Keys, markers and values in the documents' language.
DATE_KEY, VERSION_KEY, TRUST_KEY = "작성일", "버전", "신뢰도"
STATE_KEYS = ("상태", "결정 상태", "결정상태", "문서 상태", "문서상태")
STATE_VALUES = ("확정", "[확정]")
CONFIRMED_MARKERS = ("확정기록", "결정서")
UNCONFIRMED_MARKERS = ("미확정", "불확정", "확정 전")
DRAFT_MARKERS = ("초안", "제안안", "가설", "진행메모")
OWNERS = ("docs", "uiux")

#: Digits of any script, as Python and Java write them.
VERSION, VERSION_JAVA = r"v(\d+(?:\.\d+)*)", r"v(\p{Nd}+(?:\.\p{Nd}+)*)"


@dataclass(slots=True)
class Context:
    """What the first lines say: the first heading and (key, value, from a table) entries in order of precedence."""

    title: str | None
    entries: list[tuple[str, str, bool]]


def context(lines: list[str]) -> Context:
    """Lines of top-level paragraphs as ``key: value``, then the first two cells of top-level table rows."""
    top = [x.rstrip("\r\n") for x in lines[:TOP_LINES]]
    blocks = markdown.top_blocks(top)
    title = next((b.title for b in blocks if b.kind == "heading"), None)
    pairs, rows = [], []
    for b in blocks:
        if b.kind == "paragraph":
            for line in top[b.start : b.end]:
                key, colon, value = line.strip().partition(":")
                if colon:
                    pairs.append((key.strip(" \t"), value.strip(" \t"), False))
        elif b.kind == "table":
            for row in b.children[1:]:
                own = markdown.cells(top[row.start])
                if len(own) >= 2:
                    rows.append((own[0], own[1], True))
    return Context(title, pairs + rows)


def _date(text: str | None) -> date | None:
    if text is None or not re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        return None
    try:
        return date.fromisoformat(text)
    except ValueError:
        return None


def extract(path: str, lines: list[str]) -> tuple[date | None, str | None, str, str, str]:
    """document_date, document_version, version_scope, decision_state, owner_domain; raises for another owner."""
    segments = path.split("/")
    if segments[0] not in OWNERS:
        raise ValueError("the first segment names no owner")
    stem = re.sub(r"(?<=.)\.[^.]*\Z", "", segments[-1])
    found = context(lines)
    value = lambda key: next((v for k, v, _ in found.entries if k == key), None)
    head = re.match(r"(\d{4}-\d{2}-\d{2})(?=\Z|[-_])", stem)
    written = _date(value(DATE_KEY)) or _date(head[1] if head else None)
    stated = re.fullmatch(VERSION, value(VERSION_KEY) or "")
    named = stated or re.search(rf"(?:^|[-_]){VERSION}(?=\Z|[-_])", stem)
    says = lambda text, markers: any(m in text for m in markers)
    confirmed = (says(stem, CONFIRMED_MARKERS) and not says(stem, UNCONFIRMED_MARKERS)) or any(
        (k in STATE_KEYS and v in STATE_VALUES) or (t and k == TRUST_KEY and v == STATE_VALUES[0]) for k, v, t in found.entries
    )
    draft = says(stem, DRAFT_MARKERS) or says(found.title or "", DRAFT_MARKERS)
    state = "unknown" if confirmed == draft else "confirmed" if confirmed else "draft"
    return written, named[1] if named else None, "historical" if "versions" in segments else "current", state, segments[0]


def extracted(occurrences: DataFrame, *more: str) -> DataFrame:
    """Metadata of rows (source_path, first_lines), with the columns ``more``; a path without an owner gives nulls and ``error``."""
    kinds = (pa.date32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string())
    names = ["document_date", "document_version", "version_scope", "decision_state", "owner_domain", "error"]
    kept = occurrences.select("source_path", *more).schema
    names = [*kept.names, *names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, lines in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows.append((*extract(path or "", lines or []), None))
                except ValueError:
                    rows.append((None, None, None, None, None, "owner"))
            made = [pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 6, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], *made], names)

    plain = "document_date date, document_version string, version_scope string, decision_state string, owner_domain string, error string"
    return occurrences.select("source_path", "first_lines", *more).mapInArrow(run, StructType([*kept.fields, *StructType.fromDDL(plain).fields]))


# --- the same rules as expressions, for first lines that are plain paragraphs ---


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*\z", "")


def _says(text: Column, markers: tuple[str, ...]) -> Column:
    return F.rlike(text, F.lit("|".join(markers)))


def line_value(lines: Column, key: str) -> Column:
    """The value of the first ``key: value`` line."""
    first = F.filter(F.slice(lines, 1, TOP_LINES), lambda x: F.trim(F.split_part(x, F.lit(":"), F.lit(1))) == key)
    return F.trim(F.regexp_extract(F.try_element_at(first, F.lit(1)), r"^[^:]*:(.*)$", 1))


def _valid_date(text: Column) -> Column:
    return F.when(F.rlike(text, F.lit(r"^(?!0000)\d{4}-\d{2}-\d{2}\z")), F.try_to_date(text, "yyyy-MM-dd"))


def expressions(path: Column, lines: Column) -> dict[str, Column]:
    stem = _stem(path)
    stated = F.regexp_extract(F.coalesce(line_value(lines, VERSION_KEY), F.lit("")), f"^{VERSION_JAVA}\\z", 1)
    named = F.regexp_extract(stem, rf"(?:^|[-_]){VERSION_JAVA}(?=\z|[-_])", 1)
    version = F.when(stated != "", stated).when(named != "", named)
    states = [line_value(lines, k).isin(*STATE_VALUES) for k in STATE_KEYS]
    structured = F.lit(False)
    for s in states:
        structured = structured | F.coalesce(s, F.lit(False))
    confirmed = (_says(stem, CONFIRMED_MARKERS) & ~_says(stem, UNCONFIRMED_MARKERS)) | structured
    draft = _says(stem, DRAFT_MARKERS)
    return {
        "document_date": F.coalesce(_valid_date(line_value(lines, DATE_KEY)), _valid_date(F.regexp_extract(stem, r"^(\d{4}-\d{2}-\d{2})(?=\z|[-_])", 1))),
        "document_version": version,
        "version_scope": F.when(F.array_contains(F.split(path, "/"), "versions"), "historical").otherwise("current"),
        "decision_state": F.when(confirmed == draft, "unknown").when(confirmed, "confirmed").otherwise("draft"),
        "owner_domain": F.when(F.split_part(path, F.lit("/"), F.lit(1)).isin(*OWNERS), F.split_part(path, F.lit("/"), F.lit(1))),
    }
