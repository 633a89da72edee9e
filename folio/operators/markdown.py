"""Markdown structure: physical lines, block trees and heading sections.

A document's lines are scanned once by recursive descent over containers (quotes, list items), each of which sees its
lines without its own prefix. Only block structure matters here: headings at the top level cut sections, every other
top-level block or gap belongs to one, and concatenated they give the section's body again.

The scan is a plain function, applied to Arrow batches of whole documents; what follows from ordinals and levels alone
(extents, parents, paths) is also there as DataFrame operations.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARSER_VERSION = "folio-markdown-v1"
DEPTH = 20  # containers within containers; deeper ones are read as paragraphs

_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+")
_HEADING = re.compile(r"(#{1,6})(?=[ \t]|$)[ \t]*(.*?)(?:[ \t]+#+)?[ \t]*$", re.S)
_RULE = re.compile(r"(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_FENCE = re.compile(r"(`{3,})([^`]*)$|(~{3,})(.*)$", re.S)
_BULLET = re.compile(r"([-+*])(?=[ \t]|$)")
_ORDERED = re.compile(r"([0-9]{1,9})([.)])(?=[ \t]|$)")
_SETEXT = re.compile(r"(=+|-+)[ \t]*$")
_DELIMITER = re.compile(r":?-+:?")
_REFERENCE = re.compile(r"\[(?=[^\]]*\S)(?:\\.|[^\[\]\\]){1,999}\]:[ \t]*(<[^<>]*>|[^\s<]\S*)?(?:[ \t]+(\"[^\"]*\"|'[^']*'|\([^()]*\)))?[ \t]*$")
_TITLE = re.compile(r"(\"[^\"]*\"|'[^']*'|\([^()]*\))[ \t]*$")
# The tags that open raw HTML blocks up to the next blank line.
_HTML_TAGS = (
    "address|article|aside|base|basefont|blockquote|body|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|fieldset|"
    "figcaption|figure|footer|form|frame|frameset|h1|h2|h3|h4|h5|h6|head|header|hr|html|iframe|legend|li|link|main|menu|menuitem|"
    "nav|noframes|ol|optgroup|option|p|param|search|section|summary|table|tbody|td|tfoot|th|thead|title|tr|track|ul"
)
_ATTRIBUTE = r"(?:\s+[A-Za-z_:][A-Za-z0-9_.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)"
#: (opening, closing or None for a blank line, may interrupt a paragraph)
_HTML = (
    (re.compile(r"<(?:script|pre|style|textarea)(?=\s|>|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I), True),
    (re.compile(r"<!--"), re.compile(r"-->"), True),
    (re.compile(r"<\?"), re.compile(r"\?>"), True),
    (re.compile(r"<![A-Z]"), re.compile(r">"), True),
    (re.compile(r"<!\[CDATA\["), re.compile(r"\]\]>"), True),
    (re.compile(rf"</?(?:{_HTML_TAGS})(?=\s|/?>|$)", re.I), None, True),
    (re.compile(rf"(?:<[A-Za-z][A-Za-z0-9-]*{_ATTRIBUTE}*\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>)\s*$"), None, False),
)


def physical_lines(text: str) -> list[str]:
    """Lines with their endings; only CR, LF and CR LF end one."""
    return _LINE.findall(text)


@dataclass(slots=True)
class Line:
    number: int  # from 0
    text: str  # without its ending and the prefixes of the containers around it
    column: int = 0
    lazy: bool = False

    def lead(self) -> tuple[int, str]:
        """Columns of indentation and what follows."""
        column = self.column
        for i, ch in enumerate(self.text):
            if ch == " ":
                column += 1
            elif ch == "\t":
                column += 4 - column % 4
            else:
                return column - self.column, self.text[i:]
        return column - self.column, ""

    def without(self, columns: int) -> Line:
        """The line less some columns of indentation; a tab cut in two leaves its rest as spaces."""
        column, i = self.column, 0
        while column < self.column + columns and i < len(self.text) and self.text[i] in " \t":
            column += 1 if self.text[i] == " " else 4 - column % 4
            i += 1
        return Line(self.number, " " * max(0, column - self.column - columns) + self.text[i:], min(column, self.column + columns), self.lazy)

    def blank(self) -> bool:
        return not self.text.strip(" \t")


@dataclass(slots=True)
class Block:
    kind: str
    start: int  # first line, from 0
    end: int  # behind the last line
    children: list[Block] = field(default_factory=list)
    level: int = 0  # of headings
    title: str = ""


def _opens(line: Line, following: Line | None, paragraph: bool) -> str | None:
    """The kind of block that a line opens; with ``paragraph`` only what may interrupt one."""
    indent, rest = line.lead()
    if indent > 3:
        return None if paragraph else "indented_code"
    if _FENCE.match(rest):
        return "fenced_code"
    if rest[0] == ">":
        return "blockquote"
    if _RULE.match(rest):
        return "thematic_break"
    if m := _BULLET.match(rest):
        if not paragraph or rest[m.end() :].strip(" \t"):
            return "bullet_list"
    elif m := _ORDERED.match(rest):
        if not paragraph or (int(m[1]) == 1 and rest[m.end() :].strip(" \t")):
            return "ordered_list"
    if _HEADING.match(rest):
        return "heading"
    for opening, _, interrupts in _HTML:
        if opening.match(rest) and (interrupts or not paragraph):
            return "html_block"
    if following is not None and not following.lazy and _delimiters(rest, following):
        return "table"
    return None


def cells(row: str) -> list[str]:
    """The cells of a table row: unescaped pipes part them, and one at either end counts for nothing."""
    parts = [p.replace("\\|", "|").strip(" \t") for p in re.split(r"(?<!\\)\|", row.strip(" \t"))]
    if parts and parts[0] == "":
        parts = parts[1:]
    return parts[:-1] if parts and parts[-1] == "" else parts


def _delimiters(header: str, line: Line) -> bool:
    indent, rest = line.lead()
    if indent > 3 or not rest or rest[0] not in "|-:" or set(rest) - set("|-: \t") or (len(rest) > 1 and rest[0] == "-" and rest[1] in " \t") or len(rest) < 2:
        return False
    if "|" not in header or (found := cells(rest)) == []:
        return False
    return all(_DELIMITER.fullmatch(c) for c in found) and len(found) == len(cells(header))


def scan(lines: list[Line], depth: int = 0) -> tuple[list[Block], int]:
    """The blocks of a container's lines, and how many of these lines it keeps."""
    out, i = [], 0
    while i < len(lines):
        if lines[i].blank():
            i += 1
            continue
        if lines[i].lazy:  # continues no paragraph, so the container ended before it
            break
        kind = _opens(lines[i], lines[i + 1] if i + 1 < len(lines) else None, False)
        if depth >= DEPTH and kind in ("blockquote", "bullet_list", "ordered_list"):
            kind = None
        block, i = _SCANNERS.get(kind, _paragraph)(lines, i, depth)
        if block is not None:
            out.append(block)
    return out, i


def _end(lines: list[Line], i: int) -> int:
    return lines[i - 1].number + 1


def _paragraph(lines: list[Line], i: int, depth: int) -> tuple[Block | None, int]:
    first = i
    if (after := _reference(lines, i)) > i:
        return None, after
    i += 1
    while i < len(lines) and not lines[i].blank():
        indent, rest = lines[i].lead()
        if not lines[i].lazy and indent <= 3 and (m := _SETEXT.match(rest)):
            title = "\n".join(x.text.strip(" \t") for x in lines[first:i]).strip()
            return Block("heading", lines[first].number, lines[i].number + 1, level=1 if m[1][0] == "=" else 2, title=title), i + 1
        if indent <= 3 and not lines[i].lazy and _opens(lines[i], lines[i + 1] if i + 1 < len(lines) else None, True):
            break
        i += 1
    return Block("paragraph", lines[first].number, _end(lines, i)), i


def _reference(lines: list[Line], i: int) -> int:
    """Behind a link reference definition, or ``i``."""
    indent, rest = lines[i].lead()
    if indent > 3 or rest[:1] != "[" or not (m := _REFERENCE.match(rest)):
        return i
    i += 1
    if m[1] is None:  # the destination stands on the next line
        if i >= len(lines) or lines[i].blank() or lines[i].lazy or len(lines[i].text.split()) != 1:
            return i - 1
        i += 1
    if m[2] is None and i < len(lines) and not lines[i].lazy and _TITLE.match(lines[i].text.strip(" \t")):
        i += 1
    return i


def _indented(lines: list[Line], i: int, depth: int) -> tuple[Block, int]:
    first = last = i
    while i < len(lines) and not lines[i].lazy:
        if not lines[i].blank():
            if lines[i].lead()[0] < 4:
                break
            last = i
        i += 1
    return Block("indented_code", lines[first].number, lines[last].number + 1), last + 1


def _fenced(lines: list[Line], i: int, depth: int) -> tuple[Block, int]:
    first = i
    m = _FENCE.match(lines[i].lead()[1])
    fence = m[1] or m[3]
    i += 1
    while i < len(lines) and not lines[i].lazy:
        indent, rest = lines[i].lead()
        bare = rest.rstrip(" \t")
        i += 1
        if indent <= 3 and len(bare) >= len(fence) and set(bare) == {fence[0]}:
            break
    return Block("fenced_code", lines[first].number, _end(lines, i)), i


def _html(lines: list[Line], i: int, depth: int) -> tuple[Block, int]:
    first, rest = i, lines[i].lead()[1]
    closing = next(c for o, c, _ in _HTML if o.match(rest))
    while i < len(lines) and not lines[i].lazy:
        if closing is None and lines[i].blank():
            break
        i += 1
        if closing is not None and closing.search(lines[i - 1].text):
            break
    return Block("html_block", lines[first].number, _end(lines, i)), i


def _rule(lines: list[Line], i: int, depth: int) -> tuple[Block, int]:
    return Block("thematic_break", lines[i].number, lines[i].number + 1), i + 1


def _heading(lines: list[Line], i: int, depth: int) -> tuple[Block, int]:
    m = _HEADING.match(lines[i].lead()[1])
    title = m[2].strip(" \t")
    return Block("heading", lines[i].number, lines[i].number + 1, level=len(m[1]), title="" if set(title) == {"#"} else title), i + 1


def _table(lines: list[Line], i: int, depth: int) -> tuple[Block, int]:
    first = i
    rows = [Block("table_row", lines[i].number, lines[i].number + 1)]
    i += 2
    while i < len(lines) and not lines[i].blank() and not lines[i].lazy:
        if lines[i].lead()[0] > 3 or _opens(lines[i], None, True):
            break
        rows.append(Block("table_row", lines[i].number, lines[i].number + 1))
        i += 1
    return Block("table", lines[first].number, _end(lines, i), rows), i


def _quote(lines: list[Line], i: int, depth: int) -> tuple[Block, int]:
    first, inner = i, []
    while i < len(lines):
        indent, rest = lines[i].lead()
        if indent <= 3 and rest[:1] == ">" and not lines[i].lazy:
            stripped = lines[i].without(indent)
            own = Line(stripped.number, stripped.text[1:], stripped.column + 1)
            if own.text[:1] in (" ", "\t"):
                own = own.without(1)
            inner.append(own)
        elif lines[i].blank() or (not lines[i].lazy and indent <= 3 and _opens(lines[i], None, True)):
            break
        else:
            inner.append(Line(lines[i].number, lines[i].text, lines[i].column, True))
        i += 1
    children, used = scan(inner, depth + 1)
    return Block("blockquote", lines[first].number, inner[max(used, 1) - 1].number + 1, children), first + max(used, 1)


def _marker(line: Line) -> tuple[str, int] | None:
    """What a list item's line makes its list of, and the columns up to its marker's end."""
    indent, rest = line.lead()
    if indent > 3 or line.lazy or _RULE.match(rest):
        return None
    if m := _BULLET.match(rest):
        return m[1], indent + 1
    if m := _ORDERED.match(rest):
        return m[2], indent + m.end()
    return None


def _list(lines: list[Line], i: int, depth: int) -> tuple[Block, int]:
    first, items = i, []
    sign = _marker(lines[i])[0]
    kind = "bullet_list" if sign in "-+*" else "ordered_list"
    while i < len(lines) and not lines[i].blank() and (found := _marker(lines[i])) and found[0] == sign:
        line, width = lines[i], found[1]
        head = line.lead()[1]
        stripped = line.without(line.lead()[0])
        after = Line(line.number, stripped.text[len(head) - len(head[width - line.lead()[0] :]) :], line.column + width)
        gap, content = after.lead()
        gap = 1 if not content or gap > 4 else gap
        inner, reach = [after.without(gap) if content else Line(line.number, "", line.column + width)], width + gap
        j, paused = i + 1, not content
        while j < len(lines):
            here = lines[j]
            if here.blank():
                if not content and j == i + 1:  # an item that begins with a blank line has that line only
                    j += 1
                    while j < len(lines) and lines[j].blank():
                        j += 1
                    inner += [Line(x.number, "", x.column) for x in lines[i + 1 : j]]
                    break
                inner.append(Line(here.number, "", here.column))
                paused = True
            elif here.lead()[0] >= reach and not here.lazy:
                inner.append(here.without(reach))
                paused = False
            elif paused or (not here.lazy and _opens(here, None, True)) or _marker(here):
                break
            else:
                inner.append(Line(here.number, here.text, here.column, True))
            j += 1
        children, used = scan(inner, depth + 1)
        used = max(used, 1)
        items.append(Block("list_item", line.number, inner[used - 1].number + 1, children))
        i += used
    return Block(kind, lines[first].number, items[-1].end, items), i


_SCANNERS = {
    "indented_code": _indented, "fenced_code": _fenced, "html_block": _html, "thematic_break": _rule, "heading": _heading,
    "table": _table, "blockquote": _quote, "bullet_list": _list, "ordered_list": _list,
}


def top_blocks(lines: list[str]) -> list[Block]:
    """The top-level blocks of physical lines, headings among them."""
    return scan([Line(i, x.rstrip("\r\n")) for i, x in enumerate(lines)])[0]


@dataclass(slots=True)
class Section:
    ordinal: int
    parent: int | None
    level: int
    heading: str | None
    path: list[str]
    body: str
    line_start: int  # from 1
    line_end: int
    blocks: list[tuple]  # (block_id, parent_block_id, depth, kind, raw_text, line_start, line_end), in pre-order


def _rows(blocks: list[Block], lines: list[str], start: int, end: int) -> list[tuple]:
    """The blocks that cover lines ``start`` to ``end`` (from 0, exclusive), gaps filled, as flat rows."""
    rows: list[tuple] = []

    def add(block: Block, parent: int | None, depth: int) -> None:
        stack = [(block, parent, depth)]
        while stack:
            b, p, d = stack.pop()
            own = len(rows)
            if b.kind != "heading":
                rows.append((own, p, d, b.kind, "".join(lines[b.start : b.end]), b.start + 1, b.end))
                stack += [(c, own, d + 1) for c in reversed(b.children)]

    def gap(a: int, b: int) -> None:
        raw = "".join(lines[a:b])
        rows.append((len(rows), None, 0, "raw" if raw.strip() else "blank", raw, a + 1, b))

    at = start
    for block in blocks:
        if block.kind == "heading" or block.start < start or block.end > end:
            continue
        if at < block.start:
            gap(at, block.start)
        add(block, None, 0)
        at = block.end
    if at < end:
        gap(at, end)
    return rows


def parse(text: str) -> list[Section]:
    """The sections of a document: one per top-level heading, and a preamble where text stands before the first."""
    lines = physical_lines(text)
    blocks = top_blocks(lines)
    places = [i for i, b in enumerate(blocks) if b.kind == "heading"]
    heads = [blocks[i] for i in places]
    out: list[Section] = []
    if not text.strip():
        return out
    first = heads[0].start if heads else len(lines)
    preamble = "".join(lines[:first])
    if preamble.strip():
        out.append(Section(0, None, 0, None, [], preamble, 1, first, _rows(blocks[: places[0]] if places else blocks, lines, 0, first)))
    stack: list[Section] = []
    for place, next_place, head, following in zip(places, [*places[1:], len(blocks)], heads, [*heads[1:], None]):
        end = following.start if following else len(lines)
        while stack and stack[-1].level >= head.level:
            stack.pop()
        parent = stack[-1] if stack else None
        own = Section(
            len(out), parent.ordinal if parent else None, head.level, head.title, [*(parent.path if parent else []), head.title],
            "".join(lines[head.end : end]), head.start + 1, max(end, head.end), _rows(blocks[place + 1 : next_place], lines, head.end, end),
        )
        out.append(own)
        stack.append(own)
    return out


# --- on DataFrames ---

BLOCKS = "array<struct<block_id:int,parent_block_id:int,depth:int,kind:string,raw_text:string,line_start:int,line_end:int>>"
SECTIONS = f"ordinal int, parent_ordinal int, level int, heading string, heading_path array<string>, body string, line_start int, line_end int, blocks {BLOCKS}"
_BLOCK_TYPE = pa.list_(pa.struct([("block_id", pa.int32()), ("parent_block_id", pa.int32()), ("depth", pa.int32()), ("kind", pa.string()), ("raw_text", pa.string()), ("line_start", pa.int32()), ("line_end", pa.int32())]))
_BLOCK_NAMES = [f.name for f in _BLOCK_TYPE.value_type]


BATCH_CHARACTERS = 1 << 21


def in_batches(rows: Iterator[tuple[int, tuple]], kinds: tuple, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Arrow batches of rows that come with their lengths in characters: as many rows as hold about two million."""
    held, length = [], 0
    make = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
    for n, row in rows:
        held.append(row)
        length += n
        if length >= BATCH_CHARACTERS or len(held) >= 10_000:
            yield make()
            held, length = [], 0
    if held:
        yield make()


def taken(batch: pa.RecordBatch, rows: int = 32) -> Iterator[tuple]:
    """The rows of a batch as Python's values, of which few are held at a time."""
    for lo in range(0, batch.num_rows, rows):
        yield from zip(*(c.to_pylist() for c in batch.slice(lo, rows).columns))


def spread(documents: DataFrame, key: str) -> DataFrame:
    """The documents dealt to all cores: few large files would be read by few tasks, and parsing takes far longer than that."""
    spark = documents.sparkSession
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return documents.repartition(tasks, key)


def sections(documents: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row for each section of each document (with its key); a null or blank text has none."""
    names = [key, *(f.split()[0] for f in SECTIONS.rsplit(", blocks ", 1)[0].split(", ")), "blocks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = (
                (4 * len(s.body), (own, s.ordinal, s.parent, s.level, s.heading, s.path, s.body, s.line_start, s.line_end, [dict(zip(_BLOCK_NAMES, b)) for b in s.blocks]))
                for own, source in taken(batch)
                for s in parse(source or "")
            )
            kinds = (batch.column(0).type, pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.string(), pa.int32(), pa.int32(), _BLOCK_TYPE)
            yield from in_batches(rows, kinds, names)

    return spread(documents.select(key, text), key).mapInArrow(run, f"{key} {documents.schema[key].dataType.simpleString()}, {SECTIONS}")


def blocks(sectioned: DataFrame) -> DataFrame:
    """A row for each block of each section."""
    return sectioned.select("doc_id", "ordinal", F.explode("blocks").alias("b")).select("doc_id", "ordinal", "b.*")


def reparse_faults(sectioned: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, ordinal, fault): stored sections whose body, read again by itself, isn't what is stored.

    ``body``: the blocks at the top don't cover the body, piece by piece; ``lines``: the section's lines aren't as many as
    the body has, or its blocks don't follow each other's lines; ``tree``: the body parses to other blocks (kinds, parents,
    depths, texts and lines). A section is named with its first fault. A null body with blocks, or without, is ``body``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for own, ordinal, body, start, end, level, held in taken(batch):
                fault = _fault(body, start, end, level, [tuple(b[n] for n in _BLOCK_NAMES) for b in held or []])
                if fault:
                    out.append((0, (own, ordinal, fault)))
            yield from in_batches(iter(out), (batch.column(0).type, pa.int32(), pa.string()), [key, "ordinal", "fault"])

    kind = sectioned.schema[key].dataType.simpleString()
    return sectioned.select(key, "ordinal", "body", "line_start", "line_end", "level", "blocks").mapInArrow(run, f"{key} {kind}, ordinal int, fault string")


def _fault(body: str | None, start: int, end: int, level: int, rows: list[tuple]) -> str | None:
    top = [r for r in rows if r[1] is None]
    if body is None or "".join(r[4] for r in top) != body:
        return "body"
    lines = physical_lines(body)
    first = end - len(lines) + 1  # a heading's own lines come before
    if start > first or (level == 0 and start != first) or [r[5] for r in top] != [first, *(r[6] + 1 for r in top[:-1])][: len(top)] or (top and top[-1][6] != end):
        return "lines"
    again = _rows(scan([Line(i, x.rstrip("\r\n")) for i, x in enumerate(lines)])[0], lines, 0, len(lines))
    moved = [(*r[:5], r[5] + first - 1, r[6] + first - 1) for r in again]
    return None if moved == rows else "tree"
