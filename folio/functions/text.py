"""Text expressions: physical lines, white space, trigrams."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

LINES = r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+"
#: White space as the reference's ``strip`` knows it: Unicode's, and U+001C to U+001F.
BLANK = r"[\p{IsWhite_Space}\x1c-\x1f]"


def physical_lines(text: Column) -> Column:
    """Lines with their endings, in order; only CR, LF and CR LF end one."""
    return F.regexp_extract_all(text, F.lit(LINES), F.lit(0))


def not_blank(text: Column) -> Column:
    return F.coalesce(F.rlike(text, F.lit(rf"[^\p{{IsWhite_Space}}\x1c-\x1f]")), F.lit(False))


def words_apart(text: Column) -> Column:
    """Lower-cased words with three blanks between them, two before the first and one behind the last."""
    return F.concat(F.lit("  "), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "   "), F.lit(" "))


def trigram_codes(apart: str) -> np.ndarray:
    """The distinct trigrams of ``words_apart``, ascending, each as one number: three code points of 21 bits."""
    at = np.frombuffer(apart.encode("utf-32-le"), np.uint32).astype(np.int64)
    blank = at == 32
    within = ~blank[1:-1] | (blank[:-2] & ~blank[2:])  # a blank in the middle has one before it and none behind
    return np.unique(((at[:-2] << 42) | (at[1:-1] << 21) | at[2:])[within])


def trigram_text(code: Column) -> Column:
    """The trigram of a code."""
    point = lambda by: F.lpad(F.hex(F.shiftright(code, by).bitwiseAND(F.lit((1 << 21) - 1))), 8, "0")
    return F.decode(F.unhex(F.concat(point(42), point(21), point(0))), "UTF-32")


def sha_shape(value: Column, digits: int = 64) -> Column:
    return F.rlike(value, F.lit(f"^[0-9a-f]{{{digits}}}\\z"))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once for a row, also where it is used for each element of an array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def pieces(text: Column, size: int) -> Column:
    """The text in pieces of ``size`` characters, the last one shorter; one pass, whatever its length."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def cut(parts: Column, size: int, start: Column, length: Column, longest: int) -> Column:
    """What ``substr`` gives of the text of ``pieces``, from ``start`` (from 0), for lengths up to ``longest``."""
    first = F.floor(start / size).cast("int")
    return F.substr(F.array_join(F.slice(parts, first + 1, F.lit(longest // size + 2)), ""), start - first * size + 1, length)


def running(values: Column, group: int = 256) -> Column:
    """For each of an array's integers, the sum of those before it. In groups, so the work isn't the square of their number."""
    none = F.array().cast("array<int>")

    def before(each: Column) -> Column:
        state = F.struct(none.alias("sums"), F.lit(0).alias("sum"))
        return F.aggregate(each, state, lambda s, x: F.struct(F.array_append(s["sums"], s["sum"]).alias("sums"), (s["sum"] + x).alias("sum")))["sums"]

    count = F.ceil(F.size(values) / group).cast("int")
    groups = F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda k: F.slice(values, k * group + 1, group)))
    totals = lambda own: before(F.transform(own, lambda g: F.aggregate(g, F.lit(0), lambda s, x: s + x)))
    whole = let(groups, lambda own: F.flatten(F.zip_with(own, totals(own), lambda g, past: F.transform(before(g), lambda x: x + past))))
    return F.coalesce(whole, none)
