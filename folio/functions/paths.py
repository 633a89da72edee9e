"""Repository paths: canonical form and include/exclude patterns, compiled to regular expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def path_error(path: Column) -> Column:
    """Why a path can't be canonical, or null."""
    return (
        F.when(path.isNull() | (path == ""), F.lit("empty"))
        .when(F.contains(path, F.lit("\x00")), F.lit("nul"))
        .when(F.contains(path, F.lit("\\")), F.lit("backslash"))
        .when(F.startswith(path, F.lit("/")), F.lit("absolute"))
        .when(F.array_contains(F.split(path, "/"), ".."), F.lit("parent"))
        .when(F.size(_segments(path)) == 0, F.lit("empty"))
    )


def _segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))


def canonical_path(path: Column) -> Column:
    """The path without empty and ``.`` segments; null where it has an error."""
    return F.when(path_error(path).isNull(), F.array_join(_segments(path), "/"))


def strictly_canonical(path: Column) -> Column:
    """Whether a path is canonical as it stands."""
    return F.coalesce(canonical_path(path) == path, F.lit(False))


def canonical(path: str) -> str:
    """The same for one path on the driver; raises ValueError."""
    if not path or "\x00" in path or "\\" in path or path.startswith("/") or ".." in path.split("/"):
        raise ValueError("unsafe path")
    kept = [s for s in path.split("/") if s not in ("", ".")]
    if not kept:
        raise ValueError("empty path")
    return "/".join(kept)


def _segment(pattern: str) -> str:
    """One segment's wildcards as a regular expression that Java, RE2 and Python read alike."""
    out, i = "", 0
    while i < len(pattern):
        ch, i = pattern[i], i + 1
        if ch == "*":
            out += "[^/]*"
        elif ch == "?":
            out += "[^/]"
        elif ch == "[" and (end := pattern.find("]", i + 1 + (pattern[i : i + 1] == "!"))) > 0:
            own = pattern[i:end]
            negated, own = own.startswith("!"), own.removeprefix("!")
            own = re.sub(r"([\\\[\]^&~])", r"\\\1", own)
            out += f"[^/{own}]" if negated else f"[{own}]"
            i = end + 1
        else:
            out += re.escape(ch)
    return out


def compiled(pattern: str) -> str:
    """An expression to match against ``/`` and the canonical path; ``**`` stands for any number of whole segments."""
    return "^" + "".join("(?:/[^/]+)*" if s == "**" else "/" + _segment(s) for s in pattern.split("/")) + "\\z"


def selected(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Whether a profile selects a path: some include matches and no exclude does."""
    rooted = F.concat(F.lit("/"), canonical_path(path))
    any_of = lambda patterns: F.rlike(rooted, F.lit("|".join(map(compiled, patterns)))) if patterns else F.lit(False)
    return F.coalesce(any_of(include) & ~any_of(exclude), F.lit(False))
