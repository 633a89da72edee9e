"""Explicit document relations: a strict sidecar format, its validation over tables, and conflicts in both directions."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions.paths import canonical, strictly_canonical

TYPES = ("supersedes", "potential_conflict")
FIELDS = {
    "from_source_path": str, "to_source_path": str, "relation_type": str, "evidence_source_path": str,
    "evidence_line_start": int, "evidence_line_end": int,
}
SCHEMA = "position int, from_source_path string, to_source_path string, relation_type string, evidence_source_path string, evidence_line_start int, evidence_line_end int"


def _once(pairs: list[tuple]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("a key stands twice")
    return out


def parse_sidecar(payload: bytes) -> list[dict]:
    """The entries of a sidecar in their order; anything but the exact format raises ValueError."""
    try:
        root = json.loads(payload.decode("utf-8"), object_pairs_hook=_once)
    except RecursionError as error:
        raise ValueError("nested too deeply") from error
    if type(root) is not dict or root.keys() != {"relations"} or type(root["relations"]) is not list:
        raise ValueError("a sidecar holds one array of relations")
    for entry in root["relations"]:
        if type(entry) is not dict or entry.keys() != FIELDS.keys() or any(type(entry[k]) is not kind for k, kind in FIELDS.items()):
            raise ValueError("an entry lacks a field, has another or one of the wrong type")
        for key in ("from_source_path", "to_source_path", "evidence_source_path"):
            entry[key] = canonical(entry[key])
    return root["relations"]


def sidecar_table(spark: SparkSession, payload: bytes) -> DataFrame:
    rows = [(i, *(e[k] for k in FIELDS)) for i, e in enumerate(parse_sidecar(payload))]
    return spark.createDataFrame(rows, SCHEMA)


def violations(relations: DataFrame, files: DataFrame) -> DataFrame:
    """(position, rule) of relations that don't hold; ``files``: source_path and n_lines (null where not UTF-8)."""
    known = files.select(F.col("source_path"), "n_lines")
    sides = relations
    for name in ("from", "to", "evidence"):
        own = known.select(F.col("source_path").alias(f"{name}_source_path"), F.lit(True).alias(f"{name}_known"), F.col("n_lines").alias(f"{name}_lines"))
        sides = sides.join(own, f"{name}_source_path", "left")
    unsafe = ~(strictly_canonical(F.col("from_source_path")) & strictly_canonical(F.col("to_source_path")) & strictly_canonical(F.col("evidence_source_path")))
    rules = {
        "type": ~F.col("relation_type").isin(*TYPES),
        "lines": (F.col("evidence_line_start") < 1) | (F.col("evidence_line_end") < F.col("evidence_line_start")),
        "path": unsafe,
        "self": F.col("from_source_path") == F.col("to_source_path"),
        "missing": F.col("from_known").isNull() | F.col("to_known").isNull() | F.col("evidence_known").isNull(),
        "encoding": F.col("evidence_known") & F.col("evidence_lines").isNull(),
        "past_end": F.col("evidence_line_end") > F.col("evidence_lines"),
    }
    broken = F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(False)), F.lit(rule)) for rule, test in rules.items())))
    own = sides.select("position", F.explode(broken).alias("rule"))
    exact = relations.groupBy(*FIELDS).agg(F.min("position").alias("first"))
    repeats = relations.join(exact, list(FIELDS)).where("position > first").select("position", F.lit("repeat").alias("rule"))
    conflicts = relations.where("relation_type = 'potential_conflict'").withColumns({"lo": F.least("from_source_path", "to_source_path"), "hi": F.greatest("from_source_path", "to_source_path")})
    once = conflicts.groupBy("lo", "hi").agg(F.min("position").alias("first"))
    reversed_ = conflicts.join(once, ["lo", "hi"]).where("position > first").select("position", F.lit("conflict_twice").alias("rule"))
    return own.unionByName(repeats).unionByName(reversed_)


def exposed(relations: DataFrame) -> DataFrame:
    """Each potential conflict seen from both of its sides."""
    own = relations.where("relation_type = 'potential_conflict'")
    flipped = own.withColumns({"from_source_path": F.col("to_source_path"), "to_source_path": F.col("from_source_path")})
    return own.unionByName(flipped)
