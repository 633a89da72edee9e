"""A corpus pipeline: quality, exact copies, near copies, personal data, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents.

Defined results: rows with null or empty text count as empty texts in every stage, as each operator says; very long texts are
read whole by every stage; of rows that are alike, repeated ones and ones that share an id included, one stays after the exact
dedup; ties between copies go to the longest text and then the smallest doc_id, between near copies to the smallest doc_id; an
empty table passes through to no rows; columns beyond those of documents are kept by all stages but the last, whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folio.llm import exact_dedup, near_dup, packing, pii, quality
from folio.llm.common import documents, released, scratch, written

STAGES = [
    ("quality", quality.stage),
    ("exact_dedup", exact_dedup.stage),
    ("near_dup", near_dup.stage),
    ("pii", pii.stage),
    ("packing", packing.stage),
]

#: Compression and trained scores aren't SQL; tests compare every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; the rows of the last."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        with scratch(spark):  # what a stage wrote on its way goes when its rows are written
            docs = released(written(stage(spark, docs, sf_dir), name))
    return STAGES[-1][1](spark, docs, sf_dir)
