"""Table functions for SQL: sections and chunks of a table of documents.

    register(spark, counter, config)
    SELECT * FROM folio_chunks(TABLE(SELECT doc_id, text FROM documents))
    SELECT * FROM folio_sections(TABLE(SELECT doc_id, text FROM documents) PARTITION BY doc_id)

The first column of the table is the key, the second the text; the key keeps its type in the result. Without a partitioning
every task runs over the rows that it has, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from folio.operators import chunking, markdown


def _analysed(columns: str):
    fields = StructType.fromDDL(columns).fields  # on the driver: only it reads type strings

    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        if not table.isTable or len(table.dataType.fields) != 2 or table.dataType.fields[1].dataType.simpleString() != "string":
            raise ValueError("the argument is a table of a key and a text")
        key = table.dataType.fields[0]
        return AnalyzeResult(StructType([StructField(key.name, key.dataType), *fields]))

    return staticmethod(analyze)


def register(spark: SparkSession, counter: chunking.TokenCounter, config: str, limits: chunking.Limits = chunking.Limits(), parser: str = markdown.PARSER_VERSION) -> None:
    """Makes ``folio_sections`` and ``folio_chunks`` known to the session's SQL; chunks are those of the given counter."""

    class Sections:
        analyze = _analysed(markdown.SECTIONS.rsplit(", blocks ", 1)[0] + ", n_blocks int")

        def eval(self, row: Row) -> Iterator[tuple]:
            for s in markdown.parse(row[1] or ""):
                yield row[0], s.ordinal, s.parent, s.level, s.heading, s.path, s.body, s.line_start, s.line_end, len(s.blocks)

    class Chunks:
        analyze = _analysed(chunking.CHUNKS)

        def __init__(self):
            self.chunker = chunking.Chunker(counter, limits)

        def eval(self, row: Row) -> Iterator[tuple]:
            for s in markdown.parse(row[1] or ""):
                for i, d in enumerate(self.chunker.split(s.path, s.body, s.blocks)):
                    yield row[0], s.ordinal, i, *chunking.drafted(d, s.path, parser, config)

    spark.udtf.register("folio_sections", udtf(Sections))
    spark.udtf.register("folio_chunks", udtf(Chunks))
