"""Formats whose documents can't be split: a document is one task's work, many documents run in parallel."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A parsed triple: subj, subj_kind, pred, obj, obj_kind, dtype, lang, graph.
Row = tuple[str, str, str, str, str, str | None, str | None, str | None]
_COLUMNS = ["file", "row", "subj", "subj_kind", "pred", "obj", "obj_kind", "dtype", "lang", "graph"]
_BATCH = 10_000


def scope_of(text: str, base: str) -> str:
    """A mark of one document, so that nodes it leaves unnamed are no other document's."""
    return hashlib.sha1(f"{base}\n{text}".encode("utf-8", "surrogatepass"), usedforsecurity=False).hexdigest()[:12]


def parse_each(documents: DataFrame, parser: Callable[[str, str], Iterable[Row]]) -> DataFrame:
    """Triples of documents (file, value)."""

    def run(batches):
        rows = []
        for batch in batches:
            for file, text in zip(batch["file"], batch["value"]):
                for n, row in enumerate(parser(text, file)):
                    rows.append((file, n, *row))
                    if len(rows) >= _BATCH:
                        yield pd.DataFrame(rows, columns=_COLUMNS)
                        rows = []
        if rows:
            yield pd.DataFrame(rows, columns=_COLUMNS)

    schema = ", ".join(f"{c} {'long' if c == 'row' else 'string'}" for c in _COLUMNS)
    out = documents.mapInPandas(run, schema)
    return out.select(F.struct("file", F.lit(0).cast("long").alias("block"), "row").alias("ord"), *_COLUMNS[2:])


def read_each(spark: SparkSession, path: str | list[str], parser: Callable[[str, str], Iterable[Row]]) -> DataFrame:
    text = spark.read.text(path, wholetext=True)
    return parse_each(text.select(F.col("_metadata.file_path").alias("file"), "value"), parser)
