"""N-Triples and N-Quads: one statement a line, so files are split at will and all work is in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.terms import TRIPLE, XSD

_IRI = r"<([^<>\"{}|^`\\\x00-\x20]*(?:\\[uU][0-9A-Fa-f]+[^<>\"{}|^`\\\x00-\x20]*)*)>"
_BNODE = r"_:([A-Za-z0-9_·-￿][A-Za-z0-9_.·-￿-]*)"
_STRING = r"\"((?:[^\"\\]|\\.)*)\""
_SUFFIX = rf"(?:\^\^{_IRI}|@([A-Za-z]+(?:-[A-Za-z0-9]+)*))?"
#: Groups: 1-2 subject, 3 predicate, 4-5 object, 6 literal, 7 datatype, 8 language, 9-10 graph.
STATEMENT = rf"^\s*(?:{_IRI}|{_BNODE})\s*{_IRI}\s*(?:{_IRI}|{_BNODE}|{_STRING}{_SUFFIX})\s*(?:{_IRI}|{_BNODE})?\s*\.\s*(?:#.*)?$"
BLANK = r"^\s*(?:#.*)?$"


def unescape(text: Column) -> Column:
    """Resolve string escapes, also those of code points, without leaving the JVM."""
    hidden = F.replace(text, F.lit("\\\\"), F.lit("\\-"))  # a double backslash becomes an escape of its own
    parts = F.split(hidden, "\\\\")

    def code(x: Column, digits: int, charset: str) -> Column:
        return F.concat(F.decode(F.unhex(F.substring(x, 2, digits)), charset), F.substr(x, F.lit(2 + digits)))

    def one(x: Column, i: Column) -> Column:
        rest = F.substr(x, F.lit(2))
        head = F.substring(x, 1, 1)
        out = F.when(i == 0, x)
        for mark, char in (("-", "\\"), ("n", "\n"), ("t", "\t"), ("r", "\r"), ("b", "\b"), ("f", "\f"), ('"', '"'), ("'", "'")):
            out = out.when(head == mark, F.concat(F.lit(char), rest))
        return out.when(head == "u", code(x, 4, "UTF-16BE")).when(head == "U", code(x, 8, "UTF-32")).otherwise(x)

    return F.when(F.contains(text, F.lit("\\")), F.array_join(F.transform(parts, one), "")).otherwise(text)


#: All groups of a statement with a line break between them: no statement has one.
_GROUPS = "\n".join(f"${n}" for n in range(1, 11))


def parse(rows: DataFrame) -> DataFrame:
    """Triples of rows (file, block, row, value), each a line. A line that is neither a statement nor blank is an error.

    The error is in a filter, which no choice of columns can take away.
    """
    rows = rows.filter(~F.col("value").rlike(BLANK))
    m = rows.select("file", "block", "row", "value", F.split(F.regexp_replace("value", STATEMENT, _GROUPS), "\n", -1).alias("g"))
    bad = F.raise_error(F.concat(F.lit("not a statement: "), F.col("value"))).cast("boolean")
    m = m.filter(F.when(F.size("g") == 10, F.lit(True)).otherwise(bad))
    g = lambda n: F.nullif(F.col("g")[n - 1], F.lit(""))
    literal = g(4).isNull() & g(5).isNull()
    obj = F.when(literal, unescape(F.col("g")[5])).otherwise(F.coalesce(unescape(g(4)), g(5)))
    out = m.select(
        F.struct("file", "block", "row").alias("ord"),
        F.coalesce(unescape(g(1)), g(2)).alias("subj"),
        F.when(g(1).isNotNull(), "iri").otherwise("bnode").alias("subj_kind"),
        unescape(g(3)).alias("pred"),
        obj.alias("obj"),
        F.when(literal, "literal").when(g(4).isNotNull(), "iri").otherwise("bnode").alias("obj_kind"),
        F.when(literal, F.coalesce(g(7), F.when(g(8).isNull(), F.lit(XSD + "string")))).alias("dtype"),
        g(8).alias("lang"),
        F.coalesce(g(9), g(10)).alias("graph"),
    )
    return out.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in TRIPLE.fields))


def read(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Triples of text files. The order is taken at the scan: file, block, row."""
    text = spark.read.text(path)
    return parse(text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), "value"))


def scoped(triples: DataFrame) -> DataFrame:
    """Blank nodes with the file they come from in their ids."""
    own = lambda c: F.when(F.col(f"{c}_kind") == "bnode", F.concat(F.sha1(F.coalesce("ord.file", F.lit(""))), F.lit("-"), F.col(c))).otherwise(F.col(c))
    return triples.withColumns({"subj": own("subj"), "obj": own("obj")})
