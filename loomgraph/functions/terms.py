"""Terms: parts of IRIs, node identity and typed values, all as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"
RDF_TYPE = RDF + "type"
BNODE_SCHEME = "bnode://"

#: Arrival order, made where triples are read: rows of one file sort by block and row.
ORD = T.StructType([T.StructField("file", T.StringType()), T.StructField("block", T.LongType()), T.StructField("row", T.LongType())])

TRIPLE = T.StructType(
    [
        T.StructField("ord", ORD),
        T.StructField("subj", T.StringType()),
        T.StructField("subj_kind", T.StringType()),
        T.StructField("pred", T.StringType()),
        T.StructField("obj", T.StringType()),
        T.StructField("obj_kind", T.StringType()),
        T.StructField("dtype", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("graph", T.StringType()),
    ]
)

# XML Schema types by the kind of value they have here.
INTEGERS = "integer long int short byte nonNegativeInteger positiveInteger nonPositiveInteger negativeInteger unsignedLong unsignedInt unsignedShort unsignedByte".split()
REALS = "decimal double float".split()


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def local_part_or_null(iri: Column | str) -> Column:
    """What follows the last ``#``, or else the last ``/``, or else the last ``:``; null without any."""
    c = as_column(iri)
    out = F.lit(None).cast("string")
    for mark in (":", "/", "#"):
        out = F.when(F.instr(c, mark) > 0, F.substring_index(c, mark, -1)).otherwise(out)
    return out


def local_part(iri: Column | str) -> Column:
    """As :func:`local_part_or_null`, but an IRI without a delimiter is an error. Null stays null."""
    c = as_column(iri)
    return F.when(c.isNull(), F.lit(None)).otherwise(F.coalesce(local_part_or_null(c), F.raise_error(F.concat(F.lit("no local part in "), c)).cast("string")))


def namespace_part_or_null(iri: Column | str) -> Column:
    c = as_column(iri)
    return F.left(c, F.length(c) - F.length(local_part_or_null(c)))


def namespace_part(iri: Column | str) -> Column:
    """The IRI without its local part, delimiter included."""
    c = as_column(iri)
    return F.left(c, F.length(c) - F.length(local_part(c)))


def node_uri(term: Column | str, kind: Column | str) -> Column:
    """Identity of a node: IRIs as they are, blank nodes behind a scheme of their own."""
    t = as_column(term)
    return F.when(as_column(kind) == "bnode", F.concat(F.lit(BNODE_SCHEME), t)).otherwise(t)


def typed_value(lexical: Column | str, dtype: Column | str) -> Column:
    """struct<vt, lex>: the kind of a literal's value and its canonical text.

    Ill-typed literals and unknown datatypes are strings. Decimals are doubles. Times
    and durations keep their text; language tags aren't part of a value.
    """
    x, d = as_column(lexical), as_column(dtype)
    of = lambda names: d.isin([XSD + n for n in names])

    def typed(vt: str, text: Column) -> Column:
        return F.when(text.isNotNull(), F.struct(F.lit(vt).alias("vt"), text.alias("lex")))

    zone = x.rlike(r"(Z|[+-]\d\d:\d\d)$")
    low = F.trim(x)
    cases = (
        F.when(of(INTEGERS), typed("long", F.when(low.rlike(r"^[+-]?\d+$"), low.try_cast("bigint")).cast("string")))
        .when(of(REALS), typed("double", F.when(low.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?INF$|^NaN$"), low.try_cast("double")).cast("string")))
        .when(of(["boolean"]), typed("boolean", F.when(low.isin("true", "1"), "true").when(low.isin("false", "0"), "false")))
        .when(of(["date"]), typed("date", F.when(low.rlike(r"^-?\d{4,}-\d\d-\d\d$"), low.try_cast("date")).cast("string")))
        .when(of(["dateTime", "dateTimeStamp"]) & zone, typed("timestamp", low.try_cast("timestamp").cast("string")))
        .when(of(["dateTime"]), typed("timestamp_ntz", low.try_cast("timestamp_ntz").cast("string")))
        .when(of(["hexBinary"]), typed("binary", F.when(low.rlike("^([0-9a-fA-F]{2})*$"), F.upper(low))))
        .when(of(["base64Binary"]), typed("binary", F.hex(F.try_to_binary(low, F.lit("base64")))))
    )
    return F.coalesce(cases, F.struct(F.lit("string").alias("vt"), x.alias("lex")))
