import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from loomgraph.functions.terms import XSD, local_part, namespace_part, node_uri, typed_value


def one(spark, column, *values, names=("a", "b")):
    df = spark.createDataFrame([values], ", ".join(f"{n} string" for n in names[: len(values)]))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("iri", "local", "namespace"),
    [
        ("http://x/y#z", "z", "http://x/y#"),
        ("http://x/y/z", "z", "http://x/y/"),
        ("urn:a:b", "b", "urn:a:"),
        ("http://x#y/z", "y/z", "http://x#"),
        ("http://x/#a#b", "b", "http://x/#a#"),
        ("http://x/", "", "http://x/"),
        (None, None, None),
    ],
)
def test_parts(spark, iri, local, namespace):
    assert one(spark, local_part("a"), iri) == local
    assert one(spark, namespace_part("a"), iri) == namespace


def test_no_delimiter(spark):
    with pytest.raises(PySparkException, match="no local part"):
        one(spark, local_part("a"), "plain")


def test_node_uri(spark):
    assert one(spark, node_uri("a", "b"), "x", "bnode") == "bnode://x"
    assert one(spark, node_uri("a", "b"), "http://x", "iri") == "http://x"


@pytest.mark.parametrize(
    ("text", "dtype", "vt", "lex"),
    [
        ("01", "integer", "long", "1"),
        ("99999999999999999999", "integer", "string", "99999999999999999999"),
        ("abc", "integer", "string", "abc"),
        ("1.50", "decimal", "double", "1.5"),
        ("1e3", "double", "double", "1000.0"),
        ("1", "boolean", "boolean", "true"),
        ("yes", "boolean", "string", "yes"),
        ("2020-02-03", "date", "date", "2020-02-03"),
        ("2020-02-03T04:05:06", "dateTime", "timestamp_ntz", "2020-02-03 04:05:06"),
        ("2020-02-03T04:05:06+01:00", "dateTime", "timestamp", "2020-02-03 03:05:06"),
        ("P1D", "duration", "string", "P1D"),
        ("0aff", "hexBinary", "binary", "0AFF"),
        ("AQI=", "base64Binary", "binary", "0102"),
        ("x", "unheardOf", "string", "x"),
        ("", "string", "string", ""),
    ],
)
def test_typed_value(spark, text, dtype, vt, lex):
    assert tuple(one(spark, typed_value("a", "b"), text, XSD + dtype)) == (vt, lex)


def test_untyped(spark):
    assert tuple(one(spark, typed_value("a", F.lit(None).cast("string")), "1")) == ("string", "1")
