"""Quality rules with verdicts on hosts.

Each document is measured by simple rules. Failures of each rule are counted by host, the failure
rates of each host are shrunk by a beta prior for each rule, fitted to all hosts by moments net of
the variance that sampling alone would make, and the verdict on a host falls on all of its
documents: a host fails if any of its shrunk rates is too high.

Only DataFrame functions are used. The texts are read once; the measures are written,
and counts by host and the join back read that small table. Counts by host are
partial sums, so a host with a third of all rows is as good as any; a skewed
join is left to adaptive execution, a small table of hosts is broadcast by Spark.

Three-word windows are compared by 64-bit hashes within one document.

Defined results: a null or empty text has no words, lines or symbols and fails the
base rules; documents without a host (null) form a host of their own; repeated rows
are measured alike and each counts for its host; extra columns are not read; an
empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm._scratch import Scratch
from loomgraph.llm._text import BLANKS, spaced, without

SYMBOLS = "#*$%&|<>"
#: Rules by name: SQL over the measures that is true for a document that fails. The first two are the base rules.
RULES = {
    "short": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "5 * n_symbols > n_words",
    "lines": "20 * n_dup_lines > n_words",
    "letters": "word_chars < 2 * n_words",
}
BASE = ("short", "repeats")


def measures(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Per row: key, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(F.col("t"), "\n"), lambda x: F.length(F.trim(without(x, BLANKS[1:]))) > 0)
    one = docs.select(F.col(key).alias("key"), F.col(host).alias("host"), t.alias("t"))
    two = one.select(
        "key", "host",
        F.length(without(F.col("t"), BLANKS)).cast("long").alias("word_chars"),
        (F.octet_length("t") - F.octet_length(without(F.col("t"), SYMBOLS))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.split(spaced(F.col("t")), " ").alias("s"),
    )
    # an empty text splits into one empty word
    two = two.withColumn("w", F.transform(F.when(F.get("s", F.lit(0)) == "", F.slice("s", 1, 0)).otherwise(F.col("s")), lambda x: F.xxhash64(x))).drop("s")
    n = F.size("w")
    windows = F.transform(F.slice("w", 1, F.greatest(n - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(F.col("w"), i + 1), F.get(F.col("w"), i + 2)))
    three = two.select("key", "host", n.cast("long").alias("n_words"), "word_chars", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), windows.alias("h"))
    # windows sorted by hash and place, only for documents where one comes twice
    ordered = F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    four = three.withColumn("z", ordered).drop("h")
    same = lambda x, k: F.coalesce(F.get(F.col("z"), k)["h"] == x["h"], F.lit(False))
    places = F.transform("z", lambda x, k: F.when(same(x, k + 1) | F.when(k > 0, same(x, k - 1)).otherwise(False), x["i"]))
    five = four.withColumn("p", F.sort_array(F.filter(places, lambda x: x.isNotNull()))).drop("z")
    # a window covers three words, less what the next window covers
    covered = F.aggregate(F.transform("p", lambda x, k: F.least(F.lit(3), F.coalesce(F.get(F.col("p"), k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    return five.select(F.col("key").alias(key), F.col("host").alias(host), "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return F.expr(" OR ".join(RULES[r] for r in BASE))


def shrunk_rates(hosts: DataFrame, rules: list[str]) -> DataFrame:
    """Add ``rate_<rule>`` to one row per host with ``n`` and ``failed_<rule>``.

    A rule's beta prior has the mean m of the hosts' plain rates, and their variance less that of sampling, the
    mean of m(1 - m)/n; its strength is kept within 1 and 1e6 documents, also where nothing is left of the variance.
    """
    plain = {r: F.col(f"failed_{r}") / F.col("n") for r in rules}
    sums = [x for r in rules for x in (F.avg(plain[r]).alias(f"m_{r}"), F.var_pop(plain[r]).alias(f"v_{r}"))]
    prior = hosts.agg(F.avg(1 / F.col("n")).alias("noise"), *sums)
    strengths = []
    for r in rules:
        m = F.col(f"m_{r}")
        net = F.col(f"v_{r}") - m * (1 - m) * F.col("noise")
        strengths.append(F.least(F.greatest(F.when(net > 0, m * (1 - m) / net - 1).otherwise(F.lit(1e6)), F.lit(1.0)), F.lit(1e6)).alias(f"s_{r}"))
    prior = prior.select(*(f"m_{r}" for r in rules), *strengths)
    rates = {f"rate_{r}": (F.col(f"failed_{r}") + F.col(f"m_{r}") * F.col(f"s_{r}")) / (F.col("n") + F.col(f"s_{r}")) for r in rules}
    met = hosts.crossJoin(F.broadcast(prior))  # the prior is one row
    return met.select(*hosts.columns, *(x.alias(name) for name, x in rates.items()))


def judge(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", max_rate: float = 0.5) -> DataFrame:
    """Per row: key, the five measures, base_failed, kept, host, host_failed.

    A host fails if its shrunk failure rate by any rule is above ``max_rate``; a document is kept if
    neither it (by the base rules) nor its host fails.
    """
    scratch = Scratch(spark, "hostrules")
    measured = scratch.save(measures(docs, key, text, host).withColumn("base_failed", base_failed()), "measures")
    rules = list(RULES)
    failures = [F.sum(F.expr(RULES[r]).cast("long")).alias(f"failed_{r}") for r in rules]
    hosts = scratch.save(measured.groupBy(F.col(host).alias("_host")).agg(F.count(F.lit(1)).alias("n"), *failures), "hosts")
    worst = F.greatest(*(f"rate_{r}" for r in rules))
    verdicts = scratch.save(shrunk_rates(hosts, rules).select("_host", (worst > max_rate).alias("host_failed")), "verdicts")
    scratch.keep_only(measured, verdicts)
    met = measured.join(verdicts, F.col(host).eqNullSafe(F.col("_host")))
    return met.select(key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~F.col("host_failed")).alias("kept"), host, "host_failed")


SQL = r"""
WITH base AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents
), split AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM base
), windows AS (
  SELECT rid, i, w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM split)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS o(k) GROUP BY rid
), measured AS (
  SELECT s.doc_id, s.source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM split s LEFT JOIN covered c USING (rid)
), failing AS (
  SELECT *, {base} AS base_failed FROM measured
), failures AS (
  {failures}
), hosts AS (
  SELECT source, rule, count(*) AS n, sum(bad::INT) AS failed FROM failures GROUP BY source, rule
), prior AS (
  SELECT rule, m, least(greatest(CASE WHEN v - m * (1 - m) * noise > 0 THEN m * (1 - m) / (v - m * (1 - m) * noise) - 1 ELSE 1e6 END, 1.0), 1e6) AS s
  FROM (SELECT rule, avg(failed / n) AS m, var_pop(failed / n) AS v, avg(1 / n) AS noise FROM hosts GROUP BY rule)
), verdicts AS (
  SELECT source, max((failed + m * s) / (n + s)) > 0.5 AS host_failed FROM hosts JOIN prior USING (rule) GROUP BY source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT host_failed AS kept, f.source, host_failed
FROM failing f JOIN verdicts v ON f.source IS NOT DISTINCT FROM v.source
""".replace("{base}", " OR ".join(RULES[r] for r in BASE)).replace("{failures}", " UNION ALL ".join(f"SELECT source, '{r}' AS rule, {x} AS bad FROM failing" for r, x in RULES.items()))
