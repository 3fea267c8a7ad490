"""Mixing sources to target weights by Pareto order sampling.

Each source has a target of words. A document's expected number of copies is its
source's target over the source's size. The whole part is certain; the rest p
gives the odds of one more copy. They are p/(1-p), times 2m/(m + size) with the source's
mean size m: of one more copy long documents get less and short ones more, so
that the sample has more documents and doesn't hang on a few long ones. Documents of a
source are ranked by random odds over inclusion odds, and taken in that order
until the words left of the target are filled (see ``_ordered_cut``): the size of the
sample is fixed in words. Random numbers are digests of the key, so reruns agree.

Only DataFrame functions are used. Word counts are made in one pass over the
texts and written; all that follows reads that small table. Rows of a source are
never gathered: the cut in the order is found from sums by bin.

Defined results: a null or empty text has size 0 and takes no words; a null
source is a source of its own, last in order; repeated rows are ranked side by
side, and ties are broken by key and size; a null key counts as an empty one in
the random number; extra columns are kept by :func:`mix` and not read; an empty
table gives an empty table; a source of size 0 has target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm._ordered_cut import ordered_cut
from loomgraph.llm._scratch import Scratch, numbered
from loomgraph.llm._text import n_words

def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) from the MD5 digest of seed and key: 52 bits, as SQL can make it too."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def targets(sources: DataFrame, source: str = "source", max_repeat: int = 3) -> DataFrame:
    """Add ``target`` to one row per source with ``size`` (long), ``weight`` and any other columns.

    All sizes are shared by weight; a target stops at ``max_repeat`` times its source's
    size, and the excess is shared again by weight until none is above. Sources are
    capped in the order of cap over weight. The table has one row for each source.
    """
    rows = sources.withColumn("cap", F.col("size") * max_repeat)
    everything = Window.partitionBy(F.lit(0))
    order = everything.orderBy(F.col("cap") / F.col("weight"), F.col(source).asc_nulls_last())
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"total": F.sum("size").over(everything), "prior": F.sum("cap").over(upto) - F.col("cap"), "rest": F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))})
    capped = (F.col("total") - F.col("prior")).cast("double") * F.col("weight") > F.col("cap").cast("double") * F.col("rest")
    rows = rows.withColumn("capped", capped)
    rows = rows.withColumns({"used": F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(everything), "open": F.sum(F.when(F.col("capped"), 0).otherwise(F.col("weight"))).over(everything)})
    share = (F.col("total") - F.col("used")).cast("double") * F.col("weight") / F.col("open")
    return rows.select(*sources.columns, F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def cycled_weights(sources: DataFrame, source: str = "source", cycle: int = 3) -> DataFrame:
    """Add ``weight``: 1, 2, .., ``cycle``, repeating, over sources by code point, null last. One row per source."""
    n = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col(source).asc_nulls_last()))
    return sources.withColumn("weight", (n - 1) % cycle + 1)


def plan(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: DataFrame | None = None, max_repeat: int = 3, seed: int = 1) -> DataFrame:
    """Per row of ``docs``: key, source, size, source_size, target (of the source), copies, taken (words).

    :param weights: a row for each source (source, weight); by default 1, 2, 3, repeating.
    """
    scratch = Scratch(spark, "mixing")
    sizes = scratch.save(docs.select(F.col(key).alias("k"), F.col(source).alias("g"), n_words(F.col(text)).alias("size")), "sizes")
    done = _planned(scratch, sizes, [], weights, source, max_repeat, seed)
    scratch.keep_only(sizes, *scratch.named("shares"), *scratch.named("last"))
    return done.select(F.col("k").alias(key), F.col("g").alias(source), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _planned(scratch: Scratch, sizes: DataFrame, more: list[str], weights: DataFrame | None, source: str, max_repeat: int, seed: int) -> DataFrame:
    """``sizes`` (k, g, size and the columns ``more``, which tell equal rows apart) with source_size, target and copies."""
    sources = sizes.groupBy("g").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    if weights is None:
        sources = cycled_weights(sources, "g")
    else:
        w = weights.select(F.col(source).alias("_g"), "weight")
        sources = sources.join(w, sources["g"].eqNullSafe(w["_g"])).drop("_g")
    ratio = F.when(F.col("size") > 0, F.col("target") / F.col("size")).otherwise(0.0)
    shares = targets(sources, "g", max_repeat).select(F.col("g").alias("_g"), F.col("size").alias("source_size"), "target", ratio.alias("ratio"), (F.col("size") / F.col("n")).alias("mean"))
    shares = shares.withColumn("whole", F.floor("ratio").cast("long")).withColumn("p", F.col("ratio") - F.col("whole"))
    shares = scratch.save(shares, "shares")

    rows = sizes.join(shares, sizes["g"].eqNullSafe(shares["_g"])).drop("_g")
    rows = rows.withColumn("u", uniform(F.col("k"), seed)).withColumn("odds", 2.0 * F.col("mean") / (F.col("mean") + F.col("size")))
    there, absent = F.col("u") * (1 - F.col("p")), F.col("p") * F.col("odds") * (1 - F.col("u"))
    rows = rows.withColumn("at", F.when(F.col("p") > 0, there / (there + absent)).otherwise(0.0))  # odds ratio q as q / (1 + q)
    sized = F.concat(F.coalesce(F.col("k").cast("string"), F.lit("")), F.lit(":"), F.col("size"))
    rows = rows.withColumn("by_size", uniform(sized, seed))
    order = ["at", "by_size"]
    if more:
        rows = rows.withColumn("by_row", uniform(F.concat_ws(":", *more), seed))
        order.append("by_row")
    left = F.col("target") - F.col("whole") * F.col("source_size")
    budgets = shares.filter("p > 0").select(F.col("_g").alias("g"), left.alias("budget"))
    partial = ordered_cut(scratch, rows.filter("p > 0"), budgets, "g", order, "size")
    done = partial.unionByName(rows.filter("p = 0").withColumn("chosen", F.lit(False)))
    copies = F.col("whole") + F.col("chosen").cast("long")
    return done.withColumn("copies", copies)


def mix(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: DataFrame | None = None, max_repeat: int = 3, seed: int = 1) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as the plan takes it, with the columns of ``docs``.

    Rows are numbered, so that each gets the copies planned for it, also among equal rows.
    """
    scratch = Scratch(spark, "mix")
    rows = numbered(scratch, docs, "_loom_row")
    sizes = scratch.save(rows.select("_loom_row", F.col(key).alias("k"), F.col(source).alias("g"), n_words(F.col(text)).alias("size")), "sizes")
    done = _planned(scratch, sizes, ["_loom_row"], weights, source, max_repeat, seed)
    scratch.keep_only(sizes, *scratch.named("shares"), *scratch.named("last"))
    times = done.filter("copies > 0").select("_loom_row", F.col("copies").cast("int").alias("_times"))
    return rows.join(times, "_loom_row").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*docs.columns)


def plan_sql(seed: int = 1) -> str:
    """DuckDB SQL for :func:`plan` over ``documents`` with the default weights: doc_id, size, source_size, target, taken, source, copies."""
    return rf"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(sum(size) AS DOUBLE) / count(*) AS mean,
         (row_number() OVER (ORDER BY source COLLATE "C" ASC NULLS LAST) - 1) % 3 + 1 AS weight
  FROM sized GROUP BY source
), ordered AS (
  SELECT *, 3 * source_size AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS total,
         CAST(sum(3 * source_size) OVER w AS BIGINT) - 3 * source_size AS prior,
         CAST(sum(weight) OVER (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS rest
  FROM sources WINDOW w AS (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), flagged AS (
  SELECT *, CAST(total - prior AS DOUBLE) * weight > CAST(cap AS DOUBLE) * rest AS capped FROM ordered
), shared AS (
  SELECT source, source_size, mean, CASE WHEN capped THEN CAST(cap AS DOUBLE)
    ELSE CAST(total - CAST(sum(CASE WHEN capped THEN cap ELSE 0 END) OVER () AS BIGINT) AS DOUBLE) * weight
         / CAST(sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () AS BIGINT) END AS target
  FROM flagged
), parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS ratio FROM shared
), shares AS (
  SELECT *, CAST(floor(ratio) AS BIGINT) AS whole, ratio - floor(ratio) AS p FROM parts
), drawn AS (
  SELECT d.doc_id, d.source, d.size, s.source_size, s.target, s.whole, s.p, 2.0 * s.mean / (s.mean + d.size) AS odds, s.target - s.whole * s.source_size AS budget,
         CAST(CAST('0x' || substr(md5('{seed}:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u,
         substr(md5('{seed}:' || coalesce(CAST(d.doc_id AS VARCHAR), '') || ':' || d.size), 1, 12) AS by_size
  FROM sized d JOIN shares s ON d.source IS NOT DISTINCT FROM s.source
), placed AS (
  SELECT *, CASE WHEN p > 0 THEN u * (1 - p) / (u * (1 - p) + p * odds * (1 - u)) ELSE 0.0 END AS pos FROM drawn
), ranked AS (
  SELECT *, row_number() OVER w AS rn, CAST(sum(size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - size AS before
  FROM placed WINDOW w AS (PARTITION BY source ORDER BY floor(pos * 281474976710656.0), by_size, doc_id NULLS FIRST, size)
), stops AS (
  SELECT source, min(rn) AS stop FROM ranked WHERE p > 0 AND size > budget - before GROUP BY source
), walk(source, rn, stop, space) AS (
  SELECT r.source, r.rn, s.stop, r.budget - r.before FROM ranked r JOIN stops s ON r.source IS NOT DISTINCT FROM s.source AND r.rn = s.stop
  UNION ALL
  SELECT n.source, n.rn, w.stop, CASE WHEN r.size <= w.space THEN w.space - r.size ELSE w.space END
  FROM walk w JOIN ranked r ON r.source IS NOT DISTINCT FROM w.source AND r.rn = w.rn
  JOIN ranked n ON n.source IS NOT DISTINCT FROM w.source AND n.rn = w.rn + 1 WHERE w.rn + 1 < w.stop + 64
), tried AS (
  SELECT w.*, r.size, r.size <= w.space AS fits FROM walk w JOIN ranked r ON r.source IS NOT DISTINCT FROM w.source AND r.rn = w.rn
), ends AS (
  SELECT source, arg_max(CASE WHEN fits THEN space - size ELSE space END, rn) AS space,
         min(CASE WHEN NOT fits THEN (size, rn) END) AS last FROM tried GROUP BY source
), chosen AS (
  SELECT r.*, r.p > 0 AND (s.stop IS NULL OR r.rn < s.stop OR coalesce(t.fits, false) OR coalesce(e.last[2] = r.rn AND e.last[1] < 2 * e.space, false)) AS extra
  FROM ranked r LEFT JOIN stops s ON r.source IS NOT DISTINCT FROM s.source
  LEFT JOIN tried t ON r.source IS NOT DISTINCT FROM t.source AND r.rn = t.rn
  LEFT JOIN ends e ON r.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target, (whole + CAST(extra AS BIGINT)) * size AS taken, source, whole + CAST(extra AS BIGINT) AS copies FROM chosen
"""
