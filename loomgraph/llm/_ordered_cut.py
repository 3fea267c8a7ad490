"""Take rows in the order of a key, per group, until their weights fill a budget.

The order is never laid out in one task. A row's key is a text of hexadecimal digits, 12 for
each of its numbers. Weights are summed by (group, first three digits), the bin in
which a group's budget runs out is cut by the next three digits, and so on; only the rows
of the last bin, and a few after it, are ordered one by one. Later numbers part rows that
tie in the earlier ones; rows that are equal in all columns are counted, not listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm._scratch import Scratch

#: Digits of a number, and of a step.
_DIGITS, _STEP = 12, 3
#: Rows after the first that doesn't fit that are still tried, in order.
_TRIES = 64
#: A cut bin with more rows than this is cut again.
_FINE = 2048


def ordered_cut(scratch: Scratch, rows: DataFrame, budgets: DataFrame, group: str, at: list[str], size: str) -> DataFrame:
    """``rows`` with a boolean column ``chosen``.

    :param rows: columns ``group``, ``at`` (doubles in [0, 1)) and ``size`` (long, 0 or more).
    :param budgets: one row for each group: ``group`` (null-safe), ``budget`` (double).

    Rows are taken in the order of ``at`` (48 bits of each) and then of all columns, while they fit what
    is left of the budget. After the first row that doesn't fit, the next 63 are still tried in order.
    Last, the smallest of the rows tried in vain is taken if the budget is then
    missed by less than without it. A group without a budget, or with enough for all, takes all its rows.
    """
    names = rows.columns
    digits = [F.lpad(F.hex(F.floor(F.col(c) * float(1 << 4 * _DIGITS)).cast("long")), _DIGITS, "0") for c in at]
    rows = rows.withColumn("_key", F.concat(*digits))
    open_ = scratch.save(budgets.select(F.col(group).alias("_g"), F.col("budget").alias("_left"), F.lit("").alias("_bin")), "bounds")
    bounds = None
    for end in range(_STEP, _DIGITS * len(at) + 1, _STEP):
        here = _with(rows, open_, group).filter(F.startswith("_key", F.col("_bin")))
        sums = here.groupBy("_g", "_left", F.substring("_key", 1, end).alias("_cell")).agg(F.sum(size).alias("_s"), F.count(F.lit(1)).alias("_n"))
        before = F.sum("_s").over(Window.partitionBy("_g").orderBy("_cell")) - F.col("_s")
        cut = sums.withColumn("_before", before).filter((F.col("_before") <= F.col("_left")) & (F.col("_before") + F.col("_s") > F.col("_left")))
        first = cut.groupBy("_g").agg(F.min(F.struct("_cell", "_before", "_n", "_left")).alias("c"))
        finer = first.select("_g", (F.col("c._left") - F.col("c._before")).alias("_left"), F.col("c._cell").alias("_bin"), F.col("c._n").alias("_n"))
        finer = scratch.save(finer, "bounds")
        done = finer.filter((F.col("_n") <= _FINE) | F.lit(end == _DIGITS * len(at))).drop("_n")
        bounds = done if bounds is None else bounds.union(done)
        open_ = finer.filter(F.col("_n") > _FINE).drop("_n")
        if open_.isEmpty():
            break
    return _settle(scratch, rows, names, bounds, group, size)


def _settle(scratch: Scratch, rows: DataFrame, names: list[str], bounds: DataFrame, group: str, size: str) -> DataFrame:
    """Order the rows of the last bin and ``_TRIES`` rows after it; decide all the others by their key."""
    start = F.substr(F.col("_key"), F.lit(1), F.length("_bin"))
    # Spark keeps the first rows of each group before it shuffles
    turn = F.row_number().over(Window.partitionBy("_g").orderBy("_key"))
    after = _with(rows, bounds, group).filter(start > F.col("_bin")).select("_g", "_key").withColumn("_turn", turn).filter(F.col("_turn") <= _TRIES)
    stop = after.groupBy(F.col("_g").alias("_h")).agg(F.max("_key").alias("_stop"))
    last = scratch.save(bounds.join(stop, F.col("_g").eqNullSafe(F.col("_h")), "left").drop("_h"), "last")
    decided = F.when(F.col("_bin").isNull() | (start < F.col("_bin")), True).when((start > F.col("_bin")) & (F.col("_key") > F.col("_stop")), False)
    placed = _with(rows, last, group, "left").withColumn("chosen", decided)
    sure = placed.filter(F.col("chosen").isNotNull()).select(*names, "chosen")
    edge = placed.filter(F.col("chosen").isNull()).groupBy("_g", "_left", "_key", *names).agg(F.count(F.lit(1)).alias("_m"))
    entry = F.struct(F.col("_key").alias("key"), F.struct(*names).alias("row"), F.col(size).cast("double").alias("size"), F.col("_m").alias("m"))
    listed = edge.groupBy("_g").agg(F.sort_array(F.collect_list(entry)).alias("list"), F.first("_left").alias("_left"))

    def fold(acc: Column, x: Column) -> Column:
        """Take what fits of the equal rows ``x``; out: [taken, tried in vain] of each entry."""
        tried = F.when(acc["tries"] == 0, x["m"]).otherwise(F.least(x["m"], _TRIES - acc["tries"]))
        fit = F.when(x["size"] > 0, F.floor(acc["left"] / x["size"])).otherwise(tried)
        taken = F.greatest(F.least(tried, fit), F.lit(0)).cast("long")
        tries = F.when(acc["tries"] == 0, F.least(x["m"] - taken, F.lit(_TRIES))).otherwise(acc["tries"] + tried).cast("long")
        mark = F.struct(taken.alias("taken"), (tried > taken).alias("vain"))
        return F.struct((acc["left"] - taken * x["size"]).alias("left"), tries.alias("tries"), F.concat(acc["out"], F.array(mark)).alias("out"))

    begin = F.struct(F.col("_left").alias("left"), F.lit(0).cast("long").alias("tries"), F.array().cast("array<struct<taken:bigint,vain:boolean>>").alias("out"))
    picked = listed.withColumn("done", F.aggregate("list", begin, fold)).select("list", F.col("done.left").alias("space"), F.col("done.out").alias("marks"))
    spare = F.filter(F.transform("list", lambda x, i: F.struct(x["size"].alias("size"), i.alias("i"))), lambda x: F.col("marks")[x["i"]]["vain"])
    picked = picked.withColumn("last", F.array_min(spare))
    pairs = picked.select(F.posexplode(F.arrays_zip(F.col("list"), F.col("marks"))).alias("i", "z"), "space", "last")
    over = F.coalesce((F.col("i") == F.col("last.i")) & (F.col("last.size") < 2 * F.col("space")), F.lit(False)).cast("long")
    counted = pairs.select("z.list.row", "z.list.m", (F.col("z.marks.taken") + over).alias("taken"))
    settled = counted.select("row", "taken", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))).alias("copy"))
    return sure.unionByName(settled.select(*(F.col("row")[n].alias(n) for n in names), (F.col("copy") <= F.col("taken")).alias("chosen")))


def _with(rows: DataFrame, bounds: DataFrame, group: str, how: str = "inner") -> DataFrame:
    """Each row with its group's bounds; the bounds are a written table, so Spark broadcasts them only if they are small."""
    return rows.join(bounds, rows[group].eqNullSafe(bounds["_g"]), how)
