"""Tables as triples, by declarative rules whose expressions are SQL."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.terms import TRIPLE


@dataclass(frozen=True)
class Rule:
    """One triple for each row of a table.

    :param subj, obj: SQL expressions over the row; a null in either gives no triple.
    :param order: SQL expression (long) of the arrival order within the rule.
    """

    table: str
    subj: str
    pred: str
    obj: str
    order: str
    obj_kind: str = "literal"
    subj_kind: str = "iri"
    dtype: str | None = None
    lang: str | None = None


def triples(tables: Mapping[str, DataFrame], rules: Sequence[Rule]) -> DataFrame:
    """Triples of all rules; rules come in order, rows of a rule by its order expression. Each table is read once for all of its rules."""
    text = lambda x: F.lit(x).cast("string")

    def made(n: int, r: Rule) -> Column:
        return F.struct(
            F.struct(F.lit(f"{n:06d}").alias("file"), F.lit(0).cast("long").alias("block"), F.expr(r.order).cast("long").alias("row")).alias("ord"),
            F.expr(r.subj).cast("string").alias("subj"),
            text(r.subj_kind).alias("subj_kind"),
            text(r.pred).alias("pred"),
            F.expr(r.obj).cast("string").alias("obj"),
            text(r.obj_kind).alias("obj_kind"),
            text(r.dtype).alias("dtype"),
            text(r.lang).alias("lang"),
            text(None).alias("graph"),
        )

    by_table: dict[str, list[Column]] = {}
    for n, r in enumerate(rules):
        by_table.setdefault(r.table, []).append(made(n, r))
    out = None
    for name, own in by_table.items():
        each = tables[name].select(F.explode(F.array(*own)).alias("t")) if len(own) > 1 else tables[name].select(own[0].alias("t"))
        part = each.select("t.*").filter("subj IS NOT NULL AND obj IS NOT NULL").select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in TRIPLE.fields))
        out = part if out is None else out.unionByName(part)
    return out
