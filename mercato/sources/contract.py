"""Checks of what the tables promise: keys that are known and unique, and ids that
lead somewhere.

:func:`violations` counts the rows that break each rule, in one plan. Per table one
aggregate counts NULL keys. Ids that tables share (orders, customers, products,
sellers) are grouped once over all tables that carry them, with map-side partial
counts, so an id held by a third of all rows is one group row; from the counts of a
group follow its surplus copies and the rows that lead nowhere.

What breaks a rule is kept by the reports as SQL would keep it; a caller who wants the
tables refused names the rules in :func:`require`.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.sources import Tables

#: Columns that must be known.
KNOWN = {
    "customers": ("customer_id", "customer_unique_id"),
    "orders": ("order_id", "customer_id", "order_status", "order_purchase_timestamp"),
    "items": ("order_id", "product_id", "seller_id", "price", "freight_value"),
    "products": ("product_id",),
    "translation": ("product_category_name", "product_category_name_english"),
    "sellers": ("seller_id",),
    "payments": ("order_id", "payment_type", "payment_value"),
}
#: Each id: the table whose key it is, and the tables that refer to it.
IDS = {
    "order_id": ("orders", ("items", "payments")),
    "customer_id": ("customers", ("orders",)),
    "product_id": ("products", ("items",)),
    "seller_id": ("sellers", ("items",)),
    "product_category_name": ("translation", ("products",)),
}
#: Rules that reports take for granted unless ``Tables.repeated_ids`` says otherwise.
UNIQUE_IDS = ("repeated orders.order_id", "repeated customers.customer_id")


class ContractBroken(ValueError):
    """Rules that the tables break, with the number of rows."""


def rules() -> list[str]:
    out = [f"unknown {t}.{c}" for t, columns in KNOWN.items() for c in columns]
    for c, (owner, users) in IDS.items():
        out += [f"repeated {owner}.{c}", *(f"dangling {t}.{c}" for t in users)]
    return out


def _long(counts: DataFrame, names: list[str]) -> DataFrame:
    """One row of counts as (rule, rows)."""
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.coalesce(F.col(f"`{n}`"), F.lit(0)).cast("bigint").alias("rows")) for n in names])
    return counts.select(F.inline(pairs))


def violations(t: Tables, only: Iterable[str] | None = None) -> DataFrame:
    """(rule, rows): how many rows break each rule, 0 included."""
    wanted = set(rules() if only is None else only)
    if unheard := wanted - set(rules()):
        raise ValueError(f"no such rule: {', '.join(sorted(unheard))}")
    frames, parts = t.frames(), []
    for table, columns in KNOWN.items():
        names = [f"unknown {table}.{c}" for c in columns if f"unknown {table}.{c}" in wanted]
        if names:
            counts = [F.count_if(F.col(n.rpartition(".")[2]).isNull()).alias(n) for n in names]
            parts.append(_long(frames[table].agg(*counts), names))
    for c, (owner, users) in IDS.items():
        names = [n for n in [f"repeated {owner}.{c}", *(f"dangling {u}.{c}" for u in users)] if n in wanted]
        if not names:
            continue
        used = [u for u in users if f"dangling {u}.{c}" in wanted]
        sides = [owner, *used]
        rows = [frames[s].where(F.col(c).isNotNull()).select(F.col(c).alias("id"), *[F.lit(int(s == x)).alias(x) for x in sides]) for s in sides]
        each = reduce(DataFrame.unionByName, rows).groupBy("id").agg(*[F.sum(x).alias(x) for x in sides])
        sums = {f"repeated {owner}.{c}": F.sum(F.greatest(F.col(owner) - 1, F.lit(0)))}
        sums |= {f"dangling {u}.{c}": F.sum(F.when(F.col(owner) == 0, F.col(u)).otherwise(0)) for u in used}
        parts.append(_long(each.agg(*[sums[n].alias(n) for n in names]), names))
    return reduce(DataFrame.unionByName, parts)


def check(t: Tables, only: Iterable[str] | None = None) -> dict[str, int]:
    """The rules that are broken, with the number of rows: one job."""
    found = {r["rule"]: r["rows"] for r in violations(t, only).where(F.col("rows") > 0).collect()}
    return {rule: found[rule] for rule in rules() if rule in found}


def require(t: Tables, only: Iterable[str] | None = None) -> Tables:
    """``t``, or :class:`ContractBroken` where it breaks one of the rules."""
    broken = check(t, only)
    if broken:
        raise ContractBroken("; ".join(f"{rule}: {n} rows" for rule, n in broken.items()))
    return t
