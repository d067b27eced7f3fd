"""Section 6, product intelligence: pairs bought together and category leaders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.functions import as_money, line_revenue
from mercato.operators.baskets import pair_counts
from mercato.operators.ranking import top_k_per_group
from mercato.operators.segments import CATEGORY, delivered_lines, in_english, total_by_category, with_raw_category
from mercato.sources import Tables


def products_bought_together(t: Tables) -> DataFrame:
    """Unordered product pairs by how many line pairs share an order (every status)."""
    return pair_counts(
        t.items,
        "order_id",
        "product_id",
        first="product_1",
        second="product_2",
        count="times_bought_together",
    ).orderBy(F.desc("times_bought_together"), "product_1", "product_2")


def top_revenue_category(t: Tables) -> DataFrame:
    """The category with the most delivered price + freight; ties: alphabetical."""
    per_product = delivered_lines(t).groupBy("product_id").agg(F.sum(line_revenue()).alias("_rev"))
    return (
        total_by_category(per_product, t, "_rev")
        .select("product_category", as_money(F.col("_rev")).alias("highest_total_revenue"))
        .orderBy(F.desc("highest_total_revenue"), "product_category")
        .limit(1)
    )


def top_product_per_category(t: Tables) -> DataFrame:
    """Per category, the product with the most delivered price; ties: lowest product id."""
    per_product = delivered_lines(t).groupBy("product_id").agg(
        F.round(F.sum("price"), 2).alias("_revenue")
    )
    best_first = [F.col("_revenue").desc_nulls_last(), F.col("product_id").asc()]
    # one leader per own category, then the best of those that share an English name
    own = top_k_per_group(with_raw_category(per_product, t), [CATEGORY], best_first, k=1)
    leaders = top_k_per_group(in_english(own, t, "category"), ["category"], best_first, k=1)
    return leaders.select(
        "product_id", "category", F.col("_revenue").alias("revenue")
    ).orderBy(F.desc("revenue"), "category")


QUERIES = {
    "products_bought_together": products_bought_together,
    "top_revenue_category": top_revenue_category,
    "top_product_per_category": top_product_per_category,
}
