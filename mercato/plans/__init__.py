"""The 36 reports, one function ``(Tables) -> DataFrame`` each, by section.

``REPORTS`` is the registry (name -> function); ``run(spark, path, name)`` loads
the tables through the matching source adapter and builds the report.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mercato.plans import customers, overview, products, repeat, value
from mercato.sources import Tables, load_tables

REPORTS: dict[str, Callable[[Tables], DataFrame]] = {
    **overview.QUERIES,
    **customers.QUERIES,
    **repeat.QUERIES,
    **value.QUERIES,
    **products.QUERIES,
}


def run(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Load the tables and build one report; reports of a session share what
    :mod:`mercato.sources.reuse` keeps."""
    return REPORTS[name](load_tables(spark, path, reuse=True))
