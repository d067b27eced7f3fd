"""Source adapters. Every report takes a :class:`Tables` bundle.

``load_tables(spark, path)`` picks the adapter from what the folder holds:
the generated star schema (``lineitem.parquet`` ...) goes through
:mod:`mercato.sources.generated`; a folder of the seven logical tables (parquet
or CSV) goes through :mod:`mercato.sources.files`.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from mercato.schema import TABLE_NAMES


@dataclass(frozen=True)
class Tables:
    customers: DataFrame
    orders: DataFrame
    items: DataFrame
    products: DataFrame
    translation: DataFrame
    sellers: DataFrame
    payments: DataFrame
    # Optional intermediates built once for a run of many reports (see
    # mercato.plans.suite); report functions use them when present.
    shared: Mapping[str, DataFrame] = field(default_factory=dict, compare=False, repr=False)
    # Whether order_id repeats in orders, or customer_id in customers: reports then
    # count ids distinct and keep the copies of a row in joins.
    repeated_ids: bool = False

    def frames(self) -> dict[str, DataFrame]:
        """The seven base tables by logical name."""
        return {name: getattr(self, name) for name in TABLE_NAMES}

    def register_views(self, prefix: str = "") -> None:
        """Expose the seven tables as session temp views for ad-hoc Spark SQL."""
        for name, frame in self.frames().items():
            frame.createOrReplaceTempView(f"{prefix}{name}")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark's own file systems hold ``path`` (local, hdfs://, s3a://, ...)."""
    try:
        # the schema of a text source is fixed: this lists the path, no more
        return spark.read.text(path).schema is not None
    except AnalysisException:
        return False


def load_tables(
    spark: SparkSession, path: str, names: dict[str, str] | None = None, reuse: bool = False
) -> Tables:
    """The seven logical tables under ``path``, listed anew on every call.

    ``names`` maps logical tables to the file stems of an export (not used for
    the generated star schema). The ids are checked once for each state of the
    files; with ``reuse`` the order- and person-level tables that many reports start
    from are also kept for that state (:mod:`mercato.sources.reuse`).
    """
    from mercato.sources import files, generated, reuse as kept

    locations = generated.locations(path)
    state = kept.known(spark, locations) if names is None else None
    if state is not None:  # seen before and unchanged: nothing to look for or to infer
        tables = generated.load(spark, path, state.schemas)
        return kept.with_kept(tables, locations, state.fingerprint, reuse)
    star = names is None and generated.looks_generated(spark, path)
    if not star:
        locations = files.locations(spark, path, names)
    before = kept.fingerprint(spark, locations)
    schemas: dict = {}
    tables = generated.load(spark, path, schemas) if star else files.load(spark, path, names)
    return kept.with_kept(tables, locations, before, reuse, schemas)
