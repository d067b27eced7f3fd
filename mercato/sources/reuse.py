"""What is known of a state of the input files, kept for the next report.

A state is the set of files under the tables' paths: their names, lengths and
modification times, listed on every load (no content is read): a few files by the
driver, as Spark lists them too, more or nested ones by a Spark job. For a state
that was seen before in this session

* whether ids repeat is known without another pass over them,
* the schemas of generated files need no other look at their footers, and
* with ``reuse`` the order- and person-level tables that many reports start from
  (:data:`BUILDERS`) are read from the shared folder: the first report that needs one
  writes it there, so the lines are aggregated once for all reports.

A file that is added, removed or rewritten makes another state, so nothing stale is
read: a table is only kept if the files after writing it are those from before the
load listed them.
Where a cluster names no shared folder, nothing is kept. The folder's own retention
removes the tables, as it does checkpoints.
"""

from __future__ import annotations

import dataclasses
import uuid
from collections.abc import Iterator, Mapping

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercato.session import NoSharedFolder, bound_tasks, checkpoint_dir
from mercato.sources import Tables
from mercato.sources.contract import UNIQUE_IDS, check

#: Tables that are kept, and those they are built from.
BUILDERS = {
    "order_totals": (),
    "delivered_person_orders": (),
    "repeat_persons": ("delivered_person_orders",),
    "repeat_orders": ("delivered_person_orders",),
}


@dataclasses.dataclass
class _State:
    fingerprint: tuple
    repeated: bool
    schemas: dict[str, T.StructType] = dataclasses.field(default_factory=dict)
    paths: dict[str, str] = dataclasses.field(default_factory=dict)


#: By application and locations: the last state only.
_states: dict[tuple, _State] = {}


#: Files that the driver lists by itself.
MOST_LISTED = 1_000


def _listed(spark: SparkSession, locations: list[str]) -> tuple | None:
    """(path, length, modification time) of the files, if they are few."""
    try:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    except Exception:  # Spark Connect
        return None
    found = []
    for at in locations:
        path = jvm.org.apache.hadoop.fs.Path(at)
        try:
            files = path.getFileSystem(conf).listStatus(path)
        except Py4JJavaError as error:
            raise FileNotFoundError(at) from error
        if len(found) + len(files) > MOST_LISTED:
            return None
        for f in files:
            if f.isDirectory():
                return None
            if not f.getPath().getName().startswith(("_", ".")):
                found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


def fingerprint(spark: SparkSession, locations: list[str]) -> tuple:
    """What tells one state of the files from another."""
    listed = _listed(spark, locations)
    if listed is not None:
        return listed
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(locations)
    one = F.xxhash64("path", "length", "modificationTime")
    return tuple(files.agg(F.count("*"), F.sum("length"), F.bit_xor(one), F.max("modificationTime")).first())


def _bytes(state: tuple) -> int:
    """Length of all files of a fingerprint."""
    if state and not isinstance(state[0], tuple):
        return state[1] or 0
    return sum(length for _, length, _ in state)


def _key(spark: SparkSession, locations: list[str]) -> tuple:
    try:
        return (spark.sparkContext.applicationId, *locations)
    except Exception:  # Spark Connect
        return ("", *locations)


def known(spark: SparkSession, locations: list[str]) -> _State | None:
    """The state of ``locations``, if it was seen before and the files are unchanged."""
    state = _states.get(_key(spark, locations))
    try:
        return state if state and fingerprint(spark, locations) == state.fingerprint else None
    except (AnalysisException, FileNotFoundError):  # a path is gone
        return None


class Kept(Mapping):
    """The tables of a state by name, each written when it is first asked for."""

    def __init__(self, tables: Tables, locations: list[str], state: _State):
        self.tables, self.locations, self.state = tables, locations, state
        self.own: dict[str, DataFrame] = {}

    def __iter__(self) -> Iterator[str]:
        return iter(BUILDERS)

    def __len__(self) -> int:
        return len(BUILDERS)

    def __getitem__(self, name: str) -> DataFrame:
        if name in self.own:
            return self.own[name]
        from mercato.operators import segments

        builders = {"order_totals": segments.order_totals, "delivered_person_orders": segments.orders_of_persons, "repeat_persons": segments.repeat_persons, "repeat_orders": segments.repeat_orders}
        spark = self.tables.orders.sparkSession
        path = self.state.paths.get(name)
        if path is not None:
            try:
                _listed(spark, [path])
            except FileNotFoundError:  # the folder's retention took it
                path = None
        shared = {} if path else {n: self[n] for n in BUILDERS[name]}
        built = builders[name](dataclasses.replace(self.tables, shared=shared))
        if path is None:
            path = f"{checkpoint_dir(spark)}/kept-{uuid.uuid4().hex}/{name}"
            built.write.parquet(path)
            if fingerprint(spark, self.locations) != self.state.fingerprint:
                return built  # the files changed meanwhile: this load goes on without
            self.state.paths[name] = path
        self.own[name] = spark.read.schema(built.schema).parquet(path)
        return self.own[name]


def with_kept(tables: Tables, locations: list[str], before: tuple, reuse: bool, schemas: dict | None = None) -> Tables:
    """``tables``, loaded after the fingerprint ``before`` was taken, with checked ids
    and, with ``reuse``, kept tables."""
    spark = tables.orders.sparkSession
    bound_tasks(spark, _bytes(before))
    state = _states.get(_key(spark, locations))
    if state is None or state.fingerprint != before:
        state = _State(before, bool(check(tables, UNIQUE_IDS)), schemas or {})
        if fingerprint(spark, locations) == before:
            _states[_key(spark, locations)] = state
    tables = dataclasses.replace(tables, repeated_ids=state.repeated)
    if not reuse:
        return tables
    try:
        checkpoint_dir(spark)
    except NoSharedFolder:
        return tables
    return dataclasses.replace(tables, shared=Kept(tables, locations, state))
