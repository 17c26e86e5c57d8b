"""A graph: one DataFrame per node label and per edge signature, with identity, checks, views and an atomic publish."""

from __future__ import annotations

import contextlib
import functools
import threading
import uuid
from collections import defaultdict
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphlens.schema import EDGES, NODES, edge_schema

EdgeKey = tuple[str, str, str]


def node_id(label: str, *identity: Column) -> Column:
    """A stable id from a node's label, project and identifying columns; null and empty differ."""
    return F.xxhash64(F.lit(label), *[F.coalesce(c.cast("string"), F.lit("\0")) for c in identity])


def with_identity(label: str, rows: DataFrame) -> DataFrame:
    """Rows of a label's columns and project, as its node table; missing columns are null, equal nodes count once.

    Nodes are equal by their identity, not by the id that is its hash: two identities of one id both stay, and
    ``Graph.violations`` reports them.
    """
    spec = NODES[label]
    schema = spec.schema
    columns = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields if f.name != "id"]
    shaped = rows.select(*columns)
    return shaped.withColumn("id", node_id(label, F.col("project"), *[F.col(c) for c in spec.identity])).dropDuplicates(["project", *spec.identity]).select(*schema.names)


def at_once(tables: Mapping, write: Callable[[str, DataFrame], None], jobs: int = 8) -> None:
    """Write several tables, some jobs side by side: small tables leave most of a cluster idle. The first error is raised."""
    with ThreadPoolExecutor(jobs) as pool:
        for done in [pool.submit(write, k, v) for k, v in tables.items()]:
            done.result()


def ask_all(tables: Mapping, jobs: int = 16) -> None:
    """Make all tables of a ``Later``, side by side; one that fails keeps its error for whoever asks for it."""

    def ask(key) -> None:
        with contextlib.suppress(Exception):
            tables[key]

    with ThreadPoolExecutor(jobs) as pool:
        list(pool.map(ask, list(tables)))


class Later(dict):
    """Tables that are planned when first asked for: a query over a few plans only those, and a failure is its asker's alone.

    One that cannot be made is not tried again: whoever asks gets the same error.
    """

    def __init__(self, *args, **more):
        super().__init__(*args, **more)
        self._locks: dict = defaultdict(threading.RLock)

    def later(self, key, make, unless_known: bool = False) -> None:
        if not (unless_known and key in self):
            super().__setitem__(key, make)

    def __getitem__(self, key):
        with self._locks[key]:  # two threads that ask at once share what the first makes
            value = super().__getitem__(key)
            if isinstance(value, Exception):
                raise value
            if not isinstance(value, DataFrame):
                try:
                    value = value()
                except Exception as error:
                    super().__setitem__(key, error)
                    raise
                super().__setitem__(key, value)
            return value

    def get(self, key, default=None):
        return self[key] if key in self else default

    def items(self):
        return [(k, self[k]) for k in self]

    def values(self):
        return [self[k] for k in self]


@dataclass
class Graph:
    nodes: dict[str, DataFrame] = field(default_factory=dict)
    edges: dict[EdgeKey, DataFrame] = field(default_factory=dict)

    def completed(self, spark: SparkSession) -> Graph:
        """The graph with an empty table for every label and edge that it lacks."""
        nodes = {k: self.nodes.get(k, spark.createDataFrame([], s.schema)) for k, s in NODES.items()}
        edges = {k: self.edges.get(k, spark.createDataFrame([], edge_schema(k))) for k in EDGES}
        return Graph(nodes, edges)

    def in_project(self) -> DataFrame:
        """(id, project) of all nodes but files: the edges to projects, which every query takes as a column."""
        frames = [v.select(F.lit(k).alias("label"), "id", "project") for k, v in self.nodes.items() if k not in ("File", "Project")]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    def views(self, prefix: str = "") -> None:
        """Register every table for ad-hoc SQL: node_<label> and edge_<type>__<source>__<target>."""
        for k, v in self.nodes.items():
            v.createOrReplaceTempView(f"{prefix}node_{k}")
        for (t, a, b), v in self.edges.items():
            v.createOrReplaceTempView(f"{prefix}edge_{t}__{a}__{b}")

    def violations(self) -> DataFrame:
        """(table, problem, n): ids that occur twice, and edges with a missing end. A sound graph gives no rows.

        All nodes are one table of labels and ids here and all ends another, so that there are two shuffles in all.
        """
        union = lambda frames: functools.reduce(DataFrame.unionByName, frames)
        ids = union([v.select(F.lit(k).alias("label"), "id") for k, v in self.nodes.items()]).groupBy("label", "id").agg(F.count(F.lit(1)).alias("times"))
        twice = ids.where("times > 1").select(F.concat(F.lit("node_"), "label").alias("table"), F.lit("repeated id").alias("problem"))
        if not self.edges:
            return twice.groupBy("table", "problem").agg(F.count(F.lit(1)).alias("n"))
        ends = union([v.select(F.lit(f"edge_{t}__{a}__{b}").alias("table"), F.explode(F.array(*[F.struct(F.lit(f"missing {end}").alias("problem"), F.lit(label).alias("label"), F.col(end).alias("id")) for end, label in (("src", a), ("dst", b))])).alias("e")) for (t, a, b), v in self.edges.items()])
        lost = ends.select("table", "e.problem", "e.label", "e.id").join(ids.select("label", "id"), ["label", "id"], "left_anti")
        return twice.unionByName(lost.select("table", "problem")).groupBy("table", "problem").agg(F.count(F.lit(1)).alias("n"))

    def save(self, path: str, project: str | None = None) -> str:
        """Publish a version: readers see the old or the new one whole. With two nodes of one id or an edge without an end, none is.

        Tables are written by project, in folders that are never written again. A version is a list of such folders, one for
        each table and project that has rows, in one pointer row. With a ``project``, only its folders are written; the
        last version's folders of the others are pointed to again.
        """
        spark = next(iter(self.nodes.values())).sparkSession
        mine = Graph({k: v.where(F.col("project") == project) for k, v in self.nodes.items()}, {k: v.where(F.col("project") == project) for k, v in self.edges.items()}) if project is not None else self
        wrong = [tuple(r) for r in mine.violations().collect()]  # a row per table and problem
        if wrong:
            raise ValueError(f"not published: {sorted(wrong)}")
        version = uuid.uuid4().hex
        tables = {f"node_{k}": v for k, v in mine.nodes.items()} | {f"edge_{t}__{a}__{b}": v for (t, a, b), v in mine.edges.items()}
        at_once(tables, lambda name, v: v.withColumn("_project", F.col("project")).write.partitionBy("_project").parquet(f"{path}/{version}/{name}"))
        entries = [(name, unquote(folder.removeprefix("_project=")), f"{version}/{name}/{folder}") for name in tables for folder in _folders(spark, f"{path}/{version}/{name}")]
        if project is not None and _folders(spark, f"{path}/published", any_name=True):
            entries += [tuple(e) for e in _published(spark, path)["entries"] if e["project"] != project]
        row = spark.createDataFrame([(version, entries)], f"version string, entries {_ENTRIES}")
        row.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{path}/published")
        return version

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: str | None = None) -> Graph:
        """The version published last, or a given one."""
        entries = _published(spark, path, version)["entries"]

        def read(name: str, schema: T.StructType) -> DataFrame:
            folders = [f"{path}/{e['folder']}" for e in entries if e["name"] == name]
            return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)

        nodes = {k: read(f"node_{k}", s.schema) for k, s in NODES.items()}
        edges = {(t, a, b): read(f"edge_{t}__{a}__{b}", edge_schema((t, a, b))) for t, a, b in EDGES}
        return cls(nodes, edges)


_ENTRIES = "array<struct<name:string,project:string,folder:string>>"


def _published(spark: SparkSession, path: str, version: str | None = None):
    """The pointer row of a version, or of the last."""
    rows = spark.read.parquet(f"{path}/published")
    found = rows.where(F.col("version") == version) if version is not None else rows.orderBy(F.desc("at")).limit(1)
    row = found.first()
    if row is None:
        raise LookupError(f"no such version: {version}")
    return row


def _folders(spark: SparkSession, folder: str, any_name: bool = False) -> list[str]:
    """The names of a folder's partition folders (or all names); none if it is not there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in store.listStatus(path)] if store.exists(path) else []
    return [n for n in names if any_name or n.startswith("_project=")]
