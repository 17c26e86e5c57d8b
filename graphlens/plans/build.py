"""From record batches to a graph: node tables by natural keys, edges resolved on them, wipe and rebuild by owner."""

from __future__ import annotations

import functools
from collections.abc import Callable, Mapping
from time import monotonic

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.graph import Graph, Later, ask_all, at_once, with_identity
from graphlens.operators.mutation import gated, implied_nodes, insert, resolve_edges, upsert, upsert_first, upsert_set, wipe
from graphlens.schema import EDGES, NODES, edge_schema

#: Extractors in their fixed order, and the labels that each one's rebuild replaces.
ORDER = ("gql", "routes", "permissions", "pages", "docs", "e2e", "scss")
OWNED = {name: [k for k, s in NODES.items() if s.owner == name] for name in ORDER}

Batches = Mapping[str, DataFrame]


def _nodes(label: str, rows: DataFrame) -> DataFrame:
    return with_identity(label, rows)


def gql(b: Batches, g: Graph) -> None:
    g.nodes["GqlOperation"] = _nodes("GqlOperation", b["operations"].withColumnRenamed("gqlName", "gql_name"))
    g.nodes["GqlHook"] = _nodes("GqlHook", b["hooks"])
    told = F.col("targetFile") if "targetFile" in b["callsites"].columns else F.lit(None).cast("string")
    sites = b["callsites"].select("project", "target", "targetKind", F.col("file").alias("path"), "line", F.col("column").alias("col"), told.alias("at"))
    _files(g, sites)
    operations, hooks, files = g.nodes["GqlOperation"], g.nodes["GqlHook"], g.nodes["File"]
    wraps = b["hooks"].select("project", F.col("name").alias("hook"), F.explode("operations").alias("symbol"))
    g.edges["WRAPS", "GqlHook", "GqlOperation"] = resolve_edges(wraps, hooks, operations, {"hook": "name"}, {"symbol": "symbol"})
    for kind, edge, nodes, key in (("operation", "USES_OPERATION", operations, "symbol"), ("hook", "CALLS_HOOK", hooks, "name")):
        label = "GqlOperation" if kind == "operation" else "GqlHook"
        named = sites.where(F.col("targetKind") == kind)
        # A site that tells its target's file means that declaration; one that does not means all of the name.
        exact = resolve_edges(named.where("at is not null"), files, nodes, {"path": "path"}, {"target": key, "at": "file"}, ["line", "col"])
        g.edges[edge, "File", label] = exact.unionByName(resolve_edges(named.where("at is null"), files, nodes, {"path": "path"}, {"target": key}, ["line", "col"])).distinct()


def routes(b: Batches, g: Graph) -> None:
    records, parts = b["routes"], b["components"]
    g.nodes["Route"] = _nodes("Route", records)
    g.nodes["Component"] = _nodes("Component", parts)
    listed = lambda name: records.select("project", "path", "depth", "line", F.explode(name).alias("name"))
    g.nodes["Guard"] = _nodes("Guard", listed("guards"))
    keys = listed("permissions").select("project", F.col("name").alias("key"))
    g.nodes["Permission"] = _nodes("Permission", keys)
    here = {"path": "path", "depth": "depth", "line": "line"}
    for edge, name, label, key in (("RENDERS", "components", "Component", "name"), ("GUARDED_BY", "guards", "Guard", "name"), ("REQUIRES", "permissions", "Permission", "key")):
        g.edges[edge, "Route", label] = resolve_edges(listed(name), g.nodes["Route"], g.nodes[label], here, {"name": key})
    child = records.where("parentPath is not null").select("project", "path", "depth", "line", F.col("parentPath").alias("above"), (F.col("depth") - 1).alias("level"))
    g.edges["CHILD_OF", "Route", "Route"] = resolve_edges(child, g.nodes["Route"], g.nodes["Route"], here, {"above": "path", "level": "depth"})
    for edge, column, label, key in (("CALLS_HOOK", "hookCalls", "GqlHook", "name"), ("USES_OPERATION", "operationRefs", "GqlOperation", "symbol")):
        used = parts.select("project", F.col("name").alias("component"), F.explode(column).alias("used"))
        g.edges[edge, "Component", label] = resolve_edges(used, g.nodes["Component"], g.nodes[label], {"component": "name"}, {"used": key})


def permissions(b: Batches, g: Graph) -> None:
    rows = b["permissions"]
    # Attributes win over the bare keys that routes name; keys known from routes alone keep none.
    g.nodes["Permission"] = upsert_set(g.nodes["Permission"], _nodes("Permission", rows), ["project", "key"])
    granted = rows.select("project", "key", F.explode("roles").alias("code"))
    g.nodes["Role"] = upsert(g.nodes["Role"], _nodes("Role", granted), ["project", "code"])
    g.edges["GRANTED_TO", "Permission", "Role"] = resolve_edges(granted, g.nodes["Permission"], g.nodes["Role"], {"key": "key"}, {"code": "code"})


def pages(b: Batches, g: Graph) -> None:
    rows = b["pages"].withColumn("entity", F.coalesce("entity", F.lit(""))).withColumn("files", F.array_sort(F.map_values("by_role")))
    g.nodes["Page"] = _nodes("Page", rows)
    g.nodes["Domain"] = _nodes("Domain", rows.select("project", F.col("domain").alias("name")))
    key = {"domain": "domain", "entity": "entity"}
    g.edges["IN_DOMAIN", "Page", "Domain"] = resolve_edges(rows.select("project", "domain", "entity", F.col("domain").alias("name")), g.nodes["Page"], g.nodes["Domain"], key, {"name": "name"})
    held = rows.select("project", "domain", "entity", F.explode("components").alias("c")).select("project", "domain", "entity", F.col("c.file").alias("path"))
    # By file, not by name: names repeat between pages.
    g.edges["BELONGS_TO", "Component", "Page"] = resolve_edges(held, g.nodes["Component"], g.nodes["Page"], {"path": "file"}, key)
    held = held.union(rows.select("project", "domain", "entity", F.explode("files")))
    _files(g, held)
    g.edges["HAS_FILE", "Page", "File"] = resolve_edges(held, g.nodes["Page"], g.nodes["File"], key, {"path": "path"})


def docs(b: Batches, g: Graph) -> None:
    coded = F.transform("headings", lambda h: F.concat_ws("|", h["level"].cast("string"), h["text"]))
    g.nodes["Doc"] = _nodes("Doc", b["docs"].withColumn("headings", coded))


def e2e(b: Batches, g: Graph) -> None:
    specs, loc, seen = b["specs"], b["locators"], b["testids"]
    g.nodes["E2eSpec"] = _nodes("E2eSpec", specs)
    g.nodes["PageObject"] = _nodes("PageObject", b["page_objects"])
    g.nodes["TestIdLoc"] = _nodes("TestIdLoc", loc)
    targets = loc.select("project", F.explode("testids").alias("value"), F.lit(False).alias("pattern"), F.lit(None).cast("string").alias("template"), F.lit("").alias("file"), F.lit(0).cast("long").alias("line"))
    known = targets.unionByName(seen.select("project", "value", "pattern", "template", "file", "line"))
    g.nodes["TestId"] = _nodes("TestId", upsert_first(known, ["project", "value", "pattern"], ["file", "line"]))
    uses = specs.select("project", F.col("name").alias("spec"), "file", "line", F.explode("poms").alias("pom"))
    g.edges["USES_POM", "E2eSpec", "PageObject"] = resolve_edges(uses, g.nodes["E2eSpec"], g.nodes["PageObject"], {"spec": "name", "file": "file", "line": "line"}, {"pom": "name"})
    owned = b["page_objects"].select("project", F.col("name").alias("pom"), F.regexp_extract("file", r"([^/]*)\.page\.[jt]sx?$", 1).alias("module"))
    g.edges["DEFINES_LOC", "PageObject", "TestIdLoc"] = resolve_edges(owned, g.nodes["PageObject"], g.nodes["TestIdLoc"], {"pom": "name"}, {"module": "module"})
    found = loc.select("project", "name", "file", F.explode("testids").alias("value"), F.lit(False).alias("pattern"))
    same = {"value": "value", "pattern": "pattern"}
    g.edges["RESOLVES_TO", "TestIdLoc", "TestId"] = resolve_edges(found, g.nodes["TestIdLoc"], g.nodes["TestId"], {"name": "name", "file": "file"}, same)
    sights = seen.select("project", F.col("file").alias("path"), "value", "pattern", "line")
    _files(g, sights)
    g.edges["HAS_TESTID", "File", "TestId"] = resolve_edges(sights, g.nodes["File"], g.nodes["TestId"], {"path": "path"}, same, ["line"])


def scss(b: Batches, g: Graph) -> None:
    g.nodes["ScssModule"] = _nodes("ScssModule", b["scss"])
    uses = b["scss_imports"].select("project", F.col("consumer").alias("path"), F.col("module_file").alias("module"))
    _files(g, uses)
    g.edges["USES_SCSS", "File", "ScssModule"] = resolve_edges(uses, g.nodes["File"], g.nodes["ScssModule"], {"path": "path"}, {"module": "file"})


def _files(g: Graph, rows: DataFrame) -> None:
    g.nodes["File"] = upsert(g.nodes["File"], _nodes("File", implied_nodes(rows)), ["project", "path"])


STEPS: dict[str, Callable[[Batches, Graph], None]] = {"gql": gql, "routes": routes, "permissions": permissions, "pages": pages, "docs": docs, "e2e": e2e, "scss": scss}


def build(spark: SparkSession, batches: Batches, staging: str | None = None) -> tuple[Graph, list[dict]]:
    """The graph of the projects that the batches name, and per extractor: name, ok, error, seconds, written.

    Records of projects without a project record are left out. An extractor that fails, while its batches are made, planned
    or written, is reported and leaves the others' tables as they are: batches are asked for by the extractor that needs
    them. All tables are lazy: the fixed order is a chain of inputs, not of jobs.

    With a new folder for ``staging``, each extractor's tables are written there as it ends, in a job of its own, and read
    from there by the next: a record that cannot be read fails its own extractor alone, and ``written`` counts the rows.
    """
    projects = batches["projects"]
    known = Later()
    for k in batches:
        known.later(k, lambda k=k: batches[k] if k == "projects" else gated(batches[k], projects))
    if staging is not None:
        ask_all(batches)  # many small jobs, most of them waiting for one another: a cluster runs them side by side
    g = Graph().completed(spark)
    g.nodes["Project"] = with_identity("Project", projects.withColumn("project", F.col("name")).withColumn("updated_at", F.current_timestamp()))
    report = []
    for name in ORDER:
        began, before, written = monotonic(), (dict(g.nodes), dict(g.edges)), {}
        try:
            STEPS[name](known, g)
            if staging is not None:
                written = _write(spark, g, before, f"{staging}/{name}")
            report.append({"name": name, "ok": True, "error": None, "seconds": monotonic() - began, "written": written})
        except Exception as e:  # noqa: BLE001  reported to the caller
            g.nodes, g.edges = before
            report.append({"name": name, "ok": False, "error": str(e), "seconds": monotonic() - began, "written": {}})
    return g, report


def _write(spark: SparkSession, g: Graph, before: tuple[dict, dict], folder: str) -> dict[str, int]:
    """Write the tables that a step has changed, and go on from what is written; rows per table, from the files' footers."""
    counts = {}
    for kind, tables, old in (("node", g.nodes, before[0]), ("edge", g.edges, before[1])):  # edges are resolved on what is written
        changed = {k: tables[k] for k in tables if tables[k] is not old.get(k)}
        name = {k: "_".join([kind, *([k] if isinstance(k, str) else k)]) for k in changed}

        def write(k, v: DataFrame) -> None:
            v.write.parquet(f"{folder}/{name[k]}")  # noqa: B023
            tables[k] = spark.read.schema(v.schema).parquet(f"{folder}/{name[k]}")  # noqa: B023
            counts[name[k]] = tables[k].count()  # noqa: B023

        at_once(changed, write)
    return counts


def rebuild(old: Graph, new: Graph, project: str, keep: set[str] = frozenset()) -> Graph:
    """The old graph with one project's owned nodes and edges replaced by the new graph's.

    Files and roles, which nobody owns, are taken from the new edges alone: none is left behind without one. Labels to
    ``keep`` stay as they were, with the old edges that lead from or to them.
    """
    labels = [k for k in NODES if k != "Project" and k not in keep]
    nodes, edges = wipe(old.nodes, old.edges, labels, project)
    mine = lambda frame: frame.where(F.col("project") == project)
    stay = {k for k in EDGES if k[1] in keep or k[2] in keep}
    out = Graph({k: insert(nodes[k], mine(new.nodes[k])) if k in labels else old.nodes[k] for k in NODES}, {k: insert(edges[k], mine(new.edges[k])) if k not in stay else old.edges[k] for k in EDGES})
    if stay:
        files = old.nodes["File"].join(functools.reduce(DataFrame.union, [old.edges[k].select(F.col("src" if k[1] == "File" else "dst").alias("id")) for k in stay if "File" in k] or [old.nodes["File"].select("id").limit(0)]).distinct(), "id", "left_semi")
        out.nodes["File"] = upsert(out.nodes["File"], mine(files), ["project", "path"])
    out.nodes["Project"] = upsert_set(old.nodes["Project"], mine(new.nodes["Project"]), ["name"])
    return out


def with_schemas(spark: SparkSession) -> Graph:
    """An empty graph: every table with its columns."""
    return Graph({k: spark.createDataFrame([], s.schema) for k, s in NODES.items()}, {k: spark.createDataFrame([], edge_schema(k)) for k in EDGES})
