"""The named questions: functions of a graph and parameters to a DataFrame, one row per answer."""

from __future__ import annotations

import functools
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlens.functions.columns import as_text, collect_distinct, contains_text, text_of
from graphlens.graph import Graph
from graphlens.operators.joins import prefix_join
from graphlens.operators.ranks import joined_texts
from graphlens.plans.pattern import Hop, anchors, assemble, ends, gather, gather_parts, into, out, walk


class NotFound(LookupError):
    """No such thing: the error of a lookup by name, with a code for callers."""

    code = "NOT_FOUND"


def envelope(error: Exception, **more) -> dict:
    """The answer that stands for an error: its code and message, and what else the caller knows (kind, project)."""
    if isinstance(error, NotFound):
        return {"error": {"code": error.code, "message": str(error), **more}}
    if isinstance(error, ValueError):
        return {"error": {"code": "VALIDATION_ERROR", "message": str(error), **more}}
    return {"error": {"code": "INTERNAL", "message": f"{type(error).__name__}: {error}", **more}}


def listed(rows: DataFrame, name: str) -> dict:
    """The answer that holds a list: its rows, in their order, under a name, and how many they are (after any limit)."""
    found = [r.asDict(recursive=True) for r in rows.collect()]
    return {"count": len(found), name: found}


def first(rows: DataFrame, *order: str) -> dict:
    """The first row, in a total order, of a lookup that may find several; NotFound if there is none."""
    found = rows.orderBy(*[F.col(c).asc_nulls_last() for c in order]).limit(1).collect()
    if not found:
        raise NotFound("no such entry")
    return found[0].asDict(recursive=True)


def bounded(limit: int, most: int) -> int:
    if not 1 <= limit <= most:
        raise ValueError(f"limit must be 1 to {most}")
    return limit


def searched(text: str) -> str:
    if len(text) < 2:
        raise ValueError("at least two characters are needed")
    return text


def top(rows: DataFrame, limit: int | None, *order) -> DataFrame:
    """Ordered, nulls last; with a limit, the first rows of that total order."""
    keys = [c if isinstance(c, Column) else F.col(c).asc_nulls_last() for c in order]
    rows = rows.orderBy(*keys)
    return rows if limit is None else rows.limit(limit)


def _project(nodes: DataFrame, project: str) -> DataFrame:
    return nodes.where(F.col("project") == project)


# --- operations and hooks ---------------------------------------------------------------------------------------------


def gql_operations(g: Graph, project: str, kind: str | None = None, name: str | None = None, limit: int = 500) -> DataFrame:
    rows = _project(g.nodes["GqlOperation"], project)
    if kind is not None:
        rows = rows.where(F.col("kind") == kind)
    if name is not None:
        rows = rows.where(contains_text(F.col("symbol"), name) | contains_text(F.col("gql_name"), name))
    hooks = gather(walk(g, anchors(rows), into("WRAPS", "GqlHook", "GqlOperation")), "hooks", F.col("name"))
    found = assemble(rows, hooks).select("symbol", "gql_name", "kind", "file", "line", "exported", "hooks", "id")
    return top(found, bounded(limit, 5000), "symbol", "gql_name", "id").drop("id")


def gql_hook_info(g: Graph, project: str, name: str) -> DataFrame:
    rows = _project(g.nodes["GqlHook"], project).where(F.col("name") == name)
    operations = gather(walk(g, anchors(rows), out("WRAPS", "GqlHook", "GqlOperation")), "operations", F.col("symbol"), F.col("gql_name"), F.col("kind"))
    callers = gather(walk(g, anchors(rows), into("CALLS_HOOK", "File", "GqlHook", "line", "col")), "callers", F.col("path"), F.col("edge_line"), F.col("edge_col"))
    return assemble(rows, operations, callers).select("name", "file", "line", "operations", "callers")


def gql_callsites(g: Graph, project: str, target: str) -> DataFrame:
    """Where operations (by symbol) and hooks (by name) are used, one row per definition."""
    parts = []
    for label, name, edge, kind in (("GqlOperation", "symbol", "USES_OPERATION", "operation"), ("GqlHook", "name", "CALLS_HOOK", "hook")):
        rows = _project(g.nodes[label], project).where(F.col(name) == target)
        sites = gather(walk(g, anchors(rows), into(edge, "File", label, "line", "col")), "callsites", F.col("path"), F.col("edge_line"), F.col("edge_col"))
        definition = F.struct(F.col(name).alias("name"), "file", "line").alias("definition")
        parts.append(assemble(rows, sites).select(F.lit(kind).alias("target_kind"), definition, "callsites"))
    return parts[0].unionByName(parts[1])


# --- routes -----------------------------------------------------------------------------------------------------------


def _route_branches(g: Graph, rows: DataFrame) -> list[DataFrame]:
    start = anchors(rows)
    return [
        gather(walk(g, start, out("RENDERS", "Route", "Component")), "components", F.col("name")),
        gather(walk(g, start, out("GUARDED_BY", "Route", "Guard")), "guards", F.col("name")),
        gather(walk(g, start, out("REQUIRES", "Route", "Permission")), "permissions", F.col("key")),
    ]


def routes_list(g: Graph, project: str, prefix: str | None = None, limit: int = 500) -> DataFrame:
    rows = _project(g.nodes["Route"], project)
    if prefix is not None:
        rows = rows.where(F.col("path").startswith(prefix))
    found = assemble(rows, *_route_branches(g, rows))
    return top(found.select("path", "index", "depth", "file", "line", "components", "guards", "permissions", "id"), bounded(limit, 5000), "path", "depth", "id").drop("id")


def _below(g: Graph, dirs: DataFrame) -> dict[str, tuple[DataFrame, tuple[Hop, ...]]]:
    """(anchor, at) of hooks, components and files under directories (project, dir_prefix), the anchor, and the hops from there."""
    files = {
        "GqlHook": g.nodes["GqlHook"].select("project", F.col("id").alias("at"), "file"),
        "Component": g.nodes["Component"].select("project", F.col("id").alias("at"), "file"),
        "File": g.nodes["File"].select("project", F.col("id").alias("at"), F.col("path").alias("file")),
    }
    # The prefixes are few beside the files: each directory is matched once, however many anchors have it.
    start = {k: prefix_join(v, dirs, "file", "dir_prefix", ["project"], directories=True).select(F.col("dir_prefix").alias("anchor"), "at") for k, v in files.items()}
    return {
        "hooks_2": (start["GqlHook"], ()),
        "ops_2": (start["File"], (out("USES_OPERATION", "File", "GqlOperation"),)),
        "ops_3": (start["Component"], (out("USES_OPERATION", "Component", "GqlOperation"),)),
        "ops_5": (start["GqlHook"], (out("WRAPS", "GqlHook", "GqlOperation"),)),
    }


# What the lists hold, by the list's kind: the node label and the fields of a record.
_RECORDS = {"hooks": ("GqlHook", ("name", "file")), "ops": ("GqlOperation", ("symbol", "gql_name"))}


def _bytes_of_records(g: Graph, project: str) -> int:
    """How large the records of a project's hooks and operations are at most, as arrays of structs: one scan of their texts."""
    sizes = [_project(g.nodes[label], project).select(sum(F.coalesce(F.octet_length(c), F.lit(0)) + 24 for c in fields).cast("long").alias("n")) for label, fields in _RECORDS.values()]
    return sizes[0].unionByName(sizes[1]).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _ranked(g: Graph, project: str, kind: str, texts: bool) -> DataFrame:
    """(id, code, value): nodes of a project, their record or its text, and the record's rank among all, in the order of the values."""
    label, fields = _RECORDS[kind]
    nodes = _project(g.nodes[label], project).select("id", F.struct(*fields).alias("record"))
    # Records of one text are two: their ranks differ.
    value = text_of(F.col("record"), nodes.schema["record"].dataType) if texts else F.col("record")
    return nodes.select("id", value.alias("value"), (F.dense_rank().over(Window.orderBy(value, "record")) - 1).alias("code"))


def _values(g: Graph, project: str, kind: str, texts: bool) -> DataFrame:
    """(code, value): a project's distinct records, or their texts, by rank."""
    return _ranked(g, project, kind, texts).groupBy("code").agg(F.min("value").alias("value"))


# How many values are put in order together before they become one table.
_CHUNK = 4096


def _record_table(g: Graph, project: str, kind: str) -> DataFrame:
    """One row: a project's records in the order of their ranks."""
    chunks = _values(g, project, kind, False).groupBy(F.floor(F.col("code") / _CHUNK).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("code", "value"))).alias("entries"))
    chunks = chunks.select("chunk", F.col("entries.value").alias("values"))
    return chunks.agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "values"))), lambda x: x["values"])))


_UNDER = ("hooks_2", "ops_2", "ops_3", "ops_5")


def _directory_lists(g: Graph, project: str, heads: DataFrame, coded: dict[str, DataFrame]) -> DataFrame:
    """(dir_prefix, hooks_2, ops_2, ops_3, ops_5): lists of ranks (coded: at, code) of what lies under each directory of heads (anchor, dir_prefix)."""
    # As many as the entries of the table that they make, so every task can be sent them: files' prefixes are not shuffled.
    dirs = F.broadcast(heads.select(F.lit(project).alias("project"), "dir_prefix").distinct())
    rows = [(ends(g, start, *hops) if hops else start.distinct()).join(coded[k.split("_")[0]], "at").select("anchor", F.lit(k).alias("kind"), "code") for k, (start, hops) in _below(g, dirs).items()]
    lists = gather_parts(functools.reduce(DataFrame.unionByName, rows), "codes", F.col("code"), "anchor", "kind")
    return lists.groupBy(F.col("anchor").alias("dir_prefix")).agg(*[F.max(F.when(F.col("kind") == k, F.col("codes"))).alias(k) for k in _UNDER])


def _under_pages_by_row(g: Graph, project: str, heads: DataFrame) -> list[DataFrame]:
    """The same four lists by anchor, of records, from one row per anchor and thing: for projects whose records are too large for one table."""
    heads = heads.withColumnRenamed("dir_prefix", "dir_id")
    dirs = heads.select(F.lit(project).alias("project"), F.col("dir_id").alias("dir_prefix")).distinct()
    lists = []
    for k, (start, hops) in _below(g, dirs).items():
        fields = _RECORDS[k.split("_")[0]][1]
        rows = walk(g, start, *hops) if hops else walk_self(g, start, "GqlHook")
        rows = rows.select(F.col("anchor").alias("dir_id"), *fields).distinct().join(heads, "dir_id").drop("dir_id")
        lists.append(gather_parts(rows, k, F.struct(*fields)))
    return lists


def walk_self(g: Graph, start: DataFrame, label: str) -> DataFrame:
    """(anchor, node columns) of the nodes where the rows stand."""
    nodes = g.nodes[label]
    return start.distinct().join(nodes.drop("project"), start["at"] == nodes["id"]).drop("at")


def _within(table: str, make: Callable[[Column], Column]) -> Column:
    """What ``make`` makes of a column that is a table of one value, which it is given by reference.

    Such a column has to be used once: then the projection that uses it takes it over, and no row gets a copy of the table.
    """
    return F.get(F.transform(F.array(table), make), F.lit(0))


def _lists(g: Graph, project: str, rows: DataFrame, small: list[DataFrame], pages: DataFrame, components: DataFrame, table_bytes: int, texts: bool) -> DataFrame:
    """Nodes with the lists hooks, ops_direct and ops_via_hooks: what components (anchor, at) reach, then what lies under pages.

    Up to ``table_bytes`` of records, lists are ranks, and directories' lists are one table; both tables are sent to every
    task, and a node's lists are put together in the last projection, from its directories' places: no list of records, and no list
    of what lies under directories, is shuffled. Beyond, lists are made of records from the start. The rows are the same. With
    ``texts``, what has one table is made into texts there, as ``as_text`` writes them: ranks are sorted then, not texts.
    """
    hooks = ends(g, components, out("CALLS_HOOK", "Component", "GqlHook"))
    reached = {
        "hooks_1": hooks,
        "ops_1": ends(g, components, out("USES_OPERATION", "Component", "GqlOperation")),
        "ops_4": ends(g, hooks, out("WRAPS", "GqlHook", "GqlOperation")),
    }
    # Lists are distinct in themselves, not across: what two branches reach is there twice.
    lists = {"hooks": ("hooks_1", "hooks_2"), "ops_direct": ("ops_1", "ops_2", "ops_3"), "ops_via_hooks": ("ops_4", "ops_5")}
    heads = pages.select("anchor", F.concat("dir", F.lit("/")).alias("dir_prefix")).distinct()
    if _bytes_of_records(g, project) > table_bytes:
        own = []
        for k, at in reached.items():
            label, fields = _RECORDS[k.split("_")[0]]
            nodes = _project(g.nodes[label], project).select(F.col("id").alias("at"), F.struct(*fields).alias("record"))
            own.append(gather_parts(at.join(nodes, "at"), k, F.col("record")))
        found = assemble(rows, *small, *own, *_under_pages_by_row(g, project, heads))
        return found.select("*", *[F.concat(*parts).alias(name) for name, parts in lists.items()])
    coded = {k: _ranked(g, project, k, texts).select(F.col("id").alias("at"), "code") for k in _RECORDS}
    own = [gather_parts(at.join(coded[k.split("_")[0]], "at"), k, F.col("code")) for k, at in reached.items()]
    places = heads.agg(F.sort_array(F.collect_set("dir_prefix")).alias("dirs")).select(F.posexplode("dirs").alias("place", "dir_prefix"))
    found = assemble(rows, *small, *own, gather(heads.join(F.broadcast(places), "dir_prefix"), "places", F.col("place")))
    entries = places.join(_directory_lists(g, project, heads, coded), "dir_prefix", "left")
    # A row is small here and large behind: rows are dealt by their number, not by their size.
    context = rows.sparkSession.sparkContext
    found = found.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * context.defaultParallelism), "id")
    none = F.slice(F.array(F.lit(0)), 1, 0)
    if texts:
        tables = {"under": entries.select("place", *[F.coalesce(k, none).alias(k) for k in _UNDER])} | {k: _values(g, project, k, True) for k in _RECORDS}
        with ThreadPoolExecutor(len(tables)) as pool:
            tables = dict(zip(tables, pool.map(DataFrame.toArrow, tables.values()), strict=True))
        return joined_texts(as_text(found, but=(*reached, "places")), "places", tables.pop("under"), {name: (name.split("_")[0], parts) for name, parts in lists.items()}, tables)
    under = entries.agg(F.sort_array(F.collect_list(F.struct("place", *_UNDER))))
    found = found.select("*", *[under.scalar().alias(f"under_{k}") for k in _UNDER])

    def ranks(k: str) -> Column:
        """Distinct ranks of one list, in their order."""
        if k not in _UNDER:
            return F.col(k)
        return F.sort_array(F.array_distinct(F.flatten(_within(f"under_{k}", lambda u: F.transform("places", lambda p: F.coalesce(F.get(u, p)[k], none))))))

    kept = [*rows.columns, *[c for b in small for c in b.columns if c != "anchor"]]
    found = found.select(*kept, *[F.concat(*map(ranks, parts)).alias(f"{name}_codes") for name, parts in lists.items()])
    # Ranks are asked for twice, so that they stay a projection of their own: what is inside a function of arrays is not compiled.
    found = found.select("*", *[(F.size(f"{name}_codes") > 0).alias(f"any_{name}") for name in lists], *[_record_table(g, project, name.split("_")[0]).scalar().alias(f"all_{name}") for name in lists])
    records = lambda name: _within(f"all_{name}", lambda t: F.transform(f"{name}_codes", lambda c: F.get(t, c)))
    return found.select(*kept, *[F.when(F.col(f"any_{name}"), records(name)).otherwise(F.array()).alias(name) for name in lists])


def routes_resolve(g: Graph, project: str, path: str | None = None, table_bytes: int = 128 << 20, texts: bool = False) -> DataFrame:
    """What routes reach: guards, permissions, components, hooks and operations; all routes unless a path is given.

    ``table_bytes``: up to how many bytes of records every task is sent all of them. ``texts``: all lists are texts, as of ``as_text``.
    """
    rows = _project(g.nodes["Route"], project)
    if path is not None:
        rows = rows.where(F.col("path") == path)
    start = anchors(rows)
    renders = out("RENDERS", "Route", "Component")
    pages = walk(g, start, renders, out("BELONGS_TO", "Component", "Page"))
    found = _lists(g, project, rows, _route_branches(g, rows), pages, ends(g, start, renders), table_bytes, texts)
    found = found.select("path", "index", "depth", "file", "line", "guards", "permissions", "components", "hooks", "ops_direct", "ops_via_hooks")
    return as_text(found) if texts else found


def routes_by_component(g: Graph, project: str, name: str | None = None) -> DataFrame:
    rows = _project(g.nodes["Component"], project)
    if name is not None:
        rows = rows.where(F.col("name") == name)
    routes = gather(walk(g, anchors(rows), into("RENDERS", "Route", "Component")), "routes", F.col("path"))
    return assemble(rows, routes).select(F.col("name").alias("component"), "file", "line", "routes")


# --- permissions and roles ----------------------------------------------------------------------------------------------


def permissions_list(g: Graph, project: str, prefix: str | None = None, role: str | None = None) -> DataFrame:
    rows = _project(g.nodes["Permission"], project)
    if prefix is not None:
        rows = rows.where(F.col("key").startswith(prefix))
    if role is not None:
        rows = rows.where(F.array_contains(F.coalesce("roles", F.array().cast("array<string>")), role))
    routes = gather(walk(g, anchors(rows), into("REQUIRES", "Route", "Permission")), "routes", F.col("path"))
    found = assemble(rows, routes).select("key", F.coalesce("roles", F.array().cast("array<string>")).alias("roles"), "file", "line", "routes")
    return top(found, None, "key")


def permission_info(g: Graph, project: str, key: str) -> DataFrame:
    rows = _project(g.nodes["Permission"], project).where(F.col("key") == key)
    routes = gather(walk(g, anchors(rows), into("REQUIRES", "Route", "Permission")), "routes", F.col("path"))
    roles = gather(walk(g, anchors(rows), out("GRANTED_TO", "Permission", "Role")), "roles_via_edges", F.col("code"))
    return assemble(rows, routes, roles).select(F.struct("key", "file", "line").alias("permission"), F.coalesce("roles", F.array().cast("array<string>")).alias("roles"), "routes", "roles_via_edges")


def roles_list(g: Graph, project: str) -> DataFrame:
    rows = _project(g.nodes["Role"], project)
    granted = g.edges["GRANTED_TO", "Permission", "Role"].groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("n"))
    return top(rows.join(granted, "id", "left").select("code", F.coalesce("n", F.lit(0)).alias("permission_count")), None, "code")


# --- pages --------------------------------------------------------------------------------------------------------------


def _page_branches(g: Graph, rows: DataFrame) -> list[DataFrame]:
    belongs = into("BELONGS_TO", "Component", "Page")
    return [
        gather_parts(walk(g, anchors(rows), belongs), "components", F.col("name")),
        gather_parts(walk(g, anchors(rows), belongs, into("RENDERS", "Route", "Component")), "routes", F.col("path")),
    ]


def pages_list(g: Graph, project: str, domain: str | None = None) -> DataFrame:
    rows = _project(g.nodes["Page"], project)
    if domain is not None:
        rows = rows.where(F.col("domain") == domain)
    found = assemble(rows, *_page_branches(g, rows))
    return top(found.select("domain", "entity", "dir", "files", "subdirs", "components", "routes"), None, "domain", "entity", "dir")


def page_get(g: Graph, project: str, domain: str | None = None, entity: str = "", table_bytes: int = 128 << 20, texts: bool = False) -> DataFrame:
    """What pages reach; all pages unless a domain is given, then its page of the entity. ``table_bytes`` and ``texts`` as for routes."""
    rows = _project(g.nodes["Page"], project)
    if domain is not None:
        rows = rows.where((F.col("domain") == domain) & (F.coalesce("entity", F.lit("")) == entity))
    start = anchors(rows)
    belongs = into("BELONGS_TO", "Component", "Page")
    pages = rows.select(F.col("id").alias("anchor"), "dir")
    found = _lists(g, project, rows, _page_branches(g, rows), pages, ends(g, start, belongs), table_bytes, texts)
    found = found.select("domain", "entity", "dir", "files", "subdirs", "components", "routes", "hooks", "ops_direct", "ops_via_hooks")
    return as_text(found) if texts else found


def domains_list(g: Graph, project: str) -> DataFrame:
    rows = _project(g.nodes["Domain"], project)
    pages = g.edges["IN_DOMAIN", "Page", "Domain"].groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("n"))
    return top(rows.join(pages, "id", "left").select("name", F.coalesce("n", F.lit(0)).alias("pages")), None, "name")


# --- documents ----------------------------------------------------------------------------------------------------------


def docs_list(g: Graph, project: str) -> DataFrame:
    return top(_project(g.nodes["Doc"], project).select("name", "file", "title", "size", "headings"), None, "name", "file")


def doc_get(sources: DataFrame, name: str, folder: str = "docs") -> DataFrame:
    """One document of (path, text): in the folder by its stem, else at the root by its name in any letter case."""
    stem = F.regexp_extract("path", r"([^/]*)\.md$", 1)
    inside = (F.regexp_extract("path", r"^(.*)/[^/]*$", 1) == folder) & (stem == name)
    at_root = ~F.contains("path", F.lit("/")) & (F.lower(stem) == name.lower())
    found = sources.where(inside | at_root).withColumn("order", F.struct(F.when(inside, 0).otherwise(1), "path"))
    return found.agg(F.min_by(F.struct("path", "text"), "order").alias("hit")).where("hit is not null").select(F.lit(name).alias("name"), F.col("hit.path").alias("file"), F.col("hit.text").alias("content"))


def docs_search(g: Graph, project: str, q: str) -> DataFrame:
    searched(q)
    hit = lambda x: F.lower(x).contains(q.lower())
    rows = _project(g.nodes["Doc"], project)
    rows = rows.where(hit(F.col("name")) | hit(F.coalesce("title", F.lit(""))) | F.exists("headings", hit))
    return top(rows.select("name", "file", "title", F.filter("headings", hit).alias("matched_headings")), None, "name", "file")


# --- end-to-end tests -----------------------------------------------------------------------------------------------------


def e2e_specs(g: Graph, project: str, name: str | None = None, limit: int = 500) -> DataFrame:
    rows = _project(g.nodes["E2eSpec"], project)
    if name is not None:
        rows = rows.where(contains_text(F.col("name"), name) | contains_text(F.col("file"), name))
    poms = gather(walk(g, anchors(rows), out("USES_POM", "E2eSpec", "PageObject")), "poms", F.col("name"))
    found = assemble(rows, poms).select("name", "file", "line", "kind", "poms", "id")
    return top(found, bounded(limit, 5000), "file", "line", "name", "id").drop("id")


def e2e_spec(g: Graph, project: str, file: str, line: int, placeholder: bool = False) -> DataFrame:
    """A test with its page objects, their locators and test ids; ``placeholder``: one null page object if it has none."""
    rows = _project(g.nodes["E2eSpec"], project).where((F.col("file") == file) & (F.col("line") == line))
    uses = g.edges["USES_POM", "E2eSpec", "PageObject"].join(anchors(rows).select(F.col("at").alias("src")), "src").select("src", "dst").distinct()
    start = uses.select(F.col("dst").alias("anchor"), F.col("dst").alias("at")).distinct()
    poms = walk_self(g, start, "PageObject").drop("anchor")
    defines = out("DEFINES_LOC", "PageObject", "TestIdLoc")
    locators = gather(walk(g, start, defines), "locators", F.col("name"))
    testids = gather(walk(g, start, defines, out("RESOLVES_TO", "TestIdLoc", "TestId")), "testids", F.col("value"))
    full = assemble(poms, locators, testids)
    objects = uses.join(full.withColumnRenamed("id", "dst"), "dst").select(F.col("src").alias("anchor"), "name", "file", "locators", "testids")
    found = assemble(rows, gather(objects, "page_objects", F.col("name"), F.col("file"), F.col("locators"), F.col("testids")))
    none = F.array(F.struct(F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("file"), F.array().cast("array<string>").alias("locators"), F.array().cast("array<string>").alias("testids")))
    objects = F.when(F.size("page_objects") == 0, none).otherwise(F.col("page_objects")) if placeholder else F.col("page_objects")
    return found.select(F.struct("name", "file", "line", "kind").alias("spec"), objects.alias("page_objects"))


def testids_of_value(g: Graph, project: str, value: str) -> DataFrame:
    """The literal of a value, and the templates whose fixed beginning it has."""
    v = F.col("value")
    return _project(g.nodes["TestId"], project).where((~F.col("pattern") & (v == value)) | (F.col("pattern") & (F.length(v) > 0) & F.lit(value).startswith(v)))


def e2e_testid_info(g: Graph, project: str, value: str) -> DataFrame:
    """Where a test id comes from and which locators, page objects and tests reach it: one row, or none."""
    ids = testids_of_value(g, project, value)
    literals = _project(g.nodes["TestId"], project).where(~F.col("pattern"))
    direct = ids.where(~F.col("pattern")).select("id")
    heads = ids.where("pattern").select("project", F.col("value").alias("head"))
    through = prefix_join(literals.select("project", "id", "value"), heads, "value", "head", ["project"]).select("id")
    start = direct.union(through).distinct().select(F.col("id").alias("at"), F.lit(0).alias("anchor"))
    sources = gather(walk(g, ids.select(F.col("id").alias("at"), F.lit(0).alias("anchor")), into("HAS_TESTID", "File", "TestId", "line")), "sources", F.col("path"), F.col("edge_line"))
    resolves, defines = into("RESOLVES_TO", "TestIdLoc", "TestId"), into("DEFINES_LOC", "PageObject", "TestIdLoc")
    locators = gather(walk(g, start, resolves), "locators", F.col("name"), F.col("file"), F.col("line"))
    poms = gather(walk(g, start, resolves, defines), "page_objects", F.col("name"))
    specs = gather(walk(g, start, resolves, defines, into("USES_POM", "E2eSpec", "PageObject")), "specs", F.col("name"), F.col("file"), F.col("line"))
    one = ids.groupBy().agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.lit(0).alias("id"), F.lit(value).alias("value"))
    return assemble(one, sources, locators, poms, specs).drop("id")


def covered_testids(g: Graph, project: str) -> DataFrame:
    """(id): literals that a locator resolves to, and templates that begin such a literal."""
    ids = _project(g.nodes["TestId"], project)
    hit = g.edges["RESOLVES_TO", "TestIdLoc", "TestId"].select(F.col("dst").alias("id")).distinct()
    literals = ids.where(~F.col("pattern")).join(hit, "id", "left_semi")
    templates = ids.where("pattern").select("project", F.col("id").alias("template_id"), F.col("value").alias("head"))
    begun = prefix_join(literals.select("project", "value"), templates, "value", "head", ["project"]).select(F.col("template_id").alias("id"))
    return literals.select("id").union(begun).distinct()


def e2e_coverage(g: Graph, project: str, compat: bool = False) -> DataFrame:
    """One row: test ids in the source, how many of them tests cover or miss, and how many only tests know.

    The last counts literals that have no source and that no template in the source begins. ``compat`` gives 0 there,
    which is what a count of rows after an optional match comes to.
    """
    ids = _project(g.nodes["TestId"], project)
    has = g.edges["HAS_TESTID", "File", "TestId"].select(F.col("dst").alias("id")).distinct()
    shown = ids.join(has, "id", "left_semi")
    covered = covered_testids(g, project).withColumn("hit", F.lit(1))
    counts = shown.join(covered, "id", "left").agg(F.count(F.lit(1)).alias("total"), F.count("hit").alias("covered"))
    counts = counts.withColumn("uncovered", F.col("total") - F.col("covered"))
    if compat:
        return counts.withColumn("stale_e2e_only", F.lit(0).cast("long"))
    resolved = g.edges["RESOLVES_TO", "TestIdLoc", "TestId"].select(F.col("dst").alias("id")).distinct()
    alone = ids.where(~F.col("pattern")).join(resolved, "id", "left_semi").join(has, "id", "left_anti").select("project", "value")
    heads = ids.where("pattern").join(has, "id", "left_semi").select("project", F.col("value").alias("head"))
    stale = prefix_join(alone, heads, "value", "head", ["project"], "left_anti").agg(F.count(F.lit(1)).alias("stale_e2e_only"))
    # Two one-row aggregates side by side.
    return counts.withColumn("one", F.lit(1)).join(stale.withColumn("one", F.lit(1)), "one").drop("one")


def uncovered_testids(g: Graph, project: str, limit: int | None) -> DataFrame:
    ids = _project(g.nodes["TestId"], project).join(covered_testids(g, project), "id", "left_anti")
    files = walk(g, anchors(ids), into("HAS_TESTID", "File", "TestId", "line")).select("anchor", F.col("path").alias("file"), F.col("edge_line").alias("line"))
    found = ids.join(files, ids["id"] == files["anchor"]).select("value", "pattern", "file", "line")
    return top(found, limit, "file", "line", "value", "pattern")


def e2e_uncovered(g: Graph, project: str, limit: int = 500) -> DataFrame:
    return uncovered_testids(g, project, bounded(limit, 5000))


def e2e_uncovered_by_file(g: Graph, project: str, limit: int = 500) -> DataFrame:
    """The limited list by file, most first: the limit comes before the grouping."""
    rows = e2e_uncovered(g, project, limit)
    grouped = rows.groupBy("file").agg(F.count(F.lit(1)).alias("count"), F.array_sort(F.collect_list(F.struct("value", "pattern", "line"))).alias("testids"))
    return top(grouped, None, F.col("count").desc(), "file")


def e2e_testid_search(g: Graph, project: str, q: str, limit: int = 100, compat: bool = False) -> DataFrame:
    """Test ids that contain a text, and whether a locator resolves to them (``compat``: always said to be so)."""
    rows = _project(g.nodes["TestId"], project).where(contains_text(F.col("value"), searched(q)))
    hit = g.edges["RESOLVES_TO", "TestIdLoc", "TestId"].groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    has = F.lit(True) if compat else F.coalesce(F.col("n") > 0, F.lit(False))
    return top(rows.join(hit, "id", "left").select("value", "pattern", has.alias("has_locator")), bounded(limit, 500), "value", "pattern")


# --- style modules --------------------------------------------------------------------------------------------------------


def scss_list(g: Graph, project: str, name: str | None = None) -> DataFrame:
    rows = _project(g.nodes["ScssModule"], project)
    if name is not None:
        rows = rows.where(F.array_contains("classes", name))
    users = gather(walk(g, anchors(rows), into("USES_SCSS", "File", "ScssModule")), "consumers", F.col("path"))
    return top(assemble(rows, users).select("file", "classes", "consumers", "id"), None, "file", "id").drop("id")


def scss_class(g: Graph, project: str, name: str) -> DataFrame:
    return scss_list(g, project, name).select(F.col("file").alias("module"), "consumers")


# --- ad hoc ---------------------------------------------------------------------------------------------------------------


def impact(g: Graph, project: str, symbol: str | None = None) -> DataFrame:
    """Components that reach an operation through a hook."""
    rows = _project(g.nodes["GqlOperation"], project)
    if symbol is not None:
        rows = rows.where(F.col("symbol") == symbol)
    found = walk(g, anchors(rows), into("WRAPS", "GqlHook", "GqlOperation"), into("CALLS_HOOK", "Component", "GqlHook"))
    return rows.join(found.select("anchor", F.col("name").alias("component"), F.col("file").alias("component_file")), rows["id"] == F.col("anchor")).select("symbol", "component", "component_file").distinct()


def specs_of_testids(g: Graph, project: str) -> DataFrame:
    """Tests that reach each literal test id by locator and page object."""
    rows = _project(g.nodes["TestId"], project).where(~F.col("pattern"))
    found = walk(g, anchors(rows), into("RESOLVES_TO", "TestIdLoc", "TestId"), into("DEFINES_LOC", "PageObject", "TestIdLoc"), into("USES_POM", "E2eSpec", "PageObject"))
    return rows.join(found.select("anchor", F.col("name").alias("spec"), F.col("file").alias("spec_file")), rows["id"] == F.col("anchor")).select("value", "spec", "spec_file").distinct()


def top_hooks(g: Graph, project: str, limit: int = 10) -> DataFrame:
    """The hooks that most components call."""
    users = g.edges["CALLS_HOOK", "Component", "GqlHook"].groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("users"))
    rows = _project(g.nodes["GqlHook"], project).join(users, "id").select("name", "users")
    return top(rows, limit, F.col("users").desc(), "name")


def reindex_summary(g: Graph, project: str) -> DataFrame:
    """(table, n): how many nodes and edges of each kind the project has."""
    counts = [_project(v, project).agg(F.count(F.lit(1)).alias("n")).select(F.lit(f"node {k}").alias("table"), "n") for k, v in g.nodes.items() if k != "Project"]
    counts += [_project(v, project).agg(F.count(F.lit(1)).alias("n")).select(F.lit(f"edge {t} {a} {b}").alias("table"), "n") for (t, a, b), v in g.edges.items()]
    found = counts[0]
    for c in counts[1:]:
        found = found.unionByName(c)
    return found
