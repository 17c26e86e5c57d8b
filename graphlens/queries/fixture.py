"""A graph over the star-schema, event, document and page tables, to run every graph query on. All rows: project fx."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.graph import Graph, Later, node_id
from graphlens.schema import EDGES, NODES, edge_schema

PROJECT = "fx"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(*parts) -> Column:
    return F.concat(*[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])


def _id(label: str, *identity: Column) -> Column:
    return node_id(label, F.lit(PROJECT), *identity)


def _long(name: str) -> Column:
    return F.col(name).cast("long")


def fixture(spark: SparkSession, sf_dir: str) -> Graph:
    """Lazy node and edge tables; each query reads only the tables and columns that it needs."""
    t = lambda name: table(spark, sf_dir, name)
    orders, items, customers = t("orders"), t("lineitem"), t("customer")
    year, entity = F.year("o_orderdate").cast("string"), F.col("o_orderpriority")
    page_dir = _text("src/pages/", year, "/", entity)
    file = _text(page_dir, "/C", F.col("o_orderkey"), ".tsx")
    orders = orders.select("*", year.alias("year"), page_dir.alias("dir"), file.alias("file"))
    file_id, page_id = _id("File", F.col("file")), _id("Page", F.col("year"), F.col("o_orderpriority"))
    events = t("events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    key = F.col("k").cast("string")
    literal = _text(F.col("event_type"), "-", key)
    events = events.select("*", literal.alias("literal"), _text(F.col("event_type"), "-", F.substring(key, 1, 1)).alias("head"), _text("user_", F.col("user_id")).alias("user_file"))
    pages = t("pages").select("*", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"))
    documents = t("documents")
    nations = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    nations = nations.withColumn("key", _text(F.lower("r_name"), ".", F.lower("n_name"))).withColumn(
        "roles", F.when(F.col("n_nationkey") % 5 != 4, F.array_sort(F.array_distinct(F.array(_text("R", F.col("n_nationkey") % 7), _text("R", F.col("n_nationkey") % 3)))))
    )

    nodes, edges = Later(), Later()

    def shape(rows: DataFrame, **columns: Column) -> DataFrame:
        return rows.select(F.lit(PROJECT).alias("project"), *[v.alias(k) for k, v in columns.items()])

    def link(rows: DataFrame, src: Column, dst: Column, **properties: Column) -> DataFrame:
        return shape(rows, src=src, dst=dst, **properties).distinct()

    nodes.later("Project", lambda: shape(spark.range(1), id=_id("Project"), name=F.lit(PROJECT)))
    nodes.later("Domain", lambda: shape(orders.select("year").distinct(), id=_id("Domain", F.col("year")), name=F.col("year")))
    statuses = F.array_sort(F.collect_set("o_orderstatus"))
    entity_pages = orders.groupBy("year", "o_orderpriority", "dir").agg(statuses.alias("files"))
    domain_pages = orders.groupBy("year").agg(statuses.alias("files")).select("year", F.lit("").alias("o_orderpriority"), _text("src/pages/", F.col("year")).alias("dir"), "files")
    both = entity_pages.unionByName(domain_pages)
    nodes.later("Page", lambda: shape(both, id=page_id, domain=F.col("year"), entity=F.col("o_orderpriority"), dir=F.col("dir"), files=F.col("files"), subdirs=F.col("files")))
    nodes.later("Component", lambda: shape(orders, id=_long("o_orderkey"), name=_text("C", F.col("o_orderkey")), file=F.col("file"), line=_long("o_orderkey") % 100, exported=F.col("o_orderstatus") != "F"))
    paths = orders.select(F.col("file").alias("path")).union(events.select("user_file")).union(pages.select("host")).distinct()
    nodes.later("File", lambda: shape(paths, id=_id("File", F.col("path")), path=F.col("path")))
    route = _text("/", F.lower("c_mktsegment"), "/", F.col("c_custkey"))
    nodes.later("Route", lambda: shape(customers, id=_long("c_custkey"), path=route, index=F.col("c_custkey") % 5 == 0, depth=1 + _long("c_custkey") % 3, file=F.lit("src/router/index.tsx"), line=_long("c_custkey")))
    nodes.later("Guard", lambda: shape(customers.select("c_mktsegment").distinct(), id=_id("Guard", F.col("c_mktsegment")), name=F.col("c_mktsegment")))
    nodes.later("Permission", lambda: shape(nations, id=_id("Permission", F.col("key")), key=F.col("key"), roles=F.col("roles"), file=F.lit("src/common/permissions/index.ts"), line=_long("n_nationkey")))
    codes = nations.select(F.explode("roles").alias("code")).distinct()
    nodes.later("Role", lambda: shape(codes, id=_id("Role", F.col("code")), code=F.col("code")))
    kind = F.element_at(F.array(*[F.lit(x) for x in ("query", "mutation", "subscription", "fragment")]), (F.col("p_size") % 4 + 1).cast("int"))
    nodes.later("GqlOperation", lambda: shape(t("part"), id=_long("p_partkey"), symbol=_text("OP_", _long("p_partkey") - _long("p_partkey") % 2), gql_name=F.col("p_name"), kind=kind, file=_text("src/gql/queries/p", F.col("p_partkey"), ".ts"), line=_long("p_size"), exported=F.col("p_size") % 2 == 0))
    s = _long("s_suppkey")
    hook_file = (
        F.when(s % 10 == 0, _text("src/pages/", 1995 + F.floor(s % 50 / 10), "/gql/hooks/h", s, ".ts"))
        .when(s % 10 == 5, _text("src/pages/", 1995 + F.floor(s % 50 / 10), "/1-URGENT/gql/hooks/h", s, ".ts"))
        .otherwise(_text("src/gql/hooks/h", s, ".ts"))
    )
    nodes.later("GqlHook", lambda: shape(t("supplier"), id=s, name=_text("use", s), file=hook_file, line=s % 50))
    shown = events.where("k % 3 <> 0").select(F.col("literal").alias("value"), F.lit(False).alias("pattern"), F.col("user_file"), F.col("event_id").alias("line"))
    heads = events.where("event_type in ('click', 'view') and k % 10 = 0").select(F.col("head").alias("value"), F.lit(True).alias("pattern"), F.col("user_file"), F.col("event_id").alias("line"))
    sighted = shown.union(heads)
    located = events.where("k % 4 = 0").select("event_type", "literal").distinct()
    ids = sighted.select("value", "pattern").union(located.select("literal", F.lit(False))).distinct()
    nodes.later("TestId", lambda: shape(ids, id=_id("TestId", F.col("value"), F.col("pattern")), value=F.col("value"), pattern=F.col("pattern"), template=F.col("value")))
    locator_file = _text("e2e/pages/", F.col("event_type"), ".locators.ts")
    loc_name = _text("loc_", F.col("literal"))
    loc_id = _id("TestIdLoc", loc_name)
    nodes.later("TestIdLoc", lambda: shape(located, id=loc_id, name=loc_name, module=F.col("event_type"), value=_text("[data-testid=\"", F.col("literal"), "\"]"), parametric=F.lit(False), file=locator_file, line=F.length("literal").cast("long")))
    types = events.select("event_type").distinct()
    pom = _text(F.col("event_type"), "Page")
    nodes.later("PageObject", lambda: shape(types, id=_id("PageObject", pom), name=pom, file=_text("e2e/pages/", F.col("event_type"), ".page.ts")))
    specs = events.select((F.col("user_id") % 10).alias("u"), "event_type").distinct()
    spec_line = F.length("event_type").cast("long") * 10 + F.ascii("event_type")
    spec_id = _id("E2eSpec", F.col("u"), F.col("event_type"))
    nodes.later("E2eSpec", lambda: shape(specs, id=spec_id, name=_text("spec ", F.col("event_type"), " ", F.col("u")), file=_text("e2e/tests/u", F.col("u"), ".spec.ts"), line=spec_line, kind=F.lit("test")))
    lines = F.split("text", "\n")
    first = F.element_at(lines, 1)
    nodes.later("Doc", lambda: shape(documents, id=_long("doc_id"), name=F.col("doc_id").cast("string"), file=_text("docs/", F.col("doc_id"), ".md"), title=F.when(F.length(first) <= 200, first), size=_long("n_chars"), headings=F.filter(lines, lambda x: (F.length(x) >= 1) & (F.length(x) <= 40))))
    nodes.later("ScssModule", lambda: shape(pages, id=_long("page_id"), file=F.col("url"), classes=F.array_sort(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))))))

    edges.later(("IN_DOMAIN", "Page", "Domain"), lambda: link(both, page_id, _id("Domain", F.col("year"))))
    edges.later(("BELONGS_TO", "Component", "Page"), lambda: link(orders, _long("o_orderkey"), page_id))
    edges.later(("HAS_FILE", "Page", "File"), lambda: link(orders, page_id, file_id))
    edges.later(("RENDERS", "Route", "Component"), lambda: link(orders, _long("o_custkey"), _long("o_orderkey")))
    edges.later(("GUARDED_BY", "Route", "Guard"), lambda: link(customers, _long("c_custkey"), _id("Guard", F.col("c_mktsegment"))))
    edges.later(("REQUIRES", "Route", "Permission"), lambda: link(customers.join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey")), _long("c_custkey"), _id("Permission", F.col("key"))))
    edges.later(("GRANTED_TO", "Permission", "Role"), lambda: link(nations.select("key", F.explode("roles").alias("code")), _id("Permission", F.col("key")), _id("Role", F.col("code"))))
    edges.later(("CHILD_OF", "Route", "Route"), lambda: link(customers.where("c_custkey % 3 <> 0 and c_custkey > 0"), _long("c_custkey"), _long("c_custkey") - 1))
    edges.later(("WRAPS", "GqlHook", "GqlOperation"), lambda: link(items.where("l_linenumber = 1 and l_quantity > 40"), _long("l_suppkey"), _long("l_partkey")))
    edges.later(("CALLS_HOOK", "Component", "GqlHook"), lambda: link(items.where("l_linenumber = 1"), _long("l_orderkey"), _long("l_suppkey")))
    edges.later(("USES_OPERATION", "Component", "GqlOperation"), lambda: link(items.where("l_linenumber = 2 and l_quantity > 45"), _long("l_orderkey"), _long("l_partkey")))
    with_file = items.join(orders.select("o_orderkey", "file"), F.col("l_orderkey") == F.col("o_orderkey"))
    edges.later(("CALLS_HOOK", "File", "GqlHook"), lambda: link(with_file, file_id, _long("l_suppkey"), line=_long("l_linenumber"), col=_long("l_partkey")))
    edges.later(("USES_OPERATION", "File", "GqlOperation"), lambda: link(with_file.where("l_linenumber = 3 and l_quantity > 45"), file_id, _long("l_partkey"), line=_long("l_linenumber"), col=_long("l_suppkey")))
    edges.later(("HAS_TESTID", "File", "TestId"), lambda: link(sighted, _id("File", F.col("user_file")), _id("TestId", F.col("value"), F.col("pattern")), line=_long("line")))
    edges.later(("RESOLVES_TO", "TestIdLoc", "TestId"), lambda: link(located, loc_id, _id("TestId", F.col("literal"), F.lit(False))))
    edges.later(("DEFINES_LOC", "PageObject", "TestIdLoc"), lambda: link(located, _id("PageObject", pom), loc_id))
    edges.later(("USES_POM", "E2eSpec", "PageObject"), lambda: link(specs.where("event_type <> 'error'"), spec_id, _id("PageObject", pom)))
    edges.later(("USES_SCSS", "File", "ScssModule"), lambda: link(pages, _id("File", F.col("host")), _long("page_id")))
    for label, spec in NODES.items():
        nodes.later(label, lambda spec=spec: spark.createDataFrame([], spec.schema), unless_known=True)
    for key in EDGES:
        edges.later(key, lambda key=key: spark.createDataFrame([], edge_schema(key)), unless_known=True)
    return Graph(nodes, edges)
