"""Single operators on the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.functions.columns import as_text
from graphlens.functions.matches import matches_with_lines
from graphlens.functions.paths import join_route, resolve, stem
from graphlens.graph import Graph
from graphlens.operators import extract, mutation
from graphlens.operators.joins import prefix_join
from graphlens.queries import api
from graphlens.queries.fixture import PROJECT, fixture, table
from graphlens.sources.config import shared_folder
from graphlens.sources.records import read_batch, rejected_records


def x30_match_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines on which a text has "ent" followed by letters, per document: matches, and the sum of their line numbers."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(matches_with_lines(F.col("text"), "(ent)([a-z]+)", 2)).alias("m"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("matches"), F.sum("m.line").alias("line_sum"), F.max("m.g2").alias("last_tail"))


def x20_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Markdown, with every line's first word made a heading mark by the line's length."""
    marked = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(F.repeat(F.lit("#"), (F.length(x) % 5).cast("int")), F.lit(" "), x)), "\n")
    texts = table(spark, sf_dir, "documents").select(F.lit(PROJECT).alias("project"), F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), marked.alias("text"))
    return extract.docs(texts).select("name", "title", F.size("headings").cast("long").alias("n"), F.aggregate("headings", F.lit(0), lambda s, h: s + h["level"]).cast("long").alias("levels"))


def x27_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 3 == 0, F.concat("event_type", F.lit("-${id}-"), F.col("user_id").cast("string"))).when(F.col("event_id") % 7 == 0, F.lit("${x}-tail")).otherwise(F.col("event_type"))
    value, pattern = extract.classified(raw)
    return table(spark, sf_dir, "events").select(value.alias("value"), pattern.alias("pattern")).groupBy("value", "pattern").agg(F.count(F.lit(1)).alias("n"))


def x28_sorted_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.array_sort(F.array_distinct(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1))))
    return as_text(table(spark, sf_dir, "pages").select("page_id", found.alias("links")))


def x08_join_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    parent = F.when(k % 4 == 0, None).when(k % 4 == 1, F.concat(F.lit("/"), "c_mktsegment", F.lit("/"))).otherwise(F.concat(F.lit("/"), "c_mktsegment"))
    segment = F.when(k % 5 == 0, None).when(k % 5 == 1, F.concat(F.lit("/abs"), k.cast("string"))).otherwise(F.concat(F.lit("s"), k.cast("string")))
    return table(spark, sf_dir, "customer").select("c_custkey", join_route(parent, segment, k % 3 == 0).alias("path"))


def x07_route_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a tree of which each has four children; a node's segment is its number."""
    k = F.col("c_custkey")
    nodes = table(spark, sf_dir, "customer").select(k.alias("node"), F.when(k > 0, F.floor((k - 1) / 4)).alias("parent"), F.when(k % 7 != 0, k.cast("string")).alias("segment"), (k % 11 == 0).alias("index"))
    return extract.route_tree(nodes)


def x19_permission_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested role objects as JSON, one per region, walked to dotted keys."""
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    roles = F.array(F.concat(F.lit("R"), (F.col("n_nationkey") % 3).cast("string")), F.lit("ALL"))
    inner = nations.groupBy("r_name").agg(F.map_from_entries(F.collect_list(F.struct("n_name", F.create_map(F.lit("read"), roles)))).alias("m"))
    objects = inner.select(F.col("r_name").alias("project"), F.to_json(F.create_map(F.lower("r_name"), F.col("m"))).alias("json"))
    return as_text(extract.permission_keys(objects))


def f12_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    relative = F.concat(F.when(p % 3 == 0, "../").when(p % 3 == 1, "./").otherwise("../../../"), F.col("p_brand"), F.lit("/x.locators.ts"))
    found = resolve(F.concat(F.lit("src/"), F.col("p_size").cast("string")), relative)
    return table(spark, sf_dir, "part").select("p_partkey", found.alias("path"), stem(F.coalesce(found, F.lit("none.locators.ts")), ".locators").alias("stem"))


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    g = fixture(spark, sf_dir)
    ids = g.nodes["TestId"]
    return ids.where("not pattern").select("project", "value"), ids.where("pattern").select("project", F.col("value").alias("head"))


def j06_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    values, heads = _sides(spark, sf_dir)
    return prefix_join(values, heads, "value", "head", ["project"]).select("value", "head")


def j10_prefix_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    values, heads = _sides(spark, sf_dir)
    return prefix_join(values, heads, "value", "head", ["project"], "left_anti").select("value")


def _old_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Old values: every customer with orders. New ones: every customer. Keys are in both, or in the new alone."""
    row = lambda d, k, v: d.select(F.lit(PROJECT).alias("project"), F.col(k).alias("key"), v.alias("v"))
    old = row(table(spark, sf_dir, "orders"), "o_custkey", F.col("o_orderpriority")).groupBy("project", "key").agg(F.min("v").alias("v"))
    new = row(table(spark, sf_dir, "customer"), "c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")))
    return old.unionByName(row(table(spark, sf_dir, "supplier"), "s_suppkey", F.lit("supplier")).withColumn("key", -F.col("key") - 1)), new


def w02_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutation.upsert(*_old_new(spark, sf_dir), ["project", "key"]).drop("project")


def w03_upsert_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutation.upsert_set(*_old_new(spark, sf_dir), ["project", "key"]).drop("project")


def w04_upsert_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("status"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("priority"))
    return mutation.upsert_first(rows, ["o_custkey"], ["o_orderkey"]).select("o_custkey", "status", "priority")


def w06_resolve_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that name an operation by its symbol, which several have; unknown names give no edge."""
    g = fixture(spark, sf_dir)
    items = table(spark, sf_dir, "lineitem")
    facts = items.select(F.lit(PROJECT).alias("project"), F.concat(F.lit("use"), F.col("l_suppkey").cast("string")).alias("hook"), F.concat(F.lit("OP_"), F.col("l_partkey").cast("string")).alias("symbol"), F.col("l_linenumber").alias("line"))
    found = mutation.resolve_edges(facts, g.nodes["GqlHook"], g.nodes["GqlOperation"], {"hook": "name"}, {"symbol": "symbol"}, ["line"])
    return found.select("src", "dst", "line")


def w08_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by their nation's number as project; projects are the nations of suppliers with a large balance."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("project"), "c_custkey")
    rich = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.max("s_acctbal").alias("most")).where("most > 8000")
    known = rich.select(F.col("s_nationkey").cast("string").alias("name"))
    return mutation.gated(rows, known).select("project", "c_custkey")


def w09_wipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of routes and components, by segment as project, after one segment's routes are wiped."""
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    routes = customers.select(F.col("c_mktsegment").alias("project"), F.col("c_custkey").alias("id"))
    edges = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("project"), F.col("c_custkey").alias("src"), F.col("o_orderkey").alias("dst"))
    nodes, left = mutation.wipe({"Route": routes}, {("RENDERS", "Route", "Component"): edges}, ["Route"], "BUILDING")
    count = lambda d, n: d.groupBy("project").agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("table"), "project", "n")
    return count(nodes["Route"], "Route").unionByName(count(left["RENDERS", "Route", "Component"], "RENDERS"))


def a08_two_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hooks by how many components call them."""
    g = fixture(spark, sf_dir)
    per_hook = g.edges["CALLS_HOOK", "Component", "GqlHook"].groupBy("dst").agg(F.count_distinct("src").alias("users"))
    return per_hook.agg(F.count(F.lit(1)).alias("hooks"), F.sum("users").alias("uses"), F.max("users").alias("most"), F.count_if(F.col("users") > 100).alias("busy"))


def _record_lines(spark: SparkSession, sf_dir: str) -> str:
    """Parts as operation records in JSON lines, written to a new folder.

    One in seven is no JSON, one has a text for its line number, one a field that the schema does not have.
    """
    k, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("long")
    known = {"project": F.lit(PROJECT), "symbol": F.concat(F.lit("OP_"), k), "gqlName": F.concat(F.lit("Get"), k), "kind": F.lit("query"), "file": F.concat(F.lit("src/p"), k, F.lit(".ts"))}
    fields = [v.alias(n) for n, v in known.items()]
    good = [*fields, size.alias("line"), (size % 2 == 0).alias("exported")]
    which = F.col("p_partkey") % 7
    line = F.when(which == 0, F.concat(F.lit("{ no record "), k)).when(which == 1, F.to_json(F.struct(*fields, F.lit("many").alias("line")))).when(which == 2, F.to_json(F.struct(*good, F.lit(1).alias("extra")))).otherwise(F.to_json(F.struct(*good)))
    folder = f"{shared_folder(spark)}/operations"
    table(spark, sf_dir, "part").select(line.alias("value")).write.text(folder)
    return folder


def s17_json_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_batch(spark, _record_lines(spark, sf_dir), "operations").drop("project")


def s19_rejected_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejected_records(spark, _record_lines(spark, sf_dir), "operations").drop("file")


def w10_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixture's routes and components, of which some are there twice and some are lost, and what is then wrong."""
    g = fixture(spark, sf_dir)
    components = g.nodes["Component"].where("id % 10 <> 0")
    twice = components.where("id % 97 = 1").withColumn("name", F.concat("name", F.lit("again")))
    routes = g.nodes["Route"].where("id % 4 <> 0")
    edge = ("RENDERS", "Route", "Component")
    return Graph({"Route": routes, "Component": mutation.insert(components, twice)}, {edge: g.edges[edge]}).violations()


def w01_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers put to customers by nation: what both have stays twice, and columns that one side lacks are null."""
    old = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("key"), F.col("c_mktsegment").alias("v"))
    return mutation.insert(old, table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("key"))).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("with_v"))


def q26_build_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every node and edge table of the fixture graph."""
    return api.reindex_summary(fixture(spark, sf_dir), PROJECT)


QUERIES = {
    "F-12_resolve_path": f12_resolve,
    "X-07_route_tree": x07_route_tree,
    "X-08_join_route": x08_join_route,
    "X-19_permission_keys": x19_permission_keys,
    "X-20_titles": x20_titles,
    "X-27_classify": x27_classify,
    "X-28_sorted_tokens": x28_sorted_tokens,
    "X-30_match_lines": x30_match_lines,
    "J-06_prefix_join": j06_prefix_join,
    "J-10_prefix_anti": j10_prefix_anti,
    "S-17_json_batches": s17_json_batches,
    "S-19_rejected_records": s19_rejected_records,
    "W-01_insert": w01_insert,
    "W-02_upsert": w02_upsert,
    "W-03_upsert_set": w03_upsert_set,
    "W-04_upsert_first": w04_upsert_first,
    "W-06_resolve_edges": w06_resolve_edges,
    "W-08_gate": w08_gate,
    "W-09_wipe": w09_wipe,
    "W-10_violations": w10_violations,
    "A-08_two_levels": a08_two_levels,
    "Q-26_build_counts": q26_build_counts,
}

_OLD = "SELECT o_custkey AS key, min(o_orderpriority) AS v FROM orders GROUP BY 1 UNION ALL SELECT -s_suppkey - 1, 'supplier' FROM supplier"
_NEW = "SELECT c_custkey AS key, CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS v FROM customer"
_EV = "SELECT *, event_type || '-' || k AS literal, event_type || '-' || left(CAST(k AS VARCHAR), 1) AS head FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"
_SIGHTS = f"SELECT user_id, event_id, literal AS value, false AS pattern FROM ({_EV}) WHERE k % 3 <> 0 UNION ALL SELECT user_id, event_id, head, true FROM ({_EV}) WHERE event_type IN ('click', 'view') AND k % 10 = 0"
_GRANTS = "SELECT DISTINCT n_nationkey, c FROM (SELECT n_nationkey, unnest([n_nationkey % 7, n_nationkey % 3]) AS c FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey % 5 <> 4)"
_HEADS = f"ev AS ({_EV}), lit AS (SELECT DISTINCT literal AS value FROM ev WHERE k % 3 <> 0 OR k % 4 = 0), heads AS (SELECT DISTINCT head FROM ev WHERE event_type IN ('click', 'view') AND k % 10 = 0)"

ORACLE_SQL = {
    "F-12_resolve_path": """WITH t AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'src/' || p_brand || '/x.locators.ts' WHEN 1 THEN 'src/' || p_size || '/' || p_brand || '/x.locators.ts' END AS path FROM part)
SELECT p_partkey, path, CASE WHEN path IS NULL THEN 'none' ELSE 'x' END AS stem FROM t""",
    "X-07_route_tree": """WITH RECURSIVE n AS (SELECT c_custkey AS node, CASE WHEN c_custkey > 0 THEN (c_custkey - 1) // 4 END AS parent, CASE WHEN c_custkey % 7 <> 0 THEN CAST(c_custkey AS VARCHAR) END AS segment, c_custkey % 11 = 0 AS index FROM customer),
t AS (SELECT node, CASE WHEN segment IS NULL THEN '/' ELSE '/' || segment END AS path, CAST(0 AS BIGINT) AS depth, CAST(NULL AS VARCHAR) AS parent_path FROM n WHERE parent IS NULL
UNION ALL SELECT n.node, CASE WHEN n.index OR n.segment IS NULL THEN t.path ELSE regexp_replace(t.path, '/$', '') || '/' || n.segment END, t.depth + 1, t.path FROM n JOIN t ON n.parent = t.node) SELECT * FROM t""",
    "X-08_join_route": """WITH t AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '/' || c_mktsegment || '/' ELSE '/' || c_mktsegment END AS parent, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '/abs' || c_custkey ELSE 's' || c_custkey END AS segment, c_custkey % 3 = 0 AS index FROM customer)
SELECT c_custkey, CASE WHEN parent IS NULL AND segment IS NULL THEN '/' WHEN parent IS NULL AND starts_with(segment, '/') THEN segment WHEN parent IS NULL THEN '/' || segment WHEN index OR segment IS NULL THEN parent WHEN starts_with(segment, '/') THEN segment ELSE rtrim(parent, '/') || '/' || segment END AS path FROM t""",
    "X-19_permission_keys": "SELECT r_name AS project, lower(r_name) || '.' || n_name || '.read' AS key, 'ALL,R' || n_nationkey % 3 AS roles FROM nation JOIN region ON n_regionkey = r_regionkey",
    "X-20_titles": """WITH l AS (SELECT doc_id, n, line, length(line) % 5 AS level FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)),
h AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS k FROM l WHERE level BETWEEN 1 AND 3 AND trim(line) <> '')
SELECT CAST(d.doc_id AS VARCHAR) AS name, max(CASE WHEN k = 1 AND level = 1 THEN trim(line) END) AS title, count(level) AS n, coalesce(sum(level), 0)::BIGINT AS levels FROM documents d LEFT JOIN h ON h.doc_id = d.doc_id GROUP BY d.doc_id""",
    "X-27_classify": """WITH r AS (SELECT CASE WHEN event_id % 3 = 0 THEN event_type || '-${id}-' || user_id WHEN event_id % 7 = 0 THEN '${x}-tail' ELSE event_type END AS raw FROM events)
SELECT split_part(raw, '${', 1) AS value, contains(raw, '${') AS pattern, count(*) AS n FROM r GROUP BY 1, 2""",
    "X-28_sorted_tokens": "SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html, 'href=\"/([^\"]*)\"', 1))), ',') AS links FROM pages",
    "X-30_match_lines": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
m AS (SELECT doc_id, n, unnest(regexp_extract_all(line, 'ent([a-z]+)', 1)) AS tail FROM l)
SELECT doc_id, count(*) AS matches, sum(n)::BIGINT AS line_sum, max(tail) AS last_tail FROM m GROUP BY doc_id""",
    "J-06_prefix_join": f"WITH {_HEADS} SELECT value, head FROM lit JOIN heads ON starts_with(value, head)",
    "J-10_prefix_anti": f"WITH {_HEADS} SELECT value FROM lit WHERE NOT EXISTS (SELECT 1 FROM heads WHERE starts_with(value, head))",
    "S-17_json_batches": """SELECT 'OP_' || p_partkey AS symbol, 'Get' || p_partkey AS "gqlName", 'query' AS kind, 'src/p' || p_partkey || '.ts' AS file, CAST(p_size AS BIGINT) AS line, p_size % 2 = 0 AS exported FROM part WHERE p_partkey % 7 NOT IN (0, 1)""",
    "S-19_rejected_records": """SELECT 'operations' AS kind, '{ no record ' || p_partkey AS record, 'no JSON' AS reason FROM part WHERE p_partkey % 7 = 0
UNION ALL SELECT 'operations', '{"project":"fx","symbol":"OP_' || p_partkey || '","gqlName":"Get' || p_partkey || '","kind":"query","file":"src/p' || p_partkey || '.ts","line":"many"}', 'a field of another type' FROM part WHERE p_partkey % 7 = 1""",
    "W-01_insert": "SELECT key, count(*) AS n, count(v) AS with_v FROM (SELECT c_nationkey AS key, c_mktsegment AS v FROM customer UNION ALL SELECT s_nationkey, NULL FROM supplier) GROUP BY 1",
    "W-02_upsert": f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT key, v FROM o UNION ALL SELECT key, v FROM n WHERE key NOT IN (SELECT key FROM o)",
    "W-03_upsert_set": f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT key, v FROM n UNION ALL SELECT key, v FROM o WHERE key NOT IN (SELECT key FROM n)",
    "W-04_upsert_first": "SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) FILTER (o_orderkey % 3 <> 0) AS status, arg_min(o_orderpriority, o_orderkey) FILTER (o_orderkey % 5 <> 0) AS priority FROM orders GROUP BY 1",
    "W-06_resolve_edges": "SELECT DISTINCT l_suppkey AS src, p_partkey AS dst, l_linenumber AS line FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey - p_partkey % 2 = l_partkey",
    "W-08_gate": "SELECT CAST(c_nationkey AS VARCHAR) AS project, c_custkey FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier GROUP BY 1 HAVING max(s_acctbal) > 8000)",
    "W-09_wipe": """SELECT 'Route' AS "table", c_mktsegment AS project, count(*) AS n FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY 2 UNION ALL SELECT 'RENDERS', c_mktsegment, count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment <> 'BUILDING' GROUP BY 2""",
    "W-10_violations": """SELECT * FROM (SELECT 'node_Component' AS "table", 'repeated id' AS problem, count(*) AS n FROM orders WHERE o_orderkey % 10 <> 0 AND o_orderkey % 97 = 1
UNION ALL SELECT 'edge_RENDERS__Route__Component', 'missing dst', count(*) FROM orders WHERE o_orderkey % 10 = 0
UNION ALL SELECT 'edge_RENDERS__Route__Component', 'missing src', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 <> 0)) WHERE n > 0""",
    "A-08_two_levels": "SELECT count(*) AS hooks, sum(u)::BIGINT AS uses, max(u) AS most, count(*) FILTER (u > 100) AS busy FROM (SELECT l_suppkey, count(DISTINCT l_orderkey) AS u FROM lineitem WHERE l_linenumber = 1 GROUP BY 1)",
    "Q-26_build_counts": f"""SELECT 'node Domain' AS "table", count(DISTINCT year(o_orderdate)) AS n FROM orders UNION ALL SELECT 'node Page', count(DISTINCT (year(o_orderdate), o_orderpriority)) + count(DISTINCT year(o_orderdate)) FROM orders
UNION ALL SELECT 'node Component', count(*) FROM orders UNION ALL SELECT 'node Route', count(*) FROM customer UNION ALL SELECT 'node GqlOperation', count(*) FROM part UNION ALL SELECT 'node GqlHook', count(*) FROM supplier
UNION ALL SELECT 'node Doc', count(*) FROM documents UNION ALL SELECT 'node ScssModule', count(*) FROM pages UNION ALL SELECT 'edge RENDERS Route Component', count(*) FROM orders
UNION ALL SELECT 'edge WRAPS GqlHook GqlOperation', count(DISTINCT (l_suppkey, l_partkey)) FROM lineitem WHERE l_linenumber = 1 AND l_quantity > 40
UNION ALL SELECT 'edge CALLS_HOOK Component GqlHook', count(DISTINCT (l_orderkey, l_suppkey)) FROM lineitem WHERE l_linenumber = 1
UNION ALL SELECT 'edge USES_OPERATION Component GqlOperation', count(DISTINCT (l_orderkey, l_partkey)) FROM lineitem WHERE l_linenumber = 2 AND l_quantity > 45
UNION ALL SELECT 'node File', (SELECT count(*) FROM orders) + (SELECT count(DISTINCT user_id) FROM events) + count(DISTINCT regexp_extract(url, '^https?://([^/]+)', 1)) FROM pages
UNION ALL SELECT 'node Guard', count(DISTINCT c_mktsegment) FROM customer UNION ALL SELECT 'node Permission', count(*) FROM nation UNION ALL SELECT 'node Role', count(DISTINCT c) FROM ({_GRANTS})
UNION ALL SELECT 'node TestId', count(*) FROM (SELECT DISTINCT value, pattern FROM ({_SIGHTS}) UNION SELECT literal, false FROM ({_EV}) WHERE k % 4 = 0) UNION ALL SELECT 'node TestIdLoc', count(DISTINCT literal) FROM ({_EV}) WHERE k % 4 = 0
UNION ALL SELECT 'node PageObject', count(DISTINCT event_type) FROM events UNION ALL SELECT 'node E2eSpec', count(DISTINCT (user_id % 10, event_type)) FROM events
UNION ALL SELECT 'edge IN_DOMAIN Page Domain', count(DISTINCT (year(o_orderdate), o_orderpriority)) + count(DISTINCT year(o_orderdate)) FROM orders UNION ALL SELECT 'edge BELONGS_TO Component Page', count(*) FROM orders UNION ALL SELECT 'edge HAS_FILE Page File', count(*) FROM orders
UNION ALL SELECT 'edge GUARDED_BY Route Guard', count(*) FROM customer UNION ALL SELECT 'edge REQUIRES Route Permission', count(*) FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT 'edge GRANTED_TO Permission Role', count(*) FROM ({_GRANTS})
UNION ALL SELECT 'edge CHILD_OF Route Route', count(*) FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey > 0
UNION ALL SELECT 'edge CALLS_HOOK File GqlHook', count(DISTINCT (l_orderkey, l_suppkey, l_linenumber, l_partkey)) FROM lineitem JOIN orders ON o_orderkey = l_orderkey
UNION ALL SELECT 'edge USES_OPERATION File GqlOperation', count(DISTINCT (l_orderkey, l_suppkey, l_partkey)) FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber = 3 AND l_quantity > 45
UNION ALL SELECT 'edge HAS_TESTID File TestId', count(*) FROM (SELECT DISTINCT user_id, value, pattern, event_id FROM ({_SIGHTS})) UNION ALL SELECT 'edge RESOLVES_TO TestIdLoc TestId', count(DISTINCT literal) FROM ({_EV}) WHERE k % 4 = 0
UNION ALL SELECT 'edge DEFINES_LOC PageObject TestIdLoc', count(DISTINCT literal) FROM ({_EV}) WHERE k % 4 = 0 UNION ALL SELECT 'edge USES_POM E2eSpec PageObject', count(DISTINCT (user_id % 10, event_type)) FROM events WHERE event_type <> 'error'
UNION ALL SELECT 'edge USES_SCSS File ScssModule', count(*) FROM pages""",
}
