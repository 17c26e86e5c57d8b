"""The graph: patterns on a hand-made graph, mutation, build, publish, and every fixture query against DuckDB."""

from pathlib import Path

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphlens.functions.columns import as_text
from graphlens.graph import Graph, with_identity
from graphlens.operators import mutation, ranks
from graphlens.operators.joins import prefix_join
from graphlens.plans.build import OWNED, build, rebuild
from graphlens.plans.pattern import gather, gather_parts
from graphlens.queries import ORACLE_SQL, QUERIES, api
from graphlens.sources.config import projects
from graphlens.sources.records import BATCHES, empty_batches, read_batch
from graphlens.streaming.ingest import current, ingest

SF = "/root/testdata/sf0.001"


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())


def batches(spark, **known):
    out = empty_batches(spark)
    for k, v in known.items():
        out[k] = spark.createDataFrame(v, BATCHES[k])
    return out


@pytest.fixture(scope="module")
def records(spark):
    return batches(
        spark,
        projects=[("p", "/root/p"), ("q", "/root/q")],
        operations=[("p", "A", "GetA", "query", "ops/a.ts", 1, True), ("p", "A", "FragA", "fragment", "ops/a.ts", 1, True), ("p", "B", "B", "mutation", "ops/b.ts", 2, False), ("q", "A", "Other", "query", "ops/a.ts", 1, True), ("gone", "Z", "Z", "query", "z", 1, True)],
        hooks=[("p", "useA", "src/pages/dom/ent/hooks.ts", 3, ["A", "Missing"]), ("p", "useB", "src/gql/hooks/b.ts", 4, ["B"]), ("p", "useNone", "x.ts", 5, [])],
        callsites=[("p", "A", "operation", "src/pages/dom/ent/Ent.tsx", 7, 2), ("p", "A", "operation", "src/pages/dom/ent/Ent.tsx", 8, 2), ("p", "useA", "hook", "src/x.tsx", 1, 1), ("p", "useA", "hook", "src/x.tsx", 1, 1), ("p", "unknown", "hook", "src/x.tsx", 1, 1)],
        routes=[("p", "/e", False, 0, None, "r.tsx", 1, ["Ent", "Ent"], ["AuthGuard"], ["perm.read"]), ("p", "/e", True, 1, "/e", "r.tsx", 2, ["Nobody"], [], ["bare.key"]), ("p", "/f", False, 0, None, "r.tsx", 3, [], [], [])],
        components=[("p", "Ent", "src/pages/dom/ent/Ent.tsx", 1, True, ["useB"], ["B"]), ("q", "Ent", "e.tsx", 1, True, [], [])],
        permissions=[("p", "perm.read", ["R1", "R2"], "perm.ts", 3), ("p", "perm.none", [], "perm.ts", 4)],
        pages=[("p", "dom", "ent", "src/pages/dom/ent", [("Ent", "src/pages/dom/ent/Ent.tsx")], {"types": "src/pages/dom/ent/types.ts"}, ["sub"]), ("p", "dom", None, "src/pages/dom", [], {"types": "src/pages/dom/types.ts"}, [])],
        docs=[("p", "setup", "docs/setup.md", "Setup", 10, [(1, "Setup"), (2, "Install it")]), ("p", "bare", "docs/bare.md", None, 1, [])],
        specs=[("p", "first", "t.spec.ts", 1, "test", ["HomePage"]), ("p", "second", "t.spec.ts", 9, "test", [])],
        page_objects=[("p", "HomePage", "e2e/pages/home.page.ts")],
        locators=[("p", "home", "button", "sel", False, ["row-1", "only-e2e", "go"], "e2e/pages/home.locators.ts", 1)],
        testids=[("p", "go", "src/a.tsx", 1, False, "go"), ("p", "miss", "src/a.tsx", 2, False, "miss"), ("p", "row-", "src/b.tsx", 3, True, "row-${i}"), ("p", "row-", "src/c.tsx", 3, True, "row-${j}")],
        scss=[("p", "s.module.scss", ["a", "b"])],
        scss_imports=[("p", "src/a.tsx", "s.module.scss"), ("p", "src/a.tsx", "none.module.scss")],
    )


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return str(tmp_path_factory.mktemp("graph"))


@pytest.fixture(scope="module")
def graph(spark, records, folder):
    g, report = build(spark, records)
    assert all(r["ok"] for r in report), report
    return Graph.load(spark, folder, g.save(folder))


def test_build_is_sound(graph):
    assert graph.violations().collect() == []
    counts = {r.table: r.n for r in api.reindex_summary(graph, "p").collect()}
    assert counts["node GqlOperation"] == 3 and counts["edge WRAPS GqlHook GqlOperation"] == 3  # one symbol, two operations
    assert counts["edge USES_OPERATION File GqlOperation"] == 4 and counts["edge CALLS_HOOK File GqlHook"] == 1
    assert counts["edge CHILD_OF Route Route"] == 1 and counts["edge BELONGS_TO Component Page"] == 1
    assert graph.nodes["GqlOperation"].where("project = 'gone'").count() == 0


def test_permissions_have_two_writers(graph):
    got = {r.key: (r.roles, r.file) for r in graph.nodes["Permission"].collect()}
    assert got == {"perm.read": (["R1", "R2"], "perm.ts"), "perm.none": ([], "perm.ts"), "bare.key": (None, None)}
    assert rows(api.roles_list(graph, "p")) == [("R1", 1), ("R2", 1)]
    assert [r.key for r in api.permissions_list(graph, "p", role="R2").collect()] == ["perm.read"]


def test_route_answers(graph):
    found = {r["index"]: r for r in api.routes_resolve(graph, "p", "/e").collect()}
    assert set(found) == {False, True}  # layout and index share a path
    r = found[False]
    assert (r.components, r.guards, r.permissions) == (["Ent"], ["AuthGuard"], ["perm.read"])
    # Called by the component, and lying under its page: each list is distinct in itself, and both are there.
    assert sorted(h.name for h in r.hooks) == ["useA", "useB"]
    assert sorted(o.gql_name for o in r.ops_direct) == ["B", "B", "FragA", "GetA"]
    assert sorted(o.gql_name for o in r.ops_via_hooks) == ["B", "FragA", "GetA"]
    assert found[True].components == [] and found[True].hooks == []
    # The lists are the same without a table of records.
    by_row = {r["index"]: r for r in api.routes_resolve(graph, "p", "/e", table_bytes=0).collect()}
    assert by_row == found
    assert api.routes_resolve(graph, "q", "/e").count() == 0
    with pytest.raises(api.NotFound):
        api.first(api.routes_resolve(graph, "p", "/none"), "path")
    assert api.first(api.routes_resolve(graph, "p", "/e"), "path", "depth")["depth"] == 0


def _plan(frame):
    """The nodes of the optimised plan, without its scalar subqueries."""
    todo = [frame._jdf.queryExecution().optimizedPlan()]
    for node in todo:
        todo += [node.children().apply(k) for k in range(node.children().size())]
    return todo


def _names(columns):
    return {columns.apply(k).name() for k in range(columns.size())}


@pytest.mark.parametrize("ask", [api.routes_resolve, api.page_get])
def test_lists_under_pages_are_not_joined(graph, ask):
    joins = [_names(n.output()) for n in _plan(ask(graph, "p")) if n.nodeName() == "Join"]
    assert joins and not set().union(*joins) & {"hooks_2", "ops_2", "ops_3", "ops_5"}


def test_no_task_holds_the_sets_of_all_pages(graph):
    sets = [n for n in _plan(api.page_get(graph, "p")) if n.nodeName() == "Aggregate" and n.toString().startswith("Aggregate [anchor#") and "collect_set(" in n.toString().split("\n")[0]]
    long = [n for n in sets if "collect_set(place#" not in n.toString().split("\n")[0]]
    assert long and all(n.groupingExpressions().size() > 1 for n in long)


def test_lists_in_parts_are_the_same(spark):
    rows_ = spark.range(5000).selectExpr("id % 3 as anchor", "if(id % 7 = 0, null, cast(id % 900 as string)) as v").union(spark.sql("select 9L, null"))
    assert rows(gather_parts(rows_, "l", F.col("v"))) == rows(gather(rows_, "l", F.col("v")))


@pytest.mark.parametrize("ask", [api.routes_resolve, api.page_get])
def test_lists_are_texts(graph, ask):
    want = rows(as_text(ask(graph, "p")))
    assert any(r[-1] for r in want) and rows(ask(graph, "p", texts=True)) == want == rows(ask(graph, "p", texts=True, table_bytes=0))
    assert rows(ask(graph, "q", texts=True)) == rows(as_text(ask(graph, "q")))


def test_texts_are_in_their_own_order(spark):
    # A bar stands behind a digit, so that records and their texts are ordered otherwise; two records may have one text.
    ops = batches(spark, projects=[("p", "/p")], operations=[("p", s, n, "query", "o.ts", 1, True) for s, n in (("A", "x"), ("A1", "x"), ("A1", "x|y"), ("A1|x", "y"))], components=[("p", "C", "src/pages/d/C.tsx", 1, True, [], ["A", "A1", "A1|x"])], pages=[("p", "d", None, "src/pages/d", [("C", "src/pages/d/C.tsx")], {}, [])])
    g, _ = build(spark, ops)
    texts = "A1|x,A1|x,A1|x|y,A1|x|y,A1|x|y,A1|x|y,A|x,A|x"
    assert [r.ops_direct for r in api.page_get(g, "p", texts=True).collect()] == [texts] == [r.ops_direct for r in as_text(api.page_get(g, "p")).collect()]


@pytest.mark.parametrize("ask", [api.routes_resolve, api.page_get])
def test_no_row_has_a_copy_of_the_tables(graph, ask):
    names = set().union(*[_names(n.output()) for n in _plan(ask(graph, "p"))])
    assert not any(n.startswith(("all_", "under")) for n in names)


def test_texts_of_ranks(spark, monkeypatch):
    n = 2000  # few values in the first row, many in the others: both ways of putting lists together
    below = {p: sorted({(p * 31 + i * i) % n for i in range(3 if p == 0 else 700)}) for p in range(5)}
    own = [(0, [0], [7, 9]), (1, [1, 2, 4], [0, 1999]), (2, [], []), (3, [3], []), (4, [0, 1, 2, 3, 4], list(range(0, n, 3)))]
    frame = spark.createDataFrame(own, "id long, places array<int>, a array<int>").coalesce(1)
    under = pa.table({"place": pa.array(list(below)), "b": pa.array(list(below.values()), pa.list_(pa.int32()))})
    texts = {"k": pa.table({"code": pa.array(range(n)), "value": [f"v{c:05}" for c in range(n)]})}
    want = [(i, ",".join(f"v{c:05}" for c in sorted([*a, *set().union(*[below[p] for p in places])]))) for i, places, a in own]
    for at_once in (1, 1 << 20):
        monkeypatch.setattr(ranks, "_AT_ONCE", at_once)
        assert rows(ranks.joined_texts(frame, "places", under, {"l": ("k", ("a", "b"))}, texts)) == want


def test_pages_and_domains(graph):
    found = {r.entity: r for r in api.page_get(graph, "p").collect()}
    assert [h.name for h in found[""].hooks] == ["useA"] and found["ent"].routes == ["/e"]
    assert rows(api.domains_list(graph, "p")) == [("dom", 2)]


def test_operations_and_hooks(graph):
    assert [(r.symbol, r.gql_name, r.hooks) for r in api.gql_operations(graph, "p").collect()] == [("A", "FragA", ["useA"]), ("A", "GetA", ["useA"]), ("B", "B", ["useB"])]
    assert api.gql_operations(graph, "p", "query", "geta").count() == 1
    info = api.gql_hook_info(graph, "p", "useA").first()
    assert len(info.operations) == 2 and [(c.path, c.edge_line) for c in info.callers] == [("src/x.tsx", 1)]
    assert [len(r.callsites) for r in api.gql_callsites(graph, "p", "A").collect()] == [2, 2]
    for bad in (0, 5001):
        with pytest.raises(ValueError, match="limit"):
            api.gql_operations(graph, "p", limit=bad)


def test_documents(spark, graph):
    assert [r.matched_headings for r in api.docs_search(graph, "p", "install").collect()] == [["2|Install it"]]
    with pytest.raises(ValueError, match="two"):
        api.docs_search(graph, "p", "x")
    sources = spark.createDataFrame([("docs/readme.md", "inner"), ("README.md", "root"), ("CLAUDE.md", "c")], "path string, text string")
    assert api.doc_get(sources, "readme").first().content == "inner"
    assert api.doc_get(sources, "claude").first().file == "CLAUDE.md"
    assert api.doc_get(sources, "none").count() == 0


def test_end_to_end_tests(graph):
    assert api.e2e_coverage(graph, "p").first().asDict() == {"total": 3, "covered": 2, "uncovered": 1, "stale_e2e_only": 1}
    assert api.e2e_coverage(graph, "p", compat=True).first().stale_e2e_only == 0
    assert rows(api.e2e_uncovered(graph, "p")) == [("miss", False, "src/a.tsx", 2)]
    assert [(r.value, r.has_locator) for r in api.e2e_testid_search(graph, "p", "ro").collect()] == [("row-", False), ("row-1", True)]
    assert {r.has_locator for r in api.e2e_testid_search(graph, "p", "ro", compat=True).collect()} == {True}
    info = api.e2e_testid_info(graph, "p", "row-1").first()
    assert (sorted(s.path for s in info.sources), [x.name for x in info.locators], info.page_objects, [s.name for s in info.specs]) == (["src/b.tsx", "src/c.tsx"], ["button"], ["HomePage"], ["first"])
    assert api.e2e_testid_info(graph, "p", "zzz").count() == 0
    spec = api.e2e_spec(graph, "p", "t.spec.ts", 1).first()
    assert spec.page_objects[0].testids == ["go", "only-e2e", "row-1"]
    assert api.e2e_spec(graph, "p", "t.spec.ts", 9).first().page_objects == []
    assert api.e2e_spec(graph, "p", "t.spec.ts", 9, placeholder=True).first().page_objects[0].name is None


def test_styles_and_adhoc(graph):
    assert rows(api.scss_list(graph, "p", "a"), "file", "consumers") == [("s.module.scss", ["src/a.tsx"])]
    assert api.scss_class(graph, "p", "zz").count() == 0
    assert rows(api.impact(graph, "p", "B"), "component") == [("Ent",)]
    assert rows(api.specs_of_testids(graph, "p"), "value", "spec") == [("go", "first"), ("only-e2e", "first"), ("row-1", "first")]
    assert rows(api.top_hooks(graph, "p")) == [("useB", 1)]


def test_publish_and_rebuild(spark, graph, records, folder):
    count = lambda g: rows(api.reindex_summary(g, "p"))
    first = count(graph)
    rebuild(graph, build(spark, records)[0], "p").save(folder)
    assert count(Graph.load(spark, folder)) == first  # building twice changes nothing
    assert count(graph) == first  # and readers of the old version still see it
    fewer = {**records, "testids": records["testids"].where("value <> 'row-'"), "scss_imports": records["scss_imports"].limit(0)}
    smaller = rebuild(graph, build(spark, fewer)[0], "p")
    assert {r.path for r in smaller.nodes["File"].where("project = 'p'").collect()}.isdisjoint({"src/b.tsx", "src/c.tsx"})
    assert smaller.nodes["GqlOperation"].where("project = 'q'").count() == 1
    graph.views("t_")
    assert spark.sql("SELECT count(*) FROM t_edge_WRAPS__GqlHook__GqlOperation w JOIN t_node_GqlHook h ON h.id = w.src").first()[0] == 3


def test_failed_extractor_leaves_the_others(spark, records):
    broken = {**records, "docs": records["docs"].drop("headings")}
    g, report = build(spark, broken)
    assert [r["name"] for r in report if not r["ok"]] == ["docs"]
    assert g.nodes["Doc"].count() == 0 and g.nodes["E2eSpec"].count() == 2
    assert OWNED["permissions"] == [] and "TestId" in OWNED["e2e"]


def test_mutation(spark):
    df = lambda data: spark.createDataFrame(data, "project string, key string, v long")
    old, new = df([("p", "a", 1), ("p", None, 2)]), df([("p", "a", 9), ("p", "b", 3), ("p", "b", 3), ("p", None, 7)])
    assert rows(mutation.upsert(old, new, ["project", "key"]).where("key is not null")) == [("p", "a", 1), ("p", "b", 3)]
    assert mutation.upsert(old, new, ["project", "key"]).count() == 3
    assert rows(mutation.upsert_set(old, new, ["project", "key"]).where("key is not null")) == [("p", "a", 9), ("p", "b", 3)]
    assert mutation.insert(old, new).count() == 6
    seen = spark.createDataFrame([("p", "a", None, 1), ("p", "a", "second", 2), ("p", "a", "third", 3)], "project string, key string, t string, n long")
    assert rows(mutation.upsert_first(seen, ["project", "key"], ["n"]), "t") == [("second",)]
    nodes = {"A": with_identity("Guard", spark.createDataFrame([("p", "x"), ("q", "y")], "project string, name string")), "B": spark.createDataFrame([("p",)], "project string")}
    edges = {("E", "A", "B"): spark.createDataFrame([("p", 1, 2), ("q", 1, 2)], "project string, src long, dst long"), ("E", "B", "B"): spark.createDataFrame([("p", 1, 2)], "project string, src long, dst long")}
    left, kept = mutation.wipe(nodes, edges, ["A"], "p")
    assert (left["A"].count(), left["B"].count(), kept["E", "A", "B"].count(), kept["E", "B", "B"].count()) == (1, 1, 1, 1)


@pytest.mark.parametrize("how", ["inner", "left_semi", "left_anti"])
def test_prefix_join_equals_the_plain_condition(spark, how):
    values = spark.createDataFrame([("p", x) for x in ("abc", "ab", "b", "", "a/b/c", None, "ab")] + [("q", "abc")], "project string, value string")
    heads = spark.createDataFrame([("p", x) for x in ("a", "ab", "", "abcd", "a/")] + [("q", "b")], "project string, head string")
    condition = (values.project == heads.project) & (F.length("head") > 0) & F.col("value").startswith(F.col("head"))
    plain = values.join(heads, condition, how)
    columns = ["value", "head"] if how == "inner" else ["value"]
    text = lambda d: sorted(map(str, d.select(*columns).collect()))
    assert text(prefix_join(values, heads, "value", "head", ["project"], how)) == text(plain)


def test_configuration_and_records(spark, tmp_path):
    found = projects({"PROJECT_SHOP": "/code/shop/", "ROUTER_FILES_SHOP": "a.tsx, b.tsx", "PROJECT_X": "", "OTHER": "1"})
    assert list(found) == ["shop"] and found["shop"].router_files == ("a.tsx", "b.tsx") and found["shop"].code_root == "/code/shop"
    (tmp_path / "h.json").write_text('{"project": "p", "name": "useA", "operations": ["A"], "extra": 1}\n')
    assert read_batch(spark, str(tmp_path / "h.json"), "hooks").first().operations == ["A"]


def test_stream_keeps_the_latest_record(spark, tmp_path):
    source, target, check = (tmp_path / x for x in ("in", "out", "check"))
    source.mkdir()
    for k, name in enumerate(("GetA", "GetB")):
        (source / f"{k}.json").write_text(f'{{"project": "p", "symbol": "A", "gqlName": "{name}", "line": {k}}}\n')
        ingest(spark, str(source), "operations", ["project", "symbol"], str(target), str(check)).awaitTermination(60)
    assert rows(current(spark, str(target), ["project", "symbol"]), "symbol", "gqlName") == [("A", "GetB")]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.execute(ORACLE_SQL[name]).df()
    got = as_text(QUERIES[name](spark, SF)).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    text = lambda d: sorted(map(tuple, d[order].astype(object).where(d[order].notna(), None).map(str).to_numpy().tolist()))
    assert text(got) == text(want)


def test_golden_coverage(spark):
    got = QUERIES["Q-20_e2e_coverage"](spark, "/root/testdata/sf0.01").first().asDict()
    assert got == {"total": 350, "covered": 100, "uncovered": 250, "stale_e2e_only": 27}
