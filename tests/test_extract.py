"""Extraction from texts, one case per rule."""

from pyspark.sql import functions as F

from graphlens.functions.matches import matches_with_lines, unix_lines
from graphlens.functions.paths import directory_prefixes, join_route, resolve, stem
from graphlens.operators import extract, literals
from graphlens.sources.text import count_sources, list_files, read_texts


def texts(spark, *files):
    return spark.createDataFrame([("p", path, text) for path, text in files], "project string, path string, text string")


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_lines_of_matches(spark):
    df = spark.createDataFrame([("a é\r\nfoo(\n1) x\nfoo(2) foo(3)",), ("",), (None,)], "t string").withColumn("t", unix_lines(F.col("t")))
    got = [r.m for r in df.select(matches_with_lines(F.col("t"), r"(foo)\(\s*(\d)\)", 2).alias("m")).collect()]
    assert [(m.line, m.g2) for m in got[0]] == [(2, "1"), (4, "2"), (4, "3")]
    assert got[1] == []


def test_docs(spark):
    df = extract.docs(texts(spark, ("CLAUDE/a.md", "# Titel é  \ntext\n#### no\n## Two\n### Three \n"), ("b.md", "## First\n# Second"), ("c.md", "plain")))
    got = {r.name: (r.title, [(h.level, h.text) for h in r.headings], r["size"]) for r in df.collect()}
    assert got["a"][:2] == ("Titel é", [(1, "Titel é"), (2, "Two"), (3, "Three")])
    assert got["b"][:2] == (None, [(2, "First"), (1, "Second")])
    assert got["c"] == (None, [], 5)


def test_styles(spark):
    modules = extract.style_modules(texts(spark, ("src/a/x.module.scss", ".b{ }\n  .a-1 { .mid }\nx .c{}"), ("src/y.module.scss", "")))
    assert rows(modules, "file", "classes") == [("src/a/x.module.scss", ["a-1", "b"]), ("src/y.module.scss", [])]
    code = texts(spark, ("src/a/c.tsx", "import s from './x.module.scss'\nimport t from '../../../z.module.scss'"), ("src/b/d.ts", 'import q from "../y.module.scss"\nimport n from "./none.module.scss"'))
    assert rows(extract.style_imports(code, modules), "consumer", "module_file") == [("src/a/c.tsx", "src/a/x.module.scss"), ("src/b/d.ts", "src/y.module.scss")]


def test_specs(spark):
    text = "import { type APage, BPage as B, lower } from '../pages/a.page'\nimport {C} from './pages/c.page'\n  test.describe('группа', () => {\n test(\n  `one`, f)\n})\nmytest('no')\ntest.only(\"two\")"
    got = extract.specs(texts(spark, ("e2e/tests/x.spec.ts", text)))
    assert rows(got, "kind", "name", "line") == [("test", "one", 4), ("test.describe", "группа", 3), ("test.only", "two", 8)]
    assert got.first().poms == ["APage", "BPage"]
    poms = extract.page_objects(texts(spark, ("e2e/pages/a.page.ts", "export class APage {}\nclass BPage {}\nexport class Other {}")))
    assert rows(poms, "name") == [("APage",)]


def test_locators(spark):
    text = "export const a = '[data-testid=\"one\"]'\nexport const b: string = `[data-testid=\"x-${i}\"] form input`\nexport const c = (id: string) => `[data-testid='two'] [data-testid=\"three\"]`\n"
    got = extract.locators(texts(spark, ("e2e/pages/home.locators.ts", text)))
    assert rows(got, "name", "module", "line", "parametric", "testids") == [("a", "home", 1, False, ["one"]), ("b", "home", 2, False, []), ("c", "home", 3, True, ["three", "two"])]
    assert got.where("name = 'a'").first().value == "[data-testid="


def test_app_testids(spark):
    tsx = "<a data-testid=\"one\"/> <b data-testid=\"one\"/>\n<c data-testid={'two'}/>\n<d data-testid={`row-${i}`}/> <e data-testid={`${i}-x`}/> testid='three'"
    got = extract.app_testids(texts(spark, ("src/a.tsx", tsx), ("src/b.ts", "testid='no' data-testid='four'")))
    assert rows(got, "file", "value", "line", "pattern", "template") == [
        ("src/a.tsx", "one", 1, False, "one"),
        ("src/a.tsx", "row-", 3, True, "row-${i}"),
        ("src/a.tsx", "three", 3, False, "three"),
        ("src/a.tsx", "two", 2, False, "two"),
        ("src/b.ts", "four", 1, False, "four"),
    ]


OPS = """export const A = gql`
  query GetA($x: Int) { a(x: $x) { b { c } } }
  fragment F on T { id }
`
const B = gql`mutation { save }`
export const C = gql`query Broken { a `
export const D: X = gql`${F} subscription S { s }`
"""


def test_operations(spark):
    got = extract.operations(texts(spark, ("src/gql/queries/a.ts", OPS), ("src/gql/queries/b.ts", "export const A = gql`query Again { a }`"), ("src/other.ts", OPS)))
    assert rows(got, "symbol", "gqlName", "kind", "exported", "line") == [
        ("A", "F", "fragment", True, 1),
        ("A", "GetA", "query", True, 1),
        ("B", "B", "mutation", False, 5),
        ("C", "C", "fragment", True, 6),
        ("D", "S", "subscription", True, 7),
    ]


def test_hooks_and_callsites(spark):
    hook = "import { A, B } from '../queries/a'\nexport function useOne() {\n  return q(B, A, A)\n}\nexport const useTwo = () => q(A)\nconst useHidden = () => A\nexport function user() {}"
    files = texts(spark, ("src/gql/queries/a.ts", OPS), ("src/gql/hooks/h.ts", hook), ("src/x.tsx", "import { useOne } from './gql/hooks/h'\nconst d = useOne(A)"))
    ops = extract.operations(files)
    found = literals.tokens(files).persist()
    hooks = extract.hooks(found, ops)
    assert rows(hooks, "name", "line", "operations") == [("useOne", 2, ["A", "B"]), ("useTwo", 5, ["A"])]
    sites = extract.callsites(found, files, ops, hooks)
    assert ("useOne", "hook", "src/x.tsx", 2, 11) in rows(sites, "target", "targetKind", "file", "line", "column")
    assert not [r for r in sites.collect() if r.target == "A" and r.file == "src/gql/queries/a.ts" and r.line == 1]


def test_route_paths(spark):
    cases = [(None, None, False, "/"), (None, "a", False, "/a"), (None, "/a", True, "/a"), ("/p", None, False, "/p"), ("/p", "x", True, "/p"), ("/p", "/abs", False, "/abs"), ("/p/", "x", False, "/p/x"), ("", "q", False, "/q")]
    df = spark.createDataFrame([c[:3] for c in cases], "parent string, segment string, index boolean")
    assert [r[0] for r in df.select(join_route(F.col("parent"), F.col("segment"), F.col("index"))).collect()] == [c[3] for c in cases]
    nodes = spark.createDataFrame([(1, None, "app", False), (2, 1, None, True), (3, 1, "users", False), (4, 3, ":id", False), (5, 3, "/login", False)], "node long, parent long, segment string, index boolean")
    assert rows(extract.route_tree(nodes), "node", "path", "depth") == [(1, "/app", 0), (2, "/app", 1), (3, "/app/users", 1), (4, "/app/users/:id", 2), (5, "/login", 2)]


def test_route_elements(spark):
    jsx = "<AuthGuard><RoleBasedGuard roles={PERMISSIONS.a.b}><LazyForm><Page/><Page/><Outlet/></LazyForm></RoleBasedGuard><AuthGuard roles={Other.x}/></AuthGuard>"
    found = literals.tokens(texts(spark, ("r.tsx", jsx))).persist()
    r = extract.element_parts(found, spark.createDataFrame([("p", "r.tsx", 0, 0, 1000)], "project string, path string, object int, from_n int, to_n int")).first().e
    assert (r.components, r.guards, r.permissions) == (["Page", "Page"], ["AuthGuard", "RoleBasedGuard"], ["a.b", "Other.x"])
    raw = spark.createDataFrame([("':id'",), ("`:id/${Mode.EDIT}`",), ("Mode.NEW",), ("Mode.GONE",), (None,)], "s string")
    members = F.create_map(F.lit("Mode.EDIT"), F.lit("edit"), F.lit("Mode.NEW"), F.lit("create"))
    assert [x[0] for x in raw.select(extract.segment_value(F.col("s"), members)).collect()] == [":id", ":id/edit", "create", "gone", None]


def test_components(spark):
    router = "import Home, { About as Us, type T } from './Home'\nconst Lazy1 = lazy(() => import('../pages/one').then(m => ({ default: m.OnePage })))\nconst Gone = lazy(() => import('./gone'))"
    imports = extract.component_imports(literals.tokens(texts(spark, ("src/router/index.tsx", router))))
    assert rows(imports, "name", "spec") == [("Gone", "./gone"), ("Home", "./Home"), ("Lazy1", "../pages/one"), ("T", "./Home"), ("Us", "./Home")]
    files = texts(spark, ("src/router/Home.tsx", "const x = useOne(A)"), ("src/pages/one/index.tsx", "nothing"))
    found = extract.resolved_components(imports, files)
    assert rows(found.where("name in ('Home', 'Lazy1', 'Gone')"), "name", "file") == [("Home", "src/router/Home.tsx"), ("Lazy1", "src/pages/one/index.tsx")]
    known = spark.createDataFrame([("p", "useOne"), ("p", "useNo")], "project string, token string")
    assert ("Home", ["useOne"]) in rows(extract.named_in(found, literals.tokens(files), known, "hookCalls"), "name", "hookCalls")


def test_permissions(spark):
    json = '{"a": {"b": {"read": ["R1", "R2", 3], "n": 5}, "write": ["R1"]}, "c": "x", "d": []}'
    got = extract.permission_keys(spark.createDataFrame([("p", json)], "project string, json string"))
    assert rows(got, "key", "roles") == [("a.b.read", ["R1", "R2"]), ("a.write", ["R1"]), ("d", [])]


def test_pages(spark):
    paths = ["src/pages/Root.tsx", "src/pages/low.tsx", "src/pages/dom/types.ts", "src/pages/dom/Flat.tsx", "src/pages/dom/ent/Ent.tsx", "src/pages/dom/ent/sub/Deep.tsx", "src/pages/dom/hooks/H.tsx", "src/pages/dom/.hid/X.tsx", "src/pages/__tests__/T.tsx", "src/pages/empty/none/a.txt", "src/pages/dom/ent/Éa.jsx"]
    got = extract.pages(spark.createDataFrame([("p", x) for x in paths], "project string, path string"))
    assert sorted((r.domain, r.entity or "", r.dir, [c.name for c in r.components], dict(r.by_role), r.subdirs) for r in got.collect()) == [
        ("_root", "Root", "src/pages", ["Root"], {}, []),
        ("dom", "", "src/pages/dom", ["Flat"], {"types": "src/pages/dom/types.ts"}, ["ent", "hooks"]),
        ("dom", "ent", "src/pages/dom/ent", ["Ent", "Éa"], {}, ["sub"]),
    ]


def test_paths(spark):
    df = spark.createDataFrame([("a/b", "../c/./d"), ("a", "../../x"), ("", "y")], "base string, rel string")
    assert [r[0] for r in df.select(resolve(F.col("base"), F.col("rel"))).collect()] == ["a/c/d", None, "y"]
    assert spark.range(1).select(stem(F.lit("x/y.locators.ts"), ".locators"), directory_prefixes(F.lit("a/b/c"))).first() == ("y", ["a/", "a/b/"])


def test_source_tree(spark, tmp_path):
    for name, data in {"src/a.tsx": b"one\r\ntwo", "src/node_modules/b.tsx": b"no", "src/deep/c.ts": b"\xff bad", "src/d.scss": b""}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    assert rows(read_texts(spark, str(tmp_path), "*.tsx", "p"), "project", "path", "text") == [("p", "src/a.tsx", "one\ntwo")]
    assert read_texts(spark, str(tmp_path), "*.ts").first().text.endswith("bad")
    files = list_files(spark, str(tmp_path))
    assert files.count() == 3 and count_sources(files).first()[0] == 3  # the empty file is not listed


def test_permission_keys_are_never_cut_by_depth(spark):
    nested = lambda n: spark.createDataFrame([("p", '{"a":' * n + '["R"]' + "}" * n)], "project string, json string")
    for depth in (1, 3, 150):
        assert [tuple(r) for r in extract.permission_keys(nested(depth)).collect()] == [("p", ".".join("a" * depth), ["R"])]
    odd = spark.createDataFrame([("p", r'{"a.b": {"q\"x": ["R\"1", "é", null, 5, ["no"]], "n": null}}')], "project string, json string")
    assert [tuple(r) for r in extract.permission_keys(odd).collect()] == [("p", 'a.b.q"x', ['R"1', "é"])]


ROUTER = """import { Lazy } from 'react'
import { About } from '@pages/about'
enum Mode { NEW = 'new', EDIT = "edit" }
const other = [{ path: 'no' }]
const Home = lazy(() => import('./Home').then((m) => ({ default: m.HomePage })))
export const routes: RouteObject[] = [ // [{
  {
    path: '/',
    element: (
      <AuthGuard roles={PERMISSIONS.app.read}>
        <Suspense fallback={<Loader size={1} />}><Home a={{ path: 'x' }} /></Suspense>
      </AuthGuard>
    ),
    handle: { path: 'inner' },
    children: [
      { index: true, element: <About /> },
      { path: Mode.NEW, element: cond ? <A /> : <B />, children: [{ path: `:id/${Mode.EDIT}`, index: false }] },
      { path: "don't", list: [{ path: 'stray' }] },
      ...more,
    ],
  },
  { path: 'plain', element: <><RoleBasedGuard roles={Other.x} /><About /></> },
]
const routesOf = [{ path: 'never' }]
"""


def test_routes_from_text(spark):
    files = texts(spark, ("src/router/index.tsx", ROUTER), ("src/other.tsx", "const x = 1"))
    got = extract.routes(extract.route_nodes(files, extract.enum_members(files)).persist())
    want = ["path", "index", "depth", "parentPath", "line", "components", "guards", "permissions"]
    assert sorted((tuple(r[c] for c in want) for r in got.collect()), key=str) == sorted(
        [
            ("/", False, 0, None, 7, ["Home"], ["AuthGuard"], ["app.read"]),
            ("/", True, 1, "/", 16, ["About"], [], []),
            ("/new", False, 1, "/", 17, [], [], []),
            ("/new/:id/edit", False, 2, "/new", 17, [], [], []),
            ("/don't", False, 1, "/", 18, [], [], []),
            ("/plain", False, 0, None, 22, ["About"], ["RoleBasedGuard"], ["Other.x"]),
        ],
        key=str,
    )


def test_components_from_router(spark):
    files = texts(spark, ("src/router/index.tsx", ROUTER), ("src/router/Home.tsx", "import x\n\nexport function HomePage() {}\n"), ("src/pages/about/index.tsx", "export const About = 1"))
    found = extract.resolved_components(extract.component_imports(literals.tokens(files.where("path like '%router/index%'"))), files, (("@pages/", "src/pages/"),))
    assert rows(extract.component_lines(found, literals.tokens(files)), "name", "file", "line") == [("About", "src/pages/about/index.tsx", 1), ("Home", "src/router/Home.tsx", 3)]


def test_permissions_from_text(spark):
    first = "const X = {}\nexport const PERMISSIONS: Deep<string[]> = {\n  // note: { [\n  app: {\n    read: ['ADMIN', \"USER\", role, `no`] as Role[],\n    deep: { write: [] } as Page,\n    n: 5, f() {}, 'q-k': ['A'],\n  },\n} as const\n"
    files = texts(spark, ("src/common/permissions/b.ts", "export const PERMISSIONS = { late: ['X'] }"), ("src/common/permissions/a.ts", first), ("src/common/permissions/0.ts", "const PERMISSIONS = make()"), ("src/else.ts", first))
    parts = extract.permission_entries(files).persist()
    got = extract.permissions(parts)
    assert rows(got, "key", "roles", "file", "line") == [("app.'q-k'", ["A"], "src/common/permissions/a.ts", 7), ("app.deep.write", [], "src/common/permissions/a.ts", 6), ("app.read", ["ADMIN", "USER"], "src/common/permissions/a.ts", 5)]
    deep = "export const PERMISSIONS = " + "{ a: " * 70 + "['R']" + " }" * 70
    parts = extract.permission_entries(texts(spark, ("common/permissions/a.ts", deep))).persist()
    assert rows(extract.permissions(parts), "key", "roles") == [(".".join("a" * 70), ["R"])]


def test_documents_nested_deeper_than_any_cap(spark):
    body = "query Deep { a" + " { b" * 100 + " }" * 100 + " } fragment F on T { x }"
    got = extract.operations(texts(spark, ("src/gql/queries/a.ts", f"export const D = gql`{body}`"), ("src/gql/queries/b.ts", "const E = gql`query { a } }`")))
    assert rows(got, "symbol", "gqlName", "kind") == [("D", "Deep", "query"), ("D", "F", "fragment"), ("E", "E", "fragment")]
