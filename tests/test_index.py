"""From a source tree on disk to answers: extraction, build and publish in one go."""

import pytest
from pyspark.sql import functions as F

from graphlens import graph
from graphlens.graph import Graph
from graphlens.operators import extract
from graphlens.plans import index
from graphlens.plans.index import read_project, record_batches, reindex
from graphlens.queries import api
from graphlens.sources import records
from graphlens.sources.config import ProjectConfig, compiler_aliases, compiler_files, repo_root
from graphlens.sources.text import rejected_files

TREE = {
    ".git/HEAD": "ref",
    "README.md": "# Mill shop\n## Setup\n",
    "CLAUDE/guide.md": "# Guide\n",
    "CLAUDE/deep/no.md": "# No\n",
    "notes.md": "# No\n",
    "packages/web/tsconfig.json": '{ // paths\n "compilerOptions": { "baseUrl": ".", "paths": { "@pages/*": ["src/pages/*"], "@/*": ["src/*"], }, } }',
    "packages/web/src/gql/queries/orders.ts": "import gql from 'x'\nexport const ORDERS = gql`query Orders { orders { id } }`\nexport const PAY = gql`mutation Pay { pay }`\n",
    "packages/web/src/gql/hooks/useOrders.ts": "import { ORDERS } from '../queries/orders'\nexport function useOrders() {\n  return run(ORDERS)\n}\n",
    "packages/web/src/common/permissions/index.ts": "export const PERMISSIONS = {\n  orders: { read: ['ADMIN', 'CLERK'] },\n} as const\n",
    "packages/web/src/common/modes.ts": "export enum Mode { EDIT = 'edit' }\n",
    "packages/web/src/router/index.tsx": "const Orders = React.lazy(() => import('@pages/shop/orders').then((m) => ({ default: m.OrdersPage })))\nimport { Login } from '@/pages/Login'\nexport const routes = [\n  { path: '/orders', element: <AuthGuard roles={PERMISSIONS.orders.read}><Orders /></AuthGuard>,\n    children: [{ path: `:id/${Mode.EDIT}`, element: <Orders /> }] },\n  { path: 'login', element: <Login /> },\n]\n",
    "packages/web/src/pages/Login.tsx": "export const Login = () => null\n",
    "packages/web/src/pages/shop/orders/index.tsx": "import { useOrders } from '../../../gql/hooks/useOrders'\nimport styles from './o.module.scss'\n\nexport const OrdersPage = () => { const x = useOrders(); return <div data-testid=\"pay-now\">{PAY}</div> }\nimport { PAY } from '@/gql/queries/orders'\n",
    "packages/web/src/pages/shop/orders/Orders.tsx": "export const Orders = 1\n",
    "packages/web/src/pages/shop/orders/o.module.scss": ".row { }\n.cell { }\n",
    "e2e/tests/orders.spec.ts": "import { OrdersPage } from '../pages/orders.page'\ntest('pays', async () => {})\n",
    "e2e/pages/orders.page.ts": "export class OrdersPage {}\n",
    "e2e/locators/orders.locators.ts": "export const pay = `[data-testid='pay-now']`\n",
}


@pytest.fixture(scope="module")
def config(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    for name, text in TREE.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return ProjectConfig("shop", str(root / "packages/web"))


def test_roots_and_aliases(spark, config):
    assert repo_root(spark, config.code_root) == config.code_root.removesuffix("/packages/web")
    assert compiler_aliases(spark, config.code_root) == (("@pages/", "src/pages/"), ("@/", "src/"))
    assert compiler_aliases(spark, config.code_root + "/src") == (("@pages/", "pages/"), ("@/", ""))
    assert compiler_aliases(spark, config.code_root + "/src/gql") == (("@/", "src/"),)


@pytest.fixture(scope="module")
def answer(spark, config, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("graph"))
    return folder, reindex(spark, config, folder)


def test_reindex_answers_questions(spark, answer):
    folder, done = answer
    assert [r["ok"] for r in done["extractors"]] == [True] * 7 and done["source_files"] == 8
    assert done["extractors"][0]["written"]["node_GqlOperation"] == 2
    g = Graph.load(spark, folder)
    assert g.violations().count() == 0
    row = api.first(api.routes_resolve(g, "shop", "/orders"), "path").items()
    row = dict(row)
    assert row["guards"] == ["AuthGuard"] and row["permissions"] == ["orders.read"] and row["components"] == ["Orders"]
    assert "useOrders" in str(row["hooks"])
    assert api.routes_list(g, "shop", "/orders").count() == 2
    component = g.nodes["Component"].where("name = 'Orders'").first()
    assert (component.file, component.line) == ("src/pages/shop/orders/index.tsx", 4)
    assert {r.name for r in api.docs_list(g, "shop").collect()} == {"README", "guide"}
    assert api.roles_list(g, "shop").count() == 2
    assert api.specs_of_testids(g, "shop").count() == 1
    assert [r["file"] for r in api.scss_list(g, "shop").collect()] == ["src/pages/shop/orders/o.module.scss"]


def test_a_record_that_fails_while_it_runs_leaves_the_others(spark, config, answer, monkeypatch):
    folder, _ = answer
    real = extract.docs
    monkeypatch.setattr(extract, "docs", lambda texts: real(texts).withColumn("title", F.raise_error(F.lit("bad document")).cast("string")))
    done = reindex(spark, config, folder)
    assert {r["name"]: r["ok"] for r in done["extractors"]} == {"gql": True, "routes": True, "permissions": True, "pages": True, "docs": False, "e2e": True, "scss": True}
    assert "bad document" in next(r["error"] for r in done["extractors"] if not r["ok"])
    g = Graph.load(spark, folder)
    assert api.docs_list(g, "shop").count() == 2 and api.routes_list(g, "shop").count() == 3 and g.violations().count() == 0


def test_batches_are_planned_without_jobs_of_whole_trees(spark, config):
    batches = record_batches(read_project(spark, config))
    assert batches["permissions"].count() == 1 and batches["callsites"].where("target = 'PAY'").count() == 2


def test_answers_and_errors(spark, answer):
    g = Graph.load(spark, answer[0])
    assert api.listed(api.docs_list(g, "shop"), "docs")["count"] == 2
    with pytest.raises(api.NotFound) as missing:
        api.first(api.routes_resolve(g, "shop", "/nowhere"), "path")
    assert api.envelope(missing.value, kind="route")["error"] == {"code": "NOT_FOUND", "message": "no such entry", "kind": "route"}
    assert api.envelope(ValueError("limit"))["error"]["code"] == "VALIDATION_ERROR" and api.envelope(KeyError("x"))["error"]["code"] == "INTERNAL"


def test_what_fails_fails_alone(spark, config, answer, tmp_path, monkeypatch):
    """A table that cannot be made, a folder that cannot be read and a ring of routes end one extractor each."""
    real_nodes, real_texts = extract.route_nodes, index.read_texts

    def ring(*args):
        nodes = real_nodes(*args)
        return nodes.withColumn("parent", F.when(F.col("segment").contains("login"), F.col("node")).otherwise(F.col("parent")))

    def unreadable(spark, root, pattern="*", *args):
        if pattern == "*.md":
            raise OSError("permission denied")
        return real_texts(spark, root, pattern, *args)

    monkeypatch.setattr(extract, "route_nodes", ring)
    monkeypatch.setattr(index, "read_texts", unreadable)
    monkeypatch.setattr(extract, "style_modules", lambda texts: (_ for _ in ()).throw(ValueError("no styles")))
    done = reindex(spark, config, str(tmp_path / "graph"))
    errors = {r["name"]: r["error"] for r in done["extractors"]}
    assert {k for k, e in errors.items() if e is None} == {"gql", "permissions", "pages", "e2e"}
    assert "ring" in errors["routes"] and "permission denied" in errors["docs"] and "no styles" in errors["scss"]
    assert Graph.load(spark, str(tmp_path / "graph")).violations().count() == 0


def test_all_projects_in_a_call_and_only_their_own_tables(spark, config, tmp_path):
    folder = str(tmp_path / "graph")
    with pytest.raises(LookupError, match="not configured"):
        index.reindex_all(spark, folder, {}, "nobody")
    environment = {"PROJECT_SHOP": config.code_root, "PROJECT_TWIN": config.code_root, "PROJECT_GONE": "/no/such/folder"}
    answers = {a["project"]["name"]: a for a in index.reindex_all(spark, folder, environment)}
    assert "no such code root" in answers["gone"]["error"] and answers["shop"]["source_files"] == answers["twin"]["source_files"] == 8
    before = {(e["name"], e["project"]): e["folder"] for e in graph._published(spark, folder)["entries"]}
    index.reindex_all(spark, folder, environment, "twin")
    after = {(e["name"], e["project"]): e["folder"] for e in graph._published(spark, folder)["entries"]}
    assert before.keys() == after.keys() and {p for (_, p), x in after.items() if before[_, p] != x} == {"twin"}
    g = Graph.load(spark, folder)
    assert g.nodes["Route"].where("project = 'shop'").count() == g.nodes["Route"].where("project = 'twin'").count() == 3
    assert Graph.load(spark, folder, answers["shop"]["version"]).nodes["Project"].count() == 1


def test_a_graph_that_is_not_sound_is_not_published(spark, answer, tmp_path):
    folder, _ = answer
    g = Graph.load(spark, folder)
    g.nodes["Doc"] = g.nodes["Doc"].unionByName(g.nodes["Doc"])
    with pytest.raises(ValueError, match="repeated id"):
        g.save(str(tmp_path / "bad"))
    assert not (tmp_path / "bad" / "published").exists()


def test_what_is_no_record_is_told(spark, tmp_path):
    (tmp_path / "docs.json").write_text('{"project": "p", "name": "a", "size": 3}\n{"project": "p", "name": \n{"project": "p", "name": "b", "size": "many"}\n')
    assert [r.name for r in records.read_batch(spark, str(tmp_path), "docs").collect()] == ["a"]
    assert sorted(r.reason for r in records.rejected_records(spark, str(tmp_path), "docs").collect()) == ["a field of another type", "no JSON"]
    texts = spark.createDataFrame([("p", "a.ts", "fine"), ("p", "b.ts", "bad �")], "project string, path string, text string")
    files = spark.createDataFrame([("p", "a.ts"), ("p", "b.ts"), ("p", "c.ts")], "project string, path string")
    assert sorted(tuple(r)[1:] for r in rejected_files(texts, files).collect()) == [("b.ts", "not UTF-8"), ("c.ts", "not readable")]


def test_files_are_those_that_the_compiler_lists(spark, tmp_path):
    tree = {
        "tsconfig.base.json": '{"compilerOptions": {"paths": {"~/*": ["./web/src/*"]}, "outDir": "web/dist"}, "exclude": ["web/src/old"]}',
        "web/tsconfig.json": '{"extends": "../tsconfig.base", "include": ["src", "extra/*.ts"], "exclude": ["src/old", "**/*.gen.ts"], "files": ["lone/gql/queries/l.ts"]}',
        "web/src/gql/queries/a.ts": "import '../../old/gql/queries/used'\nexport const A = gql`query A { a }`",
        "web/src/gql/queries/b.gen.ts": "export const B = gql`query B { a }`",
        "web/src/old/gql/queries/used.ts": "export * from './further'\nexport const USED = gql`query Used { a }`",
        "web/src/old/gql/queries/further.ts": "export const FURTHER = gql`query Further { a }`",
        "web/src/old/gql/queries/gone.ts": "export const GONE = gql`query Gone { a }`",
        "web/extra/gql/queries/deep.ts": "export const DEEP = gql`query Deep { a }`",
        "web/lone/gql/queries/l.ts": "export const LONE = gql`query Lone { a }`",
        "web/else/gql/queries/e.ts": "export const ELSE = gql`query Else { a }`",
    }
    for name, text in tree.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    root = str(tmp_path / "web")
    assert compiler_aliases(spark, root) == (("~/", "src/"),)
    batches = record_batches(read_project(spark, ProjectConfig("x", root)), listed=compiler_files(spark, root))
    assert sorted(r.symbol for r in batches["operations"].collect()) == ["A", "FURTHER", "LONE", "USED"]
    paths = spark.createDataFrame([("src/a.ts",), ("src/deep/b.tsx",), ("extra/x.ts",), ("extra/y/x.ts",), ("lone/gql/queries/l.ts",), ("src/old/x.ts",), ("src/x.gen.ts",), ("srcs/x.ts",)], "path string")
    assert [r.path for r in paths.where(compiler_files(spark, root)).collect()] == ["src/a.ts", "src/deep/b.tsx", "extra/x.ts", "lone/gql/queries/l.ts"]
    (tmp_path / "web/tsconfig.json").write_text('{"compilerOptions": {"strict": true}}')
    assert compiler_files(spark, root) is None
