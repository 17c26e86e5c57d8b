"""A source tree written from the star-schema tables, and what extraction and a build make of it, with the SQL for it.

Every part is an operation's file, every supplier a hook, a component, a route and a test, every customer a view that
calls some of them; nations are routers, page folders and page objects, and pass hooks on from file to file. Some literals
have ten thousand characters. Other modules declare the same names again, and functions hide them: what they name is no
call site. The SQL works on the tables alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.functions.columns import as_text
from graphlens.plans.build import build
from graphlens.plans.index import Sources, record_batches, writer
from graphlens.queries import api
from graphlens.queries.fixture import table
from graphlens.sources.config import shared_folder

PROJECT = "tx"
WEB = "packages/web/"


def _t(pattern: str, **columns: str | Column) -> Column:
    """A text with columns in the places {{name}}."""
    out = F.lit(pattern)
    for name, column in columns.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), (F.col(column) if isinstance(column, str) else column).cast("string"))
    return out


def _long(k: Column, part: str) -> Column:
    """Ten thousand characters of repeated parts for one key in fifty."""
    return F.when(k % 50 == 0, F.lit(part * (10_000 // len(part)))).otherwise("")


def sources(spark: SparkSession, sf_dir: str) -> Sources:
    t = lambda name: table(spark, sf_dir, name)
    # Keys are dealt before their texts are made: a table of a few megabytes is a few tasks', its texts are a hundred times as long.
    part, customer = t("part").select(F.col("p_partkey").alias("k")).repartition("k"), t("customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n")).repartition("k")
    supplier = t("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n")).repartition("k")
    nation = t("nation").select(F.col("n_nationkey").alias("n"), F.col("n_regionkey").alias("r"))
    file = lambda rows, path, text: rows.select(F.lit(PROJECT).alias("project"), path.alias("path"), text.alias("text"))
    lines = lambda *parts: F.array_join(F.flatten(F.array(*[p if isinstance(p, Column) else F.array(F.lit(p)) for p in parts])), "\n")
    here = lambda pattern: F.array(_t(pattern, n="n"))
    lists = {
        "eager": "import { P{{k}} as S{{k}} } from '@/pages/n{{n}}/S{{k}}'",
        "lazy": "const S{{k}} = lazy(() => import('@/pages/n{{n}}/S{{k}}').then((m) => ({ default: m.P{{k}} })))",
        "routes": "  { {{step}}, element: <RoleBasedGuard roles={PERMISSIONS.n{{n}}.s{{k}}} icon={<Icon of={[<Deep />]} />}><S{{k}} />don't<S{{k}} /></RoleBasedGuard> },",
        "tests": "test('s{{k}}', async () => {})",
        "locators": "export const s{{k}} = \"[data-testid='t-{{k}}']{{long}}\"",
    }
    plain = supplier.groupBy("n").agg(F.array_sort(F.collect_list("k")).alias("ks"))
    # Every second component is imported, the others are lazy; every third route is an index, the others' segments name an enum.
    step = lambda k: F.when(k % 3 == 0, F.lit("index: true")).otherwise(F.lit("path: `s{{k}}-${Mode{{n}}.A}`"))
    pattern = lambda name, k: F.when(k % 2 == 0, F.lit(lists["lazy"])).otherwise(F.lit(lists["eager"])) if name == "lazy" else F.lit(lists[name])
    filled = lambda name, k: F.replace(F.replace(pattern(name, k), F.lit("{{step}}"), step(k)), F.lit("{{k}}"), k.cast("string"))
    each = lambda name: F.transform("ks", lambda k: F.replace(F.replace(filled(name, k), F.lit("{{n}}"), F.col("n").cast("string")), F.lit("{{long}}"), _long(k, " .step")))
    root = "{ path: '/n{{n}}', element: <AuthGuard roles={PERMISSIONS.n{{n}}.read}><Home /></AuthGuard>, children: ["
    code = [
        file(part, _t("src/gql/queries/p{{k}}.ts", k="k"), _t("export const OP_{{k}} = gql`query Get{{k}} { a { b } ${Frag}{{long}} }`\nconst IN_{{k}} = gql`mutation { pay }`", k="k", long=_long(F.col("k"), " more { field }"))),
        file(supplier, _t("src/gql/hooks/h{{k}}.ts", k="k"), _t("import { OP_{{k}} } from '../queries/p{{k}}'\nexport function useH{{k}}() {\n  return run(OP_{{k}}, OP_{{n}}, MISSING)\n}\nimport { OP_{{n}} } from '../queries/p{{n}}'\nconst hide = (OP_{{k}}) => run(OP_{{k}})\n// OP_{{k}} 'OP_{{k}}'\n", k="k", n="n")),
        file(nation, _t("src/views/gql{{n}}.ts", n="n"), _t("export * from './all{{n}}'", n="n")),
        file(nation, _t("src/views/all{{n}}.ts", n="n"), _t("export { useH{{n}} } from '../gql/hooks/h{{n}}'", n="n")),
        file(nation, _t("src/common/mode{{n}}.ts", n="n"), _t("export enum Mode{{n}} { B = 'no', A = \"m{{n}}\" }", n="n")),
        file(nation, _t("src/other/o{{n}}.ts", n="n"), _t("export const useH{{n}} = 1\nexport const OP_{{n}} = 'useH{{n}}'", n="n")),
        file(nation, _t("src/other/u{{n}}.ts", n="n"), _t("import { useH{{n}}, OP_{{n}} } from './o{{n}}'\nuseH{{n}}(OP_{{n}})\nmade.OP_{{n}}({ useH{{n}}: `useH{{n}}` })", n="n")),
        file(customer, _t("src/views/c{{k}}.tsx", k="k"), _t("import s from './m{{k}}.module.scss'\nconst x = useH{{n}}(OP_{{k}})\nconst a = <i data-testid=\"t-{{k}}\" />\nconst b = <b data-testid={`row-{{k}}-${i}`} />\nimport { useH{{n}} } from './gql{{n}}'\nimport { OP_{{k}} } from '@/gql/queries/p{{k}}'", k="k", n="n")),
        file(supplier, _t("src/pages/n{{n}}/S{{k}}.tsx", k="k", n="n"), _t("\n\nexport const P{{k}} = () => useH{{k}}(Q.OP_{{k}})\nimport { useH{{k}} } from '@/gql/hooks/h{{k}}'\nimport * as Q from '@/gql/queries/p{{k}}'", k="k")),
        file(plain, _t("src/router/n{{n}}.tsx", n="n"), lines(each("lazy"), "export const routes = [", here(root), each("routes"), "] },", "]")),
    ]
    granted = nation.groupBy(F.lit(0).alias("g")).agg(F.array_sort(F.collect_list(F.struct("n", "r"))).alias("ns"))
    keys = F.transform("ns", lambda x: F.concat(F.lit("  n"), x["n"].cast("string"), F.lit(": { read: ['R"), x["r"].cast("string"), F.lit("', \"ALL\"] as Role[] },")))
    code.append(file(granted, F.lit("src/common/permissions/index.ts"), lines("export const PERMISSIONS = {", keys, "} as const")))
    for more in code[1:]:
        code[0] = code[0].unionByName(more)
    tests = file(plain, _t("e2e/tests/n{{n}}.spec.ts", n="n"), lines(here("import { N{{n}}Page, type low, XPage as Y } from '../pages/n{{n}}.page'"), each("tests")))
    tests = tests.unionByName(file(plain, _t("e2e/pages/n{{n}}.page.ts", n="n"), _t("export class N{{n}}Page {}\nexport class Other {}", n="n")))
    tests = tests.unionByName(file(plain, _t("e2e/pages/n{{n}}.locators.ts", n="n"), lines(each("locators"))))
    return Sources(
        projects=spark.createDataFrame([(PROJECT, "/" + WEB)], "name string, root string"),
        code=code[0],
        styles=file(supplier, _t("src/views/m{{k}}.module.scss", k="k"), _t(".b{{k}} { }\n  .a{{k}}:hover { .mid }\nx .c {}\n.b{{k}}", k="k")),
        files=code[0].select("project", "path"),
        app=code[0].withColumn("path", F.concat(F.lit(WEB), "path")),
        tests=tests,
        docs=file(t("region"), _t("CLAUDE/r{{k}}.md", k="r_regionkey"), _t("# Region {{k}}\ntext\n## Part", k="r_name")),
    )


def batches(spark: SparkSession, sf_dir: str, folder: str) -> dict[str, DataFrame]:
    """The record batches of the tree; what one is made from is written below the folder before."""
    routers = tuple(f"src/router/n{n}.tsx" for n in range(25))
    return record_batches(sources(spark, sf_dir), routers, keep=writer(spark, folder))


def _batch(name: str):
    return lambda spark, sf_dir: as_text(batches(spark, sf_dir, shared_folder(spark))[name].drop("project"))


def q26_reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of all node and edge tables of the graph that is built from the source tree, each extractor in its own jobs."""
    folder = shared_folder(spark)
    graph, report = build(spark, batches(spark, sf_dir, f"{folder}/batches"), folder)
    failed = [r for r in report if not r["ok"]]
    if failed:
        raise RuntimeError(str(failed))
    return api.reindex_summary(graph, PROJECT)


QUERIES = {
    "X-01_operations": _batch("operations"),
    "X-05_hooks": _batch("hooks"),
    "X-06_callsites": _batch("callsites"),
    "X-12_routes_from_text": _batch("routes"),
    "X-15_components": _batch("components"),
    "S-05_permissions_from_text": _batch("permissions"),
    "X-21_specs": _batch("specs"),
    "X-23_page_objects": _batch("page_objects"),
    "X-25_locators": _batch("locators"),
    "X-26_app_testids": _batch("testids"),
    "X-28_class_selectors": _batch("scss"),
    "X-29_style_imports": _batch("scss_imports"),
    "Q-26_reindex": q26_reindex,
}

_S = "s AS (SELECT s_suppkey AS k, s_nationkey AS n FROM supplier)"
_SITES = f"""{_S}, p AS (SELECT p_partkey AS k FROM part), c AS (SELECT c_custkey AS k, c_nationkey AS n FROM customer),
raw AS (SELECT 'operation' AS kind, k AS of, 'src/gql/hooks/h' || k || '.ts' AS file, 1 AS line, 10 AS col FROM s
UNION ALL SELECT 'operation', k, 'src/gql/hooks/h' || k || '.ts', 3, 14 FROM s
UNION ALL SELECT 'operation', n, 'src/gql/hooks/h' || k || '.ts', 3, 19 + length(CAST(k AS VARCHAR)) FROM s
UNION ALL SELECT 'operation', n, 'src/gql/hooks/h' || k || '.ts', 5, 10 FROM s
UNION ALL SELECT 'hook', n_nationkey, 'src/views/all' || n_nationkey || '.ts', 1, 10 FROM nation
UNION ALL SELECT 'hook', n, 'src/views/c' || k || '.tsx', 2, 11 FROM c
UNION ALL SELECT 'hook', n, 'src/views/c' || k || '.tsx', 5, 10 FROM c
UNION ALL SELECT 'operation', k, 'src/views/c' || k || '.tsx', 2, 16 + length(CAST(n AS VARCHAR)) FROM c
UNION ALL SELECT 'operation', k, 'src/views/c' || k || '.tsx', 6, 10 FROM c
UNION ALL SELECT 'hook', k, 'src/pages/n' || n || '/S' || k || '.tsx', 3, 24 + length(CAST(k AS VARCHAR)) FROM s
UNION ALL SELECT 'hook', k, 'src/pages/n' || n || '/S' || k || '.tsx', 4, 10 FROM s
UNION ALL SELECT 'operation', k, 'src/pages/n' || n || '/S' || k || '.tsx', 3, 31 + 2 * length(CAST(k AS VARCHAR)) FROM s),
sites AS (SELECT kind, of, file, CAST(line AS BIGINT) AS line, CAST(col AS BIGINT) AS col FROM raw WHERE kind = 'hook' AND of IN (SELECT k FROM s) OR kind = 'operation' AND of IN (SELECT k FROM p))"""
_IN_NATION = f"{_S}, o AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY k) AS i, count(*) OVER (PARTITION BY n) AS m FROM s)"

ORACLE_SQL = {
    "X-01_operations": """SELECT 'OP_' || p_partkey AS symbol, 'Get' || p_partkey AS "gqlName", 'query' AS kind, 'src/gql/queries/p' || p_partkey || '.ts' AS file, CAST(1 AS BIGINT) AS line, true AS exported FROM part
UNION ALL SELECT 'IN_' || p_partkey, 'IN_' || p_partkey, 'mutation', 'src/gql/queries/p' || p_partkey || '.ts', 2, false FROM part""",
    "X-05_hooks": f"""WITH {_S}, used AS (SELECT DISTINCT s.k, 'OP_' || p_partkey AS op FROM s JOIN part ON p_partkey IN (s.k, s.n))
SELECT 'useH' || s.k AS name, 'src/gql/hooks/h' || s.k || '.ts' AS file, CAST(2 AS BIGINT) AS line, coalesce(string_agg(op, ',' ORDER BY op), '') AS operations FROM s LEFT JOIN used ON used.k = s.k GROUP BY s.k""",
    "X-06_callsites": f"""WITH {_SITES} SELECT CASE kind WHEN 'hook' THEN 'useH' ELSE 'OP_' END || of AS target, kind AS "targetKind", file, line, col AS "column", CASE kind WHEN 'hook' THEN 'src/gql/hooks/h' ELSE 'src/gql/queries/p' END || of || '.ts' AS "targetFile" FROM sites""",
    "X-12_routes_from_text": f"""WITH {_IN_NATION}
SELECT '/n' || n || CASE WHEN k % 3 = 0 THEN '' ELSE '/s' || k || '-m' || n END AS path, k % 3 = 0 AS index, CAST(1 AS BIGINT) AS depth, '/n' || n AS "parentPath", 'src/router/n' || n || '.tsx' AS file, m + 2 + i AS line, 'S' || k || ',S' || k AS components, 'RoleBasedGuard' AS guards, 'n' || n || '.s' || k AS permissions FROM o
UNION ALL SELECT DISTINCT '/n' || n, false, CAST(0 AS BIGINT), NULL, 'src/router/n' || n || '.tsx', m + 2, 'Home', 'AuthGuard', 'n' || n || '.read' FROM o""",
    "X-15_components": f"""WITH {_S} SELECT 'S' || k AS name, 'src/pages/n' || n || '/S' || k || '.tsx' AS file, CAST(3 AS BIGINT) AS line, true AS exported, 'useH' || k AS "hookCalls", CASE WHEN k IN (SELECT p_partkey FROM part) THEN 'OP_' || k ELSE '' END AS "operationRefs" FROM s""",
    "S-05_permissions_from_text": """SELECT 'n' || n_nationkey || '.read' AS key, 'ALL,R' || n_regionkey AS roles, 'src/common/permissions/index.ts' AS file, 1 + row_number() OVER (ORDER BY n_nationkey) AS line FROM nation""",
    "X-21_specs": f"""WITH {_IN_NATION} SELECT 's' || k AS name, 'e2e/tests/n' || n || '.spec.ts' AS file, 1 + i AS line, 'test' AS kind, 'N' || n || 'Page,XPage' AS poms FROM o""",
    "X-23_page_objects": f"""WITH {_S} SELECT DISTINCT 'N' || n || 'Page' AS name, 'e2e/pages/n' || n || '.page.ts' AS file FROM s""",
    "X-25_locators": f"""WITH {_IN_NATION} SELECT 'n' || n AS module, 's' || k AS name, '[data-testid=' AS value, false AS parametric, 't-' || k AS testids, 'e2e/pages/n' || n || '.locators.ts' AS file, i AS line FROM o""",
    "X-26_app_testids": f"""SELECT 't-' || c_custkey AS value, '{WEB}src/views/c' || c_custkey || '.tsx' AS file, CAST(3 AS BIGINT) AS line, false AS pattern, 't-' || c_custkey AS template FROM customer
UNION ALL SELECT 'row-' || c_custkey || '-', '{WEB}src/views/c' || c_custkey || '.tsx', 4, true, 'row-' || c_custkey || '-${{i}}' FROM customer""",
    "X-28_class_selectors": """SELECT 'src/views/m' || s_suppkey || '.module.scss' AS file, 'a' || s_suppkey || ',b' || s_suppkey AS classes FROM supplier""",
    "X-29_style_imports": """SELECT 'src/views/c' || c_custkey || '.tsx' AS consumer, 'src/views/m' || c_custkey || '.module.scss' AS module_file FROM customer JOIN supplier ON s_suppkey = c_custkey""",
    "Q-26_reindex": f"""WITH {_SITES}, ns AS (SELECT DISTINCT n FROM s), styled AS (SELECT c.k FROM c JOIN s ON s.k = c.k),
files AS (SELECT file FROM sites UNION SELECT '{WEB}src/views/c' || k || '.tsx' FROM c UNION SELECT 'src/pages/n' || n || '/S' || k || '.tsx' FROM s UNION SELECT 'src/views/c' || k || '.tsx' FROM styled)
SELECT 'node GqlOperation' AS "table", 2 * count(*) AS n FROM p UNION ALL SELECT 'node GqlHook', count(*) FROM s UNION ALL SELECT 'node File', count(*) FROM files
UNION ALL SELECT 'node Route', (SELECT count(*) FROM ns) + count(*) FROM s UNION ALL SELECT 'node Component', count(*) FROM s UNION ALL SELECT 'node Guard', 2 UNION ALL SELECT 'node Permission', (SELECT count(*) FROM nation) + count(*) FROM s
UNION ALL SELECT 'node Role', 1 + count(DISTINCT n_regionkey) FROM nation UNION ALL SELECT 'node Page', count(*) FROM ns UNION ALL SELECT 'node Domain', count(*) FROM ns UNION ALL SELECT 'node Doc', count(*) FROM region
UNION ALL SELECT 'node E2eSpec', count(*) FROM s UNION ALL SELECT 'node PageObject', count(*) FROM ns UNION ALL SELECT 'node TestIdLoc', count(*) FROM s UNION ALL SELECT 'node TestId', (SELECT count(*) FROM c) + count(*) FROM (SELECT k FROM c UNION SELECT k FROM s) UNION ALL SELECT 'node ScssModule', count(*) FROM s
UNION ALL SELECT 'edge WRAPS GqlHook GqlOperation', count(*) FROM (SELECT DISTINCT s.k, p.k FROM s JOIN p ON p.k IN (s.k, s.n))
UNION ALL SELECT 'edge USES_OPERATION File GqlOperation', count(*) FROM sites WHERE kind = 'operation' UNION ALL SELECT 'edge USES_OPERATION Component GqlOperation', count(*) FROM s JOIN p ON p.k = s.k
UNION ALL SELECT 'edge CALLS_HOOK File GqlHook', count(*) FROM sites WHERE kind = 'hook' UNION ALL SELECT 'edge CALLS_HOOK Component GqlHook', count(*) FROM s
UNION ALL SELECT 'edge CHILD_OF Route Route', count(*) FROM s UNION ALL SELECT 'edge RENDERS Route Component', count(*) FROM s UNION ALL SELECT 'edge GUARDED_BY Route Guard', (SELECT count(*) FROM ns) + count(*) FROM s
UNION ALL SELECT 'edge REQUIRES Route Permission', (SELECT count(*) FROM ns) + count(*) FROM s UNION ALL SELECT 'edge GRANTED_TO Permission Role', 2 * count(*) FROM nation UNION ALL SELECT 'edge IN_DOMAIN Page Domain', count(*) FROM ns
UNION ALL SELECT 'edge BELONGS_TO Component Page', count(*) FROM s UNION ALL SELECT 'edge HAS_FILE Page File', count(*) FROM s UNION ALL SELECT 'edge USES_POM E2eSpec PageObject', count(*) FROM s UNION ALL SELECT 'edge DEFINES_LOC PageObject TestIdLoc', count(*) FROM s
UNION ALL SELECT 'edge RESOLVES_TO TestIdLoc TestId', count(*) FROM s UNION ALL SELECT 'edge HAS_TESTID File TestId', 2 * count(*) FROM c UNION ALL SELECT 'edge USES_SCSS File ScssModule', count(*) FROM styled""",
}
