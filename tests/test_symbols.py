"""Bindings, extents, the document grammar, element trees, ways from roots, and literals of a megabyte."""

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from graphlens.operators import extract, graphql, literals, symbols
from graphlens.operators.trees import checkpointed, from_roots
from tests.test_extract import rows, texts

LONG = 1 << 20


def tokens(spark, *files):
    return checkpointed("tokens", literals.tokens(texts(spark, *files)))


def test_literals_of_a_megabyte(spark):
    """No pattern calls itself once a character: the same extractors on literals a thousand times as long as usual."""
    body, words = "query Big { a" + " b { c }" * (LONG // 8) + " }", "x\\'y " * (LONG // 5)
    files = texts(
        spark,
        ("src/gql/queries/a.ts", f"export const BIG = gql`{body}`\nexport const NEXT = gql`query Next {{ a }}`"),
        ("src/common/permissions/a.ts", f"export const PERMISSIONS = {{ a: ['{words}', \"R\"], b: ['S'] }}"),
        ("src/router/index.tsx", f"const t = `{words}`\nexport const routes = [{{ path: '{words}' }}, {{ path: 'b', element: <A title=\"{'z' * LONG}\"><B /></A> }}]"),
        ("e2e/pages/h.locators.ts", f"export const big = `{words}[data-testid='one']`\nexport const next = '[data-testid=\"two\"]'"),
        ("src/min.ts", "a" + ";useOne(b1)" * (LONG // 11) + ";"),
    )
    at = lambda name: files.where(F.col("path").contains(name))
    assert rows(extract.operations(at("gql")), "gqlName", "kind", "line") == [("Big", "query", 1), ("Next", "query", 2)]
    assert [len(r.roles) for r in extract.permissions(extract.permission_entries(at("permissions"))).orderBy("key").collect()] == [2, 1]
    routes = extract.routes(extract.route_nodes(at("router"))).collect()
    assert sorted((len(r.path), r.components) for r in routes) == [(2, ["A", "B"]), (len(words) + 1, [])]
    assert rows(extract.locators(at("locators")), "name", "line", "testids") == [("big", 1, ["one"]), ("next", 2, ["two"])]
    found = literals.tokens(at("min"))
    assert found.where("token = 'useOne'").count() == LONG // 11 and found.agg(F.max("column")).first()[0] > LONG - 20


DOCUMENTS = {
    "query A { a }": [("query", "A")], "{ a }": [("query", None)], "query { a(": None, "query { a } junk": None, "": None, " \n ": None, "query {}": None,
    "query A { a b: c d(x: 1) { e } }": [("query", "A")],
    "mutation M($a: Int! = 3 @d(x: 1), $b: [[T!]!]!) @dir { m(a: $a, l: [1, $b], o: {k: {z: ENUM}}) @skip(if: true) }": [("mutation", "M")],
    "fragment F on T { x } subscription S { s }": [("fragment", "F"), ("subscription", "S")],
    "fragment on on T { x }": None, "fragment F on T @d { ...G ... on U @x { y } ... { z } ... @inc(if: $v) { w } }": [("fragment", "F")],
    "query A($a: Int = $b) { a }": None, "query A() { a }": None, "query { a() }": None, "query { a: }": None, "query { a { } }": None,
    "query { on fragment query }": [("query", None)], 'query { a(s: "x } { y") }': [("query", None)], 'query { a(s: """ block " } """) }': [("query", None)],
    'query { a(s: """ \\""" } """) }': [("query", None)], 'query { a(s: "open) }': None, "query A { a } # c } \n": [("query", "A")], "# only a comment": None,
    "query A, { a,,b }": [("query", "A")], "query { ...on }": None, "query { ... on T }": None, "query { ...F }": [("query", None)], "query { a @ }": None,
    "query A { a }}": None, "query A { a ": None, "type T { a: Int }": None, "query A { a(x: -1.5e3, y: null) }": [("query", "A")], "query A { a(x: 01) }": None,
    "query A { a(x: ?) }": None, "query A { a(x: [) }": None, "query query { query }": [("query", "query")], "query A { a { ...F @x } } fragment F on T { b }": [("query", "A"), ("fragment", "F")],
    "query A($x: [Int!) { a }": None, "query A { a(x: {a 1}) }": None, "{ a } { b }": [("query", None), ("query", None)], "query A { a(x: $) }": None, "query A($x) { a }": None,
    "query A { a(x: {}) b(y: []) }": [("query", "A")], "query A($x: T = {a: [1, {b: $y}]}) { a }": None,
}


def test_documents_agree_with_a_written_table(spark):
    df = spark.createDataFrame([(k,) for k in DOCUMENTS], "d string")
    got = {r.d: None if r.x is None else [tuple(y) for y in r.x] for r in df.select("d", graphql.definitions(F.col("d")).alias("x")).collect()}
    assert got == DOCUMENTS and len(DOCUMENTS) >= 40
    stubs = extract.operations(texts(spark, ("src/gql/queries/a.ts", "const A = gql`query { a(`\nconst B = gql`query { a } junk`\nconst C = gql`query { a }`\nconst D = gql``")))
    assert rows(stubs, "symbol", "gqlName", "kind") == [("A", "A", "fragment"), ("B", "B", "fragment"), ("C", "C", "query"), ("D", "D", "fragment")]


HOOKS = """import { A, B, C } from '../queries/q'
export function useOne(x: { B: string }): { y: number } {
  const s = 'B'
  return run(A) // C
}
const after = C
export const useTwo = async <T,>(x: T): Promise<T> => {
  return q(B)
}, useThree: () => void = function () { C }
export const useFour = x => q(A, { B })
B()
export const useNot = make(A)
export const use5 = () => A, useful = () => B
function useHidden() { A }
export default function useSix() { return C }
"""


def test_hooks_use_what_their_bodies_name(spark):
    known = spark.createDataFrame([("p", x) for x in "ABC"], "project string, symbol string")
    got = extract.hooks(tokens(spark, ("src/gql/hooks/h.ts", HOOKS), ("src/else.ts", HOOKS)), known)
    assert rows(got, "name", "line", "operations") == [("useFour", 10, ["A", "B"]), ("useOne", 2, ["A"]), ("useSix", 15, ["C"]), ("useThree", 9, ["C"]), ("useTwo", 7, ["B"])]


FILES = {
    "src/gql/queries/a.ts": "export const GET = gql`query Get { a }`\nconst copy = GET\nexport { GET as RENAMED }",
    "src/gql/queries/b.ts": "export const GET = gql`query Other { b }`",
    "src/gql/hooks/useA.ts": "import { GET } from '../queries/a'\nexport default function useA() { return q(GET) }",
    "src/gql/hooks/useB.ts": "export const useA = () => 1",
    "src/gql/index.ts": "export * from './all'\nexport { useA as useOther } from './hooks/useB'",
    "src/gql/all.ts": "export { default as useA } from './hooks/useA'\nexport * from './queries/a'\nexport * from './index'",
    "src/one.tsx": "import { GET as G, useA, type Props } from '@/gql'\nimport * as Q from './gql/queries/a'\nuseA(G, Q.GET, x.GET, { GET: 1, G })\nfunction f(G) { return G }\nconst g = ({ useA }) => { useA() }\n{ const G = 1; G }\nG\nconst t = <p>Don't useA G</p>",
    "src/two.tsx": "import { GET } from './gql/queries/b'\nGET",
    "src/three.ts": "import useIt from './gql/hooks/useA'\nimport { useOther } from './gql'\nimport { RENAMED } from './gql/queries/a'\nuseIt(RENAMED); useOther()",
    "src/four.ts": "const GET = 1\nGET; useA()",
}


def test_references_follow_bindings(spark):
    files = texts(spark, *FILES.items())
    found = tokens(spark, *FILES.items())
    known = spark.createDataFrame([("p", "GET", "operation", "src/gql/queries/a.ts"), ("p", "GET", "operation", "src/gql/queries/b.ts"), ("p", "useA", "hook", "src/gql/hooks/useA.ts"), ("p", "useA", "hook", "src/gql/hooks/useB.ts")], "project string, name string, kind string, file string")
    got = symbols.references(found, known, files, (("@/", "src/"),), checkpointed)
    by = {}
    for r in got.collect():
        by.setdefault(r.file.rsplit("/", 1)[1], []).append((r.path.removeprefix("src/"), r.line, r.column))
    assert sorted(by["b.ts"]) == [("gql/queries/b.ts", 1, 14), ("two.tsx", 1, 10), ("two.tsx", 2, 1)]
    assert sorted(by["a.ts"]) == sorted(
        [("gql/queries/a.ts", 1, 14), ("gql/queries/a.ts", 2, 14), ("gql/queries/a.ts", 3, 10), ("gql/hooks/useA.ts", 1, 10), ("gql/hooks/useA.ts", 2, 43)]
        + [("one.tsx", 1, 10), ("one.tsx", 1, 17), ("one.tsx", 3, 6), ("one.tsx", 3, 11), ("one.tsx", 3, 33), ("one.tsx", 7, 1), ("three.ts", 3, 10), ("three.ts", 4, 7)]
    )
    assert sorted(by["useA.ts"]) == [("gql/hooks/useA.ts", 2, 25), ("one.tsx", 1, 20), ("one.tsx", 3, 1), ("three.ts", 1, 8), ("three.ts", 4, 1)]
    assert sorted(by["useB.ts"]) == [("gql/hooks/useB.ts", 1, 14), ("gql/index.ts", 2, 10), ("three.ts", 2, 10), ("three.ts", 4, 17)]


ELEMENT = """<AuthGuard roles={PERMISSIONS.a.b} icon={<Icon of={[{ x: <Deep roles={PERMISSIONS.no.no} /> }]} />} onClick={() => a > b && <Never />}>
  Don't say "it
  <Page.Inner fallback={cond ? <Wait /> : <Other />} />{list.map((x) => <Item key={x} />)}
  <RoleBasedGuard on={(x) => x > 1} roles={PERMISSIONS.c}><LazyTable><Suspense fallback={<Loader />}><Home /></Suspense></LazyTable></RoleBasedGuard>
  <RouterGuard roles={[PERMISSIONS.d.e]}>it's {`a ${<Hole />} b`}</RouterGuard><Plain roles={PERMISSIONS.x.y} />
</AuthGuard>"""


def test_elements_in_attributes_are_no_children(spark):
    router = f"export const routes = [{{ path: 'a', element: {ELEMENT} }}, {{ path: 'b', element: <Last /> }}]"
    got = {r.path: r for r in extract.routes(extract.route_nodes(texts(spark, ("r.tsx", router)))).collect()}
    assert got["/a"].components == ["Page.Inner", "Item", "Home", "Plain"] and got["/b"].components == ["Last"]
    assert got["/a"].guards == ["AuthGuard", "RoleBasedGuard", "RouterGuard"] and got["/a"].permissions == ["a.b", "c"]


def test_lazy_components_are_told_apart_without_semicolons(spark):
    router = "const A = lazy(() => import('./a'))\nconst B = React.lazy(() => import('./b').then((m) => ({ default: m.BPage })))\nimport C, { D as E } from './c'\n"
    assert rows(extract.component_imports(literals.tokens(texts(spark, ("r.tsx", router)))).fillna("-"), "name", "spec", "export") == [("A", "./a", "-"), ("B", "./b", "BPage"), ("C", "./c", "-"), ("E", "./c", "D")]


def test_ways_from_roots_at_any_depth(spark):
    chain = spark.createDataFrame([(k, k - 1 if k else None, str(k)) for k in range(200)] + [(900, 899, "lost")], "node long, parent long, v string")
    got = {r.node: (r.value, r.depth) for r in from_roots(chain, "v", lambda a, b: F.concat(a, F.lit("."), b)).collect()}
    assert len(got) == 200 and got[199] == (".".join(map(str, range(200))), 199)
    ring = spark.createDataFrame([(1, None, "a"), (2, 3, "b"), (3, 2, "c")], "node long, parent long, v string")
    with pytest.raises(ValueError, match="ring"):
        from_roots(ring, "v", lambda a, b: F.concat(a, b))


def test_a_document_token_is_looked_up_once(spark):
    """The automaton's table stands once in the expression, as an array that is read by place: its cost is that of the tokens."""
    said = str(graphql.definitions(F.col("t")))
    assert said.count("get(array(0, 0") == 1 and "map(" not in said
    df = spark.createDataFrame([("query A { a }" + " fragment F on T { b { c } }" * 2 + " { d }",), ("query A { a } }",), ("",)], "t string")
    got = [r.d for r in df.select(graphql.definitions(F.col("t")).alias("d")).collect()]
    assert got[0] == [("query", "A"), ("fragment", "F"), ("fragment", "F"), ("query", None)] and got[1:] == [None, None]


def test_values_over_many_parts_and_own_marks(spark, monkeypatch):
    """Values are read from parts of a text, tokens from a marked copy: neither a part's end nor a text's own marks are told."""
    monkeypatch.setattr(literals, "_PART", 7)
    long = "x😀é" * 20
    for text in (f"const R = {{ a: '{long}', b: [ '1', {{ c : 2 }} ],\n d: {long[1]} }}", "const R = { a: '', b: '' }"):
        files = texts(spark, ("f.ts", text))
        found = literals.tokens(files)
        got = {r.key: r.value for r in literals.entries(files, found).where("key is not null").collect()}
        assert got == ({"a": f"'{long}'", "b": "[ '1', { c : 2 } ]", "c": "2", "d": long[1]} if long in text else {"a": "''", "b": "''"})
        assert all(text[r.pos - 1 :].startswith(r.token) for r in found.collect())


def test_tasks_follow_the_characters(spark, monkeypatch):
    """Texts that are alike are small in a shuffle: the tasks that list their tokens are counted by characters."""
    monkeypatch.setattr(literals, "_TASK", 100)
    files = texts(spark, *[(f"f{k}.ts", "const a = 1\n" * 10) for k in range(20)])
    assert literals.tokens(files).rdd.getNumPartitions() == 24


def test_elements_meet_the_tokens_of_their_stretch(spark, monkeypatch):
    """Each token is compared with the elements near it, and elements of many stretches, in one another too, keep all theirs."""
    monkeypatch.setattr(extract, "STRETCH", 4)
    routes = ",".join(f"{{ path: 'r{k}', element: <A{k}>{'<B />' * 9}</A{k}> }}" for k in range(5))
    nested = "{ path: 'n', element: <Out list={[{ element: <In /> }]}><End /></Out> }"
    nodes = extract.route_nodes(texts(spark, ("r.tsx", f"const routes = [{routes}, {nested}]")))
    got = {r.segment: r.e.components for r in nodes.collect()}
    assert got == {**{f"r{k}": [f"A{k}", *["B"] * 9] for k in range(5)}, "n": ["Out", "End"]}


def test_an_extractor_lists_the_tokens_of_its_own_files(spark):
    """Routes and permissions list no other files' tokens; a route tree beside lazy components is not gathered into one row."""
    kept = []

    def keep(name, rows):
        kept.append(name)
        return checkpointed(name, rows)

    code = texts(
        spark,
        ("src/r.tsx", "const L = lazy(() => import('./l').then((m) => ({ default: m.P })))\nexport const routes = [{ path: '/a', element: <L /> }]"),
        ("src/l.tsx", "\nexport const P = () => useH()"),
        ("src/common/permissions/i.ts", "const PERMISSIONS = { a: { read: ['R'] } }"),
        ("src/gql/hooks/h.ts", "export function useH() { return 1 }"),
    )
    from graphlens.plans.index import Sources, record_batches

    made = record_batches(Sources(code=code), ("src/r.tsx",), keep=keep)
    assert rows(made["routes"], "path", "components") == [("/a", ["L"])] and rows(made["permissions"], "key", "roles") == [("a.read", ["R"])]
    assert {k for k in kept if k.endswith("tokens")} == {"router_tokens", "permission_tokens"}
    assert rows(made["components"], "name", "file", "line", "hookCalls") == [("L", "src/l.tsx", 2, ["useH"])]
    assert "other_tokens" not in kept


def test_statements_are_told_in_their_tokens(spark):
    """What a statement begins with and declares stands in each of its tokens: declarations and modules are read off without a join."""
    found = tokens(spark, ("a.ts", "import A, { B as C } from './x'\nexport default function f() { const y = 1 }\na.b = 2;\nexport let p = 1, q"), ("b.ts", "x(1)\nexport * from './a' // end"))
    got = found.select("path", "stmt", "head", "second", "word", "end").distinct().orderBy("path", "stmt").collect()
    assert [(r.path, r.head, r.second, r.word) for r in got] == [("a.ts", "import", "A", "import"), ("a.ts", "export", "default", "function"), ("a.ts", "export", "let", "let"), ("b.ts", "x", "(", None), ("b.ts", "export", "*", None)]
    last = {(r.path, r.stmt): r.n for r in found.groupBy("path", "stmt").agg(F.max("n").alias("n")).collect()}
    assert [r.end for r in got] == [last[r.path, r.stmt] for r in got]
    named, declared = symbols.module_names(found), symbols.declarations(found)
    assert rows(named.fillna("-"), "path", "kind", "name", "local", "spec") == [("a.ts", "import", "B", "C", "./x"), ("a.ts", "import", "default", "A", "./x"), ("b.ts", "export", "*", "-", "./a")]
    assert rows(declared, "name", "exported", "default") == [("f", True, True), ("p", True, False)]
    for frame in (named, declared):
        assert "Join" not in frame._jdf.queryExecution().optimizedPlan().toString()


HIDING = """import { A, B } from './x'
run(A, { B }, [A], ...A)
const f = ({ a: { A }, B = 1 }: T): R => run(A, B)
function g(x, A: T) { return A + B }
const h = function (...B) { return (A) => { return [A, B] } }
class K { m(A) { return A } n() { const { B } = z; { let A = B } return A } }
const t = cond ? (A) : (B)
const u = cond ? (B) => B : A
const v = async (A) => run(A), w = A
items.map((A) => A, A).filter(B => B)
if (A) { for (const B of A) { run(B) } run(B) }
"""


def test_only_brackets_that_declare_hide(spark):
    """Arguments, however many, are not looked at as parameters; a declaration of any kind hides a name in its own extent alone."""
    found = tokens(spark, ("a.ts", HIDING))
    names = spark.createDataFrame([("p", "a.ts", x) for x in "AB"], "project string, path string, name string")
    kept = {}
    covers = symbols.hidden(found, names, lambda name, frame: kept.setdefault(name, checkpointed(name, frame)))
    uses = found.where("token in ('A', 'B')").select("path", F.col("token").alias("name"), "n", "line", "column").join(covers, ["path", "name"]).where("n >= from_n and n <= to_n")
    got = sorted({(r.line, r.column, r.name) for r in uses.collect()})
    assert {y: "".join(name for line, _, name in got if line == y) for y, *_ in got} == {3: "BB", 4: "AA", 5: "BAAB", 6: "BAB", 8: "BB", 9: "AA", 10: "AA", 11: "B"}
    # Line 2 has calls alone: none of their brackets meets a name.
    later = found.where("line = 3").agg(F.min("n")).first()[0]
    assert kept["declared_in_brackets"].where((F.col("open") < later) & (F.col("bracket") != "{")).isEmpty()


def test_documents_in_batches_agree_with_the_table(spark):
    df = spark.createDataFrame([(k,) for k in [*DOCUMENTS, None]], "d string")
    got = {r.d: None if r.x is None else [tuple(y) for y in r.x] for r in df.select("d", graphql.definitions_in_batches(F.col("d")).alias("x")).collect()}
    assert got == DOCUMENTS | {None: None}


def test_tokens_are_told_without_windows(spark):
    plan = literals.tokens(texts(spark, ("a.ts", "const a = 1")))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan


def test_files_are_told_whole_wherever_batches_end(monkeypatch):
    """Batches cut files anywhere: the rows are those of each file by itself."""
    files = ["const a = { b : [ 1 ] } ; let f = ( x ) => { } // c \n export { a }", "/* only */", "a", "} ] ) ( [ {", "import x from 'y' ; // z", "< B > words < / B >"]
    made = [("p", f"f{k}", n, " \n" if n % 3 else "", t, t.isidentifier(), t == "words") for k, f in enumerate(files) for n, t in enumerate(f.split(" "))]
    whole = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made, strict=True)], ["project", "path", "n", "gap", "token", "is_name", "words"])
    whole = whole.set_column(2, "n", whole["n"].cast(pa.int32()))
    told = lambda batches: [r for b in literals._by_file(iter(batches)) for r in b.to_pylist()]
    alone = [r for k in range(len(files)) for r in told([whole.filter(pc.equal(whole["path"], f"f{k}"))])]
    assert [(r["token"], r["close"], r["end"]) for r in alone if r["token"] == "{"][:2] == [("{", 9, 10), ("{", 19, 22)]
    assert told([whole]) == alone and told([]) == []
    for batch, size in ((1, 1), (4, 3), (7, 10), (1 << 16, 2)):
        monkeypatch.setattr(literals, "_BATCH", batch)
        assert told([whole.slice(k, size) for k in range(0, len(whole), size)]) == alone
    monkeypatch.setattr(literals, "_BYTES", 1)
    assert told([whole.slice(k, 4) for k in range(0, len(whole), 4)]) == alone
