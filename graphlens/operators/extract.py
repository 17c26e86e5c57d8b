"""Facts from texts: rows (project, path, text) to record batches, by expressions that stay in the JVM.

References are found by binding (``symbols``): declarations, imports and re-exports tell two things of one name apart, but types
are not inferred. Indexers that know them can deliver their records as JSON batches instead (graphlens.sources.records).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlens.functions.matches import matches_with_lines
from graphlens.functions.paths import directory, resolve, stem
from graphlens.operators import graphql, literals, symbols
from graphlens.operators.trees import Keep, from_roots, checkpointed

# The file names, tags and patterns that mark each kind of fact.
GUARDS = ("AuthGuard", "RouterGuard", "RoleBasedGuard", "RoleBasedDisableGuard")
ROUTER_TAGS = ("Navigate", "Outlet", "DashboardLayout", "Suspense")
ROLE_FILES = {"types.ts": "types", "helpers.ts": "helpers", "constants.ts": "constants", "csvReport.ts": "csv_report", "toast-contracts.ts": "toast_contracts"}
IGNORED_ENTRIES = ("node_modules", "__tests__", "__mocks__", ".DS_Store")
SHARED_FOLDERS = ("common", "components", "hooks", "contexts", "constants")
HEADING = r"(?md)^(#{1,3})[^\S\n]+([^\n]*?\S)\s*?$"
TEST_CALL = r"(?md)^[ \t]*(test|test\.describe|test\.only|test\.skip)\s*\(\s*['\"`]([^'\"`]+)['\"`]"
POM_IMPORT = r"import\s*(?:type\s*)?\{([^}]+)\}\s*from\s*['\"](?:\.\./)+pages/[^'\"]+\.page['\"]"
PAGE_CLASS = r"export\s+class\s+(\w*Page)\b"
TESTID_IN_SELECTOR = r"\[data-testid=['\"]([^'\"]+)['\"]\]"
TESTID_LITERAL = r"data-testid=['\"]([^'\"]+)['\"]"
TESTID_TEMPLATE = r"data-testid=`([^`]+)`"
TESTID_PROPERTY = r"data-testid=\{\s*[`'\"]([^`'\"]+)[`'\"]"
TESTID_ATTRIBUTE = r"(?:data-testid|testid)=['\"]([^'\"]+)['\"]"
# Every repeated group is possessive: the matcher loops over a long literal and does not call itself.
LOCATOR = r"(?s)export\s+const\s+(\w+)\s*(?::\s*[^=]+)?=\s*((?:\([^)]*\)\s*=>\s*)?(?:`(?:[^`\\]++|\\.)*+`|'(?:[^'\\]++|\\.)*+'|\"(?:[^\"\\]++|\\.)*+\"))"
CLASS_SELECTOR = r"(?md)^\s*\.([A-Za-z_][A-Za-z0-9_-]*)\b"
STYLE_IMPORT = r"import\s+\w+\s+from\s+['\"]([^'\"]*\.module\.scss)['\"]"
GQL_TEMPLATE = r"(?s)(export\s+)?(?:const|let|var)\s+(\w+)\s*(?::[^=]+)?=\s*gql\s*`((?:[^`\\]++|\\.)*+)`"
HOOK = r"^use[A-Z]"
#: Tokens of a file that are compared with the ranges there.
STRETCH = 64

_FILE = ["project", "path"]


def _all(text: str | Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _named(texts: DataFrame, pattern: str, groups: int) -> DataFrame:
    """One row per match: project, path, line, g1, g2, ..."""
    hits = texts.select("project", "path", F.explode(matches_with_lines(F.col("text"), pattern, groups)).alias("m"))
    return hits.select("project", "path", F.col("m.line").alias("line"), *[F.col(f"m.g{k + 1}").alias(f"g{k + 1}") for k in range(groups)])


# --- documents, styles ------------------------------------------------------------------------------------------------


def docs(texts: DataFrame) -> DataFrame:
    """Markdown files: headings of levels 1 to 3; the first is the title if its level is 1."""
    headings = F.zip_with(_all("text", HEADING, 1), _all("text", HEADING, 2), lambda a, b: F.struct(F.length(a).alias("level"), b.alias("text")))
    rows = texts.withColumn("headings", headings)
    title = F.when(F.get("headings", F.lit(0))["level"] == 1, F.get("headings", F.lit(0))["text"])
    return rows.select("project", stem(F.col("path")).alias("name"), F.col("path").alias("file"), title.alias("title"), F.length("text").cast("long").alias("size"), "headings")


def style_modules(texts: DataFrame) -> DataFrame:
    return texts.select("project", F.col("path").alias("file"), F.array_sort(F.array_distinct(_all("text", CLASS_SELECTOR))).alias("classes"))


def style_imports(texts: DataFrame, modules: DataFrame) -> DataFrame:
    """Imports of style modules that exist, relative paths resolved; what leaves the root resolves to nothing."""
    texts = texts.where(F.contains("text", F.lit(".module.scss")))
    rows = texts.select("project", F.col("path").alias("consumer"), F.explode(_all("text", STYLE_IMPORT)).alias("spec"))
    rows = rows.withColumn("module_file", resolve(directory(F.col("consumer")), F.col("spec")))
    return rows.join(modules.select("project", F.col("file").alias("module_file")), ["project", "module_file"], "left_semi").select("project", "consumer", "module_file").distinct()


# --- end-to-end tests ---------------------------------------------------------------------------------------------------


def imported_page_objects(text: Column) -> Column:
    """Names of imported page-object classes: aliases and type marks off, capitalised names only."""
    names = F.flatten(F.transform(_all(text, POM_IMPORT), lambda x: F.split(x, ",")))
    names = F.transform(names, lambda x: F.regexp_replace(F.trim(F.regexp_replace(F.split_part(x, F.lit(" as "), F.lit(1)), r"\s+", " ")), r"^type ", ""))
    return F.filter(names, lambda x: x.rlike(r"^\p{Lu}"))


def specs(texts: DataFrame) -> DataFrame:
    calls = texts.withColumn("poms", imported_page_objects(F.col("text"))).select("project", "path", "poms", F.explode(matches_with_lines(F.col("text"), TEST_CALL, 2)).alias("m"))
    return calls.select("project", F.col("m.g2").alias("name"), F.col("path").alias("file"), F.col("m.line").alias("line"), F.col("m.g1").alias("kind"), "poms")


def page_objects(texts: DataFrame) -> DataFrame:
    return texts.select("project", F.explode(_all("text", PAGE_CLASS)).alias("name"), F.col("path").alias("file"))


def testid_targets(body: Column) -> Column:
    """Test ids that a locator's text names: sorted, without selectors and template holes."""
    found = F.concat(*[_all(body, rx) for rx in (TESTID_IN_SELECTOR, TESTID_LITERAL, TESTID_TEMPLATE)])
    return F.array_sort(F.array_distinct(F.filter(found, lambda v: (v != "") & ~v.rlike(r"\$\{|\[|\]| "))))


def locators(texts: DataFrame) -> DataFrame:
    rows = _named(texts, LOCATOR, 2)
    value = F.regexp_extract("g2", "['\"`]([^'\"`]+)['\"`]", 1)
    return rows.select("project", stem(F.col("path"), ".locators").alias("module"), F.col("g1").alias("name"), value.alias("value"), F.ltrim("g2").startswith("(").alias("parametric"), testid_targets(F.col("g2")).alias("testids"), F.col("path").alias("file"), "line")


def classified(raw: Column) -> tuple[Column, Column]:
    """(value, is a template): a template's value is the text before its first hole."""
    pattern = raw.contains("${")
    return F.when(pattern, F.substring_index(raw, "${", 1)).otherwise(raw), pattern


def app_testids(texts: DataFrame) -> DataFrame:
    """Test ids in application sources; templates that begin with a hole are dropped, repeats in one line count once."""
    parts, texts = [], texts.where(F.contains("text", F.lit("testid")))
    for name, group in ((r"\.tsx$", (TESTID_ATTRIBUTE, TESTID_PROPERTY, TESTID_TEMPLATE)), (r"\.ts$", (TESTID_PROPERTY, TESTID_TEMPLATE, TESTID_LITERAL))):
        for order, rx in enumerate(group):
            parts.append(_named(texts.where(F.col("path").rlike(name)), rx, 1).withColumn("order", F.lit(order)))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    value, pattern = classified(F.col("g1"))
    rows = rows.select("project", value.alias("value"), F.col("path").alias("file"), "line", pattern.alias("pattern"), F.when(pattern, F.col("g1")).otherwise(value).alias("template"), "order").where(~F.col("pattern") | (F.col("value") != ""))
    best = F.min_by(F.struct("pattern", "template"), F.struct("order", "template"))
    return rows.groupBy("project", "value", "file", "line").agg(best.alias("b")).select("project", "value", "file", "line", "b.pattern", "b.template")


# --- operations and hooks -------------------------------------------------------------------------------------------------


def operations(texts: DataFrame) -> DataFrame:
    """Tagged templates in /gql/queries/: one row per definition; of a symbol's declarations the first counts.

    A nameless definition has its symbol's name; a document that cannot be read gives one row of kind fragment.
    """
    found = _named(texts.where(F.col("path").contains("/gql/queries/")), GQL_TEMPLATE, 3)
    one = found.groupBy("project", F.col("g2").alias("symbol")).agg(F.min_by(F.struct("path", "line", "g1", "g3"), F.struct("path", "line")).alias("d"))
    body = F.regexp_replace("d.g3", r"\$\{[^}]+\}", "")
    stub = F.array(F.struct(F.lit("fragment").alias("kind"), F.lit(None).cast("string").alias("name")))
    rows = one.withColumn("found", graphql.definitions_in_batches(body)).withColumn("x", F.explode(F.when(F.size("found") > 0, F.col("found")).otherwise(stub)))
    return rows.select("project", "symbol", F.coalesce("x.name", "symbol").alias("gqlName"), F.col("x.kind").alias("kind"), F.col("d.path").alias("file"), F.col("d.line").alias("line"), (F.col("d.g1") != "").alias("exported"))


def hooks(found: DataFrame, known: DataFrame) -> DataFrame:
    """Exported hooks in /gql/hooks/, with the operations (project, symbol) that their bodies name, sorted; from token rows.

    A hook is an exported function, or a variable set to one, whose name begins with use and a capital letter.
    """
    here = found.where(F.col("path").contains("/gql/hooks/"))
    own = symbols.functions(here).where("exported").where(F.col("name").rlike(HOOK))
    named = here.where(symbols.is_name()).select("project", "path", "n", "token").join(known.select("project", F.col("symbol").alias("token")).distinct(), ["project", "token"], "left_semi")
    inside = own.join(named.withColumnRenamed("n", "at"), ["project", "path"]).where("at >= body and at <= stop")
    used = inside.groupBy("project", "path", "line", "name").agg(F.array_sort(F.collect_set("token")).alias("operations"))
    rows = own.select("project", "path", "line", "name").join(used, ["project", "path", "line", "name"], "left")
    return rows.select("project", "name", F.col("path").alias("file"), "line", F.coalesce("operations", F.array().cast("array<string>")).alias("operations"))


def callsites(found: DataFrame, files: DataFrame, operations_: DataFrame, hooks_: DataFrame, aliases: symbols.Aliases = (("@/", "src/"),), keep: Keep = checkpointed) -> DataFrame:
    """Places that refer to an operation or a hook, imports included, but for the line that declares it; from token rows.

    ``targetFile`` is the file that declares what the place refers to.
    """
    known = operations_.select("project", F.col("symbol").alias("name"), F.lit("operation").alias("kind"), "file", "line")
    known = known.unionByName(hooks_.select("project", "name", F.lit("hook").alias("kind"), "file", "line")).distinct()
    rows = symbols.references(found, known, files, aliases, keep)
    own = known.select("project", "name", "kind", "file", F.col("file").alias("path"), "line")
    rows = rows.join(own, ["project", "name", "kind", "file", "path", "line"], "left_anti")
    place = lambda c: F.col(c).cast("long").alias(c)
    return rows.select("project", F.col("name").alias("target"), F.col("kind").alias("targetKind"), F.col("path").alias("file"), place("line"), place("column"), F.col("file").alias("targetFile"))


# --- routes -----------------------------------------------------------------------------------------------------------------


def element_parts(found: DataFrame, elements: DataFrame) -> DataFrame:
    """(project, path, object, e) of routes' elements (project, path, object, from_n, to_n), ranges of token rows.

    e is struct<components, guards, permissions>: guards and permissions distinct, components as they come. An element in
    an attribute (a fallback, an icon), however deep, is no child and does not count; nor does the text between tags.
    """
    here = found.join(elements.select(*_FILE).distinct(), _FILE, "left_semi")
    order = Window.partitionBy(*_FILE).orderBy("n")
    ahead = lambda k: F.lead("token", k).over(order)
    dotted = F.when(ahead(2) == ".", F.concat_ws(".", ahead(1), ahead(3), F.when(ahead(4) == ".", ahead(5)))).otherwise(ahead(1))
    tags = here.withColumn("tag", F.when((F.col("token") == "<") & ahead(1).rlike(r"^\p{Lu}"), dotted))
    # The tag that an attribute stands in is the last that began at its level.
    level = Window.partitionBy(*_FILE, "level").orderBy("n")
    tags = tags.withColumn("owner", F.last("tag", ignorenulls=True).over(level))
    # Tokens meet the elements of their stretch of the file, not all of the file's.
    spans = elements.select(*_FILE, "object", "from_n", "to_n", F.explode(F.sequence(F.floor(F.col("from_n") / STRETCH), F.floor((F.col("to_n") - 1) / STRETCH))).alias("stretch"))
    inside = tags.withColumn("stretch", F.floor(F.col("n") / STRETCH)).join(spans, [*_FILE, "stretch"]).where("n >= from_n and n < to_n").drop("stretch")
    values = inside.where("token = '{' and prev = '='").select(*_FILE, "object", F.col("n").alias("open"), F.col("close").alias("shut"))
    key = [*_FILE, "object"]
    covered = lambda rows: rows.join(values, (rows["project"].eqNullSafe(values["project"])) & (rows["path"] == values["path"]) & (rows["object"] == values["object"]) & (rows["n"] > values["open"]) & (rows["n"] < values["shut"]), "left_anti")
    shown = covered(inside.where("tag is not null").select(*key, "n", "tag"))
    roles = covered(inside.where("token = 'roles' and next = '='").where(F.col("owner").isin(*GUARDS)).select(*key, "n", F.col("n").alias("at"))).select(*key, "n")
    told = inside.select(*key, F.col("n").alias("at"), "token").join(values, key).where("at > open and at < shut")
    told = told.join(roles.withColumn("open", F.col("n") + 2), [*key, "open"]).groupBy(*key, "n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "token"))), lambda x: x["token"]), "").alias("said"))
    told = told.where(F.col("said").rlike(r"^[A-Za-z_$][\w$]*(?:\??\.[\w$]+)+$"))
    listed = lambda rows, what, name: rows.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", what))), lambda x: x[what]).alias(name))
    is_guard, is_wrapper = F.col("tag").isin(*GUARDS), F.col("tag").isin(*ROUTER_TAGS) | F.col("tag").startswith("Lazy")
    parts = elements.select(*key).join(listed(shown.where(~is_guard & ~is_wrapper), "tag", "components"), key, "left")
    parts = parts.join(listed(shown.where(is_guard), "tag", "guards"), key, "left").join(listed(told.withColumn("said", F.regexp_replace(F.replace("said", F.lit("?"), F.lit("")), r"^PERMISSIONS\.", "")), "said", "permissions"), key, "left")
    none = F.array().cast("array<string>")
    return parts.select(*key, F.struct(F.coalesce("components", none).alias("components"), F.array_distinct(F.coalesce("guards", none)).alias("guards"), F.array_distinct(F.coalesce("permissions", none)).alias("permissions")).alias("e"))


def segment_value(raw: Column, members: Column) -> Column:
    """A path segment's text: quotes off, enum members and template holes replaced from a map, else by their own names."""
    bare = F.regexp_replace(raw, "^['\"`]|['\"`]$", "")
    names = F.concat(_all(bare, r"\$\{\s*([\w.]+)\s*\}"), F.filter(F.array(bare), lambda x: x.rlike(r"^[A-Z]\w*\.\w+$")))
    step = lambda s, n: F.replace(F.replace(s, F.concat(F.lit("${"), n, F.lit("}")), _member(members, n)), n, _member(members, n))
    return F.when(raw.isNull(), None).otherwise(F.aggregate(names, bare, step))


def _member(members: Column, name: Column) -> Column:
    return F.coalesce(F.try_element_at(members, name), F.lower(F.regexp_extract(name, r"([^.]*)$", 1)))


def route_tree(nodes: DataFrame, keep: Keep = checkpointed) -> DataFrame:
    """Full paths of a route tree: (node, parent, segment, index) to (node, path, depth, parent_path). Roots have a null parent.

    A node's own step is its segment, absolute or to be put behind its parent's path, or nothing (an index, or no segment);
    steps are joined along the way from the root, two at a time.
    """
    segment = F.col("segment")
    root = F.when(segment.isNull(), "/").when(segment.startswith("/"), segment).otherwise(F.concat(F.lit("/"), segment))
    own = F.when(F.col("parent").isNull(), F.struct(F.lit(True).alias("whole"), root.alias("path")))
    own = own.when(F.col("index") | segment.isNull(), F.lit(None).cast("struct<whole:boolean,path:string>")).otherwise(F.struct(segment.startswith("/").alias("whole"), segment.alias("path")))
    stripped = lambda x: F.regexp_replace(x, "/$", "")

    def join(above: Column, step: Column) -> Column:
        path = F.when(above["path"] == "", step["path"]).otherwise(F.concat(stripped(above["path"]), F.lit("/"), step["path"]))
        return F.when(step.isNull(), above).when(above.isNull() | step["whole"], step).otherwise(F.struct(above["whole"].alias("whole"), path.alias("path")))

    placed = from_roots(nodes.withColumn("step", own), "step", join, keep=keep, name="route_ways").select("node", F.col("value.path").alias("path"), "depth")
    up = nodes.where("parent is not null").select("node", "parent").join(placed.select(F.col("node").alias("parent"), F.col("path").alias("parent_path")), "parent")
    return placed.join(up.select("node", "parent_path"), "node", "left")


def jsx(value: Column) -> Column:
    """The value of an element property if it is JSX, in round brackets or not; else null."""
    return F.when(value.rlike(r"^(?:\(\s*)*<"), value)


def enum_members(texts: DataFrame) -> DataFrame:
    """(project, name, value): string members of enums, named Enum.MEMBER."""
    enums = _named(texts.where(F.contains("text", F.lit("enum"))), r"(?s)\benum\s+(\w+)\s*\{([^}]*)\}", 2).select("project", F.col("g1").alias("enum"), F.col("g2").alias("body"))
    pair = lambda k: _all("body", r"(?m)(\w+)\s*=\s*['\"]([^'\"\n]*)['\"]", k)
    rows = enums.select("project", "enum", F.explode(F.arrays_zip(pair(1).alias("member"), pair(2).alias("value"))).alias("x"))
    return rows.groupBy("project", F.concat_ws(".", "enum", "x.member").alias("name")).agg(F.min("x.value").alias("value"))


def route_nodes(texts: DataFrame, members: DataFrame | None = None, found: DataFrame | None = None) -> DataFrame:
    """Route objects of router files: those of the array ``routes`` and of ``children`` arrays, each with its parent's node.

    ``members`` (project, name, value) are enum members that path segments may name; ``found`` are the texts' token rows.
    """
    found = checkpointed("tokens", literals.tokens(texts)) if found is None else found
    parts = literals.entries(texts, found).where("bracket in ('{', '[')")
    root = literals.declared(found, "routes").where("bracket = '['").select("project", "path", "literal", F.lit(True).alias("root"))
    owner = parts.where("key = 'children' and child_bracket = '['").select("project", "path", F.col("child").alias("literal"), F.col("literal").alias("owner"))
    objects = parts.where("bracket = '[' and child_bracket = '{'").select("project", "path", "literal", F.col("child").alias("object"), "line")
    objects = objects.join(root, ["project", "path", "literal"], "left").join(owner, ["project", "path", "literal"], "left").where("root or owner is not null").drop("literal")
    of = lambda key: F.max(F.when(F.col("key") == key, F.col("value"))).alias(f"{key}_")
    known = parts.where("bracket = '{' and key in ('path', 'index')").groupBy("project", "path", F.col("literal").alias("object")).agg(of("path"), of("index"))
    elements = parts.where("bracket = '{' and key = 'element'").where(jsx(F.col("value")).isNotNull()).groupBy("project", "path", F.col("literal").alias("object")).agg(F.max("from_n").alias("from_n"), F.max_by("to_n", "from_n").alias("to_n"))
    none = F.array().cast("array<string>")
    rows = objects.join(known, ["project", "path", "object"], "left").join(element_parts(found, elements), ["project", "path", "object"], "left")
    rows = rows.withColumn("e", F.coalesce("e", F.struct(none.alias("components"), none.alias("guards"), none.alias("permissions"))))
    if members is None:
        rows = rows.withColumn("members", F.create_map().cast("map<string,string>"))
    else:
        # Only members that segments name: as many as the routes have, gathered per project.
        names = F.concat(_all("path_", r"\$\{\s*([\w.]+)\s*\}"), F.array("path_"))
        asked = rows.where("path_ is not null").select("project", F.explode(names).alias("name")).distinct()
        maps = members.join(asked, ["project", "name"], "left_semi").groupBy("project").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("members"))
        rows = rows.join(maps, "project", "left").withColumn("members", F.coalesce("members", F.create_map().cast("map<string,string>")))
    name = lambda c: F.when(F.col(c).isNotNull(), F.concat_ws("\0", "project", "path", F.col(c).cast("string")))
    return rows.select("project", F.col("path").alias("file"), "line", name("object").alias("node"), name("owner").alias("parent"), segment_value(F.col("path_"), F.col("members")).alias("segment"), F.coalesce(F.col("index_") == "true", F.lit(False)).alias("index"), "e")


def routes(nodes: DataFrame, keep: Keep = checkpointed) -> DataFrame:
    """Route records of ``route_nodes``, with full paths; a node that no root leads to is left out.

    The nodes are read several times: write or persist them before.
    """
    placed = route_tree(nodes.select("node", "parent", "segment", "index"), keep)
    return nodes.select("project", "file", "line", "node", "index", "e").join(placed, "node").select("project", "path", "index", "depth", F.col("parent_path").alias("parentPath"), "file", "line", "e.components", "e.guards", "e.permissions")


def in_permissions() -> Column:
    """Whether a path is of a file that may set PERMISSIONS."""
    return F.col("path").contains("/common/permissions/") | F.col("path").startswith("common/permissions/")


def permission_entries(texts: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Entries of the literals in files of /common/permissions/; those of the object that ``PERMISSIONS`` is set to have root.

    The first file, by path, that sets PERMISSIONS to an object counts. ``found`` are the texts' token rows.
    """
    files = texts.where(in_permissions())
    found = checkpointed("tokens", literals.tokens(files)) if found is None else found.where(in_permissions())
    parts = literals.entries(files, found)
    root = literals.declared(found, "PERMISSIONS").where("bracket = '{'").groupBy("project").agg(F.min_by(F.struct("path", "literal"), "path").alias("d")).select("project", "d.path", "d.literal", F.lit(True).alias("root"))
    return parts.join(root, ["project", "path", "literal"], "left")


def permissions(parts: DataFrame, keep: Keep = checkpointed) -> DataFrame:
    """Permission records of ``permission_entries``, at whatever depth.

    A list makes its dotted key a permission, whose roles are the list's plain strings; other values are left out, keys
    stay as they are written. The entries are read several times: write or persist them before.
    """
    strings = parts.where("bracket = '['").where(F.col("value").rlike(r"^(?:'(?:[^'\\]++|\\[\s\S])*+'|\"(?:[^\"\\]++|\\[\s\S])*+\")$"))
    roles = strings.groupBy("project", "path", F.col("literal").alias("node")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: F.substring(x["value"], F.lit(2), F.length(x["value"]) - 2)).alias("roles"))
    # Objects and lists are nodes; those of the root object are roots of their own.
    keyed = parts.where("bracket = '{' and child_bracket in ('{', '[')")
    nodes = keyed.select("project", "path", F.col("child").alias("node"), F.when(F.col("root").isNull(), F.col("literal")).alias("parent"), "key")
    ways = from_roots(nodes, "key", lambda above, key: F.concat_ws(".", above, key), key=_FILE, keep=keep, name="permission_ways")
    lists = keyed.where("child_bracket = '['").select("project", "path", F.col("child").alias("node"), "line")
    rows = ways.join(lists, [*_FILE, "node"]).join(roles, [*_FILE, "node"], "left")
    return rows.select("project", F.col("value").alias("key"), F.coalesce("roles", F.array().cast("array<string>")).alias("roles"), F.col("path").alias("file"), "line")


def component_imports(found: DataFrame) -> DataFrame:
    """(project, path, name, spec, export): what a router file imports, lazily first, then eagerly; the first wins. From token rows.

    A lazy component is a variable set to a call of lazy; its module and export are those named in its own declarator.
    """
    own = symbols.declarations(found).where("word in ('const', 'let', 'var')").select(*_FILE, "stmt", "name", F.col("n").alias("from_n"), "until", "line")
    rows = own.join(found.where("word in ('const', 'let', 'var')").select(*_FILE, "stmt", "n", "token"), [*_FILE, "stmt"]).where("n > from_n and n <= until")
    # The first of each of these words, with what stands behind it: a declarator is not gathered whole, it may be a route tree.
    key = [*_FILE, "name", "line"]
    order = Window.partitionBy(*key).orderBy("n")
    behind = lambda k: F.lead("token", k).over(order).alias(f"t{k}")
    rows = rows.select(*key, "n", "token", *[behind(k) for k in range(1, 5)])
    of = lambda word: F.min_by(F.struct("n", "t1", "t2", "t3", "t4"), F.when(F.col("token") == word, F.col("n"))).alias(word)
    listed = rows.groupBy(*key).agg(F.min_by("token", "n").alias("head"), of("import"), of("default"), of("lazy"))
    spec = F.when((F.col("import.t1") == "(") & F.col("import.t2").rlike("^['\"]"), F.substring(F.col("import.t2"), F.lit(2), F.length("import.t2") - 2))
    export = F.when((F.col("default.t1") == ":") & (F.col("default.t3") == "."), F.col("default.t4"))
    is_lazy = (F.col("head") == "=") & (F.col("lazy.t1") == "(") & F.col("import").isNotNull()
    lazy = listed.where(is_lazy).select(*_FILE, "name", spec.alias("spec"), export.alias("export"), F.lit(0).alias("order"), F.col("line").cast("long").alias("line")).where("spec is not null")
    eager = symbols.module_names(found).where("kind = 'import' and name <> '*'")
    eager = eager.select(*_FILE, F.col("local").alias("name"), "spec", F.when(F.col("name") != "default", F.col("name")).alias("export"), F.lit(1).alias("order"), F.col("n").cast("long").alias("line"))
    best = F.min_by(F.struct("spec", "export"), F.struct("order", "line"))
    return lazy.unionByName(eager).groupBy(*_FILE, "name").agg(best.alias("b")).select(*_FILE, "name", "b.spec", "b.export")


def resolved_components(imports: DataFrame, files: DataFrame, aliases: symbols.Aliases = (("@/", "src/"),)) -> DataFrame:
    """(project, name, file, export): imported names whose module is a file; of several files that import a name the first counts."""
    hit = imports.join(symbols.resolved_modules(imports, files, aliases), [*_FILE, "spec"])
    return hit.groupBy("project", "name").agg(F.min_by(F.struct(F.col("module").alias("file"), "export"), F.struct("path", "module")).alias("b")).select("project", "name", "b.file", "b.export")


def component_lines(components: DataFrame, found: DataFrame) -> DataFrame:
    """Components (project, name, file, export) with the line that declares the export in its file; 1 where none does."""
    own = found.join(components.select("project", F.col("file").alias("path")).distinct(), _FILE, "left_semi")
    first = symbols.declarations(own).groupBy("project", F.col("path").alias("file"), F.col("name").alias("export")).agg(F.min("line").cast("long").alias("line"))
    return components.join(first, ["project", "file", "export"], "left").withColumn("line", F.coalesce("line", F.lit(1).cast("long")))


def named_in(components: DataFrame, found: DataFrame, known: DataFrame, name: str) -> DataFrame:
    """Components (project, name, file) with the known names (project, token) that identifiers of their file have, sorted."""
    tokens = found.where(symbols.is_name()).select("project", F.col("path").alias("file"), "token").distinct().join(known.select("project", "token").distinct(), ["project", "token"], "left_semi")
    used = tokens.groupBy("project", "file").agg(F.array_sort(F.collect_set("token")).alias(name))
    return components.join(used, ["project", "file"], "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))


def permission_keys(objects: DataFrame, keep: Keep = checkpointed) -> DataFrame:
    """(project, key, roles) of nested permission objects given as JSON (project, json): dotted keys of the role lists.

    Only string elements of a list are roles; other values have none and are left out. JSON is a literal like any other:
    its objects are walked as those of source texts are.
    """
    numbered = objects.select("project", F.concat(F.lit("common/permissions/"), F.xxhash64("json").cast("string")).alias("path"), F.concat(F.lit("const PERMISSIONS = "), "json").alias("text")).distinct()
    found = keep("json_tokens", literals.tokens(numbered))
    parts = literals.entries(numbered, found)
    root = literals.declared(found, "PERMISSIONS").where("bracket = '{'").select(*_FILE, "literal", F.lit(True).alias("root"))
    plain = lambda c: F.coalesce(F.from_json(F.concat(F.lit("["), c, F.lit("]")), "array<string>")[0], c)
    parts = keep("json_entries", parts.join(root, [*_FILE, "literal"], "left").withColumn("key", plain(F.col("key"))))
    rows = permissions(parts, keep)
    return rows.select("project", "key", F.transform("roles", lambda r: plain(F.concat(F.lit('"'), r, F.lit('"')))).alias("roles"))


# --- pages --------------------------------------------------------------------------------------------------------------------


def pages(files: DataFrame, root: str = "src/pages") -> DataFrame:
    """Pages by the convention root/domain/entity, from a file listing (project, path).

    A page is a directory with a capitalised component file or a file of a known role; a component right under the root
    is a page of the domain _root; a domain's own files make a page without an entity.
    """
    parts = F.split(F.substring("path", len(root) + 2, 1 << 20), "/")
    rows = files.where(F.col("path").startswith(root + "/")).select("project", "path", parts.alias("p"))
    rows = rows.where(~F.exists("p", lambda x: x.startswith(".") | x.isin(*IGNORED_ENTRIES)))
    name = F.element_at("p", -1)
    base, n = stem(name), F.size("p")
    component = name.rlike(r"\.[tj]sx$") & base.rlike(r"^\p{Lu}")
    role = F.create_map(*[F.lit(x) for pair in ROLE_FILES.items() for x in pair])[name]
    rows = rows.select("project", "path", "p", n.alias("n"), F.when(component, F.struct(base.alias("name"), F.col("path").alias("file"))).alias("c"), role.alias("role"))
    at_root = rows.where("n = 1 and c is not null").select("project", F.lit("_root").alias("domain"), F.col("c.name").alias("entity"), F.lit(root).alias("dir"), F.array("c").alias("components"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("by_role"), F.array().cast("array<string>").alias("subdirs"))
    owner = lambda depth: rows.where(F.col("n") > depth).select(
        "project", F.get("p", F.lit(0)).alias("domain"), (F.get("p", F.lit(1)) if depth == 2 else F.lit(None).cast("string")).alias("entity"), F.concat(F.lit(root + "/"), F.array_join(F.slice("p", 1, depth), "/")).alias("dir"),
        F.when(F.col("n") == depth + 1, F.col("c")).alias("c"), F.when(F.col("n") == depth + 1, F.col("role")).alias("role"), "path", F.when(F.col("n") > depth + 1, F.get("p", F.lit(depth))).alias("sub"),
    )
    both = owner(1).unionByName(owner(2).where(~F.col("entity").isin(*SHARED_FOLDERS)))
    roles = F.map_from_entries(F.array_sort(F.collect_set(F.when(F.col("role").isNotNull(), F.struct("role", "path")))))
    grouped = both.groupBy("project", "domain", "entity", "dir").agg(F.array_sort(F.collect_set("c")).alias("components"), roles.alias("by_role"), F.array_sort(F.collect_set("sub")).alias("subdirs"))
    return at_root.unionByName(grouped.where((F.size("components") > 0) | (F.size("by_role") > 0)))
