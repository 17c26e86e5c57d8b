"""DuckDB SQL for the named queries: the same fixture graph as common table expressions, and plain joins over it."""

from __future__ import annotations

_TABLES = {
    "o": """SELECT *, CAST(year(o_orderdate) AS VARCHAR) AS yr, 'src/pages/' || CAST(year(o_orderdate) AS VARCHAR) || '/' || o_orderpriority AS dir,
        'src/pages/' || CAST(year(o_orderdate) AS VARCHAR) || '/' || o_orderpriority || '/C' || o_orderkey || '.tsx' AS file FROM orders""",
    "ev": """SELECT *, event_type || '-' || k AS literal, event_type || '-' || left(CAST(k AS VARCHAR), 1) AS head, 'user_' || user_id AS user_file
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""",
    "domain": "SELECT DISTINCT yr AS name FROM o",
    "pagefiles": """SELECT yr AS domain, o_orderpriority AS entity, dir, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS files FROM o GROUP BY ALL
        UNION ALL SELECT yr, '', 'src/pages/' || yr, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) FROM o GROUP BY yr""",
    "component": "SELECT o_orderkey AS id, 'C' || o_orderkey AS name, file, o_orderkey % 100 AS line FROM o",
    "route": "SELECT c_custkey AS id, '/' || lower(c_mktsegment) || '/' || c_custkey AS path, c_custkey % 5 = 0 AS index, 1 + c_custkey % 3 AS depth, 'src/router/index.tsx' AS file, c_custkey AS line FROM customer",
    "permission": """SELECT lower(r_name) || '.' || lower(n_name) AS key, n_nationkey AS nation, CASE WHEN n_nationkey % 5 <> 4 THEN
        list_sort(list_distinct(['R' || n_nationkey % 7, 'R' || n_nationkey % 3])) END AS roles, 'src/common/permissions/index.ts' AS file, CAST(n_nationkey AS BIGINT) AS line
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "op": "SELECT p_partkey AS id, 'OP_' || (p_partkey - p_partkey % 2) AS symbol, p_name AS gql_name, ['query', 'mutation', 'subscription', 'fragment'][p_size % 4 + 1] AS kind, 'src/gql/queries/p' || p_partkey || '.ts' AS file, CAST(p_size AS BIGINT) AS line, p_size % 2 = 0 AS exported FROM part",
    "hook": """SELECT s_suppkey AS id, 'use' || s_suppkey AS name, CASE WHEN s_suppkey % 10 = 0 THEN 'src/pages/' || CAST(1995 + (s_suppkey % 50) // 10 AS VARCHAR) || '/gql/hooks/h' || s_suppkey || '.ts'
        WHEN s_suppkey % 10 = 5 THEN 'src/pages/' || CAST(1995 + (s_suppkey % 50) // 10 AS VARCHAR) || '/1-URGENT/gql/hooks/h' || s_suppkey || '.ts'
        ELSE 'src/gql/hooks/h' || s_suppkey || '.ts' END AS file, s_suppkey % 50 AS line FROM supplier""",
    "wraps": "SELECT DISTINCT l_suppkey AS hook, l_partkey AS op FROM lineitem WHERE l_linenumber = 1 AND l_quantity > 40",
    "chook": "SELECT DISTINCT l_orderkey AS component, l_suppkey AS hook FROM lineitem WHERE l_linenumber = 1",
    "cop": "SELECT DISTINCT l_orderkey AS component, l_partkey AS op FROM lineitem WHERE l_linenumber = 2 AND l_quantity > 45",
    "fhook": "SELECT DISTINCT file, l_suppkey AS hook, l_linenumber AS line, l_partkey AS col FROM lineitem JOIN o ON l_orderkey = o_orderkey",
    "fop": "SELECT DISTINCT file, l_partkey AS op, l_linenumber AS line, l_suppkey AS col FROM lineitem JOIN o ON l_orderkey = o_orderkey WHERE l_linenumber = 3 AND l_quantity > 45",
    "renders": "SELECT o_custkey AS route, o_orderkey AS component FROM o",
    "sight": "SELECT DISTINCT literal AS value, false AS pattern, user_file AS file, event_id AS line FROM ev WHERE k % 3 <> 0 UNION SELECT head, true, user_file, event_id FROM ev WHERE event_type IN ('click', 'view') AND k % 10 = 0",
    "loc": "SELECT DISTINCT event_type AS module, literal AS value, 'loc_' || literal AS name, 'e2e/pages/' || event_type || '.locators.ts' AS file, length(literal) AS line FROM ev WHERE k % 4 = 0",
    "tid": "SELECT value, pattern FROM sight UNION SELECT value, false FROM loc",
    "spec": "SELECT DISTINCT event_type, 'spec ' || event_type || ' ' || user_id % 10 AS name, 'e2e/tests/u' || user_id % 10 || '.spec.ts' AS file, length(event_type) * 10 + ascii(event_type) AS line, 'test' AS kind FROM ev",
    "doc": "SELECT doc_id AS id, CAST(doc_id AS VARCHAR) AS name, 'docs/' || doc_id || '.md' AS file, CASE WHEN length(split_part(text, chr(10), 1)) <= 200 THEN split_part(text, chr(10), 1) END AS title, n_chars AS size, list_filter(string_split(text, chr(10)), lambda x: length(x) BETWEEN 1 AND 40) AS headings FROM documents",
    "scss": "SELECT page_id AS id, url AS file, list_sort(list_distinct(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))) AS classes, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages",
    "litcov": "SELECT t.value, t.pattern FROM tid t WHERE NOT t.pattern AND t.value IN (SELECT value FROM loc)",
    "cov": "SELECT value, pattern FROM litcov UNION SELECT t.value, t.pattern FROM tid t WHERE t.pattern AND EXISTS (SELECT 1 FROM litcov l WHERE starts_with(l.value, t.value))",
}
_USES = {"pagefiles": "o", "domain": "o", "component": "o", "fhook": "o", "fop": "o", "renders": "o", "sight": "ev", "loc": "ev", "tid": "sight loc", "spec": "ev", "litcov": "tid loc", "cov": "tid litcov"}


def _with(names: str, query: str) -> str:
    need: set[str] = set()

    def add(name: str) -> None:
        for n in _USES.get(name, "").split():
            add(n)
        need.add(name)

    for n in names.split():
        add(n)
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in _TABLES.items() if k in need) + "\n" + query


def _list(value: str, by: str | None = None) -> str:
    return f"coalesce(string_agg(DISTINCT {value}, ',' ORDER BY {value}), '')"


def _sub(value: str, rest: str) -> str:
    return f"(SELECT {_list(value)} FROM {rest})"


_PAGE_DIRS = "SELECT DISTINCT dir || '/' AS pre FROM pagefiles"
_HOOK, _OP, _SITE = "h.name || '|' || h.file", "op.symbol || '|' || op.gql_name", "f.file || '|' || f.line || '|' || f.col"


def _joined(*lists: str) -> str:
    """Lists one after another, each distinct in itself, as one sorted text."""
    parts = " UNION ALL ".join(f"SELECT DISTINCT {v} AS v FROM {rest}" for v, rest in lists)
    return f"(SELECT coalesce(string_agg(v, ',' ORDER BY v), '') FROM ({parts}))"


# By page directory, what lies below: each is needed for many anchors.
_BELOW = f"""dirs AS ({_PAGE_DIRS}),
dhook AS (SELECT DISTINCT pre, {_HOOK} AS v FROM dirs JOIN hook h ON starts_with(h.file, pre)),
dvia AS (SELECT DISTINCT pre, {_OP} AS v FROM dirs JOIN hook h ON starts_with(h.file, pre) JOIN wraps w ON w.hook = h.id JOIN op ON op.id = w.op),
dfile AS (SELECT DISTINCT pre, {_OP} AS v FROM dirs JOIN fop f ON starts_with(f.file, pre) JOIN op ON op.id = f.op),
dcomp AS (SELECT DISTINCT pre, {_OP} AS v FROM dirs JOIN component c ON starts_with(c.file, pre) JOIN cop ON cop.component = c.id JOIN op ON op.id = cop.op)"""


def _reach(anchor: str) -> str:
    """Lists by anchor id from its components (ac) and page directories (ap)."""
    lists = {
        "hooks": f"SELECT DISTINCT ac.a, 1 AS b, {_HOOK} AS v FROM ac JOIN chook ch ON ch.component = ac.c JOIN hook h ON h.id = ch.hook UNION SELECT DISTINCT ap.a, 2, v FROM ap JOIN dhook USING (pre)",
        "ops_direct": f"SELECT DISTINCT ac.a, 1 AS b, {_OP} AS v FROM ac JOIN cop ON cop.component = ac.c JOIN op ON op.id = cop.op UNION SELECT DISTINCT ap.a, 2, v FROM ap JOIN dfile USING (pre) UNION SELECT DISTINCT ap.a, 3, v FROM ap JOIN dcomp USING (pre)",
        "ops_via_hooks": f"SELECT DISTINCT ac.a, 1 AS b, {_OP} AS v FROM ac JOIN chook ch ON ch.component = ac.c JOIN wraps w ON w.hook = ch.hook JOIN op ON op.id = w.op UNION SELECT DISTINCT ap.a, 2, v FROM ap JOIN dvia USING (pre)",
    }
    return ",\n".join(f"l_{k} AS (SELECT a, string_agg(v, ',' ORDER BY v) AS {k} FROM ({v}) GROUP BY a)" for k, v in lists.items())


_JOIN3 = " ".join(f"LEFT JOIN l_{k} ON l_{k}.a = x.a" for k in ("hooks", "ops_direct", "ops_via_hooks"))
_COL3 = ", ".join(f"coalesce({k}, '') AS {k}" for k in ("hooks", "ops_direct", "ops_via_hooks"))
_ALL = "pagefiles component route op hook wraps chook cop fop renders permission"

ORACLE_SQL: dict[str, str] = {
    "Q-01_gql_operations": _with("op hook wraps", f"SELECT symbol, gql_name, kind, file, line, exported, {_sub('h.name', 'wraps w JOIN hook h ON h.id = w.hook WHERE w.op = op.id')} AS hooks FROM op WHERE kind = 'query' AND (lower(symbol) LIKE '%1%' OR lower(gql_name) LIKE '%1%') ORDER BY symbol, gql_name, id LIMIT 500"),
    "Q-02_gql_hook_info": _with("op hook wraps fhook", f"SELECT name, file, line, {_sub(_OP + chr(32) + '|| ' + repr('|') + ' || op.kind', 'wraps w JOIN op ON op.id = w.op WHERE w.hook = hook.id')} AS operations, {_sub(_SITE, 'fhook f WHERE f.hook = hook.id')} AS callers FROM hook WHERE name = 'use7'"),
    "Q-03_gql_callsites_operation": _with("op fop", f"SELECT 'operation' AS target_kind, symbol || '|' || file || '|' || line AS definition, {_sub(_SITE, 'fop f WHERE f.op = op.id')} AS callsites FROM op WHERE symbol = 'OP_8'"),
    "Q-04_gql_callsites_hook": _with("hook fhook", f"SELECT 'hook' AS target_kind, name || '|' || file || '|' || line AS definition, {_sub(_SITE, 'fhook f WHERE f.hook = hook.id')} AS callsites FROM hook WHERE name = 'use8'"),
    "Q-05_routes_list": _with("route renders permission", f"SELECT path, index, depth, route.file, route.line, {_sub(repr('C') + ' || r.component', 'renders r WHERE r.route = route.id')} AS components, c_mktsegment AS guards, p.key AS permissions FROM route JOIN customer ON c_custkey = id JOIN permission p ON p.nation = c_nationkey WHERE path LIKE '/building%' ORDER BY path, depth, id LIMIT 5000"),
    "Q-06_routes_resolve": _with(_ALL, f""", {_BELOW},
ac AS (SELECT route AS a, component AS c FROM renders),
ap AS (SELECT DISTINCT route AS a, dir || '/' AS pre FROM renders JOIN o ON o_orderkey = component), {_reach('route')}
SELECT path, index, depth, file, line, c_mktsegment AS guards, p.key AS permissions, {_sub("'C' || r.component", 'renders r WHERE r.route = x.a')} AS components, {_COL3}
FROM (SELECT id AS a, route.*, c_mktsegment, c_nationkey FROM route JOIN customer ON c_custkey = id) x JOIN permission p ON p.nation = x.c_nationkey {_JOIN3}""".replace("file, line, c_mkt", "x.file, x.line, c_mkt")).replace("\n,", ",", 1),
    "Q-07_routes_by_component": _with("component route renders", "SELECT name AS component, component.file, component.line, coalesce(r.path, '') AS routes FROM component JOIN renders x ON x.component = component.id LEFT JOIN route r ON r.id = x.route"),
    "Q-08_permissions_list": _with("permission route", f"SELECT key, coalesce(array_to_string(roles, ','), '') AS roles, file, line, {_sub('r.path', 'route r JOIN customer ON c_custkey = r.id WHERE c_nationkey = permission.nation')} AS routes FROM permission"),
    "Q-09_permission_info": _with("permission route", f"SELECT key || '|' || file || '|' || line AS permission, coalesce(array_to_string(roles, ','), '') AS roles, {_sub('r.path', 'route r JOIN customer ON c_custkey = r.id WHERE c_nationkey = permission.nation')} AS routes, coalesce(array_to_string(roles, ','), '') AS roles_via_edges FROM permission WHERE key = 'africa.nation_0'"),
    "Q-10_roles_list": _with("permission", "SELECT code, count(DISTINCT key) AS permission_count FROM (SELECT key, unnest(roles) AS code FROM permission) GROUP BY code"),
    "Q-11_pages_list": _with("pagefiles route renders", f"SELECT domain, entity, dir, files, files AS subdirs, {_sub(repr('C') + ' || o_orderkey', 'o WHERE o.dir = pagefiles.dir')} AS components, {_sub('r.path', 'o JOIN route r ON r.id = o_custkey WHERE o.dir = pagefiles.dir')} AS routes FROM pagefiles"),
    "Q-12_page_get": _with(_ALL, f""", {_BELOW},
ac AS (SELECT dir AS a, o_orderkey AS c FROM o),
ap AS (SELECT dir AS a, dir || '/' AS pre FROM pagefiles), {_reach('dir')}
SELECT domain, entity, dir, files, files AS subdirs, {_sub("'C' || o_orderkey", 'o WHERE o.dir = x.a')} AS components, {_sub('r.path', 'o JOIN route r ON r.id = o_custkey WHERE o.dir = x.a')} AS routes, {_COL3}
FROM (SELECT dir AS a, * FROM pagefiles) x {_JOIN3}""").replace("\n,", ",", 1),
    "Q-13_domains_list": _with("domain pagefiles", "SELECT name, count(DISTINCT dir) AS pages FROM domain LEFT JOIN pagefiles ON domain = name GROUP BY name"),
    "Q-14_docs_list": _with("doc", "SELECT name, file, title, size, array_to_string(list_sort(headings), ',') AS headings FROM doc"),
    "Q-15_doc_get": "SELECT '7' AS name, 'docs/' || doc_id || '.md' AS file, text AS content FROM documents WHERE doc_id = 7",
    "Q-16_docs_search": _with("doc", "SELECT name, file, title, array_to_string(list_sort(list_filter(headings, lambda x: contains(lower(x), 'th'))), ',') AS matched_headings FROM doc WHERE contains(lower(name), 'th') OR contains(lower(coalesce(title, '')), 'th') OR len(list_filter(headings, lambda x: contains(lower(x), 'th'))) > 0"),
    "Q-17_e2e_specs": _with("spec", "SELECT name, file, line, kind, CASE WHEN event_type <> 'error' THEN event_type || 'Page' ELSE '' END AS poms FROM spec WHERE contains(lower(name), 'c') OR contains(lower(file), 'c') ORDER BY file, line, name LIMIT 500"),
    "Q-18_e2e_spec": _with("spec loc", f"SELECT name || '|' || file || '|' || line || '|' || kind AS spec, event_type || 'Page|e2e/pages/' || event_type || '.page.ts|' || {_sub('loc.name', 'loc WHERE loc.module = spec.event_type')} || '|' || {_sub('loc.value', 'loc WHERE loc.module = spec.event_type')} AS page_objects FROM spec WHERE file = 'e2e/tests/u3.spec.ts' AND event_type = 'click'"),
    "Q-19_e2e_testid_info": _with("tid sight loc spec", f"""SELECT 'click-60' AS value, {_sub("s.file || '|' || s.line", "sight s JOIN hit USING (value, pattern)")} AS sources, {_sub("loc.name || '|' || loc.file || '|' || loc.line", "loc JOIN lit USING (value)")} AS locators,
{_sub("loc.module || 'Page'", "loc JOIN lit USING (value)")} AS page_objects, {_sub("spec.name || '|' || spec.file || '|' || spec.line", "loc JOIN lit USING (value) JOIN spec ON spec.event_type = loc.module AND spec.event_type <> 'error'")} AS specs FROM (SELECT count(*) AS n FROM hit) WHERE n > 0""").replace("\nSELECT 'click", ",\nhit AS (SELECT * FROM tid WHERE (NOT pattern AND value = 'click-60') OR (pattern AND starts_with('click-60', value))),\nlit AS (SELECT DISTINCT t.value FROM tid t JOIN hit h ON (NOT h.pattern AND t.value = h.value) OR (h.pattern AND starts_with(t.value, h.value)) WHERE NOT t.pattern)\nSELECT 'click", 1),
    "Q-20_e2e_coverage": _with("tid sight loc cov", """, has AS (SELECT DISTINCT value, pattern FROM sight)
SELECT count(*) AS total, count(c.value) AS covered, count(*) - count(c.value) AS uncovered,
(SELECT count(*) FROM litcov l WHERE (l.value, l.pattern) NOT IN (SELECT value, pattern FROM has) AND NOT EXISTS (SELECT 1 FROM has h WHERE h.pattern AND starts_with(l.value, h.value))) AS stale_e2e_only
FROM has LEFT JOIN cov c ON c.value = has.value AND c.pattern = has.pattern""").replace("\n,", ",", 1),
    "Q-21_e2e_uncovered": _with("sight cov", "SELECT DISTINCT value, pattern, file, line FROM sight s WHERE NOT EXISTS (SELECT 1 FROM cov c WHERE c.value = s.value AND c.pattern = s.pattern) ORDER BY file, line, value, pattern LIMIT 5000"),
    "Q-22_e2e_uncovered_by_file": _with("sight cov", "SELECT file, count(*) AS count, string_agg(value || '|' || pattern || '|' || line, ',' ORDER BY value || '|' || pattern || '|' || line) AS testids FROM (SELECT DISTINCT value, pattern, file, line FROM sight s WHERE NOT EXISTS (SELECT 1 FROM cov c WHERE c.value = s.value AND c.pattern = s.pattern) ORDER BY file, line, value, pattern LIMIT 5000) GROUP BY file"),
    "Q-23_e2e_testid_search": _with("tid loc", "SELECT value, pattern, NOT pattern AND value IN (SELECT value FROM loc) AS has_locator FROM tid WHERE contains(lower(value), 'click') ORDER BY value, pattern LIMIT 500"),
    "Q-24_scss_list": _with("scss", "SELECT file, array_to_string(classes, ',') AS classes, host AS consumers FROM scss"),
    "Q-25_scss_class": _with("scss", "SELECT file AS module, host AS consumers FROM scss WHERE list_contains(classes, '/The')"),
    "Q-28_adhoc_impact": _with("component op wraps chook", "SELECT DISTINCT op.symbol, c.name AS component, c.file AS component_file FROM op JOIN wraps w ON w.op = op.id JOIN chook ch ON ch.hook = w.hook JOIN component c ON c.id = ch.component WHERE op.symbol = 'OP_8'"),
    "Q-29_adhoc_testid_spec": _with("tid loc spec", "SELECT DISTINCT loc.value, spec.name AS spec, spec.file AS spec_file FROM loc JOIN spec ON spec.event_type = loc.module AND spec.event_type <> 'error'"),
    "Q-30_adhoc_top_hooks": _with("hook chook", "SELECT name, count(DISTINCT component) AS users FROM hook JOIN chook ON chook.hook = hook.id GROUP BY name ORDER BY users DESC, name LIMIT 10"),
}
