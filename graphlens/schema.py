"""Node and edge tables of a code-intelligence graph: columns, natural keys, ends and owners."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class NodeSpec:
    """A node table. ``identity`` tells two nodes apart; ``owner`` is the extractor whose rebuild replaces them."""

    columns: str
    identity: tuple[str, ...]
    owner: str | None

    @property
    def schema(self) -> T.StructType:
        return T._parse_datatype_string(f"id long, project string, {self.columns}")


NODES = {
    "Project": NodeSpec("name string, root string, updated_at timestamp", ("name",), None),
    "GqlOperation": NodeSpec("symbol string, gql_name string, kind string, file string, line long, exported boolean", ("symbol", "gql_name", "file", "line"), "gql"),
    "GqlHook": NodeSpec("name string, file string, line long", ("name", "file", "line"), "gql"),
    "File": NodeSpec("path string", ("path",), None),
    "Route": NodeSpec("path string, index boolean, depth long, file string, line long", ("path", "depth", "file", "line"), "routes"),
    "Component": NodeSpec("name string, file string, line long, exported boolean", ("name", "file", "line"), "routes"),
    "Guard": NodeSpec("name string", ("name",), "routes"),
    "Permission": NodeSpec("key string, roles array<string>, file string, line long", ("key",), "routes"),
    "Role": NodeSpec("code string", ("code",), None),
    "Page": NodeSpec("domain string, entity string, dir string, files array<string>, subdirs array<string>", ("domain", "entity", "dir"), "pages"),
    "Domain": NodeSpec("name string", ("name",), "pages"),
    "Doc": NodeSpec("name string, file string, title string, size long, headings array<string>", ("name", "file"), "docs"),
    "E2eSpec": NodeSpec("name string, file string, line long, kind string", ("name", "file", "line"), "e2e"),
    "PageObject": NodeSpec("name string, file string", ("name", "file"), "e2e"),
    "TestIdLoc": NodeSpec("name string, module string, value string, parametric boolean, file string, line long", ("name", "file", "line"), "e2e"),
    "TestId": NodeSpec("value string, pattern boolean, template string", ("value", "pattern"), "e2e"),
    "ScssModule": NodeSpec("file string, classes array<string>", ("file",), "scss"),
}

#: (type, source label, target label): property columns.
EDGES: dict[tuple[str, str, str], str] = {
    ("WRAPS", "GqlHook", "GqlOperation"): "",
    ("USES_OPERATION", "File", "GqlOperation"): "line long, col long",
    ("USES_OPERATION", "Component", "GqlOperation"): "",
    ("CALLS_HOOK", "File", "GqlHook"): "line long, col long",
    ("CALLS_HOOK", "Component", "GqlHook"): "",
    ("CHILD_OF", "Route", "Route"): "",
    ("RENDERS", "Route", "Component"): "",
    ("GUARDED_BY", "Route", "Guard"): "",
    ("REQUIRES", "Route", "Permission"): "",
    ("GRANTED_TO", "Permission", "Role"): "",
    ("IN_DOMAIN", "Page", "Domain"): "",
    ("BELONGS_TO", "Component", "Page"): "",
    ("HAS_FILE", "Page", "File"): "",
    ("USES_POM", "E2eSpec", "PageObject"): "",
    ("DEFINES_LOC", "PageObject", "TestIdLoc"): "",
    ("RESOLVES_TO", "TestIdLoc", "TestId"): "",
    ("HAS_TESTID", "File", "TestId"): "line long",
    ("USES_SCSS", "File", "ScssModule"): "",
}


def edge_schema(key: tuple[str, str, str]) -> T.StructType:
    return T._parse_datatype_string("project string, src long, dst long" + (f", {EDGES[key]}" if EDGES[key] else ""))
