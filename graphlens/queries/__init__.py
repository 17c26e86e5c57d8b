"""Named queries over the fixture graph of the driver's tables: lists as text, so that two engines compare alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.functions.columns import as_text
from graphlens.graph import Graph
from graphlens.queries import api, ops, texts
from graphlens.queries.fixture import PROJECT, fixture, table
from graphlens.queries.oracle import ORACLE_SQL as GRAPH_SQL

Query = Callable[[SparkSession, str], DataFrame]


def _on(ask: Callable[[Graph], DataFrame]) -> Query:
    return lambda spark, sf_dir: as_text(ask(fixture(spark, sf_dir)))


def _doc_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = table(spark, sf_dir, "documents").select(F.concat(F.lit("docs/"), "doc_id", F.lit(".md")).alias("path"), "text")
    return api.doc_get(sources, "7")


def _spec(g: Graph) -> DataFrame:
    return api.e2e_spec(g, PROJECT, "e2e/tests/u3.spec.ts", len("click") * 10 + ord("c"))


QUERIES: dict[str, Query] = {
    "Q-01_gql_operations": _on(lambda g: api.gql_operations(g, PROJECT, "query", "1")),
    "Q-02_gql_hook_info": _on(lambda g: api.gql_hook_info(g, PROJECT, "use7")),
    "Q-03_gql_callsites_operation": _on(lambda g: api.gql_callsites(g, PROJECT, "OP_8")),
    "Q-04_gql_callsites_hook": _on(lambda g: api.gql_callsites(g, PROJECT, "use8")),
    "Q-05_routes_list": _on(lambda g: api.routes_list(g, PROJECT, "/building", 5000)),
    "Q-06_routes_resolve": _on(lambda g: api.routes_resolve(g, PROJECT, texts=True)),
    "Q-07_routes_by_component": _on(lambda g: api.routes_by_component(g, PROJECT)),
    "Q-08_permissions_list": _on(lambda g: api.permissions_list(g, PROJECT)),
    "Q-09_permission_info": _on(lambda g: api.permission_info(g, PROJECT, "africa.nation_0")),
    "Q-10_roles_list": _on(lambda g: api.roles_list(g, PROJECT)),
    "Q-11_pages_list": _on(lambda g: api.pages_list(g, PROJECT)),
    "Q-12_page_get": _on(lambda g: api.page_get(g, PROJECT, texts=True)),
    "Q-13_domains_list": _on(lambda g: api.domains_list(g, PROJECT)),
    "Q-14_docs_list": _on(lambda g: api.docs_list(g, PROJECT)),
    "Q-15_doc_get": _doc_get,
    "Q-16_docs_search": _on(lambda g: api.docs_search(g, PROJECT, "th")),
    "Q-17_e2e_specs": _on(lambda g: api.e2e_specs(g, PROJECT, "c")),
    "Q-18_e2e_spec": _on(_spec),
    "Q-19_e2e_testid_info": _on(lambda g: api.e2e_testid_info(g, PROJECT, "click-60")),
    "Q-20_e2e_coverage": _on(lambda g: api.e2e_coverage(g, PROJECT)),
    "Q-21_e2e_uncovered": _on(lambda g: api.e2e_uncovered(g, PROJECT, 5000)),
    "Q-22_e2e_uncovered_by_file": _on(lambda g: api.e2e_uncovered_by_file(g, PROJECT, 5000)),
    "Q-23_e2e_testid_search": _on(lambda g: api.e2e_testid_search(g, PROJECT, "click", 500)),
    "Q-24_scss_list": _on(lambda g: api.scss_list(g, PROJECT)),
    "Q-25_scss_class": _on(lambda g: api.scss_class(g, PROJECT, "/The")),
    "Q-28_adhoc_impact": _on(lambda g: api.impact(g, PROJECT, "OP_8")),
    "Q-29_adhoc_testid_spec": _on(lambda g: api.specs_of_testids(g, PROJECT)),
    "Q-30_adhoc_top_hooks": _on(lambda g: api.top_hooks(g, PROJECT)),
}

QUERIES |= ops.QUERIES | texts.QUERIES
ORACLE_SQL: dict[str, str] = GRAPH_SQL | ops.ORACLE_SQL | texts.ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]
