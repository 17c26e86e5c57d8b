"""From a source tree to a graph: texts to record batches, batches to tables, each extractor written as its own job."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Mapping
from dataclasses import asdict
from time import monotonic

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphlens.graph import Graph, Later
from graphlens.operators import extract, literals, symbols
from graphlens.operators.trees import Keep, checkpointed
from graphlens.plans.build import OWNED, Batches, build, rebuild
from graphlens.sources.config import ProjectConfig, compiler_aliases, compiler_files, folder_exists, projects, repo_root
from graphlens.sources.records import BATCHES, OPTIONAL
from graphlens.sources.text import list_files, read_texts, rejected_files

# Where a repository keeps its documents and tests.
DOC_FOLDERS = ("CLAUDE",)
ROOT_DOCS = ("README.md", "CLAUDE.md")
TEST_FOLDER = "e2e"


class Sources:
    """A project's texts (project, path, text): of its code root, and of its repository, whose paths differ.

    projects (name, root); code: TypeScript below the code root; styles: style modules below its src; files: its listing
    (project, path); app: TypeScript below its src, by its path in the repository; tests: test, page-object and locator files,
    docs: documents, by their path in the repository. Each is a DataFrame, or a function that gives one when it is asked for.
    """

    def __init__(self, **tables: DataFrame | Callable[[], DataFrame]):
        self._tables = Later(tables)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._tables:
            raise AttributeError(name)
        return self._tables[name]



def record_batches(sources: Sources, router_files: tuple[str, ...] = ProjectConfig.router_files, aliases: tuple[tuple[str, str], ...] = (("@/", "src/"),), keep: Keep = checkpointed, listed: Column | None = None) -> Batches:
    """All record batches of the texts, each planned when it is first asked for, over the files that can hold its facts.

    The code's tokens are listed by kinds of files, so that an extractor lists those of its own files only; the files of components
    are known late and listed again, unless the compiler's choice has all listed before. ``keep`` is given every batch and every table that
    others are made from: by default it checkpoints them, ``reindex`` writes them. ``listed``, a predicate over path, says which
    code files the compiler is given; those that their imports lead to are read too, other code is not.
    """
    here = F.col("path")
    found = Later()

    def table(name: str, make: Callable[[], DataFrame]) -> None:
        found.later(name, lambda: keep(name, make()))

    def batch(name: str, make: Callable[[], DataFrame]) -> None:
        table(name, lambda: make().select(*T._parse_datatype_string(BATCHES[name] + OPTIONAL.get(name, "")).names))

    # Files whose tokens some extractors read without the others'.
    kinds = {"router_tokens": here.isin(*router_files), "permission_tokens": extract.in_permissions(), "hook_tokens": here.contains("/gql/hooks/")}
    if listed is None:
        code = lambda: sources.code
        table("component_tokens", lambda: literals.tokens(sources.code.join(component_paths(), ["project", "path"], "left_semi")))
        rest = F.lit(True)
        parts = {}
        for name, kind in kinds.items():
            table(name, lambda kind=kind: literals.tokens(sources.code.where(kind)))
            parts[name] = rest
            rest = rest & ~kind
        table("other_tokens", lambda: literals.tokens(sources.code.where(rest)))
        found.later("tokens", lambda: functools.reduce(DataFrame.unionByName, [found["other_tokens"], *[found[k].where(v) for k, v in parts.items()]]))
    else:
        table("all_tokens", lambda: literals.tokens(sources.code))
        table("program", lambda: symbols.program(found["all_tokens"], sources.code.select("project", "path"), listed, aliases, keep))
        code = lambda: sources.code.join(found["program"], ["project", "path"], "left_semi")
        found.later("tokens", lambda: found["all_tokens"].join(found["program"], ["project", "path"], "left_semi"))
        found.later("component_tokens", lambda: found["tokens"].join(component_paths(), ["project", "path"], "left_semi"))
        for name, kind in kinds.items():
            found.later(name, lambda kind=kind: found["tokens"].where(kind))
    router = lambda rows: rows.where(here.isin(*router_files))
    files = lambda: code().select("project", "path")

    def component_files() -> DataFrame:
        shown = found["routes"].select("project", F.explode("components").alias("name")).distinct()
        return extract.resolved_components(extract.component_imports(found["router_tokens"]), files(), aliases).join(shown, ["project", "name"], "left_semi")

    def component_paths() -> DataFrame:
        return found["component_files"].select("project", F.col("file").alias("path")).distinct()

    def components() -> DataFrame:
        tokens = found["component_tokens"]
        parts = extract.component_lines(found["component_files"], tokens)
        parts = extract.named_in(parts, tokens, found["hooks"].select("project", F.col("name").alias("token")), "hookCalls")
        parts = extract.named_in(parts, tokens, found["operations"].select("project", F.col("symbol").alias("token")), "operationRefs")
        return parts.withColumn("exported", F.lit(True))

    def test_files(pattern: str) -> DataFrame:
        return sources.tests.where(here.rlike(pattern))

    table("component_files", component_files)
    batch("projects", lambda: sources.projects)
    batch("operations", lambda: extract.operations(code()))
    batch("hooks", lambda: extract.hooks(found["hook_tokens"], found["operations"]))
    batch("callsites", lambda: extract.callsites(found["tokens"], files(), found["operations"], found["hooks"], aliases, keep))
    batch("routes", lambda: extract.routes(keep("route_nodes", extract.route_nodes(router(code()), extract.enum_members(code()), found["router_tokens"])), keep))
    batch("components", components)
    batch("permissions", lambda: extract.permissions(keep("permission_entries", extract.permission_entries(code(), found["permission_tokens"])), keep))
    batch("pages", lambda: extract.pages(sources.files))
    batch("docs", lambda: extract.docs(sources.docs))
    batch("specs", lambda: extract.specs(test_files(f"^{TEST_FOLDER}/tests/.*\\.spec\\.ts$")))
    batch("page_objects", lambda: extract.page_objects(test_files(f"^{TEST_FOLDER}/pages/[^/]*\\.page\\.ts$")))
    batch("locators", lambda: extract.locators(test_files(r"\.locators\.ts$")))
    batch("testids", lambda: extract.app_testids(sources.app))
    batch("scss", lambda: extract.style_modules(sources.styles))
    batch("scss_imports", lambda: extract.style_imports(sources.code, found["scss"]))
    # Only batches are for the graph; tables they share are made when a batch asks for them.
    return _Only(found, set(BATCHES))


class _Only(Mapping):
    """Some keys of a mapping; values are made when they are asked for."""

    def __init__(self, whole: Later, keys: set[str]):
        self._whole, self._keys = whole, [k for k in whole if k in keys]

    def __getitem__(self, key: str) -> DataFrame:
        if key not in self._keys:
            raise KeyError(key)
        return self._whole[key]

    def __iter__(self):
        return iter(self._keys)

    def __len__(self) -> int:
        return len(self._keys)


def writer(spark: SparkSession, folder: str) -> Keep:
    """Write a table once and go on from there; one that cannot be written raises to whoever asks for it."""

    def keep(name: str, rows: DataFrame) -> DataFrame:
        rows.write.parquet(f"{folder}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{folder}/{name}")

    return keep


def read_project(spark: SparkSession, config: ProjectConfig) -> Sources:
    """The texts of a configured project, from wherever Spark's readers reach; folders that are missing give no rows."""
    root, name = config.code_root, config.name
    repo = repo_root(spark, root)
    none = spark.createDataFrame([], "project string, path string, text string")

    def below(folder: str, base: str, pattern: str, recursive: bool = True) -> DataFrame:
        if not folder_exists(spark, folder):
            return none
        inside = folder.removeprefix(base).strip("/")
        rows = read_texts(spark, folder, pattern, name, recursive)
        return rows.withColumn("path", F.concat(F.lit(f"{inside}/"), "path")) if inside else rows

    def docs() -> DataFrame:
        found = none
        for folder in DOC_FOLDERS:
            found = found.unionByName(below(f"{repo}/{folder}", repo, "*.md", recursive=False))
        return found.unionByName(below(repo, repo, "*.md", recursive=False).where(F.col("path").isin(*ROOT_DOCS)))

    # Folders are listed when an extractor asks for them: one that cannot be read is that extractor's failure.
    return Sources(
        projects=spark.createDataFrame([(name, root)], "name string, root string"),
        code=lambda: below(root, root, "*.{ts,tsx}"),
        styles=lambda: below(f"{root}/src", root, "*.module.scss"),
        files=lambda: list_files(spark, root, name).select("project", "path"),
        app=lambda: below(f"{root}/src", repo, "*.{ts,tsx}"),
        tests=lambda: below(f"{repo}/{TEST_FOLDER}", repo, "*.ts"),
        docs=docs,
    )


def reindex(spark: SparkSession, config: ProjectConfig, folder: str) -> dict:
    """Read a project's tree, build its graph and publish it in ``folder`` beside the other projects there.

    Each extractor's tables are written as a job of its own: one that fails, while its batches are made, planned or
    written, is reported and leaves the others' tables, and its own old ones, as they are. Only the project's own tables
    are written. The answer has, per extractor, name, ok, error, seconds and the rows written; the source files; how many
    files were not readable or no UTF-8; the version published.
    """
    began = monotonic()
    if not folder_exists(spark, config.code_root):
        raise LookupError(f"no such code root: {config.code_root}")
    sources = read_project(spark, config)
    staging = f"{folder}/staging/{uuid.uuid4().hex}"
    batches = record_batches(sources, config.router_files, compiler_aliases(spark, config.code_root), writer(spark, f"{staging}/batches"), compiler_files(spark, config.code_root))
    graph, report = build(spark, batches, staging)
    if folder_exists(spark, f"{folder}/published"):
        failed = {label for r in report if not r["ok"] for label in OWNED[r["name"]]}
        graph = rebuild(Graph.load(spark, folder), graph, config.name, keep=failed)
    version = graph.save(folder, config.name)
    files = sources.files.where(F.col("path").rlike(r"\.tsx?$") & ~F.array_contains(F.split("path", "/"), "node_modules"))
    rejected = {r["reason"]: r["n"] for r in rejected_files(sources.code, files).groupBy("reason").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {"project": asdict(config), "version": version, "source_files": files.count(), "rejected": rejected, "extractors": report, "seconds": monotonic() - began}


def reindex_all(spark: SparkSession, folder: str, environment: Mapping[str, str] | None = None, project: str | None = None) -> list[dict]:
    """``reindex`` for every configured project, or the one of this name; LookupError if there is none.

    A project that fails as a whole (no code root, a graph that is not sound) is reported with its error, and the next goes on.
    """
    targets = [c for c in projects(environment).values() if project is None or c.name == project]
    if not targets:
        raise LookupError(f"project not configured: {project}")
    answers = []
    for config in targets:
        try:
            answers.append(reindex(spark, config, folder))
        except Exception as error:  # noqa: BLE001  reported to the caller
            answers.append({"project": asdict(config), "error": f"{type(error).__name__}: {error}"})
    return answers


__all__ = ["Batches", "Sources", "read_project", "record_batches", "reindex", "reindex_all"]
