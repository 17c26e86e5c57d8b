"""Where a project's code lives: the environment (PROJECT_<NAME>, ROUTER_FILES_<NAME>), its repository, its compiler's paths."""

from __future__ import annotations

import json
import os
import re
import tempfile
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# What marks a repository's root, and where a project's compiler configuration may be.
REPO_MARKERS = (".git", "pnpm-workspace.yaml", "lerna.json", "nx.json", "rush.json", "turbo.json")
COMPILER_FILES = ("tsconfig.json", "tsconfig.app.json", "../tsconfig.json")


@dataclass(frozen=True)
class ProjectConfig:
    name: str
    code_root: str
    #: Root-relative files that hold the route tree.
    router_files: tuple[str, ...] = ("src/router/index.tsx",)
    options: Mapping[str, str] = field(default_factory=dict)


def projects(environment: Mapping[str, str] | None = None) -> dict[str, ProjectConfig]:
    """The configured projects by name, lower case."""
    env = os.environ if environment is None else environment
    found = {}
    for key, root in env.items():
        if key.startswith("PROJECT_") and root:
            name = key.removeprefix("PROJECT_")
            files = tuple(x.strip() for x in env.get(f"ROUTER_FILES_{name}", "").split(",") if x.strip())
            found[name.lower()] = ProjectConfig(name.lower(), root.rstrip("/"), files or ProjectConfig.router_files)
    return found


def folder_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever store the path names."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)


def repo_root(spark: SparkSession, code_root: str) -> str:
    """The nearest folder above the code root that a marker makes a repository's root; else two levels up."""
    scheme, _, bare = code_root.rstrip("/").rpartition("://")
    parts = bare.split("/")
    above = [f"{scheme}://" * bool(scheme) + "/".join(parts[:k]) for k in range(len(parts) - 1, 0, -1) if "/".join(parts[:k])]
    for folder in above:
        if any(folder_exists(spark, f"{folder}/{m}") for m in REPO_MARKERS):
            return folder
    return above[min(1, len(above) - 1)]


def _settings(spark: SparkSession, path: str, seen: tuple[str, ...] = ()) -> dict:
    """A compiler configuration with what it extends: its own settings over theirs, files and patterns by absolute path.

    The files are small and read whole; comments and trailing commas are allowed. Configurations of packages are not followed.
    """
    text = spark.read.text(path, wholetext=True).first()[0]
    bare = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.DOTALL)
    own = json.loads(re.sub(r",(\s*[}\]])", r"\1", bare))
    folder = path.rsplit("/", 1)[0]
    found: dict = {"compilerOptions": {}}
    above = own.get("extends", [])
    for name in [above] if isinstance(above, str) else above:
        target = _joined(folder, name if name.endswith(".json") else f"{name}.json")
        if name.startswith(".") and target not in seen and folder_exists(spark, target):
            more = _settings(spark, target, (*seen, path))
            found = {**found, **more, "compilerOptions": {**found["compilerOptions"], **more["compilerOptions"]}}
    options = own.get("compilerOptions", {})
    found["compilerOptions"] = {**found["compilerOptions"], **options}
    if "paths" in options or "baseUrl" in options:
        found["paths_folder"] = folder
    for key in ("files", "include", "exclude"):
        if key in own:
            found[key] = [_joined(folder, x) for x in own[key]]
    if "outDir" in options:
        found["out"] = _joined(folder, options["outDir"])
    return found


def _joined(folder: str, relative: str) -> str:
    """A path relative to a folder, without . and .. parts."""
    parts = folder.split("/")
    for part in relative.split("/"):
        if part == "..":
            parts.pop()
        elif part not in ("", "."):
            parts.append(part)
    return "/".join(parts)


def compiler_settings(spark: SparkSession, code_root: str) -> dict | None:
    """The settings of the first of the usual configuration files that is there."""
    root = code_root.rstrip("/")
    for name in COMPILER_FILES:
        if folder_exists(spark, f"{root}/{name}"):
            return _settings(spark, _joined(root, name))
    return None


def compiler_aliases(spark: SparkSession, code_root: str) -> tuple[tuple[str, str], ...]:
    """(beginning of a module name, root-relative path) of the compiler's path mappings, the longest first; else @/ for src/."""
    settings = compiler_settings(spark, code_root) or {"compilerOptions": {}}
    options, root = settings["compilerOptions"], code_root.rstrip("/") + "/"
    base = _joined(settings.get("paths_folder", ""), options.get("baseUrl", "."))
    found = {}
    for head, targets in options.get("paths", {}).items():
        if head.endswith("*") and targets:
            target = _joined(base, targets[0].removesuffix("*")) + "/"
            if target.startswith(root):  # modules outside the code root are not of the project
                found[head.removesuffix("*")] = target.removeprefix(root)
    return tuple(sorted(found.items(), key=lambda x: (-len(x[0]), x[0]))) or (("@/", "src/"),)


#: Folders that a configuration without exclusions leaves out.
UNREAD = ("node_modules", "bower_components", "jspm_packages")


def _pattern(path: str) -> str:
    """A configuration's path pattern as a regular expression; one without wildcard or ending in its last part is a folder."""
    last = path.rsplit("/", 1)[-1]
    if "*" not in last and "?" not in last and "." not in last:
        path += "/**/*"
    out = re.escape(path).replace(re.escape("**/"), "(?:[^/]+/)*").replace(re.escape("*"), "[^/]*").replace(re.escape("?"), "[^/]")
    return f"^{out}$"


def compiler_files(spark: SparkSession, code_root: str) -> Column | None:
    """Which root-relative paths (column path) the compiler's configuration lists: a predicate; None if all below the root are.

    Listed files always are; others if an inclusion fits them and no exclusion does. Without inclusions all files are
    included, or none where files are listed; without exclusions package folders and the output folder are left out.
    """
    settings = compiler_settings(spark, code_root)
    if settings is None or not any(k in settings for k in ("files", "include", "exclude", "out")):
        return None
    root = code_root.rstrip("/")
    path = F.concat(F.lit(root + "/"), F.col("path"))
    included = settings.get("include", [] if "files" in settings else [f"{root}/**/*"])
    excluded = settings.get("exclude", [*[f"{root}/**/{x}" for x in UNREAD], *([settings["out"]] if "out" in settings else [])])
    fits = lambda patterns: F.lit(False) if not patterns else path.rlike("|".join(_pattern(x) for x in patterns))
    return path.isin(settings.get("files", [])) | (fits(included) & ~fits(excluded))


def shared_folder(spark: SparkSession) -> str:
    """A new folder for tables on their way, where all executors see it: below spark.checkpoint.dir; a local one in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="graphlens-tables-")
    return f"{base}/{uuid.uuid4().hex}"
