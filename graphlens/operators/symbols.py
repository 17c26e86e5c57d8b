"""Names and what they stand for: statements, declarations and their extents, imports and exports, references by binding.

All from the token rows of ``literals.tokens``. A reference is an identifier whose binding leads to a symbol's declaration,
through imports, aliases and re-exports, and that no local declaration hides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlens.functions.paths import directory, resolve
from graphlens.operators import literals

_FILE = ["project", "path"]
_STMT = [*_FILE, "stmt"]
_DECLARATION = [*_FILE, "name", "n", "line", "stmt", "word", "exported", "default", "until"]
#: What a module's name may lack of its file's path, in the order of preference.
ENDINGS = ("", ".tsx", ".ts", ".jsx", "/index.tsx", "/index.ts")
Aliases = tuple[tuple[str, str], ...]
Keep = Callable[[str, DataFrame], DataFrame]


def is_name() -> Column:
    return F.col("is_name")


def _unquoted(token: Column) -> Column:
    return F.substring(token, F.lit(2), F.length(token) - 2)


# --- declarations -------------------------------------------------------------------------------------------------


def declarations(found: DataFrame) -> DataFrame:
    """Top-level functions, classes, enums and variables: (project, path, name, n, line, stmt, word, exported, default, until).

    A declarator runs from its name (token n) to the next one's of its statement; ``until`` is its last token.
    """
    named = F.col("word").isin("function", "class", "enum") & (F.col("prev").isin("function", "class", "enum") | ((F.col("prev") == "*") & (F.col("prev2") == "function")))
    variable = F.col("word").isin("const", "let", "var") & (F.col("prev").isin("const", "let", "var") | ((F.col("prev") == ",") & F.col("next").isin("=", ":")))
    exported = F.col("head") == "export"
    rows = found.where((F.col("level") == 0) & is_name() & (named | variable))
    rows = rows.select(*_STMT, "token", "n", "line", "word", "end", exported.alias("exported"), (exported & (F.col("second") == "default")).alias("default"))
    following = F.lead("n").over(Window.partitionBy(*_STMT).orderBy("n"))
    return rows.select(*_FILE, F.col("token").alias("name"), "n", "line", "stmt", "word", "exported", "default", F.coalesce(following - 1, F.col("end")).alias("until"))


def functions(found: DataFrame) -> DataFrame:
    """The declarations that are functions, with the range (body, stop) of the tokens of what the function does.

    A function's body is its braces. An arrow's is what stands behind it: the braces, or all to the declarator's end. A
    variable is a function if an arrow function or the word function stands right behind its sign of equality.
    """
    said = F.col("word").isin("const", "let", "var", "function")
    own = declarations(found).where(said)
    top = found.where((F.col("level") == 0) & said).select(*_STMT, F.col("n").alias("at"), "token", "prev", "close")
    rows = own.join(top, _STMT).where("at > n and at <= until")
    # The tokens of a declarator outside all brackets; behind an opening bracket comes what follows its counterpart.
    listed = rows.groupBy(*_DECLARATION).agg(F.array_sort(F.collect_list(F.struct("at", "token", "prev", "close"))).alias("t"))
    after = lambda list_, k: F.slice(list_, k + 1, F.greatest(F.size(list_) - k, F.lit(0)))
    place = lambda list_, token: F.array_position(F.transform(list_, lambda x: x["token"]), token)
    value = F.when(F.col("word") == "function", F.col("t")).otherwise(F.when(place(F.col("t"), "=") > 0, after(F.col("t"), place(F.col("t"), "="))))
    listed = listed.withColumn("t", value).where("t is not null")
    listed = listed.withColumn("t", F.when(F.get("t", F.lit(0))["token"] == "async", after(F.col("t"), F.lit(1))).otherwise(F.col("t")))
    first, second, arrow = F.get("t", F.lit(0)), F.get("t", F.lit(1)), place(F.col("t"), "=>")
    spoken = (F.col("word") == "function") | (first["token"] == "function")
    is_arrow = (arrow > 0) & (((first["token"] == "(") & second["token"].isin("=>", ":")) | (first["token"] == "<") | (first["token"].rlike(literals.NAME) & (second["token"] == "=>")))
    brace = F.get(F.filter("t", lambda x: (x["token"] == "{") & ~x["prev"].isin(":", "|", "&", "=>", "<", ",", "=", "extends")), F.lit(0))
    behind = F.get("t", arrow.cast("int"))
    body = F.when(spoken, brace).when(is_arrow, behind)
    listed = listed.withColumn("b", body).where("b is not null")
    return listed.select(*_DECLARATION, F.col("b.at").alias("body"), F.when(F.col("b.token") == "{", F.col("b.close")).otherwise(F.col("until")).alias("stop"))


# --- modules ------------------------------------------------------------------------------------------------------


def resolved_modules(specs: DataFrame, files: DataFrame, aliases: Aliases) -> DataFrame:
    """(project, path, spec, module): the file that a module name means in a file, by its path, with an ending, or as a folder's index.

    ``aliases`` are beginnings of module names and the root-relative paths that they stand for; the first that fits counts.
    """
    target = resolve(directory(F.col("path")), F.col("spec"))
    for head, folder in reversed(aliases):
        target = F.when(F.col("spec").startswith(head), F.concat(F.lit(folder), F.substring("spec", len(head) + 1, 1 << 20))).otherwise(target)
    tries = specs.select(*_FILE, "spec").distinct().withColumn("t", target)
    tries = tries.withColumn("try", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.concat("t", F.lit(e)).alias("module")) for k, e in enumerate(ENDINGS)])))
    hit = tries.select(*_FILE, "spec", "try.module", "try.k").join(files.select("project", F.col("path").alias("module")), ["project", "module"], "left_semi")
    return hit.groupBy(*_FILE, "spec").agg(F.min_by("module", "k").alias("module"))


def module_names(found: DataFrame) -> DataFrame:
    """What import and export statements name: (project, path, stmt, kind, name, local, spec, n).

    kind is import or export; name is the other module's or the exported name (default; * for all), local the name here;
    n is the token of the name that is not of this file's own making.
    """
    rows = found.where("level <= 1 and (head = 'import' or (head = 'export' and second in ('{', '*', 'type', 'default')))")
    # Few tokens can be a name or a module there; the others are put aside before they are looked at more closely.
    rows = rows.where(F.col("next").isin(",", "}", "from") | F.col("prev").isin("default", "from", "import", "as"))
    quoted = (F.col("token").startswith("'") | F.col("token").startswith('"')) & F.col("prev").isin("from", "import") & (F.col("level") == 0)
    module = F.when(quoted, _unquoted(F.col("token")))
    begins = F.col("prev").isin("{", ",") | ((F.col("prev") == "type") & F.col("prev2").isin("{", ","))
    ends = F.col("next").isin(",", "}")
    inside = (F.col("level") == 1) & is_name()
    mine = F.col("head") == "import"
    plain = inside & begins & ends
    renamed = inside & (F.col("prev") == "as") & ends
    default = mine & (F.col("level") == 0) & is_name() & F.col("next").isin(",", "from") & ((F.col("prev") == "import") | ((F.col("prev") == "type") & (F.col("prev2") == "import")))
    space = mine & (F.col("level") == 0) & (F.col("prev") == "as") & (F.col("prev2") == "*")
    star = ~mine & (F.col("level") == 0) & (F.col("token") == "*") & (F.col("next") == "from")
    set_default = ~mine & (F.col("second") == "default") & (F.col("level") == 0) & (F.col("prev") == "default") & is_name() & ~F.col("token").isin("function", "class", "async", "abstract")
    one = lambda name, local, at: F.struct(F.lit(name).alias("name") if isinstance(name, str) else name.alias("name"), local.alias("local"), at.alias("at"))
    token, other, n = F.col("token"), F.col("prev2"), F.col("n")
    said = (
        F.when(plain, one(token, token, n))
        .when(renamed & mine, one(other, token, n - 2))
        .when(renamed, one(token, other, n - 2))
        .when(default, one("default", token, n))
        .when(space, one("*", token, n))
        .when(star, one("*", F.lit(None).cast("string"), n))
        .when(set_default, one("default", token, n))
    )
    listed = rows.select(*_STMT, "head", said.alias("said"), module.alias("module")).where("said is not null or module is not null")
    listed = listed.withColumn("spec", F.min("module").over(Window.partitionBy(*_STMT))).where("said is not null")
    return listed.select(*_STMT, F.when(mine, "import").otherwise("export").alias("kind"), "said.name", "said.local", "spec", F.col("said.at").alias("n"))


def _doubled(rows: DataFrame, keep: Keep) -> DataFrame:
    """(project, path, name, to_path, to_name): every name's pointer led on to where it ends (null pointers end at themselves).

    Pointers are followed two at a time, so the rounds are the logarithm of the longest way. A pointer to a name that is not
    there, or into a ring, leads nowhere and is left out.
    """
    key = [*_FILE, "name"]
    now = keep("exports_led_0", rows.select(*key, F.coalesce("to_path", "path").alias("to_path"), F.when(F.col("to_path").isNull(), F.col("name")).otherwise(F.col("to_name")).alias("to_name"), F.col("to_path").isNull().alias("ended")))
    for k in range(1, 33):
        if now.where("not ended").isEmpty():
            break
        step = now.select("project", F.col("path").alias("to_path"), F.col("name").alias("to_name"), F.col("to_path").alias("next_path"), F.col("to_name").alias("next_name"), F.col("ended").alias("then"))
        led = now.where("not ended").join(step, ["project", "to_path", "to_name"])
        led = led.select(*key, F.col("next_path").alias("to_path"), F.col("next_name").alias("to_name"), F.col("then").alias("ended"))
        # What points at itself again is a ring.
        now = keep(f"exports_led_{k}", now.where("ended").unionByName(led.where("ended or to_path <> path or to_name <> name")))
    return now.where("ended").drop("ended")


def reachable(steps: DataFrame, keep: Keep, name: str) -> DataFrame:
    """(project, path, module): the files that steps from file to file lead to, over ways of twice the length each round."""
    ways = keep(f"{name}_0", steps.select(*_FILE, "module").where("path <> module").distinct())
    many = ways.count()
    for k in range(1, 32):
        if not many:
            break
        more = ways.select("project", F.col("path").alias("start"), F.col("module").alias("path")).join(ways, _FILE).select("project", F.col("start").alias("path"), "module")
        ways = keep(f"{name}_{k}", ways.unionByName(more).where("path <> module").distinct())
        before, many = many, ways.count()
        if many == before:
            break
    return ways


def program(found: DataFrame, files: DataFrame, chosen: Column, aliases: Aliases, keep: Keep) -> DataFrame:
    """(project, path): the files that are chosen, and those that their imports lead to, directly or not.

    ``found`` are the token rows of all files; ``chosen`` is a predicate over path. Only ways through files that are not chosen are followed.
    """
    quoted = F.col("token").rlike("^['\"]") & ((F.col("prev").isin("from", "import") & (F.col("level") == 0)) | ((F.col("prev") == "(") & F.col("prev2").isin("import", "require")))
    names = found.where(quoted).select(*_FILE, _unquoted(F.col("token")).alias("spec")).distinct()
    steps = keep("import_steps", resolved_modules(names, files, aliases).select(*_FILE, "module", chosen.alias("from_chosen")))
    outside = steps.where("not from_chosen").select(*_FILE, "module")
    ways = reachable(outside, keep, "import_ways")
    first = steps.where("from_chosen").select("project", F.col("module").alias("path")).distinct()
    further = first.join(ways, _FILE).select("project", F.col("module").alias("path"))
    return files.select(*_FILE).where(chosen).unionByName(first).unionByName(further).distinct()


def exported_names(found: DataFrame, names: DataFrame, modules: DataFrame, keep: Keep) -> DataFrame:
    """(project, path, name, at_path, at_name): every name that a file exports, and the file and name that declare it.

    Re-exports lead from file to file; ``export *`` passes on all names but the default, a file's own names first.
    """
    own = declarations(found).where("exported")
    direct = own.select(*_FILE, F.when(F.col("default"), "default").otherwise(F.col("name")).alias("name"), F.lit(None).cast("string").alias("to_path"), F.col("name").alias("to_name"))
    out = names.where("kind = 'export' and local is not null").join(modules, [*_FILE, "spec"], "left")
    taken = names.where("kind = 'import' and name <> '*'").join(modules, [*_FILE, "spec"]).select(*_FILE, F.col("local").alias("here"), F.col("name").alias("imported"), F.col("module").alias("from_module"))
    local = out.where("spec is null").join(taken.withColumnRenamed("here", "local"), [*_FILE, "local"], "left")
    local = local.select(*_FILE, "name", F.col("from_module").alias("to_path"), F.coalesce("imported", "local").alias("to_name"))
    passed = out.where("spec is not null and module is not null").select(*_FILE, "name", F.col("module").alias("to_path"), F.col("local").alias("to_name"))
    explicit = keep("exports", direct.unionByName(local).unionByName(passed).dropDuplicates([*_FILE, "name"]))
    stars = names.where("kind = 'export' and local is null and spec is not null").join(modules, [*_FILE, "spec"]).select(*_FILE, "module").distinct()
    stars = reachable(stars, keep, "stars")
    passed = stars.join(explicit.where("name <> 'default'").select("project", F.col("path").alias("module"), "name"), ["project", "module"])
    passed = passed.groupBy(*_FILE, "name").agg(F.min("module").alias("to_path")).join(explicit.select(*_FILE, "name"), [*_FILE, "name"], "left_anti")
    pointers = explicit.unionByName(passed.select(*_FILE, "name", "to_path", F.col("name").alias("to_name")))
    # A name without a module is declared here; it may be declared under another name than it is exported by.
    ends = pointers.where("to_path is null").select(*_FILE, "name", F.col("to_name").alias("declared"))
    led = _doubled(pointers, keep).select(*_FILE, "name", F.col("to_path").alias("at_path"), F.col("to_name").alias("end"))
    return led.join(ends.select("project", F.col("path").alias("at_path"), F.col("name").alias("end"), "declared"), ["project", "at_path", "end"]).select(*_FILE, "name", "at_path", F.col("declared").alias("at_name"))


# --- references ---------------------------------------------------------------------------------------------------


def hidden(found: DataFrame, names: DataFrame, keep: Keep) -> DataFrame:
    """(project, path, name, from_n, to_n): where a local declaration of a file's name hides the one of its top level.

    ``names`` (project, path, name) are the names that matter. A local variable, function or class hides a name in the
    braces around it; a parameter in its function.
    """
    spans = found.where("close is not null").select(*_FILE, F.col("n").alias("open"), "close", (F.col("level") + 1).alias("level"), F.col("token").alias("bracket"), F.col("prev").alias("bp"), F.col("prev2").alias("bp2"), "behind", "end")
    here = found.where((F.col("level") > 0) & is_name()).select(*_FILE, "token", "n", "level", "prev", "next")
    known = names.select(*_FILE, F.col("name").alias("token")).distinct()
    variables = F.col("bp").isin("const", "let", "var")
    # What follows the closing bracket tells parameters from arguments.
    is_function = (F.col("bp") == "function") | (F.col("bp2") == "function")
    takes = (F.col("bracket") == "(") & (F.coalesce(is_function, F.lit(False)) | F.col("behind").isin("=>", ":"))
    bound = F.col("next").isin(",", "}", "]", "=") & (F.col("prev").isin("{", "[", ",", "...") | (F.col("prev") == ":"))
    first = F.col("prev").isin("(", ",", "...")
    unpacked = (F.col("bracket") == "{") & F.col("bp").isin("(", ",")
    # Only brackets that may declare something meet the tokens that may be declared there.
    around = here.where(bound | first).join(spans.where(variables | unpacked | takes), [*_FILE, "level"]).where("open < n and n < close")
    around = keep("declared_in_brackets", around.join(known, [*_FILE, "token"], "left_semi"))
    declared = here.where(F.col("prev").isin("const", "let", "var", "function", "class")).join(known, [*_FILE, "token"], "left_semi").select(*_FILE, "token", "level", F.col("n").alias("at"), F.col("n").alias("to"))
    # A name taken out of an object or list that is declared in braces: the braces around the declaration count.
    taken = around.where(bound & variables & (F.col("level") > 1)).select(*_FILE, "token", (F.col("level") - 1).alias("level"), F.col("open").alias("at"), F.col("open").alias("to"))
    # Parameters, plain or taken out of an object.
    head = ["open", "close", "level", "bp", "bp2", "behind", "end"]
    listed = around.where(first & takes).select(*_FILE, "token", *head)
    nested = around.where(bound & unpacked).select(*_FILE, "token", F.col("open").alias("o"), (F.col("level") - 1).alias("level"))
    nested = nested.join(spans.where(takes), [*_FILE, "level"]).where("open < o and o < close").select(*_FILE, "token", *head)
    heads = listed.unionByName(nested).distinct()
    # The brackets around all of them are looked up together.
    asked = heads.select(*_FILE, "token", (F.col("level") - 1).alias("level"), F.col("open").alias("at"), F.col("close").alias("to"), F.struct(*head).alias("head"))
    asked = asked.unionByName(declared.unionByName(taken), allowMissingColumns=True)
    outer = spans.select(F.col("project").alias("in_project"), F.col("path").alias("in_path"), F.col("level").alias("in_level"), F.col("open").alias("from_n"), F.col("close").alias("to_n"))
    found_in = asked.join(outer, F.expr("project = in_project and path = in_path and level = in_level and from_n < at and to < to_n"), "left")
    braces = found_in.where("head is null and from_n is not null").select(*_FILE, "token", "from_n", "to_n")
    # What follows the parameters at their level: to the end of the brackets around them, or of their statement.
    heads = found_in.where("head is not null").select(*_FILE, "token", "head.*", F.coalesce("to_n", F.col("head.end") + 1).alias("limit")).drop("end")
    told = F.col("token").isin("=>", "{", ",", ";") | (F.col("prev") == "=>")
    level = found.where(told).select(*_FILE, "n", F.col("token").alias("t"), (F.col("level") + 1).alias("level"), F.col("close").alias("c"), F.col("prev").alias("p"))
    follow = heads.join(level, [*_FILE, "level"]).where("n > close and n < limit")
    rows = follow.groupBy(*_FILE, "token", "open", "close", "level", "bp", "bp2", "behind", "limit").agg(F.array_sort(F.collect_list(F.struct("n", "t", "c", "p"))).alias("f"))
    arrow = F.array_position(F.transform("f", lambda x: x["t"]), "=>").cast("int")
    is_arrow = (F.col("behind") == "=>") | ((F.col("behind") == ":") & (arrow > 0))
    body = F.when(is_function, F.get(F.filter("f", lambda x: (x["t"] == "{") & ~x["p"].isin(":", "|", "&", "<", ",")), F.lit(0))).when(is_arrow, F.get("f", arrow))
    comma = F.filter("f", lambda x: (x["n"] > F.col("body.n")) & x["t"].isin(",", ";"))
    rows = rows.withColumn("body", body).where("body is not null")
    stop = F.when(F.col("body.t") == "{", F.col("body.c")).otherwise(F.coalesce(F.get(comma, F.lit(0))["n"], F.col("limit")))
    params = rows.select(*_FILE, "token", F.col("open").alias("from_n"), stop.alias("to_n"))
    return braces.unionByName(params).withColumnRenamed("token", "name").distinct()


def references(found: DataFrame, known: DataFrame, files: DataFrame, aliases: Aliases, keep: Keep) -> DataFrame:
    """Where symbols are named: (project, name, kind, file, path, line, column) for known (project, name, kind, file).

    A symbol is a top-level declaration of its file. In that file its name stands for it; in others, what an import of
    it calls it, by whatever re-exports it came; ``space.name`` where a whole module is imported. Property names, keys,
    strings and comments name nothing, and a local declaration hides the name. The names in import and export statements
    count as references.
    """
    names = keep("module_names", module_names(found))
    modules = keep("modules", resolved_modules(names.where("spec is not null"), files, aliases))
    exports = keep("exported_names", exported_names(found, names, modules, keep))
    symbol = F.struct(F.col("name"), F.col("kind"), F.col("file")).alias("symbol")
    symbols = known.select("project", symbol, F.col("file").alias("at_path"), F.col("name").alias("at_name")).distinct()
    open_ = keep("exported_symbols", exports.join(symbols, ["project", "at_path", "at_name"]).select("project", F.col("path").alias("module"), "name", "symbol"))
    taken = names.where("spec is not null").join(modules, [*_FILE, "spec"])
    imported = taken.where("kind = 'import' and name <> '*'").join(open_, ["project", "module", "name"])
    own = symbols.select("project", F.col("at_path").alias("path"), F.col("at_name").alias("name"), "symbol")
    bindings = keep("bindings", own.unionByName(imported.select(*_FILE, F.col("local").alias("name"), "symbol")).distinct())
    named = found.where(is_name()).select(*_FILE, "n", "line", "column", "token", "prev", "prev2", "next", "head")
    member = F.coalesce(F.col("prev").isin(".", "?."), F.lit(False))
    key = F.coalesce((F.col("next") == ":") & F.col("prev").isin("{", ","), F.lit(False))
    uses = named.where(~member & ~key).select(*_FILE, "n", "line", "column", "token").join(bindings.withColumnRenamed("name", "token"), [*_FILE, "token"])
    covers = hidden(found, bindings, keep).withColumnRenamed("name", "token")
    shown = uses.join(covers, (uses["project"].eqNullSafe(covers["project"])) & (uses["path"] == covers["path"]) & (uses["token"] == covers["token"]) & (uses["n"] >= covers["from_n"]) & (uses["n"] <= covers["to_n"]), "left_anti")
    # The other module's names in import and export statements.
    spoken = imported.where("local <> name").select(*_FILE, "n", "symbol")
    passed = taken.where("kind = 'export' and local is not null").select("project", "path", "module", F.col("local").alias("name"), "n").join(open_, ["project", "module", "name"]).select(*_FILE, "n", "symbol")
    spoken = spoken.unionByName(passed).join(named.where("head in ('import', 'export') and token <> 'default'"), [*_FILE, "n"])
    spaces = taken.where("kind = 'import' and name = '*'").select(*_FILE, F.col("local").alias("prev2"), "module")
    members = named.where(member).join(spaces, [*_FILE, "prev2"]).join(open_.withColumnRenamed("name", "token"), ["project", "module", "token"])
    parts = [x.select(*_FILE, "line", "column", "symbol") for x in (shown, spoken, members)]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()
    return rows.select("project", "symbol.name", "symbol.kind", "symbol.file", "path", "line", "column")
