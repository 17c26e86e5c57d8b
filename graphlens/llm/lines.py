"""Line dedup: a suffix array over line ids by distributed prefix doubling finds repeated line runs; later copies go.

DataFrame operations only: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlens.llm.common import cut, fresh_name, release
from graphlens.llm.sharding import with_prefix


def split_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k1, k2, first_id, base, n, ids): one row per distinct text, with its place in the corpus and its 128-bit line ids.

    base numbers all lines of all texts, in the order of the smallest id that has the text (none first), of its hash
    and of the line: the global text of line ids. Later copies of a whole text add no run that its first does not have.
    """
    rows = docs.where(F.col(text_col).isNotNull()).select(
        F.struct(F.col(id_col).isNotNull().alias("known"), F.col(id_col).alias("id")).alias("first"),
        F.xxhash64(text_col).alias("k1"),
        F.xxhash64(F.lit(1), text_col).alias("k2"),
        F.transform(F.split(text_col, "\n", -1), lambda x: F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(1), x).alias("h2"))).alias("ids"),
    )
    texts = rows.groupBy("k1", "k2").agg(F.min("first").alias("first"), F.first("ids").alias("ids")).withColumn("n", F.size("ids").cast("long"))
    placed, _ = with_prefix(texts, ["first", "k1", "k2"], ["n"])
    return placed.select("k1", "k2", F.col("first.id").alias("first_id"), F.col("before_n").alias("base"), "n", "ids")


def _ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Repeated key rows with rank (how many repeated suffixes have smaller keys) and low (their first position and its text).

    The keys are dealt by range and written once; one total per partition makes the ranks global.
    """
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("pos", "base")).alias("low")).where("n > 1")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(counted.repartitionByRange(n, *keys).withColumn("part", F.spark_partition_id()))
    totals = dealt.groupBy("part").agg(F.sum("n").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    ranked = dealt.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    # One row per partition: bounded by the number of partitions.
    return ranked.join(F.broadcast(offsets), "part").select(*keys, "low", (F.col("offset") + F.col("inside")).alias("rank"))


def _dense(found: Column) -> Column:
    """The ranks of sorted (i, rank) entries as an array by i, null where there is none."""
    gap = lambda x, j: (x["i"] - F.coalesce(F.get(found, j - 1)["i"], F.lit(-1)) - 1).cast("int")
    return F.flatten(F.transform(found, lambda x, j: F.concat(F.array_repeat(F.lit(None).cast("long"), gap(x, j)), F.array(x["rank"]))))


def _level(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(base, r): per text, the ranks of its suffixes by the keys; suffixes that occur once have none, texts without any no row."""
    found = rows.join(_ranked(rows, keys), keys).groupBy("base").agg(F.array_sort(F.collect_list(F.struct("i", "rank"))).alias("found"))
    return cut(found.select("base", _dense(F.col("found")).alias("r")))


def suffix_ranks(lines: DataFrame, max_rounds: int = 20) -> list[DataFrame]:
    """Prefix doubling, twice a round: the k-th table ranks the suffixes of each text by their first 4**k lines.

    A round names a suffix by the ranks of its four quarters, which stand in one array. A suffix whose run occurs once
    has its final place and takes no part in later rounds, and the rounds end when no run is repeated.
    """
    rows = lines.select("base", F.posexplode("ids").alias("i", "h")).select("base", F.col("i").cast("long").alias("i"), (F.col("base") + F.col("i")).alias("pos"), "h.h1", "h.h2")
    levels = [_level(rows, ["h1", "h2"])]
    for k in range(max_rounds):
        if levels[-1].isEmpty():
            return levels[:-1]
        span = 4**k
        quarters = F.transform(F.sequence(F.lit(0), F.size("r") - 1), lambda i: F.struct(i.cast("long").alias("i"), *[F.get("r", i + j * span).alias(f"r{j}") for j in range(4)]))  # noqa: B023
        rows = levels[-1].select("base", F.explode(quarters).alias("q")).select("base", "q.*").dropna().withColumn("pos", F.col("base") + F.col("i"))
        levels.append(_level(rows, ["r0", "r1", "r2", "r3"]))
    raise RuntimeError(f"runs of more than 4**{max_rounds} lines")


def longest_prefixes(lines: DataFrame, min_lines: int = 1) -> DataFrame:
    """(base, i, lcp): positions whose suffix shares its first ``min_lines`` lines or more with an earlier position's, and
    how many it shares at most.

    From the deepest ranks down, a position's prefix grows by one to three spans as long as the grown prefix has an
    earlier position. Positions of equal prefix so far are compared by the ranks that follow, together with
    the first position that has the prefix: whatever reaches further has an earlier one among these.
    """
    levels = suffix_ranks(lines)
    state = None  # (base, i, lcp, low)
    for k in reversed(range(len(levels))):
        span, ranks = 4**k, levels[k]
        entry = F.struct("i", "lcp", "low", F.lit(False).alias("first"))
        if state is None:
            asked = ranks.withColumn("known", F.expr("cast(array() as array<struct<i: bigint, lcp: bigint, low: struct<pos: bigint, base: bigint>, first: boolean>>)"))
        else:
            firsts = state.select(F.col("low.base").alias("base"), F.struct((F.col("low.pos") - F.col("low.base")).alias("i"), "lcp", "low", F.lit(True).alias("first")).alias("e")).distinct()
            known = state.select("base", entry.alias("e")).unionByName(firsts).groupBy("base").agg(F.collect_list("e").alias("known"))
            asked = ranks.join(known, "base", "full").withColumn("known", F.coalesce("known", F.expr("cast(array() as array<struct<i: bigint, lcp: bigint, low: struct<pos: bigint, base: bigint>, first: boolean>>)")))
        own = F.transform(F.filter("known", lambda e: ~e["first"]), lambda e: e["i"])
        fresh = F.array_except(F.sequence(F.lit(0).cast("long"), F.size("r").cast("long") - 1), own)
        nowhere = F.expr("cast(null as struct<pos: bigint, base: bigint>)")
        fresh = F.transform(F.coalesce(fresh, F.array().cast("array<bigint>")), lambda i: F.struct(i.alias("i"), F.lit(0).cast("long").alias("lcp"), nowhere.alias("low"), F.lit(False).alias("first")))
        at = lambda e, j: F.get("r", (e["i"] + e["lcp"] + j * span).cast("int"))  # noqa: B023, E731
        grown = F.transform(F.concat("known", fresh), lambda e: F.struct(e.alias("e"), *[at(e, j).alias(f"a{j}") for j in range(3)]))
        rows = asked.select("base", F.explode(grown).alias("g")).select("base", "g.e.*", "g.a0", "g.a1", "g.a2")
        rows = rows.where("lcp > 0 or a0 is not null").withColumn("pos", F.col("base") + F.col("i"))
        # One row for each length tried; those from which the shorter spans cannot reach min_lines are left out.
        tried = F.filter(
            F.array(*[F.struct(F.lit(d).alias("d"), F.col("a0"), (F.col("a1") if d > 1 else F.lit(None).cast("long")).alias("a1"), (F.col("a2") if d > 2 else F.lit(None).cast("long")).alias("a2")) for d in (1, 2, 3)]),
            lambda t: (F.col("lcp") + t["d"] * span + span - 1 >= min_lines) & t["a0"].isNotNull() & ((t["d"] < 2) | t["a1"].isNotNull()) & ((t["d"] < 3) | t["a2"].isNotNull()),  # noqa: B023
        )
        rows = cut(rows.select("base", "i", "pos", "lcp", "low", "first", tried.alias("tried")))
        tries = rows.select("base", "i", "pos", "lcp", "low", "first", F.explode("tried").alias("t")).select("*", F.xxhash64("lcp", "low.pos", "t.d", "t.a0", "t.a1", "t.a2").alias("name"), F.xxhash64(F.lit(1), "lcp", "low.pos", "t.d", "t.a0", "t.a1", "t.a2").alias("name2"))
        shared = tries.groupBy("name", "name2").agg(F.min(F.struct("pos", "base")).alias("found"), F.max("pos").alias("high")).where("found.pos < high").select(F.bitwise_not("name").alias("not_name"), "name2", "found")
        longer = tries.where("not first").withColumn("not_name", F.bitwise_not("name")).join(shared, ["not_name", "name2"]).where("found.pos < pos")
        longer = longer.select("base", "i", F.struct((F.col("lcp") + F.col("t.d") * span).alias("lcp"), F.col("found").alias("low")).alias("best"))
        kept = rows.where("lcp > 0 and not first").select("base", "i", F.struct("lcp", "low").alias("best"))
        state, last = cut(longer.unionByName(kept).groupBy("base", "i").agg(F.max("best").alias("best")).select("base", "i", "best.lcp", "best.low")), state
        release(rows)
        if last is not None:
            release(last)
    if state is None:
        return lines.select("base", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("lcp")).limit(0)
    return state.where(F.col("lcp") >= min_lines).select("base", "i", "lcp")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 2) -> DataFrame:
    """The documents with n_lines, n_removed, n_runs, longest_run, line_runs and kept_text (underscores where taken).

    A line goes if it lies in a run of at least ``min_lines`` lines that also starts at an earlier position, in the order
    of id, text hash and line; the first copy of every run stays. Lines end at \\n and are equal when their 128-bit ids
    are. line_runs are the document's maximal repeated runs, (start, length) from line 0: the longest prefix that its suffix
    from start shares with an earlier one, where that is no remainder of the run before. n_runs is their number, longest_run
    the greatest length.

    Defined results: null text stays null, with no lines; empty text is one empty line; with ``min_lines`` of 2 or more a
    single line, blank or not, that other texts have stays; null ids come first; rows equal in id and text are one document
    and get the same result; empty table - no rows.
    """
    names = {c: fresh_name(docs, c) for c in ("n_lines", "n_removed", "n_runs", "longest_run", "line_runs", "kept_text")}
    lines = split_lines(docs, id_col, text_col)
    found = longest_prefixes(lines.select("base", "ids"), min_lines)
    runs = found.groupBy("base").agg(F.array_sort(F.collect_list(F.struct(F.col("i").alias("start"), F.col("lcp").alias("length")))).alias("shared_"))
    # A text that several documents have is a repeated run as a whole in all but the first.
    texts = lines.select("k1", "k2", "first_id", "base").join(runs, "base", "left").drop("base")
    counts = docs.where(F.col(text_col).isNotNull()).groupBy(F.xxhash64(text_col).alias("k1"), F.xxhash64(F.lit(1), text_col).alias("k2")).agg(F.min(id_col).alias("least"), F.max(id_col).alias("most"), F.count(F.lit(1)).alias("rows"), F.count(id_col).alias("named"))
    copied = counts.where((F.col("rows") > 1) & (~F.col("least").eqNullSafe(F.col("most")) | ((F.col("named") > 0) & (F.col("named") < F.col("rows")))))
    texts = texts.join(copied.select("k1", "k2", F.lit(True).alias("copied_")), ["k1", "k2"], "left").where("shared_ is not null or copied_")
    # Joined by another key than the groupings', so that a text of many documents can be split between tasks.
    texts = texts.select(F.bitwise_not("k1").alias("k1_"), F.col("k2").alias("k2_"), F.col("first_id").alias("first_"), "shared_")
    joined = docs.join(texts, (F.bitwise_not(F.xxhash64(docs[text_col])) == F.col("k1_")) & (F.xxhash64(F.lit(1), docs[text_col]) == F.col("k2_")), "left")
    parts = F.split(F.col(text_col), "\n", -1)
    size = F.coalesce(F.when(F.col(text_col).isNotNull(), F.size(parts)), F.lit(0)).cast("long")
    kind = "array<struct<start: bigint, length: bigint>>"
    later = F.col("k1_").isNotNull() & ~docs[id_col].eqNullSafe(F.col("first_"))
    joined = joined.select(*[docs[c] for c in docs.columns], size.alias("size_"), later.alias("later_"), F.coalesce("shared_", F.array().cast(kind)).alias("shared_"))
    head = lambda x, j: F.coalesce(F.get("shared_", j - 1)["start"] + 1 != x["start"], F.lit(True)) | (F.get("shared_", j - 1)["length"] != x["length"] + 1)
    whole = F.when(F.col("size_") >= min_lines, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("size_").alias("length")))).otherwise(F.array().cast(kind))
    covered = F.array_distinct(F.flatten(F.transform("shared_", lambda x: F.sequence(x["start"], x["start"] + min_lines - 1))))
    gone = F.when(F.col("later_"), F.when(F.col("size_") >= min_lines, F.sequence(F.lit(0).cast("long"), F.col("size_") - 1)).otherwise(F.array().cast("array<bigint>"))).otherwise(covered)
    joined = joined.withColumn("gone_", gone).withColumn("runs_", F.when(F.col("later_"), whole).otherwise(F.filter("shared_", head)))
    kept = F.array_except(F.sequence(F.lit(0).cast("long"), F.col("size_") - 1), F.col("gone_"))
    text = F.when(F.size("gone_") == 0, F.col(text_col)).otherwise(F.array_join(F.transform(kept, lambda i: F.get(parts, i.cast("int"))), "\n"))
    return joined.select(
        *[F.col(c) for c in docs.columns],
        F.col("size_").alias(names["n_lines"]),
        F.size("gone_").cast("long").alias(names["n_removed"]),
        F.size("runs_").cast("long").alias(names["n_runs"]),
        F.coalesce(F.array_max(F.transform("runs_", lambda x: x["length"])), F.lit(0)).cast("long").alias(names["longest_run"]),
        F.col("runs_").alias(names["line_runs"]),
        text.alias(names["kept_text"]),
    )


def remove_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 2) -> DataFrame:
    """The documents' own columns and all their rows, the text without later copies of repeated line runs (``line_dedup``).

    Defined results: a text that repeats an earlier one of ``min_lines`` lines or more becomes empty; null texts stay
    null; texts without such a run stay byte for byte; rows equal in id and text get the same text; empty table - no rows.
    """
    out = line_dedup(docs, id_col, text_col, min_lines)
    kept = out.columns[-1]
    return out.select(*[F.col(kept).alias(c) if c == text_col else F.col(c) for c in docs.columns])
