"""Source texts as tokens with their brackets, and object and array literals as rows: running sums, not a parser.

A text's tokens are exploded once; a bracket's depth is a running sum, the bracket that holds a token is the last one
opened at its depth, and an entry of a literal is what stands between two commas of that depth. Windows go by file; the
token rows' own running sums and neighbours are told in Arrow batches of whole files, where they lie side by side already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Every repeated group is possessive, so that the matcher loops over a long literal instead of calling itself.
_TEMPLATE = r"`(?:[^`\\$]++|\\[\s\S]|\$\{(?:[^`{}]++|`(?:[^`\\]++|\\[\s\S])*+`|\{[^{}`]*+\})*+\}|\$)*+`"
_STRING = r"'(?:[^'\\\n]++|\\[\s\S])*+'|\"(?:[^\"\\\n]++|\\[\s\S])*+\""
_COMMENT = r"//[^\n]*+|/\*(?s:.*?)(?:\*/|\z)"
_WORDS = "export|import|const|let|var|function|type|interface|class|enum|async|declare|abstract|namespace"
# The words of an element, between a tag's end and the next tag or expression: no statement begins in them.
_ELEMENT_TEXT = rf"(?:[^<>{{}}=;()\n]++|\n(?!\s*+(?:{_WORDS})\b)|\([^<>{{}}=;()]*+\))++"
# What is looked back for stands behind what is cheap to see: else sixty places before each token are tried.
_BEGINS = rf"\s*+(?=[\p{{L}}\p{{N}}'\"&])(?!(?=(?:{_WORDS})\b)(?<=\n[ \t]{{0,60}}))"
_TEXT = rf"(?<=>)(?:(?<=[^=\s(,]>)|(?<=\n[ \t]{{0,60}}>)){_BEGINS}{_ELEMENT_TEXT}(?=[<{{])|(?<=\}}){_BEGINS}{_ELEMENT_TEXT}(?=</)"
_REGEX = r"(?=/)(?<=[=(,:!&|?\[]\s{0,3})/(?![/*\s>])(?:[^/\\\[\n]++|\\.|\[(?:[^\]\\\n]++|\\.)*+\])++/[a-z]*+"
_NAME = r"[A-Za-z_$\p{L}][\w$\p{L}]*+"
NAME = rf"^{_NAME}$"
TOKEN = rf"{_COMMENT}|{_TEXT}|{_STRING}|{_TEMPLATE}|{_REGEX}|=>|{_NAME}|\p{{N}}[\w.]*+|[\[\]{{}}(),:;=<>]|[^\s\w$\p{{L}}\[\]{{}}(),:;=<>'\"`/]++|[/'\"`]"
#: Words that say what a statement declares.
DECLARING = ("const", "let", "var", "function", "class", "import", "enum")
#: What begins a statement, and what stands before such a word inside one.
STARTS = tuple(_WORDS.split("|"))
INSIDE = ("export", "default", "async", "declare", "abstract", "import", "const", "let", "var", "function", "class", "=", "=>", ":", "|", "&", "<", ",", "?", "typeof", "extends", "implements", ".", "?.")
_FILE = ["project", "path"]
#: Mark a token's start and end while a text is cut.
_MARK, _END = "\ue000", "\ue001"
#: Characters of texts whose tokens one task lists; a longer text is one task's.
_TASK = 1 << 21
#: Characters of the parts that a text is cut into, where values are read from it.
_PART = 1 << 12


def _tasks(texts: DataFrame) -> int:
    """How many tasks list the texts' tokens."""
    characters = texts.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    return max(texts.sparkSession.sparkContext.defaultParallelism, -(-characters // _TASK))


def _pieces(text: Column) -> Column:
    """array<struct<gap, token>> of a text: its tokens, each behind what stands before it; the last, without a token, is the rest.

    Tokens are marked in a copy of the text, so that it is matched once; a text that has such a mark of its own is matched thrice.
    """
    hits = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    slow = F.arrays_zip(F.slice(F.split(text, TOKEN, -1), 1, F.size(hits)).alias("gap"), hits.alias("token"))
    marked = F.split(F.regexp_replace(text, F.lit(TOKEN), F.lit(f"{_MARK}$0{_END}")), _END, -1)
    fast = F.transform(marked, lambda x: F.struct(F.substring_index(x, _MARK, 1).alias("gap"), F.when(F.contains(x, F.lit(_MARK)), F.substring_index(x, _MARK, -1)).alias("token")))
    return F.when(F.contains(text, F.lit(_MARK)) | F.contains(text, F.lit(_END)), slow).otherwise(fast)


def tokens(texts: DataFrame) -> DataFrame:
    """Tokens but comments and the words of elements: (project, path, n, pos, line, column, token, level, prev, prev2, next, stmt, close, behind, is_name, head, second, word, end).

    level counts the brackets around a token: an opening bracket has the level that it stands in, a closing one the level
    that it ends. prev, prev2 and next are the tokens beside it; stmt numbers the file's statements; close is the token
    number of an opening bracket's counterpart, behind the token after that; is_name tells identifiers. head and second are the first tokens of a token's
    statement, word the first at its top level that declares, end its last token's number.
    """
    # Tasks are counted by characters: texts that resemble one another are next to nothing in a shuffle, and their tokens are not.
    spread = texts.repartition(_tasks(texts), *_FILE)
    rows = spread.select(*_FILE, F.posexplode(_pieces(F.col("text"))).alias("n", "x")).select(*_FILE, "n", "x.gap", "x.token").where("token is not null")
    rows = rows.withColumn("is_name", F.col("token").rlike(NAME))
    # An element's words: what no other kind of token looks like.
    words = ~F.col("is_name") & F.col("token").rlike(r"^[\s\p{L}\p{N}'\"&]") & ~F.col("token").rlike(rf"^(?:\p{{N}}[\w.]*+|[^\s\w$\p{{L}}'\"]++|{_STRING}|['\"])$")
    return rows.withColumn("words", words).mapInArrow(_by_file, _TOKENS)


_TOKENS = (
    "project string, path string, n int, pos long, line long, column long, token string, level long, prev string, prev2 string, next string, "
    "stmt long, close int, behind string, is_name boolean, head string, second string, word string, end int"
)
#: Tokens that are told together, with the rest of the last one's file, and bytes of them.
_BATCH, _BYTES = 1 << 16, 1 << 26


def _by_file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Token rows with what their files' other tokens tell; a file's rows come one after another, the first has the number 0."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        waiting.append(batch)
        begins = np.flatnonzero(batch["n"].to_numpy() == 0)
        full = sum(map(len, waiting)) >= _BATCH or sum(b.nbytes for b in waiting) >= _BYTES
        if full and len(begins):
            yield from _told([*waiting[:-1], batch.slice(0, begins[-1])])
            waiting = [batch.slice(begins[-1])]
    yield from _told(waiting)


def _kept(table: pa.Table, where: np.ndarray, *columns: np.ndarray) -> tuple:
    return table.filter(pa.array(where)), *[c[where] for c in columns]


def _is(tokens: pa.Array, *words: str) -> np.ndarray:
    return pc.is_in(tokens, pa.array(words)).to_numpy(zero_copy_only=False)


def _told(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The token rows of whole files: running sums and neighbours, each file by itself."""
    table = pa.Table.from_batches(batches).combine_chunks() if batches else None
    if not table:
        return
    one = lambda name: table[name].combine_chunks()
    file = np.cumsum(one("n").to_numpy() == 0)

    def summed(x: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Running sums, each file's from 0."""
        total, first = np.cumsum(x), np.flatnonzero(np.diff(of, prepend=-1))
        return total - np.repeat(total[first] - x[first], np.diff(first, append=len(x)))

    length = lambda x: pc.utf8_length(x).to_numpy().astype(np.int64)
    feeds = lambda x: pc.count_substring(x, "\n").to_numpy().astype(np.int64)

    def tail(x: pa.Array, some: np.ndarray) -> np.ndarray:
        """Characters behind the last line feed of those texts that have some."""
        out = np.zeros(len(x), np.int64)
        out[some] = [len(t) - t.rfind("\n") - 1 for t in x.filter(pa.array(some)).to_pylist()]
        return out

    gap, token = one("gap"), one("token")
    in_gap, in_token = feeds(gap), feeds(token)
    end = summed(length(gap) + length(token), file)
    start = end - length(token)
    line = summed(in_gap + in_token, file) - in_token + 1
    # Positions of the last line feed: in the gap before a token, up to the token's end, and up to the end of the token before.
    feed = np.where(in_gap > 0, start - tail(gap, in_gap > 0), 0)
    last = np.where(in_token > 0, end - tail(token, in_token > 0), feed)
    far = int(end.max()) + 1
    before = np.maximum.accumulate(last + file * far) - file * far
    before = np.where(np.diff(file, prepend=-1) != 0, 0, np.roll(before, 1))
    column = start + 1 - np.maximum(feed, before)
    opens, closes = _is(token, "{", "[", "("), _is(token, "}", "]", ")")
    level = summed(opens.astype(np.int64) - closes, file) - opens + closes
    said = pc.or_(pc.starts_with(token, "//"), pc.starts_with(token, "/*")).to_numpy(zero_copy_only=False)
    table, file, start, line, column, level = _kept(table, ~said, file, start, line, column, level)

    def beside(k: int) -> pa.Array:
        """The place of the token k places on in the same file, or null."""
        at = np.arange(len(file)) + k
        there = (at >= 0) & (at < len(file))
        at = np.where(there, at, 0)
        return pa.array(at, mask=~there | (file[at] != file)) if len(file) else pa.array([], pa.int64())

    # A name between a tag's end and the next tag is an element's word, too.
    token = one("token")
    near = lambda k, *words: _is(token.take(beside(k)), *words)
    alone = one("is_name").to_numpy(zero_copy_only=False) & near(-1, ">") & near(1, "<", "{") & ~_is(token, *STARTS)
    table, file, start, line, column, level = _kept(table, ~(one("words").to_numpy(zero_copy_only=False) | alone), file, start, line, column, level)
    if not len(file):
        return
    token, n = one("token"), one("n").to_numpy()
    prev, prev2, after = token.take(beside(-1)), token.take(beside(-2)), token.take(beside(1))
    begins = (level == 0) & (_is(token, *STARTS) & ~_is(prev, *INSIDE) | _is(prev, ";"))
    stmt = summed(begins.astype(np.int64), file)
    # A bracket's counterpart is the next one of the level inside it.
    opens, closes = _is(token, "{", "[", "("), _is(token, "}", "]", ")")
    inner = level + opens
    brackets = np.flatnonzero(opens | closes)
    order = brackets[np.lexsort((brackets, inner[brackets], file[brackets]))]
    pairs = opens[order[:-1]] & (inner[order[:-1]] == inner[order[1:]]) & (file[order[:-1]] == file[order[1:]])
    other = np.zeros(len(file), np.int64)
    other[order[:-1][pairs]] = order[1:][pairs]
    other = pa.array(other, mask=other == 0)
    # What statements begin with stands in every row: nothing has to look it up again.
    first = np.flatnonzero((np.diff(file, prepend=-1) != 0) | (np.diff(stmt, prepend=-1) != 0))
    sizes = np.diff(first, append=len(file))
    head, places = np.repeat(first, sizes), np.arange(len(file))
    declares = np.minimum.reduceat(np.where((level == 0) & _is(token, *DECLARING), places, len(file)), first)
    declares = np.repeat(declares, sizes)
    word = token.take(pa.array(np.where(declares < len(file), declares, 0), mask=declares == len(file)))
    numbers = pa.array(n)
    columns = [
        one("project"), one("path"), numbers, start + 1, line, column, token, level, prev, prev2, after,
        stmt, numbers.take(other), after.take(other), one("is_name"), token.take(pa.array(head)), after.take(pa.array(head)), word, numbers.take(pa.array(np.repeat(first + sizes - 1, sizes))),
    ]
    names = [c.split()[0] for c in _TOKENS.split(", ")]
    yield from pa.table([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names).to_batches(max_chunksize=_BATCH)


def entries(texts: DataFrame, found: DataFrame) -> DataFrame:
    """(project, path, literal, bracket, place, key, child, child_bracket, value, line, from_n, to_n): entries of all bracketed lists.

    ``literal`` is the token number of the bracket that holds an entry; its value is the tokens from_n up to to_n. In braces an entry has a key and the text of its
    value; in others it is all value. ``child`` is the bracket that the value begins with.
    """
    opens, closes = F.col("token").isin("{", "[", "("), F.col("token").isin("}", "]", ")")
    inner = found.where(opens).select(*_FILE, "n", F.lit(0).alias("kind"), "pos", "line", "token", (F.col("level") + 1).alias("level"))
    rows = found.select(*_FILE, "n", F.lit(1).alias("kind"), "pos", "line", "token", "level").unionByName(inner)
    upto = Window.partitionBy(*_FILE, "level").orderBy("n", "kind")
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    holder = F.last(F.when(F.col("kind") == 0, F.struct("n", "token")), ignorenulls=True).over(upto)
    commas = F.coalesce(F.sum(F.when((F.col("token") == ",") & (F.col("kind") == 1), 1).otherwise(0)).over(before), F.lit(0))
    rows = rows.select("*", holder.alias("holder"), commas.alias("place")).where("kind = 1 and holder is not null")
    parts = rows.groupBy(*_FILE, F.col("holder.n").alias("literal"), F.col("holder.token").alias("bracket"), "place").agg(F.array_sort(F.collect_list(F.struct("n", "token", "pos", "line"))).alias("t"))
    keyed = (F.col("bracket") == "{") & (F.get("t", F.lit(1))["token"] == ":")
    first = F.when(F.col("bracket") == "{", F.lit(2)).otherwise(F.lit(0))
    last = F.element_at("t", -1)
    parts = parts.where((F.size("t") > first + 1) & ((F.col("bracket") != "{") | keyed))
    parts = parts.select(
        *_FILE, "literal", "bracket", "place", F.when(keyed, F.get("t", F.lit(0))["token"]).alias("key"), F.get("t", first).alias("v"), F.get("t", F.lit(0))["line"].alias("line"), F.size("t").alias("size"), last["pos"].alias("end"), last["n"].alias("to_n"), last["token"].isin(",", "}", "]", ")").alias("ended")
    ).where("ended")
    # Values are read from parts of the text: looking for each one from the text's beginning takes the square of its length.
    cut = texts.select(*_FILE, F.posexplode(F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{_PART}}}"), F.lit(0))).alias("part", "said"))
    begin, until = F.col("v.pos") - 1, F.col("end") - 1
    parts = parts.select("*", F.explode(F.sequence(F.floor(begin / _PART).cast("int"), F.floor((until - 1) / _PART).cast("int"))).alias("part")).join(cut, [*_FILE, "part"])
    here = F.greatest(begin - F.col("part") * _PART, F.lit(0))
    said = F.struct("part", F.substring("said", here.cast("int") + 1, (F.least(until - F.col("part") * _PART, F.lit(_PART)) - here).cast("int")).alias("said"))
    joined = parts.groupBy(*_FILE, "literal", "bracket", "place", "key", "v", "line", "to_n").agg(F.array_sort(F.collect_list(said)).alias("value"))
    value = F.rtrim(F.array_join(F.transform("value", lambda x: x["said"]), ""))
    bracket = F.col("v.token").isin("{", "[", "(")
    return joined.select(*_FILE, "literal", "bracket", "place", "key", F.when(bracket, F.col("v.n")).alias("child"), F.when(bracket, F.col("v.token")).alias("child_bracket"), value.alias("value"), "line", F.col("v.n").alias("from_n"), "to_n")


def declared(found: DataFrame, name: str) -> DataFrame:
    """(project, path, literal, bracket): the literal that a file's variable of this name is set to, at its top level."""
    upto = Window.partitionBy(*_FILE).orderBy("n")
    marks = found.withColumn("begins", (F.col("token") == name) & F.lag("token").over(upto).isin("const", "let", "var") & (F.col("level") == 0))
    marks = marks.select("*", F.last(F.when(F.col("begins"), F.col("n")), ignorenulls=True).over(upto).alias("of"), F.lead("n").over(upto).alias("next_n"), F.lead("token").over(upto).alias("next_token"))
    since = Window.partitionBy(*_FILE, "of").orderBy("n")
    ends = F.sum(F.when(F.col("token").isin("=", ";"), 1).otherwise(0)).over(since)
    marks = marks.where("of is not null").withColumn("ends", ends).where("token = '=' and ends = 1 and level = 0 and next_token in ('{', '[')")
    return marks.groupBy(*_FILE).agg(F.min_by(F.struct(F.col("next_n").alias("literal"), F.col("next_token").alias("bracket")), "n").alias("d")).select(*_FILE, "d.literal", "d.bracket")
