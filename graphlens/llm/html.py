"""HTML extraction: words score positive, tags negative, and the contiguous region of the greatest sum is the content."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from graphlens.llm.common import arrow_rows, fresh_name, small_batches, with_schema
from graphlens.llm.html_pages import labelled_pages

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<(?P<raw>script|style|noscript|template|textarea|title|svg|iframe)\b(?>[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*(?:>|$)(?s:.*?)(?:</(?P=raw)\s*>|$)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attributes>(?>[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)|<[!?/][^>]*(?:>|$)",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_SPACE = re.compile(r"\s+")
_PARTS = re.compile(r"[_-]+")
#: An element is boilerplate if its log-odds of holding content are below this.
DROP = -1.5
#: What opens and closes marks in a labelled page.
_MARKS = {"[[": "mark-content", "]]": "mark-end", "{{": "mark-boilerplate", "}}": "mark-back"}

# The HTML standard's void elements, those that end an open one of their own name, and those whose start or end
# parts one block from the next.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SELF_ENDING = frozenset("p li td tr dt dd option".split())
_BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_ROOTS = frozenset(["html", "body", "head"])
# Elements of running text, and parts that only stand in a larger whole: what a class calls them says nothing about content.
_PHRASES = frozenset("a abbr b bdi bdo cite code data del dfn em i ins kbd mark q s samp small span strong sub sup time u var wbr".split())
_TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li td th dd dt blockquote figcaption caption pre summary".split())
_PARTS_OF_A_WHOLE = frozenset("h1 h2 h3 h4 h5 h6 li td th tr thead tbody tfoot caption figcaption dt dd".split())
#: What an entry of a list of comments may be.
_ENTRIES = frozenset("div li article section dd tr".split())
_DATE = re.compile(r"\b\d{1,4}[./-]\d{1,2}[./-]\d{1,4}\b|\b\d{1,2}:\d{2}\b|\b\d{1,2}\.? \w+ (?:19|20)\d{2}\b|\b(?:19|20)\d{2}-\d{2}\b")


def names_of(attributes: str) -> list[str]:
    """The words of an element's class, id and role; digits at a word's end do not count."""
    return [x.rstrip("0123456789-_") for found in _ATTRIBUTE.findall(attributes) for x in "".join(found).lower().split()] if attributes else []


class ElementScore:
    """Log-odds that an element holds content, from its name and the words of its class, id and role.

    The odds are counted on labelled pages: an element holds content if marked text stands in it, and is boilerplate if
    it has text, but none of that. A word that the pages do not have scores by its parts: those that tell boilerplate
    share their mean with the parts that no page has, so that one telling part beside a strange one does not decide.
    """

    def __init__(self, tags: dict[str, float], words: dict[str, float], parts: dict[str, float], whole: frozenset[str] = frozenset()):
        self.tags, self.words, self.parts, self.whole = tags, words, parts, whole

    def holds(self, name: str, attributes: str) -> bool:
        """Whether an element is all content by its kind: an article, or one that labelled pages use for content and nothing else."""
        return name in ("article", "main") or bool(attributes) and not self.whole.isdisjoint(names_of(attributes))

    def __call__(self, name: str, attributes: str, in_article: bool) -> float:
        tag = self.tags.get(name, 0.0)
        if in_article:
            tag = self.tags.get(f"in {name}", tag)
        if not attributes:
            return tag
        told = [self._word(x) for x in names_of(attributes) if x]
        # What a site calls an element tells more than its name does: a word for content keeps what the name would drop.
        most, least = max(told, default=0.0), min(told, default=0.0)
        return tag / 2 + most if most > -least else tag + least

    def _word(self, word: str) -> float:
        got = self.words.get(word)
        if got is None:
            parts = [self.parts.get(x, 0.0) for x in _PARTS.split(word) if x and not x.isdigit()]
            bad = [x for x in parts if x < 0]
            got = sum(max(-3.0, x) for x in bad) / (len(bad) + parts.count(0.0)) if bad else 0.0
        return got

    @staticmethod
    def fit(pages: list[str]) -> ElementScore:
        kept, dropped = [Counter(), Counter(), Counter()], [Counter(), Counter(), Counter()]
        outer, pure = Counter(), Counter()
        for page in pages:
            for name, attributes, in_article, content, whole in _labelled_elements(page):
                words = set(names_of(attributes))
                if content and words and (name in _PHRASES or name in _PARTS_OF_A_WHOLE):
                    continue  # what these are called decides nothing
                if content and whole is not None:
                    outer.update(words)
                    pure.update(words if whole else ())
                parts = {p for w in words for p in _PARTS.split(w)}
                # Where words tell what an element is, its name is not counted.
                names = [] if words else ["in " * in_article + name]
                for counts, found in zip(kept if content else dropped, (names, words, parts), strict=True):
                    counts.update(found)
        odds = lambda k: {x: math.log((kept[k][x] + 0.3) / (dropped[k][x] + 0.3)) for x in {*kept[k], *dropped[k]}}
        # A name that stands on both sides says little: only one that is nearly always boilerplate is worth its odds.
        # Inside an article it counts apart if the pages have it there as content (a heading's header, say).
        tags = {x: s if s < DROP - 1 else 0.0 for x, s in odds(0).items() if not x.startswith("in ") or kept[0][x]}
        return ElementScore(tags, odds(1), odds(2), frozenset(x for x in pure if pure[x] >= 5 and pure[x] > 0.4 * outer[x]))


def _marked(page: str) -> str:
    for mark, tag in _MARKS.items():
        page = page.replace(mark, f"<{tag}>")
    return page


def _labelled_elements(page: str) -> Iterator[tuple[str, str, bool, bool, bool | None]]:
    """(name, attributes, in an article, holds content, holds nothing else) of a labelled page's elements that have text.

    The last is None for elements that stand inside the content.

    Of boilerplate, only the outermost element counts: what stands in it (links, lists) is no better a sign than elsewhere.
    """
    found: list[dict] = []
    stack: list[dict] = []
    content = within = False  # whether what stands here is content, or between the marks of the content at least
    articles = at = 0
    page = _marked(page)
    for m in _TOKEN.finditer(page):
        if page[at : m.start()].strip():
            for e in stack:
                e["content" if content else "other"] = True
                e["outside"] |= not within
        at = m.end()
        name = (m["name"] or "").lower()
        if name in _MARKS.values():
            content, within = name in ("mark-content", "mark-back"), name != "mark-end"
        elif name and name not in _VOID and not m["close"]:
            stack.append({"name": name, "attributes": m["attributes"], "article": articles > 0, "above": stack[-1] if stack else None, "content": False, "other": False, "outside": False, "inside": within})
            found.append(stack[-1])
            articles += name in ("article", "main")
        elif m["close"] and any(e["name"] == name for e in stack):
            while True:
                e = stack.pop()
                articles -= e["name"] in ("article", "main")
                if e["name"] == name:
                    break
    for e in found:
        if e["content"] or (e["other"] and e["above"] is not None and e["above"]["content"]):
            yield e["name"], e["attributes"], e["article"], e["content"], None if e["inside"] else not e["outside"]


def threads(page: str) -> set[int]:
    """Where elements begin that are lists of comments by their build: like children, each with words and a date.

    Two children at least are of one name and class, have a time element or a date in them, and are most of the element's.
    """
    found: set[int] = set()
    stack: list[dict] = []
    at = 0

    def closed() -> None:
        e = stack.pop()
        if e["like"] and (most := max(e["like"].values())) >= 2 and 3 * most >= 2 * e["kids"]:
            found.add(e["at"])
        if stack:
            above = stack[-1]
            above["words"] += e["words"]
            above["dated"] |= e["dated"]
            if e["name"] in _BLOCK:
                above["kids"] += 1
                if e["name"] in _ENTRIES and e["dated"] and e["words"] >= 3 and (e["class"] or e["name"] in ("li", "article")):
                    above["like"][e["name"], e["class"]] += 1

    opened: Counter = Counter()
    for m in _TOKEN.finditer(page):
        text = page[at : m.start()]
        at = m.end()
        if stack and text.strip():
            stack[-1]["words"] += len(text.split())
            stack[-1]["dated"] |= _DATE.search(text) is not None
        name = (m["name"] or "").lower()
        if not name or name in _VOID:
            continue
        if m["close"]:
            if opened[name]:
                while True:
                    last = stack[-1]["name"]
                    opened[last] -= 1
                    closed()
                    if last == name:
                        break
        else:
            if name in _SELF_ENDING and stack and stack[-1]["name"] == name:
                opened[name] -= 1
                closed()
            stack.append({"at": m.start(), "name": name, "class": " ".join(names_of(m["attributes"])), "words": 0, "dated": name == "time", "kids": 0, "like": Counter()})
            opened[name] += 1
    while stack:
        closed()
    return found


def scan(page: str, element: ElementScore) -> Iterator[tuple[str, str, bool]]:
    """(tag, "", inside) or ("", text, inside) of everything but comments, scripts, styles and elements that score as boilerplate.

    inside: within an article, or an element that is all content by its kind. There, parts of a larger whole (headings,
    list items, cells) are never boilerplate by what a class calls them, nor are elements of running text in a text block
    anywhere. A list of reader comments, told by its build, is left out behind an article's end. An element left open ends
    with its parent, so an unclosed advert cannot swallow the page; a new article or main element also ends boilerplate
    that only a class told. Every tag is looked at once, and every element is closed once.
    """
    stack: list[tuple[str, bool]] = []  # open elements, and whether they are all content
    opened: Counter = Counter()  # how many of each name are open
    dropped, by_name = -1, False  # the depth at which boilerplate began, and whether a class alone cannot have told it
    holding = articles = blocks = at = 0  # open elements that are all content; of those, all but main; open text blocks
    ended = False
    scores: dict[tuple, float] = {}
    lists: set[int] | None = None
    for m in _TOKEN.finditer(page):
        if at < m.start() and dropped < 0:
            yield "", page[at : m.start()], holding > 0
        at = m.end()
        name = m["name"]
        if not name:
            if m["raw"] and dropped < 0:
                yield m["raw"].lower(), "", holding > 0
            continue
        name = name.lower()
        if name in _VOID:
            if dropped < 0:
                yield name, "", holding > 0
            continue
        ends = 0
        if m["close"]:
            if opened[name]:
                ends = next(k for k in range(1, len(stack) + 1) if stack[-k][0] == name)
        elif name in _SELF_ENDING and stack and stack[-1][0] == name:
            ends = 1
        for _ in range(ends):
            gone, whole = stack.pop()
            opened[gone] -= 1
            holding -= whole
            articles -= whole and gone != "main"
            blocks -= gone in _TEXT_BLOCKS
            ended |= whole and gone != "main"
        if ends and len(stack) <= dropped:
            dropped = -1
        if m["close"]:
            if dropped < 0:
                yield "/" + name, "", holding > 0
            continue
        starts = name in ("article", "main")
        if dropped < 0 and ended and not articles:
            if lists is None:  # nothing is told by its build without dates
                lists = threads(page) if "<time" in page or "<TIME" in page or _DATE.search(page) else set()
            if m.start() in lists:
                dropped, by_name = len(stack), True
        if (dropped < 0 or (starts and not by_name)) and name not in _ROOTS:
            part = (holding > 0 and name in _PARTS_OF_A_WHOLE) or (blocks > 0 and name in _PHRASES)
            key = (name, "" if part else m["attributes"], holding > 0)
            score = scores.get(key)
            if score is None:
                score = scores[key] = element(*key)
            if score < DROP:
                if dropped < 0:
                    dropped, by_name = len(stack), element(name, "", holding > 0) < DROP
            elif starts:
                dropped = -1
        whole = dropped < 0 and element.holds(name, m["attributes"])
        if dropped < 0:
            yield name, "", holding > 0
        stack.append((name, whole))
        opened[name] += 1
        holding += whole
        articles += whole and name != "main"
        blocks += name in _TEXT_BLOCKS
    if at < len(page) and dropped < 0:
        yield "", page[at:], holding > 0


def features(page: str, element: ElementScore) -> Iterator[tuple[str, int, str]]:
    """(feature, count, text) of every token: tags and words, told apart in and out of content elements, and in links.

    "in " stands before those inside an article or another element that is all content. Where such elements hold half of a
    page's words or more, "beside " stands before the others.
    """
    tokens, words, link = [], [0, 0], False
    for tag, text, inside in scan(page, element):
        if tag:
            link = tag == "a" or (link and tag != "/a")
            tokens.append((inside, tag, 1, ""))
        else:
            count = len(text.split())
            words[inside] += 0 if link else count
            tokens.append((inside, "a w" if link else "w", count, text))
    out = "beside " if words[1] and words[1] >= words[0] else ""
    for inside, name, count, text in tokens:
        yield ("in " if inside else out) + name, count, text


class Weights:
    """What labelled pages teach: which elements hold content, and the scores of tags and words along a page."""

    def __init__(self, element: ElementScore, tokens: dict[str, float]):
        self.element, self.tokens = element, tokens

    def of(self, feature: str) -> float:
        """A tag unseen in the labelled pages costs little inside an article and half a word outside."""
        value = self.tokens.get(feature)
        return value if value is not None else -0.02 if feature.startswith("in ") else -0.5


def fit_weights(pages: list[str] | None = None) -> Weights:
    """Scores from labelled pages: of elements, of tags and of words (w; a w in a link), in and out of articles.

    A token's score is the log-odds of standing inside the marked content. A tag that content has as often as the rest
    costs next to nothing; the others' costs are doubled as often as makes the best region the content on most of the
    first 150 pages.
    """
    pages = labelled_pages() if pages is None else pages
    element = ElementScore.fit(pages)
    inside, outside = Counter(), Counter()
    for page in pages:
        content = False
        for x, n, _ in features(_marked(page), element):
            name = x.removeprefix("in ").removeprefix("beside ")
            if name in _MARKS.values():
                content = name in ("mark-content", "mark-back")
            elif not name.startswith("/mark"):
                (inside if content else outside)[x] += n
    total = sum(inside.values()), sum(outside.values())
    raw = {x: math.log((inside[x] + 0.5) / total[0]) - math.log((outside[x] + 0.5) / total[1]) for x in {*inside, *outside}}
    best = None
    for power in range(6):
        tokens = {x: (s if x.endswith("w") else -0.02 if s > -0.5 else s * 2**power) for x, s in raw.items()}
        for x in ("w", "in w", "in a w"):
            tokens[x] = max(0.5, tokens.get(x, 0.5))
        weights = Weights(element, tokens)
        right = sum(extract(unmarked(p), weights) == marked_text(p, weights) for p in pages[:150])
        if best is None or right > best[0]:
            best = right, weights
    return best[1]


def unmarked(page: str) -> str:
    for mark in _MARKS:
        page = page.replace(mark, "")
    return page


def marked_text(page: str, weights: Weights) -> str:
    """The text between a labelled page's marks, without what its inner marks take out."""
    body = page[page.index("[[") + 2 : page.index("]]")]
    while "{{" in body:
        body = body[: body.index("{{")] + body[body.index("}}") + 2 :]
    return extract(body, Weights(ElementScore({}, {}, {}), {"w": 1.0, "a w": 1.0, "in w": 1.0, "in a w": 1.0, "beside w": 1.0, "": 0.0}), whole=True)


@lru_cache(1)
def default_weights() -> Weights:
    return fit_weights()


def best_region(values: list[float]) -> tuple[int, int]:
    """The contiguous run [start, end) of the greatest positive sum, the first and shortest of equals; (0, 0) if none is positive."""
    best, start, end = 0.0, 0, 0
    total, begun = 0.0, 0
    for k, value in enumerate(values):
        total += value
        if total <= 0:
            total, begun = 0.0, k + 1
        elif total > best:
            best, start, end = total, begun, k + 1
    return start, end


def extract(page: str | None, weights: Weights | None = None, whole: bool = False) -> str:
    """The main text of a page: its blocks in page order, one per line; no content gives an empty text.

    ``whole`` takes all of the page that is no boilerplate element for the region.
    """
    if not page:
        return ""
    weights = default_weights() if weights is None else weights
    tokens = list(features(page, weights.element))
    start, end = (0, len(tokens)) if whole else best_region([weights.of(x) * count for x, count, _ in tokens])
    blocks, now = [], []
    for x, _, text in tokens[start:end]:
        if text:
            now.append(text)
        elif x.removeprefix("in ").removeprefix("beside ").lstrip("/") in _BLOCK:
            blocks.append("".join(now))
            now = []
    blocks.append("".join(now))
    lines = (_SPACE.sub(" ", unescape(x)).strip() for x in blocks)
    return "\n".join(x for x in lines if x)


def extract_text(pages: DataFrame, name: str = "text", html_col: str = "html", weights: Weights | None = None) -> DataFrame:
    """The pages with their main text (underscores where the name is taken).

    Every page is scanned once, whole, without a shuffle; the weights are small tables fitted on labelled pages.
    Defined results: null, empty and tagless html give an empty text or the text as it is; comments, scripts and tags
    that never end run to the end of the page, as in browsers; elements that never end run to the end of their parent;
    unknown references stay as they are; equal pages give equal texts; empty table - no rows.
    """
    weights = weights or default_weights()
    place = pages.columns.index(html_col)
    name = fresh_name(pages, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, place):
            got = [extract(page.as_py(), weights) for page in batch.column(place)]
            yield arrow_rows(batch, batch.schema, **{name: pa.array(got, pa.string())})

    return pages.mapInArrow(run, with_schema(pages, **{name: "string"}))
