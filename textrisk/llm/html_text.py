"""Main text of web pages by the maximum-scoring subsequence.

A page is a sequence of words and tags. On labelled pages (those that mark their
article; the article element is the label) we count, for every kind of tag and of block
around a word, how much of it is content. A word scores above zero, up to 1, by the share
of content among the words in such blocks; a tag scores below zero, the more the larger
its share outside content, up to the mean number of words of a stretch outside content.
Elements that never hold main text (menus, forms, notices, comments, ...) are left out
wherever they stand: their tags and words score nothing, neither in training nor on a
page, and never reach the text. On a page that marks its article, a word outside of it
scores below zero. One linear scan finds the contiguous region of the largest sum; block
elements separate blocks. Elements end where HTML says so, with or without an end tag.

The tag weights come from a sample of the pages that mark their article, ``MAX_PAGES``
by hash of the id (the bound of what the driver sees is the tag table, ``MAX_TAGS``
entries, those without words outside not among them). Every page is then read whole. A
table without such a page gets no weights, and a warning says so.

Defined results: null or empty html, and pages without a word, give the empty text;
of regions with equal sums the first wins; every row is read for itself.
"""

from __future__ import annotations

import html as entities
import re
import warnings
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textrisk.llm.common import table

MAX_PAGES = 2000
MAX_TAGS = 2000
INSIDE = 0.02  # cost of a tag that occurs only inside content
LEAST = 0.01  # score of a word in blocks that never hold content
CONTENT = ("article", "main")

# HTML's raw-text, void and block elements.
RAW = ("script", "style", "textarea", "title")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog div dl dt fieldset
    figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre
    section summary table tbody td tfoot th thead tr ul""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
DROPPED = frozenset("""nav aside footer header form head menu dialog noscript template iframe svg select
    button""".split())
# Class, id or role words of elements that hold no main text: every part of the word is of one of these two.
DROPPED_NAME = re.compile(
    r"ads?|advert\w*|banner|sponsor\w*|promo\w*|nav|navbar|navigation|menu|breadcrumbs?|sidebar|footer|header|cookies?|consent|"
    r"notices?|popup|modal|newsletter|subscribe|share|social|related|comments?|replies|disqus|widget", re.I)
PLAIN_NAME = re.compile(
    r"list|box|bar|area|section|wrapper|wrap|container|content|block|row|col|inner|outer|site|page|main|top|bottom|left|right|"
    r"items?|links?|icons?|buttons?|media|posts?|articles?|signup|form|slot|unit|thread|\d+", re.I)

TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
    r"|<(?P<raw>" + "|".join(RAW) + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|$)"
    r"|<(?P<close>/?)(?P<name>[A-Za-z][A-Za-z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)"
    r"|(?P<text>[^<]+|<)", re.S | re.I)
NAMES = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def tokens(html: str | None) -> Iterator[tuple[str, str, str]]:
    """(kind, name, value): text, open and close tags in page order. Comments,
    declarations and raw-text elements (their whole content) are no tokens."""
    for m in TOKEN.finditer(html or ""):
        if m["text"] is not None:
            yield "text", "", m["text"]
        elif m["name"]:
            name = m["name"].lower()
            # The id of a heading is an anchor made from its words.
            names = " ".join(a or b or c for key, a, b, c in NAMES.findall(m["attrs"])
                             if key.lower() != "id" or name not in HEADINGS) if m["attrs"] else ""
            yield "close" if m["close"] else "open", name, names
            if not m["close"] and m["attrs"].endswith("/") and name in DROPPED:
                yield "close", name, ""


def feature(kind: str, name: str, names: str) -> str:
    """A tag as the model sees it: with its first class on opening."""
    return f"/{name}" if kind == "close" else f"{name}.{names.split()[0].lower()}" if names.strip() else name


def is_dropped(name: str, names: str) -> bool:
    """Whether an element never holds main text, by its name or a whole word of its names."""
    if name in DROPPED:
        return True
    if name in VOID or name in CONTENT or name in ("html", "body"):
        return False
    for word in names.split():
        parts = [w for w in re.split(r"[-_]+", word) if w]
        if any(map(DROPPED_NAME.fullmatch, parts)) and all(DROPPED_NAME.fullmatch(w) or PLAIN_NAME.fullmatch(w) for w in parts):
            return True
    return False


# Elements whose start ends an open one of the same group, and what such a search does not leave.
ENDS = {"li": (("li",), BLOCKS - {"li", "address", "div", "p"}),
        "dd": (("dd", "dt"), BLOCKS - {"dd", "dt", "address", "div", "p"}),
        "dt": (("dd", "dt"), BLOCKS - {"dd", "dt", "address", "div", "p"}),
        "td": (("td", "th"), frozenset(("tr", "table"))), "th": (("td", "th"), frozenset(("tr", "table"))),
        "tr": (("tr",), frozenset(("table", "tbody", "thead", "tfoot")))}


class Around:
    """The open elements at the current place of a page: blocks, and others that are dropped."""

    def __init__(self):
        self.open: list[tuple[str, str, bool]] = []  # name, feature, dropped
        self.count: Counter = Counter()
        self.dropped = 0

    def _end(self, i: int) -> None:
        name, _, dropped = self.open.pop(i)
        self.count[name] -= 1
        self.dropped -= dropped

    def _cut(self, i: int) -> None:
        while len(self.open) > i:
            self._end(-1)

    def move(self, kind: str, name: str, names: str) -> bool:
        """Follow a tag; whether it belongs to a dropped element (as its own tag or within)."""
        before = self.dropped
        if name in VOID:
            return before > 0
        block = name in BLOCKS
        if kind == "open":
            if block and self.count["p"]:  # a block ends an open paragraph
                i = len(self.open) - 1
                while i >= 0 and self.open[i][0] not in BLOCKS:
                    i -= 1
                if i >= 0 and self.open[i][0] == "p":
                    self._cut(i)
            ended, kept = ENDS.get(name, ((), ()))
            if any(self.count[n] for n in ended):
                i = len(self.open) - 1
                while i >= 0 and self.open[i][0] not in ended and self.open[i][0] not in kept:
                    i -= 1
                if i >= 0 and self.open[i][0] in ended:
                    self._cut(i)
            dropped = is_dropped(name, names)
            if block or dropped or self.count[name] > 0:
                self.open.append((name, feature(kind, name, names), dropped))
                self.count[name] += 1
                self.dropped += dropped
            return self.dropped > 0
        if self.count[name] > 0:
            i = len(self.open) - 1
            while self.open[i][0] != name:
                i -= 1
            if block:
                self._cut(i)
            else:
                self._end(i)
        return before > 0

    def key(self) -> str:
        for name, kind, _ in reversed(self.open):
            if name in BLOCKS:
                return f"in {kind}"
        return "in"


STRETCH = "outside"  # the table's row with the words (o) and the number (i) of stretches outside content


def _label_counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    inside, outside = Counter(), Counter()
    for f in frames:
        for page in f["html"]:
            depth, found, around, stretch = 0, False, Around(), 0
            counts = (Counter(), Counter())  # outside, inside

            def end_stretch() -> None:
                if stretch:
                    counts[0][STRETCH] += stretch
                    counts[1][STRETCH] += 1

            for kind, name, value in tokens(page):
                if kind == "text":
                    n = len(value.split())
                    stretch += n if depth == 0 else 0
                    if not around.dropped:
                        counts[depth > 0][around.key()] += n
                    continue
                left_out = around.move(kind, name, value)
                if name in CONTENT:
                    if depth == 0:
                        end_stretch()
                        stretch = 0
                    depth = depth + 1 if kind == "open" else max(0, depth - 1)
                    found = True
                    counts[0][feature(kind, name, value)] += 1
                elif not left_out:
                    counts[depth > 0][feature(kind, name, value)] += 1
            end_stretch()
            if found:
                outside.update(counts[0])
                inside.update(counts[1])
    names = list(inside | outside)
    if names:
        yield pd.DataFrame({"tag": names, "inside": [inside[n] for n in names], "outside": [outside[n] for n in names]})


def train_weights(pages: DataFrame, id_col: str = "page_id", html_col: str = "html",
                  max_pages: int = MAX_PAGES) -> dict[str, float]:
    """Scores of tags, and of words by the block around them ("in p", ...), from the
    pages that mark their article."""
    marked = pages.where(F.col(html_col).rlike(rf"(?i)<({'|'.join(CONTENT)})\b"))
    n = marked.count()
    if n == 0:
        warnings.warn("no page marks its article: the main text is found without learned weights", stacklevel=2)
        return {}
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(11), F.col(id_col)), 11) / F.lit(float(2 ** 53))
    counts = (marked.where(unit < min(1.0, max_pages / n)).select(F.col(html_col).alias("html"))
              .mapInPandas(_label_counts, "tag string, inside long, outside long")
              .groupBy("tag").agg(F.sum("inside").alias("i"), F.sum("outside").alias("o"))
              .where((F.col("o") > 0) | (F.col("tag") == "in"))  # others score like unknown ones
              .orderBy(F.desc(F.col("tag") == STRETCH), F.desc(F.col("i") + F.col("o")), "tag").limit(MAX_TAGS).collect())
    stretch = next((r["o"] / r["i"] for r in counts if r["tag"] == STRETCH), 0.0)
    return {r["tag"]: max(LEAST, r["i"] / max(1, r["i"] + r["o"])) if r["tag"].startswith("in")
            and r["tag"][2:3] in ("", " ") else -(INSIDE + stretch * r["o"] / (r["i"] + r["o"]))
            for r in counts if r["tag"] != STRETCH}


def weight(weights: dict[str, float], kind: str, name: str, names: str) -> float:
    """An unknown tag counts like its name without class, else as mostly inside."""
    for key in (feature(kind, name, names), f"/{name}" if kind == "close" else name):
        if key in weights:
            return weights[key]
    return -INSIDE


def scores_of(found: list[tuple[str, str, str]], weights: dict[str, float]) -> tuple[list[float], list[bool]]:
    """One score per token, and whether it is left out. A run of text scores its number
    of words times their score, -1 a word outside the article of a page that marks one."""
    around, scores, left_out, depth = Around(), [], [], 0
    label = next((c for c in CONTENT if any(k == "open" and n == c for k, n, _ in found)), None)
    for kind, name, value in found:
        if kind == "text":
            dropped = around.dropped > 0
            block = next((n for n, _, _ in reversed(around.open) if n in BLOCKS), "")
            word = weights.get(around.key(), weights.get(f"in {block}", 1.0))
            scores.append(0.0 if dropped else len(value.split()) * (-1.0 if label and not depth else word))
        else:
            dropped = around.move(kind, name, value)
            if name == label and not dropped:
                depth = depth + 1 if kind == "open" else max(0, depth - 1)
            scores.append(0.0 if dropped else weight(weights, kind, name, value))
        left_out.append(dropped)
    return scores, left_out


def best_region(scores: list[float]) -> tuple[int, int]:
    """[from, to) of the first contiguous run with the largest sum; empty if none is positive."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, span = total, (start, i + 1)
    return span


def main_text(html: str | None, weights: dict[str, float]) -> str:
    found = list(tokens(html))
    scores, left_out = scores_of(found, weights)
    first, last = best_region(scores)
    blocks, words = [], []

    def close_block() -> None:
        text = " ".join("".join(words).split())
        if text:
            blocks.append(text)
        words.clear()

    for (kind, name, value), dropped in zip(found[first:last], left_out[first:last]):
        if kind == "text":
            if not dropped:
                words.append(entities.unescape(value))
        elif name in BLOCKS:
            close_block()
        elif name == "br":
            words.append(" ")
    close_block()
    return "\n".join(blocks)


def extract(pages: DataFrame, weights: dict[str, float], html_col: str = "html") -> DataFrame:
    """``pages`` with their main text in a column ``text`` instead of the html."""
    @F.pandas_udf("string")
    def texts(html: pd.Series) -> pd.Series:
        return html.map(lambda h: main_text(h, weights), na_action=None)

    return pages.withColumn("text", texts(F.col(html_col)))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages.select("page_id", "url", "html"), train_weights(pages)).select(
        "page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
