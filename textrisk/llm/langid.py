"""Language identification: known words first, then shorter and shorter n-grams.

Training (bounded sample of labelled rows): words of each language are counted,
words with at least ``MIN_COUNT`` occurrences make up the word table, and the
character n-grams (4 down to 1, with word edges) of all training words the
backoff tables. A word of the text scores by its log frequency in each language if
it is in the word table; otherwise each of its 4-grams scores, and a 4-gram that
is unknown backs off to its 3-grams and so on, with a fixed penalty per step.

The score is the posterior of the winning language under equal priors, of the
mean score per word sharpened by ``SHARPEN`` (so that long texts do not all read
1.0). Text without any letter, or null, is ``und`` with score 0.

Bounds: ``MAX_ROWS_PER_LANG`` labelled rows per language (by hash of doc_id, the
same rows on every run) and ``MAX_WORDS``/``MAX_GRAMS`` table entries per language;
the tables are broadcast. Every document is scored over its whole text.

Ties go to the language that sorts first. No labelled row: every text is ``und``.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textrisk.llm.common import table, worker_cache

MAX_ROWS_PER_LANG = 3000
MAX_WORDS = 20_000
MAX_GRAMS = 20_000
MAX_LANGS = 500
MIN_COUNT = 3
LONGEST = 4
PENALTY = -1.0
SHARPEN = 8.0
CACHE_WORDS = 300_000
NOT_LETTERS = re.compile(r"[\W\d_]+")


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _letters(text: str) -> list[str]:
    return [w for w in NOT_LETTERS.split(text.lower()) if w]


def grams(word: str, n: int) -> list[str]:
    edged = f" {word} " if n > 1 else word
    return [edged[i:i + n] for i in range(len(edged) - n + 1)] or [edged]


def _count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: dict[str, Counter] = {}
    for frame in frames:
        for lang, text in zip(frame["lang"], frame["text"], strict=True):
            counts.setdefault(lang, Counter()).update(_letters(text))
    for lang, c in counts.items():
        yield pd.DataFrame({"lang": lang, "word": list(c), "n": np.fromiter(c.values(), dtype=np.int64, count=len(c))})


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          max_rows: int = MAX_ROWS_PER_LANG) -> dict:
    """The model from the labelled rows that are not held out."""
    rows = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = rows.groupBy(F.col(lang_col).alias("lang")).count().limit(MAX_LANGS + 1).collect()
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not sizes:
        return {"name": uuid.uuid4().hex, "langs": [], "words": {}, "grams": {}}
    rate = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1.0, max_rows / r["count"])))])
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(5), F.col(id_col)), 11) / F.lit(float(2 ** 53))
    sample = rows.where(unit < rate[F.col(lang_col)]).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = (sample.mapInPandas(_count, "lang string, word string, n long")
              .groupBy("lang", "word").agg(F.sum("n").alias("n")))
    # Bounded by the sample; the commonest words per language are what is kept.
    top = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    kept = counts.withColumn("r", F.row_number().over(top)).where(F.col("r") <= 2 * MAX_WORDS).drop("r").toPandas()
    langs = sorted(r["lang"] for r in sizes)
    return build(kept, langs)


def build(counts: pd.DataFrame, langs: list[str]) -> dict:
    """Log frequency tables: {entry: row of one score per language}."""
    def logs(per: list[Counter], most: int, least: int) -> dict[str, np.ndarray]:
        names = {w for c in per for w, n in c.most_common(most) if n >= least}
        totals = [sum(c.values()) + len(names) + 1 for c in per]
        return {w: np.array([np.log((c[w] + 0.5) / t) for c, t in zip(per, totals, strict=True)]) for w in names}

    per = []
    for lang in langs:
        own = counts[counts["lang"] == lang]
        per.append(Counter(dict(zip(own["word"], own["n"].tolist(), strict=True))))
    tables = {}
    for n in range(LONGEST, 0, -1):
        sums = []
        for c in per:
            total: Counter = Counter()
            for w, k in c.items():
                for g in grams(w, n):
                    total[g] += k
            sums.append(total)
        tables[n] = logs(sums, MAX_GRAMS, MIN_COUNT)
    return {"name": uuid.uuid4().hex, "langs": langs, "words": logs(per, MAX_WORDS, MIN_COUNT), "grams": tables}


class Rows:
    """Score rows by name in one growing matrix."""

    def __init__(self, width: int):
        self.at, self.rows = {}, np.zeros((1024, width))

    def add(self, names: list[str], rows: np.ndarray) -> None:
        first = len(self.at)
        while first + len(names) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[first:first + len(names)] = rows
        self.at.update(zip(names, range(first, first + len(names)), strict=True))

    def get(self, names: list[str]) -> np.ndarray:
        return self.rows[np.fromiter(map(self.at.__getitem__, names), dtype=np.int64, count=len(names))]

    def missing(self, names) -> list[str]:
        return [n for n in names if n not in self.at]


class Scorer:
    """Word and n-gram scores of one model, remembered (up to CACHE_WORDS of each).
    Unseen names are scored together, all words of a text at a time."""

    def __init__(self, model: dict):
        self.model = model
        self.clear()

    def clear(self) -> None:
        width = len(self.model["langs"])
        self.words, self.grams = Rows(width), {n: Rows(width) for n in range(1, LONGEST + 1)}

    def means(self, parts: list[list[str]], n: int) -> np.ndarray:
        """Row i: mean score of the n-grams parts[i] (none of them empty)."""
        flat = [g for p in parts for g in p]
        self.learn_grams(set(flat), n)
        counts = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        starts = np.cumsum(counts) - counts
        return np.add.reduceat(self.grams[n].get(flat), starts, axis=0) / counts[:, None]

    def learn_grams(self, names, n: int) -> None:
        """An n-gram's own score, else with a penalty the mean of its shorter ones."""
        new, own = self.grams[n].missing(names), self.model["grams"].get(n, {})
        known = [g for g in new if g in own]
        if known:
            self.grams[n].add(known, np.stack([own[g] for g in known]))
        rest = [g for g in new if g not in own]
        if rest and n == 1:
            self.grams[n].add(rest, np.zeros((len(rest), len(self.model["langs"]))))
        elif rest:
            self.grams[n].add(rest, PENALTY + self.means(
                [[g[i:i + n - 1] for i in range(max(1, len(g) - n + 2))] for g in rest], n - 1))

    def learn_words(self, names) -> None:
        """A known word's own score, else that of its n-grams; 0 for the best language."""
        new, own = self.words.missing(names), self.model["words"]
        known, rest = [w for w in new if w in own], [w for w in new if w not in own]
        for part, rows in ((known, lambda: np.stack([own[w] for w in known])),
                           (rest, lambda: PENALTY + self.means([grams(w, LONGEST) for w in rest], LONGEST))):
            if part:
                scores = rows()
                self.words.add(part, scores - scores.max(axis=1, keepdims=True))

    def __call__(self, text: str | None) -> tuple[str, float]:
        found = _letters(text or "")
        if not found or not self.model["langs"]:
            return "und", 0.0
        if max(len(self.words.at), *(len(r.at) for r in self.grams.values())) > CACHE_WORDS:
            self.clear()
        self.learn_words(set(found))
        mean = self.words.get(found).mean(axis=0)
        odds = np.exp(SHARPEN * (mean - mean.max()))
        best = int(np.argmax(mean))
        return self.model["langs"][best], float(odds[best] / odds.sum())


def scorer(model: dict) -> Scorer:
    """The worker's scorer of this model."""
    cache = worker_cache("language-scorers")
    if model["name"] not in cache:
        cache.clear()
        cache[model["name"]] = Scorer(model)
    return cache[model["name"]]


def identify(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score. Only the text is read for a prediction."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(frames: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        score = scorer(held.value)
        for texts in frames:
            yield pd.DataFrame([score(t) for t in texts], columns=["lang_pred", "score"])

    return docs.withColumn("_lang", predict(F.col(text_col)))


def with_letters(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows in whose text a language could be found: those with a letter."""
    @F.pandas_udf("boolean")
    def some(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: bool(_letters(t or "")), na_action=None).astype(bool)

    return docs.where(some(F.col(text_col)))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs)).select(
        "doc_id", held_out().alias("held_out"), "_lang.lang_pred", "_lang.score")
