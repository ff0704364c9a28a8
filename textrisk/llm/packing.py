"""Best-fit packing planned on a histogram of lengths.

1. Documents are tokenised and cut into pieces of at most ``capacity`` tokens in
   the scan tasks; pieces are written once, each with its number among the pieces
   of equal length of its task.
2. Best fit, longest first, runs over the counts of the (at most ``capacity``)
   lengths: open sequences are kept as runs of equal free space, a run takes as
   many pieces of a length as fit, and a step of the plan places a whole run of
   ranks. The size of the plan is bounded by ``capacity`` alone: every length ends
   at most one run early, and a run can be changed by fewer than sqrt(2 capacity)
   different lengths.
3. Pieces take the planned slots by joining on their rank within the length:
   task-wise counts give each task its first rank per length, so no task ever
   orders all pieces of one length. The plan is broadcast (bounded as above).

Defined results: a null or empty text is the single end token; repeated rows are
packed as documents of their own; a null doc_id stays null; empty tables give
empty results.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textrisk.llm.common import byte_level_alphabet, table, tokenizer_file, worker_cache, written

CAPACITY = 4096
END_ID = 1
CACHE_WORDS = 200_000  # per Python worker; a full cache is emptied, results do not change
TEXTS = 100  # texts tokenised at a time
TOKENIZER = "word_bpe_49k.json"

class WordTokenizer:
    """Ids of whole texts from ids of their parts.

    The tokenizer drops white space and never joins characters across it, so a text's
    ids are those of its words in order (only space and newline split here, anything
    else is left to it). A word in Latin-1 without apostrophe or <| further falls into
    runs of letters, single digits and runs of other signs, as in the tokenizer's own
    pre-tokenisation; these parts are encoded once per worker.
    """

    PART = re.compile(r"[^\W\d_\xb2\xb3\xb9\xbc-\xbe]+|[\d\xb2\xb3\xb9\xbc-\xbe]|(?:[^\w\s]|_)+")

    PLAIN = re.compile("[a-z\u00e0-\u00f6\u00f8-\u00fe]+")
    TAILS = frozenset(".,;:!?")

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.encoder, self.words, self.parts = Tokenizer.from_file(path), {}, {}
        names = self.encoder.get_vocab(with_added_tokens=True)
        # The last token of a pre-token, and no other, has the end-of-word mark.
        self.ends = np.zeros(max(names.values()) + 1, dtype=bool)
        self.ends[[i for n, i in names.items() if n.endswith("</w>")]] = True
        self.fast = self.ranked(path, names)

    def ranked(self, path: str, names: dict[str, int]):
        """A faster encoder of lower-case words (a-z, U+00E0 to U+00FE but U+00F7): where the merges make the ids
        in order, ids are ranks of byte strings. Capitals never occur in such words, so a capital
        stands for a last letter (its last byte is that of the small one less 32): the mark
        of the end of a word becomes part of its last byte. None for other files."""
        with open(path, encoding="utf-8") as f:
            merges = json.load(f)["model"]["merges"]
        made = ["".join(m.split(" ") if isinstance(m, str) else m) for m in merges]
        if [names.get(m) for m in made] != list(range(512, 512 + len(made))):
            return None
        alphabet, ranks = byte_level_alphabet(), {}
        for name, i in names.items():
            marked = name.endswith("</w>")
            plain = name.removesuffix("</w>")
            if i >= 512 + len(made) or not all(c in alphabet for c in plain):
                continue
            raw = bytes(alphabet[c] for c in plain)
            if not marked and not any(0x41 <= x <= 0x5A or 0x80 <= x <= 0x9E for x in raw):
                ranks[raw] = i
            elif marked and (0x61 <= raw[-1] <= 0x7A or 0xA0 <= raw[-1] <= 0xBE) and not any(
                    0x41 <= x <= 0x5A or 0x80 <= x <= 0x9E for x in raw):
                ranks[raw[:-1] + bytes([raw[-1] - 32])] = i
        self.space = names.get("\u0120")
        if self.space is None or any(bytes([x]) not in ranks for x in (*range(0x41, 0x5B), *range(0x80, 0x9F))):
            return None
        import tiktoken
        for x in range(256):  # the library wants every byte; those left do not occur
            ranks.setdefault(bytes([x]), (1 << 30) + x)
        return tiktoken.Encoding("words", pat_str=r"\S+| ", mergeable_ranks=ranks, special_tokens={})

    def split(self, word: str) -> tuple[str, ...] | list[str]:
        if word.isascii() or max(word, default="") < "\u0100":
            if word.isalpha():
                return (word.lower(),)
            if word[-1:] in self.TAILS and word[:-1].isalpha():
                return word[:-1].lower(), word[-1]
            if word.isprintable() and "'" not in word and "<|" not in word:
                return self.PART.findall(word.lower())
        return (word,)

    def learn(self, new: list[str]) -> None:
        """Encode unseen parts: those of one pre-token in one string, cut at its ends of words, any
        others each for itself."""
        single = [p for p in new if (p.isascii() or max(p) < "\u0100") and (
            p.isalpha() or self.PART.fullmatch(p) and p.isprintable() and "<|" not in p)]
        if self.fast:
            plain = [p for p in single if self.PLAIN.fullmatch(p)]
            if plain:
                ids = np.array(self.fast.encode_ordinary(" ".join([p[:-1] + p[-1].upper() for p in plain])), dtype="<u4")
                self.cut(plain, ids[ids != self.space])
            single = [p for p in single if p not in self.parts]
        if single:
            self.cut(single, np.array(self.encoder.encode_batch_fast([" ".join(single)], add_special_tokens=False)[0].ids,
                                      dtype="<u4"))
        rest = [p for p in new if p not in self.parts]
        for p, e in zip(rest, self.encoder.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            self.parts[p] = np.array(e.ids, dtype="<u4").tobytes()

    def cut(self, single: list[str], ids: np.ndarray) -> None:
        """Note the ids of each part, if there is one end of word for each."""
        cut = [0, *(4 * np.flatnonzero(self.ends[ids]) + 4).tolist()]
        if len(cut) == len(single) + 1 and cut[-1] == 4 * len(ids):
            held = ids.tobytes()
            self.parts.update(zip(single, [held[a:b] for a, b in zip(cut, cut[1:], strict=False)], strict=True))

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        split = [t.replace("\n", " ").split(" ") for t in texts]
        words, parts = self.words, self.parts
        if len(words) > CACHE_WORDS or len(parts) > CACHE_WORDS:
            words.clear()
            parts.clear()
        new = list(set().union(*split).difference(words))
        found = list(map(self.split, new))
        self.learn(list(set().union(*found).difference(parts)))
        words.update(zip(new, [parts[f[0]] if len(f) == 1 else b"".join([parts[p] for p in f]) for f in found], strict=True))
        return [np.frombuffer(b"".join(map(words.__getitem__, ws)), dtype="<u4") for ws in split]


def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer per worker; ``path`` is a file, or a name that the public
    tokenizers' package resolves on the executor."""
    cache = worker_cache("best-fit-packing")
    if path not in cache:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        cache[path] = WordTokenizer(tokenizer_file(path))
    return cache[path]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def cut_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               tokenizer_file: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of every document; ``nth`` counts those of equal length in a task."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(capacity + 1, dtype=np.int64)
        encode, end = tokenizer(tokenizer_file), np.array([end_id], dtype="<u4")
        for frame in (f.iloc[a:a + TEXTS] for f in frames for a in range(0, len(f), TEXTS)):
            out = []
            for doc, part, ids in zip(frame["i"], frame["p"], encode(frame["t"].tolist()), strict=True):
                ids = np.concatenate([ids, end])
                for k, a in enumerate(range(0, len(ids), capacity)):
                    piece = ids[a:a + capacity]
                    out.append((doc, k, a, len(piece), zlib.crc32(piece.tobytes()), part, seen[len(piece)]))
                    seen[len(piece)] += 1
            frame = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])
            yield frame.assign(doc_id=frame["doc_id"].astype("Int64"))

    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.spark_partition_id().alias("p"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return rows.mapInPandas(run, PIECES)


def plan_best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple]:
    """Best fit, longest first, over counts of lengths. Rows (length, first rank,
    pieces, per sequence, first sequence, first offset): the piece of rank r goes to
    sequence first + (r - first rank) // per, after its predecessors there."""
    free: list[tuple[int, int, int]] = []  # (free tokens, first sequence, sequences), sorted
    plan, sequences = [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        at = bisect_left(free, (length, -1, -1))
        while left:
            if at == len(free):  # open as many as the rest needs: one run, filled below
                per = capacity // length
                free.append((capacity, sequences, -(-left // per)))
                sequences += -(-left // per)
            room, first, n = free.pop(at)
            per = room // length
            whole = min(n, left // per)
            pieces = []
            if whole:
                plan.append((length, rank, whole * per, per, first, capacity - room))
                pieces.append((room - per * length, first, whole))
                rank, left = rank + whole * per, left - whole * per
            if whole < n and left:  # the rest of this length ends inside the next sequence
                plan.append((length, rank, left, left, first + whole, capacity - room))
                pieces.append((room - left * length, first + whole, 1))
                rank, left, whole = rank + left, 0, whole + 1
            if whole < n:
                pieces.append((room, first + whole, n - whole))
            # What still has room for this length stands only where left is 0.
            for p in pieces:
                if p[0]:
                    insort(free, p)
            at = bisect_left(free, (length, -1, -1))
    return plan


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give every piece a sequence_id and an offset."""
    spark = pieces.sparkSession
    pieces = written(pieces, "pieces")
    per_task = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    first = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    per_task = per_task.select("part", "length", first.alias("before"))
    # At most `capacity` rows come to the driver.
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = np.array(sorted(plan_best_fit(counts, capacity)), dtype=np.int64).reshape(-1, 6)
    held = spark.sparkContext.broadcast(plan)

    @F.pandas_udf("sequence_id long, offset long")
    def slot(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        rows = held.value
        # Ranks restart at each length; the step is the last with a first rank <= rank.
        lengths, starts = rows[:, 0], rows[:, 1]
        span = np.int64(max(int(starts.max()), int(rank.max())) + 1)
        step = np.searchsorted(lengths * span + starts, length.to_numpy() * span + rank.to_numpy(), side="right") - 1
        inside, per = rank.to_numpy() - starts[step], rows[step, 3]
        return pd.DataFrame({"sequence_id": rows[step, 4] + inside // per,
                             "offset": rows[step, 5] + inside % per * length.to_numpy()})

    placed = (pieces.join(per_task, ["part", "length"])
              .withColumn("_slot", slot("length", F.col("before") + F.col("nth"))))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "_slot.sequence_id", "_slot.offset")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(cut_pieces(table(spark, sf_dir, "documents")))
