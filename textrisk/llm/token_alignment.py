"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Both tokenizers write a text as tokens over the same bytes, so each gives an ascending list
of byte ends. The shorter list drives a galloping search into the longer: from the place its
share of the list suggests, steps of 1, 2, 4, ... bracket an end, and a binary search closes
the bracket (all ends of a batch at once, each document inside its own stretch of the
lists). Ends found in both lists cut the tokens into groups; differences of the found ranks
say how many tokens of the longer list each token of the shorter one overlaps. Two tokens
that end together are linked.

Encoding: neither tokenizer joins signs across a single space or newline between other
signs (for the piece model this is read from its pieces; else whole texts are encoded at
once), so texts are cut there and every distinct unit is encoded once per worker.

Corpus counts: the distinct id pairs of a document travel as arrays in one written table. A
pair is common if it is in at least 1 / ``COMMON`` of all (document, pair) rows, so there are
at most ``COMMON`` such pairs at any size; these are broadcast. The rows of all other pairs
are joined by pair, where no key holds more than that share.

Defined results: a text that is null, empty or not reproduced byte for byte by both
tokenizers has no tokens, and zeros; special tokens' strings are plain text; equal rows are
documents of their own; empty tables give empty results. Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textrisk.llm.common import byte_level_alphabet, table, tokenizer_file, worker_cache, written

BYTE_MODEL = "byte_bpe_50k.json"
PIECE_MODEL = "piece_bpe_32k.model"
COMMON = 50_000
BYTE_LEVEL = "ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=True)"
BATCH = 100  # texts aligned together
CACHE_UNITS = 120_000  # per Python worker, twice; what stays unseen for long is dropped and encoded anew


class Side:
    """One tokenizer: ids of a text that starts with a space, and the bytes of each id."""

    def __init__(self, encode, entries: list[bytes], cuts: str):
        self.encode, self.entries, self.cuts = encode, entries, cuts
        self.lengths = np.array([len(e) for e in entries], dtype=np.int64)
        inner = np.array([[f"{i},", f"{i}|", f"{i};"] for i in range(len(entries))], dtype=object)
        self.inside, self.before_bar, self.before_next = inner[:, 0], inner[:, 1], inner[:, 2]

    def same(self, ids: list[int], text: bytes) -> bool:
        return b"".join([self.entries[i] for i in ids]) == text


def byte_side(path: str) -> Side:
    """The byte-level tokenizer of a JSON file. Where its merges make the ids in order, ids are
    ranks and the much faster ``tiktoken`` gives the same tokens; else its own library encodes."""
    import json

    import tiktoken
    from tokenizers import Tokenizer
    model = Tokenizer.from_file(path)
    model.encode_special_tokens = True
    names, alphabet = model.get_vocab(with_added_tokens=False), byte_level_alphabet()
    entries = [b""] * (max(names.values()) + 1)
    for name, i in names.items():
        entries[i] = bytes(alphabet[c] for c in name)
    with open(path, encoding="utf-8") as f:
        merges = json.load(f)["model"]["merges"]
    made = ["".join(m.split(" ") if isinstance(m, str) else m) for m in merges]
    ordered = all(names.get(x) == 256 + k for k, x in enumerate(made)) and len(names) - len(made) in (256, 257)
    if ordered and model.normalizer is None and str(model.pre_tokenizer) == BYTE_LEVEL:
        import public_tokenizers
        ranks = {e: i for i, e in enumerate(entries[:256 + len(made)])}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return Side(fast.encode_ordinary, entries, " \n")
    return Side(lambda text: model.encode(text, add_special_tokens=False).ids, entries, " \n")


def piece_side(path: str) -> Side:
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    entries, cuts = [], set(" \n")
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i).replace("▁", " ")
        if model.is_byte(i):
            entries.append(bytes([int(piece[1:-1], 16)]))
            continue
        entries.append(b"" if model.is_unknown(i) or model.is_control(i) else piece.encode())
        cuts -= {c for c in cuts if c in piece[1:]} if piece.strip(" \n") else set()
    return Side(lambda text: model.encode(text[1:], num_threads=1), entries, "".join(sorted(cuts)))


class Encoder:
    """Ids of both tokenizers, unit by unit. A unit that a single space leads is named by
    what follows the space, any other by itself."""

    ODD = re.compile(r"\s\s|^\s|\s$")

    def __init__(self, a: Side, b: Side):
        self.sides, self.units, self.older = (a, b), ({}, {}), ({}, {})
        self.lines = "\n" in a.cuts and "\n" in b.cuts
        self.words = " " in a.cuts and " " in b.cuts

    def split(self, text: str) -> list[str]:
        if not self.words:
            return [" " + text]
        if not self.ODD.search(text):
            return (text.replace("\n", " \n") if self.lines else text).split(" ")
        units = re.split(r"(?<=\S)(?=[ \n]\S)" if self.lines else r"(?<=\S)(?= \S)", " " + text)
        return [u if u[0] != " " or u[1:2].isspace() or len(u) == 1 else u[1:] for u in units]

    @staticmethod
    def written(unit: str) -> str:
        return unit if unit[0].isspace() else " " + unit

    def learn(self, new: list[str]) -> None:
        """Encode unseen units in one text, as any text holds them, cut again by their byte ends;
        a unit that ends in white space ends its text."""
        joined = [u for u in new if not u[-1].isspace()]
        texts = list(map(self.written, joined))
        text = " |" + "".join(texts)
        stops = np.cumsum([0, *map(len, map(str.encode, texts))])
        parts = []
        for side in self.sides:
            ids = side.encode(text)
            at = np.cumsum(side.lengths[ids]) - 2
            cut = np.minimum(np.searchsorted(at, stops), len(at) - 1)
            if not side.same(ids, text.encode()) or (at[cut] != stops).any():
                break
            held, cut = np.array(ids, dtype="<i4").tobytes(), (4 * cut + 4).tolist()
            parts.append([held[x:y] for x, y in zip(cut, cut[1:], strict=False)])
        else:
            for known, found in zip(self.units, parts, strict=True):
                known.update(zip(joined, found, strict=True))
        for u in new:
            if u not in self.units[0]:
                t = self.written(u)
                ids = [self.alone(side, t) for side in self.sides]
                good = all(side.same(x.tolist(), t.encode()) for side, x in zip(self.sides, ids, strict=True))
                for known, x in zip(self.units, ids, strict=True):
                    known[u] = x.tobytes() if good else None

    @staticmethod
    def alone(side: Side, text: str) -> np.ndarray:
        if text[0] == " ":
            return np.array(side.encode(text), dtype="<i4")
        ids = np.array(side.encode(" |" + text), dtype="<i4")
        return ids[np.searchsorted(np.cumsum(side.lengths[ids]), 2) + 1:]

    def __call__(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both tokenizers, or None for a text without tokens."""
        if len(self.units[0]) > CACHE_UNITS:
            self.units, self.older = ({}, {}), self.units
        split = [self.split(t) if t else [] for t in texts]
        new = set().union(*split).difference(self.units[0])
        kept = new.intersection(self.older[0])
        for known, before in zip(self.units, self.older, strict=True):
            known.update((u, before[u]) for u in kept)
        if len(new) > len(kept):
            self.learn(list(new - kept))
        a, b = (known.__getitem__ for known in self.units)
        out = []
        for s in split:
            x, y = list(map(a, s)), list(map(b, s))
            out.append(None if not s or None in x else (
                np.frombuffer(b"".join(x), dtype="<i4"), np.frombuffer(b"".join(y), dtype="<i4")))
        return out


def gallop(keys: np.ndarray, into: np.ndarray, guess: np.ndarray) -> np.ndarray:
    """Index of the first element of the ascending ``into`` that is not below each key (no key is
    above the last): steps of doubling length from the guess bracket it, halving finds it."""
    last = len(into) - 1
    at = np.clip(guess, 0, last)
    below = into[at] < keys
    lo, hi = np.where(below, at + 1, 0), np.where(below, last, at)
    for way in (1, -1):
        open_, step = np.flatnonzero(below if way == 1 else ~below), 1
        while len(open_):
            probe = np.clip(at[open_] + way * step, 0, last)
            less = into[probe] < keys[open_]
            lo[open_[less]] = probe[less] + 1
            hi[open_[~less]] = probe[~less]
            open_ = open_[less & (probe < last)] if way == 1 else open_[~less & (probe > 0)]
            step *= 2
    open_ = np.flatnonzero(lo < hi)
    while len(open_):
        mid = (lo[open_] + hi[open_]) // 2
        less = into[mid] < keys[open_]
        lo[open_[less]] = mid[less] + 1
        hi[open_[~less]] = mid[~less]
        open_ = open_[lo[open_] < hi[open_]]
    return lo


def common_ends(short: list[np.ndarray], long: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For documents given by their byte ends: the ranks (over all documents) in the two lists
    of the ends that both have, and how many tokens of ``long`` each token of ``short`` overlaps."""
    ns, nl = (np.array([len(x) for x in side]) for side in (short, long))
    base = np.cumsum([0, *(x[-1] for x in short[:-1])])
    first_s, first_l = np.cumsum(ns) - ns, np.cumsum(nl) - nl
    keys = np.concatenate(short) + np.repeat(base, ns)
    into = np.concatenate(long) + np.repeat(base, nl)
    inside = np.arange(len(keys)) - np.repeat(first_s, ns)
    rank = gallop(keys, into, np.repeat(first_l, ns) + inside * np.repeat(nl, ns) // np.repeat(ns, ns))
    both = into[rank] == keys
    overlaps = np.diff(rank, prepend=0) + 1 - np.r_[0, both[:-1]]
    return np.flatnonzero(both), rank[both], overlaps


def aligned(side_a: Side, side_b: Side, a: list[np.ndarray], b: list[np.ndarray]) -> dict[str, list]:
    """Groups, links and overlaps of documents given by their ids; ``a`` is the shorter list of
    all of them or the longer of all of them."""
    ends = [[np.cumsum(side.lengths[x]) for x in ids] for side, ids in ((side_a, a), (side_b, b))]
    a_short = len(a[0]) <= len(b[0])
    x, y, overlaps = common_ends(*(ends if a_short else ends[::-1]))
    end_a, end_b = (x, y) if a_short else (y, x)
    ids_a, ids_b = np.concatenate(a), np.concatenate(b)
    na, nb = np.array([len(i) for i in a]), np.array([len(i) for i in b])
    stop_a, stop_b = np.cumsum(na), np.cumsum(nb)
    doc = np.searchsorted(stop_a, end_a, side="right")

    # Token strings in the order a, a | b, b ; with the sign that follows each.
    sizes_a, sizes_b = np.diff(end_a, prepend=-1), np.diff(end_b, prepend=-1)
    before_b = np.cumsum(sizes_b) - sizes_b
    out = np.empty(len(ids_a) + len(ids_b), dtype=object)
    place_a = np.arange(len(ids_a)) + np.repeat(before_b, sizes_a)
    place_b = np.arange(len(ids_b)) + np.repeat(end_a + 1, sizes_b)
    out[place_a], out[place_b] = side_a.inside[ids_a], side_b.inside[ids_b]
    out[place_a[end_a]], out[place_b[end_b]] = side_a.before_bar[ids_a[end_a]], side_b.before_next[ids_b[end_b]]
    stops = stop_a + stop_b
    groups = ["".join(out[u:v].tolist())[:-1] for u, v in zip(np.r_[0, stops[:-1]], stops, strict=True)]

    pairs, n = np.unique(np.stack([doc, ids_a[end_a], ids_b[end_b]]).astype(np.int64).T @ np.array(
        [1 << 42, 1 << 21, 1], dtype=np.int64), return_counts=True)
    cut = np.searchsorted(pairs >> 42, np.arange(1, len(a)))
    drive = na if a_short else nb
    return {"n_a": na.tolist(), "n_b": nb.tolist(), "n_groups": np.bincount(doc, minlength=len(a)).tolist(),
            "n_overlaps": np.add.reduceat(overlaps, np.cumsum(drive) - drive).tolist(), "groups": groups,
            "a": np.split((pairs >> 21 & (1 << 21) - 1).astype(np.int32), cut),
            "b": np.split((pairs & (1 << 21) - 1).astype(np.int32), cut), "n": np.split(n.astype(np.int32), cut)}


GIVES = ("n_a long, n_b long, n_groups long, n_overlaps long, {groups} string, "
         "a array<int>, b array<int>, n array<int>")


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_model: str = BYTE_MODEL,
          piece_model: str = PIECE_MODEL, hashed: bool = False) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_overlaps, groups, a, b, n): one row per row of ``docs``. ``groups``
    reads ``a1,a2|b1;a3|b2,b3``; a, b, n are the document's distinct linked id pairs and how often
    it has each. ``hashed`` gives groups_sha256 (empty without tokens) instead of groups."""
    name = "groups_sha256" if hashed else "groups"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = worker_cache("token-alignment")
        if (byte_model, piece_model) not in cache:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            cache[byte_model, piece_model] = Encoder(byte_side(tokenizer_file(byte_model)),
                                                     piece_side(tokenizer_file(piece_model)))
        encode = cache[byte_model, piece_model]
        for f in (f.iloc[x:x + BATCH] for f in frames for x in range(0, len(f), BATCH)):
            ids = encode(f["t"].tolist())
            empty = {"n_a": 0, "n_b": 0, "n_groups": 0, "n_overlaps": 0, "groups": "", "a": [], "b": [], "n": []}
            rows = [empty] * len(ids)
            for a_short in (True, False):
                of = [k for k, x in enumerate(ids) if x is not None and (len(x[0]) <= len(x[1])) == a_short]
                if of:
                    got = aligned(*encode.sides, [ids[k][0] for k in of], [ids[k][1] for k in of])
                    for k, row in zip(of, zip(*got.values(), strict=True), strict=True):
                        rows[k] = dict(zip(got, row, strict=True))
            out = pd.DataFrame(rows, columns=list(empty))
            if hashed:
                out["groups"] = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in out["groups"]]
            out.insert(0, "i", f["i"].to_numpy())
            yield out.rename(columns={"groups": name})

    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    kind = texts.schema["i"].dataType.simpleString()
    return texts.mapInPandas(run, f"i {kind}, {GIVES.format(groups=name)}").withColumnRenamed("i", id_col)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(a, b, count, held, best) over all documents of ``rows`` (a, b, n): links, documents that
    have the pair, and whether no other a is linked more often with this b."""
    counts = rows.groupBy("a", "b").agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("held"))
    counts = written(counts, "pair-counts")
    most = counts.groupBy(F.col("b").alias("m")).agg(F.max("count").alias("most"))
    return counts.join(most, F.col("b") == F.col("m")).select(
        "a", "b", "count", "held", (F.col("count") == F.col("most")).alias("best"))


def with_corpus_counts(found: DataFrame, common: int = COMMON) -> DataFrame:
    """``found`` (of ``align``, without its arrays) with n_best, links whose count is the highest
    of their b, and count_sum, the sum of the links' counts."""
    found = written(found.withColumn("_row", F.monotonically_increasing_id()), "aligned")
    rows = found.select("_row", F.explode(F.arrays_zip("a", "b", "n")).alias("_p")).select("_row", "_p.*")
    counts = written(pair_counts(rows), "pair-counts")
    total = counts.agg(F.sum("held")).first()[0] or 0
    often = F.broadcast(counts.where(F.col("held") * common >= total))
    rest = counts.where(F.col("held") * common < total)
    gain = [F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"),
            F.sum(F.col("n") * F.col("count")).alias("count_sum")]
    by_row = (rows.join(often, ["a", "b"]).groupBy("_row").agg(*gain)
              .unionByName(rows.join(often, ["a", "b"], "left_anti").join(rest, ["a", "b"]).groupBy("_row").agg(*gain)))
    sums = by_row.groupBy(F.col("_row").alias("_of")).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return found.drop("a", "b", "n").join(sums, F.col("_row") == F.col("_of"), "left").drop("_row", "_of").withColumns(
        {"n_best": F.coalesce("n_best", F.lit(0)), "count_sum": F.coalesce("count_sum", F.lit(0))})


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_corpus_counts(align(table(spark, sf_dir, "documents"), hashed=True))
    return found.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum",
                        "groups_sha256", "n_overlaps")
