"""Token alignment against a plain walk over the bytes of both encodings."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("sentencepiece")
pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

from textrisk.llm import token_alignment as T  # noqa: E402


@pytest.fixture(scope="module")
def plain():
    """(ids and bytes of A, ids and bytes of B) of a text by the libraries themselves."""
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(str(public_tokenizers.path(T.BYTE_MODEL)))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path(T.PIECE_MODEL)))
    names = {i: n for n, i in a.get_vocab().items()}
    plain_bytes = [*range(33, 127), *range(161, 173), *range(174, 256)]
    sign = {chr(x): x for x in plain_bytes}
    for k, x in enumerate(x for x in range(256) if x not in plain_bytes):
        sign[chr(256 + k)] = x

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    def run(text):
        ids = a.encode(" " + text, add_special_tokens=False).ids
        other = b.encode(text, num_threads=1)
        return (ids, [bytes(sign[c] for c in names[i]) for i in ids]), (other, [piece(i) for i in other])
    return run


def brute(docs, plain):
    rows, links = [], []
    for d, text in docs:
        own, groups = [], []
        (a, ab), (b, bb) = plain(text) if text else (([], []), ([], []))
        want = (" " + (text or "")).encode()
        if not text or b"".join(ab) != want or b"".join(bb) != want:
            a, b = [], []
        i = j = x = y = 0
        part = ([], [])
        while i < len(a) or j < len(b):
            if x <= y:
                x += len(ab[i])
                part[0].append(a[i])
                i += 1
            else:
                y += len(bb[j])
                part[1].append(b[j])
                j += 1
            if x == y:
                own.append((a[i - 1], b[j - 1]))
                groups.append(",".join(map(str, part[0])) + "|" + ",".join(map(str, part[1])))
                part = ([], [])
        rows.append((d, len(a), len(b), groups))
        links.append(own)
    count = Counter(p for own in links for p in own)
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for (d, na, nb, groups), own in zip(rows, links, strict=True):
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((d, na, nb, len(groups), len(own), sum(count[p] == best[p[1]] for p in own),
                    sum(count[p] for p in own), sha, na + nb - len(groups)))
    return sorted(out, key=repr)


def run(spark, docs, folder):
    spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, a int, groups string").write.parquet(
        f"{folder}/documents.parquet")
    return sorted((tuple(r) for r in T.op12_token_alignment(spark, str(folder)).collect()), key=repr)


SIGNS = ["a", "the", " ", " ", "  ", "\n", "\n\n", "\t", "é", "日本", " ", "　", "'s", ".", "1", "23", "<s>",
         "<|endoftext|>", "<0x41>", "▁", "Word", "́", "😀", "\r\n", "ünïcode", "-", "\x1c", "\u0000"]


def odd_texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(SIGNS) for _ in range(r.randrange(1, 25))) for _ in range(n)]


def test_encoder_equals_the_libraries(plain):
    encode = T.Encoder(T.byte_side(str(public_tokenizers.path(T.BYTE_MODEL))),
                       T.piece_side(str(public_tokenizers.path(T.PIECE_MODEL))))
    texts = odd_texts(1500, 1) + [" ", "\n", "  x", "x ", "\nx", "x\n y", "a b", " \nfoo"]
    for x in range(0, len(texts), 50):
        for text, got in zip(texts[x:x + 50], encode(texts[x:x + 50]), strict=True):
            (a, ab), (b, bb) = plain(text)
            whole = (" " + text).encode()
            if b"".join(ab) != whole or b"".join(bb) != whole:
                assert got is None, text
            else:
                assert (got[0].tolist(), got[1].tolist()) == (a, b), text


def test_gallop_finds_first_not_below():
    r = np.random.default_rng(1)
    for _ in range(100):
        into = np.unique(r.integers(0, 300, r.integers(1, 80)))
        keys = np.sort(r.integers(-5, into[-1] + 1, 40))
        guess = r.integers(-3, len(into) + 3, 40)
        assert T.gallop(keys, into, guess).tolist() == np.searchsorted(into, keys).tolist()


def test_query_matches_plain_walk(spark, plain, tmp_path):
    docs = list(enumerate(odd_texts(150, 2)))
    docs += [(200, None), (201, ""), (202, "The quick brown fox. " * 3000), (203, "x" * 20_000), (None, "null id"),
             (5, docs[5][1]), (5, "another text")]
    assert run(spark, docs, tmp_path / "a") == brute(docs, plain)
    assert run(spark, [], tmp_path / "b") == []


def test_common_and_rare_pairs_give_the_same_counts(spark, plain, as_rows):
    """Whichever pairs are broadcast, the result is the same."""
    docs = spark.createDataFrame(list(enumerate(odd_texts(60, 3))), "doc_id long, text string")
    found = T.align(docs)
    all_ = as_rows(T.with_corpus_counts(found))
    assert as_rows(T.with_corpus_counts(found, common=1)) == all_
    assert as_rows(T.with_corpus_counts(found, common=40)) == all_
    for r in found.collect():
        if r["n_a"]:
            parts = [g.split("|") for g in r["groups"].split(";")]
            assert sum(len(p[0].split(",")) for p in parts) == r["n_a"] and len(parts) == r["n_groups"]
            assert Counter(dict(zip(zip(r["a"], r["b"], strict=True), r["n"], strict=True))) == Counter(
                (int(p[0].split(",")[-1]), int(p[1].split(",")[-1])) for p in parts)


def test_driver_rows(spark, plain):
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in T.op12_token_alignment(spark, sf).collect()), key=repr)
    assert got == brute(docs, plain)
