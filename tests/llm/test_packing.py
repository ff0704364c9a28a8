import random
import zlib

import numpy as np
import pytest

from textrisk.llm.packing import cut_pieces, pack, plan_best_fit, tokenizer

public_tokenizers = pytest.importorskip("public_tokenizers")


def best_fit_sequences(lengths, capacity):
    """Plain best fit, longest first, one piece at a time."""
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in room if r >= n]
        if fits:
            room.remove(min(fits))
            room.append(min(fits) - n)
        else:
            room.append(capacity - n)
    return len(room)


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit_over_counts(seed):
    rnd, capacity = random.Random(seed), 64
    lengths = [rnd.randint(1, capacity if seed % 2 else 20) for _ in range(rnd.randint(1, 600))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    used, slots = {}, {n: [] for n in counts}
    for length, rank, pieces, per, first, offset in plan_best_fit(counts, capacity):
        for r in range(pieces):
            slots[length].append(rank + r)
            used.setdefault(first + r // per, []).append((offset + r % per * length, length))
    assert all(sorted(slots[n]) == list(range(c)) for n, c in counts.items())
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(used) == best_fit_sequences(lengths, capacity)


def test_plan_does_not_grow_with_the_documents():
    rnd = random.Random(3)
    counts = {n: rnd.randint(1, 50) for n in range(1, 513)}
    big = {n: c * 1_000_000 for n, c in counts.items()}
    assert len(plan_best_fit(big, 512)) < 4 * 512 * 8


def test_tokens_equal_the_tokenizer_on_whole_texts():
    rnd = random.Random(1)
    signs = "ab Z9'\"\n\t_-.,!\xbc\xb2\xaa\xba\xb5\xdf\xff\xc0\xd7\xf7 \u0301\xe9 \u03a3\u03c3\u017f\u4e2d1<|> \x85\x1c\xa0"
    texts = ["".join(rnd.choice(signs) for _ in range(50)) for _ in range(500)]
    texts += ["<|endoftext|> x", "a<|startoftext|>b", "don't we'll I'M", "", "word " * 5000]
    t = tokenizer("word_bpe_49k.json")
    whole = [e.ids for e in t.encoder.encode_batch(texts, add_special_tokens=False)]
    assert [a.tolist() for a in t(texts)] == whole


def test_pieces_and_places(docs_of):
    texts = [(1, "hello world"), (2, None), (3, ""), (4, "a b c " * 3000), (5, "a " * 4095), (5, "a " * 4095), (None, "x")]
    got = pack(cut_pieces(docs_of(texts).repartition(3))).toPandas()
    assert len(got) == len(texts) + 2
    t = tokenizer("word_bpe_49k.json")
    for doc, text in texts[:4]:
        ids = np.append(t([text or ""])[0], np.uint32(1)).astype("<u4")
        own = got[got["doc_id"] == doc].sort_values("piece")
        assert own["length"].sum() == len(ids) and (own["length"] <= 4096).all()
        for r in own.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == (s["length"].cumsum() - s["length"]).tolist() and s["length"].sum() <= 4096


def test_empty_table(docs_of):
    assert pack(cut_pieces(docs_of([]))).count() == 0


def test_ranked_words_have_the_tokenizers_ids():
    """Words that the faster encoder takes, by themselves and in texts."""
    from textrisk.llm.packing import WordTokenizer
    tok = WordTokenizer(str(public_tokenizers.path("word_bpe_49k.json")))
    assert tok.fast is not None
    rnd = random.Random(3)
    signs = "etaoinshrdlu" * 4 + "abcdefghijklmnopqrstuvwxyz" + "áéíóúñüäößçàèøþÿµª÷"
    words = ["".join(rnd.choice(signs) for _ in range(rnd.randint(1, 14))) for _ in range(4000)]
    want = [e.ids for e in tok.encoder.encode_batch(words, add_special_tokens=False)]
    assert [x.tolist() for x in tok(words)] == want
    texts = [" ".join(rnd.choice([w, w.upper(), w.capitalize(), w + ".", f"{w},{w}", f"{w}'s", f"{w}9"]) for w in words[a:a + 50])
             for a in range(0, 4000, 50)]
    assert [x.tolist() for x in tok(texts)] == [e.ids for e in tok.encoder.encode_batch(texts, add_special_tokens=False)]
