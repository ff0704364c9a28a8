import random

from textrisk.llm.langid import grams, held_out, identify, train

SYLLABLES = {"aa": ["ka", "ro", "ti", "shu"], "bb": ["blen", "dor", "gust", "mir"], "cc": ["\u043c\u0430", "\u0440\u0438", "\u043d\u043e"]}


def rows(n=300, seed=2):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        lang = rnd.choice(list(SYLLABLES))
        out.append((i, " ".join("".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randint(1, 3))) for _ in range(30)), lang))
    return out


def test_held_out_accuracy(docs_of):
    docs = docs_of(rows())
    got = identify(docs, train(docs)).select("doc_id", "lang", held_out().alias("h"), "_lang.*").toPandas()
    held = got[got["h"]]
    assert len(held) > 50 and (held["lang"] == held["lang_pred"]).mean() > 0.98
    assert got["score"].between(0, 1).all()


def test_labels_and_ids_are_no_inputs(docs_of):
    known = rows()
    model = train(docs_of(known))
    other = [(i + 5000, t, None, "elsewhere") for i, t, _ in known[:40]]
    assert ([r.p for r in identify(docs_of(known[:40]), model).selectExpr("_lang.lang_pred p").collect()]
            == [r.p for r in identify(docs_of(other), model).selectExpr("_lang.lang_pred p").collect()])


def test_unseen_words_back_off_to_grams(docs_of):
    model = train(docs_of(rows()))
    got = identify(docs_of([(1, "gustgustgustblendormir"), (2, "tirokashukatiroti")]), model)
    assert [r.p for r in got.selectExpr("_lang.lang_pred p").collect()] == ["bb", "aa"]


def test_edges(docs_of):
    docs = docs_of([*rows(60), (1000, None, None), (1001, "", None), (1002, "123 !! 4_5", None),
                    (1003, "karoti" * 20_000, None),
                    (None, "blen dor", None), (1004, "karo", None)])
    got = {r.doc_id: r for r in identify(docs, train(docs)).select("doc_id", "_lang.*").collect()}
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1000].score == 0
    assert got[1003].lang_pred == "aa" and got[None].lang_pred == "bb"


def test_no_labels_and_empty_table(docs_of):
    docs = docs_of([(1, "karo", None)])
    assert [r.p for r in identify(docs, train(docs)).selectExpr("_lang.lang_pred p").collect()] == ["und"]
    assert identify(docs_of([]), train(docs_of([]))).count() == 0


def test_grams_have_word_edges():
    assert grams("ab", 4) == [" ab "] and grams("a", 4) == [" a "] and grams("ab", 1) == ["a", "b"]
