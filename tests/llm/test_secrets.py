import hashlib
import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from textrisk.llm.secrets import dense_windows, op3_secret_scan, scan_secrets

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
TEXTS = [
    (1, None), (2, ""), (3, "plain words only"), (4, "é token = \"0123456789abcdef01\" and PassWord:abcdefghijkl"),
    (5, "token=secret: verylongvalue123456"), (6, "AKIAABCDEFGHIJKLMN AKIASHORT AKIA" + "Z9" * 20),
    (7, "x" * 50_000 + " deadbeefdeadbeef"), (8, "api_key='aB3dE5gH7jK9mN1pQ3sT5'\n" * 30),
    (9, "see Q7xT2mPz9LwK4vRbN8sYc1Hd here"), (10, "key EXAMPLEQ7xT2mPz9LwK4vRbN8sYc1Hd"), (10, "repeated"), (10, "repeated"),
    (11, "averyveryverylonglowercaseword and some-long-hyphenated-words-12"), (None, "AKIAABCDEFGHIJKLMN"),
    (12, "AABBCCDDEEFF00112233 in upper hex 9F3A7C51E08B2D46F7A1"),
]


def base(text):
    t = text or ""
    spans = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if len(m.group(1)) >= 12]
    spans += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m.group()) >= 18]
    spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m.group()) >= 16]
    return sorted(spans)


def test_base_spans_match_plain_patterns(docs_of):
    rnd = random.Random(3)
    parts = ["token", "Secret", "=", ":", " ", "'", '"', "abcdef0123456789", "AKIA", "ABCD1234", "passwd", "é", "\n", "API_KEY", "z" * 12]
    texts = TEXTS + [(100 + i, "".join(rnd.choice(parts) for _ in range(25))) for i in range(300)]
    got = scan_secrets(docs_of(texts)).select("doc_id", "text", "base_spans", "all_spans").collect()
    assert len(got) == len(texts)
    for r in got:
        assert [tuple(s) for s in r.base_spans] == base(r.text)
        assert set(r.base_spans) <= set(r.all_spans)


def test_entropy_adds_and_allow_list_suppresses(docs_of):
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.all_spans] for r in
           scan_secrets(docs_of([t for t in TEXTS if t[0] in (9, 10, 11, 12)][:5])).collect()}
    assert got[9] == [("entropy_base64", 4, 28)] and got[10] == []
    assert all(got.get(i, []) == [] for i in (11,))


def test_windows_match_brute_force(spark):
    rnd = random.Random(9)
    words = ["".join(rnd.choice("ab12XYZ9") if rnd.random() < 0.5 else rnd.choice("qwertzuiopQWERT0123456789") for _ in range(n))
             for n in (1, 15, 16, 17, 40, 90) for _ in range(6)]
    for bits in (2.5, 3.2):
        df = spark.createDataFrame([(w,) for w in words], "w string")
        for r in df.select("w", dense_windows(F.col("w"), 16, bits).alias("d")).collect():
            hits = [i for i in range(len(r.w) - 15) if -sum(c / 16 * math.log2(c / 16) for c in Counter(r.w[i:i + 16]).values()) >= bits - 1e-10]
            assert (r.d.lo, r.d.hi) == ((hits[0], hits[-1] + 16) if hits else (None, None))


def test_query_digest(spark):
    got = {r.doc_id: r for r in op3_secret_scan(spark, "/root/testdata/sf0.001").collect()}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        spans = base(r.text)
        joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)
        assert got[r.doc_id].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert got[r.doc_id].n_hex == sum(s[2] == "hex" for s in spans)


def test_no_python_in_the_plan(spark, docs_of):
    plan = scan_secrets(docs_of(TEXTS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert scan_secrets(docs_of([])).count() == 0


RANDOM = "tQ9vLz3KfW8nRb2XyJ5mHc7GpD4sUa6EoT1iYwZk"


def test_windows_slide_over_what_base_spans_and_harmless_segments_leave(docs_of):
    def dense(text):
        return [text[s.start:s.end] for s in scan_secrets(docs_of([(1, text)])).collect()[0].all_spans if s.kind == "entropy_base64"]

    assert dense(f"see hooks/example/{RANDOM} here") == [RANDOM]
    assert RANDOM in dense(f"see 0a1b2c3d4e5f6071/{RANDOM} here")[0]
    assert dense("key QwErTyUiOpAsDfGhJkLzXcVb here") == ["QwErTyUiOpAsDfGhJkLzXcVb"]  # no digit
    slashed = RANDOM[:12] + "/ab/" + RANDOM[12:26]
    assert dense(f"k {slashed} e") == [slashed]
    for harmless in ("src/main/resources/templates/example/index", "AbstractSingletonProxyFactoryBean", "EXAMPLE" + RANDOM,
                     "some_LONG-words/with-slashes-2024", "queelleaiierelletion"):
        assert dense(f"a {harmless} b") == [], harmless


def test_time_grows_with_the_text(docs_of):
    """A run of 100,000 characters and 20,000 matches take seconds."""
    import time
    rnd = random.Random(6)
    run = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(100_000))
    many = " ".join(f"{rnd.getrandbits(64):016x}" for _ in range(20_000))
    scan_secrets(docs_of([(0, "token=abcdefabcdef " + RANDOM)])).collect()  # compile
    for text in (run, many):
        start = time.time()
        row = scan_secrets(docs_of([(1, text)])).collect()[0]
        assert time.time() - start < 60
        if text is many:
            assert len(row.base_spans) == 20_000
        else:
            assert [(s.start, s.end) for s in row.all_spans] == [(0, 100_000)]


def test_spans_go_on_across_blocks_of_matches(docs_of):
    """Spans are listed by blocks: their places and order do not depend on where a block ends."""
    import re
    texts = [" é ".join(f"{j:016x}" for j in range(n)) for n in (1, 127, 128, 129, 257)]
    got = {r.doc_id: r for r in scan_secrets(docs_of(list(enumerate(texts)))).collect()}
    for i, text in enumerate(texts):
        want = [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]{16,}", text)]
        assert [(s.kind, s.start, s.end) for s in got[i].base_spans] == want
