"""Secret scan in SQL functions: fixed patterns and sliding-window entropy.

Base kinds (assign, access, hex) are pattern matches with a minimum length.
The entropy kinds look at candidate strings of one character class. A window slides
over the candidate; the sum of c log2 c over its character counts is updated by
the character that enters and the one that leaves, and the span runs from the first
to the end of the last window whose Shannon entropy reaches the class's threshold.
Base spans are cut out of the candidates first, and windows slide over what remains. The
allow list is applied to the dense span's segments (between / and =), not to the whole
candidate: a span keeps the parts of it that are not known to be harmless.

Positions count code points, ends are exclusive. A match's start is the length of
the texts between matches and of the matches before it (split and extract of the
same pattern), so only texts with a match pay for positions. What a fold reads at every
step is bound once before it (``let``), and words are cut from their match, not from
the text, so that the work grows with the length of a text.

Defined results: null text is empty; no spans give empty strings and zero counts;
every row is scanned for itself, so repeated rows repeat their results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textrisk.llm.common import table

SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"
BLOCK = 128  # matches listed together: a step of a fold copies the list it adds to

# The base patterns, in the order in which kinds are listed.
ASSIGN = (r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = r"AKIA[A-Z0-9]{14,}"  # a run of 18 or more: shorter runs hold no other match
HEX = r"[0-9a-f]{16,}"  # maximal runs of 16 or more


@dataclass(frozen=True)
class CharClass:
    kind: str
    pattern: str
    window: int
    bits: float


CLASSES = (
    CharClass("entropy_hex", r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{16,}", 16, 2.8),
    CharClass("entropy_base64", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}", 20, 3.6),
)

# Known harmless strings: documentation keys, placeholders, plain alphabets, words joined
# by - or _ (letters whose case does not change within one or two letters, then a short
# number), dates and numbers. Looked for in path segments and dense spans.
ALLOW = (r"(?i:example|sample|placeholder|x{6,}|0123456789|abcdefgh)|^[0-9_+/-]+$"
         r"|^(?!.*(?<![a-z])[a-z]{1,2}[A-Z])(?:[A-Za-z_/+-]+|[A-Za-z]+[_/-][A-Za-z_/-]*[0-9]{1,4})$")
SHORT = 4  # a harmless segment under this length does not part its neighbours: keys hold / too
PIECES = "array<struct<start:int,end:int,word:int,origin:int>>"  # of candidate ``word``, which starts at ``origin``


def _from(c: Column, i: Column) -> Column:
    return F.get(c, i)


def let(value: Column, use) -> Column:
    """``use`` of a value that is evaluated once, however often ``use`` reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _spans(gaps: Column, hits: Column, kept: Column, kind: str, rank: int, least: int) -> Column:
    def step(state: Column, i: Column) -> Column:
        start = state["at"] + F.char_length(_from(gaps, i))
        end = start + F.char_length(_from(hits, i))
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"))
        fits = F.char_length(_from(kept, i)) >= least
        # Cast the one span: a cast of the list would copy all spans so far at every step.
        return F.struct(end.alias("at"), F.when(fits, F.concat(state["out"], F.array(span).cast(SPAN)))
                        .otherwise(state["out"]).alias("out"))

    def block(state: Column, first: Column) -> Column:
        start = F.struct(state["at"].alias("at"), F.array().cast(SPAN).alias("out"))
        inside = F.sequence(first, F.least(first + BLOCK - 1, F.size(hits) - 1))
        return let(F.aggregate(inside, start, step), lambda s: F.struct(
            s["at"].alias("at"), F.concat(state["out"], F.array(s["out"]).cast(f"array<{SPAN}>")).alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
    return F.flatten(F.aggregate(F.sequence(F.lit(0), F.size(hits) - 1, F.lit(BLOCK)), start, block)["out"])


def matches(text: Column, pattern: str, kind: str, rank: int, group: int = 0, least: int = 1) -> Column:
    """Spans of the leftmost non-overlapping matches whose ``group`` has ``least`` characters."""
    def extract(g: int) -> Column:
        return F.regexp_extract_all(text, F.lit(pattern), F.lit(g))

    found = let(F.split(text, pattern, -1), lambda gaps: let(extract(0), lambda hits: (
        _spans(gaps, hits, hits, kind, rank, least) if group == 0 else
        let(extract(group), lambda kept: _spans(gaps, hits, kept, kind, rank, least)))))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPAN))


def _term(c: Column) -> Column:
    """c log2 c, 0 for 0."""
    return F.when(c > 0, c * F.log2(c)).otherwise(F.lit(0.0))


def dense_windows(word: Column, window: int, bits: float) -> Column:
    """struct(lo, hi): start of the first and end of the last window of ``word`` whose
    entropy reaches ``bits``; nulls if none does. The sum of c log2 c changes only by the counts
    of the character that enters and the one that leaves."""
    enough = F.lit(window).cast("double") * (F.log2(F.lit(float(window))) - bits) + 1e-9

    def slide(codes: Column) -> Column:
        def held(i: Column, code: Column) -> Column:
            """How often the window's characters but the entering and the leaving one are ``code``."""
            # By position: a slice would copy the whole word each time.
            inner = F.sequence(F.greatest(i - window + 1, F.lit(0)), i - 1)
            return F.when(i > 0, F.size(F.filter(inner, lambda k: _from(codes, k) == code))).otherwise(0).cast("double")

        def step(state: Column, i: Column) -> Column:
            came = _from(codes, i)
            gone = F.when(i >= window, _from(codes, i - window))

            def changed(more: Column, less: Column) -> Column:
                left = F.when(gone.isNull(), F.lit(0.0)).otherwise(_term(less) - _term(less + 1))
                return F.when(came == gone, state["s"]).otherwise(state["s"] + left + _term(more + 1) - _term(more))

            def state_of(total: Column) -> Column:
                dense = (i >= window - 1) & (total <= enough)
                return F.struct(total.alias("s"), F.when(dense, F.coalesce(state["lo"], i - window + 1)).otherwise(state["lo"]).alias("lo"),
                                F.when(dense, i + 1).otherwise(state["hi"]).alias("hi"))

            return let(let(held(i, came), lambda more: let(held(i, gone), lambda less: changed(more, less))), state_of)

        start = F.struct(F.lit(0.0).alias("s"), F.lit(None).cast("int").alias("lo"), F.lit(None).cast("int").alias("hi"))
        end = F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step)
        return F.struct(end["lo"].alias("lo"), end["hi"].alias("hi"))

    return let(F.transform(F.split(word, ""), lambda ch: F.ascii(ch)), slide)


def _piece(start: Column, end: Column, of: Column) -> Column:
    return F.array(F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"),
                            of["word"].alias("word"), of["origin"].alias("origin"))).cast(PIECES)


def outside(places: Column, base: Column) -> Column:
    """The pieces of ``places`` (disjoint spans of the candidates, in order) that no span of ``base`` covers: one
    pass over both in order of their starts."""
    none = F.lit(None).cast("int")
    events = F.array_sort(F.concat(
        F.transform(base, lambda b: F.struct(b["start"].alias("start"), F.lit(-1).alias("word"), b["end"].alias("end"))),
        F.transform(places, lambda p, i: F.struct(p["start"].alias("start"), i.cast("int").alias("word"), p["end"].alias("end")))))

    def step(state: Column, e: Column) -> Column:
        covers = e["word"] < 0
        stop = F.when(covers, F.least(e["start"], state["end"])).otherwise(state["end"])
        out = F.when(state["at"] < stop, F.concat(state["out"], _piece(state["at"], stop, state))).otherwise(state["out"])
        covered = F.when(covers, F.greatest(state["covered"], e["end"])).otherwise(state["covered"])
        return F.struct(F.when(covers, F.greatest(state["at"], e["end"])).otherwise(F.greatest(e["start"], covered)).alias("at"),
                        F.when(covers, state["end"]).otherwise(e["end"]).alias("end"), covered.alias("covered"),
                        F.when(covers, state["word"]).otherwise(e["word"]).alias("word"),
                        F.when(covers, state["origin"]).otherwise(e["start"]).alias("origin"), out.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("end"), F.lit(0).alias("covered"), none.alias("word"),
                     none.alias("origin"), F.array().cast(PIECES).alias("out"))
    return F.aggregate(events, start, step, lambda s: F.when(s["at"] < s["end"], F.concat(
        s["out"], _piece(s["at"], s["end"], s))).otherwise(s["out"]).cast(PIECES))


def open_runs(piece: Column, word: Column, allow: str) -> Column:
    """The runs of path segments of ``word``, a piece's text, that are not harmless; the
    whole piece if nothing in it is."""
    def step(state: Column, segment: Column) -> Column:
        end = (state["at"] + F.char_length(segment)).cast("int")
        harmless = segment.rlike(allow) & (F.char_length(segment) >= SHORT)
        return F.struct((end + 1).alias("at"), F.when(harmless, end + 1).otherwise(state["run"]).cast("int").alias("run"),
                        F.when(harmless, F.concat(state["out"], _piece(state["run"], state["at"], piece)))
                        .otherwise(state["out"]).alias("out"))

    start = F.struct(piece["start"].alias("at"), piece["start"].alias("run"), F.array().cast(PIECES).alias("out"))
    runs = F.aggregate(F.split(word, "/", -1), start, step,
                       lambda s: F.concat(s["out"], _piece(s["run"], piece["end"], piece)).cast(PIECES))
    return F.when(word.rlike(allow), runs).otherwise(F.array(piece).cast(PIECES))


def entropy_spans(text: Column, base: Column, cls: CharClass, rank: int, allow: str = ALLOW) -> Column:
    def inside(hits: Column, places: Column, base: Column) -> Column:
        def cut(p: Column) -> Column:
            return F.substring(_from(hits, p["word"]), p["start"] - p["origin"] + 1, p["end"] - p["start"])

        def long_enough(pieces: Column) -> Column:
            return F.filter(pieces, lambda p: p["end"] - p["start"] >= cls.window)

        def judge(p: Column) -> Column:
            return let(dense_windows(cut(p), cls.window, cls.bits), lambda seen: F.struct(
                (p["start"] + seen["lo"]).alias("start"), (p["start"] + seen["hi"]).alias("end"),
                p["word"].alias("word"), p["origin"].alias("origin")))

        runs = long_enough(F.flatten(F.transform(long_enough(outside(places, base)), lambda p: open_runs(p, cut(p), allow))))
        dense = F.filter(F.transform(runs, judge), lambda p: p["start"].isNotNull() & ~cut(p).rlike(allow))
        return F.transform(dense, lambda p: F.struct(p["start"].alias("start"), F.lit(rank).alias("rank"),
                                                     F.lit(cls.kind).alias("kind"), p["end"].alias("end"))).cast(SPAN)

    found = let(F.regexp_extract_all(text, F.lit(cls.pattern), F.lit(0)), lambda hits: let(
        F.split(text, cls.pattern, -1), lambda gaps: let(
            _spans(gaps, hits, hits, cls.kind, rank, 1), lambda places: let(base, lambda b: inside(hits, places, b)))))
    return F.when(text.rlike(cls.pattern), found).otherwise(F.array().cast(SPAN))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, text_col: str = "text", classes=CLASSES, allow: str = ALLOW) -> DataFrame:
    """``docs`` with array columns base_spans and all_spans (start, rank, kind, end)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.withColumn("base_spans", F.array_sort(F.concat(
        matches(text, ASSIGN, "assign", 0, group=2, least=12),
        matches(text, ACCESS, "access", 1), matches(text, HEX, "hex", 2))))
    added = [entropy_spans(text, F.col("base_spans"), c, 3 + i, allow) for i, c in enumerate(classes)]
    return found.withColumn("all_spans", F.array_sort(F.concat(F.col("base_spans"), *added)))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", count("assign"), count("access"), count("hex"),
                        F.sha2(listed(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"),
                        listed(F.col("all_spans")).alias("spans"))
