"""Merkle dataset manifest with pointer-jumping proofs.

Rows are leaves: SHA-256 of their fields, each written as ``-`` (null) or byte count,
``:``, value. Within a group (language) leaves ascend by id; every ``FANOUT`` consecutive
nodes (the last run may be shorter) become the digest of their joined hex digests, until
one node, the subroot, remains. The subroots, ordered by group, form the top tree in the
same way; its last node is the root of the dataset.

A run (the nodes that share a parent) is one row: its nodes have the same ancestors, so
the run carries their common path. Every run starts with the segment to its parent run:
the siblings left and right of its own digest there. Repeated self-joins replace the
ancestor a run points to by that one's ancestor and append its segment, so the distance
doubles each round until all runs reach the root; the leaves then leave their runs with
one more step, their own siblings. After a join over distance d up to ``FANOUT ** d`` runs
share an ancestor; ancestors are replicated over salts, so that at most ``FANOUT ** 2``
rows meet in one key at any size.

Defined results: ids ascend with null first; rows that repeat an id are leaves of their
own, ordered by their digest; a null group is a group of its own, before all others; a
group of one leaf has that leaf as its subroot, a manifest of one group its subroot as
root. Nulls, empty and long texts hash as their fields say. An empty table gives no rows.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textrisk.functions.ranking import rank_within
from textrisk.llm.common import UPPER, table, written

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TOP = "top"  # group keys of the rows start with "g"
SALTED_FROM = 3  # ancestor distance from which keys are salted
RUN = ["grp", "level", "run"]
PATH = "array<struct<left:string,right:string>>"


def digest(*hex_or_text: Column) -> Column:
    return F.sha2(F.concat(*hex_or_text).cast("binary"), 256)


def field(c: Column) -> Column:
    text = c.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(values: Sequence[Column]) -> Column:
    return digest(*[field(v) for v in values])


def fold(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` leads to along ``path``."""
    return F.aggregate(path, leaf, lambda acc, step: digest(step["left"], acc, step["right"]))


def _siblings(digests: Column, place: Column) -> Column:
    """(left, right): the joined digests before and after ``place`` (from 0)."""
    return F.struct(F.concat_ws("", F.slice(digests, F.lit(1), place)).alias("left"),
                    F.concat_ws("", F.slice(digests, place + 2, F.size(digests))).alias("right"))


def _tree(leaves: DataFrame, fanout: int) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """The trees of all groups of ``leaves`` (grp, pos from 0, digest, member).

    Returns (first, upper, tops): the level-0 runs with their members, the runs above, and
    (grp, digest) of each group's last node. A lone node is passed on unhashed: it is the
    only one of run 0, for runs fill from the left."""
    def runs_of(nodes: DataFrame, level: int, *more: str) -> DataFrame:
        runs = nodes.groupBy("grp", F.floor(F.col("pos") / fanout).alias("run")).agg(
            F.array_sort(F.collect_list(F.struct("pos", "digest", *more))).alias("nodes"))
        lone = (F.col("run") == 0) & (F.size("nodes") == 1)
        digests = F.col("nodes.digest")
        return runs.select("grp", F.lit(level).alias("level"), "run", lone.alias("lone"), digests.alias("digests"),
                           F.when(lone, F.get("nodes", F.lit(0))["digest"]).otherwise(
                               F.sha2(F.concat_ws("", digests).cast("binary"), 256)).alias("digest"),
                           *[F.col(f"nodes.{m}").alias(m) for m in more])

    first = written(runs_of(leaves, 0, "member"), "merkle-runs")
    upper, tops, at = None, first.where("lone"), first.where("not lone").drop("member")
    level = 0
    while not at.isEmpty():
        level += 1
        nodes = at.select("grp", F.col("run").alias("pos"), "digest")
        step = written(runs_of(nodes, level), "merkle-runs")
        tops = tops.unionByName(step.where("lone"), allowMissingColumns=True)
        at = step.where("not lone")
        upper = at if upper is None else upper.unionByName(at)
    return first, upper, tops.select("grp", "digest")


def _jump(runs: DataFrame, parents: DataFrame, tops: DataFrame, fanout: int) -> DataFrame:
    """(grp, level, run, path, subroot) of every run, its path reaching the root.

    ``runs``: (grp, level, run, digest) of all runs, ``parents``: (grp, level, run, digests)
    of those that are hashed, ``tops``: (grp, subroot, place) in the top tree."""
    up = parents.select(F.col("grp").alias("p_grp"), F.col("level").alias("p_level"), F.col("run").alias("p_run"),
                        "digests")
    here = F.struct(*RUN)

    def linked(rows: DataFrame, grp: Column, level: Column, place: Column) -> DataFrame:
        run, inside = F.floor(place / fanout), (place % fanout).cast("int")
        found = rows.join(up, (grp == up["p_grp"]) & (level == up["p_level"]) & (run == up["p_run"]), "left")
        anc = F.when(F.col("p_grp").isNotNull(), F.struct(
            F.col("p_grp").alias("grp"), F.col("p_level").alias("level"), F.col("p_run").alias("run")))
        step = F.when(F.col("p_grp").isNotNull(), F.array(_siblings(F.col("digests"), inside))).otherwise(
            F.array().cast(PATH))
        return found.select(here.alias("me"), anc.alias("anc"), step.alias("path"), "subroot")

    # The last run of a group has no parent in its own tree, all others have one.
    inner = linked(runs.withColumn("subroot", F.lit(None).cast("string")), F.col("grp"), F.col("level") + 1, F.col("run"))
    last = inner.where("anc is null").select("me.*").join(tops, "grp")
    outer = linked(last, F.lit(TOP), F.lit(0), F.col("place"))
    ends = inner.where(f"anc is null and me.grp = '{TOP}'")
    at = written(inner.where("anc is not null").unionByName(outer).unionByName(ends), "merkle-jump")
    distance = 1
    while not at.where("anc is not null").isEmpty():
        salts = fanout ** max(0, distance - SALTED_FROM + 1)
        far = at.select(F.col("me").alias("f_me"), F.col("anc").alias("f_anc"), F.col("path").alias("f_path"),
                        F.col("subroot").alias("f_subroot"),
                        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("f_salt"))
        if salts > 1:  # nothing is as far below a run of a level less than the distance
            far = far.where(F.col("f_me.level") + F.when(F.col("f_me.grp") == TOP, distance).otherwise(0) >= distance)
        near = at.where("anc is not null").withColumn("salt", F.pmod(F.xxhash64("me"), F.lit(salts)).cast("int"))
        moved = near.join(far, (near["anc"] == far["f_me"]) & (near["salt"] == far["f_salt"])).select(
            "me", F.col("f_anc").alias("anc"), F.concat("path", "f_path").alias("path"),
            F.coalesce("subroot", "f_subroot").alias("subroot"))
        at = written(at.where("anc is null").unionByName(moved), "merkle-jump")
        distance *= 2
    return at.select("me.*", "path", "subroot")


def merkle_manifest(docs: DataFrame, leaf: Column, id_col: str = "doc_id", group_col: str = "lang",
                    carry: Sequence[Column] = (), fanout: int = FANOUT) -> tuple[DataFrame, str | None]:
    """(proofs, root). ``proofs`` has one row per row of ``docs``: id, leaf, subroot, path
    (left and right siblings from the leaf up to the root) and a struct of the ``carry``
    columns; ``fold(leaf, path)`` gives the root."""
    group = F.col(group_col).cast("string")
    member = F.struct(F.col(id_col).alias("id"), *carry)
    rows = written(docs.select(F.when(group.isNull(), "g").otherwise(F.concat(F.lit("g="), group)).alias("grp"),
                               member.alias("member"), leaf.alias("digest"))
                   .withColumn("id", F.col("member.id")), "merkle-leaves")
    ranked = rank_within(rows, ["grp"], ["id", "digest"], "pos").withColumn("pos", F.col("pos") - 1)
    first, upper, subroots = _tree(ranked, fanout)
    tops = rank_within(subroots.withColumn("all", F.lit(TOP)), ["all"], ["grp"], "pos").withColumn(
        "place", F.col("pos") - 1)
    t_first, t_upper, t_top = _tree(tops.select(
        F.lit(TOP).alias("grp"), F.col("place").alias("pos"), "digest", F.col("grp").alias("member")), fanout)
    root = t_top.select("digest").first()

    keys = [*RUN, "digest"]
    runs, parents = first.select(*keys), t_first.where("not lone").select(*RUN, "digests")
    runs = runs.unionByName(t_first.where("not lone").select(*keys))
    for more in (upper, t_upper):
        if more is not None:
            runs, parents = runs.unionByName(more.select(*keys)), parents.unionByName(more.select(*RUN, "digests"))
    parents = parents.unionByName(first.where("not lone").select(*RUN, "digests"))
    paths = _jump(runs, parents, tops.select("grp", F.col("digest").alias("subroot"), "place"), fanout)

    held = first.join(paths.where(f"level = 0 and grp <> '{TOP}'").drop("level"), ["grp", "run"])
    leaves = held.select("lone", "digests", "path", "subroot", F.posexplode("member").alias("place", "member"))
    own = F.when(F.col("lone"), F.array().cast(PATH)).otherwise(
        F.array(_siblings(F.col("digests"), F.col("place"))))
    return leaves.select(F.col("member.id").alias("id"), F.get("digests", F.col("place")).alias("leaf"), "subroot",
                         F.concat(own, "path").alias("path"), "member"), root["digest"] if root else None


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lowered = F.translate(F.col("text"), UPPER, UPPER.lower())
    named = [F.col(c) for c in FIELDS]
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0,
                     leaf_digest([*named[:-1], lowered])).alias("tampered")
    proofs, root = merkle_manifest(docs, leaf_digest(named), carry=[changed])
    sides = F.transform("path", lambda s: F.concat(s["left"], s["right"]))
    folded = fold(F.coalesce(F.col("member.tampered"), F.col("leaf")), F.col("path"))
    return proofs.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", F.lit(root).cast("string").alias("root"),
        F.sha2(F.concat_ws("", sides).cast("binary"), 256).alias("proof_sha256"), folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


_FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = " || ".join(_FIELD.format(c) for c in FIELDS[:-1])
OP13_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || lang, '') AS g, sha256({_LEAF} || {_FIELD.format('text')}) AS leaf,
         sha256({_LEAF} || {_FIELD.format(f"translate(text, '{UPPER}', '{UPPER.lower()}')")}) AS lowered,
         list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c))),
           lambda a, b: list_reduce(list_concat([xor(CAST(a AS BIGINT), CAST(b AS BIGINT))], range(8)),
             lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))) AS crc
  FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, leaf) - 1 AS pos,
        row_number() OVER (ORDER BY g, doc_id, leaf) AS k, CASE WHEN xor(crc, 4294967295) % 3 = 0 THEN lowered ELSE leaf END AS shown FROM d),
low(g, lvl, pos, h) AS (
  SELECT g, 0, pos, leaf FROM n
  UNION ALL
  SELECT g, lvl + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM low) WHERE c > 1 GROUP BY g, lvl, pos // 8),
sub AS (SELECT g, row_number() OVER (ORDER BY g) - 1 AS place, h, lvl FROM (
          SELECT g, arg_max(h, lvl) AS h, max(lvl) AS lvl FROM low GROUP BY g)),
high(lvl, pos, h) AS (
  SELECT 0, place, h FROM sub
  UNION ALL
  SELECT lvl + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER () AS c FROM high) WHERE c > 1 GROUP BY lvl, pos // 8),
step AS (
  SELECT g, lvl, pos, coalesce(string_agg(h, '') OVER before, '') AS l, coalesce(string_agg(h, '') OVER after, '') AS r
  FROM (SELECT *, count(*) OVER (PARTITION BY g, lvl) AS c FROM
          (SELECT g, lvl, pos, h FROM low UNION ALL SELECT 'top', lvl, pos, h FROM high)) WHERE c > 1
  WINDOW before AS (PARTITION BY g, lvl, pos // 8 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         after AS (PARTITION BY g, lvl, pos // 8 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
up(k, g, lvl, pos, acc, proof, top) AS (
  SELECT k, g, 0, pos, shown, '', false FROM n
  UNION ALL
  SELECT u.k, CASE WHEN s.g IS NULL THEN 'top' ELSE u.g END, CASE WHEN s.g IS NULL THEN 0 ELSE u.lvl + 1 END,
         CASE WHEN s.g IS NULL THEN t.place ELSE u.pos // 8 END,
         CASE WHEN s.g IS NULL THEN u.acc ELSE sha256(s.l || u.acc || s.r) END,
         CASE WHEN s.g IS NULL THEN u.proof ELSE u.proof || s.l || s.r END, u.top OR s.g IS NULL
  FROM up u LEFT JOIN step s ON s.g = u.g AND s.lvl = u.lvl AND s.pos = u.pos LEFT JOIN sub t ON t.g = u.g
  WHERE s.g IS NOT NULL OR NOT u.top),
last AS (SELECT k, arg_max(acc, length(proof) * 2 + CAST(top AS INT)) AS acc,
                arg_max(proof, length(proof) * 2 + CAST(top AS INT)) AS proof FROM up GROUP BY k)
SELECT doc_id, leaf, sub.h AS subroot, root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = root AS verified
FROM n JOIN last USING (k) JOIN sub USING (g), (SELECT arg_max(h, lvl) AS root FROM high)
"""
