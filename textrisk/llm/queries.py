"""Driver queries of the subpackage: name -> builder, and DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textrisk.llm.common import table
from textrisk.llm.decontaminate import OP11_SQL, op11_benchmark_decontamination
from textrisk.llm.exact_dedup import dedup_classes
from textrisk.llm.fingerprints import op5_document_fingerprints
from textrisk.llm.html_text import op2_html_extraction
from textrisk.llm.jaccard_join import op10_ngram_jaccard_join
from textrisk.llm.langid import op7_language_id
from textrisk.llm.licenses import op8_license_scan
from textrisk.llm.merkle import OP13_SQL, op13_merkle_manifest
from textrisk.llm.mixing import op9_mix_sources
from textrisk.llm.packing import op6_best_fit_packing
from textrisk.llm.secrets import op3_secret_scan
from textrisk.llm.token_alignment import op12_token_alignment
from textrisk.llm.url_filter import op4_url_filter


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_classes(table(spark, sf_dir, "documents")).withColumn(
        "text_sha256", F.lower(F.hex("digest"))).drop("digest")


OP1_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                    'abcdefghijklmnopqrstuvwxyz') AS x FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY x) AS keep_id,
       count(*) OVER (PARTITION BY x) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY x) AS kept, sha256(x) AS text_sha256
FROM t
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_html_extraction": op2_html_extraction,
    "op3_secret_scan": op3_secret_scan,
    "op4_url_filter": op4_url_filter,
    "op5_document_fingerprints": op5_document_fingerprints,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_language_id": op7_language_id,
    "op8_license_scan": op8_license_scan,
    "op9_mix_sources": op9_mix_sources,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_benchmark_decontamination": op11_benchmark_decontamination,
    "op12_token_alignment": op12_token_alignment,
    "op13_merkle_manifest": op13_merkle_manifest,
}

OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END AS sh
      FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
e AS (SELECT doc_id, unnest(sh) AS t FROM s),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM e x JOIN e y ON x.t = y.t AND x.doc_id <> y.doc_id
      GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b
      WHERE 100 * m >= 75 * (p.n + q.n - m)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, coalesce(min(r.b), n.doc_id)) AS component_id
FROM n LEFT JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n
"""

ORACLES: dict[str, str] = {"op1_exact_dedup": OP1_SQL, "op10_ngram_jaccard_join": OP10_SQL,
                           "op11_benchmark_decontamination": OP11_SQL, "op13_merkle_manifest": OP13_SQL}
