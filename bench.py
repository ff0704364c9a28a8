"""Headline timings: screening, evaluation, c-TF-IDF and coherence.

Runs each query over the whole driver tables in $BENCH_SF_DIR (default
/root/testdata/sf0.1) on local[$BENCH_CPUS] and prints one JSON line. Every
query is executed to the end with the `noop` sink (full plan, no transfer of
rows to Python).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from textrisk.plans.registry import load_all  # noqa: E402
from textrisk.session import clear_scratch, get_session  # noqa: E402
from textrisk.sources.readers import TEXT_PARTITIONS  # noqa: E402

HEADLINE = [
    "screen_candidates", "screen_funnel", "screen_by_lang", "keyword_by_lang",
    "model_metrics", "mcnemar_pairs", "agreement_pairs", "wilson_by_source",
    "ngram_dictionary", "class_tfidf", "top_terms", "coherence_npmi", "coherence_cv", "topic_model_sweep",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = get_session(f"local[{cpus}]", int(cpus) * 2, app_name="textrisk-bench")
    # The driver's tables are one split each: deal their texts over the cores.
    spark.conf.set(TEXT_PARTITIONS, cpus)
    reg = load_all()
    # JVM and regex warm-up on the smallest tables, not timed.
    smoke = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(smoke):
        reg["screen_by_lang"].build(spark, smoke).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.perf_counter()
        reg[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    clear_scratch(spark)
    spark.stop()


if __name__ == "__main__":
    main()
