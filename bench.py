"""Headline queries timed on one table folder; prints one JSON line.

BENCH_SF_DIR is the folder, BENCH_CPUS the number of local cores. Each query is
run once to warm up code and file caches, then timed; the timed run writes to a
no-op sink, so every row and column is computed.
"""

from __future__ import annotations

import importlib.util
import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINES = [
    "flagship_region_timeline",
    "a03_duplicate_groups",
    "j08_drop_all_copies",
    "p05_p09_indicator_recodes",
    "a31_count_metrics",
    "a34_multilabel_report",
    "a41_f20_location_levels_fuzzy",
    "a47_distance_summary",
    "f04_f07_counts_from_answers",
    "f12_f14_parsed_answers",
    "j01_j02_best_gazetteer_match",
    "j12_n01_names_in_texts",
    "w04_temporal_split",
    "w05_stratified_split",
    "w14_tags_to_spans",
    "w15_roc_auc",
    "w16_average_precision",
    "b07_thresholds_per_label",
    "b03_b05_paired_significance",
    "b03_paired_significance_poisson",
    "s06_w01_page_incidents",
    "t01_stream_page_ingest",
    "op3_decontaminate",
    "op8_license_scan",
    "op9_ngram_join",
    "op10_quality_rules",
]


def main() -> None:
    from incidentry.session import build_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "incidentry-bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
           "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g")},
    )
    spark.sparkContext.setLogLevel("ERROR")
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    found = entry.queries()
    names = [n for n in (sys.argv[1:] or HEADLINES) if n in found]

    times, cold = {}, {}
    for name in names:
        for store in (cold, times):
            start = time.perf_counter()
            found[name](spark, folder).write.format("noop").mode("overwrite").save()
            store[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "cold": cold, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
