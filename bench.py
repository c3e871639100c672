"""Headline queries, timed: prints one JSON line.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the cores.  Every query is run to its
end into a sink that keeps nothing; the first, untimed run warms the JVM.  ``planning``
holds the part of a time that goes before the first row: building and planning the query,
with whatever it computes eagerly (checkpoints, streams).  With
``BENCH_SMALL`` set, ``small`` holds the times over a tenth of the data, so growth can be read off.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pressmill.plans import registry  # noqa: E402
from pressmill.session import local_session  # noqa: E402

HEADLINES = [
    "q1_list_page", "q3_search", "q11_accounts", "t2_top_keywords", "t4_daily_keywords", "t6_author_report",
    "t10_period_counts", "t16_keyword_growth", "g9_tag_statistics", "g11_tag_trends", "c7_overall",
    "c12_quality_summary", "e1_clean_content", "e7_split_collections", "e13_dedup_url", "e26_insert_absent",
    "h2_text", "l1_content_links", "x8_list_entries", "x10_vault_tags", "d1_related_author", "j2_endpoint_state",
    "x3_documents", "x13_vault_notes", "t15_trend_summary", "d2_related_tag", "e6_digest_export", "e14_renumber",
    "str1_stream_ingest",
]


def timed(spark, sf_dir):
    times, planning = {}, {}
    for name in HEADLINES:
        start = time.time()
        df = registry.QUERIES[name](spark, sf_dir)
        df._jdf.queryExecution().executedPlan()
        planning[name] = round(time.time() - start, 3)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    return times, planning


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, partitions=max(int(cpus), 1) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    registry.QUERIES["t2_top_keywords"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times, planning = timed(spark, sf_dir)
    sf = os.path.basename(sf_dir).replace("sf", "")
    out = {"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "planning": planning, "sf": sf}
    small = os.path.join(os.path.dirname(sf_dir), "sf0.01")
    if os.environ.get("BENCH_SMALL") and os.path.isdir(small):
        out["small"] = timed(spark, small)[0]
    print(json.dumps(out))


if __name__ == "__main__":
    main()
