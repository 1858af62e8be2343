"""Wall time of the registered queries, as one JSON line.

Each query is executed in full (its rows are produced and dropped) in one session. A
first pass over the smallest tables compiles the plans, so the second one measures the
queries and not the JVM starting up.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from mnemoloom.plans.catalogue import CATALOGUE  # noqa: E402
from mnemoloom.session import get_spark  # noqa: E402

# One or two per family: what a user of the engine waits for.
HEADLINE = """
    usage_by_tool usage_daily facts_search_like task_resume transcript_suffix_budget facts_flatten_dedup
    facts_merge_antijoin facts_redacted vectors_first_wins tokens_frequency lexical_topk bm25_topk retrieval_metrics
    cosine_topk rrf_fusion recall_hybrid degree_topk khop_neighbourhood reverse_impact shortest_path_len symbol_spans
    symbols_in_ranges diff_impact tree_rollup edge_verdicts churn_by_file cochange_pairs fan_in risk_rank stream_pairs
    stream_dependencies contract_scan contract_match service_map failure_context path_claims story_summary
    usage_window_stream usage_sessions session_pairing
""".split()


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    if names == ["all"]:
        names = list(CATALOGUE)
    spark = get_spark(
        "bench", f"local[{cpus}]", **{
            "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false",
        }
    )
    small = os.path.join(os.path.dirname(path), "sf0.001")
    for name in names if os.path.isdir(small) else []:
        CATALOGUE[name].run(spark, small).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        CATALOGUE[name].run(spark, path).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
        print(name, seconds[name], file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    sf = os.path.basename(path).removeprefix("sf")
    print(json.dumps({"metric": "total_wall_time", "value": total, "unit": "sec", "queries": seconds, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
