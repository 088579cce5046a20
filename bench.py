"""Times the headline queries and prints one JSON line.

Reads $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS]. Every query is run to a
no-op sink, so the whole result is computed and nothing is collected. The value is the sum of the
queries' times; a short unrelated job warms the session up first. Each time goes to stderr as it comes.
A query is cancelled after $BENCH_LIMIT seconds (120) and listed as unfinished; if the run itself is
ended, the line holds what was measured until then.
"""

import json
import os
import signal
import sys
import tempfile
import threading
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from plumbline import session  # noqa: E402
from workload import queries as registered  # noqa: E402

HEADLINE = [
    "full_check_orders", "full_check_customers", "repair_and_recheck", "column_profile",
    "numeric_profile_lineitem", "text_profile_documents", "exact_duplicates",
    "exact_duplicates_documents", "duplicate_ids", "duplicate_order_lines", "near_duplicates",
    "survivorship_conflicts", "pattern_violation_customers", "date_order_orders",
    "mixed_date_formats_orders", "outlier_report_lineitem", "pii_columns_customers",
    "pii_pattern_counts_documents", "unreadable_chars_documents", "violation_rows",
    "declared_fields_supply_chain", "fix_impute_median", "fix_id_dedup_lines",
    "fix_standardize_orders", "fix_winsorize", "fix_golden_record", "fix_pii_tokenize",
    "learning_patterns", "global_summary", "report_recommendations",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS") or str(os.cpu_count() or 8)
    spark = session.build(f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="plumbline-bench-"),
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    times, unfinished = {}, []

    def report(*_):
        print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                          "unit": "sec", "queries": times, "unfinished": unfinished,
                          "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}), flush=True)

    def stopped(*_):
        report()
        os._exit(0)

    signal.signal(signal.SIGTERM, stopped)
    limit = float(os.environ.get("BENCH_LIMIT", "120"))
    for name in names:
        over = threading.Event()

        def cancel():
            over.set()
            spark.interruptAll()

        clock = threading.Timer(limit, cancel)
        clock.start()
        start = time.perf_counter()
        try:
            registered.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
        except Exception:
            if not over.is_set():
                raise
            unfinished.append(name)
        finally:
            clock.cancel()
        print(name, times.get(name, "not finished"), file=sys.stderr, flush=True)
    report()
    spark.stop()


if __name__ == "__main__":
    main()
