"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the folder of retail tables, ``BENCH_CPUS`` the local
cores, ``BENCH_RUNS`` the timed runs per query after one warm-up run; seconds are medians,
``spread`` the least and the most. Every result is consumed in full. ``setup`` holds what is written once and then read
by all queries: the staging table, the model, the lookup copies.
"""

from __future__ import annotations

import glob
import json
import os
import statistics
import tempfile
import time

import pyarrow.parquet as pq
from pyspark.sql import DataFrame

from ledgerline.plans.warehouse import Warehouse, open_retail
from ledgerline.queries import LOOKUP_CUSTOMER, QUERIES
from ledgerline.session import local_session

HEADLINE = (
    "dq_row_count_total_vs_populated",
    "dq_duplicate_item_id_summary",
    "dq_sku_category_real_conflicts",
    "sku_category_majority",
    "dq_order_consistency_summary",
    "payment_method_share",
    "service_accounts",
    "dq_missing_token_profile",
    "dq_mv_vs_rounded_gross",
    "dq_fully_test_customers",
    "dq_discount_hypotheses",
    "dq_row_findings",
    "build_customers",
    "build_products",
    "build_orders",
    "build_order_items",
    "pk_order_items",
    "fk_items_orders",
    "fk_items_products",
    "recon_uncategorized_impact",
    "recon_ledger",
    "v_monthly_kpi",
    "v_rfm_segments",
    "v_cohort_retention",
    "category_revenue",
    "star_fact_sales",
    "customer_order_lookup",
    "customer_order_lookup_indexed",
)


def consume(df: DataFrame) -> None:
    df.write.mode("overwrite").format("noop").save()


def timed(action) -> float:
    started = time.perf_counter()
    action()
    return time.perf_counter() - started


def row_groups_admitting(path: str, column: str, value: int) -> tuple[int, int]:
    """(row groups whose statistics admit the value, all row groups) below ``path``."""
    admitting = total = 0
    for name in glob.glob(f"{path}/**/*.parquet", recursive=True):
        meta = pq.ParquetFile(name).metadata
        index = meta.schema.to_arrow_schema().get_field_index(column)
        for group in range(meta.num_row_groups):
            stats = meta.row_group(group).column(index).statistics
            total += 1
            has_range = stats is not None and stats.has_min_max
            admitting += bool(has_range and stats.min <= value <= stats.max)
    return admitting, total


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    runs = int(os.environ.get("BENCH_RUNS", "7"))
    spark = local_session(tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    # From raw tables to the first result, with nothing written before.
    with Warehouse.from_retail(spark, folder) as fresh:
        cold = timed(lambda: consume(QUERIES["v_monthly_kpi"](fresh)))
    warehouse = open_retail(spark, folder)

    setup = {
        "land_staging": timed(warehouse.staging),
        "build_model": timed(warehouse.load_model),
        "lookup_copy": timed(lambda: warehouse.lookup_table("items_by_customer")),
    }
    floor = statistics.median(timed(spark.range(1).collect) for _ in range(9))
    seconds, spread = {}, {}
    for name in HEADLINE:
        # Each run builds its plan anew, so none reuses the shuffles of another. A lookup
        # is answered to the caller; the other results are consumed where they are.
        finish = DataFrame.collect if name.startswith("customer_order_lookup") else consume

        def run(query=QUERIES[name], finish=finish) -> None:
            finish(query(warehouse))

        run()
        spent = sorted(timed(run) for _ in range(runs))
        seconds[name] = statistics.median(spent)
        spread[name] = [round(spent[0], 3), round(spent[-1], 3)]

    plain = sorted(map(str, QUERIES["customer_order_lookup"](warehouse).collect()))
    fast = sorted(map(str, QUERIES["customer_order_lookup_indexed"](warehouse).collect()))
    # Row groups of the one partition that the catalog leaves, out of those of all.
    layout = warehouse.lookup_table("items_by_customer")
    part = layout.of(LOOKUP_CUSTOMER, layout.partition).first()[0]
    path = warehouse.catalog.path("items_by_customer")
    read, _ = row_groups_admitting(f"{path}/{layout.partition}={part}", "customer_id", LOOKUP_CUSTOMER)
    _, total = row_groups_admitting(path, "customer_id", LOOKUP_CUSTOMER)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": {name: round(spent, 3) for name, spent in seconds.items()},
                "runs": runs,
                "spread": spread,
                "cold_end_to_end": round(cold, 3),
                "setup": {name: round(spent, 3) for name, spent in setup.items()},
                "lookup": {
                    "customer": LOOKUP_CUSTOMER,
                    "rows": len(plain),
                    "equal": plain == fast,
                    "empty_job_sec": round(floor, 3),
                    "row_groups_read": read,
                    "row_groups": total,
                },
                "sf": os.path.basename(folder).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
