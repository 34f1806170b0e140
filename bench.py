"""Headline queries, timed; prints one JSON line.

Every query runs to the end into a no-op sink, so that nothing but the plan is
measured. The first, untimed round loads classes and compiles generated code.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = (
    "flagship",
    "tokenize_lineitem",
    "apply_masking_wide",
    "apply_masking_customer",
    "residual_scan",
    "normalize_documents",
    "masked_fields_documents",
    "token_join",
    "governed_group",
    "governed_regroup",
    "resolve_clients",
    "query_verdict",
    "build_audit",
    "load_rules",
    "verify_policy",
    "token_consistency",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        # Call-site capture for every column expression costs more than planning.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from veilspark import plans
    from veilspark.plans.settings import POLICY, keys
    from veilspark.functions.masking import tokenize
    from pyspark.sql import functions as F

    def lines(engine):
        """A token on every order line, the widest use of the token function."""

        def build(s, sf):
            t = {n: s.read.parquet(f"{sf}/{n}.parquet") for n in ("lineitem", "orders", "customer")}
            joined = t["lineitem"].join(t["orders"], F.expr("l_orderkey = o_orderkey")).join(
                t["customer"], F.expr("o_custkey = c_custkey")
            )
            name = F.col("c_name") if engine is None else F.concat(F.lit("É "), F.col("c_name"))
            token = tokenize(name, "customer", "CUST", keys(s), POLICY.placeholders, engine or "jvm")
            return joined.select("l_orderkey", token.alias("token"))

        return build

    queries = {name: plans.queries()[name] for name in HEADLINE}
    queries["token_per_line"] = lines(None)
    queries["token_per_line_nfkc"] = lines("jvm")
    queries["token_per_line_nfkc_python"] = lines("python")

    def run(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    times = {}
    for name in queries:
        run(name)
        times[name] = round(min(run(name) for _ in range(2)), 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
