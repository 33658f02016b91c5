"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores.  Every query
runs once to warm up and is then timed to its last row.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from plumbline.operators import anomaly as a  # noqa: E402
from plumbline.operators import clean as c  # noqa: E402
from plumbline.operators import detail as d  # noqa: E402
from plumbline.operators import features as f  # noqa: E402
from plumbline.operators import quality as q  # noqa: E402
from plumbline.session import local_session  # noqa: E402


def headline(spark, sf: str) -> dict:
    from checks import clean as cc
    from checks import quality as cq
    from checks import series as cs
    from checks import stream as ct
    from checks.tables import load

    def pipeline(mode: str):
        options = dict(cc.PIPELINE)
        options["remove_outliers"] = {"method": "iqr", "columns": ["o_orderkey", "o_custkey", "o_totalprice"], "mode": mode}
        return c.clean_pipeline(load(spark, sf, "dirty_orders"), options).df

    return {
        "completeness_lineitem": lambda: q.completeness(load(spark, sf, "lineitem"), "lineitem"),
        "table_metrics_lineitem_exact": lambda: q.table_metrics(load(spark, sf, "lineitem"), "lineitem"),
        "table_metrics_lineitem_approx": lambda: q.table_metrics(load(spark, sf, "lineitem"), "lineitem", approx=True),
        "dataset_metrics": lambda: q.dataset_metrics(spark, cq.sources(spark, sf, missing=False)),
        "detail_metrics_documents": lambda: d.detail_metrics(load(spark, sf, "documents"), "documents"),
        "clean_pipeline_sequential": lambda: pipeline("sequential"),
        "clean_pipeline_joint": lambda: pipeline("joint"),
        "fill_interpolate_keyed": lambda: cc.fill("interpolate", ["user_id"])(spark, sf),
        "fill_interpolate_keyless": lambda: cc.fill("interpolate")(spark, sf),
        "drop_duplicates_last": lambda: c.drop_duplicates(load(spark, sf, "dirty_orders"), ["o_custkey", "o_orderstatus"], "last", ["o_orderkey"]),
        "rolling_stats": lambda: f.rolling_stats(load(spark, sf, "events"), ["ts", "event_id"], "value", 20, ["user_id"]),
        "detect_anomalies_k1": lambda: a.detect_anomalies(cs.orders(spark, sf), ["d"], columns=["total_price"]),
        "detect_anomalies_k3": lambda: cs.detect(spark, sf),
        "detect_anomalies_events": lambda: cs.detect_events(spark, sf),
        "pca_embeddings": lambda: cs.pca_embeddings(spark, sf),
        "stream_quality_tumbling": lambda: ct.tumbling(spark, sf),
    }


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    times = {}
    for name, build in headline(spark, sf).items():
        build().write.format("noop").mode("overwrite").save()
        start = time.time()
        build().write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
