"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

The matching engine's queries are run to completion (a no-op write); ``decode``
figures beside them are microseconds a shot of the kernel by itself, on one
core, over a cubic lattice with a boundary, with little and with much remembered.
"""

from __future__ import annotations

import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = HERE + os.pathsep + os.environ.get("PYTHONPATH", "")

HEADLINE = ("q_decode_weight", "q_edges", "q_match_pairs", "q_negative", "q_correlated", "p_decode_in_parts", "q_by_component", "h_bitpack", "g_merge_smallest", "g_merge_independent", "g_merge_independent_ordered", "g_integer_weights", "x_distances", "c_implied", "r_noise", "e_error_rate")


def grid(d: int, rounds: int, p: float):
    """A d x d x rounds lattice with boundary edges on two sides: the shape of a memory experiment."""
    import math

    from pairweave import Matching

    m = Matching()
    w = math.log((1 - p) / p)
    at = lambda x, y, t: (t * d + y) * d + x
    for t in range(rounds):
        for y in range(d):
            for x in range(d):
                if x + 1 < d:
                    m.add_edge(at(x, y, t), at(x + 1, y, t), weight=w, error_probability=p)
                if y + 1 < d:
                    m.add_edge(at(x, y, t), at(x, y + 1, t), weight=w, error_probability=p)
                if t + 1 < rounds:
                    m.add_edge(at(x, y, t), at(x, y, t + 1), weight=w, error_probability=p)
            m.add_boundary_edge(at(0, y, t), fault_ids=0, weight=w, error_probability=p)
            m.add_boundary_edge(at(d - 1, y, t), weight=w, error_probability=p)
    return m


def kernel(d: int, p: float, shots: int) -> tuple[float, float]:
    """Microseconds a shot on one core: after one other shot, as the published figures, and after as many others."""
    import numpy as np

    m = grid(d, d, p)
    rng = np.random.default_rng(1)
    ends = [(u, v) for u, v, *_ in m._edges]
    drawn = []
    for _ in range(2 * shots):
        hit: set[int] = set()
        for i in np.flatnonzero(rng.random(len(ends)) < p):
            for x in ends[i]:
                if x is not None:
                    hit ^= {x}
        drawn.append(sorted(hit))
    took = []
    for before in (drawn[shots : shots + 1], drawn[shots:]):
        own = m.compiled()
        own._forget()
        for h in before:
            own.decode(h)
        began = time.perf_counter()
        for h in drawn[:shots]:
            own.decode(h)
        took.append((time.perf_counter() - began) / shots * 1e6)
    return took[0], took[1]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from pairweave.plans import catalog

    catalog.q_decode_weight(spark, sf_dir).limit(1).collect()  # starts the JVM and the Python workers
    took, shots = {}, 0
    for name in HEADLINE:
        began = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    from pairweave.plans import fixtures

    shots = fixtures.shots(spark, sf_dir).count()
    cold, warm = {}, {}
    for d, p, n in ((5, 0.001, 5000), (5, 0.005, 3000), (9, 0.001, 1500), (13, 0.001, 1500)):
        cold[f"d{d}_p{p}"], warm[f"d{d}_p{p}"] = (round(x, 1) for x in kernel(d, p, n))
    print(json.dumps({"metric": "matching_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rpartition("sf")[2], "shots": shots, "shots_per_s": round(shots / took["q_decode_weight"], 1), "kernel_us_per_shot_after_one": cold, "kernel_us_per_shot_after_as_many": warm, "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
