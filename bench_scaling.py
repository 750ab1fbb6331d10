"""Core scaling of the window path on a replicated packet table.

python bench_scaling.py [sf_dir] [times]  -> one JSON line per core count
(1, 2, 4, 8), each in its own Spark process (local[N] is fixed per JVM).
"""
from __future__ import annotations

import json
import os
import subprocess
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def run_one(sf_dir: str, times: int, cpus: int) -> dict:
    from netlens.functions.features import engineer
    from netlens.operators.windows import windows_from_packets
    from netlens.plans.oracle_sql import FIXTURE_CHUNK_BYTES
    from netlens.session import get_session
    from netlens.sources.derived import packets_from_events, replicate_packets, table
    spark = get_session(f"local[{cpus}]", app="netlens-scaling", shuffle_partitions=2 * cpus)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
    pk = replicate_packets(packets_from_events(table(spark, sf_dir, "events")), times)
    n = pk.count()
    out = {}
    for name, build in (("window_summary", lambda: windows_from_packets(pk, FIXTURE_CHUNK_BYTES)),
                        ("feature_algebra", lambda: engineer(
                            windows_from_packets(pk, FIXTURE_CHUNK_BYTES),
                            keep=["source", "chunk_id", "window_id"]))):
        build().write.format("noop").mode("overwrite").save()          # warm-up
        t0 = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        dt = time.perf_counter() - t0
        out[name] = {"sec": round(dt, 3), "rows_per_sec": round(n / dt, 1)}
    spark.stop()
    return {"cpus": cpus, "packets": n, "times": times, **out}


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    times = int(sys.argv[2]) if len(sys.argv) > 2 else 10
    if len(sys.argv) > 3:
        print(json.dumps(run_one(sf_dir, times, int(sys.argv[3]))))
        return
    for cpus in (1, 2, 4, 8):
        res = subprocess.run([sys.executable, __file__, sf_dir, str(times), str(cpus)],
                             capture_output=True, text=True)
        lines = [ln for ln in res.stdout.splitlines() if ln.startswith("{")]
        print(lines[-1] if lines else json.dumps({"cpus": cpus, "error": res.stderr[-300:]}),
              flush=True)


if __name__ == "__main__":
    main()
