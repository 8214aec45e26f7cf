"""Per-query input and shuffle volumes from a Spark event log (no UI needed).

Run the bench with an event log, then summarise it:
    BENCH_EVENT_LOG_DIR=$(mktemp -d /tmp/run-XXXXXX) BENCH_REPS=1 python bench.py
    python tools/shuffle_report.py <that dir>
Jobs are attributed to queries through the job description bench.py sets.
"""

from __future__ import annotations

import json
import os
import sys
from collections import defaultdict


def _lines(path: str):
    """Event-log lines; rolling logs are zstd-compressed in several frames."""
    if path.endswith(".zstd"):
        import io

        import zstandard
        with open(path, "rb") as raw:
            reader = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True)
            yield from io.TextIOWrapper(reader, encoding="utf-8")
    else:
        with open(path, encoding="utf-8") as f:
            yield from f


def main() -> None:
    d = sys.argv[1]
    logs = sorted(os.path.join(r, f) for r, _, fs in os.walk(d) for f in fs
                  if f.startswith("events_") or f.startswith("local-") or f.startswith("app-"))
    stage_desc: dict[int, str] = {}
    totals: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
    for path in logs:
        for line in _lines(path):
                ev = json.loads(line)
                kind = ev.get("Event")
                if kind == "SparkListenerJobStart":
                    desc = (ev.get("Properties") or {}).get("spark.job.description", "?")
                    for sid in ev.get("Stage IDs", []):
                        stage_desc[sid] = desc
                elif kind == "SparkListenerTaskEnd":
                    m = ev.get("Task Metrics") or {}
                    t = totals[stage_desc.get(ev.get("Stage ID"), "?")]
                    t["input_bytes"] += (m.get("Input Metrics") or {}).get("Bytes Read", 0)
                    t["input_records"] += (m.get("Input Metrics") or {}).get("Records Read", 0)
                    t["shuffle_records"] += (m.get("Shuffle Write Metrics") or {}).get("Shuffle Records Written", 0)
                    t["shuffle_write_bytes"] += (m.get("Shuffle Write Metrics") or {}).get("Shuffle Bytes Written", 0)
                    t["shuffle_read_bytes"] += sum((m.get("Shuffle Read Metrics") or {}).get(k, 0)
                                                   for k in ("Remote Bytes Read", "Local Bytes Read"))
                    t["tasks"] += 1
    print("| query | input rows | shuffle rows written | shuffle MB written | tasks |")
    print("|---|---|---|---|---|")
    for q, t in sorted(totals.items()):
        if q in ("?", None):
            continue
        print(f"| {q} | {int(t['input_records'])} | {int(t['shuffle_records'])} | "
              f"{t['shuffle_write_bytes'] / 1e6:.2f} | {int(t['tasks'])} |")


if __name__ == "__main__":
    main()
