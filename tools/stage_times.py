"""Summarise a Spark event log: per-job wall time, stages, tasks, shuffle bytes.

Usage:
    BENCH_EVENT_LOG=$(mktemp -d /tmp/run-XXXXXX) python bench.py
    python tools/stage_times.py <that folder> [--top 20]

Reads the (zstd-compressed or plain) event log Spark wrote; never starts a
server or reads the UI. Jobs are listed slowest first with their call site.
"""

from __future__ import annotations

import argparse
import glob
import io
import json
import os


def _lines(path: str):
    with open(path, "rb") as fh:
        head = fh.read(4)
        fh.seek(0)
        if head == b"\x28\xb5\x2f\xfd":  # zstd frame magic
            import zstandard

            reader = zstandard.ZstdDecompressor().stream_reader(fh, read_across_frames=True)
            yield from io.TextIOWrapper(reader, encoding="utf-8")
        else:
            yield from io.TextIOWrapper(fh, encoding="utf-8")


def summarise(folder: str) -> list[dict]:
    files = [f for f in glob.glob(os.path.join(folder, "**", "*"), recursive=True) if os.path.isfile(f)]
    files = [f for f in files if "appstatus" not in os.path.basename(f)]
    jobs: dict[int, dict] = {}
    stage_job: dict[int, int] = {}
    for f in sorted(files):
        for line in _lines(f):
            try:
                e = json.loads(line)
            except ValueError:
                continue
            ev = e.get("Event")
            if ev == "SparkListenerJobStart":
                jid = e["Job ID"]
                props = e.get("Properties") or {}
                jobs[jid] = {
                    "job": jid,
                    "start": e["Submission Time"],
                    "end": None,
                    "site": (props.get("callSite.short") or "")[:80],
                    "stages": len(e["Stage Infos"]),
                    "tasks": 0,
                    "shuffle_write": 0,
                    "shuffle_read": 0,
                }
                for s in e["Stage Infos"]:
                    stage_job[s["Stage ID"]] = jid
            elif ev == "SparkListenerJobEnd" and e["Job ID"] in jobs:
                jobs[e["Job ID"]]["end"] = e["Completion Time"]
            elif ev == "SparkListenerTaskEnd":
                job = jobs.get(stage_job.get(e.get("Stage ID"), -1))
                if job is None:
                    continue
                job["tasks"] += 1
                m = e.get("Task Metrics") or {}
                job["shuffle_write"] += (m.get("Shuffle Write Metrics") or {}).get("Shuffle Bytes Written", 0)
                rm = m.get("Shuffle Read Metrics") or {}
                job["shuffle_read"] += rm.get("Remote Bytes Read", 0) + rm.get("Local Bytes Read", 0)
    for j in jobs.values():
        j["seconds"] = round(((j["end"] or j["start"]) - j["start"]) / 1000, 3)
    return sorted(jobs.values(), key=lambda j: -j["seconds"])


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("folder")
    ap.add_argument("--top", type=int, default=20)
    args = ap.parse_args()
    rows = summarise(args.folder)
    print(f"{'job':>5} {'sec':>8} {'stages':>6} {'tasks':>6} {'shuf_w_MB':>10} {'shuf_r_MB':>10}  call site")
    for j in rows[: args.top]:
        print(
            f"{j['job']:>5} {j['seconds']:>8.3f} {j['stages']:>6} {j['tasks']:>6} "
            f"{j['shuffle_write'] / 1e6:>10.2f} {j['shuffle_read'] / 1e6:>10.2f}  {j['site']}"
        )
    print(f"{len(rows)} jobs, {sum(j['seconds'] for j in rows):.1f} s summed")


if __name__ == "__main__":
    main()
