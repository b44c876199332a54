"""Reports with their log lines, against a plain scan of the month's lines."""

import datetime as dt
import json
import os
import random

import pytest

from hostlens.operators import reports as RP
from hostlens.sources import files as SF

LINES = "month string, ts timestamp, line_key long, line string"
REPORTS = "id long, created_at timestamp, question string"


def brute(reports, lines, n):
    out = {}
    for i, at, _ in reports:
        mine = sorted((t, k, line) for m, t, k, line in lines if at is not None and t is not None and m == f"{at:%Y-%m}" and t <= at)
        out[i] = [line for _, _, line in mine[-n:]]
    return out


def log(seed, n, months):
    """Lines of several months; the second holds more than a third of them, half of those within one minute."""
    r, lines = random.Random(seed), []
    for k in range(n):
        m = 2 if k % 2 else r.choice(months)
        day = dt.datetime(2026, m, 14, 12, 30, r.randrange(60)) if m == 2 and k % 4 == 1 else dt.datetime(2026, m, r.randrange(1, 28), r.randrange(24), r.randrange(60))
        lines.append((f"{day:%Y-%m}", day, k, f"line {k}"))
    return lines


@pytest.mark.parametrize("n,seconds", [(1, 3600), (7, 60), (200, 86_400)])
def test_against_a_plain_scan(spark, n, seconds):
    r = random.Random(n)
    lines = [*log(n, 600, [1, 2, 3, 5]), (None, dt.datetime(2026, 1, 3), 9000, "no month"), ("2026-01", None, 9001, "no time")]
    times = [x[1] for x in r.sample(lines[:600], 40)] + [dt.datetime(2026, 4, 2), dt.datetime(2026, 2, 1), dt.datetime(2026, 5, 31), None]
    reports = [(i, t, f"q{i}") for i, t in enumerate(times)]
    out = RP.with_recent_logs(spark.createDataFrame(reports, REPORTS).repartition(3), spark.createDataFrame(lines, LINES).repartition(5), n=n, bucket_seconds=seconds).collect()
    assert {x["id"]: x["recent_logs"] for x in out} == brute(reports, lines, n)
    assert {x["id"]: x["question"] for x in out} == {i: f"q{i}" for i in range(len(times))} and len(out) == len(times)


def test_empty(spark):
    none, one = spark.createDataFrame([], LINES), spark.createDataFrame([(1, dt.datetime(2026, 1, 2), "q")], REPORTS)
    assert RP.with_recent_logs(one, none).first()["recent_logs"] == []
    assert RP.with_recent_logs(spark.createDataFrame([], REPORTS), spark.createDataFrame(log(1, 20, [1, 2]), LINES)).count() == 0
    with pytest.raises(ValueError):
        RP.with_recent_logs(one, none, n=0)


def test_no_window_over_a_month(spark):
    """Nothing is dealt out by month alone, and no more than two lookups are made per report."""
    lines, reports = spark.createDataFrame(log(3, 300, [1, 2, 3]), LINES), spark.createDataFrame([(1, dt.datetime(2026, 2, 14, 13), "q")], REPORTS)
    plan = RP.with_recent_logs(reports, lines)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_log_file_to_exported_report(spark, scratch_dir):
    text = [f"2026-01-0{1 + i // 10} 10:00:{i:02d} | INFO | step {i}" for i in range(30)]
    for month in ("2026-01", "2026-02"):
        with open(os.path.join(scratch_dir, f"agent_{month}.log"), "w") as f:
            f.write("\n".join([*text[:5], "a line that does not parse", *text[5:]]).replace("2026-01", month) + "\n")
    lines = SF.log_lines(SF.read_logs(spark, scratch_dir + "/*.log"))
    reports = spark.createDataFrame([(5, dt.datetime(2026, 1, 2, 10, 0, 13), "why", "because", "u@x.org", '["SELECT 1"]', None)],
                                    "id long, created_at timestamp, question string, answer string, user_email string, executed_codes string, recent_logs string")
    out = scratch_dir + "/out"
    SF.export_reports(RP.with_recent_logs(reports, lines, n=4), out)
    (folder,) = [d for d in os.listdir(out) if d.startswith("month=")]
    (part,) = [p for p in os.listdir(f"{out}/{folder}") if p.endswith(".json")]
    got = json.loads(open(f"{out}/{folder}/{part}").read())
    assert folder == "month=2026-01" and got["recent_logs"] == text[10:14] and got["executed_codes"] == ["SELECT 1"]
    with pytest.raises(Exception, match="exist"):
        SF.export_reports(reports, out)
