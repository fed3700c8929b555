"""Short reports and states of reports that add up."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import cloakwork as cw
from cloakwork.operators.normalise import normalise
from cloakwork.plans.queries import reports
from cloakwork.sources.reports import html_report

ROW = "root string, path string, line int, category string, value string, risk double, confidence double, fingerprint string"


@pytest.fixture(scope="module")
def some(spark):
    draw = random.Random(2)
    rows = [
        (draw.choice(["a", "a", "a", "b", None]), draw.choice(["p", "q", None]), draw.choice([None, 1, 2]), draw.choice(["x", "y"]),
         f"[REDACTED_{draw.randint(0, 5)}]", draw.choice([0.1, 0.5, 0.9]), 0.5, f"f{draw.randint(0, 60)}")
        for _ in range(400)
    ]
    return spark.createDataFrame(rows, ROW).repartition(7).persist()


def brute(rows, n, key):
    groups: dict = {}
    for r in rows:
        groups.setdefault(key(r), []).append(r)
    low = lambda v: (v is not None, v if v is not None else 0)
    order = lambda r: (-r.risk, low(r.path), low(r.line), r.category, r.value, r.confidence)
    return sorted((repr(k), i + 1, order(r), len(g)) for k, g in groups.items() for i, r in enumerate(sorted(g, key=order)[:n]))


@pytest.mark.parametrize("by", [[], ["root"], ["root", "category"]])
def test_riskiest(some, by):
    rows = some.withColumn("column", F.lit(0))
    got = cw.riskiest(rows, 7, by).collect()
    low = lambda v: (v is not None, v if v is not None else 0)
    key = lambda r: tuple(r[c] for c in by)
    shown = sorted((repr(key(r)), r["rank"], (-r.risk, low(r.path), low(r.line), r.category, r.value, r.confidence), r.n_findings) for r in got)
    assert shown == brute(some.collect(), 7, key)


def test_no_total_sort(some):
    plan = cw.riskiest(some.withColumn("column", F.lit(0)), 7, ["root"])._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and plan.count("WindowGroupLimit") == 2


def test_short_html(some):
    lines = [r.text for r in html_report(some, top=5).collect()]
    assert sum(t.startswith("<tr>") for t in lines) == 5 and any("395 more in the full report" in t for t in lines)
    assert sum(r.text.startswith("<tr>") for r in html_report(some).collect()) == 400
    assert not any("more in the full" in r.text for r in html_report(some, top=400).collect())
    tables = cw.html_tables(some, ["root"], 3).collect()
    assert {r.root for r in tables} == {"a", "b", None} and all(r.html.count("<tr>") == 3 for r in tables)
    assert sum(r.n_findings for r in tables) == 400
    assert html_report(some.limit(0), top=5).count() == 2


def test_states_add_up(spark, some):
    parts = some.withColumn("run", F.pmod(F.xxhash64("path", "line", "value", "fingerprint"), F.lit(4)))
    states = cw.report_state(parts, by=["run"]).drop("run")
    one, other = cw.state_summary(cw.report_state(some)).first(), cw.state_summary(states).first()
    twice = cw.state_summary(cw.merge_states(states).unionByName(cw.report_state(some.limit(0)))).first()
    assert one == other == twice
    whole = cw.summary(normalise(some)).first()
    assert (one.total_findings, one.score, one.risk_distribution) == (whole.total_findings, whole.score, whole.risk_distribution)
    exact = some.agg(F.count_distinct("fingerprint")).first()[0]
    assert abs(one.distinct_secrets - exact) <= 0.03 * exact + 1
    doubled = cw.state_summary(states.unionByName(states)).first()
    assert doubled.total_findings == 800 and doubled.distinct_secrets == one.distinct_secrets
    empty = cw.state_summary(cw.report_state(some.limit(0))).first()
    assert (empty.total_findings, empty.score, empty.distinct_secrets) == (0, 100.0, 0)
    by_root = {r.root: r.total_findings for r in cw.state_summary(cw.report_state(some, by=["root"]), by=["root"]).collect()}
    assert sum(by_root.values()) == 400


def test_merged_state_looks_for_findings_once(spark, small, monkeypatch):
    seen = []
    state = reports.report.report_state
    monkeypatch.setattr(reports.report, "report_state", lambda df, **by: seen.append(df.inputFiles()) or state(df, **by))
    row = reports.merged_report_state(spark, small).first()
    assert seen[0] and all("/findings-" in f for f in seen[0])
    assert row.secrets_close and row.total_findings >= spark.read.parquet(f"{small}/documents.parquet").count()
