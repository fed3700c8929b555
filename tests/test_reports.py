from __future__ import annotations

import csv
import glob
import io
import json

import pytest
from pyspark.sql import functions as F

import cloakwork as cw
from cloakwork.functions.text import plain_number
from cloakwork.operators.normalise import csv_line, normalise, redact_findings
from cloakwork.sources.reports import csv_report, html_report, json_findings, json_summary

from . import samples as s

# Two findings whose report is agreed on.
FLAT = "filePath string, line int, category string, redactedValue string, riskScore double"
TWO = [
    ("src/config.env", 2, "openai-key", "[REDACTED_9f3a]", 0.92),
    ("src/db.ts", 14, "database-url", "[REDACTED_2b71]", 0.81),
]


@pytest.fixture
def two(spark):
    return spark.createDataFrame(TWO, FLAT)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], FLAT)


def lines(report):
    return [r.text for r in report.orderBy("section", "path", "line").collect()]


def test_summary(two, none):
    row = cw.summary(normalise(two)).first()
    assert (row.total_findings, row.score) == (2, 13.5)
    assert row.risk_distribution == {"openai-key": 1, "database-url": 1}
    empty = cw.summary(normalise(none)).first()
    assert (empty.total_findings, empty.score, empty.risk_distribution) == (0, 100.0, {})


def test_score_never_goes_below_zero(spark):
    wild = spark.createDataFrame([("a", 1, "x", "v", 3.0)], FLAT)
    assert cw.summary(normalise(wild)).first().score == 0.0


def test_nested_and_flat_findings_normalise_alike(spark, two):
    nested = spark.createDataFrame(
        [(v, c, (p, n, None), (None, 0.92 if n == 2 else 0.81, None)) for p, n, c, v, _ in TWO],
        "value string, category string, location struct<filePath:string,line:int,column:int>, "
        "detection struct<confidence:double,risk:double,features:array<string>>",
    )
    assert sorted(map(str, normalise(nested).collect())) == sorted(map(str, normalise(two).collect()))
    row = normalise(spark.createDataFrame([(None,)], "category string")).first()
    assert (row.value, row.category, row.path, row.line, row.confidence, row.risk, row.regex_match, row.features) == (
        "[REDACTED]", "unknown", "clipboard", None, 0.5, 0.0, True, [],
    )


def test_csv(two, none, spark):
    assert lines(csv_report(two)) == [
        "category,value,risk,confidence,location",
        "openai-key,[REDACTED_9f3a],0.92,0.5,src/config.env:2",
        "database-url,[REDACTED_2b71],0.81,0.5,src/db.ts:14",
    ]
    assert lines(csv_report(none)) == ["category,value,risk,confidence,location"]
    odd = spark.createDataFrame([('src/weird,path/"file".env', 2, "openai-key", "[REDACTED_9f3a]", 1.0), ("a\r\nb", 0, "k", None, 0.0)], FLAT)
    safe = redact_findings(normalise(odd))
    got = [r[0] for r in safe.select(csv_line(safe)).collect()]
    assert got[0] == 'openai-key,[REDACTED_9f3a],1,0.5,"src/weird,path/""file"".env:2"'
    assert next(csv.reader(io.StringIO(got[0])))[4] == 'src/weird,path/"file".env:2'
    assert got[1] == "k,[REDACTED],0,0.5,a b"


def test_html(two, none, spark):
    whole = "\n".join(lines(html_report(two)))
    assert "<html" in whole and "[REDACTED_9f3a]" in whole and "Findings: 2<" in whole and "score: 13.5<" in whole
    assert "Findings: 0<" in "\n".join(lines(html_report(none)))
    odd = spark.createDataFrame([("<a&b>", 1, '"x"', "v", 0.5)], FLAT)
    assert "<td>&lt;a&amp;b&gt;</td>" in "\n".join(lines(html_report(odd)))


def test_no_report_holds_a_raw_value(texts):
    found = cw.findings(texts(s.THREE, s.ONE_LINE, s.CONFIG_OBJECT)).persist()
    shown = [str(r) for r in json_findings(found).collect()] + lines(csv_report(found)) + lines(html_report(found))
    everything = "\n".join(shown)
    for row in found.collect():
        assert row.value not in everything
    assert "[REDACTED_openai]" in everything
    found.unpersist()


def test_json_shape(two):
    row = json_findings(two).where("category = 'openai-key'").first()
    assert (row.value, row.location.filePath, row.location.line, row.detection.risk, row.detection.regexMatch) == (
        "[REDACTED_9f3a]", "src/config.env", 2, 0.92, True,
    )
    text = json_summary(two).first().summary
    parsed = json.loads(text)
    assert parsed["totalFindings"] == 2 and parsed["score"] == 13.5 and parsed["generatedAt"].endswith("Z")
    assert "\n" in text


@pytest.mark.parametrize("fmt", ["csv", "html", "json"])
def test_written_reports(two, tmp_path, fmt):
    out = str(tmp_path / fmt)
    cw.write_report(two, fmt, out)
    if fmt == "json":
        found = [json.loads(x) for f in glob.glob(f"{out}/findings/part-*") for x in open(f)]
        assert sorted(f["category"] for f in found) == ["database-url", "openai-key"]
        whole = "".join(open(f).read() for f in sorted(glob.glob(f"{out}/summary/part-*")))
        assert json.loads(whole)["totalFindings"] == 2
        return
    whole = "".join(open(f).read() for f in sorted(glob.glob(f"{out}/part-*")))
    if fmt == "csv":
        assert whole.splitlines()[0] == "category,value,risk,confidence,location" and len(whole.splitlines()) == 3
    else:
        assert whole.startswith("<!DOCTYPE html>") and whole.strip().endswith("</html>")
    with pytest.raises(ValueError):
        cw.write_report(two, "pdf", out)


def test_write_redacted(texts, tmp_path, spark):
    out = str(tmp_path / "redacted")
    assert cw.write_redacted(texts(s.THREE, s.CLEAN, s.ONE_LINE), out) == 5
    back = {r.doc_id: r.text for r in spark.read.parquet(out).collect()}
    assert back[1] == s.CLEAN and "[REDACTED_openai]" in back[0]


def test_plain_numbers(spark):
    rows = spark.createDataFrame([(1.0,), (0.92,), (0.0,), (100.0,), (0.0001,), (1e-5,), (-2.5,), (12345678.0,)], "x double")
    got = [r[0] for r in rows.select(plain_number(F.col("x"))).collect()]
    assert got == ["1", "0.92", "0", "100", "0.0001", "0.00001", "-2.5", "12345678"]


def test_aggregates(texts):
    found = cw.findings(texts(s.THREE, s.ONE_LINE, s.CLEAN))
    counts = {r.category: r.n_findings for r in cw.by_category(found).collect()}
    assert counts == {"openai": 2, "password": 2, "generic": 1}
    assert {r.doc_id for r in cw.max_risk(found).collect()} == {0, 1}
    twice = {r.n_findings for r in cw.repeated_secrets(found).where("category = 'openai'").collect()}
    assert twice == {2}
