"""Behaviour that matters on large or lopsided data."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

import cloakwork as cw
from cloakwork.functions.bind import let, walk
from cloakwork.plans.queries.common import KEYS_PER_TASK, order_keys
from cloakwork.session import _CLEANUP, CHECKPOINT_DIR, _own_folder, discard, scratch_dir, stored

from . import samples as s

KEY = bytes(range(32))


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_walk_adds_up_over_blocks(spark):
    for n in (0, 1, 63, 64, 65, 1000):
        items = F.slice(F.sequence(F.lit(1), F.lit(1000)), 1, n)
        state = walk(items, F.lit(0), "array<int>", lambda c, x: (c + x, F.array(c + x)))
        row = spark.range(1).select(let(state, lambda x: x).alias("w")).first().w
        assert row.carry == n * (n + 1) // 2 and row.out == [i * (i + 1) // 2 for i in range(1, n + 1)]


@pytest.mark.parametrize("separator", ["\n", "; "])
def test_many_findings_in_one_text(spark, separator):
    one = F.concat(F.lit("k=AKIA"), F.upper(F.substring(F.md5(F.col("i").cast("string")), 1, 16)))
    rows = spark.range(3000).select(F.col("id").alias("i")).select(F.array_join(F.array_sort(F.collect_list(one)), separator).alias("text"))
    docs = rows.select(F.lit(1).alias("doc_id"), "text")
    row = cw.protect(docs, mode="number", key=KEY).first()
    assert row.n_findings == 3000 and row.secret_lines == (3000 if separator == "\n" else 1)
    assert row.masked_text == separator.join(f"k=[REDACTED_{i}]" for i in range(1, 3001))
    found = cw.findings(docs).orderBy("ordinal").collect()
    if separator == "\n":
        assert [(f.line, f.column) for f in found] == [(i, 3) for i in range(1, 3001)]
    else:
        assert [(f.line, f.column) for f in found] == [(1, 3 + i * 24) for i in range(3000)]


def test_detection_runs_once_per_query(texts):
    docs = texts(s.THREE)
    marker = r"client-key-data:\s*"
    once = plan_of(cw.findings(docs)).count(marker)
    assert once > 0
    assert plan_of(cw.summary(cw.findings(docs))).count(marker) == once
    assert plan_of(cw.mask(docs)).count(marker) == once
    assert plan_of(cw.protect(docs, mode="number", key=KEY)).count(marker) == once
    assert plan_of(cw.detect(docs).where("doc_id > 0")).count(marker) == once
    # A filter on the result may cost one more run for the rows it keeps, never more.
    assert plan_of(cw.mask(docs).where("n_findings > 0")).count(marker) == 2 * once


def test_only_needed_columns_are_read(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    plan = cw.by_category(cw.findings(docs))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<text:string>" in plan
    filtered = cw.mask(docs.where("source = 'src1'"))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(source,src1)" in filtered


def test_no_shuffle_in_narrow_operators(texts):
    docs = texts(s.THREE)
    masked = cw.mask(docs, mode="inline", key=KEY)
    for df in (cw.findings(docs), cw.detect(docs), masked, cw.unmask_inline(masked, KEY), cw.redact(docs)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_spread(spark):
    cores = spark.sparkContext.defaultParallelism
    assert cw.spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() == cores
    wide = spark.range(0, 1000, 1, cores + 3)
    assert cw.spread(wide) is wide


def test_spread_counts_rows_not_splits(spark, tmp_path):
    """One row group cut into many splits lies in one of them."""
    cores = spark.sparkContext.defaultParallelism
    spark.range(20_000).selectExpr("id", "md5(string(id)) as text").coalesce(1).write.parquet(f"{tmp_path}/t")
    size = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "10000")
    try:
        rows = spark.read.parquet(f"{tmp_path}/t")
        assert rows.rdd.getNumPartitions() > cores
        dealt = cw.spread(rows.select("text"))
        assert min(dealt.rdd.glom().map(len).collect()) > 0 and dealt.count() == 20_000
    finally:
        spark.conf.set(size, before)


def test_spread_bounds_the_rows_of_a_task(spark):
    cores = spark.sparkContext.defaultParallelism
    uneven = spark.range(0, 100, 1, cores).union(spark.range(0, 100 * cores, 1, 1))
    assert cw.spread(uneven, 50).rdd.getNumPartitions() == -(-(100 + 100 * cores) // 50)
    assert cw.spread(spark.range(0), 50).count() == 0


def test_texts_made_from_keys_go_in_small_shares(spark, tmp_path):
    """As many row groups as cores, each within what a task may read of texts, were scanned as they lay."""
    cores = spark.sparkContext.defaultParallelism
    rows = 30_000 * cores
    spark.range(0, rows, 1, cores).selectExpr("id AS o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    keys = order_keys(spark, str(tmp_path))
    sizes = keys.rdd.glom().map(len).collect()
    assert sum(sizes) == rows and max(sizes) <= KEYS_PER_TASK * 1.01
    assert sorted(r.o_orderkey for r in keys.collect()) == list(range(rows))


def test_one_token_in_very_many_texts(spark):
    """A reference token pasted all over; the join keeps the shape that adaptive skew handling needs."""
    one = spark.createDataFrame([(0, s.OPENAI)], "doc_id long, text string")
    done = cw.protect(one, mode="vault", key=KEY, corpus="x")
    token = done.first().masked_text
    pasted = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(f"{token} and {token}").alias("masked_text"))
    restored = cw.unmask_vault(pasted, cw.vault_of(done), KEY)
    assert restored.where(F.col("restored_text") != f"{s.OPENAI} and {s.OPENAI}").count() == 0
    assert restored.count() == 5000


def test_block_escapes(texts):
    odd = f"﷐ ﷐0 ﷐1\n{s.BLOCK}\n﷐\n"
    done = cw.protect(texts(odd), mode="inline", key=KEY)
    assert done.first().masked_text.startswith("﷐ ﷐0 ﷐1\nHIDDEN")
    assert cw.unmask_inline(done, KEY).first().restored_text == odd


def test_scratch_space(spark):
    base = spark.conf.get(CHECKPOINT_DIR, None) or _own_folder("local")
    first, second = scratch_dir(spark, "a"), scratch_dir(spark, "a")
    assert first != second and first.startswith(base.rstrip("/") + "/a-")
    _own_folder.cache_clear()
    with pytest.raises(ValueError):
        _own_folder("yarn")


def test_discarded_tables(spark):
    first, second = stored(spark.range(5), "a"), stored(spark.range(7).groupBy("id").count(), "b")
    path = second._scratch_path.removeprefix("file:")
    discard(second, spark.range(1))
    assert first.count() == 5 and not os.path.exists(path) and spark.conf.get(_CLEANUP, "false") == "false"


def test_scores_are_worked_out_where_they_are_asked_for(spark, texts):
    """Scores stand beside the findings: a query that leaves them out does not pay for them."""
    docs = texts(f"password = {s.OPENAI}\nx /a/b/c", "nothing", None)
    found = cw.findings(docs, custom=[cw.custom_rule("path", "/a/b/c")])
    words = "passw|pwd|credential"
    assert words in plan_of(found.select("doc_id", "risk"))
    assert words not in plan_of(found.select("doc_id", "value", "line", "column"))
    listed = cw.detect(docs, custom=[cw.custom_rule("path", "/a/b/c")]).selectExpr("inline(findings)").collect()
    assert len(listed) == 2 and [tuple(r) for r in found.select(*listed[0].__fields__).collect()] == [tuple(r) for r in listed]
    kept = cw.findings(docs, custom=[cw.custom_rule("path", "/a/b/c")], min_confidence=0.5).collect()
    assert kept == [r for r in found.collect() if r.confidence >= 0.5] and len(kept) == 1
