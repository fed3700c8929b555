"""Restoring a stream of messages from a stream of vault rows."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

import cloakwork as cw
from cloakwork.plans.queries import streams
from cloakwork.session import scratch_dir

from . import samples as s

KEY = bytes(range(32))
START = dt.datetime(2024, 5, 1, 12)


def run(spark, source, out, log):
    """All that is new, as one start of the stream."""
    source.writeStream.format("parquet").option("path", out).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(source.schema).parquet(out)


def at(minutes):
    return F.lit(START + dt.timedelta(minutes=minutes)).cast("timestamp")


@pytest.mark.parametrize("mode", ["vault", "number"])
def test_vault_rows_that_come_later(spark, texts, mode):
    docs = texts(s.THREE, s.OPENAI, s.CLEAN, f"{s.ONE_LINE}\n{s.ONE_LINE}", None, s.THREE + "\n" + s.OPENAI)
    done = cw.protect(docs, mode=mode, key=KEY, corpus="c")
    masked = done.select("doc_id", "masked_text").withColumn("ts", at(0))
    rows = cw.vault_of(done).select("doc_id", "token_id", "payload")
    # The first text's rows come before it, the second's an hour and a half later, the others within the hour, some twice.
    vault = rows.withColumn("vault_ts", F.when(F.col("doc_id") == 0, at(-30)).when(F.col("doc_id") == 1, at(90)).otherwise(at(40)))
    messages_dir, vault_dir, out, log = (scratch_dir(spark, n) for n in ("messages", "vault", "out", "log"))

    def put(df, path):
        df.coalesce(1).write.mode("append").parquet(path)

    put(vault.where("doc_id = 0"), vault_dir)
    put(masked, messages_dir)
    stream = cw.unmask_stream(
        spark.readStream.schema(masked.schema).parquet(messages_dir),
        spark.readStream.schema(vault.schema).parquet(vault_dir),
        KEY, ts_col="ts", vault_ts_col="vault_ts", mode=mode,
    )
    first = {r.doc_id for r in run(spark, stream, out, log).collect()}
    assert first == {2, 4}
    put(vault.where("doc_id > 1"), vault_dir)
    put(vault.where("doc_id = 3"), vault_dir)
    run(spark, stream, out, log)
    put(vault.where("doc_id = 1"), vault_dir)
    for minutes in (300, 600):
        put(masked.limit(1).select(F.lit(-1).cast("long").alias("doc_id"), F.lit("").alias("masked_text"), at(minutes).alias("ts")), messages_dir)
        put(vault.limit(1).select(F.lit(-1).cast("long").alias("doc_id"), F.lit("x").alias("token_id"), F.lit("").alias("payload"), at(minutes).alias("vault_ts")), vault_dir)
        got = run(spark, stream, out, log)
    key = lambda r: (r.doc_id, r.restored_text, r.tokens_seen, r.tokens_restored)
    restore = cw.unmask_vault if mode == "vault" else cw.unmask_numbered
    want = {key(r) for r in restore(masked, vault.where("doc_id <> 1").drop("vault_ts"), KEY).collect()}
    rows = [key(r) for r in got.where("doc_id >= 0").collect()]
    assert len(rows) == 6 and set(rows) == want
    late = next(r for r in rows if r[0] == 1)
    assert late[2:] == (1, 0) and "sk-" not in late[1]


def test_conflicting_rows(spark, texts):
    done = cw.protect(texts(s.OPENAI), mode="vault", key=KEY, corpus="c")
    masked = done.select("doc_id", "masked_text").withColumn("ts", at(0))
    rows = cw.vault_of(done).select("token_id", "payload").withColumn("vault_ts", at(1))
    other = rows.withColumn("payload", F.lit("AAAA"))
    end = [F.lit("x").alias("token_id"), F.lit("").alias("payload"), at(900).alias("vault_ts")]
    dirs = [scratch_dir(spark, n) for n in ("messages", "vault", "out", "log")]
    masked.unionByName(masked.select(F.lit(-1).cast("long").alias("doc_id"), F.lit("").alias("masked_text"), at(900).alias("ts"))).write.parquet(dirs[0])
    rows.unionByName(other).unionByName(rows.select(*end)).write.parquet(dirs[1])
    stream = cw.unmask_stream(
        spark.readStream.schema(masked.schema).parquet(dirs[0]), spark.readStream.schema(rows.schema).parquet(dirs[1]),
        KEY, ts_col="ts", vault_ts_col="vault_ts",
    )
    row = run(spark, stream, dirs[2], dirs[3]).where("doc_id = 0").first()
    assert (row.tokens_seen, row.tokens_restored) == (1, 0) and row.restored_text == row.masked_text
    with pytest.raises(ValueError, match="mode"):
        cw.unmask_stream(masked, rows, KEY, ts_col="ts", vault_ts_col="vault_ts", mode="inline")


def test_restored_messages_are_masked_once_by_all_tasks(spark, tmp_path, monkeypatch):
    """The table lies in one partition; both streams come from one stored table."""
    seen = {}

    def protect(df, **options):
        seen["parts"] = df.rdd.getNumPartitions()
        return cw.protect(df, **options)

    def vault_of(df, *args):
        seen["files"] = df.inputFiles()
        return cw.vault_of(df, *args)

    monkeypatch.setattr(streams, "protect", protect)
    monkeypatch.setattr(streams, "vault_of", vault_of)
    events = spark.range(24).selectExpr(
        "id as event_id", "timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, int(id)) as ts", "'{}' as props"
    )
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    rows = streams.stream_restored_messages(spark, str(tmp_path)).collect()
    assert seen["parts"] >= spark.sparkContext.defaultParallelism
    assert seen["files"] and all("/protected-" in f for f in seen["files"])
    assert sorted((r.doc_id, r.tokens_restored) for r in rows) == [(i, int(i % 6 != 5)) for i in range(24)]


def _hourly(spark, folder, n):
    """Events an hour apart, the last ones first; one without a text."""
    rows = spark.range(n - 1, -1, -1, 1).selectExpr(
        "id as event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, int(id)) as ts", "if(id = 7, null, '{}') as props"
    )
    rows.coalesce(1).write.parquet(f"{folder}/events.parquet")
    return sorted((i, int(i != 7), int(i % 6 != 5 and i != 7)) for i in range(n))


def test_restored_messages_wait_for_a_micro_batch_only(spark, tmp_path, monkeypatch):
    """State is given up as time goes on, not when all messages are in it; nothing is late, and all is restored as before."""
    held, late = [], []

    def wait(self, *args):
        ended = finish(self, *args)
        for progress in self.recentProgress:
            held.append(sum(o["numRowsTotal"] for o in progress["stateOperators"]))
            late.extend(o["numRowsDroppedByWatermark"] for o in progress["stateOperators"])
        return ended

    finish = StreamingQuery.awaitTermination
    monkeypatch.setattr(StreamingQuery, "awaitTermination", wait)
    monkeypatch.setattr(streams, "ROWS_PER_FILE", 1, raising=False)
    n = 15 * spark.sparkContext.defaultParallelism
    want = _hourly(spark, tmp_path, n)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    rows = streams.stream_restored_messages(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.tokens_seen, r.tokens_restored) for r in rows) == want
    # A message, its vault row and its group; all at once they are nearly 3 n.
    assert len(held) > 3 and max(held) < n and not any(late)
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_restored_messages_where_the_store_keeps_no_dates(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "_dated", lambda *_: 0)
    monkeypatch.setattr(streams, "ROWS_PER_FILE", 1)
    want = _hourly(spark, tmp_path, 3 * spark.sparkContext.defaultParallelism)
    rows = streams.stream_restored_messages(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.tokens_seen, r.tokens_restored) for r in rows) == want
