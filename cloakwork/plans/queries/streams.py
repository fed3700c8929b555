"""Messages as they arrive."""

from __future__ import annotations

import re
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...operators.mask import protect, vault_of
from ...operators.unmask import unmask_numbered
from ...session import discard, scratch_dir, stored
from ...sources.corpus import spread
from ...streaming.live import finding_counts, mask_stream, new_secrets, protect_stream, unmask_stream
from ...streaming.vault import compact_vault, read_vault
from ..oracle import line_sql, masked_sql, pick_sql, quote, value_sql
from ..planted import any_line
from .common import CONVERSATIONS, KEY, KEYS_PER_TASK, messages_text, query, table


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = table(spark, sf_dir, name).schema
    # As a pattern, because a stream takes a plain path for a directory.
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.[p]arquet")


def _drained(stream: DataFrame, purpose: str, settings: dict[str, int] | None = None) -> DataFrame:
    """Everything the stream has to give, through a file sink; a stream keeps the settings that it was started with."""
    spark = stream.sparkSession
    path = scratch_dir(spark, purpose)
    before = {name: spark.conf.get(name) for name in settings or {}}
    for name, value in (settings or {}).items():
        spark.conf.set(name, value)
    try:
        running = (
            stream.writeStream.format("parquet")
            .option("path", path)
            .option("checkpointLocation", scratch_dir(spark, f"{purpose}-log"))
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


# Rows of a file that feeds a stream, about; a micro-batch takes the rows of as many files as there are cores.
ROWS_PER_FILE = 25_000


def _in_turn(df: DataFrame, time_col: str, files: int, purpose: str) -> DataFrame:
    """A stream of a table by time: micro-batches take its files one after the other, and no row comes behind a later one.

    So a watermark passes what waits in state after each of them, and state is bounded by a micro-batch.  Files are taken
    by their dates, which are set here; where the store does not keep them, all rows come in one micro-batch.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, purpose)
    (df.repartitionByRange(files, time_col) if files > 1 else df.coalesce(1)).write.parquet(path)
    reader = spark.readStream.schema(df.schema)
    batches = -(-files // spark.sparkContext.defaultParallelism)
    if batches > 1 and (written := _dated(spark, path)):
        reader = reader.option("maxFilesPerTrigger", -(-written // batches))
    return reader.parquet(path)


def _dated(spark: SparkSession, path: str) -> int:
    """Date the files of a written table a second apart, by their numbers; how many there are, or 0 if the store does not keep that."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = [f.getPath() for f in store.listStatus(folder) if f.getPath().getName().startswith("part-")]
    parts.sort(key=lambda p: (int(re.match(r"part-([0-9]+)", p.getName())[1]), p.getName()))
    first = (int(time.time()) - len(parts)) * 1000
    for i, part in enumerate(parts):
        store.setTimes(part, first + 1000 * i, -1)
    kept = all(store.getFileStatus(part).getModificationTime() == first + 1000 * i for i, part in enumerate(parts))
    return len(parts) if kept else 0


@query(masked_sql(CONVERSATIONS) + "SELECT * FROM masked")
def stream_masked_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drained(mask_stream(messages_text(table_stream(spark, sf_dir, "conversations"))).drop("text"), "masked")


@query(CONVERSATIONS)
def stream_vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked stream and its vault, put together again."""
    out, vault, log = (scratch_dir(spark, name) for name in ("stream-out", "stream-vault", "stream-log"))
    running = protect_stream(
        messages_text(table_stream(spark, sf_dir, "conversations")),
        out_path=out,
        vault_path=vault,
        checkpoint=log,
        mode="number",
        key=KEY,
    )
    running.awaitTermination()
    masked = spark.read.parquet(out).select("doc_id", "masked_text")
    restored = unmask_numbered(masked, spark.read.parquet(vault), KEY)
    return restored.select("doc_id", F.col("restored_text").alias("text"))


@query("SELECT doc_id, r.run, text FROM (" + CONVERSATIONS + ") AS c, (VALUES (1), (2)) AS r(run)")
def stream_vault_two_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams, each with its own checkpoint, write to the same place: both are restored from their own vaults."""
    out, vault = scratch_dir(spark, "stream-out"), scratch_dir(spark, "stream-vault")
    for _ in range(2):
        protect_stream(
            messages_text(table_stream(spark, sf_dir, "conversations")),
            out_path=out,
            vault_path=vault,
            checkpoint=scratch_dir(spark, "stream-log"),
            mode="number",
            key=KEY,
        ).awaitTermination()
    masked = spark.read.parquet(out).select("doc_id", F.col("run").alias("stream"), "masked_text")
    rows = spark.read.parquet(vault).withColumnRenamed("run", "stream")
    restored = unmask_numbered(masked, rows, KEY, id_cols=["doc_id", "stream"])
    first = restored.agg(F.min("stream")).first()[0]
    run = F.when(F.col("stream") == first, 1).otherwise(2)
    return restored.select("doc_id", run.alias("run"), F.col("restored_text").alias("text"))


def _event_messages(rows: DataFrame) -> DataFrame:
    key = F.col("event_id")
    return rows.select(key.alias("doc_id"), "ts", F.concat(F.col("props"), F.lit("\n"), any_line(key)).alias("text"))


@query(
    f"""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start,
  strftime(date_trunc('hour', ts) + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M') AS window_end,
  {pick_sql("event_id", lambda p: quote(p.category))} AS category, count(*) AS n_findings FROM events
WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE
GROUP BY ALL"""
)
def stream_finding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that the watermark has closed."""
    counts = _drained(finding_counts(_event_messages(table_stream(spark, sf_dir, "events")), "ts"), "counts")
    shown = [F.date_format(c, "yyyy-MM-dd HH:mm").alias(c) for c in ("window_start", "window_end")]
    return counts.select(*shown, "category", "n_findings")


@query(
    f"""SELECT DISTINCT sha256({pick_sql("user_id", lambda p: value_sql(p, "user_id"))}) AS fingerprint,
  {pick_sql("user_id", lambda p: quote(p.category))} AS category FROM events"""
)
def stream_new_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user sends the same secret again and again."""
    key = F.col("user_id")
    messages = table_stream(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), "ts", any_line(key).alias("text"))
    return _drained(new_secrets(messages, "ts", delay="400 days"), "secrets").select("fingerprint", "category")


# Minutes between a message and its vault row: some come before it, some after it, some too late to be waited for.
_LATER = (0, 30, -20, 55, 5, 24 * 60)


@query(
    f"""SELECT event_id AS doc_id, 1::INTEGER AS tokens_seen, CASE WHEN event_id % {len(_LATER)} = 5 THEN 0 ELSE 1 END::INTEGER AS tokens_restored,
  CASE WHEN event_id % {len(_LATER)} <> 5 THEN md5(props || chr(10) || {pick_sql("event_id", lambda p: line_sql(p, "event_id"))}) END AS text_md5 FROM events"""
)
def stream_restored_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked messages restored from a stream of vault rows; those whose row comes too late stay masked."""
    messages = _event_messages(spread(table(spark, sf_dir, "events"), KEYS_PER_TASK))
    # Both streams are fed from what is masked once.
    done = stored(protect(messages, mode="vault", key=KEY, corpus="events").drop("text"), "protected")
    later = F.make_dt_interval(mins=F.get(F.array(*[F.lit(m) for m in _LATER]), (F.col("doc_id") % len(_LATER)).cast("int")))
    rows = vault_of(done, ["doc_id", "ts"]).withColumn("vault_ts", F.col("ts") + later)
    # A last row in either stream, years later, lets the watermark pass all others.
    end = F.lit("2100-01-01 00:00:00").cast("timestamp_ntz")
    last = spark.range(1).select(F.lit(-1).cast("long").alias("doc_id"), end.alias("ts"), F.lit("").alias("masked_text"))
    texts = done.select("doc_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "masked_text").unionByName(last)
    last = spark.range(1).select(F.lit("none").alias("token_id"), F.lit("").alias("payload"), end.alias("vault_ts"))
    vault = rows.select("token_id", "payload", F.col("vault_ts").cast("timestamp_ntz").alias("vault_ts")).unionByName(last)
    files = max(1, -(-done.count() // ROWS_PER_FILE))
    streams = [_in_turn(df, name, files, "restore-in") for df, name in ((texts, "ts"), (vault, "vault_ts"))]
    restored = unmask_stream(*streams, KEY, ts_col="ts", vault_ts_col="vault_ts")
    text = F.when(F.col("tokens_restored") == F.col("tokens_seen"), F.md5("restored_text"))
    discard(done)
    # What waits is a micro-batch's, so a partition of state for each core will do.  The stream is read once: no old state is kept.
    settings = {
        "spark.sql.shuffle.partitions": spark.sparkContext.defaultParallelism,
        "spark.sql.streaming.maxBatchesToRetainInMemory": 1,
        "spark.sql.streaming.minBatchesToRetain": 2,
        "spark.sql.streaming.stateStore.minDeltasForSnapshot": 2,
    }
    out = _drained(restored, "restored", settings)
    return out.where("doc_id >= 0").select("doc_id", "tokens_seen", "tokens_restored", text.alias("text_md5"))


@query(CONVERSATIONS)
def stream_vault_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream in micro-batches of some messages, whose vault is compacted before its texts are restored."""
    source = scratch_dir(spark, "messages")
    messages = messages_text(table(spark, sf_dir, "conversations"))
    messages.repartition(6).write.parquet(source)
    out, vault = scratch_dir(spark, "stream-out"), scratch_dir(spark, "stream-vault")
    protect_stream(
        spark.readStream.schema(messages.schema).option("maxFilesPerTrigger", 1).parquet(source),
        out_path=out,
        vault_path=vault,
        checkpoint=scratch_dir(spark, "stream-log"),
        mode="number",
        key=KEY,
    ).awaitTermination()
    compact_vault(spark, vault)
    restored = unmask_numbered(spark.read.parquet(out).select("doc_id", "masked_text"), read_vault(spark, vault), KEY)
    return restored.select("doc_id", F.col("restored_text").alias("text"))
