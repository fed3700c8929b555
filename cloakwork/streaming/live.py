"""Protecting messages as they arrive."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.tokens import MASK_TOKEN, UUID4
from ..operators.catalogue import VAULT_PREFIX
from ..operators.detect import findings
from ..operators.mask import mask, protect, vault_of
from ..operators.unmask import MAP, payload_map, restored_by_map, untouched


def mask_stream(messages: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The batch projection on a stream: stateless, so no watermark and no state store."""
    return mask(messages, text_col, **options)


def _timed(messages: DataFrame, ts_col: str, delay: str) -> DataFrame:
    """With a watermark; a timestamp without time zone is read in the session's zone."""
    return messages.withColumn(ts_col, F.col(ts_col).cast("timestamp")).withWatermark(ts_col, delay)


def finding_counts(
    messages: DataFrame,
    ts_col: str,
    *,
    text_col: str = "text",
    id_cols: Sequence[str] = ("doc_id",),
    window: str = "1 hour",
    delay: str = "10 minutes",
) -> DataFrame:
    """Findings per category and time window; late messages are accepted for ``delay``."""
    found = findings(_timed(messages, ts_col, delay), text_col, id_cols=[*id_cols, ts_col])
    return (
        found.groupBy(F.window(ts_col, window).alias("w"), "category")
        .agg(F.count("*").alias("n_findings"))
        .select(
            F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "category", "n_findings"
        )
    )


def new_secrets(
    messages: DataFrame,
    ts_col: str,
    *,
    text_col: str = "text",
    id_cols: Sequence[str] = ("doc_id",),
    delay: str = "1 day",
    shares: int | None = None,
) -> DataFrame:
    """Each secret once while it keeps turning up within ``delay``; state is bounded by the watermark.

    A secret that is sent all the time would make one task hot, so copies are first dropped within shares
    of the messages, as many as there are shuffle partitions unless told otherwise, and only what is left meets
    by secret.
    """
    shares = shares or int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = findings(_timed(messages, ts_col, delay), text_col, id_cols=[*id_cols, ts_col])
    share = F.pmod(F.xxhash64(*id_cols), F.lit(shares))
    keys = ["fingerprint", "category"]
    shared = found.select(*keys, ts_col, share.alias("share")).dropDuplicatesWithinWatermark([*keys, "share"])
    return shared.drop("share").dropDuplicatesWithinWatermark(keys)


def unmask_stream(
    messages: DataFrame,
    vault: DataFrame,
    key: bytes,
    *,
    ts_col: str,
    vault_ts_col: str,
    text_col: str = "masked_text",
    id_cols: Sequence[str] = ("doc_id",),
    mode: str = "vault",
    early: str = "1 hour",
    wait: str = "1 hour",
    delay: str = "10 minutes",
    prefix: str = VAULT_PREFIX,
) -> DataFrame:
    """Restore the tokens in a stream of messages from a stream of vault rows, whichever comes first.

    A token takes the vault row of its id (``mode="vault"``) or of its message and number (``mode="number"``) whose
    time is at most ``early`` before and ``wait`` after the message's.  What has no vault row in time goes out
    unchanged once the watermark has passed, and is counted: ``tokens_seen`` less ``tokens_restored``.  Messages without
    a token pass at once.  Both streams may be late by ``delay``; state is dropped when no row can meet it any more.

    ``id_cols`` and ``ts_col`` tell messages apart.  A text is kept once while it waits, however many tokens it
    has.  Gives ``id_cols``, ``ts_col``, ``text_col``, ``restored_text`` and the counts, in append mode.
    """
    if mode not in ("vault", "number"):
        raise ValueError(f"mode must be 'vault' or 'number', not {mode!r}")
    ids = list(id_cols)
    pattern = f"(?i){prefix}({UUID4})" if mode == "vault" else MASK_TOKEN

    def name(token: Column) -> Column:
        found = F.regexp_extract(token, pattern, 1)
        return F.lower(found) if mode == "vault" else found

    timed = _timed(messages, ts_col, delay).select(*ids, ts_col, text_col)
    has_token = F.coalesce(F.col(text_col).rlike(pattern), F.lit(False))
    tokens = F.array_distinct(F.transform(F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(0)), name))
    asked = timed.where(has_token).select(*ids, ts_col, text_col, F.posexplode(tokens).alias("__cw_at", "__cw_token"))
    asked = asked.withColumn(text_col, F.when(F.col("__cw_at") == 0, F.col(text_col))).drop("__cw_at")

    rows = _timed(vault, vault_ts_col, delay).select(
        *([F.col(c).alias(f"__cw_{i}") for i, c in enumerate(ids)] if mode == "number" else []),
        F.col("token_id").alias("__cw_id"), F.col("payload").alias("__cw_payload"), F.col(vault_ts_col).alias("__cw_ts"),
    )
    same = F.col("__cw_token") == F.col("__cw_id")
    if mode == "number":
        same = reduce(lambda x, y: x & y, [F.col(c) == F.col(f"__cw_{i}") for i, c in enumerate(ids)], same)
    in_time = F.expr(f"__cw_ts >= `{ts_col}` - interval {early} and __cw_ts <= `{ts_col}` + interval {wait}")
    met = asked.join(rows, same & in_time, "leftOuter")

    entry = F.when(F.col("__cw_payload").isNotNull(), F.struct(F.col("__cw_token").alias("token_id"), F.col("__cw_payload").alias("payload")))
    whole = met.groupBy(*ids, ts_col).agg(F.max(text_col).alias(text_col), F.array_sort(F.collect_set(entry)).alias("__cw_rows"))
    known = whole.select(*ids, ts_col, text_col, payload_map(F.col("__cw_rows")).alias(MAP))
    return restored_by_map(known, pattern, name, key, text_col).unionByName(untouched(timed.where(~has_token), text_col))


def protect_stream(
    messages: DataFrame,
    *,
    out_path: str,
    vault_path: str,
    checkpoint: str,
    text_col: str = "text",
    id_cols: Sequence[str] = ("doc_id",),
    trigger: dict | None = None,
    **options,
) -> StreamingQuery:
    """Write masked messages and their vault.

    Per micro-batch the vault is written first, so no token is ever out without its vault row.  Both go to
    a directory of the stream and batch, ``run=<id>/batch=<n>``, replaced as a whole: a batch that is run again
    after a failure leaves the same rows (tokens and ciphertexts are derived, not random).  The id is the one that
    the checkpoint holds, so that a stream with a new checkpoint adds to earlier results and replaces none.
    """
    ids = list(id_cols)

    def write(batch: DataFrame, batch_id: int) -> None:
        log = batch.sparkSession.read.text(f"{checkpoint}/metadata")
        place = f"run={log.select(F.get_json_object('value', '$.id')).first()[0]}/batch={batch_id}"
        done = protect(batch, text_col, id_cols=ids, **options).persist()
        try:
            vault_of(done, ids).write.mode("overwrite").parquet(f"{vault_path}/{place}")
            done.drop("vault", text_col).write.mode("overwrite").parquet(f"{out_path}/{place}")
        finally:
            done.unpersist()

    return (
        messages.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
