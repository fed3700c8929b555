from __future__ import annotations

from pyspark.sql import functions as F

import cloakwork as cw
from cloakwork.plans.queries import KEY, QUERIES
from cloakwork.plans.queries.common import messages_text
from cloakwork.plans.queries.streams import table_stream
from cloakwork.session import scratch_dir


def test_stream_and_batch_mask_alike(spark, small):
    got = QUERIES["stream_masked_messages"](spark, small)
    want = QUERIES["masked_conversations"](spark, small)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_new_checkpoint_replaces_nothing(spark, small):
    out, vault = scratch_dir(spark, "out"), scratch_dir(spark, "vault")

    def run(log):
        cw.protect_stream(
            messages_text(table_stream(spark, small, "conversations")),
            out_path=out, vault_path=vault, checkpoint=log, mode="number", key=KEY,
        ).awaitTermination()
        return [spark.read.parquet(p) for p in (out, vault)]

    log = scratch_dir(spark, "log")
    first = [df.count() for df in run(log)]
    # The same checkpoint has seen all; another one starts over, in a place of its own.
    assert all(first) and [df.count() for df in run(log)] == first
    again = run(scratch_dir(spark, "log"))
    assert [df.count() for df in again] == [2 * n for n in first]
    rows = again[1].groupBy("doc_id", "token_id").agg(F.countDistinct("payload").alias("n"), F.countDistinct("run").alias("runs"))
    assert rows.where("n <> 1 or runs <> 2").count() == 0


def test_counts_and_new_secrets(spark, small):
    counts = QUERIES["stream_finding_counts"](spark, small)
    assert counts.groupBy("window_start", "category").count().where("count > 1").count() == 0
    secrets = QUERIES["stream_new_secrets"](spark, small)
    assert secrets.count() == secrets.select("fingerprint").distinct().count() > 0
