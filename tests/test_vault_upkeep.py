"""Compaction of a stream's vault: each token once, before, during and after."""

from __future__ import annotations

import glob
import os

import pytest
from pyspark.sql import functions as F

import cloakwork as cw
from cloakwork.session import scratch_dir
from cloakwork.streaming import vault as upkeep

KEY = bytes(range(32))


def tokens(df):
    return sorted((r.doc_id, r.token_id, r.payload) for r in df.select("doc_id", "token_id", "payload").collect())


def batch(spark, root, run, n, low, high):
    rows = spark.range(low, high).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("token_id"), F.lit("p").alias("payload"), F.lit("c").alias("category"))
    rows.coalesce(1).write.mode("overwrite").parquet(f"{root}/run={run}/batch={n}")


def expected(*ranges):
    return sorted((i, f"t{i}", "p") for low, high in ranges for i in range(low, high))


def test_each_token_once(spark):
    root = scratch_dir(spark, "vault").removeprefix("file:")
    with pytest.raises(ValueError, match="no vault"):
        cw.read_vault(spark, root)
    for n in range(4):
        batch(spark, root, "a", n, n * 10, n * 10 + 10)
    batch(spark, root, "b", 0, 100, 105)
    whole = expected((0, 40), (100, 105))
    assert tokens(cw.read_vault(spark, root)) == whole and cw.compact_vault(spark, root) == 3
    assert tokens(cw.read_vault(spark, root)) == whole
    # Folders are still there; a covered batch that is run again changes nothing, the newest one may.
    assert len(glob.glob(f"{root}/run=*/batch=*")) == 5
    batch(spark, root, "a", 1, 10, 20)
    batch(spark, root, "a", 3, 30, 40)
    assert tokens(cw.read_vault(spark, root)) == whole and cw.compact_vault(spark, root) == 0
    for n in range(4, 7):
        batch(spark, root, "a", n, n * 10, n * 10 + 10)
    whole = expected((0, 70), (100, 105))
    assert tokens(cw.read_vault(spark, root)) == whole
    reader = cw.read_vault(spark, root).select("doc_id", "token_id", "payload")
    assert cw.compact_vault(spark, root) == 3
    # The reader from before keeps its files, a new one sees the same; covered folders of the first time are gone.
    assert tokens(reader) == whole == tokens(cw.read_vault(spark, root))
    left = sorted(os.path.relpath(p, root) for p in glob.glob(f"{root}/run=*/batch=*"))
    assert left == ["run=a/batch=3", "run=a/batch=4", "run=a/batch=5", "run=a/batch=6", "run=b/batch=0"]
    # A batch from long ago is run again after its folder has gone.
    batch(spark, root, "a", 0, 0, 10)
    assert tokens(cw.read_vault(spark, root)) == whole


def test_a_compaction_that_is_lost(spark, monkeypatch):
    root = scratch_dir(spark, "vault").removeprefix("file:")
    for n in range(3):
        batch(spark, root, "a", n, n * 10, n * 10 + 10)

    def fails(self, path, text):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(upkeep._Store, "publish", fails)
        with pytest.raises(OSError, match="lost"):
            cw.compact_vault(spark, root)
    assert tokens(cw.read_vault(spark, root)) == expected((0, 30))
    assert cw.compact_vault(spark, root) == 2
    store = upkeep._Store(spark, root)
    with pytest.raises(FileExistsError):
        store.publish(f"{root}/_manifest/{1:010d}.json", "{}")
    assert tokens(cw.read_vault(spark, root)) == expected((0, 30))


def test_segments_stay_few(spark):
    root = scratch_dir(spark, "vault").removeprefix("file:")
    for n in range(12):
        batch(spark, root, "a", n, n * 10, n * 10 + 10)
        cw.compact_vault(spark, root)
    _, manifest = upkeep._newest(upkeep._Store(spark, root))
    assert len(manifest["segments"]) <= 4 and sum(s["rows"] for s in manifest["segments"]) == 110
    assert len(os.listdir(f"{root}/_segments")) <= 6
    assert tokens(cw.read_vault(spark, root)) == expected((0, 120))
