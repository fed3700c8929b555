"""Upkeep of a stream's vault: many small folders of micro-batches become few files.

A stream adds a folder ``run=<id>/batch=<n>`` to its vault with every micro-batch.  Compaction writes the batches that
are finished to a segment below ``_segments``, which plain readers of the folder do not see, and then publishes a manifest
below ``_manifest``: which segments there are and up to which batch of each run they hold the rows.  A reader takes the
newest manifest, its segments, and the batch folders that it does not cover, so it sees each row once:

* before a manifest is published, only the folders count; a segment without a manifest is never read;
* from then on the segment counts and its folders do not, whether they are still there or not;
* a batch that the stream runs again writes the rows it wrote before, to a folder that is covered already.

The newest batch of a run may be about to be run again and stays out.  Folders are deleted one compaction after the one that
covered them, so that a reader that is at work keeps its files.  Segments grow in tiers: new rows are merged with the
segments behind them that are no larger, so a row is rewritten as often as the logarithm of the vault's size.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows in a file of a segment, about.
ROWS_PER_FILE = 1_000_000

_SEGMENTS, _MANIFESTS = "_segments", "_manifest"


class _Store:
    """The few operations on the vault's folder that Spark's readers and writers do not offer."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.files = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def names(self, path: str) -> list[str]:
        place = self._path(path)
        return sorted(f.getPath().getName() for f in self.files.listStatus(place)) if self.files.exists(place) else []

    def batches(self) -> Iterator[tuple[str, int]]:
        """Finished batches by run and number."""
        found = self.files.globStatus(self._path(f"{self.root}/run=*/batch=*/_SUCCESS")) or []
        for status in found:
            folder = status.getPath().getParent()
            number = re.fullmatch(r"batch=([0-9]+)", folder.getName())
            if number:
                yield folder.getParent().getName().removeprefix("run="), int(number[1])

    def read(self, path: str) -> str:
        stream = self.files.open(self._path(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, path: str, text: str) -> None:
        """Write a file that is there whole or not at all; one that is there already is an error."""
        draft, place = self._path(f"{path}.{uuid.uuid4().hex}.draft"), self._path(path)
        out = self.files.create(draft, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if self.files.exists(place) or not self.files.rename(draft, place):
            self.files.delete(draft, False)
            raise FileExistsError(f"{path} has been published by another compaction")

    def delete(self, path: str) -> None:
        self.files.delete(self._path(path), True)


def _newest(store: _Store) -> tuple[int, dict]:
    """Number and content of the newest manifest."""
    numbers = [int(n.removesuffix(".json")) for n in store.names(f"{store.root}/{_MANIFESTS}") if re.fullmatch(r"[0-9]+\.json", n)]
    if not numbers:
        return 0, {"segments": [], "covered": {}, "before": {}}
    return max(numbers), json.loads(store.read(f"{store.root}/{_MANIFESTS}/{max(numbers):010d}.json"))


def _rows(spark: SparkSession, store: _Store, segments: list[str], batches: list[tuple[str, int]]) -> DataFrame | None:
    parts = []
    if batches:
        folders = [f"{store.root}/run={run}/batch={n}" for run, n in batches]
        rows = spark.read.option("basePath", store.root).parquet(*folders)
        parts.append(rows.withColumn("run", F.col("run").cast("string")).withColumn("batch", F.col("batch").cast("long")))
    if segments:
        parts.append(spark.read.parquet(*[f"{store.root}/{_SEGMENTS}/{s}" for s in segments]))
    if not parts:
        return None
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def read_vault(spark: SparkSession, vault_path: str) -> DataFrame:
    """Every row of a stream's vault once, with its ``run`` and ``batch``."""
    store = _Store(spark, vault_path)
    _, manifest = _newest(store)
    covered = manifest["covered"]
    open_batches = [(run, n) for run, n in store.batches() if n > covered.get(run, -1)]
    rows = _rows(spark, store, [s["name"] for s in manifest["segments"]], open_batches)
    if rows is None:
        raise ValueError(f"no vault at {vault_path}")
    return rows


def compact_vault(spark: SparkSession, vault_path: str, rows_per_file: int = ROWS_PER_FILE) -> int:
    """Move finished batches into segments; how many were moved.  One compaction of a vault runs at a time: of two, one
    fails when it publishes, and nothing is lost."""
    store = _Store(spark, vault_path)
    number, manifest = _newest(store)
    covered = manifest["covered"]
    finished = list(store.batches())
    newest = {run: max(n for r, n in finished if r == run) for run in {r for r, _ in finished}}
    new = [(run, n) for run, n in finished if covered.get(run, -1) < n < newest[run]]
    if not new:
        return 0

    fresh = _rows(spark, store, [], new)
    total, merged, kept = fresh.count(), [], list(manifest["segments"])
    while kept and kept[-1]["rows"] <= total:
        merged.append(kept.pop())
        total += merged[-1]["rows"]
    name = f"{number + 1:010d}-{uuid.uuid4().hex}"
    files = max(1, -(-total // rows_per_file))
    # In ranges of token ids: a file says in its statistics which ones it has.
    rows = _rows(spark, store, [s["name"] for s in merged], new)
    rows.repartitionByRange(files, "token_id").sortWithinPartitions("token_id").write.parquet(f"{store.root}/{_SEGMENTS}/{name}")

    segments = [*kept, {"name": name, "rows": total}] if total else kept
    now = dict(covered) | {run: max(n for r, n in new if r == run) for run in {r for r, _ in new}}
    text = json.dumps({"segments": segments, "covered": now, "before": covered, "gone": [s["name"] for s in merged]})
    store.publish(f"{store.root}/{_MANIFESTS}/{number + 1:010d}.json", text)
    # What the manifest before this one covered has had its readers.
    for run, n in finished:
        if n <= covered.get(run, -1):
            store.delete(f"{store.root}/run={run}/batch={n}")
    for old in manifest.get("gone", []):
        store.delete(f"{store.root}/{_SEGMENTS}/{old}")
    return len(new)
