"""A store of originals that is only ever added to: what was put and what was cleared, the newest event winning.

Events lie in files bucketed by document, so restoring joins without shuffling the store, whatever its size: only the
documents that are asked for move.  Clearing adds a few numbers instead of rewriting texts; ``compact`` writes what is
left to a new generation, bucketed alike.  A generation counts once its marker is there; until then, and for readers that
began before, the one before it stands.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DONE = "_DONE"


class BackupLog:
    """The store below a folder.  Documents are told apart by ``id_cols``; rows where one of them is null are left out,
    as they could not be asked for.  One writer at a time.

    ``buckets`` is best no less than the session's shuffle partitions: Spark deals a store of fewer out again.
    """

    def __init__(self, spark: SparkSession, path: str, id_cols: Sequence[str] = ("doc_id",), id_types: Sequence[str] = ("bigint",), buckets: int = 200):
        self.spark, self.path, self.ids, self.buckets = spark, path.rstrip("/"), list(id_cols), buckets
        self.columns = [f"`{c}` {t}" for c, t in zip(id_cols, id_types, strict=True)]
        hadoop = spark.sparkContext._jsc.hadoopConfiguration()
        self._hadoop_path = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self._hadoop_path(self.path).getFileSystem(hadoop)
        if not self._generations():
            self._mark(0)

    def _generations(self) -> list[int]:
        found = self.files.globStatus(self._hadoop_path(f"{self.path}/gen=*/{_DONE}")) or []
        return sorted(int(f.getPath().getParent().getName().removeprefix("gen=")) for f in found)

    def _mark(self, generation: int) -> None:
        self.files.create(self._hadoop_path(f"{self.path}/gen={generation}/{_DONE}"), True).close()

    def _table(self, generation: int) -> str:
        """The generation as a bucketed table of this session's catalogue."""
        name = f"backup_{hashlib.sha256(self.path.encode()).hexdigest()[:16]}_{generation}"
        keys = ", ".join(f"`{c}`" for c in self.ids)
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({', '.join(self.columns)}, seq BIGINT, cleared BOOLEAN, text STRING) "
            f"USING parquet CLUSTERED BY ({keys}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/gen={generation}/events'"
        )
        return name

    def _add(self, rows: DataFrame, generation: int) -> None:
        known = rows.where(" and ".join(f"`{c}` is not null" for c in self.ids))
        # Dealt as the buckets are: a file for each bucket, not for each bucket and task.
        known.repartition(self.buckets, *self.ids).write.insertInto(self._table(generation))

    def put(self, df: DataFrame, text_col: str = "text", seq: int | None = None) -> None:
        """Keep the originals of some documents, in place of earlier ones."""
        seq = time.time_ns() if seq is None else seq
        event = [F.lit(seq).cast("long").alias("seq"), F.lit(False).alias("cleared"), F.col(text_col).cast("string").alias("text")]
        self._add(df.select(*self.ids, *event), self._generations()[-1])

    def clear(self, df: DataFrame, seq: int | None = None) -> None:
        """Forget the originals of some documents."""
        seq = time.time_ns() if seq is None else seq
        event = [F.lit(seq).cast("long").alias("seq"), F.lit(True).alias("cleared"), F.lit(None).cast("string").alias("text")]
        self._add(df.select(*self.ids).distinct().select("*", *event), self._generations()[-1])

    def kept(self) -> DataFrame:
        """The newest original of every document that has one; of several put at once, the first by text."""
        events = self.spark.table(self._table(self._generations()[-1]))
        newest = events.groupBy(*self.ids).agg(F.max("seq").alias("newest"))
        same = [F.col(f"e.`{c}`") == F.col(f"n.`{c}`") for c in self.ids]
        # Not an equality: the buckets' own columns are to be the only keys of the join.
        met = events.alias("e").join(newest.alias("n"), [*same, F.col("e.seq") >= F.col("n.newest")])
        rows = met.select(*[F.col(f"e.`{c}`") for c in self.ids], "e.cleared", "e.text")
        last = rows.groupBy(*self.ids).agg(F.max("cleared").alias("cleared"), F.min("text").alias("text"))
        return last.where("not cleared").drop("cleared")

    def restore(self, wanted: DataFrame) -> DataFrame:
        """The wanted documents with ``original_text``, null where there is none."""
        originals = self.kept().withColumnRenamed("text", "original_text").hint("merge")
        return wanted.join(originals, self.ids, "left")

    def compact(self) -> None:
        """Write what is left to a new generation; the generation before the present one goes."""
        now = self._generations()
        left = self.kept().select(*self.ids, F.lit(0).cast("long").alias("seq"), F.lit(False).alias("cleared"), "text")
        self._add(left, now[-1] + 1)
        self._mark(now[-1] + 1)
        for old in now[:-1]:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(old)}")
            self.files.delete(self._hadoop_path(f"{self.path}/gen={old}"), True)
