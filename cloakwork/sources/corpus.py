"""Reading a tree of text files as a corpus."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stored

# Extensions that are scanned, and directories that are not.
EXTENSIONS = (
    "ts", "tsx", "js", "jsx", "py", "java", "go", "rb", "sh", "bash", "json", "md", "env", "txt",
    "yml", "yaml", "xml", "gradle", "properties", "ini", "conf", "toml",
)
SKIPPED_DIRS = ("node_modules", "out", "dist", "build", ".git", "venv", "env")

_SCHEMA = "root string, path string, text string"


# Rows that one task scans at most: a small text takes some tenth of a millisecond.
ROWS_PER_TASK = 200_000

# Files that one task opens at most.
FILES_PER_TASK = 10_000


def spread(df: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Deal a corpus whose rows lie in fewer partitions than there are cores out to all of them.

    Detection is bound by computing.  The number of partitions does not tell: a Parquet file is cut into splits by size,
    but a row group goes to one of them as a whole and the others stay empty.  So rows are counted by partition, for
    which a table's footers do.  Rows are also dealt out where one partition has more than ``rows_per_task``; a corpus
    that is read evenly by as many tasks as there are cores, or more, is returned as it is, without a shuffle, and so is
    a stream.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    sizes = df.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n"))
    filled, most, rows = sizes.agg(F.count("n"), F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if filled >= cores and most <= rows_per_task:
        return df
    return df.repartition(max(cores, -(-rows // rows_per_task)))


def is_scannable(path: Column) -> Column:
    """By its path below the root: a listed extension (any case) or ``.env``, and in no skipped directory."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    extension = F.lower(F.regexp_extract(name, r"[^/]\.([^./]*)$", 1))
    skipped = "|".join(re.escape(d) for d in SKIPPED_DIRS)
    return (extension.isin(*EXTENSIONS) | (name == ".env")) & ~path.rlike(f"(^|/)({skipped})/")


def cap_per_root(
    df: DataFrame, limit: int, root_col: str = "root", order_cols: Sequence[str] = ("path",)
) -> DataFrame:
    """The first ``limit`` rows of each root.  The rank filter is applied before the shuffle as well, so a
    root with most of the rows sends only ``limit`` rows per task."""
    rank = F.row_number().over(Window.partitionBy(root_col).orderBy(*order_cols))
    return df.withColumn("__cw_rank", rank).where(F.col("__cw_rank") <= limit).drop("__cw_rank")


def cap(df: DataFrame, limit: int, order_cols: Sequence[str] = ("path",)) -> DataFrame:
    return df.orderBy(*order_cols).limit(limit)


def _plain(root: str) -> str:
    """A root without scheme and authority, and without a closing slash."""
    return re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", root).rstrip("/")


def _scheme(root: str) -> str:
    """What stands before a root's plain path."""
    return root.rstrip("/")[: len(root.rstrip("/")) - len(_plain(root))]


def _located(path: Column, roots: Sequence[str]) -> tuple[Column, Column]:
    known = "|".join(re.escape(r) for r in sorted({_plain(r) for r in roots}, key=len, reverse=True))
    pattern = f"^(?:[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?)?({known})/(.*)$"
    return F.regexp_extract(path, pattern, 1), F.regexp_extract(path, pattern, 2)


def _reader(spark: SparkSession):
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("ignoreCorruptFiles", "true")
        .option("ignoreMissingFiles", "true")
    )


def _open(spark: SparkSession, roots: Sequence[str]) -> tuple[list[str], DataFrame | None]:
    """The roots that exist, and a reader over them.  Listing is costly, so all are tried together first."""

    def load(paths: list[str]) -> DataFrame | None:
        try:
            return _reader(spark).load(paths)
        except AnalysisException as error:
            if "PATH_NOT_FOUND" in str(error):
                return None
            raise

    files = load(list(roots))
    if files is not None:
        return list(roots), files
    present = [root for root in roots if load([root]) is not None] if len(roots) > 1 else []
    return present, load(present) if present else None


def _qualified(spark: SparkSession, roots: Sequence[str]) -> list[str]:
    """Roots without a scheme as absolute paths, as the session's file system understands them."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()

    def whole(root: str) -> str:
        if root.startswith("/") or re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", root):
            return root
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        return re.sub("^file:/+", "/", path.getFileSystem(hadoop).makeQualified(path).toString())

    return [whole(root) for root in roots]


def _arrow_place(path: str, stores: dict | None = None):
    """The file system and inner path of a path or URI; Hadoop's names of stores stand for Arrow's.

    ``stores`` keeps the remote file systems that were opened, by name.
    """
    from pyarrow import fs

    path = re.sub("^file:/+", "/", path)
    remote = re.match("([A-Za-z][A-Za-z0-9+.-]*://[^/]*)(/.*)?$", path, re.DOTALL)
    if remote is None:
        return fs.FileSystem.from_uri(path)
    # Only the store's own name is a URI: names of files may hold any character.
    stores = {} if stores is None else stores
    if remote[1] not in stores:
        stores[remote[1]] = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", remote[1]) + "/")
    system, top = stores[remote[1]]
    return system, f"{top.rstrip('/')}{remote[2] or '/'}"


_ENTRIES = "root string, path string, length long, folder boolean, hidden boolean"


def _look_into(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What lies in some folders, except for folders that are not scanned."""
    from pyarrow import fs

    for batch in batches:
        rows = []
        for root, folder, hidden in zip(batch["root"], batch["path"], batch["hidden"], strict=True):
            system, inner = _arrow_place(folder)
            for info in system.get_file_info(fs.FileSelector(inner, allow_not_found=True)):
                inside = bool(hidden) or info.base_name[0] in "._"
                is_folder = info.type == fs.FileType.Directory
                if not (is_folder and info.base_name in SKIPPED_DIRS):
                    rows.append((root, f"{folder.rstrip('/')}/{info.base_name}", info.size or 0, is_folder, inside))
        yield pd.DataFrame(rows, columns=["root", "path", "length", "folder", "hidden"])


def _hidden_files(spark: SparkSession, roots: Sequence[str]) -> DataFrame | None:
    """Files that Spark's own listing leaves out, ``(root, path, length)``: their name, or that of a folder above them
    below the root, begins with a dot or an underscore.

    The folders are looked through by tasks, level by level, each of them on its own, so that neither a wide nor a
    deep tree is left to one task.
    """
    level = spark.createDataFrame([(root, root, False) for root in roots], "root string, path string, hidden boolean")
    width, found = len(roots), []
    while width:
        # At most as many tasks as folders: a listing is a wait, not a computation.
        spread_out = level.repartition(min(width, 4 * spark.sparkContext.defaultParallelism))
        entries = stored(spread_out.mapInPandas(_look_into, _ENTRIES), "listing")
        found.append(entries.where("hidden and not folder").select("root", "path", "length"))
        level = entries.where("folder").select("root", "path", "hidden")
        width = level.count()
    return reduce(DataFrame.unionByName, found) if found else None


# Characters of text that one batch of files holds, but for the last file of it.
_BATCH_CHARS = 1 << 22


def _read_files(paths: DataFrame, path_col: str, fields: Sequence, with_reason: bool) -> DataFrame:
    """The named files with ``text``; those without are left out, or kept with the ``reason``.

    Names are dealt out first: each costs a look at the store, however few partitions they come in.
    """
    dealt = spread(paths.select(*[f.name for f in fields]), FILES_PER_TASK)
    new = ["text", "reason"] if with_reason else ["text"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stores: dict = {}

        def look(path: str) -> tuple[str | None, str | None]:
            try:
                system, inner = _arrow_place(path, stores)
                with system.open_input_stream(inner) as stream:
                    body = stream.readall()
            except FileNotFoundError:
                return None, "missing"
            except OSError:
                return None, "unreadable"
            return (None, "not text") if with_reason and b"\0" in body[:8000] else (body.decode("utf-8", errors="replace"), None)

        for batch in batches:
            at, found, held = [], [], 0
            for i, path in enumerate(batch[path_col]):
                one = look(path)
                if with_reason or one[1] is None:
                    at.append(i)
                    found.append(one[: len(new)])
                    held += len(one[0] or "")
                if at and (held >= _BATCH_CHARS or i == len(batch) - 1):
                    rows = batch.iloc[at].reset_index(drop=True)
                    for name, values in zip(new, zip(*found, strict=True), strict=True):
                        rows[name] = pd.Series(values, dtype=object)
                    yield rows
                    at, found, held = [], [], 0

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"{name} string" for name in new])
    return dealt.mapInPandas(read, schema)


def read_paths(paths: DataFrame, path_col: str = "path") -> DataFrame:
    """Contents of the named files; files that are missing or cannot be read are left out."""
    return _read_files(paths, path_col, [f for f in paths.schema.fields if f.name != "text"], False)


def read_outcomes(paths: DataFrame, path_col: str = "path") -> DataFrame:
    """The named files with ``text``, or with the ``reason`` why there is none: ``missing``, ``unreadable`` or ``not
    text`` (a zero byte among the first 8000).  Each file is opened once."""
    return _read_files(paths, path_col, [f for f in paths.schema.fields if f.name not in ("text", "reason")], True)


def _listing(files: DataFrame, roots: Sequence[str]) -> DataFrame:
    root, below = _located(F.col("path"), roots)
    path = F.concat_ws("/", root, below)
    return files.select(root.alias("root"), path.alias("path"), "length", is_scannable(below).alias("scanned"))


def _contents(files: DataFrame, roots: Sequence[str]) -> DataFrame:
    # File metadata spells paths as URLs; a plus sign there is just a plus sign.  The filter uses nothing
    # else, so that files are dropped from the list before any is opened.
    url = F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))
    root, below = _located(F.url_decode(url), roots)
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return files.where(is_scannable(below)).select(
        root.alias("root"), F.concat_ws("/", root, below).alias("path"), text.alias("text")
    )


def _names(roots: str | Sequence[str]) -> list[str]:
    return [roots] if isinstance(roots, str) else list(roots)


def _all_listed(spark: SparkSession, present: Sequence[str], files: DataFrame, hidden: bool) -> DataFrame:
    listing = _listing(files, present)
    unseen = _hidden_files(spark, present) if hidden else None
    return listing if unseen is None else listing.unionByName(_listing(unseen, present))


def list_corpus(spark: SparkSession, roots: str | Sequence[str], *, hidden: bool = True) -> DataFrame:
    """Every file below the roots with its size and whether it would be scanned; contents are not read.

    Folders that are not scanned are not looked into for hidden files.
    """
    present, files = _open(spark, _qualified(spark, _names(roots)))
    if files is None:
        return spark.createDataFrame([], "root string, path string, length long, scanned boolean")
    return _all_listed(spark, present, files, hidden)


def load_corpus(
    spark: SparkSession,
    roots: str | Sequence[str],
    *,
    max_files: int | None = None,
    max_files_per_root: int | None = None,
    hidden: bool = True,
) -> DataFrame:
    """Scannable files below the roots as ``(root, path, text)``.

    Directories and file types that are not scanned are pruned from the file list before anything is read.
    A cap keeps the first files by path; it is worked out on the list of paths, also before reading, and only
    tasks see that list.  ``hidden`` takes in names that begin with a dot or an underscore, and what lies below
    such folders.  Roots that do not exist count as empty; relative ones lie below the working directory.
    """
    present, files = _open(spark, _qualified(spark, _names(roots)))
    if files is None:
        return spark.createDataFrame([], _SCHEMA)
    if max_files is not None or max_files_per_root is not None:
        paths = _all_listed(spark, present, files, hidden).where("scanned").select("root", "path")
        if max_files_per_root is not None:
            paths = cap_per_root(paths, max_files_per_root)
        if max_files is not None:
            paths = cap(paths, max_files)
        # The listing has plain paths; a file is opened where its root says.
        place = F.coalesce(*[F.when(F.col("root") == _plain(r), F.lit(_scheme(r))) for r in present])
        named = paths.withColumn("place", F.concat(place, "path"))
        return read_paths(named.repartition(spark.sparkContext.defaultParallelism), "place").select("root", "path", "text")
    corpus = _contents(files, present)
    unseen = _hidden_files(spark, present) if hidden else None
    if unseen is None:
        return corpus
    root, below = _located(F.col("path"), present)
    extra = read_paths(unseen.where(is_scannable(below)).select("path"))
    return corpus.unionByName(extra.select(root.alias("root"), F.concat_ws("/", root, below).alias("path"), "text"))


def load_checked(spark: SparkSession, roots: str | Sequence[str], *, hidden: bool = True) -> tuple[DataFrame, DataFrame]:
    """Scannable files below the roots, ``(root, path, text)``, and those that gave none, ``(root, path, reason)``; a root
    that does not exist is missing.

    Both come from one read, whose outcome is stored: a file that fails is not opened again to find out why.
    """
    named = _qualified(spark, _names(roots))
    present, files = _open(spark, named)
    gone = [(r, r, "missing") for r in named if r not in present]
    errors = spark.createDataFrame(gone, "root string, path string, reason string")
    if files is None:
        return spark.createDataFrame([], _SCHEMA), errors
    listed = stored(_all_listed(spark, present, files, hidden).where("scanned").select("root", "path"), "listing")
    place = F.coalesce(*[F.when(F.col("root") == _plain(r), F.lit(_scheme(r))) for r in present])
    tasks = max(spark.sparkContext.defaultParallelism, listed.count() // 1000)
    named_files = listed.withColumn("place", F.concat(place, "path")).repartition(tasks, "path")
    outcome = stored(read_outcomes(named_files, "place"), "files")
    corpus = outcome.where("reason is null").select("root", "path", "text")
    return corpus, errors.unionByName(outcome.where("reason is not null").select("root", "path", "reason"))


def unread_files(listing: DataFrame, corpus: DataFrame) -> DataFrame:
    """Files that were to be scanned but could not be read, or were left out by a cap."""
    return listing.where("scanned").join(corpus.select("path"), "path", "left_anti")
