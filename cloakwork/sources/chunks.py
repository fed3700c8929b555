"""Very long texts in chunks of whole lines.

A file or text beyond a size is not one row: it is cut at line ends into chunks that tasks read and scan on their
own.  Detection goes line by line, so lines are enough, but for private key blocks, which may span many: a cut that would
fall into a block is left out.  Which cuts those are is worked out from the block's marker lines alone, over the
whole file, so a block may span any number of pieces.  A line is never cut.

Chunks carry how many lines stand before them; findings get their place in the whole from that and from the
number of findings in the chunks before, by running sums over chunks, not over text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.catalogue import Rule
from ..operators.detect import findings
from ..operators.mask import protect
from ..session import stored
from .corpus import _all_listed, _arrow_place, _names, _open, _plain, _qualified, _scheme

# Bytes of a file, or characters of a text, in a chunk.
CHUNK = 8 << 20

_BEGIN, _END = r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"-----END [A-Z ]*PRIVATE KEY-----"
_MARKS = re.compile(f"(?:({_BEGIN})|{_END})".encode())
_BLOCK = re.compile(f"{_BEGIN}(?s:.*?){_END}")

_PIECE = "root string, path string, place string, length long, start long"
_SEEN = _PIECE + ", first long, lines long, marks array<struct<at:long,end:long,begins:boolean>>"
_CHUNK = "root string, path string, chunk int, first_line long, text string"


def _lines_from(file: pa.NativeFile, start: int, size: int, length: int) -> tuple[int, bytes]:
    """Where the first line that begins in a piece begins, and all lines that do."""
    data = file.read_at(min(size, length - start) + min(start, 1), max(start - 1, 0))
    skip = data.find(b"\n") + 1 if start else 0
    if start and not skip or skip == len(data):
        return -1, b""
    parts, at = [data[skip:]], start + size
    while at < length and not parts[-1].endswith(b"\n"):
        more = file.read_at(min(1 << 16, length - at), at)
        end = more.find(b"\n") + 1 or len(more)
        parts.append(more[:end])
        at += end
    return max(start - 1, 0) + skip, b"".join(parts)


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, pa.NativeFile]]:
    """Rows with their files, a file opened once for neighbouring rows; those that cannot be read are left out."""
    place, file = None, None
    for batch in batches:
        for row in batch.to_pylist():
            try:
                if row["place"] != place:
                    system, inner = _arrow_place(row["place"])
                    place, file = row["place"], system.open_input_file(inner)
            except OSError:
                place = None
                continue
            yield row, file


def _look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a piece holds: where its first line begins, how many lines end in it, and markers of key blocks."""
    kind = pa.list_(pa.struct([("at", pa.int64()), ("end", pa.int64()), ("begins", pa.bool_())]))
    for row, file in _opened(batches):
        first, body = _lines_from(file, row["start"], row["_size"], row["length"])
        marks = [{"at": first + m.start(), "end": first + m.end(), "begins": m[1] is not None} for m in _MARKS.finditer(body)]
        columns = {k: [row[k]] for k in ("root", "path", "place", "length", "start")} | {"first": [first], "lines": [body.count(b"\n")]}
        yield pa.RecordBatch.from_pydict(columns | {"marks": pa.array([marks], kind)})


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row, file in _opened(batches):
        try:
            text = file.read_at(row["end"] - row["first"], row["first"]).decode("utf-8", errors="replace")
        except OSError:
            continue
        yield pa.RecordBatch.from_pydict(
            {
                "root": [row["root"]], "path": [row["path"]], "chunk": pa.array([row["chunk"]], pa.int32()),
                "first_line": [row["first_line"]], "text": [text],
            }
        )


def _dealt(rows: DataFrame, least: int) -> DataFrame:
    """Some pieces to a task, in as many tasks as keep all cores busy."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartitionByRange(max(1, min(least, max(cores, least // 8))), "path", "start")


def _in_blocks(seen: DataFrame, size: int) -> DataFrame:
    """Pieces ``(path, start)`` that begin inside a key block.

    Each end marker closes the block that the first begin marker behind the end marker before it opens.
    """
    marks = seen.select("path", "start", F.explode("marks").alias("m")).select("path", "start", "m.*")
    before = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    ends = F.coalesce(F.sum((~F.col("begins")).cast("long")).over(before), F.lit(0))
    opened, closed = F.when(F.col("begins"), F.struct("at", "start")), F.when(~F.col("begins"), F.struct("at", "start"))
    blocks = marks.withColumn("n", ends).groupBy("path", "n").agg(F.min(opened).alias("b"), F.min(closed).alias("e"))
    across = blocks.where("b.at < e.at and b.start < e.start")
    return across.select("path", F.explode(F.sequence(F.col("b.start") + size, F.col("e.start"), F.lit(size))).alias("start")).distinct()


def load_chunks(spark: SparkSession, roots: str | Sequence[str], *, chunk_bytes: int = CHUNK, hidden: bool = True) -> DataFrame:
    """Scannable files below the roots as ``(root, path, chunk, first_line, text)``: the rows of ``load_corpus``, but a
    file of more than ``chunk_bytes`` as several rows, in order by ``chunk``, that together are its text.

    Short files are read once; long ones twice, first for lines and markers.  Files that cannot be read are left out.
    """
    present, files = _open(spark, _qualified(spark, _names(roots)))
    if files is None:
        return spark.createDataFrame([], _CHUNK)
    listed = _all_listed(spark, present, files, hidden).where("scanned")
    place = F.coalesce(*[F.when(F.col("root") == _plain(r), F.lit(_scheme(r))) for r in present])
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(chunk_bytes))).alias("start")
    pieces = listed.select("root", "path", F.concat(place, "path").alias("place"), F.col("length"), starts)
    pieces = stored(pieces.select(*[F.col(f.split()[0]).cast(f.split()[1]) for f in _PIECE.split(", ")]), "pieces")

    long = pieces.where(F.col("length") > chunk_bytes)
    looked = _dealt(long, long.count()).withColumn("_size", F.lit(chunk_bytes)).mapInArrow(_look, _SEEN)
    seen = stored(looked, "seen")
    by_file = Window.partitionBy("path").orderBy("start")
    lines = F.coalesce(F.sum("lines").over(by_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = seen.withColumn("first_line", lines).where("first >= 0").join(_in_blocks(seen, chunk_bytes), ["path", "start"], "left_anti")
    chunks = cuts.select(
        "root", "path", "place", "start", "first", F.coalesce(F.lead("first").over(by_file), "length").alias("end"),
        (F.row_number().over(by_file) - 1).alias("chunk"), "first_line",
    )
    zero = F.lit(0).cast("long")
    short = pieces.where(F.col("length") <= chunk_bytes).select(
        "root", "path", "place", "start", zero.alias("first"), F.col("length").alias("end"), F.lit(0).alias("chunk"), zero.alias("first_line")
    )
    whole = stored(chunks.unionByName(short), "chunks")
    return _dealt(whole, whole.count()).mapInArrow(_read, _CHUNK)


def cuts_of(text: str, size: int) -> list[int]:
    """Where the chunks of a text begin: behind the line end that follows ``size`` characters, outside key blocks."""
    cuts, blocks = [0], _BLOCK.finditer(text)
    block = next(blocks, None)
    while len(text) - cuts[-1] > size:
        at = text.find("\n", cuts[-1] + size - 1) + 1
        while at and block and block.end() <= at:
            block = next(blocks, None)
        if at and block and block.start() < at:
            at = text.find("\n", block.end()) + 1
        if not at or at == len(text):
            break
        cuts.append(at)
    return cuts


def split_long(df: DataFrame, text_col: str = "text", *, chunk_chars: int = CHUNK) -> DataFrame:
    """The rows with ``chunk`` and ``first_line``; a row whose text is longer than ``chunk_chars`` becomes several,
    dealt to all cores, whose texts in order are its text.  Shorter texts, and null ones, pass without Python."""
    new = {"chunk": "int", "first_line": "long"}
    clash = sorted(new.keys() & set(df.columns))
    if clash:
        raise ValueError(f"column {clash[0]} is there already")
    is_long = F.coalesce(F.length(text_col) > chunk_chars, F.lit(False))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [f"{k} {t}" for k, t in new.items()])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                text, line = row[text_col][0].as_py(), 0
                cuts = [*cuts_of(text, chunk_chars), len(text)]
                for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    columns = {c: pa.array([text[a:b]], row[c].type) if c == text_col else row[c] for c in row.schema.names}
                    yield pa.RecordBatch.from_pydict(columns | {"chunk": pa.array([n], pa.int32()), "first_line": pa.array([line], pa.int64())})
                    line += text.count("\n", a, b)

    cut = df.where(is_long).mapInArrow(split, schema).repartition(df.sparkSession.sparkContext.defaultParallelism)
    whole = df.where(~is_long).select("*", F.lit(0).alias("chunk"), F.lit(0).cast("long").alias("first_line"))
    return whole.unionByName(cut)


def _checked(options: dict) -> None:
    for rule in options.get("custom", ()):
        if isinstance(rule, Rule) and rule.multiline:
            raise ValueError(f"rule {rule.name} may span lines: its matches cannot be kept out of cuts")


def _before(counts: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Findings in the chunks before each chunk."""
    order = Window.partitionBy(*ids).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("__cw_before", F.coalesce(F.sum("n").over(order), F.lit(0)).cast("int")).drop("n")


def _with_before(df: DataFrame, counts: DataFrame, ids: Sequence[str]) -> DataFrame:
    keys = [*ids, "chunk"]
    same = [F.col(f"d.`{k}`").eqNullSafe(F.col(f"c.`{k}`")) for k in keys]
    met = df.alias("d").join(_before(counts, ids).alias("c"), same, "left")
    return met.select("d.*", F.coalesce("c.__cw_before", F.lit(0)).alias("__cw_before"))


def chunk_findings(chunks: DataFrame, text_col: str = "text", *, id_cols: Sequence[str] = ("path",), **options) -> DataFrame:
    """``findings`` of texts in chunks, with lines and ordinals of the whole text.  ``id_cols`` name a whole text."""
    _checked(options)
    ids = list(id_cols)
    found = findings(chunks, text_col, id_cols=[*ids, "chunk", "first_line"], **options)
    counts = found.groupBy(*ids, "chunk").agg(F.count(F.lit(1)).alias("n"))
    placed = _with_before(found, counts, ids)
    line, ordinal = F.col("line") + F.col("first_line"), F.col("ordinal") + F.col("__cw_before")
    return placed.withColumn("line", line.cast("long")).withColumn("ordinal", ordinal).drop("chunk", "first_line", "__cw_before")


def protect_chunks(chunks: DataFrame, text_col: str = "text", *, mode: str = "category", id_cols: Sequence[str] = ("path",), **options) -> DataFrame:
    """``protect`` of texts in chunks: masked texts in order are the masked whole, and numbers go through it.

    Ciphertexts are bound to text and chunk; a chunk keeps the line ends it has.
    """
    _checked(options)
    ids = list(id_cols)
    if mode == "number":
        passed = {k: v for k, v in options.items() if k in ("custom", "scope", "entropy", "rules")}
        found = findings(chunks, text_col, id_cols=[*ids, "chunk"], **passed)
        counts = found.groupBy(*ids, "chunk").agg(F.count(F.lit(1)).alias("n"))
        chunks, options = _with_before(chunks, counts, ids), options | {"numbered_after": "__cw_before"}
    return protect(chunks, text_col, mode=mode, id_cols=[*ids, "chunk"], **options).drop("__cw_before")


def joined(chunks: DataFrame, text_col: Column | str, id_cols: Sequence[str] = ("path",)) -> DataFrame:
    """Whole texts again, for those that fit into a row."""
    parts = F.sort_array(F.collect_list(F.struct("chunk", F.col(text_col).alias("t"))))
    return chunks.groupBy(*id_cols).agg(F.array_join(F.transform(parts, lambda p: p["t"]), "").alias("text"))
