"""Token ids of documents as raw binary shards, found again by document key in constant time.

What lies below the folder of a store; all numbers are little-endian:

=================  =============================================================================================
``data/*.ids``     one shard: the ids of its documents one after another, nothing else; two bytes an id where the
                   vocabulary allows it, four otherwise
``data/*.pos``     the shard's document boundaries: ``rows + 1`` signed 64-bit counts of ids
``data/*.key``     one part of the index: a minimal perfect hash of its keys and a slot for every key
``shards``         Parquet: number, file name, width, rows and ids of every shard, and the rows and ids before it
``parts``          Parquet: number, file name and keys of every part of the index
=================  =============================================================================================

Documents are written in ascending order of their keys over all shards.  The hash is a cascade of bit arrays: a key
that no other key shares its bit with stays on a level, the rest go down to the next, and the count of bits before
its own numbers the key.  Keys are not stored; a slot holds a 32-bit mark of its key, so that a key that was never
written is told from one that was, but for one in four thousand million.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from ..session import stored
from .common import NO_ID

# The id that ends a document.
END_ID = 2

# Keys in one part of the index, about: a part is built and loaded whole.
KEYS_PER_PART = 1 << 18

# Text that is encoded at a time, and ids that are read at a time, in bytes.
AT_ONCE = 8 << 20

# Distinct words whose encodings a worker keeps; beyond it they are worked out anew.
MAX_WORDS = 600_000

SLOT = np.dtype(
    [("mark", "<u4"), ("shard", "<u4"), ("last", "<u4"), ("copies", "<u8"), ("first", "<u8"), ("offset", "<u8"), ("length", "<u8")]
)
_HEAD = struct.Struct("<QQ")  # keys, levels

_ENTRY = "key long, shard int, name string, width int, row long, offset long, length long"
_FOUND = "key long, shard int, last int, copies long, first long, offset long, length long"
_READ = "key long, row long, start long, n_tokens long, ids binary"


# Encoding


# A cut between these is one between tokens: a run of letters ends, and one of marks begins.  Letters are those of
# which every version of Unicode says so.
_LETTER, _MARK = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f", ".,;:!?"


class Encoder:
    """Ids of texts by the tokenizers library, which sees every distinct word once.

    Blanks and line feeds are cut at and dropped by this vocabulary's own rules, as is any text before marks, and
    no normalisation or token reaches across such places, so the ids of a text are those of its words in a row.  Words
    of ASCII letters are looked up in lower case, which is what they are normalised to.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has the cores that Spark gives it
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        if any(m in t for t in self.special for m in _MARK + " \n"):
            raise ValueError("an added token holds a blank or a mark that texts are cut at")
        self.width = 2 if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.lengths, self.flat = np.zeros(1, np.int32), np.empty(0, np.uint32)

    def _learn(self, words: list[str]) -> None:
        flat, lengths = [], []
        for coded in self.library.encode_batch_fast(words, add_special_tokens=False):
            ids = coded.ids
            flat += ids
            lengths.append(len(ids))
        at = len(self.known)
        self.known.update(zip(words, range(at, at + len(words)), strict=True))
        self.flat = np.concatenate([self.flat, np.asarray(flat, np.uint32)])
        self.lengths = np.concatenate([self.lengths, np.asarray(lengths, np.int32)])

    def _codes(self, words: pa.Array) -> np.ndarray:
        """Numbers of distinct words, which are learnt if they are new."""
        low = pc.ascii_lower(words)
        plain = pc.string_is_ascii(words)
        for token in self.special:
            plain = pc.and_not(plain, pc.match_substring(low, token.lower()))
        spelt = pc.if_else(plain, low, words).dictionary_encode()
        names = spelt.dictionary.to_pylist()
        if len(self.known) > MAX_WORDS:
            self._forget()
        new = [w for w in names if w not in self.known]
        for at in range(0, len(new), 1 << 14):
            self._learn(new[at : at + (1 << 14)])
        codes = np.fromiter(map(self.known.__getitem__, names), np.int32, len(names))
        return codes[spelt.indices.to_numpy()]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where each text's ids begin and end, and all ids in a row."""
        apart = pc.replace_substring_regex(texts, f"([{_LETTER}])([{_MARK}])", r"\1 \2")
        words = pc.split_pattern(pc.replace_substring(apart, "\n", " "), " ")
        coded = words.flatten().dictionary_encode()
        each = self._codes(coded.dictionary)[coded.indices.to_numpy()]
        starts = np.cumsum(self.lengths, dtype=np.int64) - self.lengths
        n = self.lengths[each]
        ends = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
        ids = self.flat[np.repeat(starts[each] - ends[:-1], n) + np.arange(ends[-1])]
        places = words.offsets.to_numpy().astype(np.int64)
        return ends[places - places[0]], ids


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for all tasks of a worker."""
    return Encoder(path)


def _pieces(text: str, size: int) -> Iterator[str]:
    """A long text in parts that end before a blank, where there is one."""
    at = 0
    while at < len(text):
        end = text.rfind(" ", at + 1, at + size) if len(text) - at > size else len(text)
        if end < 0:
            end = text.find(" ", at + size)
            end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


def _runs(batch: pa.RecordBatch, column: str, size: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have about ``size`` bytes; a longer text stands alone."""
    lengths = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
    at = total = 0
    for i, n in enumerate(lengths):
        if i > at and total + n > size:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += n
    if at < len(lengths):
        yield batch.slice(at)


class _Shard:
    """The two files of a shard while they are written.  Every attempt of a task has names of its own, so what a lost
    executor leaves behind is never read."""

    def __init__(self, path: str, number: int, width: int):
        self.number, self.name = number, f"{number:07d}-{uuid.uuid4().hex}"
        self.width = width
        files, root = pafs.FileSystem.from_uri(path)
        files.create_dir(f"{root}/data", recursive=True)
        self.ids = files.open_output_stream(f"{root}/data/{self.name}.ids")
        self.pos = files.open_output_stream(f"{root}/data/{self.name}.pos")
        self.pos.write(np.zeros(1, "<i8").tobytes())
        self.rows = self.size = 0

    def write(self, ids: np.ndarray) -> None:
        self.ids.write(ids.astype(f"<u{self.width}").tobytes())

    def end(self, lengths: np.ndarray) -> dict[str, pa.Array]:
        """Close documents of these lengths; their entries without keys."""
        ends = self.size + np.cumsum(lengths)
        self.pos.write(ends.astype("<i8").tobytes())
        n = len(lengths)
        entry = {
            "shard": pa.array(np.full(n, self.number, np.int32)),
            "name": pa.array([self.name] * n, pa.string()),
            "width": pa.array(np.full(n, self.width, np.int32)),
            "row": pa.array(np.arange(self.rows, self.rows + n)),
            "offset": pa.array(ends - lengths),
            "length": pa.array(lengths),
        }
        self.rows, self.size = self.rows + n, int(ends[-1])
        return entry

    def close(self) -> None:
        self.ids.close()
        self.pos.close()


def _written(path: str, vocabulary: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shard = encoder(vocabulary), None
        for whole in batches:
            for batch in _runs(whole, "text", AT_ONCE):
                shard = shard or _Shard(path, TaskContext.get().partitionId(), own.width)
                if batch.num_rows == 1 and len(batch["text"][0].as_py() or "") > AT_ONCE:
                    n = 1
                    for piece in _pieces(batch["text"][0].as_py(), AT_ONCE):
                        ids = own.encode(pa.array([piece]))[1]
                        shard.write(ids)
                        n += len(ids)
                    shard.write(np.asarray([end_id]))
                    lengths = np.asarray([n], np.int64)
                else:
                    ends, ids = own.encode(batch["text"].fill_null(""))
                    lengths = np.diff(ends) + 1
                    both = np.full(lengths.sum(), end_id, np.uint32)
                    body = np.ones(len(both), bool)
                    body[np.cumsum(lengths) - 1] = False
                    both[body] = ids
                    shard.write(both)
                yield pa.RecordBatch.from_pydict({"key": batch["key"]} | shard.end(lengths))
        if shard is not None:
            shard.close()

    return run


def key_of(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))


def write(docs: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, parts: int | None = None) -> None:
    """Encode every whole text, end it with ``end_id`` and write the store below ``path``, a folder that all executors
    reach and Arrow can write to (local, HDFS, S3, GCS).

    Texts are dealt by ranges of their keys, one range to a shard; rows of one key that differ stand in the order of
    the hashes of their texts, equal rows in the order of the table, so that a key with a third of all rows fills many
    shards.  A missing key counts as the smallest number, a missing text as empty; repeated rows are written
    as often as they stand in the table; an empty table makes an empty store; other columns, whatever their names, are
    not read.  ``docs`` has to be readable twice with the same result, as files are.
    """
    spark = docs.sparkSession
    # At 128 MB of files to a partition a shard has some 200 MB of ids.
    parts = parts or max(docs.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(key_of(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("key", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("i"), "text")
    dealt = rows.repartitionByRange(parts, "key", "h", "i").sortWithinPartitions("key", "h", "i").select("key", "text")
    entries = stored(dealt.mapInArrow(_written(path, vocabulary, end_id), _ENTRY), "entries")

    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for every shard
    each = entries.groupBy("shard", "name", "width").agg(F.count(F.lit(1)).alias("rows"), F.sum("length").alias("ids"))
    each.select(
        "*",
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first_row"),
        F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("first_id"),
    ).write.parquet(f"{path}/shards")
    shards = spark.read.parquet(f"{path}/shards")

    met = entries.join(shards.select("shard", "first_row"), "shard")
    place = F.struct((F.col("first_row") + F.col("row")).alias("first"), "shard", "offset", "length")
    keys = met.groupBy("key").agg(F.min(place).alias("p"), F.max("shard").alias("last"), F.count(F.lit(1)).alias("copies"))
    total = shards.agg(F.sum("rows")).first()[0] or 0
    n = max(1, -(-total // KEYS_PER_PART))
    slots = keys.select("key", part_of(F.col("key"), n).alias("part"), F.lit(n).alias("of"), "p.*", "last", "copies")
    built = slots.groupBy("part").applyInArrow(_index(path), "part int, of int, name string, keys long")
    built.write.parquet(f"{path}/parts")


# Index


def part_of(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A one-to-one mix of 64 bits, another for every seed."""
    x = keys.astype(np.int64).view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _mark(keys: np.ndarray) -> np.ndarray:
    return (_mixed(keys, 1 << 20) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """Numbers each of ``n`` distinct keys from 0 to ``n - 1``; any other key gets some number or -1."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        bits = np.concatenate([*levels, np.empty(0, np.uint64)])
        self.words = bits
        count = np.bitwise_count(bits).astype(np.int64)
        self.before = np.cumsum(count) - count
        self.at = np.cumsum([0, *(len(w) for w in levels)])

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        """Two bits a key on every level: some six of ten keys stay there."""
        levels, left = [], keys
        while len(left):
            words = -(-2 * len(left) // 64)
            place = _mixed(left, len(levels)) % np.uint64(words * 64)
            alone = np.bincount(place.astype(np.int64), minlength=words * 64) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[place.astype(np.int64)]]
        return cls(levels)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        found = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, words in enumerate(self.levels):
            if not len(left):
                break
            place = _mixed(keys[left], level) % np.uint64(len(words) * 64)
            word, bit = (place >> np.uint64(6)).astype(np.int64), place & np.uint64(63)
            own = words[word]
            here = (own >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(own & ((np.uint64(1) << bit) - np.uint64(1)))
            found[left[here]] = (self.before[self.at[level] + word] + below)[here]
            left = left[~here]
        return found

    def write(self) -> bytes:
        sizes = np.asarray([len(w) for w in self.levels], "<u8")
        n = int(np.bitwise_count(self.words).sum())
        return _HEAD.pack(n, len(self.levels)) + sizes.tobytes() + self.words.astype("<u8").tobytes()

    @classmethod
    def read(cls, data: bytes) -> tuple[PerfectHash, int]:
        """The hash and where it ends."""
        _, levels = _HEAD.unpack_from(data)
        sizes = np.frombuffer(data, "<u8", levels, _HEAD.size).astype(np.int64)
        at = _HEAD.size + 8 * levels
        words = np.frombuffer(data, "<u8", sizes.sum(), at)
        return cls(np.split(words, np.cumsum(sizes)[:-1]) if levels else []), at + 8 * int(sizes.sum())


def _index(path: str):
    def build(table: pa.Table) -> pa.Table:
        keys = table["key"].to_numpy()
        own = PerfectHash.of(keys)
        slots = np.zeros(len(keys), SLOT)
        at = own.numbers(keys)
        slots["mark"][at] = _mark(keys)
        for field in ("shard", "last", "copies", "first", "offset", "length"):
            slots[field][at] = table[field].to_numpy()
        part, of = table["part"][0].as_py(), table["of"][0].as_py()
        name = f"{part:07d}-{uuid.uuid4().hex}"
        files, root = pafs.FileSystem.from_uri(path)
        with files.open_output_stream(f"{root}/data/{name}.key") as out:
            out.write(own.write())
            out.write(slots.tobytes())
        return pa.table({"part": pa.array([part], pa.int32()), "of": pa.array([of], pa.int32()), "name": [name], "keys": [len(keys)]})

    return build


class Part:
    """One part of the index in memory."""

    def __init__(self, data: bytes):
        self.hash, at = PerfectHash.read(data)
        self.slots = np.frombuffer(data, SLOT, -1, at)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are there, and their slots."""
        at = self.hash.numbers(keys)
        there = at >= 0
        there[there] = self.slots["mark"][at[there]] == _mark(keys[there])
        return there, self.slots[at[there]]


def _file(path: str, name: str) -> bytes:
    files, root = pafs.FileSystem.from_uri(path)
    with files.open_input_stream(f"{root}/data/{name}") as file:
        return file.read()


def _same(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with one value of a column each, in order."""
    values = batch[column].to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1), len(values)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def _found(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, part = None, None
        for whole in batches:
            for batch in _same(whole, "name"):
                if batch["name"][0].as_py() != name:
                    name = batch["name"][0].as_py()
                    part = Part(_file(path, f"{name}.key"))
                keys = batch["key"].to_numpy()
                there, slots = part.find(keys)
                columns = {"key": pa.array(keys[there])}
                for field, kind in (("shard", "i4"), ("last", "i4"), ("copies", "i8"), ("first", "i8"), ("offset", "i8"), ("length", "i8")):
                    columns[field] = pa.array(slots[field].astype(kind))
                yield pa.RecordBatch.from_pydict(columns)

    return run


def locate(keys: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """Each distinct key that is in the store: its first shard and row, the shard of its last row, its rows, and place
    and length of the first of them.  Keys are dealt by part of the index, so a task holds one part at a time."""
    spark = keys.sparkSession
    parts = spark.read.parquet(f"{path}/parts")
    n = parts.agg(F.max("of")).first()[0] or 1
    asked = keys.select(key_of(id_col).alias("key")).distinct().withColumn("part", part_of(F.col("key"), n))
    dealt = asked.join(parts.select("part", "name"), "part").repartition("name").sortWithinPartitions("name")
    return dealt.select("key", "name").mapInArrow(_found(path), _FOUND)


# Reading


def _documents(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pafs.FileSystem.from_uri(path)
        name, ids, pos = None, None, None
        for whole in batches:
            for batch in _same(whole, "name"):
                if batch["name"][0].as_py() != name:
                    name = batch["name"][0].as_py()
                    ids = files.open_input_file(f"{root}/data/{name}.ids")
                    pos = files.open_input_file(f"{root}/data/{name}.pos")
                for rows in _places(batch, pos):
                    yield from _bodies(*rows, batch["width"][0].as_py(), batch["first_row"][0].as_py(), batch["first_id"][0].as_py(), ids)

    return run


def _places(batch: pa.RecordBatch, pos: pa.NativeFile) -> Iterator[tuple[np.ndarray, ...]]:
    """Key, row, offset and length of documents of one shard, from the slots or, for keys with several rows, from
    the shard's boundaries."""
    keys, low, high, offset, length = (batch[c].to_numpy() for c in ("key", "low", "high", "offset", "length"))
    one = offset >= 0
    at = 0
    while at < len(keys):
        if one[at]:
            end = at + 1
            while end < len(keys) and one[end]:
                end += 1
            yield keys[at:end], low[at:end], offset[at:end], length[at:end]
        else:
            end = at + 1
            for a in range(low[at], high[at], 1 << 16):
                b = min(high[at], a + (1 << 16))
                pos.seek(8 * a)
                bounds = np.frombuffer(pos.read(8 * (b - a + 1)), "<i8")
                yield np.full(b - a, keys[at]), np.arange(a, b), bounds[:-1], np.diff(bounds)
        at = end


def _bodies(keys, rows, offset, length, width: int, first_row: int, first_id: int, ids: pa.NativeFile) -> Iterator[pa.RecordBatch]:
    """Documents with their ids as 32-bit numbers; neighbours are read together."""
    at = 0
    while at < len(keys):
        end, size = at + 1, length[at]
        while end < len(keys) and offset[end] == offset[at] + size and (size + length[end]) * 4 <= AT_ONCE:
            size += length[end]
            end += 1
        ids.seek(int(offset[at]) * width)
        body = np.frombuffer(ids.read(int(size) * width), f"<u{width}").astype("<u4").tobytes()
        bounds = np.concatenate([[0], np.cumsum(length[at:end])]) * 4
        yield pa.RecordBatch.from_pydict(
            {
                "key": pa.array(keys[at:end], pa.int64()),
                "row": pa.array(first_row + rows[at:end], pa.int64()),
                "start": pa.array(first_id + offset[at:end], pa.int64()),
                "n_tokens": pa.array(length[at:end], pa.int64()),
                "ids": pa.array([body[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()),
            }
        )
        at = end


def read(keys: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """The documents of the asked keys from the files of a store: ``key, row, start, n_tokens, ids``, one row for every
    row that was written.  ``row`` and ``start`` count rows and ids before it over all shards, ``ids`` has
    them as little-endian 32-bit numbers.  Keys that are not there, and repeats of a key, give nothing."""
    spark = keys.sparkSession
    shards = spark.read.parquet(f"{path}/shards")
    found = locate(keys, path, id_col).withColumn("shard", F.explode(F.sequence("shard", "last")))
    low = F.greatest(F.lit(0), F.col("first") - F.col("first_row"))
    high = F.least("rows", F.col("first") + F.col("copies") - F.col("first_row"))
    one = F.col("copies") == 1
    places = found.join(shards, "shard").select(
        "key", "name", "width", "first_row", "first_id", low.alias("low"), high.alias("high"),
        F.when(one, F.col("offset")).otherwise(-1).alias("offset"),
        F.when(one, F.col("length")).otherwise(-1).alias("length"),
    )
    # Few bytes each, but every row stands for a document to be read: the number of tasks follows the shards.
    parts = max(shards.count(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = places.repartitionByRange(parts, "name", "low").sortWithinPartitions("name", "low")
    return dealt.mapInArrow(_documents(path), _READ)


def get(path: str, keys: Iterable[int | None]) -> dict[int | None, list[np.ndarray]]:
    """Documents of a few keys without a Spark job: one part of the index and one range of a shard for each."""
    import pyarrow.parquet as pq

    files, root = pafs.FileSystem.from_uri(path)
    parts = {r["part"]: r for r in pq.read_table(f"{root}/parts", filesystem=files).to_pylist()}
    shards = {r["shard"]: r for r in pq.read_table(f"{root}/shards", filesystem=files).to_pylist()}
    n = max((r["of"] for r in parts.values()), default=1)
    out: dict[int | None, list[np.ndarray]] = {}
    for key in keys:
        number = NO_ID if key is None else key
        hashed = xxhash.xxh64_intdigest(struct.pack("<q", number), 42)
        part = parts.get((hashed - (hashed >> 63 << 64)) % n)
        there, slots = Part(_file(path, f"{part['name']}.key")).find(np.asarray([number], np.int64)) if part else ([False], None)
        out[key] = []
        if there[0]:
            s = slots[0]
            for shard in range(int(s["shard"]), int(s["last"]) + 1):
                r = shards[shard]
                low, high = max(0, int(s["first"]) - r["first_row"]), min(r["rows"], int(s["first"] + s["copies"]) - r["first_row"])
                with files.open_input_file(f"{root}/data/{r['name']}.pos") as pos, files.open_input_file(f"{root}/data/{r['name']}.ids") as ids:
                    bounds = np.frombuffer(pos.read_at(8 * (high - low + 1), 8 * low), "<i8")
                    body = np.frombuffer(ids.read_at(int(bounds[-1] - bounds[0]) * r["width"], int(bounds[0]) * r["width"]), f"<u{r['width']}")
                    out[key] += np.split(body, bounds[1:-1] - bounds[0])
    return out
