"""Scoring text with a language model that reads from both sides.

Every word is predicted from the two before it and the two after it; the logarithms of these probabilities, added up,
are the pseudo-likelihood of a document.  The network is small: one table of vectors for each of the four places, a
bend, and two steps of 32 choices, first the word's class and then the word in it.  It is trained in numpy, by every
task on its own rows from a common start, and the results are averaged by their numbers of words.

Words outside the vocabulary share places of the network.  How often each of them comes is counted over the whole corpus, and
its part of its place's occurrences is the last factor of its probability.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored

CLASSES = 32
WORDS = CLASSES * CLASSES
# Words outside the vocabulary share that many of its places, by hash.
RARE = 64
SIDE = 2
VECTOR = 16

# Of the words that are counted, about as many at most are looked up in memory; the others meet their counts in a join.
COMMON = 1 << 17
# Logarithms are added up in whole numbers of this part, so that a sum does not depend on the order.
_UNIT = 2.0**30

# The common start is trained on about as many documents, by the hash of their text.
START_DOCUMENTS = 500
_BATCH = 2048
_RATE = 0.1
_BLOCK = 4096

_SHAPES = {
    "vectors": (2 * SIDE, WORDS + 1, VECTOR),
    "bend": (VECTOR,),
    "to_class": (VECTOR, CLASSES),
    "class_bias": (CLASSES,),
    "class_vectors": (CLASSES, VECTOR),
    "to_member": (VECTOR, CLASSES),
    "member_bias": (CLASSES, CLASSES),
}


@dataclass
class Network:
    """Its tables by name; ``words`` gives the places of the most frequent words."""

    tables: dict[str, np.ndarray]
    words: dict[bytes, int]

    @staticmethod
    def start(words: dict[bytes, int]) -> Network:
        draw = np.random.default_rng(0)
        return Network({k: draw.normal(0, 0.1, s).astype(np.float32) for k, s in _SHAPES.items()}, words)

    def ids(self, text: str | None) -> np.ndarray:
        """The places of a text's words, lower case, cut at white space."""
        known = self.words
        found = [
            i if (i := known.get(w)) is not None else WORDS - 1 - zlib.crc32(w) % RARE
            for w in (text or "").lower().encode("utf-8", "surrogatepass").split()
        ]
        return np.array(found, np.int64)

    def contexts(self, ids: np.ndarray) -> np.ndarray:
        """The places of the neighbours of each word, a further place standing for none."""
        padded = np.concatenate([np.full(SIDE, WORDS), ids, np.full(SIDE, WORDS)])
        offsets = [*range(SIDE), *range(SIDE + 1, 2 * SIDE + 1)]
        return np.stack([padded[o : o + len(ids)] for o in offsets])

    def hidden(self, near: np.ndarray) -> np.ndarray:
        tables = self.tables["vectors"]
        h = tables[0].take(near[0], axis=0)
        for j in range(1, 2 * SIDE):
            h += tables[j].take(near[j], axis=0)
        h += self.tables["bend"]
        return np.tanh(h, out=h)

    def forward(self, near: np.ndarray, ids: np.ndarray):
        """The hidden values, each word's class, and the values of both steps before they are normed."""
        t, h = self.tables, self.hidden(near)
        own = ids // CLASSES
        first = h @ t["to_class"]
        first += t["class_bias"]
        second = (h + t["class_vectors"].take(own, axis=0)) @ t["to_member"]
        second += t["member_bias"].take(own, axis=0)
        return h, own, first, second

    def log_probabilities(self, ids: np.ndarray) -> np.ndarray:
        near, out = self.contexts(ids), []
        for at in range(0, len(ids), 8 * _BATCH):
            part = ids[at : at + 8 * _BATCH]
            _, own, first, second = self.forward(near[:, at : at + 8 * _BATCH], part)
            out.append(_log_chosen(first, own) + _log_chosen(second, part % CLASSES))
        return np.concatenate(out) if out else np.zeros(0, np.float32)

    def train(self, near: np.ndarray, ids: np.ndarray, sums: dict[str, np.ndarray]) -> None:
        """One step of Adagrad on the words of a batch; ``sums`` holds the squares of earlier steps."""
        t, n = self.tables, len(ids)
        h, own, first, second = self.forward(near, ids)
        row = np.arange(n)
        g1, g2 = np.exp(_log_softmax(first), out=first), np.exp(_log_softmax(second), out=second)
        g1[row, own] -= 1
        g2[row, ids % CLASSES] -= 1
        is_own = np.zeros((n, CLASSES), np.float32)
        is_own[row, own] = 1
        through = g2 @ t["to_member"].T
        dh = (g1 @ t["to_class"].T + through) * (1 - h * h)
        steps = {
            "bend": dh.sum(0),
            "to_class": h.T @ g1,
            "class_bias": g1.sum(0),
            "class_vectors": is_own.T @ through,
            "to_member": (h + t["class_vectors"][own]).T @ g2,
            "member_bias": is_own.T @ g2,
            "vectors": _scatter(near, dh),
        }
        for name, step in steps.items():
            step /= np.float32(n)
            root = step * step
            sums[name] += root
            np.sqrt(sums[name], out=root)
            root += np.float32(1e-6)
            step *= np.float32(_RATE)
            step /= root
            t[name] -= step

    def learn(self, texts: Iterator[str | None], sums: dict[str, np.ndarray]) -> int:
        """Train on texts once, in batches that go across their ends; the number of words."""
        nears, parts, waiting, total = [], [], 0, 0
        for text in texts:
            ids = self.ids(text)
            nears.append(self.contexts(ids))
            parts.append(ids)
            waiting += len(ids)
            total += len(ids)
            if waiting >= 16 * _BATCH:
                self._batches(nears, parts, sums)
                nears, parts, waiting = [], [], 0
        self._batches(nears, parts, sums)
        return total

    def _batches(self, nears: list, parts: list, sums: dict[str, np.ndarray]) -> None:
        if not parts:
            return
        near, ids = np.concatenate(nears, axis=1), np.concatenate(parts)
        for at in range(0, len(ids), _BATCH):
            self.train(near[:, at : at + _BATCH], ids[at : at + _BATCH], sums)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.tables[k].ravel() for k in _SHAPES])

    def filled(self, values: np.ndarray) -> Network:
        tables, at = {}, 0
        for name, shape in _SHAPES.items():
            size = int(np.prod(shape))
            tables[name] = values[at : at + size].reshape(shape).astype(np.float32)
            at += size
        return Network(tables, self.words)


def no_steps() -> dict[str, np.ndarray]:
    return {k: np.full(s, 1e-4, np.float32) for k, s in _SHAPES.items()}


def _largest(x: np.ndarray) -> np.ndarray:
    """Of each row; down the columns of a turned copy this takes a third of the time."""
    return np.ascontiguousarray(x.T).max(axis=0)[:, None]


def _log_softmax(x: np.ndarray) -> np.ndarray:
    """In place."""
    x -= _largest(x)
    x -= np.log(np.exp(x).sum(axis=1, keepdims=True))
    return x


def _log_chosen(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One value a row of the logarithms of a softmax; the values are overwritten."""
    x -= _largest(x)
    chosen = x[np.arange(len(x)), at]
    return chosen - np.log(np.exp(x, out=x).sum(axis=1))


def _scatter(near: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Rows added up by the places of the neighbours, for each side."""
    values = rows.T.astype(np.float64)
    sums = np.empty((2 * SIDE, WORDS + 1, VECTOR), np.float32)
    for j, at in enumerate(near):
        for d, column in enumerate(values):
            sums[j, :, d] = np.bincount(at, column, WORDS + 1)
    return sums


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Each word of all documents and how often it comes, counted before the shuffle as well."""
    words = docs.select(F.explode(F.split(F.lower(text_col), r"[ \t\n\r\x0B\f]+")).alias("word")).where("word <> ''")
    return stored(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "words")


def vocabulary(counts: DataFrame) -> dict[bytes, int]:
    """The places of the most frequent words; ties go by word."""
    top = counts.orderBy(F.desc("n"), "word").limit(WORDS - RARE).collect()
    return {_bytes(r.word): i for i, r in enumerate(top)}


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def train(docs: DataFrame, text_col: str = "text", counts: DataFrame | None = None) -> Network:
    """Train on all documents; ``counts`` are their ``word_counts``, if there already.

    The common start sees some documents in one task; then every task goes once over its rows, and the averages over
    tasks, block by block, make the network.  What reaches the driver is the network itself, of fixed size.  Null and
    empty texts teach nothing; without any words the start is all there is.
    """
    texts = docs.select(F.col(text_col).alias("text"))
    total = texts.count()
    start = Network.start(vocabulary(word_counts(docs, text_col) if counts is None else counts))
    share = min(1.0, START_DOCUMENTS / max(total, 1))
    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(1_000_003)) < int(share * 1_000_003)).repartition(1)
    start = _averaged(some, start, passes=2)
    return _averaged(texts, start, passes=1)


def _averaged(texts: DataFrame, start: Network, passes: int) -> Network:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums, n = start.filled(start.flat()), no_steps(), 0
        for batch in batches:
            rows = batch["text"].to_pylist()
            for _ in range(passes):
                n += own.learn(iter(rows), sums)
        if n:
            values = own.flat()
            blocks = [values[i : i + _BLOCK] for i in range(0, len(values), _BLOCK)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(len(blocks)), pa.int32()),
                    pa.array([float(n)] * len(blocks), pa.float64()),
                    pa.array(blocks, pa.list_(pa.float32())),
                ],
                names=["block", "n", "weights"],
            )

    parts = texts.mapInArrow(run, "block int, n double, weights array<float>")
    each = stored(parts, "networks").select("block", "n", F.posexplode("weights").alias("at", "w"))
    mean = each.groupBy("block", "at").agg((F.sum(F.col("w") * F.col("n")) / F.sum("n")).alias("w"))
    found = mean.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("at", "w"))).alias("ws"))
    rows = found.select("block", F.col("ws.w").alias("w")).orderBy("block").collect()
    return start.filled(np.concatenate([np.array(r.w, np.float32) for r in rows])) if rows else start


@dataclass
class Shares:
    """The parts that words have of their places.

    ``common`` numbers the words of the vocabulary and those that come ``least`` times or more; ``place`` and ``share`` (a
    logarithm, 0 for a word that has a place of its own) are theirs by number, and a last one for no word.  ``totals`` has the
    logarithms of the occurrences of each shared place.
    """

    common: dict[bytes, int]
    place: np.ndarray
    share: np.ndarray
    totals: np.ndarray
    least: int

    @staticmethod
    def of(counts: DataFrame, words: dict[bytes, int]) -> Shares:
        """Collects some ``COMMON`` words at most, a histogram of counts and a sum for each shared place."""
        steps = counts.groupBy(F.floor(F.log2("n") * 8)).agg(F.min("n"), F.count(F.lit(1))).collect()
        least, room = 1 << 62, COMMON
        for _, n, size in sorted(steps, reverse=True):
            room -= size
            if room < 0:
                break
            least = n
        rare = counts.where(~F.col("word").isin([w.decode("utf-8", "surrogatepass") for w in words])) if words else counts
        sums = np.ones(RARE)
        for place, n in rare.groupBy(F.pmod(F.crc32("word"), F.lit(RARE)).alias("place")).agg(F.sum("n")).collect():
            sums[place] = n
        totals = np.log(sums)
        held = rare.where(F.col("n") >= least).toArrow()
        names = [_bytes(w) for w in held["word"].to_pylist()]
        shared = np.array([zlib.crc32(w) % RARE for w in names], np.int64)
        place = np.concatenate([np.fromiter(words.values(), np.int64, len(words)), WORDS - 1 - shared, [0]])
        share = np.concatenate([np.zeros(len(words)), np.log(held["n"].to_numpy()) - totals[shared], [0.0]])
        return Shares({w: i for i, w in enumerate([*words, *names])}, place, share, totals, least)

    def read(self, text: str | None) -> tuple[np.ndarray, float, list[bytes]]:
        """The places of the words of a lower-case text, the sum of their shares, and the words whose counts are not at hand:
        what their places' occurrences take off is in the sum, what their own add is not."""
        words = _bytes(text or "").split()
        number = self.common
        at = np.array([number.get(w, -1) for w in words], np.int64)
        ids, total = self.place[at], float(self.share[at].sum())
        gaps = np.flatnonzero(at < 0)
        others = [words[i] for i in gaps]
        if others:
            shared = np.array([zlib.crc32(w) % RARE for w in others], np.int64)
            ids[gaps] = WORDS - 1 - shared
            total -= float(self.totals[shared].sum())
        return ids, total, others


def score(
    docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text", counts: DataFrame | None = None
) -> DataFrame:
    """Per row: its id, ``n_words``, ``log_likelihood`` (the sum over all words of the whole text) and ``perplexity``.

    With ``counts``, the ``word_counts`` of a corpus, a word that shares its place has the place's probability times its part of
    the place's occurrences in that corpus (one that was not counted: as if it came once); without them it has its place's.

    Null and empty texts have no words, a sum of 0 and no perplexity.  Equal texts have equal scores.
    """

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums, sizes = [], []
            for text in batch["text"].to_pylist():
                found = network.log_probabilities(network.ids(text))
                sums.append(float(found.sum(dtype=np.float64)))
                sizes.append(len(found))
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array(sizes, pa.int64()), pa.array(sums, pa.float64())], names=["id", "n_words", "log_likelihood"]
            )

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            sums, sizes, others = [], [], []
            for text in batch["text"].to_pylist():
                ids, share, asked = shares.read(text)
                sums.append(float(network.log_probabilities(ids).sum(dtype=np.float64)) + share)
                sizes.append(len(ids))
                others.append([w.decode("utf-8", "surrogatepass") for w in asked])
            rows = pa.array(range(row, row + len(sizes)), pa.int64())
            row += len(sizes)
            yield pa.RecordBatch.from_arrays(
                [batch["id"], rows, pa.array(sizes, pa.int64()), pa.array(sums, pa.float64()), pa.array(others, pa.list_(pa.string()))],
                names=["id", "row", "n_words", "log_likelihood", "others"],
            )

    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("id"), (text if counts is None else F.lower(text)).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    if counts is None:
        found = rows.mapInArrow(places, f"id {kind}, n_words long, log_likelihood double")
    else:
        shares = Shares.of(counts, network.words)
        # Rows are told apart by numbers that are given once, since ids may repeat.
        read = stored(rows.mapInArrow(words, f"id {kind}, row long, n_words long, log_likelihood double, others array<string>"), "scores")
        asked = read.select("row", F.explode("others").alias("word"))
        known = asked.join(counts.where(F.col("n") < shares.least), "word", "left")
        part = F.round(F.log(F.coalesce("n", F.lit(1))) * _UNIT).cast("long")
        own = known.groupBy("row").agg((F.sum(part) / _UNIT).alias("own"))
        found = read.drop("others").join(own, "row", "left")
        found = found.withColumn("log_likelihood", F.col("log_likelihood") + F.coalesce("own", F.lit(0.0)))
    return found.select(
        F.col("id").alias(id_col),
        "n_words",
        "log_likelihood",
        F.when(F.col("n_words") > 0, F.exp(-F.col("log_likelihood") / F.col("n_words"))).alias("perplexity"),
    )
