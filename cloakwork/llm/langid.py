"""Language identification by Bayes' rule over what the text says, what its page declares and where it comes from.

The text speaks through letter trigrams.  The declared markup language and the address suffix speak through how
often they go with each language; the host through the languages found on it, smoothed towards its domain, and
that towards all hosts.  These counts come from the whole corpus by grouped aggregation; only the trigram table is
fitted on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..session import stored

# Labelled rows per language that the trigram table is fitted on, at most; taken by the hash of their text.
SAMPLE_PER_LANGUAGE = 400
# Labels that count as languages: the most frequent ones in the labelled rows.
MAX_LANGUAGES = 64

_BUCKETS = 1 << 15
_SMOOTHING = 0.05
# Trigrams of one text are not independent: its evidence counts by a share, and as that of so many at most.
_TEXT_SHARE, _TEXT_MOST = 0.3, 200.0
# Counts added from the level above: all hosts to a domain, a domain to a host.
_FROM_ABOVE = 5.0
# Below that many letters, a text speaks for no language, and none is rejected for it.
_FEW_LETTERS = 12


def _codes(text: str) -> np.ndarray:
    """The hashed letter trigrams of a text, words set apart by one space."""
    # Anything but letters separates: the tables of all languages are of letters only.
    letters = "".join([c if c.isalpha() else " " for c in text.lower()]) if not text.isalpha() else text.lower()
    padded = " " + " ".join(letters.split()) + " "
    points = np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if len(points) < 3:
        return np.zeros(0, np.int64)
    x = points[:-2] * np.uint32(0x9E3779B1) + points[1:-1] * np.uint32(0x85EBCA77) + points[2:] * np.uint32(0xC2B2AE3D)
    return ((x ^ (x >> np.uint32(15))) % np.uint32(_BUCKETS)).astype(np.int64)


@dataclass(frozen=True)
class TextModel:
    """Log-likelihoods of trigrams by language; the last row is that of a text in none of them."""

    languages: tuple[str, ...]
    table: np.ndarray

    def scores(self, text: str | None) -> tuple[np.ndarray, int, float]:
        """Log-likelihood by language, the number of trigrams, and by how much the best beats no language, each."""
        codes = _codes(text or "")
        if len(codes) < _FEW_LETTERS or not self.languages:
            return np.zeros(len(self.languages)), len(codes), 0.0
        sums = self.table[:, codes].sum(axis=1)
        own = sums[:-1]
        share = min(_TEXT_SHARE, _TEXT_MOST / len(codes))
        return (own - own.max()) * share, len(codes), float((own.max() - sums[-1]) / len(codes))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: dict[str, np.ndarray] = {}
        for language, text in zip(batch["label"].to_pylist(), batch["text"].to_pylist(), strict=True):
            own = counts.setdefault(language, np.zeros(_BUCKETS, np.int64))
            own += np.bincount(_codes(text or ""), minlength=_BUCKETS)
        for language, own in counts.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([language] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(own[at], pa.int64())],
                names=["label", "bucket", "n"],
            )


def fit_text_model(labelled: DataFrame, text_col: str = "text", label_col: str = "lang") -> TextModel:
    """Fit the trigram table on at most ``SAMPLE_PER_LANGUAGE`` texts of each language.

    The sample goes by the hash of the text, so that it does not depend on the order of rows; what reaches the driver
    is one count per language and bucket.  Copies of one text are in it together.
    """
    rows = labelled.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(label_col).cast("string").alias("label"), F.col(text_col).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    top = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(MAX_LANGUAGES)
    sizes = {r.label: r.n for r in top.collect()}
    languages = tuple(sorted(sizes))
    if not languages:
        return TextModel((), np.zeros((1, _BUCKETS), np.float32))
    # The share of a language's texts that makes about half the bound, by hash.
    share = [F.when(F.col("label") == l, F.lit(min(1.0, SAMPLE_PER_LANGUAGE / n / 2))) for l, n in sizes.items()]
    limit = F.coalesce(*share, F.lit(0.0))
    part = F.pmod("h", F.lit(1_000_003)) / 1_000_003
    sample = rows.where(part < limit).select("label", "text")
    found = sample.mapInArrow(_counted, "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros((len(languages) + 1, _BUCKETS))
    at = {l: i for i, l in enumerate(languages)}
    for row in found.toLocalIterator():
        counts[at[row.label], row.bucket] = row.n
    counts += _SMOOTHING
    # No language: every trigram as likely as any other.
    counts[-1] = 1.0
    table = np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)
    return TextModel(languages, table)


def _scored(model: TextModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.scores(t) for t in batch["text"].to_pylist()]
            rest = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "text"]
            names = [name for name in batch.schema.names if name != "text"]
            yield pa.RecordBatch.from_arrays(
                [
                    *rest,
                    pa.array([s.tolist() for s, _, _ in found], pa.list_(pa.float64())),
                    pa.array([n for _, n, _ in found], pa.int64()),
                    pa.array([m for _, _, m in found], pa.float64()),
                ],
                names=[*names, "scores", "n_trigrams", "margin"],
            )

    return run


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))


def suffix_of(host: Column) -> Column:
    return F.regexp_extract(host, r"([^.]*)$", 1)


def domain_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)


def declared_of(html: Column) -> Column:
    """The language that a page's markup declares, without its region."""
    return F.lower(F.regexp_extract(html, r"(?i)<html[^>]*\slang\s*=\s*[\"']?([a-z]{2,3})", 1))


def identify(rows: DataFrame, model: TextModel, none_margin: float = 0.0) -> DataFrame:
    """Fuse the evidence of ``rows``: ``(key columns..., text, declared, suffix, host, domain)``.

    Any of the four may be null or empty, and then says nothing.  The result has the key columns and ``language``
    (null if nothing speaks for any), ``probability``, ``text_language``, ``n_trigrams`` and ``rejected``: the text
    is long enough to be judged and less likely in its best language than in none.  Rows are kept as often as they
    come; a null text has no trigrams.
    """
    languages = model.languages
    given = ["declared", "suffix", "host", "domain"]
    keys = [c for c in rows.columns if c not in ("text", *given)]
    scored = rows.select(*keys, *given, "text").mapInArrow(
        _scored(model),
        rows.select(*keys, *given).schema.add("scores", ArrayType(DoubleType())).add("n_trigrams", "long").add("margin", "double"),
    )
    scored = stored(scored, "text-scores")
    if not languages:
        return scored.select(
            *keys,
            F.lit(None).cast("string").alias("language"),
            F.lit(None).cast("double").alias("probability"),
            F.lit(None).cast("string").alias("text_language"),
            "n_trigrams",
            F.lit(False).alias("rejected"),
        )
    names = F.array(*map(F.lit, languages))
    best = F.array_position("scores", F.array_max("scores")).cast("int")
    sure = (F.col("n_trigrams") >= _FEW_LETTERS) & (F.col("margin") > none_margin)
    scored = scored.withColumn("text_language", F.when(sure, F.get(names, best - 1)))

    def counts(by: str) -> DataFrame:
        """Rows by text language and a value, as one array per value."""
        some = scored.where(F.col("text_language").isNotNull() & (F.coalesce(F.col(by), F.lit("")) != ""))
        tally = [F.count(F.when(F.col("text_language") == l, 1)).cast("double") for l in languages]
        return some.groupBy(by).agg(F.array(*tally).alias(f"{by}_n"))

    tally = [F.count(F.when(F.col("text_language") == l, 1)).cast("double") for l in languages]
    total = list(scored.agg(F.array(*tally)).first()[0])
    k = len(languages)
    prior = [(n + 1.0) / (sum(total) + k) for n in total]
    above = F.array(*map(F.lit, prior))

    # P(value | language) over P(value): the value's share of a language, against its share of all rows.
    def lift(by: str) -> DataFrame:
        own = F.transform(
            F.arrays_zip(F.col(f"{by}_n").alias("n"), F.array(*map(F.lit, total)).alias("t"), above.alias("p")),
            lambda x: F.log((x["n"] + _FROM_ABOVE * x["p"]) / (x["t"] + _FROM_ABOVE)),
        )
        return counts(by).select(by, own.alias(f"{by}_log"))

    def smoothed(own: Column, higher: Column) -> Column:
        size = F.aggregate(own, F.lit(0.0), lambda x, y: x + y)
        return F.transform(
            F.arrays_zip(own.alias("n"), higher.alias("p")),
            lambda x: (x["n"] + _FROM_ABOVE * x["p"]) / (size + _FROM_ABOVE),
        )

    domains = counts("domain").select("domain", smoothed(F.col("domain_n"), above).alias("domain_p"))
    hosts = counts("host").select("host", "host_n")
    met = (
        scored.join(lift("declared"), "declared", "left")
        .join(lift("suffix"), "suffix", "left")
        .join(domains, "domain", "left")
        .join(hosts, "host", "left")
    )
    # A row's own text is not evidence for its host.
    own_at = F.transform(names, lambda l: F.when(l == F.col("text_language"), 1.0).otherwise(0.0))
    others = F.transform(
        F.arrays_zip(F.col("host_n").alias("n"), own_at.alias("o")), lambda x: F.greatest(x["n"] - x["o"], F.lit(0.0))
    )
    base = F.coalesce("domain_p", above)
    prior_of = F.when(F.col("host_n").isNull(), base).otherwise(smoothed(others, base))
    zero = F.array(*[F.lit(0.0)] * k)
    evidence = F.transform(
        F.arrays_zip(
            F.col("scores").alias("s"),
            F.coalesce("declared_log", zero).alias("d"),
            F.coalesce("suffix_log", zero).alias("a"),
            prior_of.alias("p"),
        ),
        lambda x: x["s"] + x["d"] + x["a"] + F.log(x["p"]),
    )
    fused = met.select(*keys, "text_language", "n_trigrams", "margin", *given, F.explode_outer(F.array(evidence)).alias("e"))
    top = F.array_max("e")
    spread = F.aggregate("e", F.lit(0.0), lambda s, x: s + F.exp(x - top))
    silent = (F.col("n_trigrams") < _FEW_LETTERS) & F.coalesce(
        *[F.when(F.col(c) != "", F.col(c)) for c in ("declared", "host")]
    ).isNull()
    return fused.select(
        *keys,
        F.when(~silent, F.get(names, F.array_position("e", top).cast("int") - 1)).alias("language"),
        F.when(~silent, 1 / spread).alias("probability"),
        "text_language",
        "n_trigrams",
        ((F.col("n_trigrams") >= _FEW_LETTERS) & (F.col("margin") <= none_margin)).alias("rejected"),
    )
