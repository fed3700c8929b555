"""Secrets in text by a random forest, which tells them from what only looks like one.

A candidate is a run of at least ``MIN_LENGTH`` letters, digits and a few signs with a digit in it.  The forest sees
its length and make-up, how its characters follow each other, how much of it words of the corpus cover, where the file
lies, and how the words beside it go with secrets among labelled findings.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

MIN_LENGTH = 12
# Labelled findings that the forest is trained on, at most; taken by the hash of their id.
MAX_LABELLED = 20_000
# A word of the corpus counts as one from so many occurrences on.
DICTIONARY_COUNT = 5

_TREES, _DEPTH, _SEED = 30, 6, 7
# Added to the counts of a neighbouring word, half to either side.
_SMOOTHING = 2.0

# The word or name before, what stands between, the value, and the word after.  Nothing is tried twice, so that a run
# of any length costs in proportion.
_NAME = r"[\p{L}\p{N}_]"
_CANDIDATE = (
    rf"(?:(?<!{_NAME})({_NAME}++)[^\p{{L}}\p{{N}}_\n]{{1,4}}+)?"
    rf"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])([A-Za-z0-9_+/-]{{{MIN_LENGTH},}}+={{0,2}}+)"
    rf"(?=[^\p{{L}}\p{{N}}_]{{0,4}}+({_NAME}*+))"
)

FEATURES = [
    "length",
    "digits",
    "capitals",
    "signs",
    "turns",
    "surprise",
    "covered",
    "depth",
    "test_path",
    "before_odds",
    "after_odds",
]


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """``(id, nth, value, before, after, path)``: the candidates of every whole text, numbered from 0.

    Null and empty texts have none; rows of one id and text are one text.  Without a path column the path is empty.
    """
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    rows = docs.select(F.col(id_col).alias("id"), path.alias("path"), F.col(text_col).alias("text"))
    hits = F.arrays_zip(
        *[F.regexp_extract_all("text", F.lit(_CANDIDATE), F.lit(g)).alias(n) for g, n in ((1, "before"), (2, "value"), (3, "after"))]
    )
    found = rows.where(F.col("text").rlike(r"[0-9]")).select("id", "path", F.posexplode_outer(hits).alias("nth", "hit"))
    found = found.where("hit is not null")
    return found.select(
        "id", "nth", F.col("hit.value").alias("value"), F.lower("hit.before").alias("before"), F.lower("hit.after").alias("after"), "path"
    ).distinct()


@dataclass(frozen=True)
class Corpus:
    """What the features need to know of all documents: words, and how often letters follow each other."""

    words: DataFrame
    pairs: DataFrame


def corpus_of(docs: DataFrame, text_col: str = "text") -> Corpus:
    """Words of letters with their counts, and pairs of letters with the logarithm of their share after the first."""
    words = docs.select(F.explode(F.split(F.lower(text_col), r"[^\p{L}]+")).alias("word")).where(F.length("word") >= 3)
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= DICTIONARY_COUNT)
    counts = stored(counts, "words")
    pairs = counts.select("n", F.explode(_pairs(F.col("word"))).alias("pair")).groupBy("pair").agg(F.sum("n").alias("n"))
    firsts = pairs.groupBy(F.substring("pair", 1, 1).alias("first")).agg(F.sum("n").alias("total"))
    shares = pairs.join(firsts, F.substring("pair", 1, 1) == F.col("first"))
    return Corpus(counts.select("word"), stored(shares.select("pair", F.log(F.col("n") / F.col("total")).alias("log_share")), "pairs"))


def _pairs(word: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(word) - 1, F.lit(1))), lambda i: F.substr(word, i, F.lit(2)))


# A pair that no word has.
_NEVER = -12.0


def features(found: DataFrame, corpus: Corpus) -> DataFrame:
    """The candidates with their own features, and without those of their neighbours.  Values are looked at once."""
    value = F.col("value")
    share = lambda pattern: F.regexp_count("value", F.lit(pattern)) / F.length("value")
    distinct = stored(found.select("value").distinct(), "candidates")
    pairs = distinct.select("value", F.explode(_pairs(F.lower("value"))).alias("pair")).join(corpus.pairs, "pair", "left")
    surprise = pairs.groupBy("value").agg((-F.avg(F.coalesce("log_share", F.lit(_NEVER)))).alias("surprise"))
    parts = distinct.select("value", F.explode(F.split(F.lower("value"), "[^a-z]+")).alias("word")).where(F.length("word") >= 3)
    known = parts.join(corpus.words, "word").groupBy("value").agg(F.sum(F.length("word")).alias("known"))
    kind = r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Za-z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])"
    own = distinct.join(surprise, "value", "left").join(known, "value", "left")
    own = own.select(
        value,
        F.length(value).cast("double").alias("length"),
        share("[0-9]").alias("digits"),
        share("[A-Z]").alias("capitals"),
        share("[^A-Za-z0-9]").alias("signs"),
        share(kind).alias("turns"),
        F.coalesce("surprise", F.lit(0.0)).alias("surprise"),
        (F.coalesce("known", F.lit(0)) / F.length(value)).alias("covered"),
    )
    path = F.col("path")
    return found.join(own, "value").select(
        *found.columns,
        *FEATURES[:7],
        F.size(F.split(path, "/")).cast("double").alias("depth"),
        path.rlike(r"(?i)(^|[/_.-])(tests?|examples?|samples?|fixtures?|mocks?)([/_.-]|$)").cast("double").alias("test_path"),
    )


@dataclass(frozen=True)
class Forest:
    model: RandomForestClassificationModel
    neighbours: DataFrame
    base: float


def _with_odds(rows: DataFrame, neighbours: DataFrame, base: float) -> DataFrame:
    """The log-odds of the words beside a candidate; a word that no labelled finding has says nothing."""
    side = lambda name: neighbours.where(F.col("side") == name).select(
        F.col("word").alias(name), F.col("odds").alias(f"{name}_odds")
    )
    met = rows.join(side("before"), "before", "left").join(side("after"), "after", "left")
    return met.fillna({"before_odds": base, "after_odds": base})


def train(labelled: DataFrame, corpus: Corpus) -> Forest:
    """Fit the forest on at most ``MAX_LABELLED`` findings ``(id, nth, value, before, after, path, is_secret)``."""
    some = labelled.dropna(subset=["value", "is_secret"]).withColumn("is_secret", F.col("is_secret").cast("double"))
    total = some.count()
    share = min(1.0, MAX_LABELLED / max(total, 1))
    some = some.where(F.pmod(F.xxhash64("id", "nth"), F.lit(1_000_003)) < int(share * 1_000_003))
    rows = stored(features(some, corpus), "labelled")
    sides = [rows.select(F.lit(s).alias("side"), F.col(s).alias("word"), "is_secret") for s in ("before", "after")]
    counts = sides[0].unionByName(sides[1]).groupBy("side", "word").agg(F.sum("is_secret").alias("p"), F.count(F.lit(1)).alias("n"))
    rate = rows.agg(F.avg("is_secret")).first()[0]
    if rate is None:
        raise ValueError("no labelled findings")
    odds = F.log((F.col("p") + _SMOOTHING * rate + 1e-3) / (F.col("n") - F.col("p") + _SMOOTHING * (1 - rate) + 1e-3))
    neighbours = stored(counts.select("side", "word", odds.alias("odds")), "neighbours")
    base = float(rows.sparkSession.range(1).select(F.log(F.lit((rate + 1e-3) / (1 - rate + 1e-3)))).first()[0])
    # Every other finding is shown without its neighbours, so that the forest learns to judge strange company by the
    # value itself.
    alone = F.pmod(F.xxhash64("nth", "id"), F.lit(2)) == 0
    shown = rows.select(
        *[F.when(~alone, F.col(c)).alias(c) if c in ("before", "after") else F.col(c) for c in rows.columns]
    )
    ready = VectorAssembler(inputCols=FEATURES, outputCol="v").transform(_with_odds(shown, neighbours, base))
    forest = RandomForestClassifier(
        featuresCol="v", labelCol="is_secret", numTrees=_TREES, maxDepth=_DEPTH, seed=_SEED, probabilityCol="probability"
    )
    return Forest(forest.fit(ready.select("v", "is_secret")), neighbours, base)


def classify(found: DataFrame, corpus: Corpus, forest: Forest, threshold: float = 0.5) -> DataFrame:
    """The candidates with ``probability`` of being a secret, and ``is_secret``; false positives are the rest."""
    rows = _with_odds(features(found, corpus), forest.neighbours, forest.base)
    scored = forest.model.transform(VectorAssembler(inputCols=FEATURES, outputCol="v").transform(rows))
    probability = vector_to_array("probability")[1]
    return scored.select(*found.columns, probability.alias("probability")).withColumn("is_secret", F.col("probability") >= threshold)
