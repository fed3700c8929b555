"""Custom rules from configuration files.

The files look like YAML but are read line by line:

    rules:                        (or customPatterns:)
      - name: "internal-token"
        pattern: "itok_[a-z0-9]{32}"
        category: custom

Many files, one per root, are parsed by the same job.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import split_lines, trim_space
from ..operators.catalogue import Rule, custom_rule
from .corpus import _qualified, read_paths
from .patterns import runnable

# In order of preference.
CONFIG_NAMES = (".cloakwork.yml", ".cloakwork.yaml")

# Section headers, and what stands in for a missing name or category.
SECTIONS = ("rules:", "customPatterns:")
DEFAULT_NAME = "custom-pattern"
DEFAULT_CATEGORY = "custom"

ENTRY = r"^(name|pattern|category):\s*(.+)$"

MAX_RULES = 100_000


def first_candidate(files: DataFrame, names: Sequence[str] = CONFIG_NAMES) -> DataFrame:
    """Of the files ``(root, path, text)``, per root the one whose name is preferred."""
    base = F.regexp_extract("path", r"([^/]*)$", 1)
    preference = F.array_position(F.array(*[F.lit(n) for n in names]), base)
    ranked = files.withColumn("__cw_order", preference).where("__cw_order > 0")
    best = F.row_number().over(Window.partitionBy("root").orderBy("__cw_order"))
    return ranked.withColumn("__cw_rank", best).where("__cw_rank = 1").drop("__cw_order", "__cw_rank")


def read_config_files(
    spark: SparkSession, roots: Sequence[str], names: Sequence[str] = CONFIG_NAMES
) -> DataFrame:
    """The preferred readable configuration file of each root; roots without one give no row."""
    candidates = [(r, f"{r.rstrip('/')}/{n}") for r, n in product(_qualified(spark, roots), names)]
    return first_candidate(read_paths(spark.createDataFrame(candidates, "root string, path string")), names)


def _unquoted(value: Column) -> Column:
    text = trim_space(value)
    quoted = (text.startswith('"') & text.endswith('"')) | (text.startswith("'") & text.endswith("'"))
    return F.when(quoted, F.substring(text, F.lit(2), F.greatest(F.length(text) - 2, F.lit(0)))).otherwise(text)


def parse_rules(files: DataFrame, file_cols: Sequence[str] = ("root", "path")) -> DataFrame:
    """Rules of configuration files with a ``text`` column, as ``(..., item, name, pattern, category)``.

    A header line opens the section and nothing closes it; a dash starts an item, the rest of its line may
    hold an entry; a later entry with the same key wins; comments after a value belong to the value.  A
    missing name gets a default, a missing pattern drops the item.
    """
    keys = list(file_cols)
    lines = files.select(*keys, F.posexplode(split_lines(F.col("text"))).alias("line_no", "raw")).select(
        *keys, "line_no", trim_space(F.col("raw")).alias("line")
    )
    lines = lines.where((F.col("line") != "") & ~F.col("line").startswith("#"))
    so_far = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    header = F.col("line").isin(*SECTIONS)
    dash = F.col("line").startswith("-") & F.col("open")
    items = (
        lines.withColumn("header", header)
        .withColumn("open", F.max("header").over(so_far))
        .withColumn("dash", dash)
        .withColumn("item", F.sum(F.col("dash").cast("long")).over(so_far))
        .where("open and not header and item > 0")
    )
    entry = F.when(F.col("dash"), trim_space(F.regexp_replace("line", r"^-\s*", ""))).otherwise(F.col("line"))
    entries = items.withColumn("entry", entry).select(
        *keys,
        "item",
        "line_no",
        F.regexp_extract("entry", ENTRY, 1).alias("key"),
        _unquoted(F.regexp_extract("entry", ENTRY, 2)).alias("value"),
    )

    def latest(key: str) -> Column:
        return F.max_by(F.when(F.col("key") == key, F.col("value")), F.when(F.col("key") == key, F.col("line_no")))

    return (
        entries.groupBy(*keys, "item")
        .agg(
            F.coalesce(latest("name"), F.lit(DEFAULT_NAME)).alias("name"),
            F.coalesce(latest("pattern"), F.lit("")).alias("pattern"),
            F.coalesce(latest("category"), F.lit(DEFAULT_CATEGORY)).alias("category"),
        )
        .where("name != '' and pattern != ''")
    )


def load_rules(spark: SparkSession, roots: Sequence[str], names: Sequence[str] = CONFIG_NAMES) -> DataFrame:
    return parse_rules(read_config_files(spark, roots, names))


def usable_rules(rules: DataFrame, order_cols: Sequence[str] = ("item",)) -> tuple[list[Rule], DataFrame]:
    """Split rules into those that can run, in order, and a table of rejected ones.

    Patterns that are valid in JavaScript's spelling only are respelt.
    A rule table is small by nature; one beyond ``MAX_RULES`` is refused rather than collected.
    """
    spark = rules.sparkSession
    rows = rules.orderBy(*order_cols).select("name", "pattern", "category").limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} custom rules")
    checked = [(row, runnable(spark, row.pattern)) for row in rows]
    rejected = [tuple(row) for row, pattern in checked if pattern is None]
    return (
        [custom_rule(row.name, pattern, row.category) for row, pattern in checked if pattern is not None],
        spark.createDataFrame(rejected, "name string, pattern string, category string"),
    )
