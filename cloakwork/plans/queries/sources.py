"""File trees and rule configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ...functions.text import count_newlines
from ...operators.detect import findings
from ...session import scratch_dir
from ...sources.chunks import chunk_findings, joined, load_chunks, protect_chunks, split_long
from ...sources.corpus import cap, cap_per_root, is_scannable, list_corpus, load_corpus, read_outcomes
from ...sources.rule_config import CONFIG_NAMES, first_candidate, parse_rules, usable_rules
from .. import report
from ..oracle import WRAPPED_DOCUMENTS, detect_sql, masked_sql, quote
from .common import documents, orders_text, query, table, wrapped_documents


@query(detect_sql(WRAPPED_DOCUMENTS) + "SELECT category, count(*) AS n_findings FROM found GROUP BY category")
def corpus_tree_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents written as text files below a folder, and that folder scanned."""
    root = scratch_dir(spark, "tree")
    wrapped_documents(spark, sf_dir).select("text").write.option("maxRecordsPerFile", 200).text(root)
    return report.by_category(findings(load_corpus(spark, root), id_cols=["path"]))


_BY_SOURCE = f"SELECT source AS doc_id, string_agg(t.text, chr(10) ORDER BY t.doc_id) AS text FROM ({WRAPPED_DOCUMENTS}) t JOIN documents USING (doc_id) GROUP BY source"


@query(detect_sql(_BY_SOURCE) + "SELECT doc_id AS source, line, col, ordinal, category, md5(value) AS value_md5 FROM found")
def long_file_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents of a source as one file, read and scanned in chunks of at most 64 KB or so."""
    root = scratch_dir(spark, "long-files")
    sources = table(spark, sf_dir, "documents").select("doc_id", "source")
    rows = wrapped_documents(spark, sf_dir).join(sources, "doc_id").repartition("source").sortWithinPartitions("source", "doc_id")
    rows.select("source", "text").write.partitionBy("source").text(root)
    found = chunk_findings(load_chunks(spark, root, chunk_bytes=1 << 16))
    source = F.regexp_extract("path", "/source=([^/]*)/", 1)
    return found.select(
        source.alias("source"), F.col("line").cast("int").alias("line"), F.col("column").alias("col"), "ordinal", "category",
        F.md5("value").alias("value_md5"),
    )


@query(masked_sql(WRAPPED_DOCUMENTS, "'[REDACTED_'||ordinal||']'") + "SELECT doc_id, md5(masked_text) AS masked_md5, n_findings FROM masked")
def long_text_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of more than a thousand characters in chunks, masked with numbers that go through the whole text."""
    done = protect_chunks(split_long(wrapped_documents(spark, sf_dir), chunk_chars=1000), mode="number", id_cols=["doc_id"])
    whole = joined(done, "masked_text", ["doc_id"])
    counts = done.groupBy("doc_id").agg(F.sum("n_findings").cast("int").alias("n_findings"))
    return whole.join(counts, "doc_id").select("doc_id", F.md5("text").alias("masked_md5"), "n_findings")


# Path below a root, and whether it is scanned.
_PATHS = (
    ("src/a.ts", True),
    ("src/B.PY", True),
    ("conf/.env", True),
    ("conf/prod.env", True),
    ("conf/.envrc", False),
    ("lib/node_modules/x.js", False),
    ("building/x.md", True),
    ("build/x.md", False),
    ("img/logo.png", False),
    ("Makefile", False),
    ("out", False),
)


@query(
    "SELECT p_partkey, CASE p_partkey % 11 "
    + " ".join(f"WHEN {i} THEN {str(ok).upper()}" for i, (_, ok) in enumerate(_PATHS))
    + " END AS scanned FROM part"
)
def scannable_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = F.array(*[F.lit(p) for p, _ in _PATHS])
    chosen = F.get(paths, (F.col("p_partkey") % len(_PATHS)).cast("int"))
    listed = table(spark, sf_dir, "part").select("p_partkey", chosen.alias("path"))
    return listed.select("p_partkey", is_scannable(F.col("path")).alias("scanned"))


@query("SELECT source, doc_id, text FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 20")
def file_cap_per_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    kept = cap_per_root(docs.select("source", "doc_id"), 20, "source", ["doc_id"])
    return docs.join(kept.select("doc_id"), "doc_id", "left_semi")


@query("SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 50")
def file_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap(documents(spark, sf_dir), 50, ["doc_id"])


# Configuration files by turn; {k} is the customer's key.  Names, patterns and categories expected of each.
_CONFIGS: tuple[tuple[str, tuple[tuple[str, str, str], ...]], ...] = (
    (
        'rules:\n  - name: "pass-{k}"\n    pattern: "pk[a-z]{{24}}"\n    category: "custom"\n',
        (("pass-{k}", "pk[a-z]{{24}}", "custom"),),
    ),
    ('rules:\n  - name: "broken"\n    category: "custom"\n', ()),
    ("rules:\n  - pattern: a{k}[0-9]+\n", (("custom-pattern", "a{k}[0-9]+", "custom"),)),
    (
        "# head\n\n\t rules:\n  - name: c{k}\n  # inner\n    pattern: abc[0-9]+ # kept\n\n",
        (("c{k}", "abc[0-9]+ # kept", "custom"),),
    ),
    ("rules: []\n", ()),
    (
        "name: early\ncustomPatterns:\r\n- name: one\r\n  pattern: 'o_{k}'\r\n-\r\n  name: two\r\n  pattern: https?://x:[0-9]+\r\n"
        "  category: api_key\r\n",
        (("one", "o_{k}", "custom"), ("two", "https?://x:[0-9]+", "api_key")),
    ),
    (
        "rules:\n- name: first\n  name: last{k}\n  severity: high\n  pattern: p\nrules:\n  category: x\n",
        (("last{k}", "p", "x"),),
    ),
    ("%% no: rules }} here [[", ()),
)


def _pieces(template: str) -> list[str]:
    """The template around the places of the key, with doubled braces undone."""
    return [p.replace("{{", "{").replace("}}", "}") for p in template.split("{k}")]


def _fill(template: str, key: Column) -> Column:
    first, *rest = _pieces(template)
    return F.concat(F.lit(first), *[c for piece in rest for c in (key.cast("string"), F.lit(piece))])


def _fill_sql(template: str) -> str:
    return "||c_custkey||".join(quote(piece) for piece in _pieces(template))


def _config_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer a .yaml file, and for two in three also the preferred .yml file."""
    key = F.col("c_custkey")
    turn = F.pmod(key, F.lit(len(_CONFIGS)))
    text = _fill(_CONFIGS[-1][0], key)
    for i, (template, _) in reversed(list(enumerate(_CONFIGS[:-1]))):
        text = F.when(turn == i, _fill(template, key)).otherwise(text)
    root = F.concat(F.lit("/trees/"), key.cast("string"))
    customers = table(spark, sf_dir, "customer")
    plain = _fill("rules:\n- name: fallback\n  pattern: f{k}\n", key)
    yml = customers.where(key % 3 != 0).select(
        root.alias("root"), F.concat(root, F.lit("/" + CONFIG_NAMES[0])).alias("path"), text.alias("text")
    )
    yaml = customers.select(
        root.alias("root"), F.concat(root, F.lit("/" + CONFIG_NAMES[1])).alias("path"), plain.alias("text")
    )
    return yml.unionByName(yaml)


def _expected_rules() -> str:
    branches = [
        "SELECT '/trees/' || c_custkey AS root, 1::BIGINT AS item, 'fallback' AS name, 'f' || c_custkey AS pattern, "
        "'custom' AS category FROM customer WHERE c_custkey % 3 = 0"
    ]
    for i, (_, rules) in enumerate(_CONFIGS):
        for item, rule in enumerate(rules, 1):
            name, pattern, category = (_fill_sql(part) for part in rule)
            branches.append(
                f"SELECT '/trees/' || c_custkey, {item}, {name}, {pattern}, {category} FROM customer "
                f"WHERE c_custkey % 3 <> 0 AND c_custkey % {len(_CONFIGS)} = {i}"
            )
    return " UNION ALL ".join(branches)


@query(_expected_rules())
def rule_config_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse_rules(first_candidate(_config_files(spark, sf_dir)))
    return parsed.select("root", "item", "name", "pattern", "category")


@query(
    """SELECT n_name AS name, CASE WHEN n_nationkey % 5 = 0 THEN '[unclosed' ELSE n_name || '_[0-9]+' END AS pattern,
  n_nationkey % 5 <> 0 AS usable FROM nation"""
)
def rule_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that do not compile are set apart before any plan is built."""
    key = F.col("n_nationkey")
    pattern = F.when(key % 5 == 0, F.lit("[unclosed")).otherwise(F.concat(F.col("n_name"), F.lit("_[0-9]+")))
    rules = table(spark, sf_dir, "nation").select(
        key.alias("item"), F.col("n_name").alias("name"), pattern.alias("pattern"), F.lit("custom").alias("category")
    )
    good, rejected = usable_rules(rules)
    kept = spark.createDataFrame([(r.name, r.pattern) for r in good], "name string, pattern string")
    return kept.withColumn("usable", F.lit(True)).unionByName(
        rejected.select("name", "pattern", F.lit(False).alias("usable"))
    )


@query(
    """SELECT 'text' AS outcome, (SELECT count(DISTINCT source) FROM documents) AS n_files,
  (SELECT sum(len(string_split(text, chr(10))))::BIGINT FROM documents) AS n_lines
UNION ALL SELECT 'missing', count(*), 0 FROM customer"""
)
def files_read_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each source, and as many that are not there as there are customers, in one read."""
    root = scratch_dir(spark, "files")
    rows = table(spark, sf_dir, "documents").select("source", "text").repartition("source")
    rows.write.partitionBy("source").text(root)
    there = list_corpus(spark, root).where("scanned").select("path")
    gone = table(spark, sf_dir, "customer").select(F.concat(F.lit(f"{root}/gone/"), "c_custkey", F.lit(".txt")).alias("path"))
    outcome = read_outcomes(there.unionByName(gone))
    lines = F.coalesce(count_newlines(F.col("text")), F.lit(0))
    return outcome.groupBy(F.coalesce("reason", F.lit("text")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("n_files"), F.sum(lines).cast("long").alias("n_lines")
    )


# Patterns in JavaScript's spelling, and the text that each matches in, with {k} for the order's key.
_RESPELT = (
    ("braces", "cfg{[0-9]+}", "cfg{{{k}}}"),
    ("anything", "key[^]val[0-9]+", "key:val{k}"),
    ("bracket", "slot[[(][0-9]+", "slot[{k}"),
    ("group", r"(?<the_id>tenant)=\k<the_id>[0-9]+", "tenant=tenant{k}"),
)


def _filled(text: str, sql: bool = False):
    before, after = text.format(k="\0").split("\0")
    return f"'{before}' || o_orderkey || '{after}'" if sql else (before, after)


@query(
    "SELECT o_orderkey AS doc_id, CASE o_orderkey % 4 "
    + " ".join(f"WHEN {i} THEN '{name}'" for i, (name, _, _) in enumerate(_RESPELT))
    + " END AS rule_id, CASE o_orderkey % 4 "
    + " ".join(f"WHEN {i} THEN {_filled(text, sql=True)}" for i, (_, _, text) in enumerate(_RESPELT))
    + " END AS value FROM orders"
)
def respelt_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Custom rules that are valid in JavaScript's spelling only."""
    rows = [(i, name, pattern, "custom") for i, (name, pattern, _) in enumerate(_RESPELT)]
    good, _ = usable_rules(spark.createDataFrame(rows, "item int, name string, pattern string, category string"))

    def text(key: Column) -> Column:
        parts = [_filled(text) for _, _, text in _RESPELT]
        spelt = [F.concat(F.lit(f"see {before}"), key.cast("string"), F.lit(f"{after} here")) for before, after in parts]
        return F.get(F.array(*spelt), F.pmod(key, F.lit(4)).cast("int"))

    return findings(orders_text(spark, sf_dir, text), custom=good).select("doc_id", "rule_id", "value")
