"""The operators as queries over whole tables, and the SQL that checks those that SQL can express."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir, stored
from . import (
    bpe,
    conversations,
    decontaminate,
    fingerprint,
    langid,
    licenses,
    line_dedup,
    masked_lm,
    near_dedup,
    phrases,
    secrets,
    token_files,
    url_lists,
)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# Where the public tokenizers are described; a parameter of the operators.
TOKENIZERS = "/opt/tokenizers"


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    """The path of the word vocabulary, from the package that describes the public tokenizers."""
    try:
        import public_tokenizers
    except ModuleNotFoundError:
        sys.path.append(TOKENIZERS)
        return f"{TOKENIZERS}/word_bpe_49k.json"
    return str(public_tokenizers.path("word_bpe_49k.json"))


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


@query()
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.tokenize(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary())
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        sha256(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"),
        sha256(F.col("decoded")).alias("decoded_sha256"),
    )


def documents_with_pages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with what the page that they come from declares, and its address.

    The last number of a page's path is the document's id.  Documents without a page have their source as host.
    """
    pages = table(spark, sf_dir, "pages")
    page = pages.select(
        F.regexp_extract("url", r"^[^?#]*/([0-9]{1,18})(?:\.[a-z]+)?/?(?:[?#]|$)", 1).try_cast("long").alias("__page_doc"),
        langid.declared_of(F.col("html")).alias("declared"),
        langid.host_of(F.col("url")).alias("host"),
        F.col("page_id").alias("__page"),
    )
    first = page.where("__page_doc is not null").groupBy("__page_doc").agg(F.min(F.struct("__page", "declared", "host")).alias("p"))
    met = docs.join(first, F.col("doc_id") == F.col("__page_doc"), "left")
    host = F.coalesce("p.host", "source")
    return met.select(
        "doc_id",
        "text",
        F.col("p.declared").alias("declared"),
        langid.suffix_of(F.col("p.host")).alias("suffix"),
        host.alias("host"),
        langid.domain_of(F.col("p.host")).alias("domain"),
    )


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str, *more: Column) -> DataFrame:
    model = langid.fit_text_model(docs)
    return langid.identify(documents_with_pages(spark, docs, sf_dir), model)


@query()
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = languages(spark, table(spark, sf_dir, "documents"), sf_dir)
    return found.select(
        "doc_id",
        "language",
        F.round("probability", 6).alias("probability"),
        "text_language",
        (~F.col("rejected")).alias("kept"),
    )


@query()
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    items = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return found.select(
        F.col("__id").alias("doc_id"),
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        sha256(items).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


@query()
def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dedup.near_duplicates(docs, shingle_words=2, percent=80)


@query()
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = line_dedup.dedup_lines(docs, removed_col="n_removed")
    return found.select(
        "doc_id",
        F.col("n_removed").cast("long").alias("n_removed"),
        sha256(F.coalesce("text", F.lit(""))).alias("text_sha256"),
        ((F.col("n_removed") == 0) | (F.trim("text") != "")).alias("kept"),
    )


@query()
def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Each text's own fingerprint is made once, before it goes to its neighbour with the text.
    docs = docs.withColumn("mark", fingerprint.fingerprint(F.col("text")))
    rows = fingerprint.with_next(docs, "doc_id", ["text", "mark"], parts, tie=["text"])
    edited = fingerprint.edited_text(F.col("text"), F.col("next_text"))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), "mark", "next_mark", F.explode_outer(F.array(edited)).alias("edited"))
    rows = rows.select(
        "doc_id",
        "n_chars",
        sha256(F.col("edited")).alias("edited_sha256"),
        "mark",
        "next_mark",
        F.explode_outer(F.array(fingerprint.fingerprint(F.col("edited")))).alias("edited_mark"),
    )
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.col("mark").alias("fingerprint"),
        F.col("edited_mark").alias("edited_fingerprint"),
        fingerprint.likeness(F.col("mark"), F.col("edited_mark")).alias("near_edited"),
        fingerprint.likeness(F.col("mark"), F.col("next_mark")).alias("near_next"),
    )


# The lists of the URL query follow from the addresses themselves: each host, domain and folder may have entries in
# two lists, by the digits of a hash, added on one day and some of them taken away and added again later.
_DAY0 = "2024-01-01 00:00:00"


def _digits(text: Column, at: int, n: int) -> Column:
    return F.conv(F.substring(F.md5(text), at, n), 16, 10).cast("int")


def captures_of(pages: DataFrame) -> DataFrame:
    """Pages with a time of fetching within a year, to the minute."""
    minutes = _digits(F.concat(F.lit("fetched"), F.col("page_id").cast("string")), 1, 6) % (366 * 1440)
    at = F.timestamp_seconds(F.unix_seconds(F.lit(_DAY0).cast("timestamp")) + minutes * 60)
    return pages.select("page_id", "url", at.alias("fetched_at"))


def list_changes(pages: DataFrame) -> DataFrame:
    """Dated changes of two lists over the keys that occur in the addresses."""
    keys = pages.select(F.explode(url_lists.address_keys(F.col("url"))).alias("k")).select(F.col("k.key").alias("key")).distinct()
    lists = keys.select("key", F.explode(F.array(F.lit("abuse"), F.lit("curated"))).alias("list"))
    named = F.concat("list", F.lit(":"), "key")
    listed = lists.where(_digits(named, 1, 2) < 96).select(
        "list",
        "key",
        F.when(_digits(named, 3, 1) < 10, "block").otherwise("allow").alias("action"),
        F.explode(F.sequence(F.lit(0), _digits(named, 4, 1) % 4)).alias("step"),
        named.alias("named"),
    )
    # Changes in turn add the entry and take it away.
    day = (_digits(F.col("named"), 6, 2) + F.col("step") * (20 + _digits(F.col("named"), 8, 2) % 60)) % 400
    at = F.timestamp_seconds(F.unix_seconds(F.lit(_DAY0).cast("timestamp")) + (day - 20) * 86400)
    return listed.select("list", "key", "action", at.alias("at"), (F.col("step") % 2 == 0).alias("added"))


@query(
    """
    WITH p AS (
      SELECT page_id, url,
        lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1)) AS host,
        regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS path,
        TIMESTAMP '2024-01-01 00:00:00'
          + to_minutes(CAST(('0x' || substr(md5('fetched' || CAST(page_id AS VARCHAR)), 1, 6)) AS INTEGER) % 527040) AS fetched_at
      FROM pages
    ), h AS (
      SELECT *, string_split(host, '.') AS labels, string_split(path, '/') AS parts FROM p WHERE host <> ''
    ), k AS (
      SELECT page_id, fetched_at, i AS depth, array_to_string(labels[len(labels) - i + 1 : len(labels)], '.') AS key
      FROM h, unnest(range(1, len(labels) + 1)) AS t(i)
      UNION ALL
      SELECT page_id, fetched_at, len(labels) + i AS depth, host || array_to_string(parts[1:i], '/') AS key
      FROM h, unnest(range(2, len(parts) + 1)) AS t(i)
    ), l AS (
      SELECT list, key, list || ':' || key AS named FROM (SELECT DISTINCT key FROM k), (VALUES ('abuse'), ('curated')) AS v(list)
    ), d AS (
      SELECT *, CAST('0x' || substr(md5(named), 3, 1) AS INTEGER) AS d3, CAST('0x' || substr(md5(named), 4, 1) AS INTEGER) AS d4,
        CAST('0x' || substr(md5(named), 6, 2) AS INTEGER) AS d6, CAST('0x' || substr(md5(named), 8, 2) AS INTEGER) AS d8
      FROM l WHERE CAST('0x' || substr(md5(named), 1, 2) AS INTEGER) < 96
    ), c AS (
      SELECT list, key, CASE WHEN d3 < 10 THEN 'block' ELSE 'allow' END AS action,
        TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST((d6 + s * (20 + d8 % 60)) % 400 - 20 AS INTEGER)) AS moment, s % 2 = 0 AS added
      FROM d, unnest(range(0, d4 % 4 + 1)) AS t(s)
    ), o AS (
      SELECT list, key, action, moment, bool_and(added) AS added FROM c GROUP BY ALL
    ), i AS (
      SELECT *, lead(moment) OVER (PARTITION BY list, key, action ORDER BY moment) AS until FROM o
    ), m AS (
      SELECT page_id, depth, list, key, action, row_number() OVER (
        PARTITION BY page_id ORDER BY depth DESC, CASE WHEN action = 'block' THEN 0 ELSE 1 END, list, key) AS r
      FROM k JOIN i USING (key) WHERE i.added AND k.fetched_at >= i.moment AND (i.until IS NULL OR k.fetched_at < i.until)
    )
    SELECT pages.page_id, m.action, m.key AS entry, m.list, coalesce(m.action, 'allow') <> 'block' AS kept
    FROM pages LEFT JOIN m ON m.page_id = pages.page_id AND m.r = 1
    """
)
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    found = url_lists.evaluate(captures_of(pages), list_changes(pages), "url", "fetched_at")
    return found.select(
        "page_id", "action", "entry", "list", (F.coalesce("action", F.lit("allow")) != "block").alias("kept")
    )


@query()
def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counts = masked_lm.word_counts(docs)
    return masked_lm.score(docs, masked_lm.train(docs, counts=counts), counts=counts)


def files_of(docs: DataFrame) -> DataFrame:
    """Documents as files: a folder for every source, language and 64 numbers in a row.  A text of fewer than 80
    characters stands for the licence file of its folder."""
    number = F.col("doc_id").cast("string")
    name = F.when(F.length("text") < 80, F.concat(F.lit("LICENSE."), number)).otherwise(F.concat(number, F.lit(".txt")))
    folder = F.floor(F.col("doc_id") / 64).cast("string")
    return docs.select("doc_id", F.concat_ws("/", "source", "lang", folder, name).alias("path"), "text")


@query()
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = files_of(table(spark, sf_dir, "documents"))
    found = licenses.scan(files.select("path", "text"), licenses.templates(spark))
    return found.select(
        F.regexp_extract("path", r"([0-9]+)(?:\.txt)?$", 1).cast("long").alias("doc_id"),
        "path",
        "license",
        F.round("cosine", 6).alias("cosine"),
        "origin",
    )


def labelled_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with known answers: texts around the numbers of orders, half of them with a secret.

    Secrets are passwords, tokens and access keys; the others are revisions, checksums, order and card numbers and
    names with numbers, of the same alphabets and lengths.
    """
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").distinct()
    digest = F.md5(F.concat(F.lit("finding"), F.col("o_orderkey").cast("string")))
    long_hex = F.substring(F.concat(digest, F.md5(digest)), 1, 40)
    upper = F.upper(F.substring(F.translate(F.base64(F.md5(digest).cast("binary")), "+/=", "AZQ"), 1, 16))
    number = F.substring(F.translate(long_hex, "abcdef", "012345"), 1, 16)
    customer = F.concat(F.lit("Customer"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))
    texts = [
        (1, F.concat(F.lit("the password="), F.substring(long_hex, 1, 18), F.lit(" is for"))),
        (1, F.concat(F.lit("and token = \""), long_hex, F.lit("\" here"))),
        (1, F.concat(F.lit("of AKIA"), upper, F.lit(" to"))),
        (1, F.concat(F.lit("secret: "), F.substring(long_hex, 3, 24), F.lit(" must"))),
        (0, F.concat(F.lit("in commit "), long_hex, F.lit(" of"))),
        (0, F.concat(F.lit("with checksum="), F.substring(long_hex, 1, 32), F.lit(" for"))),
        (0, F.concat(F.lit("paid with "), number, F.lit(" and"))),
        (0, F.concat(F.lit("by "), customer, F.lit(" in"))),
    ]
    kind = _digits(F.concat(F.lit("kind"), F.col("o_orderkey").cast("string")), 1, 1) % len(texts)
    text = F.coalesce(*[F.when(kind == i, t) for i, (_, t) in enumerate(texts)])
    label = F.get(F.array(*[F.lit(l) for l, _ in texts]), kind)
    rows = orders.select("o_orderkey", text.alias("text"), label.alias("is_secret"))
    found = secrets.candidates(rows, "o_orderkey", "text")
    return found.join(rows.select(F.col("o_orderkey").alias("id"), "is_secret"), "id")


@query()
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.concat_ws("/", "source", "lang").alias("path"))
    corpus = secrets.corpus_of(docs)
    forest = secrets.train(labelled_findings(spark, sf_dir), corpus)
    found = secrets.classify(stored(secrets.candidates(docs, path_col="path"), "candidates"), corpus, forest)
    return found.select(
        F.col("id").alias("doc_id"),
        "nth",
        sha256(F.col("value")).alias("value_sha256"),
        F.length("value").alias("length"),
        "before",
        F.round("probability", 6).alias("probability"),
        "is_secret",
    )


@query()
def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = scratch_dir(spark, "token-files")
    token_files.write(docs, path, vocabulary())
    found = token_files.read(docs.select("doc_id"), path)
    return found.select(
        F.nullif("key", F.lit(token_files.NO_ID)).alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"), "row"
    )


def damaged(turns: DataFrame) -> DataFrame:
    """Turns as a careless export leaves them, by a hash of their numbers; missing values are one blank."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    rows = turns.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), (F.crc32(key) % 20).alias("harm"))
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("harm") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("harm") == 0, 0).when(F.col("harm") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(1), times))).drop("col")


@query(
    r"""
    WITH RECURSIVE t AS (
      SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS named FROM conversations
    ), hashed AS (
      SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(named, ''), lambda c: CAST(ascii(c) AS BIGINT))),
        lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS harm
      FROM t
    ), d AS (
      SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
        CASE harm WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
      FROM hashed, unnest(range(0, CASE harm WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS r(i)
    ), o AS (
      SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(md5(role) || text)) AS i,
        NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS is_blank,
        regexp_matches(text, '[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*\z') AS is_cut FROM d
    ), f AS (
      SELECT *, substr(role, 1, 1) AS initial, NOT is_blank AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS is_again FROM o
    ), g AS (
      SELECT *, NOT is_blank AND NOT is_again AND is_cut AS is_truncated,
        lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au') AS is_illegal FROM f
    ), counts AS (
      SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (is_blank) AS blank,
        count(*) FILTER (is_again) AS duplicate, count(*) FILTER (is_truncated) AS truncated,
        count(*) FILTER (coalesce(is_illegal, false)) AS illegal, count(*) AS n FROM g GROUP BY conv_id
    ), steps AS (
      -- After each turn, for every state of the pattern, least cost, first audit and repaired text.
      SELECT conv_id, CAST(0 AS BIGINT) AS i,
        CAST({c: 0, a: '', r: []} AS STRUCT(c BIGINT, a VARCHAR, r VARCHAR[])) AS q0,
        CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, r VARCHAR[])) AS q1,
        CAST({c: 5, a: 'I', r: ['user:']} AS STRUCT(c BIGINT, a VARCHAR, r VARCHAR[])) AS q2,
        CAST({c: 10, a: 'II', r: ['user:', 'assistant:']} AS STRUCT(c BIGINT, a VARCHAR, r VARCHAR[])) AS q3
      FROM counts
      UNION ALL
      SELECT conv_id, i, w0, w1, v2, least(w3, CASE WHEN v2 IS NOT NULL THEN {c: v2.c + 5, a: v2.a || 'I', r: list_append(v2.r, 'assistant:')} END)
      FROM (
        SELECT *, least(w2, CASE WHEN w0 IS NOT NULL THEN {c: w0.c + 5, a: w0.a || 'I', r: list_append(w0.r, 'user:')} END,
          CASE WHEN w1 IS NOT NULL THEN {c: w1.c + 5, a: w1.a || 'I', r: list_append(w1.r, 'user:')} END,
          CASE WHEN w3 IS NOT NULL THEN {c: w3.c + 5, a: w3.a || 'I', r: list_append(w3.r, 'user:')} END) AS v2
        FROM (
          SELECT s.conv_id, g.i,
            {c: q0.c + 2, a: q0.a || 'D', r: q0.r} AS w0,
            least(CASE WHEN q1 IS NOT NULL THEN {c: q1.c + 2, a: q1.a || 'D', r: q1.r} END,
              CASE WHEN keeps AND initial = 's' THEN {c: q0.c + more, a: q0.a || 'K', r: list_append(q0.r, role || ':' || text)} END) AS w1,
            least(CASE WHEN q2 IS NOT NULL THEN {c: q2.c + 2, a: q2.a || 'D', r: q2.r} END,
              CASE WHEN keeps AND initial = 'u' THEN {c: q0.c + more, a: q0.a || 'K', r: list_append(q0.r, role || ':' || text)} END,
              CASE WHEN keeps AND initial = 'u' AND q1 IS NOT NULL THEN {c: q1.c + more, a: q1.a || 'K', r: list_append(q1.r, role || ':' || text)} END,
              CASE WHEN keeps AND initial = 'u' AND q3 IS NOT NULL THEN {c: q3.c + more, a: q3.a || 'K', r: list_append(q3.r, role || ':' || text)} END,
              CASE WHEN keeps THEN {c: q0.c + more + 1, a: q0.a || 'R', r: list_append(q0.r, 'user:' || text)} END,
              CASE WHEN keeps AND q1 IS NOT NULL THEN {c: q1.c + more + 1, a: q1.a || 'R', r: list_append(q1.r, 'user:' || text)} END,
              CASE WHEN keeps AND q3 IS NOT NULL THEN {c: q3.c + more + 1, a: q3.a || 'R', r: list_append(q3.r, 'user:' || text)} END) AS w2,
            least(CASE WHEN q3 IS NOT NULL THEN {c: q3.c + 2, a: q3.a || 'D', r: q3.r} END,
              CASE WHEN keeps AND initial = 'a' AND q2 IS NOT NULL THEN {c: q2.c + more, a: q2.a || 'K', r: list_append(q2.r, role || ':' || text)} END,
              CASE WHEN keeps AND q2 IS NOT NULL THEN {c: q2.c + more + 1, a: q2.a || 'R', r: list_append(q2.r, 'assistant:' || text)} END) AS w3
          FROM steps s JOIN (SELECT *, NOT is_blank AND NOT is_again AS keeps, CASE WHEN is_truncated THEN 5 ELSE 0 END AS more FROM g) g
            ON g.conv_id IS NOT DISTINCT FROM s.conv_id AND g.i = s.i + 1
        )
      )
    ), ends AS (
      SELECT c.*, least(q0, q3) AS e FROM steps s JOIN counts c ON c.conv_id IS NOT DISTINCT FROM s.conv_id AND c.n = s.i
    )
    SELECT k.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
      coalesce(illegal, 0) AS illegal, coalesce(e.c, 0) AS cost, coalesce(e.a, '') AS audit, sha256(coalesce(array_to_string(e.r, chr(10)), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM k.conv_id
    """
)
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    done = conversations.repair(damaged(turns), with_turns=False).drop("repaired")
    every = turns.select("conv_id").distinct()
    met = every.alias("k").join(done.alias("d"), F.col("k.conv_id").eqNullSafe(F.col("d.conv_id")), "left")
    counts = [F.coalesce(f"d.{c}", F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return met.select(
        "k.conv_id", *counts, F.coalesce("d.audit", F.lit("")).alias("audit"), F.coalesce("d.repaired_sha256", nothing).alias("repaired_sha256")
    )


@query(
    r"""
    WITH pieces AS (
      SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
    ), w AS (
      SELECT lang, row_number() OVER () AS p, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS words FROM pieces
    ), t AS (
      SELECT lang, p, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM w
    ), ahead AS (
      SELECT lang, w AS w1, lead(w, 1) OVER v AS w2, lead(w, 2) OVER v AS w3, lead(w, 3) OVER v AS w4 FROM t WINDOW v AS (PARTITION BY p ORDER BY i)
    ), f AS (
      SELECT lang, [w1] AS words, w1 AS phrase, 1 AS size, count(*) AS c FROM ahead GROUP BY ALL
      UNION ALL SELECT lang, [w1, w2], concat_ws(' ', w1, w2), 2, count(*) FROM ahead WHERE w2 IS NOT NULL GROUP BY ALL
      UNION ALL SELECT lang, [w1, w2, w3], concat_ws(' ', w1, w2, w3), 3, count(*) FROM ahead WHERE w3 IS NOT NULL GROUP BY ALL
      UNION ALL SELECT lang, [w1, w2, w3, w4], concat_ws(' ', w1, w2, w3, w4), 4, count(*) FROM ahead WHERE w4 IS NOT NULL GROUP BY ALL
    ), n AS (
      SELECT lang, CAST(sum(c) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang
    ), keyed AS (
      SELECT lang || chr(9) || phrase AS key, c FROM f
    ), candidates AS (
      SELECT * FROM f WHERE size > 1 AND c >= 30
    ), cuts AS (
      SELECT *, array_to_string(words[1 : k], ' ') AS head, array_to_string(words[k + 1 : size], ' ') AS tail
      FROM candidates, unnest(range(1, size)) AS t(k)
    ), scores AS (
      SELECT u.lang, u.phrase, u.size, u.c AS a, p.c AS l, q.c AS r, k, CAST(2000000::HUGEINT * u.c // (p.c + q.c) AS BIGINT) AS score
      FROM cuts u JOIN keyed p ON p.key = u.lang || chr(9) || head JOIN keyed q ON q.key = u.lang || chr(9) || tail
    ), lowest AS (
      SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
    ), inside AS (
      SELECT lang, array_to_string(words[i : i + part - 1], ' ') AS phrase, max(c) AS most
      FROM candidates, unnest([1, 2, 3]) AS s(i), unnest([2, 3]) AS t(part) WHERE part < size AND i + part - 1 <= size GROUP BY ALL
    ), ranked AS (
      SELECT o.*, row_number() OVER (PARTITION BY o.lang ORDER BY score DESC, a DESC, o.phrase) AS rank
      FROM lowest o LEFT JOIN inside USING (lang, phrase) WHERE coalesce(100 * most < 80 * a, true)
    )
    SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
    """
)
def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents").select("lang", "text"))
