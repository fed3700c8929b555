"""The ten operators against brute force, round trips and held-out labels, and on odd rows."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cloakwork.llm import (
    bpe,
    common,
    decontaminate,
    fingerprint,
    langid,
    licenses,
    line_dedup,
    masked_lm,
    near_dedup,
    queries,
    secrets,
    url_lists,
)

DOCS = "doc_id long, text string, key string, at int, id string, words string, hits int"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def documents(small):
    return pq.read_table(f"{small}/documents.parquet").to_pylist()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank and long texts, a repeated row, one id with two texts, and columns whose names the
    operators use themselves."""
    long = " ".join(f"word{i % 977} of{i % 31}" for i in range(20_000))
    rows = [
        (1, None), (2, ""), (3, "  \n\n "), (None, "a text without a number, long enough to be one of its own"),
        (4, long), (5, "same row twice over in this very table"), (5, "same row twice over in this very table"),
        (6, "one id has"), (6, "two other texts here"), (7, "x"), (8, "\u0000 ÀÉ 漢字 🙂 \r\n İ"), (None, None),
    ]
    return spark.createDataFrame([(i, t, "k", 0, "i", "w", 1) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# 1. BPE


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary())


def test_bpe_as_the_library(library, documents):
    draw = random.Random(3)
    texts = [d["text"] for d in documents] + [
        "", "   ", "It's we'll I'M 'S 're x", "<|startoftext|>hello<|endoftext|> World <|endoftext|",
        "ΑΣ ΣΑΣ İstanbul ǅ ﬁ ẞ", "a" * 500 + " " + "ab" * 300 + " " + "!" * 400, "한국어 🙂👩‍👩‍👧 ½ Ⅷ ①", "\x00\x1f​ tab\tnew\r\n",
    ]
    texts += ["".join(draw.choice("abcdefgilmnorstéü' 1!.<|>-") for _ in range(draw.randint(0, 60))) for _ in range(500)]
    texts += ["".join(chr(draw.choice([draw.randint(0, 0x2FF), draw.randint(0x370, 0xD7FF), draw.randint(0xE000, 0x1FFFF)])) for _ in range(20)) for _ in range(500)]
    codec = bpe.Codec(queries.vocabulary())
    offsets, ids = codec.encode(texts)
    for i, want in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == want.ids, texts[i]


def test_bpe_query(spark, small, library, documents):
    got = {r.doc_id: r for r in queries.op1_bpe(spark, small).collect()}
    for d in documents:
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert got[d["doc_id"]][1:4] == (len(ids), sha(" ".join(map(str, ids))), sha(text))


def test_bpe_odd(odd, empty, library):
    rows = bpe.tokenize(odd, queries.vocabulary()).collect()
    assert len(rows) == 12 and rows[0].key == "k"
    for r in rows:
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == want and r.decoded == library.decode(want, skip_special_tokens=False)
    assert bpe.tokenize(empty, queries.vocabulary()).count() == 0


# 2. Language ID


def test_language_accuracy(spark, small):
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents")
    held = F.pmod(F.xxhash64("text"), F.lit(2)) == 0
    model = langid.fit_text_model(docs.where(~held))
    rows = queries.documents_with_pages(spark, docs.where(held), "/root/testdata/sf0.01")
    found = langid.identify(rows, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.language == r.lang for r in found) >= 0.98 * len(found)
    assert not any(r.rejected for r in found)


def test_language_odd(spark, odd, empty):
    docs = queries.table(spark, "/root/testdata/sf0.001", "documents")
    model = langid.fit_text_model(docs)
    rows = odd.select("doc_id", "text", *[F.lit(None).cast("string").alias(c) for c in ("declared", "suffix", "host", "domain")])
    found = langid.identify(rows, model).collect()
    assert len(found) == 12 and all(r.language is None for r in found if r.n_trigrams == 0)
    assert langid.identify(rows.limit(0), model).count() == 0
    nothing = langid.fit_text_model(empty.withColumn("lang", F.lit("en")))
    assert {r.language for r in langid.identify(rows, nothing).collect()} == {None}
    noise = spark.createDataFrame([(1, "xqzjwk vvkqx zzqxj wqkxv jjxqz kvqzx " * 20, "en", "", "h", "")], "doc_id long, text string, declared string, suffix string, host string, domain string")
    assert langid.identify(noise, model).first().rejected


def test_host_prior_decides_a_text_that_says_little(spark):
    docs = queries.table(spark, "/root/testdata/sf0.001", "documents")
    model = langid.fit_text_model(docs)
    german = docs.where("lang = 'de'").select("doc_id", "text").limit(12)
    rows = german.unionByName(spark.createDataFrame([(-1, "zu")], "doc_id long, text string"))
    given = rows.select("*", F.lit("").alias("declared"), F.lit("net").alias("suffix"), F.lit("a.b.net").alias("host"), F.lit("b.net").alias("domain"))
    assert langid.identify(given, model).where("doc_id = -1").first().language == "de"


# 3. Masked language model


def test_masked_scores_by_plain_loops(spark, small, odd):
    docs = queries.table(spark, small, "documents")
    network = masked_lm.train(docs)
    t, text = network.tables, "the of one strange thhaehe word"
    ids = network.ids(text)
    import numpy as np

    total = 0.0
    for i, w in enumerate(ids):
        near = [ids[k] if 0 <= k < len(ids) else masked_lm.WORDS for k in (i - 2, i - 1, i + 1, i + 2)]
        h = np.tanh(t["bend"] + sum(t["vectors"][j][n] for j, n in enumerate(near)))
        c, m = divmod(int(w), masked_lm.CLASSES)
        one = h @ t["to_class"] + t["class_bias"]
        two = (h + t["class_vectors"][c]) @ t["to_member"] + t["member_bias"][c]
        total += one[c] - np.log(np.exp(one).sum()) + two[m] - np.log(np.exp(two).sum())
    row = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = masked_lm.score(row, network).first()
    assert got.n_words == 6 and abs(got.log_likelihood - total) < 1e-3
    found = masked_lm.score(odd, network).collect()
    assert len(found) == 12 and found[0][1:] == (0, 0.0, None)
    # Shuffled words are less likely than the text.
    some = docs.where("length(text) > 2000").limit(20).select("doc_id", "text")
    mixed = some.withColumn("text", F.array_join(F.shuffle(F.split("text", r"\s+"), 5), " "))
    mean = lambda x: masked_lm.score(x, network).agg(F.sum("log_likelihood")).first()[0]
    assert mean(some) > mean(mixed)


def test_masked_steps_by_plain_loops():
    """The steps of a batch against their plain forms, to the last bit."""
    import numpy as np

    draw = np.random.default_rng(1)
    x = draw.normal(0, 9, (300, masked_lm.CLASSES)).astype(np.float32)
    x[0], x[1, 3] = 0, 80
    plain = x - x.max(axis=1, keepdims=True)
    plain = plain - np.log(np.exp(plain).sum(axis=1, keepdims=True))
    at = draw.integers(0, masked_lm.CLASSES, 300)
    assert (masked_lm._log_chosen(x.copy(), at) == plain[np.arange(300), at]).all()
    assert (masked_lm._log_softmax(x.copy()) == plain).all()
    near = draw.integers(0, masked_lm.WORDS + 1, (2 * masked_lm.SIDE, 300))
    rows = draw.normal(0, 1, (300, masked_lm.VECTOR)).astype(np.float32)
    sums = np.zeros((2 * masked_lm.SIDE, masked_lm.WORDS + 1, masked_lm.VECTOR))
    for j, places in enumerate(near):
        np.add.at(sums[j], places, rows.astype(np.float64))
    assert (masked_lm._scatter(near, rows) == sums.astype(np.float32)).all()


def test_masked_model_of_nothing(empty):
    network = masked_lm.train(empty)
    assert masked_lm.score(empty, network).count() == 0


@pytest.mark.parametrize("common", [4, masked_lm.COMMON])
def test_masked_scores_tell_words_of_one_place_apart(spark, odd, monkeypatch, common):
    """A rare word has its part of its place: by plain loops, whether its count is at hand or comes by the join."""
    monkeypatch.setattr(masked_lm, "COMMON", common)
    monkeypatch.setattr(masked_lm, "vocabulary", lambda counts: {b"the": 0, b"of": 1})
    texts = ["The amber of\tthe quartz", "amber amber quartz \u0391\u03a3 basalt", None, "", "the amber of basalt slate", "amber amber quartz \u0391\u03a3 basalt"]
    docs = spark.createDataFrame([(i // 2 if i else None, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    seen = collections.Counter(w for t in texts for w in (t or "").lower().split())
    places = collections.Counter()
    for w, n in seen.items():
        places[zlib.crc32(w.encode()) % masked_lm.RARE] += n * (w not in ("the", "of"))
    counts = masked_lm.word_counts(docs)
    assert {r.word: r.n for r in counts.collect()} == seen
    network = masked_lm.train(docs, counts=counts)

    def want(text):
        words = (text or "").lower().split()
        rare = [w for w in words if w not in ("the", "of")]
        own = sum(math.log(seen.get(w, 1) / max(places[zlib.crc32(w.encode()) % masked_lm.RARE], 1)) for w in rare)
        return float(network.log_probabilities(network.ids(text)).sum(dtype="float64")) + own

    # Also words that were not counted.
    more = docs.unionByName(spark.createDataFrame([(9, "of unheard obsidian amber")], docs.schema))
    got = masked_lm.score(more, network, counts=counts).collect()
    wanted = [(i // 2 if i else None, len((t or "").split()), want(t)) for i, t in enumerate(texts)] + [(9, 4, want("of unheard obsidian amber"))]
    order = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    for r, w in zip(sorted(got, key=order), sorted(wanted, key=order), strict=True):
        assert r[:2] == w[:2] and abs(r[2] - w[2]) < 1e-6
        assert r.perplexity is None if not w[1] else abs(r.perplexity - math.exp(-w[2] / w[1])) < 1e-4 * r.perplexity
    assert len({r.log_likelihood for r in got if r.n_words == 5 and abs(r.log_likelihood - want(texts[1])) < 1e-6}) == 1
    empty_counts = masked_lm.word_counts(docs.limit(0))
    assert masked_lm.score(odd, network, counts=empty_counts).count() == odd.count()


def test_masked_query_scores_words_and_not_places(spark, tmp_path):
    """Words beyond the vocabulary that share a place are told apart by the query too."""
    def sharing():
        first = {}
        for i in range(10_000):
            place = zlib.crc32(b"zz%d" % i) % masked_lm.RARE
            if place in first:
                return first[place], f"zz{i}"
            first[place] = f"zz{i}"

    often, once = sharing()
    usual = [f"w{i}" for i in range(masked_lm.WORDS - masked_lm.RARE)]
    rows = [(0, " ".join(usual * 20)), (1, " ".join([often] * 9)), (2, f"w1 {often} w2"), (3, f"w1 {once} w2")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.log_likelihood for r in queries.op3_lm_scoring(spark, str(tmp_path)).collect()}
    # Ten occurrences of the one, one of the other; the network has the same for both.
    assert abs(got[2] - got[3] - math.log(10)) < 1e-6


# 4. Licences


def test_licenses(spark):
    files = spark.createDataFrame(
        [
            ("a/LICENSE", "Released under the MIT License."),
            ("a/b/c/x.py", "no licence line in here"),
            ("a/b/c/y.py", "code\nLicensed under the Apache License, Version 2.0.\nmore code"),
            ("a/b/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."),
            ("a/z.py", None),
            ("q/r.py", ""),
            ("ab/r.py", "words"),
            (None, "All rights reserved."),
            ("a/z.py", None),
        ],
        "path string, text string",
    ).withColumn("license", F.lit("clash"))
    got = {r.path: (r.license, r.origin) for r in licenses.scan(files, licenses.templates(spark)).collect()}
    assert got == {
        "a/LICENSE": ("MIT", "own"),
        "a/b/c/x.py": ("GPL-3.0", "folder"),
        "a/b/c/y.py": ("Apache-2.0", "own"),
        "a/b/COPYING.txt": ("GPL-3.0", "own"),
        "a/z.py": ("MIT", "folder"),
        "q/r.py": (None, None),
        "ab/r.py": (None, None),
        None: (None, None),
    }
    assert licenses.scan(files.limit(0), licenses.templates(spark)).count() == 0


def test_license_cosine_by_hand(spark):
    import math

    texts = ["Licensed under CC BY 4.0 by me", "under the sea", "by the way", "nothing"]
    files = spark.createDataFrame([(f"{i}", t) for i, t in enumerate(texts)], "path string, text string")
    known = licenses.templates(spark, [("CC", "Licensed under CC BY 4.0"), ("X", "All rights reserved")])
    words = [t.lower().split() for t in texts]
    idf = lambda w: math.log((1 + 4) / (1 + sum(w in x for x in words))) + 1
    line, template = words[0], "licensed under cc by 4.0".split()
    tf = lambda ws: {w: ws.count(w) for w in ws}
    other = math.log((1 + 4) / 2) + 1
    weight = {w: n * (idf(w) if w in template else other) for w, n in tf(line).items()}
    mine = {w: n * idf(w) for w, n in tf(template).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    want = sum(weight[w] * mine[w] for w in mine) / norm(weight) / norm(mine)
    row = licenses.statements(files, known, least=0.5).first()
    assert row.license == "CC" and abs(row.cosine - want) < 1e-9


def test_license_words_that_no_template_has_weigh_by_their_lines(spark):
    import math

    texts = ["Licensed under CC BY 4.0 often often"] + ["often seen"] * 6
    files = spark.createDataFrame([(f"{i}", t) for i, t in enumerate(texts)], "path string, text string")
    known = licenses.templates(spark, [("CC", "Licensed under CC BY 4.0")])
    rare = math.log((1 + 7) / (1 + 1)) + 1
    often = math.log((1 + 7) / (1 + 7)) + 1
    want = math.sqrt(5) * rare / math.sqrt(5 * rare**2 + (2 * often) ** 2)
    row = licenses.statements(files, known, least=0.5).first()
    assert row.license == "CC" and abs(row.cosine - want) < 1e-9


# 5. Secrets


def test_secrets_held_out(spark, odd):
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents")
    corpus = secrets.corpus_of(docs)
    findings = queries.labelled_findings(spark, "/root/testdata/sf0.01")
    held = F.pmod(F.xxhash64("id", "value"), F.lit(3)) == 0
    forest = secrets.train(findings.where(~held), corpus)
    rows = secrets.classify(findings.where(held).withColumnRenamed("is_secret", "want"), corpus, forest).collect()
    assert len(rows) > 1000 and sum(r.is_secret == bool(r.want) for r in rows) >= 0.97 * len(rows)
    assert secrets.classify(secrets.candidates(odd), corpus, forest).count() == 0
    assert secrets.classify(secrets.candidates(odd.limit(0)), corpus, forest).count() == 0


def test_candidates(spark):
    text = 'so the password=e3b3ed3cc8548923d6 das\ntoken = "0641917ea4e9feb9cda83477b57ac2654884f485", then longwordwithoutdigits 4690149265297988'
    rows = spark.createDataFrame([(1, text), (2, None), (1, text)], "doc_id long, text string")
    got = [(r.before, r.value, r.after) for r in secrets.candidates(rows).orderBy("nth").collect()]
    assert got == [
        ("password", "e3b3ed3cc8548923d6", "das"),
        ("token", "0641917ea4e9feb9cda83477b57ac2654884f485", "then"),
        ("longwordwithoutdigits", "4690149265297988", ""),
    ]


# 6. Decontamination

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UP))


def brute_hits(docs, items, size=10):
    known = {}
    for item, text in items:
        w = bench_words(text)
        k = min(size, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            known.setdefault(tuple(w[i : i + k]), set()).add(item)
    out = []
    for number, text in docs:
        w, hit, found = bench_words(text), set(), set()
        for k in {len(x) for x in known}:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in known:
                    hit |= set(range(i, i + k))
                    found |= known[tuple(w[i : i + k])]
        out.append((number, len(w), sorted(hit), sorted(found)))
    return out


def test_contamination_by_brute_force(spark, documents, odd, monkeypatch):
    bench = pq.read_table("/root/testdata/sf0.001/benchmark.parquet").to_pylist()
    items = [(r["item_id"], r["text"]) for r in bench] + [(900, "two other"), (901, "X"), (902, ""), (903, None), (904, "Same row, twice")]
    docs = [(d["doc_id"] + 100, d["text"]) for d in documents] + [(r.doc_id, r.text) for r in odd.collect()]
    docs += [(999, " ".join(["nor"] * 5) + " !! " + bench[0]["text"].upper() + " tail")]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("w1", F.lit(0))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    order = lambda rows: sorted(rows, key=repr)
    want = order(brute_hits(docs, items))
    for block in (decontaminate.BLOCK_BYTES, 200_000):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
        got = decontaminate.contamination(table, benchmark).collect()
        assert order([(r["__id"], r.n_words, r.hits, sorted(r["items"])) for r in got]) == want
    kept = decontaminate.decontaminate(table, benchmark)
    assert kept.columns == table.columns and kept.count() == sum(not w[2] for w in want)
    cut = decontaminate.decontaminate(table, benchmark, remove="spans")
    assert cut.count() == len(docs)
    text = cut.where("doc_id = 999").first().text
    assert bench_words(text) == ["nor"] * 5 + ["tail"]
    assert decontaminate.contamination(table.limit(0), benchmark).count() == 0
    assert decontaminate.contamination(table, benchmark.limit(0)).where("size(hits) > 0").count() == 0


# 7. Near duplicates


def brute_groups(docs, size, percent):
    sets = {}
    for number, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))
        k = min(size, len(w))
        sets.setdefault(number, []).append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset())
    parent = {n: n for n in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    flat = [(n, s) for n, ss in sets.items() for s in ss if s]
    for i, (a, x) in enumerate(flat):
        for b, y in flat[i + 1 :]:
            common = len(x & y)
            if common * 100 >= percent * (len(x) + len(y) - common):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return [(n, len(s), root(n), root(n) == n) for n, ss in sets.items() for s in ss]


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_by_brute_force(spark, documents, odd, size):
    draw = random.Random(size)
    docs = [(d["doc_id"] + 1000, d["text"]) for d in documents]
    docs += [(r.doc_id, r.text) for r in odd.collect() if r.doc_id is not None]
    base = [f"w{draw.randint(0, 400)}" for _ in range(150)]
    number = 5000
    # Many copies with a few words changed, short texts near each other, and chains.
    for _ in range(150):
        words = list(base)
        for _ in range(draw.randint(0, 5)):
            words[draw.randrange(len(words))] = f"v{draw.randint(0, 10**6)}"
        docs.append((number := number + 1, " ".join(words)))
    for n in range(1, 40):
        words = [f"s{draw.randint(0, 9)}" for _ in range(n)]
        docs += [(number := number + 1, " ".join(words)), (number := number + 1, " ".join([*words, "end"])), (number := number + 1, " ".join(words[1:]))]
    chain = [f"c{i}" for i in range(60)]
    for i in range(12):
        chain = [*chain[2:], f"c{60 + 2 * i}", f"c{61 + 2 * i}"]
        docs.append((number := number + 1, " ".join(chain)))
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit(1)).repartition(4)
    got = near_dedup.near_duplicates(table, shingle_words=size).collect()
    want = brute_groups(docs, size, 80)
    assert sorted(map(tuple, got)) == sorted(want)
    kept = near_dedup.deduplicate(table, shingle_words=size)
    assert kept.columns == table.columns and kept.count() == sum(w[3] for w in want)


def test_near_duplicates_odd(odd, empty):
    rows = near_dedup.near_duplicates(odd).collect()
    assert len(rows) == 12 and all(r.kept for r in rows if r.doc_id is None)
    assert near_dedup.deduplicate(odd).count() == 12
    assert near_dedup.near_duplicates(empty).count() == 0


def test_components(spark):
    draw = random.Random(1)
    edges = [(draw.randint(0, 300), draw.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(2001, 2300)]
    parent = {n: n for e in edges for n in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = root(a), root(b)
        parent[max(p, q)] = min(p, q)
    linked = {n for a, b in edges if a != b for n in (a, b)}
    got = dict(common.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {n: root(n) for n in linked}


# 8. Fingerprints


def test_fingerprint_query(spark, small, documents):
    got = {r.doc_id: r for r in queries.op8_fingerprints(spark, small).collect()}
    order = sorted(documents, key=lambda d: -d["doc_id"])
    marks = {}
    for i, d in enumerate(order):
        text, after = d["text"], order[(i + 1) % len(order)]
        half = len(text) // 2
        r = got[d["doc_id"]]
        assert (r.n_chars, r.edited_sha256) == (len(text), sha(text[: len(text) - half] + after["text"][:half]))
        assert 0 <= r.near_edited <= 1 and (r.near_next == 1) == (text == after["text"])
        marks.setdefault(text, set()).add(r.fingerprint)
    assert all(len(m) == 1 for m in marks.values()) and len(set.union(*marks.values())) == len(marks)
    assert sum(r.near_edited > r.near_next for r in got.values()) > 0.8 * len(got)


def test_fingerprint_locates_edits(spark):
    lines = [f"line {i}, with a clause; and one more." for i in range(30)]
    other = [*lines[:7], "changed here", *lines[8:20], "put in", *lines[20:]]
    row = spark.createDataFrame([("\n".join(lines), "\n".join(other))], "a string, b string")
    a, b = fingerprint.fingerprint(F.col("a")), fingerprint.fingerprint(F.col("b"))
    there, back, same, near = row.select(
        fingerprint.differing(a, b), fingerprint.differing(b, a), fingerprint.differing(a, a), fingerprint.likeness(a, b)
    ).first()
    assert (there, back, same) == ([7], [7, 20], []) and 0.9 < near < 1


def test_fingerprint_nodes_follow_from_each_other(spark):
    text = "\n".join(f"paragraph {i % 17}, with {i} clauses; or so" for i in range(60))
    mark = spark.createDataFrame([(text,)], "a string").select(fingerprint.fingerprint(F.col("a")).alias("m"))
    m, top, sections, paragraphs, leaves = mark.select(
        "m", fingerprint.root(F.col("m")), fingerprint.sections(F.col("m")), fingerprint.paragraphs(F.col("m")), fingerprint.leaves(F.col("m"))
    ).first()
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    pieces = [re.split(r"(?<=[,;])(?=\s)", line) for line in text.split("\n")]
    assert paragraphs == [md5("".join(map(md5, p))) for p in pieces]
    assert leaves == [md5(c)[:8] for p in pieces for c in p] and len(sections) > 2
    assert top == md5("".join(sections)) and m.startswith(top)


def test_fingerprint_repeats_and_moves(spark):
    draw = random.Random(18)
    rows = [("x\nx\ny", "x\ny"), ("a\nb", "b\na"), ("a", "a"), ("", "a"), ("", ""), ("x\n\nx", "x\n\n")]
    for _ in range(60):
        lines = [draw.choice(["p", "q", "r", "s, t", "t; s"]) + str(draw.randrange(9)) for _ in range(draw.randint(1, 40))]
        other = list(lines)
        for _ in range(draw.randrange(4)):
            at = draw.randrange(len(other) + 1)
            other[at : at + draw.randrange(3)] = draw.choices(lines, k=draw.randrange(3))
        rows.append(("\n".join(lines), "\n".join(other)))
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string")
    a, b = fingerprint.fingerprint(F.col("a")), fingerprint.fingerprint(F.col("b"))
    table = table.select("i", "a", "b", a.alias("x"), b.alias("y"))
    x, y = F.col("x"), F.col("y")
    got = table.select("i", fingerprint.likeness(x, y), fingerprint.differing(x, y), fingerprint.differing(y, x)).orderBy("i").collect()
    for (_, near, there, back), (p, q) in zip(got, rows, strict=True):
        cut = lambda t: collections.Counter(c for line in t.split("\n") for c in re.split(r"(?<=[,;])(?=\s)", line))
        u, v = cut(p), cut(q)
        total = u.total() + v.total()
        assert near == (1.0 if p == q else min(2.0 * (u & v).total(), total - 1) / total)
        # Equal texts differ nowhere, others somewhere, and without what differs both are the same.
        rest = lambda t, gone: [line for i, line in enumerate(t.split("\n")) if i not in gone]
        assert (p == q) == (not there and not back)
        assert rest(p, there) == rest(q, back)
    assert [r[2] for r in got[:2]] == [[1], [0, 1]] or got[0][2] in ([0], [1])


def test_fingerprint_odd(odd, empty):
    rows = fingerprint.fingerprints(odd).collect()
    assert len(rows) == 12 and rows[0].fingerprint == rows[1].fingerprint and rows[5] == rows[6]
    assert fingerprint.fingerprints(empty).count() == 0
    following = fingerprint.with_next(odd.select("doc_id", "text"), "doc_id", ["text"], 4).collect()
    assert len(following) == 12
    assert fingerprint.with_next(empty.select("doc_id", "text"), "doc_id", ["text"], 4).count() == 0


def test_fingerprint_of_text_without_clauses(spark):
    draw = random.Random(8)
    plain = " ".join("".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 9))) for _ in range(600))
    smile = "".join(chr(draw.randint(0x1F600, 0x1F64F)) for _ in range(1000))
    han = "。".join("".join(chr(draw.randint(0x4E00, 0x9FFF)) for _ in range(12)) for _ in range(60))
    texts = [plain, smile, han, "a" * 2000]
    rows = []
    for text in texts:
        at = len(text) // 2
        rows.append((text, text[:at] + ("b" if text[at] != "b" else "c") + text[at + 1 :], text[: len(text) // 2] + "q" * 500))
    table = spark.createDataFrame(rows, "a string, b string, c string")
    marks = {c: fingerprint.fingerprint(F.col(c)) for c in "abc"}
    got = table.select(
        fingerprint.likeness(marks["a"], marks["b"]), fingerprint.likeness(marks["a"], marks["c"]), fingerprint.root(marks["a"]) == fingerprint.root(marks["b"])
    ).collect()
    for one, half, same in got[:3]:
        assert 0.8 < one < 1 and 0.3 < half < 0.9 and not same
    assert not got[3][2]
    count = table.select(F.size(fingerprint.leaves(marks["a"]))).collect()
    assert all(r[0] >= len(t) / 256 for r, t in zip(count, texts, strict=True))


# 9. Lines


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_lines_by_brute_force(spark, documents, odd):
    draw = random.Random(9)
    base = "the quick brown foxes jumped over seventeen sleeping guard dogs beside yonder river bank".split()
    docs = [(d["doc_id"] + 100, d["text"]) for d in documents]
    for i in range(120):
        words = list(base)
        if i % 3 == 1:
            words[draw.randrange(len(words))] = draw.choice(["a", "of", "Foxes", "in"])
        if i % 3 == 2:
            k = draw.randrange(len(words) - 1)
            words[k : k + 2] = words[k : k + 2][::-1]
        docs.append((5000 + i, f"Own words of text number {i} {i * 7} {i * 13} only\n{' '.join(words)}!\nshort line\n\n"))
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("pos", F.lit(0)).repartition(3)
    lines, groups = line_dedup.line_groups(table, "doc_id", "text", 5, 80)
    raw = line_dedup._lines(table, "doc_id", "text")
    hashes = {}
    for r in line_dedup._hashed(raw, 5).collect():
        assert hashes.setdefault(r.line_id, (r.h1, r.h2, r.sizes)) == (r.h1, r.h2, r.sizes)
    split = raw.select(line_dedup.words_of(F.col("line")).alias("words")).where("size(words) > 0")
    words = {r[0]: r[1] for r in split.select(F.xxhash64("words"), F.array_join("words", " ")).distinct().collect()}
    parent = {k: k for k in words}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def agree(p, q):
        """Whether two lines have the same two blocks, of a quarter of the words of each."""
        blocks = [[((h1, h1 >> 2, h1 >> 4, h2, h2 >> 2)[i] & line_dedup._BITS, sizes >> 12 * i & 4095) for i in range(5)] for h1, h2, sizes in (p, q)]
        same = [i for i in range(5) if blocks[0][i][0] == blocks[1][i][0]]
        enough = lambda x, i, j: x[i][1] + x[j][1] >= max(2, sum(n for _, n in x) / 4)
        return any(enough(x, i, j) and enough(y, i, j) for x, y in [blocks] for i in same for j in same if i < j)

    known = sorted(k for k in words if hashes[k][0] is not None)
    for i, a in enumerate(known):
        for b in known[i + 1 :]:
            x, y = words[a], words[b]
            most = max(len(x), len(y)) * 20 // 100
            bits = sum((p ^ q).bit_count() for p, q in zip(hashes[a][:2], hashes[b][:2], strict=True))
            if abs(len(x) - len(y)) <= most and bits <= 24 and agree(hashes[a], hashes[b]) and edit_distance(x, y) <= most:
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    got = {r.line_id: r.group for r in groups.collect()}
    assert all(got.get(k, k) == root(k) for k in words) and len(set(map(root, words))) < len(words)
    # One occurrence of each group stays, the first.
    left = line_dedup.dedup_lines(table, removed_col="n_removed").collect()
    seen = {}
    texts = dict(docs)
    ids = {v: k for k, v in words.items()}
    for number in sorted(texts):
        for line in texts[number].split("\n"):
            w = " ".join(x for x in re.split(r"[^\w]+|_", line.lower()) if x)
            if w in ids:
                seen.setdefault(root(ids[w]), []).append(number)
    assert sum(r.n_removed for r in left) == sum(len(v) - 1 for v in seen.values())
    assert all(r.text == texts[r.doc_id] for r in left if r.n_removed == 0)


def test_lines_odd(odd, empty):
    rows = line_dedup.dedup_lines(odd).collect()
    assert len(rows) == 12 and {r.key for r in rows} == {"k"}
    assert [r.text for r in rows if r.doc_id == 1] == [None]
    assert line_dedup.dedup_lines(empty).count() == 0


def test_long_line_is_hashed_whole(spark):
    words = " ".join(f"word{i}" for i in range(3000))
    rows = spark.createDataFrame([(1, words), (2, words + " more"), (3, words[:9000])], "doc_id long, text string")
    kept = {r.doc_id for r in line_dedup.dedup_lines(rows).collect()}
    assert 1 in kept and 2 not in kept


def test_repeated_row_with_a_near_line_elsewhere(spark):
    line = "seventeen quick brown foxes jumped over sleeping guard dogs beside yonder river bank this morning"
    words = line.split()
    near = " ".join([words[1], words[0], *words[2:]])
    rows = [(1, "one text of its own\n" + near)] + [(2, "another text of its own\n" + line)] * 4
    table = spark.createDataFrame(rows, "doc_id long, text string")
    hashes = {}
    for r in line_dedup._hashed(line_dedup._lines(table, "doc_id", "text"), 5).collect():
        hashes.setdefault(r.line_id, set()).add((r.h1, r.h2))
    assert all(len(h) == 1 for h in hashes.values())
    left = {(r.doc_id, r.text) for r in line_dedup.dedup_lines(table).collect()}
    assert left == {(1, rows[0][1]), (2, "another text of its own")}


def test_near_lines_by_edit_distance_alone(spark, documents):
    from corpus_pipeline import line_dedup_stage

    draw = random.Random(4)
    own = {" ".join(x for x in re.split(r"[^\w]+|_", line.lower()) if x) for d in documents for line in (d["text"] or "").split("\n")}
    own = sorted(line for line in own if len(line.split()) >= 5)
    some = draw.sample(own, 250)
    edited = []
    for i, line in enumerate(some):
        words = line.split()
        at = draw.randrange(len(words))
        typo = draw.randrange(len(words[at]))
        words[at] = words[at][:typo] + "q" + words[at][typo + 1 :] if i % 2 else draw.choice(own).split()[0]
        edited.append(" ".join(words))
    lines = sorted({*some, *edited})
    table = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    longest = F.greatest(F.length("a.text"), F.length("b.text"))
    near = (F.abs(F.length("a.text") - F.length("b.text")) <= F.floor(longest / 5)) & (
        F.levenshtein("a.text", "b.text") <= F.floor(longest / 5)
    )
    pairs = table.alias("a").join(table.alias("b"), (F.col("a.doc_id") < F.col("b.doc_id")) & near).select("a.doc_id", F.col("b.doc_id").alias("other")).collect()
    linked = {n for p in pairs for n in p}
    parent = {n: n for n in linked}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        p, q = root(a), root(b)
        parent[max(p, q)] = min(p, q)
    assert len(pairs) > 200
    want = {n for n in linked if root(n) != n}
    gone = set(range(len(lines))) - {r.doc_id for r in line_dedup_stage(spark, table, "").collect()}
    # Nothing else goes, and next to nothing of it stays.
    assert gone <= want and len(gone) >= 0.97 * len(want)


def test_near_lines_by_number_of_edits(spark, documents):
    """The share of lines with so many replaced words that is found, of those that the edit distance links."""
    draw = random.Random(14)
    own = {" ".join(x for x in re.split(r"[^\w]+|_", line.lower()) if x) for d in documents for line in (d["text"] or "").split("\n")}
    own = sorted(line for line in own if len(line.split()) >= 12)
    other = sorted({w for line in own for w in line.split()})
    rows, asked = [], {}
    for n in range(300):
        line, edits = draw.choice(own).split(), 1 + n % 3
        changed = list(line)
        for at in draw.sample(range(len(line)), edits):
            changed[at] = draw.choice(other)
        x, y = " ".join(line), " ".join(changed)
        if x != y and edit_distance(x, y) <= max(len(x), len(y)) // 5:
            # Words of its own keep each pair apart from the others.
            asked[n] = edits
            rows += [(2 * n, f"{x} pair{n}x"), (2 * n + 1, f"{y} pair{n}x")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in line_dedup.dedup_lines(table).collect()}
    share = {e: [2 * n + 1 not in kept for n, k in asked.items() if k == e] for e in (1, 2, 3)}
    share = {e: sum(found) / len(found) for e, found in share.items()}
    assert share[1] >= 0.97 and share[2] >= 0.75 and share[3] >= 0.4, share


def test_bits_of_many_words_are_counted_alike(spark):
    """A block of more words than its fields can count has the same bits by the other way."""
    hashes = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.xxhash64(i))
    got = spark.createDataFrame([(1,), (7,), (63,), (64,), (500,)], "n int").select(hashes.alias("h"), line_dedup._block(hashes).alias("bits")).collect()
    for r in got:
        want = sum(1 << p for i in range(9) for p in (7 * i, 7 * i + 1) if 2 * sum(h >> p & 1 for h in r.h) > len(r.h))
        assert r.bits == want


def test_short_lines_and_scripts_without_spaces(spark):
    from corpus_pipeline import line_dedup_stage

    han = "我们在北京的公园里散步看见了许多美丽的花朵和高大的树木还有孩子们在草地上快乐地奔跑玩耍"
    thai = "วันนี้อากาศดีมากเราจึงไปเดินเล่นที่สวนสาธารณะกับเพื่อนและครอบครัว"
    rows = [
        (1, f"All rights reserved.\n{han}\none of its own\n\n***"),
        (2, f"another of its own\n  all rights reserved\n{han[:20]}雨{han[21:]}\n* * *\n\n---"),
        (3, f"{thai}\nthird"),
        (4, f"fourth\n{thai}\n短い行"),
        (5, "短い行\nfifth"),
    ]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup_stage(spark, table, "").collect()}
    assert got == {1: rows[0][1], 2: "another of its own\n\n---", 3: rows[2][1], 4: "fourth\n短い行", 5: "fifth"}


# 10. Lists of addresses


def test_url_lists(spark):
    day = "2024-01-{:02d} 00:00:00".format
    changes = [
        ("l", "bad.com", "block", day(5), True), ("l", "bad.com", "block", day(10), False), ("l", "bad.com", "block", day(20), True),
        ("m", "ok.bad.com", "allow", day(1), True), ("m", "bad.com/x", "block", day(1), True), (None, "bad.com", "block", day(1), True),
        ("l", "bad.com", "block", day(5), True), ("l", "tie.org", "block", day(3), True), ("l", "tie.org", "block", day(3), False),
        ("a", "both.org", "allow", day(1), True), ("b", "both.org", "block", day(1), True),
    ]
    captures = [
        ("http://bad.com/", day(4)), ("http://bad.com/", day(5)), ("http://bad.com/", day(10)), ("https://u@WWW.Bad.com:80/a?b#c", day(25)),
        ("http://ok.bad.com/", day(6)), ("http://bad.com/x/y", day(12)), ("http://tie.org", day(4)), ("http://both.org", day(2)),
        ("not an address", day(2)), (None, day(2)), ("http://bad.com/", None), ("http://bad.com/", day(5)),
    ]
    given = spark.createDataFrame(changes, "list string, key string, action string, at string, added boolean").withColumn("at", F.col("at").cast("timestamp"))
    table = spark.createDataFrame(captures, "url string, fetched string").withColumn("fetched", F.col("fetched").cast("timestamp")).withColumn("key", F.lit("clash"))
    for span in (1, 30):
        got = url_lists.evaluate(table, given, "url", "fetched", span).collect()
        found = sorted([(r.url, str(r.fetched), r.action, r.entry) for r in got], key=repr)
        want = [None, "block", None, "block", "allow", "block", None, "block", None, None, None, "block"]
        assert sorted([(u, str(r) if r is None else r, a) for (u, r), a in zip(captures, want, strict=True)], key=repr) == sorted([f[:3] for f in found], key=repr)
    assert url_lists.keep_allowed(table, given, "url", "fetched").count() == 12 - sum(a == "block" for a in want)
    assert url_lists.evaluate(table.limit(0), given, "url", "fetched").count() == 0
    assert url_lists.evaluate(table, given.limit(0), "url", "fetched").where("action is not null").count() == 0


def test_address_keys(spark):
    row = spark.createDataFrame([("https://me@A.b.example:8080/x//y/?q#f",)], "u string").select(url_lists.address_keys(F.col("u"))).first()
    assert [tuple(k) for k in row[0]] == [("example", 1), ("b.example", 2), ("a.b.example", 3), ("a.b.example/x", 5), ("a.b.example/x/", 6), ("a.b.example/x//y", 7)]


def test_unlike_lines_of_a_list_are_told_apart_where_they_meet(spark, monkeypatch):
    """Lines that share words, and so keys, were all paired before any of them was looked at."""
    rng = random.Random(5)

    def made() -> str:
        few = rng.sample("etaoinsrhldcum", 3)
        return " ".join("".join(rng.choice(few) for _ in range(15)) for _ in range(3))

    lines = [f"shared opening words found everywhere among these {made()}" for _ in range(60)]
    lines += [lines[7].replace("opening", "openings"), lines[30][:-1] + "#" + lines[30][-1]]
    table = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    asked = []
    real = line_dedup.linked

    def linked(lists, verify, *rest):
        def counted(pairs, own):
            asked.append(pairs.count())
            return verify(pairs, own)

        return real(lists, counted, *rest)

    monkeypatch.setattr(line_dedup, "linked", linked)
    left = {r.doc_id for r in line_dedup.dedup_lines(table).collect()}
    assert left == set(range(60))
    assert len(asked) > 1 and asked[-1] <= len(lines), asked


def test_letters_tell_no_similar_lines_apart(spark):
    rng = random.Random(11)
    rows = []
    for i in range(300):
        a = "".join(rng.choice("etaoinsrhldcum xyzäß") for _ in range(rng.randint(20, 80)))
        b = list(a)
        for _ in range(rng.randint(1, 16)):
            at = rng.randrange(len(b))
            b[at : at + rng.randint(0, 1)] = rng.choice(["", "e", "t", "zz", " "])
        rows.append((i, a, "".join(b)))
    both = spark.createDataFrame(rows, "id int, a string, b string")
    side = lambda c: both.select("id", *line_dedup._letters(F.col(c))).alias(c)
    met = both.join(side("a"), "id").join(side("b"), "id").withColumn("apart", F.levenshtein(both["a"], both["b"]))
    assert met.where(~line_dedup._few_letters_apart("a", "b", F.col("apart"))).count() == 0
    assert met.where(line_dedup._few_letters_apart("a", "b", F.lit(0))).count() < 150


def test_unlike_sets_of_a_list_are_told_apart_where_they_meet(spark, monkeypatch):
    """Copies of one text with too many words changed share keys; all of them were paired before any was looked at."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(300)]

    def changed(least: int, most: int) -> str:
        words = list(base)
        for at in rng.sample(range(300), rng.randint(least, most)):
            words[at] = f"v{rng.randint(0, 10**9)}"
        return " ".join(words)

    docs = [(i, changed(4, 14)) for i in range(150)] + [(1000 + i, changed(26, 34)) for i in range(100)]
    docs.append((2000, docs[170][1] + " end"))
    asked = []
    real = near_dedup._verified

    def verified(pairs, *rest):
        asked.append(pairs.count())
        return real(pairs, *rest)

    monkeypatch.setattr(near_dedup, "_verified", verified)
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), shingle_words=2).collect()
    assert sorted(map(tuple, got)) == sorted(brute_groups(docs, 2, 80))
    assert sum(asked) <= 6 * len(docs), asked


def test_parities_tell_no_similar_sets_apart(spark):
    rng = random.Random(7)
    rows = []
    for i in range(400):
        n = rng.choice([1, 5, 30, 200, 3000])
        a = [rng.getrandbits(63) - 2**62 for _ in range(n)]
        b = a[rng.randint(0, n // 5) :] + [rng.getrandbits(63) - 2**62 for _ in range(rng.randint(0, n // 5))]
        similar = len({*a} & {*b}) * 100 >= 80 * len({*a, *b})
        marks = [near_dedup.parities(np.unique(np.array(x, np.int64))).tolist() for x in (a, b)]
        rows.append((i, similar, len({*a}), marks[0], len({*b}), marks[1]))
    table = spark.createDataFrame(rows, "id int, similar boolean, n long, x array<long>, m long, y array<long>")
    side = lambda n, p: table.select("id", F.col(n).alias("n"), *[F.col(p)[i].alias(f"p{i}") for i in range(near_dedup.PARITIES)])
    met = side("n", "x").alias("l").join(side("m", "y").alias("r"), "id").select("id", near_dedup._few_apart("l", "r", 80).alias("pass"))
    told = table.select("id", "similar").join(met, "id").groupBy("similar", "pass").count().collect()
    found = {(r["similar"], r["pass"]): r["count"] for r in told}
    assert (True, False) not in found and found[True, True] > 50 and found[False, False] > 50
