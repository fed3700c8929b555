"""Originals in a log, and files that give no text."""

from __future__ import annotations

import cloakwork as cw
from cloakwork.session import scratch_dir
from cloakwork.sources.corpus import read_paths

from . import samples as s


def originals(log, docs):
    return {r.doc_id: r.original_text for r in log.restore(docs.select("doc_id")).collect()}


def test_backup_log(spark, texts):
    path = scratch_dir(spark, "backup").removeprefix("file:")
    log = cw.BackupLog(spark, path, buckets=4)
    docs = texts("a", "b", None, "d")
    assert originals(log, docs) == dict.fromkeys(range(4))
    log.put(docs)
    log.put(docs)
    assert originals(log, docs) == {0: "a", 1: "b", 2: None, 3: "d"}
    log.put(texts("edited"))
    log.clear(docs.where("doc_id = 1").unionByName(docs.where("doc_id = 1")))
    want = {0: "edited", 1: None, 2: None, 3: "d"}
    assert originals(log, docs) == want and log.kept().count() == 3
    reader = log.restore(docs.select("doc_id"))
    log.compact()
    assert originals(log, docs) == want == {r.doc_id: r.original_text for r in reader.collect()}
    log.put(texts("x", "again"))
    # Another object on the same folder goes on where this one is.
    other = cw.BackupLog(spark, path, buckets=4)
    assert originals(other, docs) == {0: "x", 1: "again", 2: None, 3: "d"}
    other.compact()
    other.clear(docs)
    assert originals(log, docs) == dict.fromkeys(range(4)) and log.kept().count() == 0
    log.put(spark.createDataFrame([(None, "x")], "doc_id long, text string"))
    assert log.kept().count() == 0


def test_the_store_is_not_shuffled(spark, texts):
    log = cw.BackupLog(spark, scratch_dir(spark, "backup").removeprefix("file:"), buckets=8)
    log.put(texts("a", "b"))
    plan = log.restore(texts("", "", "").select("doc_id"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Bucketed: true") >= 1


def test_files_that_give_no_text(spark, tmp_path):
    (tmp_path / "a.txt").write_text(s.OPENAI)
    (tmp_path / "b.txt").write_bytes(b"PK\x03\x04\0\0binary")
    (tmp_path / "c.txt").write_bytes("é \udcff".encode("utf-8", "surrogateescape"))
    (tmp_path / "d.png").write_bytes(b"\0")
    (tmp_path / ".hidden.txt").write_text("")
    corpus, errors = cw.load_checked(spark, [str(tmp_path), f"{tmp_path}/nowhere"])
    assert {r.path.rsplit("/", 1)[1]: r.text for r in corpus.collect()} == {"a.txt": s.OPENAI, "c.txt": "é �", ".hidden.txt": ""}
    assert sorted((r.path.rsplit("/", 1)[1], r.reason) for r in errors.collect()) == [("b.txt", "not text"), ("nowhere", "missing")]
    paths = [str(tmp_path / "gone.txt"), str(tmp_path), str(tmp_path / "a.txt")]
    got = {r.path: r.reason for r in cw.read_outcomes(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert got == {paths[0]: "missing", paths[1]: "unreadable", paths[2]: None}
    corpus, errors = cw.load_checked(spark, f"{tmp_path}/nowhere")
    assert corpus.count() == 0 and errors.count() == 1


def test_names_of_files_are_dealt_out(spark, tmp_path):
    """Many names in one partition, most of them of nothing; long files end a batch."""
    (tmp_path / "a.txt").write_text("a\n" * 3_000_000)
    (tmp_path / "b.txt").write_text("é" * 10)
    (tmp_path / "c.txt").write_text("")
    names = [f"{tmp_path}/gone{i}.txt" for i in range(50)] + [f"{tmp_path}/{x}.txt" for x in "abc"]
    paths = spark.createDataFrame([(i, p) for i, p in enumerate(names)], "n long, path string").coalesce(1)
    for read, kept in ((cw.read_outcomes, range(53)), (read_paths, range(50, 53))):
        got = read(paths)
        assert got.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        rows = sorted(got.collect())
        assert [r.n for r in rows] == list(kept)
        assert [len(r.text) for r in rows[-3:]] == [6_000_000, 10, 0]
        assert [r.text is None for r in rows] == [i < 50 for i in kept]
        if read is cw.read_outcomes:
            assert [r.reason for r in rows] == ["missing"] * 50 + [None] * 3
