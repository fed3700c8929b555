from __future__ import annotations

from pathlib import Path

import pytest

import cloakwork as cw
from cloakwork.sources.corpus import cap_per_root, list_corpus
from cloakwork.sources.patterns import compiles, respelt, runnable
from cloakwork.sources.rule_config import first_candidate, parse_rules

from . import samples as s


def tree(base: Path, count: int, secret: bool) -> str:
    base.mkdir(parents=True, exist_ok=True)
    for i in range(count):
        text = f"# part {i}\nexport OPENAI_API_KEY=sk-live-{i:04d}q7w{i:04d}x2z{i:04d}\n" if secret else f"PORT={8000 + i}\n"
        (base / f"part{i:02d}.env").write_text(text)
    return str(base)


def scan(spark, roots, **options):
    return cw.findings(cw.load_corpus(spark, roots, **options), id_cols=["root"], path_col="path")


def test_findings_across_files(spark, tmp_path):
    root = tree(tmp_path / "w", 10, True)
    rows = scan(spark, root).collect()
    assert len(rows) == 10
    assert {(r.path, r.line) for r in rows} == {(f"{root}/part{i:02d}.env", 2) for i in range(10)}


def test_caps(spark, tmp_path):
    many, few = tree(tmp_path / "many", 75, True), tree(tmp_path / "few", 3, True)
    assert scan(spark, many).count() == 75
    capped = cw.load_corpus(spark, many, max_files=50)
    assert cw.unread_files(list_corpus(spark, many), capped).count() == 25
    assert sorted(r.path for r in capped.collect()) == [f"{many}/part{i:02d}.env" for i in range(50)]
    per_root = cw.load_corpus(spark, [many, few], max_files_per_root=5).groupBy("root").count()
    assert {r.root: r["count"] for r in per_root.collect()} == {many: 5, few: 3}


def test_clean_empty_and_missing(spark, tmp_path):
    assert scan(spark, tree(tmp_path / "clean", 5, False)).count() == 0
    (tmp_path / "empty").mkdir()
    assert cw.load_corpus(spark, str(tmp_path / "empty")).count() == 0
    assert cw.load_corpus(spark, "/path/does/not/exist").count() == 0
    assert list_corpus(spark, ["/path/does/not/exist"]).count() == 0
    both = cw.load_corpus(spark, ["/path/does/not/exist", tree(tmp_path / "c2", 2, False)])
    assert both.count() == 2


def test_what_is_scanned(spark, tmp_path):
    # The root itself may lie below a directory that is skipped inside a root.
    root = tmp_path / "build" / "my work"
    for name in (
        "a.ts", "B.PY", "deep/er/c.json", ".env", "sub/.env", "node_modules/x/d.js", "sub/out/e.md", "logo.png",
        "Makefile", "building/f.md", "venv/.env", "a+b %20.md",
    ):
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(s.OPENAI)
    got = {r.path.removeprefix(f"{root}/") for r in cw.load_corpus(spark, str(root)).collect()}
    assert got == {"a.ts", "B.PY", "deep/er/c.json", ".env", "sub/.env", "building/f.md", "a+b %20.md"}
    listed = {r.path.removeprefix(f"{root}/"): r.scanned for r in list_corpus(spark, [f"file://{root}"]).collect()}
    assert listed["a.ts"] and not listed["node_modules/x/d.js"] and not listed["logo.png"]


def test_hidden_files(spark, tmp_path):
    names = {
        "a.ts", ".env", "a/.env", "b/x/.env", "__init__.py", "_config.yml", ".eslintrc.json", "__tests__/t.ts",
        ".github/workflows/d.yml", "_x/.y/z.md", "pages/[id].tsx", "q{1}*?.py",
    }
    for name in names | {"d/venv/.env", "e/out/q/.env", ".git/config.yml", ".hidden.png"}:
        path = tmp_path / "tree" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(s.OPENAI)
    base = f"{tmp_path}/tree"
    for root in (base, f"file://{base}", f"file:{base}/"):
        rows = cw.load_corpus(spark, root).collect()
        assert {r.path.removeprefix(f"{base}/") for r in rows} == names and {(r.root, r.text) for r in rows} == {(base, s.OPENAI)}
        listed = {r.path.removeprefix(f"{base}/") for r in list_corpus(spark, root).where("scanned").collect()}
        assert listed == names
        capped = cw.load_corpus(spark, root, max_files=50)
        assert {r.path.removeprefix(f"{base}/") for r in capped.collect()} == names
        first = cw.load_corpus(spark, root, max_files_per_root=4).collect()
        assert [r.path.removeprefix(f"{base}/") for r in sorted(first, key=lambda r: r.path)] == sorted(names)[:4]
    assert cw.unread_files(list_corpus(spark, base), cw.load_corpus(spark, base, max_files=5)).count() == len(names) - 5


def test_skipped_files_are_not_read(spark, tmp_path):
    root = tmp_path / "w"
    tree(root, 3, True)
    tree(root / "node_modules", 20, True)
    corpus = cw.load_corpus(spark, str(root), hidden=False)
    corpus.collect()
    plan = corpus._jdf.queryExecution().executedPlan()
    while plan.children().size():
        plan = plan.children().head()
    assert plan.metrics().apply("numFiles").value() == 3


def test_bytes_that_are_not_text(spark, tmp_path):
    (tmp_path / "x.txt").write_bytes(b"\xff\xfe password=abcdef \xc3")
    row = cw.load_corpus(spark, str(tmp_path)).first()
    assert "password=abcdef" in row.text and "�" in row.text


def test_cap_is_applied_before_the_shuffle(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("source", "doc_id")
    plan = cap_per_root(docs, 3, "source", ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


CONFIGS = {
    "one": ('rules:\n  - name: "build-ticket"\n    pattern: "bt-[0-9]{6}[a-f]{4}"\n    category: "custom"\n',
            [("build-ticket", "bt-[0-9]{6}[a-f]{4}", "custom")]),
    "broken": ("%% }} no: rules - here [", []),
    "no pattern": ('rules:\n  - name: "nothing-to-find"\n    category: "custom"\n', []),
    "no name": ("rules:\n  - pattern: x+\n", [("custom-pattern", "x+", "custom")]),
    "empty name": ('rules:\n  - name: ""\n    pattern: x+\n', []),
    "empty list": ("rules: []\n", []),
    "comments": ('# head\n\nrules:\n  - name: "between-remarks"\n    pattern: "zq[0-9]+"\n    category: "custom"\n\n# end\n',
                 [("between-remarks", "zq[0-9]+", "custom")]),
    "two": ('rules:\n  - name: "left"\n    pattern: "l:[0-9]+"\n  - name: "right"\n    pattern: "r:[0-9]+"\n',
            [("left", "l:[0-9]+", "custom"), ("right", "r:[0-9]+", "custom")]),
    "colon": ('rules:\n  - name: "door"\n    pattern: "ssh://gate[0-9]:[0-9]+"\n',
              [("door", "ssh://gate[0-9]:[0-9]+", "custom")]),
    "quotes": ("customPatterns:\r\n-name: 'a'\r\n pattern: \"b' # kept\r\n category: \"\r\n",
               [("a", "\"b' # kept", "")]),
}


def test_config_files(spark):
    files = spark.createDataFrame([(k, f"/{k}/.cloakwork.yml", t) for k, (t, _) in CONFIGS.items()], "root string, path string, text string")
    got = {}
    for r in parse_rules(files).orderBy("root", "item").collect():
        got.setdefault(r.root, []).append((r.name, r.pattern, r.category))
    assert got == {k: rules for k, (_, rules) in CONFIGS.items() if rules}


def test_config_choice_and_missing_files(spark, tmp_path):
    for name in ("a", "b", "c", "d"):
        (tmp_path / name).mkdir()
    (tmp_path / "a/.cloakwork.yml").write_text("rules:\n- pattern: first\n")
    (tmp_path / "a/.cloakwork.yaml").write_text("rules:\n- pattern: second\n")
    (tmp_path / "b/.cloakwork.yaml").write_text("rules:\n- pattern: second\n")
    (tmp_path / "d/.cloakwork.yml").mkdir()
    roots = [str(tmp_path / n) for n in ("a", "b", "c", "d", "missing")]
    got = {r.root[-1]: r.pattern for r in cw.load_rules(spark, roots).collect()}
    assert got == {"a": "first", "b": "second"}
    files = spark.createDataFrame([("r", "/r/other.yml", "x")], "root string, path string, text string")
    assert first_candidate(files).count() == 0


def test_quarantine(spark, texts):
    assert compiles(spark, "a+") and not compiles(spark, "[0-9")
    rules = spark.createDataFrame(
        [(1, "half-a-class", "[0-9", "custom"), (2, "good", "tok_[0-9]{4}", "api_key")],
        "item int, name string, pattern string, category string",
    )
    good, rejected = cw.usable_rules(rules)
    assert [(r.name, r.category, r.custom) for r in good] == [("good", "api_key", True)]
    assert [r.name for r in rejected.collect()] == ["half-a-class"]
    row = cw.findings(texts("x tok_1234"), custom=good).first()
    assert (row.category, row.value) == ("api_key", "tok_1234")


def test_too_many_rules_are_refused(spark, monkeypatch):
    monkeypatch.setattr("cloakwork.sources.rule_config.MAX_RULES", 2)
    rules = spark.range(3).selectExpr("id item", "'n' name", "'p' pattern", "'c' category")
    with pytest.raises(ValueError):
        cw.usable_rules(rules)


# Patterns in JavaScript's spelling that are not valid as they stand, a text, and what they match in it.
SPELLINGS = [
    ("cfg{[0-9]+}", "a cfg{12} b", ["cfg{12}"]),
    ("a{,3}", "x a{,3} aaa", ["a{,3}"]),
    ("x{2}y{", "xxy{ xy{", ["xxy{"]),
    ("k[^]v", "k=v k\tv kv", ["k=v", "k\tv"]),
    ("t[[a]x", "t[x tax tbx", ["t[x", "tax"]),
    ("(?<the_id>id)=\\k<the_id>", "id=id id=ix", ["id=id"]),
    ("(?<$a>x)(?<_a>y)\\k<$a>\\k<_a>", "xyxy xyyx", ["xyxy"]),
    (r"\u{41}\u{1F600}", "A\U0001F600 B", ["A\U0001F600"]),
    (r"\y\i-key_[0-9]", "yi-key_7", ["yi-key_7"]),
    (r"a\0{1}b|c{x}", "c{x} a", ["c{x}"]),
    (r"\cj{z|ab{c", "ab{c", ["ab{c"]),
    ("[a&&[b]x{y", "[x{y &x{y cx{y", ["[x{y", "&x{y"]),
]


def test_other_spellings(spark, texts):
    assert not any(compiles(spark, pattern) for pattern, _, _ in SPELLINGS)
    rows = [(i, f"r{i}", pattern, "custom") for i, (pattern, _, _) in enumerate(SPELLINGS)]
    rules = spark.createDataFrame(rows, "item int, name string, pattern string, category string")
    good, rejected = cw.usable_rules(rules)
    index = cw.rule_index(rules)
    assert rejected.count() == index.rejected.count() == 0
    docs = texts(*[text for _, text, _ in SPELLINGS])
    for found in (cw.findings(docs, custom=good), cw.findings(docs, rules=index)):
        got: dict = {}
        for r in found.orderBy("doc_id", "ordinal").collect():
            if r.rule_id == f"r{r.doc_id}":
                got.setdefault(r.doc_id, []).append(r.value)
        assert got == {i: values for i, (_, _, values) in enumerate(SPELLINGS)}


@pytest.mark.parametrize("pattern", ["(abc", "abc)", "[abc", "*a", "a**", "a{3,2}", "(?<1a>x)", "\\", "[z-a]{"])
def test_broken_in_any_spelling(spark, pattern):
    assert runnable(spark, pattern) is None


def test_valid_patterns_stay_as_they_are(spark):
    for pattern in (r"[a-z&&[^b]]", r"\v\h+", "a{2,3}+", r"(?<name>a)\k<name>", r"\p{IsGreek}"):
        assert runnable(spark, pattern) == pattern


def test_respelling_keeps_common_patterns():
    for pattern in (r"[A-Za-z0-9+/=_-]{24,}", r"\bKEY_[0-9]{6}\b$", r"(?:a|b)+?[^\s'\";,]{8,}", r"\x41\u0042\p{L}\1(?=x)(?<!y)", r"[\]\\\-]"):
        assert respelt(pattern) == pattern
