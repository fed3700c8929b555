"""Rule tables of any size against the same rules compiled one by one."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

import cloakwork as cw
from cloakwork.operators import rule_index as ri

RULES = "item long, name string, pattern string, category string"


@pytest.mark.parametrize(
    ("pattern", "literals"),
    [
        ("itok_[a-z0-9]{32}", ["itok_"]),
        ("ab", []),
        ("abcd|x+", []),
        ("(?:abcd|efgh[0-9])tail", ["tail"]),
        ("(?:abcdef|ghijkl)x?yz", ["abcdef", "ghijkl"]),
        ("abcde?fghij", ["fghij"]),
        ("abcd+efg", ["abcd"]),
        ("(longer_one)?abcd", ["abcd"]),
        ("(longer_one){1,3}abcd", ["longer_one"]),
        (r"key\.v1\:\x41BCD", ["key.v1:ABCD"]),
        (r"\Qa.b*c\E[0-9]", ["a.b*c"]),
        (r"^KEY_\b[0-9]{6}$", ["KEY_"]),
        ("(?i)SeCrEt=(.+)", ["SeCrEt="]),
        ("(?<name>abcd)(?=efgh)", ["abcd"]),
        ("(?!abcdef)[a-z]{6}", []),
        ("[abcd]{4}", []),
        ("", []),
    ],
)
def test_literals(pattern, literals):
    assert ri.literals_of(pattern) == literals


@pytest.mark.parametrize("pattern", ["abcd(", "abcd)", "[abcd", "abcd{2,1}", "*abcd", r"(abcd)\1", "(?u)abcd", "[z-a]abcd", "[a&&b]abcd", "(?<=a)*b", r"\p{IsGreek}abcd"])
def test_what_is_left_to_the_library(pattern):
    assert ri.literals_of(pattern) is None


def random_pattern(draw, depth):
    """A pattern, and a function that spells a text that it matches."""
    parts = []
    for _ in range(draw.randint(1, 3)):
        kind = draw.randint(0, 4 if depth else 2)
        if kind < 2:
            text = draw.choice(["abcd", "efg", "hijkl", "m.n"])
            one, spell = re.escape(text), lambda text=text: text
        elif kind == 2:
            one, spell = "[x-z0]", lambda: draw.choice("xyz0")
        else:
            branches = [random_pattern(draw, depth - 1) for _ in range(kind - 2)]
            one = f"({'|'.join(p for p, _ in branches)})"
            spell = lambda branches=branches: draw.choice(branches)[1]()
        often, least, most = draw.choice([("", 1, 1)] * 4 + [("?", 0, 1), ("+", 1, 3), ("*", 0, 2), ("{2}", 2, 2), ("{0,2}", 0, 2), ("+?", 1, 2)])
        if often and kind < 2:
            # Only the last character is repeated.
            parts.append((one + often, lambda s=spell, low=least, high=most: s()[:-1] + s()[-1] * draw.randint(low, high)))
        else:
            parts.append((one + often, lambda s=spell, low=least, high=most: "".join(s() for _ in range(draw.randint(low, high)))))
    return "".join(p for p, _ in parts), lambda: "".join(s() for _, s in parts)


def test_literals_are_in_every_match():
    draw, checked = random.Random(8), 0
    for _ in range(500):
        pattern, spell = random_pattern(draw, 2)
        found = ri.literals_of(pattern)
        for _ in range(10):
            text = spell()
            assert re.fullmatch(pattern, text)
            checked += bool(found)
            assert not found or any(x in text for x in found), (pattern, text, found)
    assert checked > 2000


def shapes(n):
    """Rules of many shapes, in an order that matters where they overlap."""
    kinds = [
        lambda i: f"acme{i}_[0-9a-f]{{6}}",
        lambda i: f"(?i)Token{i}:[a-z]+",
        lambda i: f"(?:left{i}|right{i})-[0-9]+",
        lambda i: f"acme{i}_[0-9a-f]{{4}}",
        lambda i: f"^start{i} [a-z]+$",
        lambda i: f"q{i}[0-9]",
        lambda i: f"BEGIN{i}[^Z]*END",
        lambda i: f"x{i}y?zzz",
        lambda i: f"broken{i}(",
    ]
    return [(i, f"rule{i}", kinds[i % len(kinds)](i), "custom" if i % 2 else "api_key") for i in range(n)]


def some_texts(n, rules):
    draw = random.Random(4)
    for _ in range(n):
        lines = []
        for _ in range(draw.randint(0, 6)):
            i = draw.randrange(rules)
            lines.append(
                draw.choice(["", "see ", "é ", "key=acme"])
                + draw.choice([f"acme{i}_0a1b2c", f"tOKEN{i}:abc", f"right{i}-12", f"start{i} abc", f"q{i}7", f"BEGIN{i} a\nb END", f"x{i}zzz", "nothing", f"acme{i}_0a1b token{i}:x"])
                + draw.choice(["", " ", " password=hunter2hunter2", "\r"])
            )
        yield "\n".join(lines)


def test_as_compiled_rules(spark, texts):
    rules = spark.createDataFrame(shapes(90), RULES)
    usable, rejected = cw.usable_rules(rules)
    index = cw.rule_index(rules.repartition(3))
    assert index.rejected.count() == rejected.count() == 10
    assert len(index.direct) == 30
    docs = texts(*some_texts(300, 90), None, "")
    for scope in ("document", "line"):
        one = cw.findings(docs, custom=usable, scope=scope)
        other = cw.findings(docs, rules=index, scope=scope)
        key = lambda df: sorted(map(tuple, df.collect()))
        assert one.columns == other.columns and key(one) == key(other)
    assert one.where("rule_id like 'rule%'").select("rule_id").distinct().count() > 40
    masked, same = cw.mask(docs, custom=usable), cw.mask(docs, rules=index)
    assert masked.columns == same.columns
    assert sorted(map(tuple, masked.fillna("").collect())) == sorted(map(tuple, same.fillna("").collect()))


def test_odd_tables(spark, texts):
    docs = texts("acme0_0a1b2c", None)
    empty = cw.rule_index(spark.createDataFrame([], RULES))
    assert cw.findings(docs, rules=empty).count() == 0
    rows = [(1, None, "acme0_[0-9a-f]{6}", None), (1, None, "acme0_[0-9a-f]{6}", None), (2, "n", None, "c"), (3, "m", "", "c")]
    index = cw.rule_index(spark.createDataFrame(rows, RULES))
    assert index.rules.count() == 1 and [r.rule_id for r in cw.findings(docs, rules=index).collect()] == ["custom-pattern"]
    assert cw.findings(docs.limit(0), rules=index).count() == 0
    with pytest.raises(ValueError, match="not both"):
        cw.detect(docs, rules=index, custom=[cw.custom_rule("x", "y")])


def test_too_many_rules_without_a_literal(spark, monkeypatch):
    monkeypatch.setattr(ri, "MAX_DIRECT", 5)
    with pytest.raises(ValueError, match="without a literal"):
        cw.rule_index(spark.createDataFrame([(i, "r", f"[0-9]{{{i + 1}}}", "c") for i in range(6)], RULES))


def test_rules_that_share_their_beginning_get_other_grams(spark):
    rules = spark.range(500).select(F.col("id").alias("item"), F.lit("r").alias("name"), F.format_string("tenant-key-%04d=[a-z]+", "id").alias("pattern"), F.lit("c").alias("category"))
    index = cw.rule_index(rules)
    assert index.grams.groupBy("gram").count().agg(F.max("count")).first()[0] <= 10


def test_a_text_meets_only_rules_whose_literal_it_holds(spark, texts):
    """Rules that share all grams of eight characters with a text, but not the whole literal, are not tried on it."""
    words = [f"ofthing{a}{b}{c}" for a in "abcd" for b in "abcd" for c in "abcd"]
    rules = spark.createDataFrame([(i, w, f" {w}[.,]", "custom") for i, w in enumerate(words)] + [(99, "é", "é<Ü>é!", "custom"), (100, "s", "abÇ:", "custom")], RULES)
    index = cw.rule_index(rules)
    docs = texts("see ofthingaab, so", "Ofthing ofthingddd; É<ü>é! É<Ü>é! x abç: aBÇ: ", " é<Ü>é", "!", "", None)
    met = {r.doc_id: len(r["__cw_met"]) for r in index.attach(docs).collect()}
    assert met == {0: 1, 1: 2, 2: 0, 3: 0, 4: 0, 5: 0}
    assert sorted(r.order for r in index.rules.select("order").collect()) == list(range(66))
    usable, _ = cw.usable_rules(rules)
    key = lambda df: sorted(map(tuple, df.select("doc_id", "rule_id", "column").collect()))
    assert key(cw.findings(docs, rules=index)) == key(cw.findings(docs, custom=usable))
