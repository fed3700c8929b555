"""Finding secrets in a text column.

Everything here is a narrow projection: no shuffle, no Python worker.  The work is staged so that the
common case (a text without secrets) costs little:

1. ``gate``: one pass over the text looks for the literals of all rules at once.
2. ``hits``: only where the gate is open, which rules match the text?
3. ``scan``: only for texts with a hit, cut the text into units (lines) and, per unit, extract the
   matches of the rules that hit, place them by offset and merge overlapping ones.

Rules are applied line by line, so the cost of placing and merging depends on the length of a line, not
of the document.  In document scope the match of a multi-line rule, such as a private key block, forms one
unit together with the rest of its first and last line; in line scope only its marker line is seen.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence
from functools import lru_cache, reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bind import let, walk
from ..functions.crypto import fingerprint
from ..functions.text import LINE_BREAK, count_newlines, shannon_bits
from .catalogue import (
    BUILTIN_RULES,
    INLINE_PREFIX,
    MASK_PREFIX,
    VAULT_PREFIX,
    Rule,
    gate_pattern,
    rule_set,
)
from .score import confidence_of, context_of, entropy_of, features_of, risk_of

if TYPE_CHECKING:
    from .rule_index import RuleIndex

# Beyond this many custom rules their patterns travel as one array literal instead of one expression each.
COMPILED_LIMIT = 200

CHUNK_SIZE = 50

# Inside texts with key blocks: an escape character (a Unicode noncharacter, hardly ever in a text), what
# stands for a line feed in a block, and what stands for the escape character itself.
_ESCAPE = "\ufdd0"
_BLOCK_FEED = _ESCAPE + "0"
_ESCAPED = _ESCAPE + "1"

# Start and end of the value, start of the whole match, the rule, and the value unless spans were merged.
_SPAN = "struct<s:int,e:int,m:int,prio:int,v:string>"
_SPANS = f"array<{_SPAN}>"
_FOUND = (
    "array<struct<line:int,column:int,s:int,e:int,rule_id:string,category:string,value:string,"
    "context_from:int,base:double,severity:double>>"
)

FINDING_FIELDS = (
    "ordinal", "line", "column", "rule_id", "category", "value", "regex_match", "entropy_score",
    "context_score", "confidence", "risk", "features",
)


# One of our tokens from start to end (a rule may leave out the closing bracket), and nothing else.
_OWN_TOKEN = (
    rf"\A(?:{re.escape(MASK_PREFIX)}[A-Za-z0-9_-]+\]?|{re.escape(INLINE_PREFIX)}[A-Za-z0-9+/=_-]*(?::[A-Za-z0-9+/=_-]*)?"
    rf"|(?i:{re.escape(VAULT_PREFIX)}[0-9a-f-]*))\z"
)

# Parts of a pattern that look at what stands beside a match, or at where a line or text ends.
BOUND = r"[\^$]|\\[AzZGbB]|\(\?<?[=!]"


def _gates(text: Column, rules: Sequence[Rule]) -> Column:
    """Does the text hold an anchor of any case-sensitive rule; of any rule that ignores case?

    One pass over the text asks for both; only where that succeeds they are told apart.
    """
    anchored = [r for r in rules if r.anchors]
    no, never = F.lit(False), F.struct(F.lit(False).alias("exact"), F.lit(False).alias("fold"))

    def gate(fold: bool) -> Column:
        group = [r for r in anchored if r.fold is fold]
        return text.rlike(gate_pattern(group)) if group else no

    if not anchored:
        return never
    both = F.struct(gate(False).alias("exact"), gate(True).alias("fold"))
    return F.when(text.rlike(gate_pattern(anchored)), both).otherwise(never)


def _flags(text: Column, rules: Sequence[Rule], gates: Column) -> Column:
    """Which rules match the text; null for a null text."""

    def flag(rule: Rule) -> Column:
        if rule.custom and re.search(BOUND, rule.pattern):
            # What holds at the ends of a line need not hold in the text around it: only the lines can tell.
            return F.lit(True)
        matched = text.rlike(rule.pattern)
        if not rule.anchors:
            return matched
        # The rule's own anchors first: that is several times faster than the pattern itself.
        own = text.rlike(gate_pattern([rule]))
        return gates["fold" if rule.fold else "exact"] & own & matched

    return F.when(text.isNotNull(), F.array(*[flag(rule) for rule in rules]))


# Rules as data; those that look at what stands beside a match can only be told by lines.
RULE_DATA = (
    "array<struct<prio:int,name:string,category:string,pattern:string,group:int,base:double,"
    "severity:double,min_entropy:double,bound:boolean>>"
)

# Priorities of built-in rules where custom ones have numbers of their own.
_BUILTIN_FIRST = 1 << 30


def _as_data(rules: Sequence[Rule], orders: Sequence[int] | None = None) -> Column:
    """The rules as one array literal (folded once by the optimizer)."""
    rows = [
        {
            "prio": i if orders is None else orders[i],
            "name": r.name,
            "category": r.category,
            "pattern": r.pattern,
            "group": r.group,
            "base": r.base,
            "severity": r.severity,
            "min_entropy": r.min_entropy,
            "bound": re.search(BOUND, r.pattern) is not None,
        }
        for i, r in enumerate(rules)
    ]
    return F.from_json(F.lit(json.dumps(rows)), RULE_DATA)


def _match(text: Column, rule: Column) -> Column:
    """All matches of one rule in a text, with the text between them."""

    def parts(full: Column, gaps: Column) -> Column:
        # A split drops the empty piece before an empty match at the very start; put it back.
        dropped = F.size(gaps) == F.size(full)
        captured = F.regexp_extract_all(text, rule["pattern"], rule["group"])
        return F.struct(
            rule["prio"].alias("prio"),
            rule["min_entropy"].alias("least_bits"),
            full.alias("full"),
            F.when(rule["group"] == 0, full).otherwise(captured).alias("val"),
            F.when(dropped, F.concat(F.array(F.lit("")), gaps)).otherwise(gaps).alias("gaps"),
        )

    whole = F.regexp_extract_all(text, rule["pattern"], F.lit(0))
    return let(whole, lambda full: let(F.split(text, rule["pattern"], -1), lambda gaps: parts(full, gaps)))


def _place(match: Column) -> Column:
    """Offsets of the matches of one rule: start and end of the value, start of the whole match."""
    steps = F.transform(
        match["full"],
        lambda full, k: F.struct(
            F.length(F.get(match["gaps"], k)).alias("gap"),
            F.length(full).alias("size"),
            F.get(match["val"], k).alias("v"),
        ),
    )
    least_bits = match["least_bits"]

    def keep(value: Column) -> Column:
        masked = value.rlike(_OWN_TOKEN)
        random = F.when(least_bits > 0, shannon_bits(value) >= least_bits).otherwise(F.lit(True))
        return (value != "") & ~masked & random

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        begin = at + x["gap"]
        end = begin + x["size"]
        span = F.struct(
            (end - F.length(x["v"])).alias("s"),
            end.alias("e"),
            begin.alias("m"),
            match["prio"].alias("prio"),
            x["v"].alias("v"),
        )
        return end, F.when(keep(x["v"]), F.array(span)).otherwise(F.array().cast(_SPANS))

    return let(steps, lambda items: walk(items, F.lit(0), _SPANS, step)["out"])


def _merge(spans: Column) -> Column:
    """Union of overlapping spans; the best rule (lowest priority number) names the union."""

    def join(last: Column, x: Column) -> Column:
        same = (last["s"] == x["s"]) & (last["e"] == x["e"])
        return F.struct(
            last["s"].alias("s"),
            F.greatest(last["e"], x["e"]).alias("e"),
            F.least(last["m"], x["m"]).alias("m"),
            F.least(last["prio"], x["prio"]).alias("prio"),
            F.when(same, last["v"]).alias("v"),
        )

    def step(last: Column, x: Column) -> tuple[Column, Column]:
        overlaps = x["s"] < last["e"]
        done = F.when(overlaps, F.array().cast(_SPANS)).otherwise(F.array(last))
        return F.when(overlaps, join(last, x)).otherwise(x), done

    # Starts from a span before the text, which is dropped again.
    none = F.struct(*[F.lit(-1).alias(name) for name in ("s", "e", "m", "prio")], F.lit(None).cast("string").alias("v"))
    merged = let(F.array_sort(spans), lambda found: walk(found, none.cast(_SPAN), _SPANS, step))
    whole = let(merged, lambda x: F.concat(x["out"], F.array(x["carry"])))
    return F.filter(whole, lambda span: span["s"] >= 0)


def _describe(text: Column, span: Column, many_lines: Column, rule_of: Callable[[Column], Column]) -> Column:
    """One finding inside a unit; ``line`` is still relative to the unit (0 = its first line)."""

    def finding(x: Column) -> Column:
        rule, value = x["rule"], x["value"]
        before = F.substring(text, F.lit(1), span["s"])
        open_ssh = (rule["category"] == "private_key") & value.startswith("-----BEGIN OPENSSH")
        in_line = F.when(many_lines, F.length(F.substring_index(before, "\n", -1))).otherwise(span["s"])
        return F.struct(
            F.when(many_lines, count_newlines(before)).otherwise(F.lit(0)).alias("line"),
            (in_line + 1).alias("column"),
            span["s"].alias("s"),
            span["e"].alias("e"),
            rule["name"].alias("rule_id"),
            F.when(open_ssh, F.lit("ssh")).otherwise(rule["category"]).alias("category"),
            value.alias("value"),
            # Where the text that counts as context begins: scores are worked out only when asked for.
            F.greatest(span["m"] - 40, F.lit(0)).alias("context_from"),
            rule["base"].alias("base"),
            rule["severity"].alias("severity"),
        )

    parts = F.struct(
        rule_of(span["prio"]).alias("rule"),
        F.coalesce(span["v"], F.substring(text, span["s"] + 1, span["e"] - span["s"])).alias("value"),
    )
    return let(parts, finding)


def _units(text: Column, blocks: Sequence[tuple[Column, str]]) -> Column:
    """Lines of the text, with each match of the multi-line patterns kept inside one unit.

    ``blocks`` are the patterns, each with whether it matches the text at all.
    """

    def swap(value: Column, old: str, new: str) -> Column:
        return F.replace(value, F.lit(old), F.lit(new))

    def folded(escaped: Column, block: tuple[Column, str]) -> Column:
        some, pattern = block

        def fold(t: Column) -> Column:
            pieces = F.zip_with(
                F.split(t, pattern, -1),
                F.regexp_extract_all(t, F.lit(pattern), 0),
                lambda gap, found: F.concat(gap, F.coalesce(swap(found, "\n", _BLOCK_FEED), F.lit(""))),
            )
            return F.when(some, F.array_join(pieces, "")).otherwise(t)

        return let(escaped, fold)

    lines = F.split(text, LINE_BREAK, -1)
    if not blocks:
        return lines
    units = F.transform(
        F.split(reduce(folded, blocks, swap(text, _ESCAPE, _ESCAPED)), LINE_BREAK, -1),
        lambda u: swap(swap(u, _BLOCK_FEED, "\n"), _ESCAPED, _ESCAPE),
    )
    return F.when(reduce(lambda x, y: x | y, [some for some, _ in blocks]), units).otherwise(lines)


def _chunks(rules: Sequence[Rule]) -> list[range]:
    """Neighbouring rules whose patterns can be tried together as alternatives of one pattern."""
    chunks: list[range] = []
    for i, rule in enumerate(rules):
        # References to groups and named groups do not survive being joined.
        alone = re.search(r"\\[1-9]|\\k<|\(\?<[A-Za-z]", rule.pattern) is not None
        last = chunks[-1] if chunks else range(0)
        joins = not alone and last and len(last) < CHUNK_SIZE and last.step == 1
        if joins:
            chunks[-1] = range(last.start, i + 1)
        else:
            # The step only marks a chunk that takes no more rules.
            chunks.append(range(i, i + 1, 2 if alone else 1))
    return chunks


def scan_of(
    text: Column,
    rules: Sequence[Rule] = BUILTIN_RULES,
    scope: str = "document",
    met: Column | None = None,
    orders: Sequence[int] = (),
) -> Column:
    """Units of a text with their findings, ``array<struct<text, found>>``; null for a text without hits.

    ``met`` are more custom rules as data, other ones for every text, which rank by their numbers among the custom
    rules of ``rules``, whose numbers ``orders`` gives.
    """
    if scope not in ("document", "line"):
        raise ValueError(f"scope must be 'document' or 'line', not {scope!r}")
    custom = [r for r in rules if r.custom]
    indexed = met is not None
    bulk = custom if indexed or len(custom) > COMPILED_LIMIT else []
    if list(rules[: len(bulk)]) != bulk:
        raise ValueError("custom rules must come before the built-in ones")
    single = list(rules)[len(bulk) :]
    numbers = [*orders, *range(_BUILTIN_FIRST, _BUILTIN_FIRST + len(single))] if indexed else None
    data = _as_data(rules, numbers)

    def bulk_hits(part: Column, candidates: Column) -> Column:
        return F.filter(candidates, lambda rule: F.rlike(part, rule["pattern"]))

    def in_text(candidates: Column) -> Column:
        return F.filter(candidates, lambda rule: rule["bound"] | F.rlike(text, rule["pattern"]))

    def bulk_of(chunk: range) -> Column:
        own = F.slice(data, chunk[0] + 1, len(chunk))
        if any(re.search(BOUND, bulk[i].pattern) for i in chunk):
            return in_text(own)
        either = "|".join(f"(?:{bulk[i].pattern})" for i in chunk)
        some = text.rlike(either if len(chunk) > 1 else bulk[chunk[0]].pattern)
        return F.when(some, bulk_hits(text, own)).otherwise(F.slice(data, 1, 0))

    def rule_of(hits: Column) -> Callable[[Column], Column]:
        """A rule by its priority."""
        if not indexed:
            return lambda prio: F.get(data, prio)
        builtin = F.slice(data, len(bulk) + 1, max(len(single), 1))
        own = lambda prio: F.get(F.filter(hits["bulk"], lambda rule: rule["prio"] == prio), F.lit(0))
        return lambda prio: F.when(prio >= _BUILTIN_FIRST, F.get(builtin, prio - _BUILTIN_FIRST)).otherwise(own(prio))

    anchored = [r for r in single if r.anchors]

    none = F.array().cast("array<int>")

    def matching(unit: Column, hits: Column, with_anchors: bool) -> Column:
        """Numbers of the rules that hit the text and match this unit."""
        numbers = [
            F.when(F.get(hits["one"], F.lit(i)) & unit.rlike(rule.pattern), F.lit(i + len(bulk)))
            for i, rule in enumerate(single)
            if bool(rule.anchors) is with_anchors
        ]
        return F.array_compact(F.array(*numbers)) if numbers else none

    def find(unit: Column, hits: Column) -> Column:
        here = matching(unit, hits, False)
        if anchored:
            # Most lines have no anchor, and one look tells.
            gated = F.when(unit.rlike(gate_pattern(anchored)), matching(unit, hits, True)).otherwise(none)
            here = gated if len(anchored) == len(single) else F.concat(here, gated)
        chosen = F.transform(here, lambda i: F.get(data, i))
        if bulk or indexed:
            chosen = F.concat(bulk_hits(unit, hits["bulk"]), chosen)

        def found(rules_here: Column) -> Column:
            spans = F.flatten(F.transform(rules_here, lambda rule: let(_match(unit, rule), _place)))
            return let(
                F.contains(unit, F.lit("\n")),
                lambda many: F.transform(_merge(spans), lambda span: _describe(unit, span, many, rule_of(hits))),
            )

        return let(chosen, lambda c: F.when(F.size(c) > 0, found(c)).otherwise(F.array().cast(_FOUND)))

    blocks = [rule for rule in rules if rule.multiline] if scope == "document" else []

    def units(hits: Column) -> Column:
        def matches(rule: Rule) -> Column:
            return F.get(hits["one"], F.lit(single.index(rule))) if rule in single else text.rlike(rule.pattern)

        return _units(text, [(matches(rule), rule.pattern) for rule in blocks])

    def scan(hits: Column) -> Column:
        some = F.array_contains(hits["one"], True)
        if bulk or indexed:
            some = some | (F.size(hits["bulk"]) > 0)
        return F.when(
            some, F.transform(units(hits), lambda u: F.struct(u.alias("text"), find(u, hits).alias("found")))
        )

    def hits(gates: Column) -> Column:
        fields = [_flags(text, single, gates).alias("one")]
        if bulk or indexed:
            chunks = [bulk_of(chunk) for chunk in _chunks(bulk)] + ([in_text(met)] if indexed else [])
            fields.append(F.when(text.isNotNull(), F.flatten(F.array(*chunks))).alias("bulk"))
        return F.struct(*fields)

    return let(_gates(text, single), lambda gates: let(hits(gates), scan))


def _numbered(scan: Column) -> Column:
    """Findings of a document in text order, with document-wide line number and ordinal, and what their scores need."""
    # Units of more than one line shift the numbers of everything after them.
    long_units = F.filter(
        F.transform(scan, lambda x, i: F.struct(i.alias("i"), count_newlines(x["text"]).alias("n"))),
        lambda x: x["n"] > 0,
    )

    def first_line(shifts: Column, i: Column) -> Column:
        before = F.filter(shifts, lambda x: x["i"] < i)
        return i + 1 + F.aggregate(before, F.lit(0), lambda total, x: total + x["n"])

    def placed(text: Column, f: Column, line: Column) -> Column:
        window = F.substring(text, f["context_from"] + 1, f["s"] - f["context_from"])
        return F.struct(line.alias("line"), f.alias("f"), window.alias("window"))

    def of_unit(shifts: Column, x: Column, i: Column) -> Column:
        return F.transform(x["found"], lambda f: placed(x["text"], f, first_line(shifts, i) + f["line"]))

    def finish(x: Column, k: Column) -> Column:
        f = x["f"]
        return F.struct(
            (k + 1).alias("ordinal"),
            x["line"].alias("line"),
            *[f[name].alias(name) for name in ("column", "rule_id", "category", "value", "base", "severity")],
            x["window"].alias("window"),
        )

    def all_of(shifts: Column) -> Column:
        return F.flatten(F.transform(scan, lambda x, i: of_unit(shifts, x, i)))

    return let(long_units, lambda shifts: F.transform(all_of(shifts), finish))


def _scored(found: Column) -> Column:
    """A numbered finding in the canonical schema."""

    def rated(x: Column) -> Column:
        f = x["f"]
        return x.withField("confidence", confidence_of(f["value"], f["category"], f["base"], x["entropy"], x["context"]))

    def finish(x: Column) -> Column:
        f = x["f"]
        return F.struct(
            *[f[name].alias(name) for name in ("ordinal", "line", "column", "rule_id", "category", "value")],
            F.lit(True).alias("regex_match"),
            x["entropy"].alias("entropy_score"),
            x["context"].alias("context_score"),
            x["confidence"].alias("confidence"),
            risk_of(f["severity"], x["confidence"]).alias("risk"),
            features_of(F.lit(True), x["entropy"], x["context"]).alias("features"),
        )

    scores = F.struct(
        found.alias("f"), entropy_of(found["value"]).alias("entropy"), context_of(found["window"]).alias("context")
    )
    return let(let(scores, rated), finish)


_EMPTY = (
    "array<struct<ordinal:int,line:int,column:int,rule_id:string,category:string,value:string,"
    "regex_match:boolean,entropy_score:double,context_score:double,confidence:double,risk:double,"
    "features:array<string>>>"
)


def finding_list(scan: Column, min_confidence: float = 0.0) -> Column:
    found = F.when(scan.isNotNull(), F.transform(_numbered(scan), _scored)).otherwise(F.array().cast(_EMPTY))
    if min_confidence > 0:
        found = F.filter(found, lambda f: f["confidence"] >= min_confidence)
    return found


def summary_of(found: Column) -> Column:
    """``"<n> finding(s): <category>=<k>, ..."`` sorted by category."""
    names = F.array_sort(F.array_distinct(F.transform(found, lambda f: f["category"])))
    parts = F.transform(
        names,
        lambda name: F.concat_ws(
            "=", name, F.size(F.filter(found, lambda f: f["category"] == name)).cast("string")
        ),
    )
    total = F.concat(F.size(found).cast("string"), F.lit(" finding(s)"))
    return F.when(F.size(found) > 0, F.concat(total, F.lit(": "), F.array_join(parts, ", "))).otherwise(total)


@lru_cache(maxsize=64)
def scan_column(text_col: str, rules: tuple[Rule, ...], scope: str) -> Column:
    """``scan_of`` a named column; kept, because building it takes some hundred calls into the JVM."""
    return let(F.col(text_col), lambda text: scan_of(text, rules, scope))


def found_in(
    text_col: str,
    custom: Sequence[Rule] = (),
    scope: str = "document",
    entropy: bool = False,
    min_confidence: float = 0.0,
) -> Column:
    """The findings of a text column as an array of structs."""
    scan = scan_column(text_col, rule_set(custom, entropy=entropy), scope)
    return let(scan, lambda x: finding_list(x, min_confidence))


def scan_with(
    df: DataFrame, text_col: str, custom: Sequence[Rule], rules: RuleIndex | None, scope: str, entropy: bool
) -> tuple[DataFrame, Column]:
    """A table and the scan of its text column, by the custom rules given or by an indexed table of rules."""
    if rules is None:
        return df, scan_column(text_col, rule_set(custom, entropy=entropy), scope)
    if custom:
        raise ValueError("custom rules stand in the rule table or are given, not both")
    own = rule_set(rules.direct, entropy=entropy)
    met = F.col("__cw_met")
    scan = let(F.col(f"`{text_col}`"), lambda text: scan_of(text, own, scope, met, rules.orders))
    return rules.attach(df, text_col), scan


def detect(
    df: DataFrame,
    text_col: str = "text",
    *,
    custom: Sequence[Rule] = (),
    scope: str = "document",
    entropy: bool = False,
    min_confidence: float = 0.0,
    rules: RuleIndex | None = None,
) -> DataFrame:
    """Per text: its findings, how many, the highest risk and a one-line summary.

    ``rules`` is a table of custom rules of any size, see ``rule_index``.  ``min_confidence`` only narrows this report; masking never filters on confidence.
    """

    def result(found: Column) -> Column:
        risks = F.transform(found, lambda f: f["risk"])
        return F.struct(
            found.alias("findings"),
            F.size(found).alias("n_findings"),
            F.coalesce(F.array_max(risks), F.lit(0.0)).alias("max_risk"),
            summary_of(found).alias("summary"),
        )

    keep = [F.col(f"`{c}`") for c in df.columns]
    rows, scan = scan_with(df, text_col, custom, rules, scope, entropy)
    found = let(scan, lambda x: finding_list(x, min_confidence))
    return rows.select(*keep, let(found, result).alias("__cw")).select(*keep, "__cw.*")


def findings(
    df: DataFrame,
    text_col: str = "text",
    *,
    id_cols: Sequence[str] = ("doc_id",),
    path_col: str | None = None,
    custom: Sequence[Rule] = (),
    scope: str = "document",
    entropy: bool = False,
    min_confidence: float = 0.0,
    rules: RuleIndex | None = None,
) -> DataFrame:
    """One row per finding, in the canonical schema."""
    ids = [F.col(f"`{c}`") for c in id_cols if c != "path"]
    if path_col is None and "path" in id_cols:
        path_col = "path"
    path = F.col(path_col) if path_col else F.lit(None).cast("string")
    scanned, scan = scan_with(df, text_col, custom, rules, scope, entropy)
    # Scores are a column of their own beside what they rest on: where nobody asks for them they are not worked out.
    filtered = min_confidence > 0
    found = let(scan, lambda x: finding_list(x, min_confidence) if filtered else F.when(x.isNotNull(), _numbered(x)))
    # An outer explode: for the plain one the optimizer would test "has findings" in a filter of its own,
    # and so run the detection twice.
    rows = scanned.select(*ids, path.alias("path"), F.explode_outer(found).alias("f")).where(F.col("f").isNotNull())
    scores = F.col("f") if filtered else _scored(F.col("f"))
    scored = rows.select(*ids, F.col("path"), F.col("f"), scores.alias("scores"))
    plain = ("ordinal", "line", "column", "rule_id", "category", "value")
    return scored.select(
        *ids,
        F.col("path"),
        *[F.col(f"{'f' if name in plain else 'scores'}.{name}").alias(name) for name in FINDING_FIELDS],
        fingerprint(F.col("f.value")).alias("fingerprint"),
    )
