"""Regular expressions as users write them: whether they are any, and in the spelling of the library that runs them."""

from __future__ import annotations

import re

from pyspark.errors import IllegalArgumentException
from pyspark.sql import SparkSession

# What an escaped letter may be followed by to keep its meaning; other escaped letters stand for themselves.
_KEPT = re.compile(r"[dDwWsSBtnrf]|b|x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|[pP]\{[A-Za-z_=]+\}|[1-9][0-9]*")
_QUANTIFIER = re.compile(r"\{[0-9]+(?:,[0-9]*)?\}")
_NAME = re.compile(r"\(\?<([A-Za-z_$][A-Za-z0-9_$]*)>")
_NAMED = re.compile(r"k<([A-Za-z_$][A-Za-z0-9_$]*)>")


def compiles(spark: SparkSession, pattern: str) -> bool:
    """Whether the regular expression is valid, asked of the library that will run it."""
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException:
        return False
    return True


def respelt(pattern: str) -> str:
    """A pattern in JavaScript's spelling as one for the library that runs it.

    Braces that repeat nothing, brackets and ampersands in classes, and escaped letters without a meaning stand for
    themselves; ``[^]`` is any character and ``[]`` none; ``\\u{...}``, ``\\0``, ``\\v``, ``[\\b]`` and control letters are
    written out; names of groups lose what other libraries do not allow in them.
    """
    out: list[str] = []
    names: dict[str, str] = {}
    at, in_class = 0, False

    def name(own: str) -> str:
        plain = re.sub("[^A-Za-z0-9]", "", own)
        if plain == own:
            return own
        return names.setdefault(own, f"g{len(names)}{plain}")

    def escaped() -> int:
        """Add the escape that begins here; its length."""
        rest = pattern[at + 1 :]
        point = re.match(r"u\{([0-9A-Fa-f]{1,6})\}", rest)
        named = _NAMED.match(rest)
        control = re.match("c([A-Za-z])", rest)
        kept = _KEPT.match(rest)
        if point:
            out.append(f"\\x{{{point[1]}}}")
            return 1 + point.end()
        if named and not in_class:
            out.append(f"\\k<{name(named[1])}>")
            return 1 + named.end()
        if control:
            out.append(f"\\x{ord(control[1].upper()) - 64:02x}")
            return 3
        if re.match("0(?![0-9])|v", rest) or (in_class and rest[:1] == "b"):
            out.append({"0": r"\x00", "v": r"\x0b", "b": r"\x08"}[rest[0]])
            return 2
        if kept:
            out.append("\\" + kept[0])
            return 1 + kept.end()
        out.append(rest[:1] if rest[:1].isalpha() else pattern[at : at + 2])
        return 2

    while at < len(pattern):
        char = pattern[at]
        group = _NAME.match(pattern, at)
        repeat = _QUANTIFIER.match(pattern, at)
        if char == "\\":
            at += escaped()
            continue
        if in_class:
            in_class = char != "]"
            out.append("\\" + char if char == "[" or pattern[at : at + 2] == "&&" else char)
        elif pattern.startswith("[^]", at):
            out.append(r"[\s\S]")
            at += 2
        elif pattern.startswith("[]", at):
            out.append("(?!)")
            at += 1
        elif char == "[":
            in_class = True
            out.append("[^" if pattern[at + 1 : at + 2] == "^" else "[")
            at += len(out[-1]) - 1
        elif group:
            out.append(f"(?<{name(group[1])}>")
            at = group.end() - 1
        elif repeat:
            out.append(repeat[0])
            at = repeat.end() - 1
        else:
            out.append("\\" + char if char in "{}]" else char)
        at += 1
    return "".join(out)


def runnable(spark: SparkSession, pattern: str) -> str | None:
    """The pattern, respelt only if it is not valid as it stands; null if it is not valid either way."""
    if compiles(spark, pattern):
        return pattern
    other = respelt(pattern)
    return other if compiles(spark, other) else None
