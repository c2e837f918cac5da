"""Alias rules: ordered patterns that map a tool's dataset URN to the canonical one.

A short rule list is compiled on the driver into one column expression (``AliasResolver``), so resolving a
URN is a projection: no join, no shuffle and no lookup table to broadcast. That tries every rule on every
name; a long list is kept as a table instead (``RuleIndex``) and joined by the literal text that its rules begin with.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Fixed value: a placeholder such as {name} or {path*}.
_PLACEHOLDER = re.compile(r"\{([a-zA-Z_][a-zA-Z0-9_]*)(\*?)\}")


@dataclass(frozen=True)
class AliasRule:
    """A compiled rule: a Java regex with one group per variable, and the target template."""

    regex: str
    variables: tuple[str, ...]
    canonical: str

    def matches(self, urn: Column) -> Column:
        return urn.rlike(self.regex)

    def replacement(self) -> str:
        """The target as a replacement text of Java, in which a variable is a group and all that could be one is escaped."""
        text, position = "", 0
        for placeholder in _PLACEHOLDER.finditer(self.canonical):
            if placeholder.group(1) in self.variables:
                text += _plain(self.canonical[position : placeholder.start()])
                text += f"${self.variables.index(placeholder.group(1)) + 1}"
                position = placeholder.end()
        return text + _plain(self.canonical[position:])

    def rewrite(self, urn: Column) -> Column:
        parts: list[Column] = []
        position = 0
        for placeholder in _PLACEHOLDER.finditer(self.canonical):
            if placeholder.group(1) not in self.variables:
                continue
            if placeholder.start() > position:
                parts.append(F.lit(self.canonical[position : placeholder.start()]))
            group = self.variables.index(placeholder.group(1)) + 1
            parts.append(F.regexp_extract(urn, self.regex, group))
            position = placeholder.end()
        if position < len(self.canonical):
            parts.append(F.lit(self.canonical[position:]))
        return F.concat(*parts)


def compile_rule(pattern: str, canonical: str) -> AliasRule | None:
    """Compile one pattern; None for an empty or ambiguous one, which is skipped."""
    pattern, canonical = pattern.strip(), canonical.strip()
    if not pattern or not canonical:
        return None
    names = [match.group(1) for match in _PLACEHOLDER.finditer(pattern)]
    if len(set(names)) != len(names):
        return None
    regex, position = "", 0
    for match in _PLACEHOLDER.finditer(pattern):
        regex += _quoted(pattern[position : match.start()])
        regex += r"([^\n]+)" if match.group(2) else r"([^/]+)"
        position = match.end()
    regex += _quoted(pattern[position:])
    return AliasRule(rf"\A{regex}\z", tuple(names), canonical)


def _quoted(literal: str) -> str:
    return re.sub(r"[^A-Za-z0-9_/ ]", lambda m: "\\" + m.group(0) if ord(m.group(0)) < 128 else m.group(0), literal)


def _plain(literal: str) -> str:
    return re.sub(r"[\\$0-9]", lambda m: "\\" + m.group(0), literal)


def literal_start(pattern: str) -> str:
    """The text that every match of a pattern begins with."""
    found = _PLACEHOLDER.search(pattern.strip())
    return pattern.strip()[: found.start()] if found else pattern.strip()


class RuleIndex:
    """Many ordered rules as a table, keyed by their literal beginnings; the first rule that matches wins.

    A name is looked up by its beginnings of the lengths that occur among the rules, so it meets
    only rules that begin as it does, and only these are tried. Distinct names are matched once.
    """

    def __init__(self, spark: SparkSession, rules: Sequence[tuple[str, str]]):
        rows = []
        for number, (pattern, canonical) in enumerate(rules):
            rule = compile_rule(pattern, canonical)
            if rule is not None:
                rows.append((number, literal_start(pattern), rule.regex, rule.replacement()))
        self.lengths = sorted({len(row[1]) for row in rows})
        self.rules = spark.createDataFrame(rows, "number int, beginning string, regex string, replacement string")

    def match(self, names: DataFrame, urn: str = "urn") -> DataFrame:
        """``names`` with ``canonical_urn``, null where no rule applies."""
        asked = names.select(F.col(urn).alias("__urn")).filter("__urn IS NOT NULL").distinct()
        if not self.lengths:
            return names.withColumn("canonical_urn", F.lit(None).cast("string"))
        fitting = F.filter(F.array(*[F.lit(n) for n in self.lengths]), lambda n: n <= F.length("__urn"))
        beginnings = F.explode(F.transform(fitting, lambda n: F.substring(F.col("__urn"), F.lit(1), n))).alias("beginning")
        met = asked.select("__urn", beginnings).join(self.rules, "beginning").filter(F.rlike("__urn", F.col("regex")))
        first = met.groupBy("__urn").agg(F.min(F.struct("number", "regex", "replacement")).alias("rule"))
        named = first.select("__urn", F.regexp_replace("__urn", F.col("rule.regex"), F.col("rule.replacement")).alias("canonical_urn"))
        return names.join(named, F.col(urn) == F.col("__urn"), "left").drop("__urn")

    def resolve(self, names: DataFrame, urn: str = "urn") -> DataFrame:
        """``names`` with ``canonical_urn``, which is the URN itself where no rule applies."""
        return self.match(names, urn).withColumn("canonical_urn", F.coalesce("canonical_urn", F.col(urn)))


class AliasResolver:
    """The ordered rules of one deployment; the first rule that matches wins."""

    def __init__(self, rules: Sequence[tuple[str, str]] = ()):
        compiled = (compile_rule(pattern, canonical) for pattern, canonical in rules)
        self.rules = [rule for rule in compiled if rule is not None]

    def match(self, urn: Column) -> Column:
        """The canonical URN, or null when no rule applies."""
        result: Column | None = None
        for rule in self.rules:
            step = rule.matches(urn)
            result = F.when(step, rule.rewrite(urn)) if result is None else result.when(step, rule.rewrite(urn))
        return F.lit(None).cast("string") if result is None else result

    def resolve(self, urn: Column) -> Column:
        """The canonical URN, or the URN itself when no rule applies."""
        return F.coalesce(self.match(urn), urn)
