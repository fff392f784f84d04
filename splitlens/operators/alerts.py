"""Alert screening by a rule table: a rule is violated where its pattern matches more often than allowed.

A few rules are expressions of one plan. Of many, most match nowhere in a text: the letters that a pattern can't do without
are put in one automaton, which finds in one pass over a text the rules that may match it, and only their patterns
are counted.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    rule_set: str
    name: str
    pattern: str
    most: int = 0
    priority: int = 0


class RuleSet:
    """Active rules, in order."""

    def __init__(self, rules: Iterable[Rule]):
        self.rules = list(rules)

    def sets(self) -> list[str]:
        return sorted({r.rule_set for r in self.rules})

    def choose(self, rule_set: str) -> RuleSet:
        if rule_set not in self.sets():
            raise ValueError(f"no rule set {rule_set}; there are {', '.join(self.sets())}")
        return RuleSet(r for r in self.rules if r.rule_set == rule_set)

    def without(self, name: str) -> RuleSet:
        return RuleSet(r for r in self.rules if r.name != name)

    def at_least(self, priority: int) -> RuleSet:
        return RuleSet(r for r in self.rules if r.priority >= priority)


def rules_from(df: DataFrame) -> RuleSet:
    """Rules of a table with ``rule_set_name, description, smarts, max, priority``: as many rows as rules."""
    return RuleSet(Rule(r.rule_set_name, r.description, r.smarts, int(r.max or 0), int(r.priority or 0)) for r in df.collect())


_CAPITALS = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def needed(pattern: str) -> str | None:
    """The longest run of letters that every match of a pattern has, capitals A to Z made small; None where none is known,
    as for syntax that only the JVM's patterns have."""
    try:
        tree = re._parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return None
    runs, own = [""], ""

    def walk(nodes, folded: bool) -> None:
        nonlocal own
        for op, value in nodes:
            kind = str(op)
            if kind == "LITERAL" and (value < 128 or not folded):
                own += chr(value)
                continue
            if kind == "SUBPATTERN" and not value[1] and not value[2]:
                walk(value[3], folded)
                continue
            if kind == "AT":
                continue
            runs.append(own)
            own = ""
            if kind in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] >= 1:
                walk(value[2], folded)
                runs.append(own)
                own = ""

    walk(tree, bool(tree.state.flags & re.IGNORECASE))
    best = max([*runs, own], key=len)
    return best.translate(_CAPITALS) or None


def may_match(text: Column, rules: RuleSet) -> Column:
    """Numbers of the rules whose pattern may match a text, ascending."""
    letters: dict[str, list[int]] = {}
    always = []
    for i, rule in enumerate(rules.rules):
        literal = needed(rule.pattern)
        always.append(i) if literal is None else letters.setdefault(literal, []).append(i)

    @F.pandas_udf("array<int>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for literal, numbers in letters.items():
            automaton.add_word(literal, numbers)
        if letters:
            automaton.make_automaton()

        def of(text: str | None) -> list[int]:
            hits = set(always)
            if text and letters:
                for _, numbers in automaton.iter(text.translate(_CAPITALS)):
                    hits.update(numbers)
            return sorted(hits)

        for batch in batches:
            yield batch.map(of, na_action=None).astype(object)

    return found(text)


FEW = 24  # rules that are expressions


def violations(text: Column, rules: RuleSet) -> Column:
    """Names of violated rules, in order. Patterns are regular expressions, counted by the JVM."""
    if len(rules.rules) > FEW:
        of = lambda values: F.array(*[F.lit(v) for v in values])
        names, patterns, most = of([r.name for r in rules.rules]), of([r.pattern for r in rules.rules]), of([r.most for r in rules.rules])
        count = lambda i: F.regexp_count(F.coalesce(text, F.lit("")), F.get(patterns, i))
        return F.filter(F.transform(may_match(text, rules), lambda i: F.when(count(i) > F.get(most, i), F.get(names, i))), lambda x: x.isNotNull())
    found = [F.when(F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r.pattern)) > r.most, F.lit(r.name)) for r in rules.rules]
    return F.filter(F.array(*found), lambda x: x.isNotNull()) if found else F.array().cast("array<string>")


def screen(df: DataFrame, text: str, rules: RuleSet) -> DataFrame:
    """Adds ``warnings``, ``n_warnings`` and ``first_warning``."""
    out = df.withColumn("warnings", violations(F.col(text), rules))
    return out.withColumn("n_warnings", F.size("warnings")).withColumn("first_warning", F.get("warnings", F.lit(0)))


def alert_counts(screened: DataFrame) -> DataFrame:
    return screened.select(F.explode("warnings").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
