"""Ordered rule sets over a code: the first rule that matches gives the label."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A label and the tests that earn it; any test suffices.

    ``prefixes`` start the code, ``exact`` equal it, ``span`` = (low, high) bounds the code's
    leading characters as text, both ends included.
    """

    label: str
    prefixes: Sequence[str] = ()
    exact: Sequence[str] = ()
    span: tuple[str, str] | None = None

    def test(self, code: Column) -> Column:
        lengths = sorted({len(p) for p in self.prefixes})
        tests = [
            F.substring(code, 1, n).isin([p for p in self.prefixes if len(p) == n])
            for n in lengths]
        if self.exact:
            tests.append(code.isin(*self.exact))
        if self.span:
            low, high = self.span
            tests.append(F.substring(code, 1, len(low)).between(low, high))
        return reduce(or_, tests)


@dataclass(frozen=True)
class RuleSet:
    default: str
    rules: Sequence[Rule] = field(default_factory=tuple)

    def _case(self, code: Column, strip_dots: bool, results: Sequence, default) -> Column:
        if strip_dots:
            code = F.translate(code, ".", "")
        chain = F
        for rule, result in zip(self.rules, results):
            chain = chain.when(rule.test(code), result)
        return chain.otherwise(default)

    def label(self, code: Column, strip_dots: bool = False) -> Column:
        """The label of ``code`` as one CASE expression."""
        return self._case(
            code, strip_dots, [F.lit(r.label) for r in self.rules], F.lit(self.default))

    def number(self, code: Column, strip_dots: bool = False) -> Column:
        """The 1-based number of the rule that gives the label, 0 for the default."""
        numbers = [F.lit(i + 1).cast("tinyint") for i in range(len(self.rules))]
        return self._case(code, strip_dots, numbers, F.lit(0).cast("tinyint"))

    def number_of(self, label: str) -> int:
        return [r.label for r in self.rules].index(label) + 1

    def shadowed(self) -> list[tuple[str, str]]:
        """Prefixes that can never match since an earlier rule's prefix covers them."""
        found, seen = [], []
        for rule in self.rules:
            found += [(rule.label, p) for p in rule.prefixes if p.startswith(tuple(seen))]
            seen += rule.prefixes
        return found


# Code lists, branch order and labels.
ONCOLOGY = RuleSet("no oncology", (
    Rule("oncology", exact=(
        "Z12.11", "R11.0", "R11.2", "R53.0", "R53.1", "R53.81", "R53.83", "G93.3", "E86.0",
        "D61.818", "D61.9", "D64.0", "D64.1", "D64.2", "D64.3", "D64.81",
        "C82.50", "C82.59", "C84.90", "C84.99", "C84.A0", "C84.A9", "C84.Z0", "C84.Z9",
        "C85.10", "C85.19", "C85.20", "C85.29", "C85.80", "C85.89", "C85.90", "C85.99", "C86.4",
        "C78.00", "C78.01", "C78.02", "D03.4", "C50.911", "C50.912", "C50.919", "C55",
        "C56.1", "C56.2", "C56.9", "C18.9", "C43.4", "C44.01",
        "C4A.0", "C4A.10", "C4A.11", "C4A.12", "C4A.20", "C4A.21", "C4A.22",
        "C4A.30", "C4A.31", "C4A.39", "C73", "C74.00", "C74.01", "C74.02",
        "C74.10", "C74.11", "C74.12", "C74.90", "C74.91", "C74.92")),
))

PAIN = RuleSet("No Pain", (
    Rule("pain, unspecified", ("R52",)),
    Rule("acute and chronic pain, not elsewhere classified", ("G89",)),
    Rule("abdomen pain", ("R10",)),
    Rule("back pain", ("M549", "M545")),
    Rule("kidney stones", ("N200",)),
    Rule("ankle/foot injuries", span=("S90", "S99")),
    Rule("breast pain", ("N644",)),
    Rule("chest pain", span=("R071", "R079")),
    Rule("ear pain", ("H920",)),
    Rule("eye pain", ("H571",)),
    Rule("headache", ("R51",)),
    Rule("migrane", ("G43909", "G43919", "G43911")),
    Rule("joint pain", ("M255",)),
    Rule("limb pain", ("M796",)),
    Rule("pelvic and perineal pain", ("R102",)),
    Rule("shoulder pain", ("M2551",)),
    Rule("spine pain", ("M54",)),
    Rule("throat pain", ("R070",)),
    Rule("tongue pain", ("K146",)),
    Rule("tooth pain", ("K088",)),
    Rule("renal colic", ("N23",)),
    Rule("pain disorders exclusively related to psychological factors", ("F4541",)),
))

DEPRESSION = RuleSet("No Depression", (
    Rule("Major depressive disorder, single episode", ("F32",)),
    Rule("Major depressive disorder, recurrent", ("F33",)),
))

DISEASE = RuleSet("not a core disease", (
    Rule("diabetes", ("Z794", "E08", "E09", "E10", "E11", "E13")),
    Rule("hf", (
        "39891", "40201", "40211", "40291", "40401", "40403", "40411", "40413", "40491", "40493",
        "42821", "42822", "42823", "42831", "42832", "42833", "42841", "42842", "42843",
        "I0981", "I5020", "I5021", "I5022", "I5023", "I5030", "I5031", "I5032", "I5033",
        "I5040", "I5041", "I5042", "I5043",
        "4281", "4282", "4283", "4284", "4289", "I110", "I130", "I132", "I501", "I509")),
    Rule("ischemic hd", ("I25",)),
    Rule("kidney disease", ("N17", "N18", "N19")),
    Rule("osteoporosis", ("M80", "M81", "M82")),
    Rule("copd", ("J44",)),
    Rule("stroke", ("I64", "I694", "I619", "I639")),
))
