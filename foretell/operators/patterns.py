"""Many patterns over many texts in one pass: an Aho-Corasick automaton over what every match must contain.

A set of patterns becomes one automaton of literals; a text is read once, whatever the number of patterns, and only patterns whose literal it holds are tried as regular expressions.  Texts are made distinct first and go through the automaton in Arrow batches where they lie.  A pattern table that grows with the data is cut into lots of at most MOST patterns, each of which is one automaton and one pass, so what is sent to the tasks has a bounded size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretell.functions.subjects import NOT_POLITICAL, POLITICAL_WORDS

#: Patterns of one automaton.
MOST = 200_000


def required(pattern: str) -> set[str] | None:
    """Literals, case-folded, of which every match of a pattern holds one; None if there is no telling."""
    return _best(_literals(re._parser.parse(pattern, re.IGNORECASE)))


def _best(sets: list[set[str]]) -> set[str] | None:
    """The set whose shortest literal is longest."""
    return max(sets, key=lambda s: (min(map(len, s)), -len(s)), default=None)


def _literals(parsed) -> list[set[str]]:
    """Sets of literals of each of which a match holds one."""
    found, run = [], ""
    for op, value in parsed:
        name = str(op)
        if name == "LITERAL":
            run += chr(value).casefold()
            continue
        if run:
            found.append({run})
            run = ""
        if name == "SUBPATTERN":
            found += _literals(value[-1])
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and value[0] > 0:
            found += _literals(value[2])
        elif name == "BRANCH":
            each = [_best(_literals(b)) for b in value[1]]
            if all(each):
                found.append(set().union(*each))
    return [*found, {run}] if run else found


class Patterns:
    """Regular expressions without regard to case, or plain substrings, by number."""

    def __init__(self, patterns: list[str], plain: bool = False):
        self.patterns, self.plain = patterns, plain
        anchors: dict[str, list[int]] = {}
        self.always: list[int] = []
        for k, p in enumerate(patterns):
            for literal in ({p} if plain else required(p)) or []:
                anchors.setdefault(literal, []).append(k)
            if not plain and not required(p):
                self.always.append(k)
        self.anchors, self._ready = anchors, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_ready": None}

    def hits(self, text: str) -> list[int]:
        """The patterns that a text matches, ascending."""
        if self._ready is None:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for literal, numbers in self.anchors.items():
                automaton.add_word(literal, numbers)
            if self.anchors:
                automaton.make_automaton()
            self._ready = automaton, None if self.plain else [re.compile(p, re.IGNORECASE) for p in self.patterns]
        automaton, rules = self._ready
        if self.plain:
            return sorted({k for _, numbers in automaton.iter(text) for k in numbers}) if self.anchors else []
        if text.isascii():  # beyond ASCII, letters can equal others without regard to case and not case-folded
            maybe = {*self.always, *(k for _, numbers in (automaton.iter(text.casefold()) if self.anchors else []) for k in numbers)}
        else:
            maybe = range(len(rules))
        return sorted(k for k in maybe if rules[k].search(text))


def _found(texts: DataFrame, text: str, patterns: Patterns, first: bool) -> DataFrame:
    sent = texts.sparkSession.sparkContext.broadcast(patterns)  # at most MOST patterns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [(t, k) for t in b.column(0).to_pylist() for k in sent.value.hits(t)[: 1 if first else None]]
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in pairs], pa.string()), pa.array([k for _, k in pairs], pa.int32())], [text, "number"])

    return texts.mapInArrow(run, f"`{text}` string, number int")


def matches(df: DataFrame, text: str, patterns: list[str], first: bool = False) -> DataFrame:
    """text, number: every distinct text of a column with each pattern (by its place in the list) that it matches, or only the first."""
    texts = df.filter(F.col(text).isNotNull()).select(text).distinct()
    return _found(texts, text, Patterns(patterns), first)


def substrings(df: DataFrame, text: str, table: DataFrame, pattern: str, most: int = MOST) -> DataFrame:
    """text, pattern: every distinct text of a column with each distinct value of table's column `pattern` that it contains (empty ones and nulls aside), with regard to case."""
    texts = df.filter(F.col(text).isNotNull()).select(text).distinct()
    wanted = table.filter(F.col(pattern) != "").select(F.col(pattern).alias("_p")).distinct()
    lots, out = max(1, -(-wanted.count() // most)), None
    for lot in range(lots):
        own = [r["_p"] for r in wanted.filter(F.pmod(F.xxhash64("_p"), F.lit(lots)) == lot).collect()]  # about `most` at most
        names = df.sparkSession.createDataFrame([*enumerate(own)], "number int, pattern string")
        found = _found(texts, text, Patterns(own, plain=True), False).join(F.broadcast(names), "number").select(text, F.col("pattern").alias(pattern))
        out = found if out is None else out.unionByName(found)
    return out


def not_political(df: DataFrame, question: str) -> DataFrame:
    """question, reason: the distinct questions that are left out, with the first reason.  Those that hold a political word are kept, whatever else they say."""
    open_ = df.filter(~F.col(question).rlike(rf"(?i)\b({'|'.join(POLITICAL_WORDS)})\b"))
    reasons = F.array(*[F.lit(r) for _, r in NOT_POLITICAL])
    return matches(open_, question, [p for p, _ in NOT_POLITICAL], first=True).select(question, F.get(reasons, F.col("number")).alias("reason"))
