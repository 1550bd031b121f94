"""Many patterns over the lines of messages in one pass.

Most patterns can only match where some fixed text of theirs stands. These texts make one automaton, which is led
over each line once, whatever the number of patterns; only the pairs of line and pattern that it finds are then matched
with the pattern itself, by Spark's own engine. Patterns without such a text are matched with each line.

The texts are looked for without regard to case (A-Z), so that they are a condition for patterns with and without
case alike; what the automaton finds is a superset and decides nothing.

Defined results: indices follow the list of patterns, ascending, each once; a pattern that isn't `usable` matches nothing; the
empty pattern matches each line; null lines and lists of lines match nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from re import _constants as ops, _parser as parser  # how a pattern is built; checked by tests over all kinds

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.text import ascii_lower
from .filters import body_matches, capped, usable

#: Longer texts are cut: a part of what must be there must be there as well.
LONGEST = 32
#: At most so many texts one of which must be there; beyond it the pattern is matched with each line.
WIDEST = 64
#: What the two engines read differently: sets within sets and intersections, octal and vertical escapes, names, Unicode case.
UNSURE = re.compile(r"\[\^?\]|\[[^\]]*\[|&&|\\[0-9vN]|\(\?[a-zA-Z-]*[uUaLx]")
UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def _of(tree) -> list[frozenset[str]]:
    """Conditions of a sequence: of each set one text at least must be in whatever matches."""
    found, run = [], ""
    for op, value in [*tree, (None, None)]:
        if op is ops.LITERAL:
            run += chr(value)
            continue
        if run:
            found.append(frozenset([run]))
        run = ""
        if op is ops.SUBPATTERN:
            found += _of(value[3])
        elif op is ops.ATOMIC_GROUP:
            found += _of(value)
        elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT, ops.POSSESSIVE_REPEAT) and value[0] >= 1:
            found += _of(value[2])
        elif op is ops.BRANCH:
            own = [_best(_of(b)) for b in value[1]]
            if all(own):
                found.append(frozenset().union(*own))
    return found


def _best(conditions: list[frozenset[str]]) -> frozenset[str]:
    """The condition whose shortest text is longest, then that of fewest texts; none: the empty set."""
    fit = [c for c in conditions if len(c) <= WIDEST]
    return max(fit, key=lambda c: (min(map(len, c)), -len(c)), default=frozenset())


def required(pattern: str) -> frozenset[str]:
    """Texts in lower case (A-Z) of which a line that matches has one at least; empty if none is known."""
    try:
        tree = () if UNSURE.search(pattern) else parser.parse(pattern)
    except re.error:  # a form that Python doesn't know
        return frozenset()
    return frozenset(t[:LONGEST].translate(UPPER) for t in _best(_of(tree)))


class PatternSet:
    """Patterns to be matched together. For a few patterns plain conditions do (filters.body_match_indices)."""

    def __init__(self, patterns: list[str]):
        self.patterns = list(patterns)
        good = [i for i, p in enumerate(self.patterns) if usable(p)]
        self.texts: dict[str, list[int]] = {}
        self.plain = []
        for i in good:
            texts = required(self.patterns[i])
            for t in texts:
                self.texts.setdefault(t, []).append(i)
            if not texts:
                self.plain.append(i)

    def candidates(self, lines: Column) -> Column:
        """Pairs that the automaton finds, each once, as line * 2^32 + pattern; lines is array<string>."""
        texts = self.texts

        @pandas_udf("array<bigint>")
        def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for t, own in texts.items():
                automaton.add_word(t, own)
            automaton.make_automaton()

            def pairs(own) -> np.ndarray:
                out: set[int] = set()
                for k, line in enumerate(own if own is not None else ()):
                    if line:
                        for _, hits in automaton.iter(line):
                            out.update([k << 32 | i for i in hits])
                return np.fromiter(out, np.int64, len(out))

            for batch in batches:
                yield pd.Series([pairs(own) for own in batch], dtype=object)

        return find(F.transform(lines, ascii_lower))

    def hits(self, lines: Column) -> Column:
        """Indices of the patterns that some line matches, a line being taken up to the cap of the filters."""
        def verified(own: Column) -> Column:
            lines, pairs = own["lines"], own["pairs"]
            texts = F.array(*[F.lit(p) for p in self.patterns])
            line, pattern = lambda p: F.shiftright(p, 32).cast("int"), lambda p: p.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
            hit = lambda p: F.rlike(capped(F.get(lines, line(p))), F.get(texts, pattern(p)))
            return F.transform(F.filter(pairs, lambda p: F.coalesce(hit(p), F.lit(False))), pattern)

        none = F.array().cast("array<int>")
        # lines and pairs stand in an array of one, so that neither is made again for each pair
        both = F.array(F.struct(lines.alias("lines"), self.candidates(lines).alias("pairs"))) if self.texts else None
        found = F.coalesce(F.get(F.transform(both, verified), F.lit(0)), none) if self.texts else none
        each = [F.when(body_matches(lines, self.patterns[p]), F.array(F.lit(p))).otherwise(none) for p in self.plain]
        return F.array_sort(F.array_distinct(F.concat(found, *each)))

    def header_hits(self, headers: Column) -> Column:
        """Indices of the patterns that `name: value`, the name or the value of some header matches."""
        lines = F.flatten(F.transform(headers, lambda h: F.array(F.concat(h["name"], F.lit(": "), h["value"]), h["name"], h["value"])))
        return self.hits(lines)
