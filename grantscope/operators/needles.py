"""Which lines can match which patterns: one pass over a text for the literals that all patterns need.

Most patterns of a catalog match only where a certain literal stands.  All such literals go
into one Aho-Corasick automaton, built once a worker; a line is then tried only against
patterns of which it holds a literal, and a line that holds none is not looked at again.
The automaton decides nothing by itself: what it lets through is matched by Spark.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Sequence
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

PLACE = "array<struct<at:int,hits:array<int>>>"


def needed(pattern: str) -> frozenset[str] | None:
    """Literals of which every match of the pattern holds at least one; None where that can't be told."""
    try:
        tree = re._parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return None
    return None if tree.state.flags & re.IGNORECASE else _of(list(tree))


def _of(items: list) -> frozenset[str] | None:
    """The set among all that a sequence must hold whose shortest literal is the longest."""
    found: list[frozenset[str]] = []
    run = ""
    for op, value in [*items, (None, None)]:
        name = str(op)
        if name == "LITERAL":
            run += chr(value)
            continue
        if name == "AT":  # takes no character
            continue
        if run:
            found.append(frozenset([run]))
            run = ""
        inner = None
        if name == "SUBPATTERN" and not value[1] & re.IGNORECASE:
            inner = _of(list(value[3]))
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
            inner = _of(list(value[2]))
        elif name == "ATOMIC_GROUP":
            inner = _of(list(value))
        elif name == "BRANCH":
            parts = [_of(list(x)) for x in value[1]]
            inner = None if None in parts else frozenset().union(*parts)
        if inner:
            found.append(inner)
    return max(found, key=lambda x: (min(map(len, x)), -len(x), sorted(x)), default=None)


@lru_cache(maxsize=16)
def automaton(groups: tuple[frozenset[str], ...]) -> ahocorasick.Automaton:
    """The automaton of all literals: at each it says its size in bytes and the numbers of the groups that hold it."""
    numbers: dict[str, list[int]] = {}
    for n, group in enumerate(groups):
        for literal in sorted(group):
            numbers.setdefault(literal.encode().decode("latin-1"), []).append(n)
    found = ahocorasick.Automaton()
    for literal, own in numbers.items():
        found.add_word(literal, (len(literal), own))
    found.make_automaton()
    return found


def places(lines: Column, groups: Sequence[frozenset[str]], every: bool = False) -> Column:
    """Per array of lines: ``at`` (from 0) and the sorted numbers of the groups that a line holds a literal of.

    Lines that hold none are left out, unless ``every`` asks for all.  Null lines hold none, a null array has no lines.
    """
    own = tuple(groups)

    @F.arrow_udf(PLACE)
    def scan(column: pa.Array) -> pa.Array:
        machine = automaton(own) if any(own) else None
        column = column.fill_null([]) if column.null_count else column
        cuts = column.offsets.to_numpy().tolist()
        values = column.values.cast(pa.large_binary()).fill_null(b"")
        ends = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1].tolist()
        data = memoryview(values.buffers()[2]) if values.buffers()[2] is not None else memoryview(b"")
        at, hits, sizes, counts = [], [], [0], [0]
        for a, b in zip(cuts, cuts[1:], strict=False):
            found: dict[int, set[int]] = {k: set() for k in range(a, b)} if every else {}
            text, base = str(data[ends[a] : ends[b]], "latin-1"), ends[a]
            for last, (size, numbers) in machine.iter(text) if machine and text else ():
                line = bisect_right(ends, base + last, a, b + 1) - 1
                if base + last - size + 1 >= ends[line]:
                    found.setdefault(line, set()).update(numbers)
            for line in sorted(found):
                at.append(line - a)
                hits.extend(sorted(found[line]))
                sizes.append(len(hits))
            counts.append(len(at))
        inner = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(hits, pa.int32()))
        return pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.StructArray.from_arrays([pa.array(at, pa.int32()), inner], ["at", "hits"]))

    return scan(lines)
