"""Leftmost-longest merging of token runs.

A sequence of ids is a string of code points, one for each id, so a merge pass is one regular
expression whose alternatives stand longest first; that stays in the JVM. Large packs, for which
trying the alternatives in turn is slow, go through an automaton (or, without its library, a trie) in
Arrow batches instead. Both give the same.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Packs up to this size are merged by a regular expression.
REGEX_MOST = 256


def pattern_of(expansions: list[bytes]) -> str:
    """Regular expression over byte tokens decoded as Latin-1."""
    ordered = sorted(set(expansions), key=lambda e: (-len(e), e))
    return "|".join("".join(f"\\x{b:02X}" for b in e) for e in ordered)


def as_string(tokens: Column) -> Column:
    """Byte tokens as a string with a character for each token."""
    return F.decode(tokens, "ISO-8859-1")


def merged_size(tokens: Column, expansions: list[bytes]) -> Column:
    """Tokens that are left after the merge pass."""
    if not expansions:
        return F.octet_length(tokens).cast("long")
    if len(set(expansions)) > REGEX_MOST:
        return _merged_size(tokens, expansions)
    # the mark stands outside Latin-1, so it can be told from every token
    return F.length(F.regexp_replace(as_string(tokens), pattern_of(expansions), "☃")).cast("long")


def finder(expansions: list[bytes]) -> Callable[[bytes], list[bytes]]:
    """The merged runs of a sequence in order, whatever the size of the pack."""
    try:
        import ahocorasick
    except ImportError:
        trie = Trie({tuple(e): k for k, e in enumerate(dict.fromkeys(expansions))})
        return lambda b: [b[lo:hi] for lo, hi, new in trie.occurrences(list(b)) if new is not None]
    automaton = ahocorasick.Automaton()
    for e in expansions:
        automaton.add_word(e.decode("latin-1"), e)
    automaton.make_automaton()
    return lambda b: [e for _, e in automaton.iter_long(b.decode("latin-1"))]


def _merged_size(tokens: Column, expansions: list[bytes]) -> Column:
    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        find = finder(expansions)
        for s in batches:
            yield s.map(lambda b: None if b is None else len(b) - sum(len(e) - 1 for e in find(bytes(b)))).astype("Int64")

    return run(tokens)


def _spans(tokens: Column, expansions: list[bytes]) -> Column:
    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        find = finder(expansions)
        for s in batches:
            yield s.map(lambda b: None if b is None else [e.hex().upper() for e in find(bytes(b))])

    return run(tokens)


def spans(tokens: Column, expansions: list[bytes]) -> Column:
    """The merged runs in order, as hex."""
    if len(set(expansions)) > REGEX_MOST:
        return _spans(tokens, expansions)
    found = F.regexp_extract_all(as_string(tokens), F.lit(f"({pattern_of(expansions)})"), F.lit(1))
    return F.transform(found, lambda m: F.hex(F.encode(m, "ISO-8859-1")))


class Trie:
    """Patterns of ids; the longest that matches at a place wins, whatever the order of insertion."""

    def __init__(self, patterns: dict[tuple[int, ...], int]):
        self.root: dict = {}
        for ids, new in patterns.items():
            if len(ids) < 2:
                raise ValueError("a merge takes two tokens or more")
            node = self.root
            for i in ids:
                node = node.setdefault(i, {})
            if None in node and node[None] != new:
                raise ValueError(f"two ids for the run {ids}")
            node[None] = new

    def occurrences(self, ids: list[int]) -> Iterator[tuple[int, int, int | None]]:
        """start, end and new id of each piece from the left; None for a single token that stays."""
        at, n = 0, len(ids)
        while at < n:
            node, to, new = self.root, at, None
            end = at + 1
            while to < n and (node := node.get(ids[to])) is not None:
                to += 1
                if None in node:
                    new, end = node[None], to
            yield at, end, new
            at = end

    def merge(self, ids: list[int]) -> list[int]:
        return [ids[a] if new is None else new for a, _, new in self.occurrences(ids)]


class Merger:
    """The merge pass over many sequences of ids at once: one after another in an array, cut by offsets.

    A pack of up to REGEX_MOST runs is a regular expression over a string with a code point for each id,
    which is the trie's choice, leftmost and longest; other packs and ids go through the trie.
    """

    def __init__(self, patterns: dict[tuple[int, ...], int]):
        self.patterns, self.trie, self.find = patterns, Trie(patterns), None
        if patterns and len(patterns) <= REGEX_MOST and all(0 <= i <= sys.maxunicode for run in patterns for i in run):
            self.new = {"".join(map(chr, run)): new for run, new in patterns.items()}
            self.find = re.compile("|".join(map(re.escape, sorted(self.new, key=lambda e: (-len(e), e))))).finditer

    def spans(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and new id of each run that is merged."""
        edges = list(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))
        if not self.patterns:
            found = []
        elif self.find and (not len(ids) or (ids.min() >= 0 and ids.max() <= sys.maxunicode)):
            whole = ids.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
            found = [(*m.span(), self.new[m.group()]) for lo, hi in edges for m in self.find(whole, lo, hi)]
        else:
            found = [(lo + a, lo + b, new) for lo, hi in edges for a, b, new in self.trie.occurrences(ids[lo:hi].tolist()) if new is not None]
        start, end, new = np.array(found, np.int64).reshape(-1, 3).T
        return start, end, new

    def __call__(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged ids, and their offsets."""
        start, end, new = self.spans(ids, offsets)
        edge = np.zeros(len(ids) + 1, np.int8)
        edge[start + 1], edge[end] = 1, -1
        kept = np.cumsum(edge[:-1], dtype=np.int8) == 0
        out = ids.copy()
        out[start] = new
        return out[kept], np.concatenate(([0], np.cumsum(kept)))[offsets]


class Expander:
    """Base ids of merged ones, by the runs of new ids, for many sequences at once; an id that stands for nothing else stays."""

    def __init__(self, runs: dict[int, tuple[int, ...]]):
        self.new = np.array(sorted(runs), np.int64)
        self.size = np.array([len(runs[k]) for k in sorted(runs)], np.int64)
        self.pool = np.array([i for k in sorted(runs) for i in runs[k]], np.int64)
        self.first = np.cumsum(self.size) - self.size

    def __call__(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Base ids, and their offsets."""
        if not len(self.new):
            return ids, offsets
        at = np.minimum(np.searchsorted(self.new, ids), len(self.new) - 1)
        made = self.new[at] == ids
        size = np.where(made, self.size[at], 1)
        ends = np.concatenate(([0], np.cumsum(size)))
        out = np.repeat(ids, size)
        starts, own = ends[:-1][made], size[made]
        place = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
        out[np.repeat(starts, own) + place] = self.pool[np.repeat(self.first[at[made]], own) + place]
        return out, ends[offsets]


#: Ids that are merged at once.
SLICE = 1 << 18


def slices(size: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of sequences of these sizes that have SLICE ids or are one sequence."""
    ends, lo = np.cumsum(size), 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SLICE, "right")))
        yield lo, hi
        lo = hi


def flat(sequences: list[np.ndarray | None]) -> tuple[np.ndarray, np.ndarray]:
    """Sequences one after another, and their offsets; none has no ids."""
    own = [np.zeros(0, np.int64) if x is None else np.asarray(x, np.int64) for x in sequences]
    return (np.concatenate(own) if own else np.zeros(0, np.int64)), np.cumsum([0, *map(len, own)])


def by_slices(s: pd.Series, run: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> pd.Series:
    """run over a column of arrays of ids, as a column."""
    rows, out = s.tolist(), []
    for lo, hi in slices(np.array([0 if x is None else len(x) for x in rows], np.int64)):
        ids, ends = run(*flat(rows[lo:hi]))
        ids = ids.astype(np.int32)
        out += [None if x is None else ids[a:b] for x, a, b in zip(rows[lo:hi], ends, ends[1:], strict=False)]
    return pd.Series(out, index=s.index, dtype=object)


def merge_ids(ids: Column, patterns: dict[tuple[int, ...], int]) -> Column:
    """The merge pass over an array of ids, for packs of any size."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        merger = Merger(patterns)
        for s in batches:
            yield by_slices(s, merger)

    return run(ids)


def expand_ids(ids: Column, patterns: dict[tuple[int, ...], int]) -> Column:
    """Base ids of merged ids; a token that no pattern made stands for itself."""
    if not patterns:
        return ids
    table = F.create_map(*[x for run, new in patterns.items() for x in (F.lit(new), F.array(*map(F.lit, run)))])
    return F.flatten(F.transform(ids, lambda i: F.coalesce(F.try_element_at(table, i), F.array(i))))


def audit(rows: DataFrame, ids: str, patterns: dict[tuple[int, ...], int], base_size: int) -> DataFrame:
    """One row of violation counts; all are 0 for a sound pack. Sequences are merged and expanded inside tasks, and only counts leave them."""
    names = ["n_lines", "not_lossless", "longer", "outside_view"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger, expander, sums = Merger(patterns), Expander({new: run for run, new in patterns.items()}), np.zeros(4, np.int64)
        own = np.array(sorted(patterns.values()), np.int64)
        for batch in batches:
            rows = batch.column(0)
            sums[0] += len(rows)
            size = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
            for lo, hi in slices(size):
                part = rows.slice(lo, hi - lo)
                base, offsets = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate(([0], np.cumsum(size[lo:hi])))
                merged, ends = merger(base, offsets)
                back, edges = expander(merged, ends)
                sums[1] += changed(base, offsets, back, edges)
                sums[2] += np.count_nonzero(np.diff(ends) > np.diff(offsets))
                sums[3] += within(~np.isin(merged, own) & (merged >= base_size), ends)
        yield pa.RecordBatch.from_arrays([pa.array([k]) for k in sums], names=names)

    made = rows.select(F.col(ids).cast("array<int>")).mapInArrow(run, ", ".join(f"{c} long" for c in names))
    return made.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in names], F.lit(sum(new < base_size for new in patterns.values())).cast("long").alias("not_appended"))


def within(marks: np.ndarray, offsets: np.ndarray) -> int:
    """Sequences in which a mark stands."""
    return len(np.unique(np.searchsorted(offsets, np.flatnonzero(marks), "right")))


def changed(a: np.ndarray, ends: np.ndarray, b: np.ndarray, edges: np.ndarray) -> int:
    """Sequences that are not the same in both."""
    if np.array_equal(ends, edges):
        return within(a != b, ends)
    return sum(not np.array_equal(a[i:j], b[k:m]) for i, j, k, m in zip(ends, ends[1:], edges, edges[1:], strict=False))


def compiled(expansions: list[bytes]) -> "re.Pattern[bytes]":
    """The same pass for Python's own bytes, for tests."""
    return re.compile(b"|".join(map(re.escape, sorted(set(expansions), key=lambda e: (-len(e), e)))))
