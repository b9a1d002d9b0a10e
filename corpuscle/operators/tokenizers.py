"""Tokenizers beside bytes: subword vocabularies of the tokenizers library, and byte-level BPE trained here.

Token counts of a corpus go through its distinct pieces: the pre-tokenizer's pieces are counted, each
distinct piece is encoded once, and the counts are multiplied, so the encoder's work grows with the
vocabulary of the corpus and not with its length. Trained BPE is a chain of plain replacements over
the text's bytes, so it needs no Python at all.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

_loaded: dict[str, object] = {}


@dataclass(frozen=True)
class Subword:
    """A tokenizer of the tokenizers library by the path of its file; a worker loads it once."""

    path: str

    @property
    def handle(self):  # noqa: ANN201
        """The library's object."""
        if self.path not in _loaded:
            from tokenizers import Tokenizer

            _loaded[self.path] = Tokenizer.from_file(self.path)
        return _loaded[self.path]

    @property
    def size(self) -> int:
        """Ids, those of added tokens included."""
        return self.handle.get_vocab_size(with_added_tokens=True)

    def encode(self, text: Column) -> Column:
        """Ids without special tokens; a null text has none."""

        @F.pandas_udf("array<int>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                yield pd.Series([e.ids for e in self.handle.encode_batch_fast(s.fillna("").tolist(), add_special_tokens=False)], dtype=object)

        return run(text)

    def decode(self, ids: Column, skip_special: bool = True) -> Column:
        @F.pandas_udf("string")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                yield pd.Series(self.handle.decode_batch([x.tolist() for x in s], skip_special_tokens=skip_special))

        return run(ids)

    def count(self, text: Column) -> Column:
        return F.size(self.encode(text)).cast("long")

    def pieces(self, ids: Column) -> Column:
        """How ids are shown: the vocabulary's own piece, or the id decoded by itself."""

        @F.pandas_udf("array<string>")
        def run(s: pd.Series) -> pd.Series:
            show = lambda i: self.handle.id_to_token(i) or self.handle.decode([i], skip_special_tokens=False)
            return s.map(lambda x: [show(int(i)) for i in x])

        return run(ids)

    def fingerprint(self, probes: list[str]) -> str:
        """Of the size and the probes' encodings: tells whether a pack fits this tokenizer."""
        return fingerprint(self.size, [self.handle.encode(p, add_special_tokens=False).ids for p in probes])

    def totals(self, rows: DataFrame, by: list[str], text: str = "text") -> DataFrame:
        """The columns `by` and n_tokens, the tokens of all their texts, through distinct pieces.

        A task counts words, cuts each distinct one into pieces once, and gives out a row for each
        distinct piece; a piece is encoded once for each group that has it.
        """
        keys = [f for c in by for f in rows.schema.fields if f.name == c]
        of_pieces = StructType([*keys, StructField("piece", StringType()), StructField("n", LongType())])
        of_tokens = StructType([*keys, StructField("n_tokens", LongType())])
        given, made = to_arrow_schema(of_pieces), to_arrow_schema(of_tokens)

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            split, words = self._cutters()
            pieces: dict[str, list[str]] = {}
            sums: dict[tuple, Counter] = {}
            for b in batches:
                counts: dict[tuple, Counter] = {}
                for *group, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if t:
                        counts.setdefault(tuple(group), Counter()).update(words(t))
                    else:
                        counts.setdefault(tuple(group), Counter())
                for group, found in counts.items():
                    held = sums.setdefault(group, Counter())
                    for w, n in found.items():
                        if w not in pieces:
                            if len(pieces) > MOST_HELD:
                                pieces.clear()
                            pieces[w] = split(w)
                        for p in pieces[w]:
                            held[p] += n
                if sum(map(len, sums.values())) > MOST_HELD:
                    yield from told(sums)
                    sums = {}
            yield from told(sums)

        def told(sums: dict[tuple, Counter]) -> Iterator[pa.RecordBatch]:
            for group, counts in sums.items():
                yield pa.RecordBatch.from_arrays([*(pa.array([x] * len(counts), f.type) for x, f in zip(group, given, strict=False)), pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], schema=given)

        def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                tokens = [len(self.handle.model.tokenize(p)) * n for p, n in zip(b.column("piece").to_pylist(), b.column("n").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns[: len(by)], pa.array(tokens, pa.int64())], schema=made)

        counted = rows.select(*by, text).mapInArrow(cut, of_pieces).groupBy(*by, "piece").agg(F.sum("n").alias("n"))
        return counted.mapInArrow(sized, of_tokens).groupBy(*by).agg(F.sum("n_tokens").alias("n_tokens"))

    def _cutters(self) -> tuple[Callable[[str], list[str]], Callable[[str], list[str]]]:
        """What cuts a text into the pre-tokenizer's pieces, and what cuts it into words that have the same pieces alone.

        The expression of byte-level pre-tokenizers lets no piece pass from a character into a single
        space before another one; for other pre-tokenizers the text is one word.
        """
        if not self.handle.pre_tokenizer:
            return (lambda t: [t]), (lambda t: [t])
        kind = json.loads(self.handle.to_str())["pre_tokenizer"]
        split = lambda t: [w for w, _ in self.handle.pre_tokenizer.pre_tokenize_str(t)]
        return split, (BEFORE_SPACE.split if kind["type"] == "ByteLevel" and kind.get("use_regex", True) else lambda t: [t])


#: Between a character and a single space that another character follows.
BEFORE_SPACE = re.compile(r"(?<=\S)(?= \S)")
#: Distinct words or pieces that a task holds.
MOST_HELD = 1 << 19


def fingerprint(size: int, encodings: list[list[int]]) -> str:
    """SHA-256 of a canonical JSON record of a tokenizer."""
    return hashlib.sha256(json.dumps({"probes": encodings, "size": size}, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


# --- BPE that is trained here -------------------------------------------------------------------

#: Words that merges are learned from, the most frequent ones; the histogram that the driver holds.
MOST_WORDS = 20_000


def symbols(text: Column) -> Column:
    """Each byte as <xx>."""
    return F.regexp_replace(F.hex(F.encode(text, "utf-8")), "(..)", "<$1>")


def histogram(rows: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """word, n: runs between spaces, each with the space before it; the most frequent."""
    words = rows.select(F.explode(F.regexp_extract_all("text", F.lit("( ?[^ ]+)"), F.lit(1))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return words.orderBy(F.desc("n"), F.hex(F.encode("word", "utf-8"))).limit(most)


def train_bpe(rows: DataFrame, merges: int, most: int = MOST_WORDS) -> list[tuple[str, str, int]]:
    """left, right (hex) and count of each merge, in order; ties go to the lesser pair."""
    words = [(r["s"][1:-1].split("><"), r["n"]) for r in histogram(rows, most).select(symbols(F.col("word")).alias("s"), "n").collect()]
    out = []
    for _ in range(merges):
        counts: dict[tuple[str, str], int] = {}
        for parts, n in words:
            for pair in zip(parts, parts[1:], strict=False):
                counts[pair] = counts.get(pair, 0) + n
        if not counts:
            break
        best = min(counts, key=lambda p: (-counts[p], f"<{p[0]}><{p[1]}>"))
        out.append((*best, counts[best]))
        for k, (parts, n) in enumerate(words):
            if best[0] in parts:
                made, at = [], 0
                while at < len(parts):
                    both = tuple(parts[at : at + 2]) == best
                    made.append("".join(best) if both else parts[at])
                    at += 1 + both
                words[k] = made, n
    return out


def bpe_symbols(text: Column, merges: list[tuple[str, str, int]]) -> Column:
    """The text's tokens as <hex>, merge after merge; a merge never spans words, since no right part begins with a space."""
    return reduce(lambda s, m: F.replace(s, F.lit(f"<{m[0]}><{m[1]}>"), F.lit(f"<{m[0]}{m[1]}>")), merges, symbols(text))


def bpe_count(text: Column, merges: list[tuple[str, str, int]]) -> Column:
    """How many tokens bpe_symbols() shows: here each is a character, a byte as it stands and a merged one beyond Latin-1."""
    known: dict[str, str] = {}
    symbol = lambda h: chr(int(h, 16)) if len(h) == 2 else known.setdefault(h, chr(0x100 + len(known)))
    pairs = [(symbol(a) + symbol(b), symbol(a + b)) for a, b, _ in merges]
    made = reduce(lambda s, m: F.replace(s, F.lit(m[0]), F.lit(m[1])), pairs, F.decode(F.encode(text, "utf-8"), "ISO-8859-1"))
    return F.length(made).cast("long")
