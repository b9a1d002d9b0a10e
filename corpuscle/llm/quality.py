"""Quality rules: statistics of a text by itself, and the frequency of its lines on its host.

The method: normalised lines are hashed, the distinct documents (ids) of a host that hold each
line are counted, lines over the limits are removed, and a document of which too little is left is
rejected.

Defined results: a null text has no words, so it fails the base rule, and stays null; a null host
is a host of its own; all null ids count as one document; repeated rows count once and get equal
results; a very long text is a run of its own; a column of `keep` that has the name of a made one
gives way to it; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.llm import common, hash_table, line_index
from corpuscle.llm.words import _C, Words, byte_spans, mix, windows

#: A line is removed if more than LINE_PERCENT of its host's documents hold it, and LINE_LEAST at least.
LINE_PERCENT, LINE_LEAST = 2.0, 10
#: A document is depleted if less than this percentage of its words is left.
LEFT_PERCENT = 30
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def statistics(words: Words) -> list[np.ndarray]:
    """STATISTICS of each text of a run."""
    data, n = words.data, words.n
    first, _ = words.lines()
    of = words.text[first].astype(np.uint64)
    # equal lines of one text share a key, and the first of them is no repetition
    _, at, counts = np.unique(mix(byte_spans(data, *words.line_bytes(first)) + of * _C[1]), return_index=True, return_counts=True)
    dup = np.bincount(words.text[first][at], counts - 1, n).astype(np.int64)
    run, at = windows(words.hashes(lower=False), words.text, 3)
    inside = np.zeros(len(words.start) + 2, bool)
    if len(run):
        _, back, counts = np.unique(mix(run + words.text[at].astype(np.uint64) * _C[2]), return_inverse=True, return_counts=True)
        often = at[counts[back] >= 2]
        for k in range(3):
            inside[often + k] = True
    repeats = np.bincount(words.text, inside[: len(words.start)], n).astype(np.int64)
    return [words.count, words.per_text(words.solid & ((data & 0xC0) != 0x80)), words.per_text(_SYMBOLS[data]), dup, repeats]


def frequent_lines(docs: DataFrame, doc_id: str = "doc_id", host: str = "source", text: str = "text") -> hash_table.HashTable:
    """Lines over the limits."""
    rows = line_index.line_rows(docs, doc_id, host, text)
    counts = rows.distinct().groupBy("host", "key").agg(F.count("*").alias("n"))
    return line_index.common_lines(counts, LINE_LEAST, LINE_PERCENT, "quality-lines")


def judge(docs: DataFrame, keep: list[str], doc_id: str = "doc_id", host: str = "source", text: str = "text", with_text: bool = False) -> DataFrame:
    """The columns `keep`, then STATISTICS, base_failed, n_removed_words and kept; with_text: also new_text, without the removed lines."""
    table = frequent_lines(docs, doc_id, host, text)
    made = [*STATISTICS, "base_failed", "n_removed_words", "kept", *["new_text"] * with_text]
    keep = [c for c in keep if c not in made]
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    out += "".join(f", {c} long" for c in STATISTICS) + ", base_failed boolean, n_removed_words long, kept boolean" + ", new_text string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, body = line_index.host_hashes(batch.column(len(keep))), batch.column(len(keep) + 1)
            done: list[list[np.ndarray]] = []
            changed: dict[int, str] = {}
            for lo, hi, data, offsets in common.chunks(body):
                words = Words(data, offsets)
                first, last, key = line_index.lines_of(words, hosts[lo:hi])
                gone, _ = table.lookup(key)
                at = words.text[first]
                removed = np.bincount(at, gone * (last - first), words.n).astype(np.int64) if len(at) else np.zeros(words.n, np.int64)
                own = statistics(words)
                failed = (own[0] < 50) | (100 * own[4] > 50 * own[0])
                done.append([*own, failed, removed, ~failed & ((own[0] - removed) * 100 >= LEFT_PERCENT * own[0])])
                if with_text:
                    changed |= {lo + k: t for k, t in line_index.without_lines(words, words.line_bytes(first[gone])[0], at[gone])}
            if not done:
                continue
            columns = [pa.array(np.concatenate(c)) for c in zip(*done, strict=True)]
            columns[:5] = [c.cast(pa.int64()) for c in columns[:5]]
            if with_text:
                columns.append(line_index.replaced(body, changed))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *columns], names=[*keep, *made])

    return docs.select(*keep, F.col(host).cast("string").alias("__host"), F.col(text).cast("string").alias("__text")).mapInArrow(common.released(run), out)


def sql() -> str:
    """judge() over the table documents, for DuckDB."""
    word, lower = r"[^\x20\x09-\x0D]", "translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{word}+') AS w FROM documents),
a AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols FROM d),
s AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM d),
l AS (SELECT *, regexp_replace(regexp_replace({lower}, '[\\x20\\x09-\\x0D]+', ' ', 'g'), '^ | $', '', 'g') AS norm, len(regexp_extract_all(line, '{word}+')) AS k FROM s WHERE regexp_matches(line, '{word}')),
u AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM l GROUP BY doc_id),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
r AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g), (SELECT unnest([0, 1, 2]) AS o) WHERE c > 1 GROUP BY doc_id),
f AS (SELECT source, norm, count(DISTINCT coalesce(doc_id, 9223372036854775807)) AS n FROM l GROUP BY source, norm),
t AS (SELECT source, count(DISTINCT coalesce(doc_id, 9223372036854775807)) AS total FROM d GROUP BY source),
b AS (SELECT f.source, norm FROM f JOIN t ON f.source IS NOT DISTINCT FROM t.source WHERE n >= {LINE_LEAST} AND n * 100 > total * {LINE_PERCENT}),
m AS (SELECT l.doc_id, CAST(sum(k) AS BIGINT) AS gone FROM l JOIN b ON l.source IS NOT DISTINCT FROM b.source AND l.norm = b.norm GROUP BY l.doc_id),
j AS (SELECT a.*, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(gone, 0) AS n_removed_words FROM a LEFT JOIN u USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN m USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND (n_words - n_removed_words) * 100 >= {LEFT_PERCENT} * n_words AS kept FROM j"""
