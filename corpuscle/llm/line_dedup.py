"""Line deduplication by site-relative frequency.

For each host, the pages that hold a line are divided by the host's pages; lines over the
boilerplate ratio are dropped from all of them.

Defined results: a null text stays null and has no lines; a null host is a host of its own; each
row is a page, whatever its id; lines without words stay, and a line that only one page holds is
no boilerplate, however few pages the host has; rows are never dropped; a very long text is a run
of its own; a column of `keep` that has the name of a made one gives way to it; an empty table
gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.llm import common, hash_table, line_index
from corpuscle.llm.words import Words

#: A line is boilerplate on more than PERCENT of its host's pages; one page repeats nothing, so LEAST.
PERCENT, LEAST = 10.0, 2

#: What page_text() does, in order: pattern and replacement, in the common part of Java's and RE2's syntax.
MARKUP = [
    (r"(?is)<(?:script|style)\b[^>]*>.*?</(?:script|style)\s*>|<!--.*?-->", ""),
    (r"(?i)</?(?:html|head|title|body|nav|header|footer|article|section|div|p|br|ul|ol|li|table|tr|h[1-6])\b[^>]*>", "\n"),
    (r"<[^>]*>", ""),
]
#: Then plain replacements, and what stands around line feeds.
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")]
EDGES = [(r"[\x20\x09-\x0D]*\n[\x20\x09-\x0D]*", "\n"), (r"^\n|\n$", "")]
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


def page_text(html: Column) -> Column:
    """Text of a page, a line for each block."""
    for pattern, to in MARKUP:
        html = F.regexp_replace(html, pattern, to)
    for entity, to in ENTITIES:
        html = F.replace(html, F.lit(entity), F.lit(to))
    for pattern, to in EDGES:
        html = F.regexp_replace(html, pattern, to)
    return html


def page_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, HOST, 1))


def boilerplate(docs: DataFrame, doc_id: str, host: str, text: str, percent: float = PERCENT, least: int = LEAST) -> hash_table.HashTable:
    counts = line_index.line_rows(docs, doc_id, host, text).groupBy("host", "key").agg(F.count("*").alias("n"))
    return line_index.common_lines(counts, least, percent, "boilerplate")


def drop_boilerplate(docs: DataFrame, keep: list[str], doc_id: str, host: str, text: str, percent: float = PERCENT, least: int = LEAST) -> DataFrame:
    """The columns `keep`, then n_lines and n_dropped (lines with words) and new_text."""
    table = boilerplate(docs, doc_id, host, text, percent, least)
    made = ["n_lines", "n_dropped", "new_text"]
    keep = [c for c in keep if c not in made]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema) + "n_lines long, n_dropped long, new_text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, column = line_index.host_hashes(batch.column(len(keep))), batch.column(len(keep) + 1)
            lines, dropped = [], []
            changed: dict[int, str] = {}
            for lo, hi, data, offsets in common.chunks(column):
                words = Words(data, offsets)
                first, _, key = line_index.lines_of(words, hosts[lo:hi])
                gone, _ = table.lookup(key)
                at = words.text[first]
                lines.append(np.bincount(at, minlength=words.n))
                dropped.append(np.bincount(at[gone], minlength=words.n))
                changed |= {lo + k: t for k, t in line_index.without_lines(words, words.line_bytes(first[gone])[0], at[gone])}
            if lines:
                counts = [pa.array(np.concatenate(c).astype(np.int64)) for c in (lines, dropped)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *counts, line_index.replaced(column, changed)], names=[*keep, *made])

    return docs.select(*keep, F.col(host).cast("string").alias("__host"), F.col(text).cast("string").alias("__text")).mapInArrow(common.released(run), schema)


def sql(percent: float = PERCENT, least: int = LEAST) -> str:
    """The same over the table pages, for DuckDB."""
    text = "html"
    of = lambda text, pattern, to: f"regexp_replace({text}, '{pattern}', {'chr(10)' if to == chr(10) else repr(to)}, 'g')"
    for pattern, to in MARKUP:
        text = of(text, pattern, to)
    for entity, to in ENTITIES:
        text = f"replace({text}, '{entity}', '{to}')"
    for pattern, to in EDGES:
        text = of(text, pattern, to)
    lower = "translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH p AS (SELECT page_id, lower(regexp_extract(url, '{HOST}', 1)) AS host, {text} AS text FROM pages),
s AS (SELECT page_id, host, string_split(text, chr(10)) AS parts FROM p),
l AS (SELECT page_id, host, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM s),
n AS (SELECT *, regexp_replace(regexp_replace({lower}, '[\\x20\\x09-\\x0D]+', ' ', 'g'), '^ | $', '', 'g') AS norm FROM l),
c AS (SELECT host, norm, count(DISTINCT page_id) AS pages FROM n WHERE norm <> '' GROUP BY host, norm),
t AS (SELECT host, count(*) AS total FROM p GROUP BY host),
b AS (SELECT c.host, c.norm FROM c JOIN t USING (host) WHERE c.pages >= {least} AND c.pages * 100 > t.total * {percent}),
m AS (SELECT n.*, n.norm <> '' AS full_line, b.norm IS NOT NULL AS gone FROM n LEFT JOIN b ON n.host = b.host AND n.norm = b.norm)
SELECT page_id, host, CAST(count(*) FILTER (full_line) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS new_text
FROM m GROUP BY page_id, host"""
