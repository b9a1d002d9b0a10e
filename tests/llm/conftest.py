import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def thue_morse(n=1024):
    """Two texts of n letters on which every polynomial modulo a power of two has the same value."""
    a, b = "a", "b"
    while len(a) < n:
        a, b = a + b, b + a
    return a, b


def make_docs(n=60, seed=3):
    """Documents with copies, near copies, nulls, empties, repeated rows and one long text."""
    r = random.Random(seed)
    vocabulary = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "Né", "TH") for b in ("ra", "so", "ti") for c in ("", "n", "s", "'s")]
    text = lambda k: "\n".join(" ".join(r.choice(vocabulary) for _ in range(r.randint(3, 14))) + "." for _ in range(k))
    rows = []
    for i in range(n):
        body = "Shared notice of the house, all rights kept.\n" + text(r.randint(4, 12))
        rows.append([i * 3, body, "en", r.choice(["a", "b", "b", "b", None])])
    base = text(16).split(" ")
    for k in range(8):  # near copies
        near = list(base)
        near[r.randrange(len(near))] = "changed"
        rows.append([1000 + k, " ".join(near), "en", "b"])
    for k in range(5):  # exact copies
        rows.append([2000 + k, rows[9][1], "en", "b"])
    rows += [[3000, None, "en", "a"], [3001, "", "en", "a"], [3002, " \t\n", None, None], [3003, "three words only", "en", "a"], [3004, "Three  WORDS only", "en", "b"], [3005, "x " * 30_000 + "end", "en", "b"], [3006, "a<|endoftext|>b  c\n\nd", "en", "a"], [None, "no id at all but some words here", "en", "a"]]
    rows += [list(rows[2]), list(rows[2])]  # repeated rows
    one, other = thue_morse()
    rows += [[4000, one, "en", "b"], [4001, other, "en", "b"], [4002, f"{one}\n{other}\n" + " ".join(f"w{k}" for k in range(60)), "en", "a"], [4003, f"{one} {other} x y z {other} {one}", "en", "a"]]
    rows += [[4100 + k, None if k % 2 else " \n", "en", "wordless"] for k in range(3)]  # a source without words
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]


@pytest.fixture(scope="session")
def rows():
    return make_docs()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def wide(docs):
    """With columns whose names the operators use for their own."""
    from pyspark.sql import functions as F

    out = docs
    for name in ("size", "taken", "target", "node", "key", "doc", "content", "kept", "score", "row", "pass", "passes", "shard", "slot", "n_words", "n_lines", "n_dropped", "new_text", "held_out", "features", "id", "part", "label", "grp", "rep", "perplexity", "ids", "decoded", "n_tokens", "position", "again", "fingerprint", "bins", "edited", "head", "_id", "_size", "_order", "_source", "_part", "_start", "n_shingles"):
        out = out.withColumn(name, F.lit(name))
    return out
