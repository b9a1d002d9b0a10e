import hashlib
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpuscle.llm import bpe, common, repair, words
from tests.llm.conftest import thue_morse

LIBRARY = Tokenizer.from_file(bpe.default_path())
CODER = bpe.ForcedBoundaryBPE(bpe.default_path())
ODD = [
    "", " ", "\n", " a", "  a", "a  b", "a \n b", "a\n\nb\n", "\ta\t b", "l'été 's don't   x", "日本語 テキスト。　a b  c", "\u0085x\u001c y", "a" * 3000 + "é" * 50,
    "a.", "b", ".", " ,", "x é, ×, a×.b ÷; ñ.", "x ", " y", "é  b  c", ":a", "word.'s a.b,c", "x<|endoftext|>y z", "<|endoftext|>", "a <|endoftext|> b", "\U0001f600 ok‍!",
]


def encoded(texts):
    out = []
    for _, _, data, offsets in common.chunks(pa.array(texts), 1 << 12):
        ids, counts = CODER.encode_run(data, offsets)
        out += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    return out


def test_encoding_equals_library():
    for order in (ODD, ODD[::-1], [t for t in ODD if "<|" not in t] * 2):
        assert encoded(order) == [e.ids for e in LIBRARY.encode_batch(order, add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8")) | st.text("ab ,.\n'Éé "), min_size=1, max_size=4))
def test_encoding_equals_library_on_any_text(texts):
    assert encoded(texts) == [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    for t in texts:
        ids = CODER.encode(t)
        assert CODER.decode(ids) == LIBRARY.decode(ids.tolist(), skip_special_tokens=False) == t


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("aeéÑſ×\n '&$-_(1.日") | st.text("aeinorstEéÑœ \n"), min_size=1, max_size=4))
def test_cuts_at_marks_and_line_feeds_equal_library(texts):
    assert encoded(texts) == [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def test_fragments_are_merged_together(monkeypatch):
    coder = bpe.ForcedBoundaryBPE(bpe.default_path())
    texts = [f"{w}\n{w} {w}&&& {w}é {w}" for w in ("hestionle", "Ouelyering", "a", "in" * 20, "noñé", "e" * 47)]
    want = [e.ids for e in LIBRARY.encode_batch([*texts, "x" * 99], add_special_tokens=False)]
    asked = []
    monkeypatch.setattr(coder, "tokenize", lambda x: asked.append(x) or coder.library.model.tokenize(x))

    def made(texts):
        data, ends = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *[len(t.encode()) for t in texts]])
        ids, counts = coder.encode_run(data, ends)
        return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]

    assert made(texts) == want[:-1]
    assert {x.strip("&") for x in asked} <= {"", "Ċ"}  # marks and line feeds alone; one call a word before
    assert made([*texts, "x" * 99]) == want and "x" * 99 in asked  # over the bound
    monkeypatch.setattr(bpe, "MERGED_AT_ONCE", 3)
    coder.pieces = bpe._Pieces()
    assert made([*texts, "x" * 99]) == want
    assert not bpe._Merges({"vocab": {"a": 0, "##b": 1, "ab": 2}, "merges": ["a ##b"], "continuing_subword_prefix": "##"}, bpe.byte_alphabet()).whole
    monkeypatch.setattr(coder.merges, "whole", False)  # a model with other rules
    coder.pieces = bpe._Pieces()
    assert made([*texts, "x" * 99]) == want


def test_words_without_structure_collide():
    one, other = thue_morse()
    assert encoded([one, other, f"{one} {other}"]) == [e.ids for e in LIBRARY.encode_batch([one, other, f"{one} {other}"], add_special_tokens=False)]
    data = np.frombuffer((one + other).encode(), np.uint8)
    start = np.arange(0, 2048, 64)
    for width in (64, 128, 512, 1024):
        at = start[start + width <= 2048]
        keys, spans = words.byte_spans(data, at, at + width), [data[a : a + width].tobytes() for a in at]
        assert len(set(keys.tolist())) == len(set(spans))


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=60), st.integers(0, 9))
def test_span_hashes_do_not_depend_on_place(span, before):
    data = np.frombuffer(b"\xff" * before + span + b"\x01\x02", np.uint8)
    alone = np.frombuffer(span, np.uint8)
    at = lambda x, n: words.byte_spans(x, np.array([n]), np.array([n + len(span)]))[0]
    assert at(data, before) == at(alone, 0)
    values = np.frombuffer(span[: len(span) // 8 * 8], np.uint64)
    k = len(values)
    assert words.value_spans(np.append(values[::-1], values), np.array([k]), np.array([2 * k]))[0] == words.value_spans(values, np.array([0]), np.array([k]))[0]


def test_forced_cuts_are_between_pairs_of_no_entry():
    pieces = list(CODER.fragments_of("qzĠthe"))
    assert "".join(pieces) == "qzĠthe"
    assert all(a[-1] + b[0] not in CODER.inside for a, b in zip(pieces, pieces[1:], strict=False))


def test_encode_decode_rows(docs, rows, empty, wide):
    got = bpe.encode_decode(docs, with_ids=True).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), LIBRARY.encode(t or "", add_special_tokens=False).ids, t or "") for i, t, *_ in rows)
    assert sorted((str(r.doc_id), list(r.ids), r.decoded) for r in got) == want
    for r in got:
        assert r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert bpe.encode_decode(empty).collect() == []
    assert bpe.encode_decode(wide).count() == len(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=400), st.integers(1, 6))
def test_grammar_round_trip(ids, rounds):
    ids = np.array(ids, np.uint32)
    blob = repair.pack(ids, 6, rounds=rounds, least=2, share=0)
    g = repair.Grammar(blob)
    assert (g.all() == ids).all()
    assert all(s == len(e) for s, e in zip(g.sizes, [g._expand(np.array([6 + k])) for k in range(len(g.rules))], strict=True))
    for start in range(0, len(ids), 7):
        assert (g.read(start, min(9, len(ids) - start)) == ids[start : start + 9]).all()


def test_grammar_makes_rules_of_runs():
    g = repair.Grammar(repair.pack(np.array([1] * 64 + [2, 3] * 40, np.uint32), 10, rounds=6, least=2, share=0))
    assert len(g.seq) < 20 and g.n_tokens == 144


def test_grammar_leaves_no_frequent_pair():
    r = np.random.default_rng(5)
    passage = r.integers(0, 3000, 200)
    parts = [x for k in range(40) for x in (passage, r.integers(0, 3000, 50))]
    ids = np.concatenate([*parts, r.zipf(1.3, 60_000) % 3000]).astype(np.uint32)
    seq, rules, sizes = repair.compress(ids, 3000)
    _, counts = np.unique((seq[:-1].astype(np.uint64) << np.uint64(32)) | seq[1:], return_counts=True)
    assert counts.max() < max(8, int(2e-5 * len(seq)))
    assert sizes.max() >= 200  # the passage is one symbol, or part of one
    assert (repair.Grammar(repair.pack(ids, 3000)).all() == ids).all()


def recounted(ids, free, least, share):
    """Rounds that count all pairs of the sequence anew."""
    seq, rules = ids.tolist(), []
    while True:
        counts, role = Counter(zip(seq, seq[1:], strict=False)), {}
        names = {}
        for (a, b), n in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
            if n >= max(least, int(share * len(seq))) and (a not in role if a == b else role.get(a, 1) == 1 and role.get(b, 2) == 2):
                role |= {a: 3} if a == b else {a: 1, b: 2}
                names[a, b] = free + len(names)
        if not names:
            return seq, rules
        out, k = [], 0
        while k < len(seq):
            pair = tuple(seq[k : k + 2])
            out.append(names.get(pair, seq[k]))
            k += 2 if pair in names else 1
        seq, free = out, free + len(names)
        rules += [list(p) for p in names]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=300), st.integers(2, 8), st.sampled_from([0, 0.03]), st.sampled_from([0, 1 << 31]))
def test_rounds_equal_recounting(ids, least, share, shift):
    ids = (np.array(ids) + shift).astype(np.uint32)
    seq, rules, _ = repair.compress(ids, 6 + shift, least=least, share=share)
    assert (seq.tolist(), rules.tolist()) == recounted(ids, 6 + shift, least, share)


def test_rounds_sort_only_what_they_changed(monkeypatch):
    r = np.random.default_rng(5)
    ids = np.concatenate((r.zipf(1.3, 60_000) % 3000, np.tile(r.integers(0, 3000, 64), 30))).astype(np.uint32)
    met, alike = [], repair._alike
    monkeypatch.setattr(repair, "_alike", lambda seq, at: met.append(len(at)) or alike(seq, at))
    seq, rules, _ = repair.compress(ids, 3000)
    assert len(met) > 8 and met[0] == len(ids) - 1
    assert sum(met[1:]) <= 2 * (len(ids) - len(seq))  # two pairs with neighbours for each pair replaced


def test_token_files(spark, docs, rows, empty, tmp_path):
    repair.write_ids(docs, path := f"{tmp_path}/ids", block_tokens=500)
    got = sorted(repair.read_ids(spark, path, with_ids=True).collect(), key=lambda r: r.start)
    at = 0
    assert [r.doc_id for r in got] == sorted((i for i, *_ in rows), key=lambda i: -1 if i is None else i)
    texts = {}
    for i, t, *_ in rows:
        texts.setdefault(i, t or "")
    for r in got:
        want = np.array([*LIBRARY.encode(texts[r.doc_id], add_special_tokens=False).ids, 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(want), zlib.crc32(want.tobytes()))
        assert list(r.ids) == want.tolist()
        at += len(want)
    repair.write_ids(empty, path := f"{tmp_path}/none")
    assert repair.read_ids(spark, path).collect() == []


def test_token_files_of_other_columns(spark, wide, rows, tmp_path):
    repair.write_ids(wide, path := f"{tmp_path}/wide")
    assert repair.read_ids(spark, path).count() == len(rows)


def test_wrong_file_is_refused():
    with pytest.raises(ValueError):
        repair.Grammar(b"x" * 64)
