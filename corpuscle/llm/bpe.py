"""BPE encoding and decoding by forced boundaries.

A byte pair that stands inside no vocabulary entry can never be merged across: between its two
bytes every encoding is cut. Texts are cut there after the tokenizer's own pre-tokenization,
the fragments are encoded independently (each distinct one once for a worker) and the ids are
concatenated.

Before that, a text is cut where the pre-tokenizer is certain to cut: before a space or a line
feed that a visible character follows, between a line feed and a letter, and between a letter and
a mark that is no apostrophe. The pieces of some megabytes of text are hashed together, each
distinct one is encoded once, many fragments of letters at a time, and the ids are gathered in
the texts' order.

Defined results: a null text counts as empty and has no ids; special tokens of the vocabulary
that stand in a text become their id, as in the library; rows are never dropped, repeated rows
stay repeated, columns of the input that are not asked for do not matter, and one of `keep` that has
the name of a made one gives way to it; a very long text is a run of its own; an empty table gives an
empty one. Pieces are told apart by 64 bits of a hash among the few 100,000 that a worker keeps.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpuscle.llm import common
from corpuscle.llm.words import byte_spans

#: Distinct pieces that a worker keeps, some 30 MB; then it starts anew.
KEPT_PIECES = 800_000
#: Of other fragments than whole words.
KEPT_FRAGMENTS = 50_000
#: Fragments of more bytes are encoded one by one.
MERGED_BYTES = 48
#: A table of so many fragments takes some 60 MB at most.
MERGED_AT_ONCE = 1 << 16
#: Texts are encoded in runs of about so many bytes.
RUN_BYTES = 4 << 20
_CUT = re.compile(r"[ \n](?=\S)")
#: Letters whose class no version of Unicode has changed.
_WORD = re.compile(r" ?[A-Za-z\xC0-\xD6\xD8-\xF6\xF8-\u017F]+\Z")

#: What a byte is, as bits; a table for bytes.translate.
_BREAK, _VISIBLE, _MARK, _LETTER, _LEAD = 1, 2, 4, 8, 16
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x0A]] |= _BREAK  # a space or a line feed
_KIND[[*range(0x21, 0x7F), *range(0xC3, 0xE0)]] |= _VISIBLE  # first bytes of characters that are white space in no version of Unicode
_KIND[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and c != 0x27]] |= _MARK  # an apostrophe may begin a contraction
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] |= _LETTER
_KIND[[0xC3, 0xC4, 0xC5]] |= _LEAD  # first bytes of letters of two bytes, but for two signs
_KINDS = _KIND.tobytes()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


_SHOWN = np.array([ord(c) for c, _ in sorted(byte_alphabet().items(), key=lambda x: x[1])], "<u2")


class _Pieces:
    """Ids of the distinct pieces that a worker has met, in arrays sorted by the pieces' hashes."""

    def __init__(self) -> None:
        self.keys, self.start, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    def missing(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, keys)
        return np.flatnonzero(np.append(self.keys, np.uint64(0))[at] != keys) if len(self.keys) else np.arange(len(keys))

    def add(self, keys: np.ndarray, body: np.ndarray, size: np.ndarray) -> None:
        """keys: sorted, none of them known; body: ids of all, one after another."""
        if self.used + len(body) > len(self.flat):
            self.flat = np.concatenate((self.flat[: self.used], np.zeros(len(self.flat) + len(body), np.uint32)))
        self.flat[self.used : self.used + len(body)] = body
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.start = np.insert(self.start, at, (self.used + np.cumsum(size) - size).astype(np.int32))
        self.size = np.insert(self.size, at, size)
        self.used += len(body)

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, keys)
        return self.start[at], self.size[at]


class _Merges:
    """Merges many fragments at once, each as byte-pair encoding does: the first pair of the list, and of its places the leftmost."""

    NEVER = np.int32(2**31 - 1)

    def __init__(self, model: dict, alphabet: dict[str, int]):
        ids = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        other = any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        #: Whether these are all rules of the model; else fragments are left to the library.
        self.whole = not other and all(c in ids for c in alphabet) and len(set(pairs)) == len(pairs)
        if not self.whole:
            return
        self.first = np.array([ids[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])], np.int32)
        keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], np.int64)
        by = np.argsort(keys)
        self.keys, self.rank = np.append(keys[by], -1), np.append(by, self.NEVER).astype(np.int32)
        self.becomes = np.array([ids[a + b] for a, b in pairs], np.int32)
        self.of_bytes = self.ranks(np.repeat(self.first, 256), np.tile(self.first, 256)).reshape(256, 256)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys[:-1], key)
        return np.where(self.keys[at] == key, self.rank[at], self.NEVER)

    def made(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of fragments, none of them empty, one after another, and the number of each."""
        counts, ends = np.zeros(len(start), np.int32), []
        by = np.argsort(size, kind="stable")
        own = symbols = ranks = None
        # fragments of k symbols: those of k bytes, and longer ones after a merge; each merges once or has its ids
        for k in range(int(size.max(initial=0)), 0, -1):
            lo, hi = np.searchsorted(size[by], [k, k + 1])
            new = by[lo:hi]
            raw = data[start[new][:, None] + np.arange(k)]
            fresh = new, self.first[raw], self.of_bytes[raw[:, :-1], raw[:, 1:]]
            own, symbols, ranks = fresh if own is None else (np.concatenate(x) for x in zip((own, symbols, ranks), fresh, strict=True))
            if k == 1 or not len(own):
                more = np.zeros(len(own), bool)
            else:
                at = ranks.argmin(1)
                best = ranks[np.arange(len(own)), at]
                more = best != self.NEVER
            ends.append((own[~more], symbols[~more]))
            counts[own[~more]] = k
            if k > 1:
                n = int(more.sum())
                own, symbols, ranks, row = own[more], symbols[more], ranks[more], np.arange(n)
                if not n:
                    symbols, ranks = symbols[:, 1:], ranks[:, 1:]
                    continue
                at, best = at[more], best[more]
                symbols[row, at] = self.becomes[best]
                keep = np.ones((n, k), bool)
                keep[row, at + 1] = False
                symbols = symbols[keep].reshape(n, k - 1)
                keep = np.ones((n, k - 1), bool)
                keep[row, at] = False
                ranks = ranks[keep].reshape(n, k - 2)
                for r, c in ((row[at > 0], at[at > 0] - 1), (row[at < k - 2], at[at < k - 2])):
                    ranks[r, c] = self.ranks(symbols[r, c], symbols[r, c + 1])
        first = np.cumsum(counts, dtype=np.int64) - counts
        out = np.empty(int(counts.sum()), np.uint32)
        for which, ids in ends:
            out[first[which][:, None] + np.arange(ids.shape[1])] = ids
        return out, counts


class ForcedBoundaryBPE:
    """Encodes to little-endian unsigned 32-bit ids, and decodes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        alphabet = byte_alphabet()
        self.shown = {b: c for c, b in alphabet.items()}
        vocabulary = spec["model"]["vocab"]
        #: Pairs of adjacent bytes inside an entry; any other pair is a certain cut.
        self.inside = {pair for word in vocabulary for pair in map("".join, zip(word, word[1:], strict=False))}
        self.inside_bytes = np.zeros((256, 256), bool)
        for a, b in self.inside:
            if a in alphabet and b in alphabet:
                self.inside_bytes[alphabet[a], alphabet[b]] = True
        self.size = max([*vocabulary.values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * self.size
        for word, k in vocabulary.items():
            self.bytes_of[k] = bytes(alphabet[c] for c in word) if all(c in alphabet for c in word) else word.encode()
        for word, k in self.special.items():
            self.bytes_of[k] = word.encode()
        self.packed = [np.uint32(k).astype("<u4").tobytes() for k in range(self.size)]
        self.tokenize = self.library.model.tokenize
        # merges as the library makes them, of bytes by their values: a pair's place in the list, and what it becomes
        self.merges = _Merges(spec["model"], alphabet)
        self.byte_counts = np.array([len(b) for b in self.bytes_of], np.int64)
        self.byte_starts = np.cumsum(self.byte_counts) - self.byte_counts
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.pieces = _Pieces()
        self.fragments: dict[str, bytes] = {}

    def _fragment(self, fragment: str) -> bytes:
        if (ids := self.fragments.get(fragment)) is None:
            if len(self.fragments) >= KEPT_FRAGMENTS:
                self.fragments.clear()
            ids = self._tokens(fragment)
            if len(fragment) < 64:
                self.fragments[fragment] = ids
        return ids

    def _tokens(self, fragment: str) -> bytes:
        packed = self.packed
        return b"".join([packed[t.id] for t in self.tokenize(fragment)])

    def fragments_of(self, shown: str) -> Iterator[str]:
        lo, inside = 0, self.inside
        for k in range(1, len(shown)):
            if shown[k - 1 : k + 1] not in inside:
                yield shown[lo:k]
                lo = k
        yield shown[lo:]

    def _piece(self, piece: str) -> bytes:
        if _WORD.match(piece):  # one run of the pre-tokenizer, so no need to ask the library
            shown = piece.encode().decode("latin-1").translate(self.shown)
            if self.inside.issuperset(map(add, shown, shown[1:])):  # no certain cut
                return self._tokens(shown)
            return b"".join(map(self._tokens, self.fragments_of(shown)))
        shown = self.library.pre_tokenizer.pre_tokenize_str(piece)
        return b"".join(self._fragment(f) for word, _ in shown for f in self.fragments_of(word))

    def _fragments(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of fragments of a run, one after another, and where those of each begin and the last end."""
        short = (ends - begins <= MERGED_BYTES) & self.merges.whole
        start, size = begins[short], (ends - begins)[short]
        made = [self.merges.made(data, start[k : k + MERGED_AT_ONCE], size[k : k + MERGED_AT_ONCE]) for k in range(0, len(start), MERGED_AT_ONCE)]
        ids, counts = (np.concatenate([m[k] for m in made]) if made else np.zeros(0, np.uint32) for k in (0, 1))
        if not short.all():  # one by one
            each = [np.frombuffer(self._tokens(_SHOWN[data[x:y]].tobytes().decode("utf-16-le")), "<u4") for x, y in zip(begins[~short].tolist(), ends[~short].tolist(), strict=True)]
            sizes = np.zeros(len(begins), np.int64)
            sizes[short], sizes[~short] = counts, [len(x) for x in each]
            mine = np.repeat(short, sizes)
            whole = np.empty(len(mine), np.uint32)
            whole[mine], whole[~mine] = ids, np.concatenate(each)
            ids, counts = whole, sizes
        return ids, np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))

    def _made(self, data: np.ndarray, whole: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces of a run, one after another, and the number of each."""
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(0, np.int32)
        # a piece of letters, with a space before them or not, is one run of the pre-tokenizer
        kind = np.frombuffer(whole.translate(_KINDS), np.uint8)
        letter = (kind & _LETTER) > 0
        if len(data) > 1:
            two = ((kind[:-1] & _LEAD) > 0) & ((data[1:] & 0xC0) == 0x80) & ((data[:-1] != 0xC3) | (data[1:] != 0x97) & (data[1:] != 0xB7))
            letter[:-1] |= two
            letter[1:] |= two
        odd = np.zeros(len(data) + 1, np.int32)
        np.cumsum(~letter, out=odd[1:])
        word = (odd[end] == odd[start + (data[start] == 0x20)]) & (end > start + (data[start] == 0x20))
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = ~self.inside_bytes[data[:-1], data[1:]]
        cuts = np.flatnonzero(cut)
        a, b = start[word], end[word]
        before = np.zeros(len(data) + 2, np.int32)
        np.cumsum(cut, out=before[1:])
        lo = before[a + 1].astype(np.int64)
        size = before[b] - lo
        own = np.repeat(np.arange(len(a)), size)
        at = cuts[np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(len(own))]
        # fragments: each word from its start to the first certain cut, and so on to its end
        begins, ends = np.insert(at, np.cumsum(size) - size, a), np.insert(at, np.cumsum(size), b)
        ids, marks = self._fragments(data, begins, ends)
        of_word = np.diff(marks[np.concatenate(([0], np.cumsum(size + 1)))])
        others = np.flatnonzero(~word)
        rest = [self._piece(whole[x:y].decode("utf-8", "replace")) for x, y in zip(start[others].tolist(), end[others].tolist(), strict=True)]
        sizes = np.zeros(len(start), np.int64)
        sizes[word], sizes[others] = of_word, [len(x) >> 2 for x in rest]
        mine = np.repeat(word, sizes)
        out = np.empty(len(mine), np.uint32)
        out[mine], out[~mine] = ids, np.frombuffer(b"".join(rest), "<u4")
        return out, sizes.astype(np.int32)

    def encode(self, text: str) -> np.ndarray:
        """Ids of one text, special tokens included."""
        parts = self.split.split(text) if self.split else [text]
        out = []
        for part in parts:
            if part in self.special:
                out.append(np.uint32(self.special[part]).astype("<u4").tobytes())
            else:
                cuts = [0, *(m.start() for m in _CUT.finditer(part) if m.start()), len(part)]
                out += [self._piece(part[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        return np.frombuffer(b"".join(out), "<u4")

    def encode_run(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a run, one after another, and the number of ids of each."""
        if self.special and any(t.encode() in (whole := data.tobytes()) for t in self.special):
            each = [self.encode(whole[a:b].decode("utf-8", "replace")) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            return np.concatenate(each), np.array([len(x) for x in each], np.int64)
        cut = np.zeros(len(data) + 1, bool)
        whole = data.tobytes()
        if len(data) > 1:
            kind = np.frombuffer(whole.translate(_KINDS), np.uint8)
            cut[:-2] = (kind[:-1] & _BREAK) & ((kind[1:] & _VISIBLE) >> 1)
            letter = (kind & _LETTER) > 0
            letter[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
            cut[1:-1] |= ((kind[1:] & _MARK) > 0) & letter[:-1]
            cut[1:-1] |= (data[:-1] == 0x0A) & ((kind[1:] & _LETTER) > 0)
        # what a text ends with is followed by nothing, whatever the next text begins with
        last = np.maximum(offsets[1:] - 1, 0)
        cut[last] &= (_KIND[data[last]] & _MARK) > 0 if len(data) else False
        cut[offsets] = True
        at = np.flatnonzero(cut)
        start, end = at[:-1], at[1:]
        keys, first, back = _distinct(byte_spans(data, start, end))
        pieces = self.pieces
        new = pieces.missing(keys)
        pieces.add(keys[new], *self._made(data, whole, start[first[new]], end[first[new]]))
        begin, size = pieces.of(keys)
        counts = np.concatenate(([0], np.cumsum(size[back], dtype=np.int64)))
        out = gathered(pieces.flat, begin, size, back), np.diff(counts[np.searchsorted(start, offsets)])
        if len(pieces.keys) > KEPT_PIECES:
            self.pieces = _Pieces()
        return out

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return gathered(self.flat, self.byte_starts, self.byte_counts, ids.astype(np.int64)).tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in ascending order, a place of each, and the number of the value at each place."""
    order = np.argsort(values)
    ordered = values[order]
    new = np.ones(len(values), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    back = np.empty(len(values), np.int32)
    back[order] = np.cumsum(new, dtype=np.int32) - 1
    return ordered[new], order[new], back


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs of flat named by which, one after another."""
    size = sizes[which]
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    shift = np.repeat((starts[which] - (ends - size)).astype(kind), size)
    shift += np.arange(total, dtype=kind)
    return flat[shift]


_loaded: dict[str, ForcedBoundaryBPE] = {}


def tokenizer(path: str) -> ForcedBoundaryBPE:
    if path not in _loaded:
        _loaded[path] = ForcedBoundaryBPE(path)
    return _loaded[path]


def encode_decode(docs: DataFrame, path: str | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """The columns `keep`, then n_tokens, ids_sha256 and decoded_sha256; with_ids: also the ids and the decoded text."""
    common.ship(docs.sparkSession)
    path = path or default_path()
    keep = tuple(c for c in keep if c not in ("n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"][: 2 * with_ids]))
    kept = docs.select(*keep).schema
    out = f"{''.join(f'`{f.name}` {f.dataType.simpleString()}, ' for f in kept)}n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, sha = tokenizer(path), hashlib.sha256
        for batch in batches:
            for lo, hi, data, offsets in common.chunks(batch.column(len(keep)), RUN_BYTES):
                ids, counts = bpe.encode_run(data, offsets)
                ends = np.cumsum(counts)
                own = [ids[e - n : e] for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                back = bpe.decode_bytes(ids)
                byte_ends = np.concatenate(([0], np.cumsum(bpe.byte_counts[ids])))
                decoded = [back[byte_ends[e - n] : byte_ends[e]] for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                # of invalid bytes the decoder makes marks; ids of valid texts decode to them exactly
                decoded = [d if d.isascii() else d.decode("utf-8", "replace").encode() for d in decoded]
                columns = [pa.array(counts, pa.int64()), pa.array([sha(x).hexdigest() for x in own], pa.string()), pa.array([sha(d).hexdigest() for d in decoded], pa.string())]
                if with_ids:
                    columns += [pa.array([x.view("<i4") for x in own], pa.list_(pa.int32())), pa.array([d.decode() for d in decoded], pa.string())]
                yield pa.RecordBatch.from_arrays([*(c[lo:hi] for c in batch.columns[: len(keep)]), *columns], names=[*keep, "n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"][: 2 * with_ids]])

    return docs.select(*keep, text).mapInArrow(common.released(run), out)
