"""One model and one vocabulary behind several views: encoding, masks, generation, and what the views cost."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.operators.augmented import Augmented, View
from corpuscle.operators.merge import Trie
from corpuscle.plans.model import Decoder, Kept, clone_kv, crop_kv, generated, kv_length


@dataclass
class PrefixStore:
    """Keys and values of sequences that were computed, for requests that begin alike."""

    most: int = 64
    least: int = 4
    lookups: int = 0
    hits: int = 0
    reused: int = 0
    computed: int = 0
    _kept: dict[tuple[int, ...], tuple[Kept, int, int]] = field(default_factory=dict)
    _next: int = 0

    def lookup(self, ids: list[int]) -> Kept:
        """A copy of what is kept of the deepest stored sequence that begins ids, or nothing."""
        self.lookups += 1
        for n in sorted({n for k in self._kept if self.least <= (n := len(k)) <= len(ids)}, reverse=True):
            if (key := tuple(ids[:n])) in self._kept:
                kept, hits, order = self._kept[key]
                self._kept[key] = kept, hits + 1, order
                self.hits, self.reused, self.computed = self.hits + 1, self.reused + n, self.computed + len(ids) - n
                return clone_kv(crop_kv(kept, n))
        self.computed += len(ids)
        return []

    def insert(self, ids: list[int], held: Kept) -> None:
        """A sequence that is long enough and new; beyond `most` the one with the fewest hits goes, the oldest first."""
        if len(ids) < self.least or tuple(ids) in self._kept:
            return
        self._kept[tuple(ids)] = clone_kv(held), 0, self._next
        self._next += 1
        while len(self._kept) > self.most:
            del self._kept[min(self._kept, key=lambda k: self._kept[k][1:])]

    def clear(self) -> None:
        """Drops the entries and keeps the counts."""
        self._kept.clear()

    @property
    def hit_rate(self) -> float:
        return self.hits / max(1, self.lookups)

    @property
    def reuse_rate(self) -> float:
        return self.reused / max(1, self.reused + self.computed)


@dataclass
class Router:
    model: Decoder
    vocabulary: Augmented
    _tries: dict[str, Trie] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.model.shape.vocab != self.vocabulary.total_size:
            raise ValueError(f"the model has {self.model.shape.vocab} rows, the vocabulary {self.vocabulary.total_size} ids")
        self.views: dict[str, View] = {v.name: v for v in self.vocabulary.views()}

    @property
    def names(self) -> list[str]:
        """The base view first, the others by name."""
        return list(self.views)

    def view(self, name: str) -> View:
        if name not in self.views:
            raise KeyError(f"no view {name}; there are {', '.join(self.names)}")
        return self.views[name]

    def mask(self, name: str) -> np.ndarray:
        return self.vocabulary.mask(self.view(name))

    # texts in columns, each row under the view that it names

    def encode(self, text: Column, view: Column) -> Column:
        return self.vocabulary.encode_each(text, view, self.views)

    def decode(self, ids: Column) -> Column:
        return self.vocabulary.decode(ids)

    def count(self, text: Column, view: Column) -> Column:
        return self.vocabulary.count_each(text, view, self.views)

    # single sequences, on the driver

    def ids(self, text: str, name: str) -> list[int]:
        if name not in self._tries:
            self._tries[name] = Trie(self.vocabulary.patterns(self.view(name)))
        from corpuscle.functions.text import N_SPECIAL

        return self._tries[name].merge([b + N_SPECIAL for b in text.encode()])

    def logits(self, ids: list[int], name: str) -> np.ndarray:
        """Of the next token, minus infinity where the view may not emit."""
        return self.model.forward(self.model.rows(ids or [0])[None])[0][0, -1] + self.mask(name)

    def generate(self, text: str, name: str, steps: int, store: PrefixStore | None = None) -> list[int]:
        """Greedy continuation. With a store, what it keeps of the longest stored prefix is not computed again, and the request is stored, whatever its view."""
        if store is None:
            return self.batch_generate([(text, name)], steps)[0]
        ids, may, out = self.ids(text, name) or [0], np.isfinite(self.mask(name)), []
        held = store.lookup(ids[:-1])
        new = ids[kv_length(held) :]
        seq = list(ids)
        for _ in range(steps):
            mask = np.ones((1, len(seq)), bool)
            out.append(int(np.where(may, self.model.ahead(self.model.rows(new)[None], mask, held)[0], -np.inf).argmax()))
            new = out[-1:]
            seq += new
        store.insert(ids, crop_kv(held, len(ids)))
        return out

    def batch_generate(self, requests: list[tuple[str, str]], steps: int) -> list[list[int]]:
        """Greedy continuations, views mixed; a request's answer is that of the request alone."""
        return self.model.generate([self.ids(t, v) for t, v in requests], [np.isfinite(self.mask(v)) for _, v in requests], steps)

    def answered(self, requests: DataFrame, steps: int) -> DataFrame:
        """requests: request, view, text. request, view, made, in Arrow batches."""
        views = {n: np.flatnonzero(self.vocabulary.open_ids(v)).tolist() for n, v in self.views.items()}
        encoded = requests.select("request", "view", self.encode(F.col("text"), F.col("view")).alias("ids"))
        return generated(encoded, self.model, views, steps)

    def timed(self, requests: list[tuple[str, str]], steps: int) -> list[dict]:
        """A row for each view: tokens, and the seconds of tokenizing, masking and the model."""
        out = []
        for name in dict.fromkeys(v for _, v in requests):
            own = [(t, v) for t, v in requests if v == name]
            a = time.perf_counter()
            ids = [self.ids(t, v) for t, v in own]
            b = time.perf_counter()
            masks = [np.isfinite(self.mask(v)) for _, v in own]
            c = time.perf_counter()
            made = self.model.generate(ids, masks, steps)
            d = time.perf_counter()
            out.append({"view": name, "prompt_tokens": sum(map(len, ids)), "made_tokens": sum(map(len, made)), "tokenize_seconds": b - a, "mask_seconds": c - b, "wall_seconds": d - a})
        return out


def load(packs: dict[str, list[tuple[int, ...]]], model: Decoder | None = None, seed: int = 0) -> Router:
    """A router over a model, grown by a composed row for each run of the packs."""
    from corpuscle.plans.synthesis import NORM_MATCHED, composed

    model, vocabulary = model or Decoder(seed=seed), Augmented()
    for lang, runs in packs.items():
        vocabulary.attach(lang, runs)
        rows = np.array([composed(model, list(run), NORM_MATCHED) for run in runs]).reshape(-1, model.shape.d)
        out = None if model.tied else np.array([model.unembed[run[0]] for run in runs]).reshape(-1, model.shape.d)
        model = model.appended(rows, out)
    return Router(model, vocabulary)
