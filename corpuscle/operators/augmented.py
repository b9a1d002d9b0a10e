"""An append-only vocabulary: a base of ids, packs of merged runs for languages, and views that say which packs act.

What a vocabulary holds is small and lives on the driver; texts are encoded by columns. Under a view
the runs of its languages are merged, later languages winning a run that several have; under the base
view nothing is. Whatever the view, ids expand to the same base ids.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.functions.text import N_SPECIAL, byte_ids, byte_tokens
from corpuscle.operators.grams import chunks
from corpuscle.operators.merge import Expander, Merger, Trie, by_slices, changed, flat, merge_ids, slices, within
from corpuscle.operators.tokenizers import fingerprint


def byte_array(text: str | None) -> np.ndarray | None:
    """Base ids of a text's bytes."""
    return None if text is None else np.frombuffer(text.encode(), np.uint8).astype(np.int64) + N_SPECIAL


def base_bytes(ids: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bytes of base ids, those out of range dropped, and their offsets."""
    good = (ids >= N_SPECIAL) & (ids < 256 + N_SPECIAL)
    return (ids[good] - N_SPECIAL).astype(np.uint8).tobytes(), np.concatenate(([0], np.cumsum(good)))[offsets]


@dataclass(frozen=True)
class View:
    langs: tuple[str, ...] = ()
    input_only: bool = False

    @property
    def name(self) -> str:
        return "+".join(self.langs) + ":in" * self.input_only if self.langs else "base"

    @property
    def is_base(self) -> bool:
        return not self.langs


@dataclass
class Augmented:
    base_size: int = 256 + N_SPECIAL
    base_print: str | None = None
    #: Of each language, new id by run of base ids.
    packs: dict[str, dict[tuple[int, ...], int]] = field(default_factory=dict)
    _by_id: dict[int, tuple[str, tuple[int, ...]]] = field(default_factory=dict)
    _tries: dict[tuple[str, ...], dict[tuple[int, ...], int]] = field(default_factory=dict)

    def attach(self, lang: str, runs: Iterable[tuple[int, ...]], base_size: int | None = None, base_print: str | None = None) -> dict[tuple[int, ...], int]:
        """Appends a pack's runs in order. Refused: another base, a language that is there, a run that is no run of base ids."""
        if base_size not in (None, self.base_size):
            raise ValueError(f"the pack is for a base of {base_size} ids, not {self.base_size}")
        if base_print is not None and self.base_print is not None and base_print != self.base_print:
            raise ValueError("the pack is for another base tokenizer")
        if lang in self.packs:
            raise ValueError(f"{lang} has a pack")
        self.packs[lang] = {}
        return self.add_tokens(lang, runs)

    def add_tokens(self, lang: str, runs: Iterable[tuple[int, ...]]) -> dict[tuple[int, ...], int]:
        """Appends runs to a language's pack, new or not; of a run that comes twice the last id acts."""
        made = {}
        for run in map(tuple, runs):
            if len(run) < 2 or min(run) < 0 or max(run) >= self.base_size:
                raise ValueError(f"{run} is no run of base ids")
            new = self.total_size
            self.packs.setdefault(lang, {})[run] = made[run] = new
            self._by_id[new] = lang, run
        self._tries.clear()
        return made

    @property
    def total_size(self) -> int:
        return self.base_size + len(self._by_id)

    @property
    def n_added(self) -> int:
        return len(self._by_id)

    @property
    def langs(self) -> list[str]:
        return sorted(self.packs)

    def view(self, *langs: str, input_only: bool = False) -> View:
        if missing := [x for x in langs if x not in self.packs]:
            raise KeyError(f"no pack for {', '.join(missing)}")
        return View(tuple(sorted(set(langs))), input_only)

    def views(self) -> list[View]:
        """The base view, then each language's, with and without leave to emit, by name."""
        return [View(), *sorted((View((x,), i) for x in self.packs for i in (False, True)), key=lambda v: v.name)]

    def patterns(self, view: View) -> dict[tuple[int, ...], int]:
        """Runs that act under the view."""
        if view.langs not in self._tries:
            merged: dict[tuple[int, ...], int] = {}
            for lang in view.langs:
                merged |= self.packs[lang]
            self._tries[view.langs] = merged
        return self._tries[view.langs]

    # columns of ids

    def encode_ids(self, ids: Column, view: View) -> Column:
        patterns = self.patterns(view)
        return merge_ids(ids, patterns) if patterns else ids

    def encode(self, text: Column, view: View) -> Column:
        """Ids of a text over a base of bytes."""
        patterns = self.patterns(view)
        if not patterns:
            return byte_ids(byte_tokens(text))

        @F.pandas_udf("array<int>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            merger = Merger(patterns)
            for s in batches:
                yield by_slices(s.map(byte_array), merger)

        return run(text)

    def encode_each(self, text: Column, view: Column, views: dict[str, View]) -> Column:
        """Ids of texts, each under the view that its row names."""
        return self._each(text, view, views, "array<int>", lambda ids, ends, rows: [ids[a:b].astype(np.int32) for a, b in zip(ends, ends[1:], strict=False)])

    def count_each(self, text: Column, view: Column, views: dict[str, View]) -> Column:
        """How many ids encode_each() makes, which then never leave the task."""
        return self._each(text, view, views, "long", lambda ids, ends, rows: np.diff(ends).tolist())

    def _each(self, text: Column, view: Column, views: dict[str, View], kind: str, told: Callable[[np.ndarray, np.ndarray, np.ndarray], list]) -> Column:
        packs = {name: self.patterns(v) for name, v in views.items()}

        @F.pandas_udf(kind)
        def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            mergers = {name: Merger(p) for name, p in packs.items()}
            for texts, named in batches:
                out = np.full(len(texts), None, object)
                texts, named = texts.to_numpy(), named.to_numpy()
                for name in pd.unique(named):
                    if name not in mergers:
                        raise KeyError(f"no view {name}")
                    rows = np.flatnonzero((named == name) & pd.notna(texts))
                    for lo, hi in slices(np.array([len(t) for t in texts[rows]], np.int64)):
                        part = rows[lo:hi]
                        made = told(*mergers[name](*flat([byte_array(t) for t in texts[part]])), part)
                        for row, x in zip(part, made, strict=True):
                            out[row] = x
                yield pd.Series(out) if kind != "long" else pd.Series(out, dtype="Int64")

        return run(text, view)

    def count(self, text: Column, view: View) -> Column:
        return F.size(self.encode(text, view)).cast("long")

    def to_base(self, ids: Column) -> Column:
        """Base ids, the same under every view."""
        if not self._by_id:
            return ids
        table = F.create_map(*[x for new, (_, run) in self._by_id.items() for x in (F.lit(new), F.array(*map(F.lit, run)))])
        return F.flatten(F.transform(ids, lambda i: F.coalesce(F.try_element_at(table, i), F.array(i))))

    def decode(self, ids: Column) -> Column:
        """Text of ids over a base of bytes; ids out of range are dropped, invalid bytes become marks."""
        runs = {new: run for new, (_, run) in self._by_id.items()}

        @F.pandas_udf("binary")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            expander = Expander(runs)
            for s in batches:
                rows, out = s.tolist(), []
                for lo, hi in slices(np.array([0 if x is None else len(x) for x in rows], np.int64)):
                    own = [x if x is None or x.dtype.kind == "i" else x[~np.isnan(x)] for x in rows[lo:hi]]  # a null is no id
                    made, ends = base_bytes(*expander(*flat(own)))
                    out += [None if x is None else made[a:b] for x, a, b in zip(own, ends, ends[1:], strict=False)]
                yield pd.Series(out, dtype=object)

        return F.make_valid_utf8(run(ids).cast("string"))

    def isolation(self, rows: DataFrame, views: dict[str, View]) -> DataFrame:
        """view, lang, n_tokens, n_new, not_lossless of texts (lang, text): tokens under each view, those of the view's packs, and texts that do not come back or hold an id of another pack. One pass; texts are encoded and decoded inside tasks."""
        packs, runs, base = {name: self.patterns(v) for name, v in views.items()}, {new: run for new, (_, run) in self._by_id.items()}, self.base_size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mergers, expander = {name: (Merger(p), np.array(sorted(p.values()), np.int64)) for name, p in packs.items()}, Expander(runs)
            sums: dict[tuple, np.ndarray] = {}
            for batch in batches:
                for lang, x in chunks(batch):
                    ids, offsets = x.data.astype(np.int64) + N_SPECIAL, np.append(x.start, len(x.data))
                    for name, (merger, own) in mergers.items():
                        made, ends = merger(ids, offsets)
                        back, edges = base_bytes(*expander(made, ends))
                        ours = np.isin(made, own)
                        sums[name, lang] = sums.get((name, lang), np.zeros(3, np.int64)) + (len(made), np.count_nonzero(ours), changed(x.data, offsets, np.frombuffer(back, np.uint8), edges) + within((made >= base) & ~ours, ends))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.string()), *(pa.array([int(v[k]) for v in sums.values()], pa.int64()) for k in range(3))], names=["view", "lang", "n_tokens", "n_new", "not_lossless"])

        made = rows.filter("text IS NOT NULL").select("lang", "text").mapInArrow(run, "view string, lang string, n_tokens long, n_new long, not_lossless long")
        return made.groupBy("view", "lang").agg(*[F.sum(c).alias(c) for c in ("n_tokens", "n_new", "not_lossless")])

    def pieces(self, ids: Column) -> Column:
        """How ids are shown: <xx> for bytes, the text of a merged run in brackets."""
        byte = lambda i: F.concat(F.lit("<"), F.lower(F.lpad(F.hex(i - N_SPECIAL), 2, "0")), F.lit(">"))
        named = self._table({new: f"[{self.surface(new)}]" for new in self._by_id})
        return F.transform(ids, lambda i: F.coalesce(F.try_element_at(named, i), byte(i))) if self._by_id else F.transform(ids, byte)

    @staticmethod
    def _table(values: dict[int, str]) -> Column:
        return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))])

    def surfaces_of(self, ids: Column) -> Column:
        """The text of each added id, empty for base ids."""
        if not self._by_id:
            return F.transform(ids, lambda i: F.lit(""))
        named = self._table({new: self.surface(new) for new in self._by_id})
        return F.transform(ids, lambda i: F.coalesce(F.try_element_at(named, i), F.lit("")))

    def langs_of(self, ids: Column) -> Column:
        """The language of each added id, empty for base ids."""
        if not self._by_id:
            return F.transform(ids, lambda i: F.lit(""))
        named = self._table({new: lang for new, (lang, _) in self._by_id.items()})
        return F.transform(ids, lambda i: F.coalesce(F.try_element_at(named, i), F.lit("")))

    # single ids

    def expansion(self, new: int) -> tuple[int, ...]:
        return self._by_id[new][1]

    def surface(self, new: int) -> str:
        run = self._by_id.get(new, ("", ()))[1]
        return bytes(i - N_SPECIAL for i in run if 0 <= i - N_SPECIAL < 256).decode("utf-8", "replace")

    def lang_of(self, new: int) -> str:
        return self._by_id.get(new, ("", ()))[0]

    # views of the id range

    def open_ids(self, view: View) -> np.ndarray:
        """Which of all ids the view may emit: base ids, and its packs' unless it only reads."""
        out = np.zeros(self.total_size, bool)
        out[: self.base_size] = True
        if not view.input_only:
            out[[new for lang in view.langs for new in self.packs[lang].values()]] = True
        return out

    def mask(self, view: View) -> np.ndarray:
        """Added to logits: 0 where the view may emit, minus infinity elsewhere."""
        return np.where(self.open_ids(view), 0.0, -np.inf)

    def fingerprint(self, probes: list[str]) -> str:
        """Of the size and of the probes under the view of all packs."""
        trie = Trie(self.patterns(self.view(*self.langs)))
        return fingerprint(self.total_size, [trie.merge([b + N_SPECIAL for b in p.encode()]) for p in probes])

    def check(self) -> dict[str, int]:
        """Counts of violations, all 0 for a sound vocabulary."""
        new = sorted(self._by_id)
        open_base = self.open_ids(View())
        return {
            "gaps": sum(a != b for a, b in zip(new, range(self.base_size, self.total_size), strict=True)),
            "below_base": sum(i < self.base_size for i in new),
            "outside_base": sum(i >= self.base_size for _, run in self._by_id.values() for i in run),
            "open_to_base_view": int(open_base[self.base_size :].sum()),
            "shared_by_languages": len(new) - len({i for i in new if self.lang_of(i)}),
        }


def attach_and_verify(vocabulary: Augmented, model, lang: str, runs: list[tuple[int, ...]], rows: np.ndarray, out_rows: np.ndarray):  # noqa: ANN001, ANN201
    """Attaches a pack, appends its rows to a model and holds both against each other; the larger model."""
    vocabulary.attach(lang, runs, base_size=vocabulary.base_size)
    if model.shape.vocab + len(rows) != vocabulary.total_size or len(rows) != len(runs):
        raise ValueError("rows and runs do not match")
    larger = model.appended(rows, out_rows)
    if any(vocabulary.check().values()) or (larger.embed[: model.shape.vocab] != model.embed).any():
        raise ValueError("the vocabulary is not sound")
    return larger
