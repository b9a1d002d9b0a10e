"""A small numpy decoder, and the stages that run it in Arrow batches over broadcast weights."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from corpuscle.functions.text import N_SPECIAL


@dataclass(frozen=True)
class Shape:
    vocab: int = 260
    d: int = 32
    layers: int = 2
    heads: int = 2
    d_ff: int = 64
    base: float = 10_000.0


class Decoder:
    """RMSNorm, rotary positions, causal attention and a gated feed-forward; weights from a seed.

    Inputs are rows of embeddings, so a new token is a row that stands in for several.
    """

    def __init__(self, shape: Shape = Shape(), seed: int = 0, tied: bool = False):
        r = np.random.default_rng(seed)
        self.tied, self.forward_tokens = tied, 0
        self.shape, d, f = shape, shape.d, shape.d_ff
        draw = lambda *s: (r.normal(size=s) / np.sqrt(s[0])).astype(np.float64)
        low = r.normal(size=(shape.vocab, 8)) @ r.normal(size=(8, d)) / np.sqrt(8)
        self.embed = low + 0.3 * r.normal(size=(shape.vocab, d))
        self.unembed = self.embed if tied else draw(d, shape.vocab).T
        self.blocks = [{k: draw(*s) for k, s in {"q": (d, d), "k": (d, d), "v": (d, d), "o": (d, d), "gate": (d, f), "up": (d, f), "down": (f, d)}.items()} for _ in range(shape.layers)]

    @property
    def n_params(self) -> int:
        return self.embed.size + (0 if self.tied else self.unembed.size) + sum(w.size for b in self.blocks for w in b.values())

    @property
    def output_matrix(self) -> np.ndarray | None:
        """The output rows, none of their own where they are the input rows."""
        return None if self.tied else self.unembed

    @property
    def row_norm_max(self) -> float:
        """No logit changes by more than this times the change of the hidden state."""
        return float(np.linalg.norm(self.unembed, axis=1).max())

    def save(self, path: str) -> None:
        """Weights and shape as one file of arrays."""
        blocks = {f"{k}.{name}": w for k, b in enumerate(self.blocks) for name, w in b.items()}
        np.savez(path, embed=self.embed, unembed=self.unembed, tied=self.tied, shape=[getattr(self.shape, k) for k in ("vocab", "d", "layers", "heads", "d_ff")], base=self.shape.base, **blocks)

    @staticmethod
    def load(path: str) -> "Decoder":
        """A model of the weights in a file that save() wrote."""
        with np.load(path) as f:
            shape = Shape(*map(int, f["shape"]), float(f["base"]))
            model = object.__new__(Decoder)
            model.shape, model.tied, model.forward_tokens = shape, bool(f["tied"]), 0
            model.embed = f["embed"]
            model.unembed = model.embed if model.tied else f["unembed"]
            model.blocks = [{name: f[f"{k}.{name}"] for name in ("q", "k", "v", "o", "gate", "up", "down")} for k in range(shape.layers)]
        return model

    def reset_cost(self) -> None:
        self.forward_tokens = 0

    def flops(self, gradient: bool = False) -> int:
        """Of the tokens that have gone forward, padding included."""
        return (6 if gradient else 2) * self.n_params * self.forward_tokens

    def row_params(self, n: int) -> int:
        """Parameters of n more vocabulary rows."""
        return n * self.shape.d * (1 if self.tied else 2)

    def effective_output_row(self, row: np.ndarray, out_row: np.ndarray | None) -> np.ndarray | None:
        """What a new token is emitted by: its own output row, its input row where the matrices are tied, else nothing."""
        return out_row if out_row is not None else row if self.tied else None

    def appended(self, rows: np.ndarray, out_rows: np.ndarray | None) -> "Decoder":
        """A model with more vocabulary rows; the rows there were stay as they are."""
        if rows.ndim != 2 or rows.shape[1] != self.shape.d or (out_rows is not None and rows.shape != out_rows.shape):
            raise ValueError("rows of another width")
        if self.tied and out_rows is not None and not np.array_equal(rows, out_rows):
            raise ValueError("a tied model has one row a token")
        if not self.tied and out_rows is None:
            raise ValueError("an untied model needs output rows")
        other = object.__new__(Decoder)
        other.shape = Shape(self.shape.vocab + len(rows), self.shape.d, self.shape.layers, self.shape.heads, self.shape.d_ff, self.shape.base)
        other.tied, other.forward_tokens, other.blocks = self.tied, 0, self.blocks
        other.embed = np.concatenate((self.embed, rows))
        other.unembed = other.embed if self.tied else np.concatenate((self.unembed, out_rows))
        assert np.array_equal(other.embed[: self.shape.vocab], self.embed) and np.array_equal(other.unembed[: self.shape.vocab], self.unembed)
        return other

    def resized(self, vocab: int) -> "Decoder":
        """Cut to fewer vocabulary rows, or grown by rows of zeros."""
        if vocab < self.shape.vocab:
            other = self.appended(np.zeros((0, self.shape.d)), None if self.tied else np.zeros((0, self.shape.d)))
            other.shape = Shape(vocab, *[getattr(self.shape, k) for k in ("d", "layers", "heads", "d_ff", "base")])
            other.embed = other.embed[:vocab]
            other.unembed = other.embed if self.tied else other.unembed[:vocab]
            return other
        more = np.zeros((vocab - self.shape.vocab, self.shape.d))
        return self.appended(more, None if self.tied else more)

    def padded(self, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Sequences of rows as one batch, padded on the right, and which positions hold a row."""
        wide = max(map(len, sequences))
        mask = np.arange(wide) < np.array([len(s) for s in sequences])[:, None]
        x = np.zeros((len(sequences), wide, self.shape.d))
        x[mask] = np.concatenate(sequences)
        return x, mask

    @staticmethod
    def norm(x: np.ndarray) -> np.ndarray:
        return x / np.sqrt((x * x).mean(-1, keepdims=True) + 1e-6)

    def rotate(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        half = x.shape[-1] // 2
        angle = at[:, None, :, None] * self.shape.base ** (-np.arange(half) / half)
        a, b = x[..., ::2], x[..., 1::2]
        cos, sin, out = np.cos(angle), np.sin(angle), np.empty_like(x)
        out[..., ::2], out[..., 1::2] = a * cos - b * sin, a * sin + b * cos
        return out

    def forward(self, x: np.ndarray, mask: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Logits and last hidden states of a batch of rows of embeddings; mask: which positions hold a token."""
        logits, states = self.trace(x, mask)
        return logits, states[-1]

    def trace(self, x: np.ndarray, mask: np.ndarray | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
        """Logits and the hidden states after each layer, the last one normalised."""
        n, t, d = x.shape
        self.forward_tokens += n * t
        states = []
        mask = np.ones((n, t), bool) if mask is None else mask
        at = np.maximum(np.cumsum(mask, 1) - 1, 0)  # padding on the left does not move a token
        see = np.tril(np.ones((t, t), bool))[None] & mask[:, None, :]
        h, each = self.shape.heads, d // self.shape.heads
        for b in self.blocks:
            y = self.norm(x)
            q, k, v = ((y @ b[w]).reshape(n, t, h, each).transpose(0, 2, 1, 3) for w in "qkv")
            score = self.rotate(q, at) @ self.rotate(k, at).transpose(0, 1, 3, 2) / np.sqrt(each)
            score = np.where(see[:, None], score, -1e30)
            p = np.exp(score - score.max(-1, keepdims=True))
            x = x + ((p / p.sum(-1, keepdims=True)) @ v).transpose(0, 2, 1, 3).reshape(n, t, d) @ b["o"]
            y = self.norm(x)
            g = y @ b["gate"]
            x = x + (g / (1 + np.exp(-g)) * (y @ b["up"])) @ b["down"]
            states.append(x)
        states[-1] = self.norm(x)
        return states[-1] @ self.unembed.T, states

    def rows(self, ids: list[int]) -> np.ndarray:
        return self.embed[np.asarray(ids, int)]

    def logprob(self, ids: list[int], first: int = 0, open_ids: np.ndarray | None = None) -> float:
        """Log probability of a sequence after one fixed id; open_ids: what the view may emit."""
        z, _ = self.forward(self.rows([first, *ids])[None])
        if open_ids is not None:
            z = np.where(open_ids, z, -np.inf)
        lp = log_softmax(z[0, :-1])
        return float(lp[np.arange(len(ids)), ids].sum())

    def ahead(self, x: np.ndarray, mask: np.ndarray, held: list[tuple[np.ndarray, np.ndarray]], span: int = 32) -> np.ndarray:
        """Logits after the last position of a batch; x: rows of the new positions, mask: of all positions, held: keys and values of the positions before, which the new ones join.

        The last layer is computed for the last position alone, and `span` positions attend at once.
        """
        n, new, d = x.shape
        self.forward_tokens += n * new
        h, each = self.shape.heads, d // self.shape.heads
        at = np.maximum(np.cumsum(mask, 1) - 1, 0)[:, -new:]
        for layer, b in enumerate(self.blocks):
            part = lambda y, w: (y @ b[w]).reshape(n, -1, h, each).transpose(0, 2, 1, 3)  # noqa: B023, E731
            y = self.norm(x)
            k, v = self.rotate(part(y, "k"), at), part(y, "v")
            if layer < len(held):
                k, v = np.concatenate((held[layer][0], k), 2), np.concatenate((held[layer][1], v), 2)
                held[layer] = k, v
            else:
                held.append((k, v))
            if layer == len(self.blocks) - 1:
                x, y, at = x[:, -1:], y[:, -1:], at[:, -1:]
            first, made = mask.shape[1] - x.shape[1], np.empty_like(x)
            for lo in range(0, x.shape[1], span):
                hi = min(lo + span, x.shape[1])
                see = (np.arange(first + hi) <= first + np.arange(lo, hi)[:, None])[None] & mask[:, None, : first + hi]
                score = (self.rotate(part(y[:, lo:hi], "q"), at[:, lo:hi]) / np.sqrt(each)) @ k[:, :, : first + hi].transpose(0, 1, 3, 2)
                np.copyto(score, -1e30, where=~see[:, None])
                score -= score.max(-1, keepdims=True)
                p = np.exp(score, out=score)
                made[:, lo:hi] = (p @ v[:, :, : first + hi] / p.sum(-1, keepdims=True)).transpose(0, 2, 1, 3).reshape(n, hi - lo, d)
            x = x + made @ b["o"]
            y = self.norm(x)
            g = y @ b["gate"]
            x = x + (g / (1 + np.exp(-g)) * (y @ b["up"])) @ b["down"]
        return self.norm(x[:, -1]) @ self.unembed.T

    def generate(self, prompts: list[list[int]], open_ids: list[np.ndarray], steps: int) -> list[list[int]]:
        """Greedy continuations of a batch, padded on the left; each row under its own view."""
        seqs = [np.asarray(p, int) if len(p) else np.zeros(1, int) for p in prompts]
        may, wide = np.array(open_ids), max(map(len, seqs))
        mask = np.arange(wide) >= wide - np.array([len(s) for s in seqs])[:, None]
        x, out, held = np.zeros((len(seqs), wide, self.shape.d)), [], []
        x[mask] = self.rows(np.concatenate(seqs))
        for _ in range(steps):
            out.append(np.where(may, self.ahead(x, mask, held), -np.inf).argmax(1))
            x, mask = self.rows(out[-1])[:, None], np.pad(mask, ((0, 0), (0, 1)), constant_values=True)
        return np.stack(out, 1).tolist() if out else [[] for _ in prompts]


Kept = list[tuple[np.ndarray, np.ndarray]]


def clone_kv(held: Kept) -> Kept:
    """Keys and values of each layer, copied."""
    return [(k.copy(), v.copy()) for k, v in held]


def crop_kv(held: Kept, n: int) -> Kept:
    """Of the first n positions."""
    return [(k[:, :, :n], v[:, :, :n]) for k, v in held]


def kv_length(held: Kept) -> int:
    """Positions that are kept."""
    return held[0][0].shape[2] if held else 0


def log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(-1, keepdims=True)
    return z - np.log(np.exp(z).sum(-1, keepdims=True))


def compose(model: Decoder, ids: list[int], weights: np.ndarray | None = None, matched: bool = True) -> np.ndarray:
    """A row for a run of tokens: their weighted mean, scaled to the vocabulary's mean norm."""
    w = np.ones(len(ids)) if weights is None else weights
    row = (w[:, None] * model.rows(ids)).sum(0) / w.sum()
    size = np.linalg.norm(row)
    return row * np.linalg.norm(model.embed, axis=1).mean() / size if matched and size > 0 else row


def _contexts(prefixes: list[list[int]], suffixes: list[list[int]]) -> list[tuple[list[int], list[int]]]:
    return [(p, s) for p, s in zip(prefixes, suffixes, strict=True) if p or s]


def _residual(model: Decoder, row: np.ndarray, ids: list[int], contexts: list[tuple[list[int], list[int]]], targets: list[np.ndarray]) -> np.ndarray:
    parts = []
    for (p, s), target in zip(contexts, targets, strict=True):
        x = np.concatenate((model.rows(p), row[None], model.rows(s)))
        parts.append((model.forward(x[None])[1][0, len(p) :] - target).ravel())
    return np.concatenate(parts)


def synthesize(model: Decoder, ids: list[int], contexts: list[tuple[list[int], list[int]]], q: int = 6, rounds: int = 2, seed: int = 0) -> tuple[np.ndarray, float, float]:
    """A row fitted so that the states after it are those after the run; the residual before and after.

    Damped Gauss-Newton steps in a small basis; a step that does not lower the residual is not taken.
    """
    row = compose(model, ids)
    targets = [model.forward(np.concatenate((model.rows(p), model.rows(ids), model.rows(s)))[None])[1][0, len(p) + len(ids) - 1 :] for p, s in contexts]
    extra = np.random.default_rng(seed).normal(size=(max(0, q - len(ids)), model.shape.d))
    basis = np.linalg.qr(np.concatenate((model.rows(ids), extra)).T)[0][:, :q]
    r = _residual(model, row, ids, contexts, targets)
    before = now = float(r @ r)
    for _ in range(rounds):
        eps = 1e-4
        jacobian = np.stack([(_residual(model, row + eps * basis[:, k], ids, contexts, targets) - r) / eps for k in range(basis.shape[1])], 1)
        normal = jacobian.T @ jacobian
        step = np.linalg.solve(normal + 1e-3 * np.trace(normal) / len(normal) * np.eye(len(normal)) + 1e-12 * np.eye(len(normal)), -jacobian.T @ r)
        tried = row + basis @ step
        r2 = _residual(model, tried, ids, contexts, targets)
        if float(r2 @ r2) >= now:
            break
        row, r, now = tried, r2, float(r2 @ r2)
    return row, before, now


def output_row(model: Decoder, ids: list[int], prefixes: list[list[int]], ridge: float = 0.1, trust: float = 1.0) -> np.ndarray:
    """The row by which a run's token would be emitted with the probability of the whole run, fitted by ridge regression around the row of the run's first id."""
    anchor = model.unembed[ids[0]]
    states, wanted = [], []
    for p in prefixes:
        if p:
            z, last = model.forward(np.concatenate((model.rows(p), model.rows(ids)))[None])
            at = np.arange(len(ids)) + len(p) - 1
            log_p = float(log_softmax(z[0, at])[np.arange(len(ids)), ids].sum())
            states.append(last[0, at[0]])
            wanted.append(log_p + log_total(z[0, at[0]]) - np.log1p(-min(np.exp(log_p), 1 - 1e-12)))
    if len(states) < 2:
        return anchor.copy()
    h = np.stack(states)
    weight = ridge * (h * h).sum(1).mean() * max(1.0, h.shape[1] / len(h))
    delta = np.linalg.solve(h.T @ h + weight * np.eye(h.shape[1]), h.T @ (np.array(wanted) - h @ anchor))
    return anchor + delta * min(1.0, trust * np.linalg.norm(anchor) / max(np.linalg.norm(delta), 1e-12))


def log_total(z: np.ndarray) -> float:
    return float(z.max() + np.log(np.exp(z - z.max()).sum()))


def drift_of(model: Decoder, row: np.ndarray, ids: list[int], p: list[int], s: list[int]) -> tuple[float, float, float]:
    """KL, TV and sup norm of the next token's distribution after the run and after its row."""
    z = model.forward(np.concatenate((model.rows(p), model.rows(ids)))[None])[0][0, -1]
    z2 = model.forward(np.concatenate((model.rows(p), row[None]))[None])[0][0, -1]
    lp, lq = log_softmax(z), log_softmax(z2)
    return max(0.0, float((np.exp(lp) * (lp - lq)).sum())), float(0.5 * np.abs(np.exp(lp) - np.exp(lq)).sum()), float(np.abs(z - z2).max())


SYNTHESIZED = "token string, row array<double>, out_row array<double>, before double, after double, n_contexts long"


def synthesized(contexts: DataFrame, model: Decoder, most: int = 16) -> DataFrame:
    """contexts: token, ids, prefix, suffix (arrays of ids). A row for each token, from at most `most` of its contexts."""
    held = contexts.sparkSession.sparkContext.broadcast(model)  # weights of a fixed shape

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["prefix", "suffix"], key=lambda c: c.map(lambda x: tuple(x))).head(most)
        ids = list(rows["ids"].iloc[0])
        found = _contexts([list(x) for x in rows["prefix"]], [list(x) for x in rows["suffix"]])
        names = ["token", "row", "out_row", "before", "after", "n_contexts"]
        if not found:
            return pd.DataFrame([], columns=names)
        row, before, after = synthesize(held.value, ids, found)
        return pd.DataFrame([(rows["token"].iloc[0], row.tolist(), output_row(held.value, ids, [p for p, _ in found]).tolist(), before, after, len(found))], columns=names)

    return contexts.groupBy("token").applyInPandas(run, SYNTHESIZED)


def measured(contexts: DataFrame, rows: DataFrame, model: Decoder) -> DataFrame:
    """token, kl, tv, linf at each context, of the rows synthesized for the tokens."""
    held = contexts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(t, *drift_of(held.value, np.asarray(row), list(i), list(p), list(s))) for t, row, i, p, s in zip(b["token"], b["row"], b["ids"], b["prefix"], b["suffix"], strict=True)]
            yield pd.DataFrame(out, columns=["token", "kl", "tv", "linf"])

    joined = contexts.join(rows.select("token", "row"), "token").select("token", "row", "ids", "prefix", "suffix")
    return joined.mapInPandas(run, "token string, kl double, tv double, linf double")


def off_context(negatives: DataFrame, rows: DataFrame, model: Decoder) -> DataFrame:
    """token, mass: the probability that each token would take at each position where its run does not follow.

    negatives: prefix, following (arrays of ids); rows: token, ids, out_row, a short list.
    """
    held = negatives.sparkSession.sparkContext.broadcast((model, [(r["token"], list(r["ids"]), np.asarray(r["out_row"])) for r in rows.collect()]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder, tokens = held.value
        for b in batches:
            out = []
            for prefix, following in zip(b["prefix"], b["following"], strict=True):
                z, last = decoder.forward(decoder.rows(list(prefix))[None])
                total = log_total(z[0, -1])
                out += [(t, 1 / (1 + float(np.exp(total - last[0, -1] @ w)))) for t, ids, w in tokens if list(following[: len(ids)]) != ids]
            yield pd.DataFrame(out, columns=["token", "mass"])

    return negatives.mapInPandas(run, "token string, mass double")


def generated(requests: DataFrame, model: Decoder, views: dict[str, list[int]], steps: int = 4, cells: int = 1 << 13) -> DataFrame:
    """requests: request, view, ids (an array, or byte tokens as a binary, which needs no Python step before). Continuations of all requests, views mixed in a batch; a batch is requests of like length, of `cells` ids in all with their padding, or one request."""
    held, in_bytes = requests.sparkSession.sparkContext.broadcast(model), dict(requests.dtypes)["ids"] == "binary"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        may = {}
        for name, ids in views.items():
            may[name] = np.zeros(held.value.shape.vocab, bool)
            may[name][ids] = True
        for b in batches:
            b = b.iloc[np.argsort(-b["ids"].map(len).to_numpy(), kind="stable")]
            own = (lambda x: np.frombuffer(x, np.uint8).astype(int) + N_SPECIAL) if in_bytes else (lambda x: x)
            at = 0
            while at < len(b):
                part = b.iloc[at : at + max(1, cells // max(1, len(b["ids"].iloc[at])))]
                at += len(part)
                made = held.value.generate([own(x) for x in part["ids"]], [may[v] for v in part["view"]], steps)
                yield pd.DataFrame({"request": part["request"].to_numpy(), "view": part["view"].to_numpy(), "made": made})

    return requests.mapInPandas(run, "request long, view string, made array<int>")
