"""Language identification with a byte convolutional network, trained in numpy.

Texts are cut into fixed windows of UTF-8 bytes (the last one ends at the text's end). Bytes are embedded, filters of
several widths slide over each window, their maxima over the window feed a softmax layer; a document's score of a
language is the mean probability over its windows. Prediction turns the first layer into lookup tables of byte pairs,
so a window costs a few gathers.

The network is fitted on the driver on a bounded sample: about ``SAMPLE`` labelled documents of each language (by a
hash of their id), one window of each. Everything else reads whole texts.

Defined results: ``und`` with score 0 for texts that are null or have no letter, and for all texts if nothing can be
learned (no labelled text with a letter); repeated rows are scored each; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernlake.llm.common import chunks, crc_mod, stored, text_bytes

#: Labelled documents of each language that the network is fitted on, at most about so many.
SAMPLE = 1500
WINDOW, WIDTHS, FILTERS, EMBED = 192, (2, 3, 4), 16, 12


def window_matrix(texts: list[bytes], size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all windows, zero-padded, and the text that each belongs to. Every byte lies in a window."""
    buf = np.frombuffer(b"".join(texts) + b"\0", np.uint8)
    lengths = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(lengths) - lengths
    n = np.maximum(1, -(-lengths // size))
    owner = np.repeat(np.arange(len(texts)), n)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    start = np.maximum(0, np.minimum(nth * size, lengths[owner] - size))
    at = start[:, None] + np.arange(size)
    inside = at < lengths[owner][:, None]
    out = buf[np.where(inside, at + begin[owner][:, None], len(buf) - 1)]
    return out, owner


@dataclass
class ByteCnn:
    langs: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]  # (width, EMBED, FILTERS) each
    bias: list[np.ndarray]
    dense: np.ndarray
    dense_bias: np.ndarray

    @staticmethod
    def fresh(langs: list[str], seed: int = 5) -> ByteCnn:
        r = np.random.default_rng(seed)
        shape = [(w, EMBED, FILTERS) for w in WIDTHS]
        norm = lambda *s, scale: r.normal(0, scale, s).astype(np.float32)
        return ByteCnn(langs, norm(256, EMBED, scale=0.5), [norm(*s, scale=(s[0] * EMBED) ** -0.5) for s in shape], [np.zeros(FILTERS, np.float32) for _ in WIDTHS], norm(len(WIDTHS) * FILTERS, len(langs), scale=0.1), np.zeros(len(langs), np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, *self.bias, self.dense, self.dense_bias]

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 4e-3, seed: int = 6) -> None:
        r, step = np.random.default_rng(seed), 0
        m, v = [np.zeros_like(p) for p in self.parts()], [np.zeros_like(p) for p in self.parts()]
        weight = (len(y) / (np.bincount(y, minlength=len(self.langs)) * len(self.langs) + 1e-9)).astype(np.float32)
        for _ in range(epochs):
            for part in np.array_split(r.permutation(len(x)), max(1, len(x) // batch)):
                step += 1
                for p, g, a, b in zip(self.parts(), self._gradients(x[part], y[part], weight), m, v, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-7)

    def _gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        e, rows = self.embed[x], np.arange(len(x))
        pooled, best, seen = [], [], []
        for w, f, b in zip(WIDTHS, self.filters, self.bias, strict=True):
            cols = np.concatenate([e[:, k : e.shape[1] - w + 1 + k] for k in range(w)], axis=2)
            z = cols @ f.reshape(-1, FILTERS) + b
            best.append(z.argmax(axis=1))
            pooled.append(z.max(axis=1))
            seen.append(cols)
        h = np.concatenate(pooled, axis=1)
        active = np.maximum(h, 0)
        p = softmax(active @ self.dense + self.dense_bias)
        p[rows, y] -= 1
        p *= (weight[y] / len(x))[:, None]
        gh = (p @ self.dense.T) * (h > 0)
        ge, gf, gb = np.zeros_like(self.embed), [], []
        for i, (w, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            g = gh[:, i * FILTERS : (i + 1) * FILTERS]
            got = seen[i][rows[:, None], best[i]]  # the columns under each filter's maximum
            gf.append(np.einsum("nfc,nf->cf", got, g).reshape(f.shape))
            gb.append(g.sum(axis=0))
            for k in range(w):
                np.add.at(ge, x[rows[:, None], best[i] + k].ravel(), np.einsum("nf,cf->nfc", g, f[k]).reshape(-1, EMBED))
        return [ge, *gf, *gb, active.T @ p, p.sum(axis=0)]

    def tables(self) -> list[list[np.ndarray]]:
        """For each width the outputs of byte pairs, and of a last single byte where the width is odd."""
        out = []
        for f, b in zip(self.filters, self.bias, strict=True):
            t = [self.embed @ f[k] for k in range(len(f))]
            t[0] = t[0] + b
            pairs = [(t[k][:, None] + t[k + 1][None]).reshape(-1, FILTERS) for k in range(0, len(t) - 1, 2)]
            out.append(pairs + ([t[-1]] if len(t) % 2 else []))
        return out

    def probabilities(self, x: np.ndarray, tables: list[list[np.ndarray]], block: int = 512) -> np.ndarray:
        out = []
        for lo in range(0, len(x), block):
            b = x[lo : lo + block].astype(np.int32)
            pair = (b[:, :-1] << 8) | b[:, 1:]
            pooled = []
            for w, ts in zip(WIDTHS, tables, strict=True):
                n = b.shape[1] - w + 1
                z = ts[0].take(pair[:, :n], axis=0)
                for k, t in enumerate(ts[1:], 1):
                    z += t.take((pair if len(t) > 256 else b)[:, 2 * k : 2 * k + n], axis=0)
                pooled.append(z.max(axis=1))
            out.append(softmax(np.maximum(np.concatenate(pooled, axis=1), 0) @ self.dense + self.dense_bias))
        return np.concatenate(out) if out else np.zeros((0, len(self.langs)), np.float32)


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def sampled(docs: DataFrame, label: str, most: int, id_col: str, seed: int):
    """Rows of each label, about ``most`` of them at the most, chosen by a hash of the id."""
    counts = {r[0]: r[1] for r in docs.groupBy(label).count().collect()}
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, most / n))]) if counts else None
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return docs.where(draw < share[F.col(label)]) if counts else docs


def within_bytes(docs: DataFrame, id_col: str, text_col: str, most: int, row: int) -> DataFrame:
    """The rows of a sample with texts of at most ``row`` bytes, thinned by a hash of the id and the text to about ``most`` bytes."""
    size = F.coalesce(F.octet_length(text_col), F.lit(0))
    kept = stored(docs.where(size <= row))
    total = kept.agg(F.sum(size)).first()[0] or 0
    draw = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.lit(13)), F.lit(1 << 30)) / float(1 << 30)
    return kept.where(draw < most / total) if total > most else kept


def fit(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample: int = SAMPLE) -> ByteCnn | None:
    """Learn from the labelled rows of ``docs``; None if there are none with a letter."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    at = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.greatest(F.char_length("text") - WINDOW, F.lit(1))) + 1
    rows = sampled(known, "lang", sample, "doc_id", 11).select("doc_id", "lang", F.substring(F.col("text"), at.cast("int"), F.lit(WINDOW)).alias("text")).collect()
    rows = sorted((r for r in rows if r["text"]), key=lambda r: (r["doc_id"] is None, r["doc_id"], r["text"]))
    if not rows:
        return None
    langs = sorted({r["lang"] for r in rows})
    x, owner = window_matrix([t[:WINDOW] for t in text_bytes(r["text"] for r in rows)])
    net = ByteCnn.fresh(langs)
    net.fit(x, np.array([langs.index(rows[o]["lang"]) for o in owner]))
    return net


_tables: dict[bytes, list] = {}


def score_batch(net: ByteCnn | None, values: pd.Series, letter: pd.Series) -> pd.DataFrame:
    """lang_pred and score of some texts; those without letters are ``und``."""
    pred, score = ["und"] * len(values), np.zeros(len(values))
    if net:
        key = net.dense.tobytes()
        if key not in _tables:
            _tables.clear()
            _tables[key] = net.tables()
        at = np.flatnonzero(letter.fillna(False).to_numpy(bool))
        texts = text_bytes(values.iloc[at])
        for lo, hi in chunks(texts):
            x, owner = window_matrix(texts[lo:hi])
            p = net.probabilities(x, _tables[key])
            total = np.stack([np.bincount(owner, p[:, k]) for k in range(p.shape[1])], axis=1) / np.bincount(owner)[:, None]
            for i, k, s in zip(at[lo:hi], total.argmax(axis=1), total.max(axis=1), strict=True):
                pred[i], score[i] = net.langs[k], min(1.0, s)
    return pd.DataFrame({"lang_pred": pred, "score": score})


def predicted(net: ByteCnn | None, text: Column) -> Column:
    """A struct of lang_pred and score for a column of texts; other columns never reach Python."""

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for values, letter in batches:
            yield score_batch(net, values, letter)

    return run(text, F.coalesce(text.rlike(r"\p{L}"), F.lit(False)))


def identify_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, held_out: int = 1) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score. Held-out rows are never learned from."""
    out = F.coalesce(crc_mod(F.col(id_col), folds) == held_out, F.lit(False))
    net = fit(docs.where(~out), id_col, text_col, lang_col)
    seen = docs.select(F.col(id_col).alias("doc_id"), out.alias("held_out"), predicted(net, F.col(text_col)).alias("p"))
    return seen.select("doc_id", "held_out", "p.lang_pred", "p.score")
