"""Document quality by attention-based multiple-instance learning, trained in numpy.

A document is a bag of passages (512 bytes each, the last shorter), every one of which is encoded: hashed byte-pair
frequencies and a few shape statistics pass a tanh layer. Gated attention weighs the passages, and a logistic layer
scores the weighted mean. Labels are those of documents; passages have none.

The network is fitted on the driver on a bounded sample of labelled rows: about ``SAMPLE`` documents of each class (by a
hash of their id) and about ``SAMPLE_BYTES`` of text, of documents of at most ``ROW_BYTES`` each. It reads every passage
of these, and scoring every passage of every text.

Defined results: a null text counts as empty, and an empty text is one empty passage, so it gets a score; without
labels of both classes every score is the share of label 1 (0.5 without any); repeated rows are scored each; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernlake.llm.common import chunks, crc_mod, small, text_bytes
from quernlake.llm.language_id import sampled, within_bytes

#: Labelled documents of each class that the network is fitted on, at most about so many.
SAMPLE = 2000
#: Bytes of text of the sample, at most about so many, and of one document of it, at most.
SAMPLE_BYTES, ROW_BYTES = 32 << 20, 1 << 20
PASSAGE, PAIRS, HIDDEN, ATTEND = 512, 512, 32, 16
_KIND = np.full(256, 5, np.uint8)  # letters beyond ASCII
_KIND[:128] = 4  # marks
_KIND[ord("a") : ord("z") + 1] = 0
_KIND[ord("A") : ord("Z") + 1] = 1
_KIND[ord("0") : ord("9") + 1] = 2
_KIND[[0x20, *range(0x09, 0x0E)]] = 3
FEATURES = PAIRS + 6 + 4
_FOLD = np.random.default_rng(3).integers(0, PAIRS, 65536).astype(np.int64)


def encode_passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and the text that each belongs to."""
    lengths = np.array([len(t) for t in texts], np.int64)
    n = np.maximum(1, -(-lengths // PASSAGE))
    owner = np.repeat(np.arange(len(texts)), n)
    first = np.cumsum(n) - n
    buf = np.frombuffer(b"".join(texts), np.uint8)
    doc = np.repeat(np.arange(len(texts)), lengths)
    at = np.arange(len(buf)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    passage = first[doc] + at // PASSAGE
    k = len(owner)
    size = np.bincount(passage, minlength=k).astype(np.float32)
    out = np.zeros((k, FEATURES), np.float32)
    out[:, PAIRS : PAIRS + 6] = np.bincount(passage * 6 + _KIND[buf], minlength=6 * k).reshape(k, 6)
    if len(buf) > 1:
        same = passage[1:] == passage[:-1]
        pair = buf[:-1].astype(np.uint16) << 8 | buf[1:]
        counts = np.bincount((passage[:-1] * PAIRS + _FOLD[pair])[same], minlength=PAIRS * k).reshape(k, PAIRS)
        out[:, :PAIRS] = np.sqrt(counts / np.maximum(1, size)[:, None])
        out[:, -4] = (counts > 0).sum(axis=1) / np.maximum(1, np.minimum(size, PAIRS))
    if len(buf) > 8:  # how many eight-byte strings of a passage are new in it
        four = pair[:-2].astype(np.uint32) << 16 | pair[2:]
        grams = four[:-4].astype(np.uint64) << np.uint64(32) | four[4:]
        inside = passage[7:] == passage[:-7]
        own, key = passage[:-7][inside], ((grams[inside] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
        both = np.sort(own << 20 | key)
        new = np.ones(len(both), bool)
        new[1:] = both[1:] != both[:-1]
        distinct = np.bincount(both[new] >> 20, minlength=k)
        out[:, -3] = distinct / np.maximum(1, np.bincount(own, minlength=k))
    out[:, PAIRS : PAIRS + 6] /= np.maximum(1, size)[:, None]
    out[:, -2] = size / PASSAGE
    out[:, -1] = np.log1p(lengths)[owner] / 10
    return out, owner


@dataclass
class GatedMil:
    parts: list[np.ndarray]
    prior: float | None = None

    @staticmethod
    def fresh(seed: int = 8) -> GatedMil:
        r = np.random.default_rng(seed)
        norm = lambda *s: r.normal(0, s[0] ** -0.5, s).astype(np.float32)
        return GatedMil([norm(FEATURES, HIDDEN) * 3, np.zeros(HIDDEN, np.float32), norm(HIDDEN, ATTEND), norm(HIDDEN, ATTEND), norm(ATTEND), norm(HIDDEN), np.zeros(1, np.float32)])

    def forward(self, x: np.ndarray, owner: np.ndarray, n: int):
        enc, eb, v, u, w, out, ob = self.parts
        h = np.tanh(x @ enc + eb)
        t, g = np.tanh(h @ v), 1 / (1 + np.exp(-(h @ u)))
        a = (t * g) @ w
        first = np.searchsorted(owner, np.arange(n))  # every text has a passage, and they are in order
        a = np.exp(a - np.maximum.reduceat(a, first)[owner]) if n else a
        a = (a / np.bincount(owner, a, n)[owner]).astype(np.float32)
        z = np.add.reduceat(h * a[:, None], first, axis=0) if n else np.zeros((0, HIDDEN), np.float32)
        return h, t, g, a, z, 1 / (1 + np.exp(-(z @ out + ob)))

    def score(self, x: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        return np.full(n, self.prior) if self.prior is not None else self.forward(x, owner, n)[-1]

    def fit(self, bags: list[np.ndarray], y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 3e-3, seed: int = 9) -> None:
        r, step = np.random.default_rng(seed), 0
        m, s = [np.zeros_like(p) for p in self.parts], [np.zeros_like(p) for p in self.parts]
        for _ in range(epochs):
            for part in np.array_split(r.permutation(len(bags)), max(1, len(bags) // batch)):
                step += 1
                x, owner = np.concatenate([bags[i] for i in part]), np.repeat(np.arange(len(part)), [len(bags[i]) for i in part])
                for p, g, a, b in zip(self.parts, self._gradients(x, owner, y[part]), m, s, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p -= rate * ((a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-7) + 1e-4 * p)

    def _gradients(self, x: np.ndarray, owner: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        enc, _, v, u, w, out, _ = self.parts
        n = len(y)
        h, t, g, a, z, p = self.forward(x, owner, n)
        d = ((p - y) / n).astype(np.float32)
        gz = d[:, None] * out
        per = (gz[owner] * h).sum(axis=1)
        mean = np.bincount(owner, per * a, n).astype(np.float32)
        ga = a * (per - mean[owner])
        gt, gg = ga[:, None] * w * g * (1 - t * t), ga[:, None] * w * t * g * (1 - g)
        gh = (gz[owner] * a[:, None] + gt @ v.T + gg @ u.T) * (1 - h * h)
        return [x.T @ gh, gh.sum(axis=0), h.T @ gt, h.T @ gg, (t * g).T @ ga, z.T @ d, d.sum(keepdims=True)]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> GatedMil:
    """Learn from ``docs`` (doc_id, text) joined with ``labels`` (doc_id, label of 0 or 1)."""
    labels = labels.where("label in (0, 1)")
    counts = {int(r[0]): r[1] for r in labels.groupBy("label").count().collect()}
    if len(counts) < 2:
        return GatedMil([], float(min(counts, default=0.5)))
    chosen = sampled(labels, "label", sample, "doc_id", 12)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, rows = text_bytes(b["text"]), []
            for lo, hi in chunks(texts):
                x, owner = encode_passages(texts[lo:hi])
                for i, part in enumerate(np.split(x, np.searchsorted(owner, np.arange(1, hi - lo)))):
                    rows.append((b["doc_id"].iloc[lo + i], b["label"].iloc[lo + i], part.astype(np.float16).tobytes()))
            yield pd.DataFrame(rows, columns=["doc_id", "label", "x"])

    rows = within_bytes(docs.join(small(chosen, 2 * sample), "doc_id"), "doc_id", "text", SAMPLE_BYTES, ROW_BYTES).mapInPandas(run, "doc_id long, label int, x binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["label"], r["x"]))
    y = np.array([r["label"] for r in rows], np.float32)
    if len(set(y.tolist())) < 2:
        return GatedMil([], float(y.mean()) if len(y) else 0.5)
    net = GatedMil.fresh()
    net.fit([np.frombuffer(r["x"], np.float16).reshape(-1, FEATURES).astype(np.float32) for r in rows], y)
    return net


def classify_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", folds: int = 3, held_out: int = 1) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. Held-out rows are never learned from."""
    seen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    learn = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(crc_mod(F.col("doc_id"), folds) != held_out)
    net = fit(seen, learn)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            texts, score = text_bytes(b), np.zeros(len(b))
            for lo, hi in chunks(texts):
                score[lo:hi] = net.score(*encode_passages(texts[lo:hi]), hi - lo)
            yield pd.Series(np.clip(score, 0, 1))

    out = F.coalesce(crc_mod(F.col("doc_id"), folds) == held_out, F.lit(False))
    rows = seen.select("doc_id", out.alias("held_out"), scored("text").alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
