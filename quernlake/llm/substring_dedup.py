"""Removal of repeated byte strings with suffix arrays, ordered by deep-shallow sorting.

A byte goes if it lies in a string of ``length`` bytes that also starts in a document with a smaller id. Equal texts
are collapsed first: a copy of at least ``length`` bytes goes whole. The other documents are packed into blocks.
Every window of ``length`` bytes has a key, the smallest hash of its 18-byte substrings, which equal windows share;
neighbouring windows mostly share it too, so keys come in runs. Blocks ask for the number of documents that hold
each key; only windows whose key occurs in several documents can repeat.

Those windows are suffix-sorted in their block, and the first of each run of equal ones is sent, with its bytes, to
the task of its key; there the suffixes of all blocks are sorted together and the smallest document of each window
goes back. A key of more than ``HOT`` documents would gather too much, so its windows are spread by their own bytes
instead; each block sends every distinct window once, however many of its documents hold it. Back in the block, the
suffix array spreads the answer to all equal windows.

Defined results: a null text counts as empty; texts shorter than ``length`` keep all bytes; rows of one id never
cover each other, repeated rows get the same figures each; rows without an id come after all others and have one row
each; extra columns are ignored; an empty table gives an empty result. Hashes only choose what is compared; windows
are told equal by their bytes. Equal texts are told by SHA-256.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernlake.llm.blocks import REQUEST, answer, ask, block_table, from_planes, key_ranges, over_blocks, planes, released, text_size, totals
from quernlake.llm.common import NO_ID, id_or_null, known_id, mix64, powers, prefix_hash, small, span_hash, stored
from quernlake.llm.suffix_sort import window_classes

GRAM, HOT, BLOCK_BYTES = 18, 4096, 1 << 20
#: Tasks that compare windows, for each range of keys: windows take more room than keys.
FINER = 4
_ODD = np.uint64(0xD6E8FEB86659FD93)
SENT = "part int, block long, data binary"
FOUND = "doc_id long, digest binary, n_removed long, n_spans long, kept_sha256 string, kept binary"


class Windows:
    """Runs of consecutive windows with equal keys of one block's documents."""

    def __init__(self, row, length: int):
        self.ids, self.lens = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["lens"], np.int64)
        self.buf, self.length = np.frombuffer(row["text"], np.uint8), length
        self.ends = np.cumsum(self.lens)
        n, gram = len(self.buf), min(GRAM, length)
        if n < length:
            self.start = self.size = self.doc = np.zeros(0, np.int64)
            self.key = np.zeros(0, np.uint64)
            return
        least = self._hashes(n, gram)
        width = 1
        while width < length - gram + 1:
            step = min(width, length - gram + 1 - width)
            least = np.minimum(least[:-step], least[step:])
            width += step
        inside = np.ones(n, bool)
        for k in range(1, length):  # windows that would leave their document
            at = self.ends - k
            inside[at[(at >= 0) & (self.lens >= k)]] = False
        at = np.flatnonzero(inside[: n - length + 1])
        if not len(at):
            self.start = self.size = self.doc = np.zeros(0, np.int64)
            self.key = np.zeros(0, np.uint64)
            return
        key = least[at]
        first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (at[1:] != at[:-1] + 1))))
        self.start, self.key = at[first], key[first]
        self.size = np.diff(first, append=len(at))
        self.doc = np.searchsorted(self.ends, self.start, "right")

    def _hashes(self, n: int, gram: int) -> np.ndarray:
        prefix = prefix_hash(self.buf)
        h = (prefix[gram:] - prefix[: n - gram + 1]) * powers(n + 1)[0][: n - gram + 1]
        h ^= h >> np.uint64(32)
        h *= _ODD
        h ^= h >> np.uint64(29)
        return h

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys, the documents that hold each, and the key of each run as an index."""
        keys, at = np.unique(self.key, return_inverse=True)
        order = np.argsort(at, kind="stable")  # within a key the documents ascend
        a, d = at[order], self.doc[order]
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (self.ids[d[1:]] != self.ids[d[:-1]]))) if len(a) else np.zeros(0, bool)
        return keys, np.bincount(a[new], minlength=len(keys)).astype(np.int32), at

    def places(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All windows of some runs, and the run of each."""
        size = self.size[runs]
        run = np.repeat(runs, size)
        nth = np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size)
        return self.start[run] + nth, run


def _pack(*columns: np.ndarray, tail: bytes = b"") -> bytes:
    return np.int64(len(columns[0])).tobytes() + b"".join(planes(c.astype(np.int64)) for c in columns) + tail


def _unpack(data: bytes, columns: int) -> tuple[list[np.ndarray], bytes]:
    n = int(np.frombuffer(data[:8], np.int64)[0])
    return [from_planes(data[8 + 8 * n * k : 8 + 8 * n * (k + 1)], np.int64) for k in range(columns)], data[8 + 8 * n * columns :]


def _segments(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> bytes:
    nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return buf[np.repeat(start, size) + nth].tobytes()


def _requests(row, length: int, ranges: int) -> pd.DataFrame:
    keys, docs, _ = Windows(row, length).distinct()
    return pd.DataFrame(list(ask(row["block"], keys, docs, ranges)), columns=["part", "block", "keys", "counts"])


def _candidates(row, replies: dict, length: int, ranges: int, hot: int) -> pd.DataFrame:
    """The first of equal windows in this block, as runs under the task that compares them with other blocks."""
    w = Windows(row, length)
    keys, docs, at = w.distinct()
    total = answer(replies, 0)
    beyond = total > docs  # documents elsewhere hold the key as well
    place, run = w.places(np.flatnonzero(beyond[at]) if len(keys) else np.zeros(0, np.int64))
    if not len(place):
        return pd.DataFrame(columns=["part", "block", "data"])
    classes = window_classes(w.buf, place, length)
    _, first = np.unique(classes, return_index=True)
    first.sort()
    place, run = place[first], run[first]
    much = total[at[run]] > hot
    new = np.concatenate(([True], (run[1:] != run[:-1]) | (place[1:] != place[:-1] + 1) | much[1:]))
    start = np.flatnonzero(new)
    size = np.diff(start, append=len(place))
    place, run, much = place[start], run[start], much[start]
    spread = w.key[run].copy()
    spread[much] = span_hash(prefix_hash(w.buf), place[much], place[much] + length)
    part = ((mix64(spread) >> np.uint64(33)) % np.uint64(ranges)).astype(np.int64)
    order = np.lexsort((place, part))
    place, size, part, doc = place[order], size[order], part[order], w.doc[run[order]]
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(part)]))
    rows = [(int(part[a]), row["block"], _pack(place[a:b], size[a:b], w.ids[doc[a:b]], tail=_segments(w.buf, place[a:b], size[a:b] + length - 1))) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    return pd.DataFrame(rows, columns=["part", "block", "data"])


def _compared(rows: pd.DataFrame, length: int) -> pd.DataFrame:
    """For windows that a smaller document of another block holds: their places and that document."""
    got = [_unpack(d, 3) for d in rows["data"]]
    size = np.concatenate([c[1] for c, _ in got])
    place = np.concatenate([c[0] for c, _ in got])
    ids = np.concatenate([c[2] for c, _ in got])
    owner = np.repeat(np.arange(len(got)), [len(c[0]) for c, _ in got])
    buf = np.frombuffer(b"".join(t for _, t in got), np.uint8)
    span = size + length - 1
    nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    run = np.repeat(np.arange(len(size)), size)
    classes = window_classes(buf, (np.cumsum(span) - span)[run] + nth, length)
    least = np.full(classes.max() + 1, NO_ID)
    np.minimum.at(least, classes, ids[run])
    hit = least[classes] < ids[run]
    run, nth, least = run[hit], nth[hit], least[classes[hit]]
    out = []
    cuts = np.searchsorted(owner[run], np.arange(len(got) + 1))
    for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        if a < b:
            out.append((rows["block"].iloc[k], 1, int(rows["part"].iloc[0]), _pack(place[run[a:b]] + nth[a:b], least[a:b])))
    return pd.DataFrame(out, columns=["block", "kind", "part", "data"])


def _result(row, replies: dict, length: int, keep_bytes: bool) -> pd.DataFrame:
    w = Windows(row, length)
    keys, docs, at = w.distinct()
    told = [_unpack(d, 2)[0] for _, d in replies.get(1, [])]
    where = np.concatenate([t[0] for t in told]) if told else np.zeros(0, np.int64)
    lower = np.concatenate([t[1] for t in told]) if told else np.zeros(0, np.int64)
    covered = np.zeros(len(w.buf) + 1, np.int32)
    if len(keys):
        wanted = docs > 1
        wanted[at[np.searchsorted(w.start, where, "right") - 1]] = True
        place, run = w.places(np.flatnonzero(wanted[at]))
        if len(place):
            classes = window_classes(w.buf, place, length)
            ids = w.ids[w.doc[run]]
            least = np.full(classes.max() + 1, NO_ID)
            np.minimum.at(least, classes, ids)
            np.minimum.at(least, classes[np.searchsorted(place, where)], lower)
            hit = place[least[classes] < ids]
            np.add.at(covered, hit, 1)
            np.add.at(covered, hit + length, -1)
    gone = np.cumsum(covered[:-1]) > 0
    begins = w.ends - w.lens
    total = np.concatenate(([0], np.cumsum(gone)))
    opens = gone.copy()
    opens[1:] &= ~gone[:-1]
    heads = begins[w.lens > 0]
    opens[heads] = gone[heads]
    spans = np.concatenate(([0], np.cumsum(opens)))
    rows = []
    for i, (a, b) in enumerate(zip(begins.tolist(), w.ends.tolist(), strict=True)):
        kept = w.buf[a:b][~gone[a:b]].tobytes()
        rows.append((w.ids[i], row["digests"][32 * i : 32 * i + 32], total[b] - total[a], spans[b] - spans[a], hashlib.sha256(kept).hexdigest(), kept if keep_bytes else None))
    return pd.DataFrame(rows, columns=["doc_id", "digest", "n_removed", "n_spans", "kept_sha256", "kept"])


def _encode(b: pd.DataFrame, texts: list[bytes]) -> tuple:
    return b["doc_id"].to_numpy(np.int64).tobytes(), np.array([len(t) for t in texts], np.int64).tobytes(), b"".join(b["digest"]), b"".join(texts)


def substring_dedup(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", keep_bytes: bool = False, hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with ``keep_bytes`` the bytes as ``kept``."""
    if not GRAM <= length <= 120:
        raise ValueError(f"length is {GRAM} to 120 bytes, not {length}")
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.select(known_id(F.col(id_col)).alias("doc_id"), text.alias("text"))
    docs = docs.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    rows = stored(docs.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")))
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    copies = stored(rows.join(firsts.where("n > 1"), "digest").where("doc_id <> first").select("doc_id", "digest").distinct())
    single = docs.join(small(copies, copies.count()), ["doc_id", "digest"], "left_anti")

    size = text_size(docs)
    ranges = key_ranges(size)
    blocks = block_table(single.select("doc_id", "digest", "text"), size, BLOCK_BYTES, _encode, "ids binary, lens binary, digests binary, text binary")
    asked = over_blocks(blocks, None, lambda row, _: _requests(row, length, ranges), REQUEST)
    held = stored(totals(asked, ranges, [(0, None)]))
    sent = over_blocks(blocks, held, lambda row, r: _candidates(row, r, length, FINER * ranges, hot), SENT)
    lower = stored(sent.groupBy("part").applyInPandas(lambda x: released(_compared(x, length)), "block long, kind int, part int, data binary"))
    found = over_blocks(blocks, lower, lambda row, r: _result(row, r, length, keep_bytes), FOUND).dropDuplicates(["digest"])

    out = rows.join(found.withColumnRenamed("doc_id", "first"), "digest", "left")
    own, whole = F.col("doc_id") == F.col("first"), F.col("n_bytes") >= length
    own_or = lambda name, copied, short: F.when(own, F.col(name)).when(whole, copied).otherwise(short)
    empty = hashlib.sha256(b"").hexdigest()
    kept = [own_or("kept", F.lit(b""), F.col("kept")).alias("kept")] if keep_bytes else []
    return out.select(
        id_or_null("doc_id"),
        "n_bytes",
        own_or("n_removed", F.col("n_bytes"), F.lit(0)).cast("long").alias("n_removed"),
        own_or("n_spans", F.lit(1), F.lit(0)).cast("long").alias("n_spans"),
        own_or("kept_sha256", F.lit(empty), F.lower(F.hex("digest"))).alias("kept_sha256"),
        *kept,
    )
