"""Best-fit packing of tokenised documents by large-item matching.

Documents are tokenised once; longer ones are cut into pieces of the capacity. Only the histogram of piece lengths
(at most ``capacity`` rows, whatever the corpus) is planned on the driver: lengths above a third of the capacity are
matched greedily, at most two to a bin (the largest partner that fits beside a piece above a half; what is left pairs
among itself), then the smaller lengths go, largest first, to the tightest remaining gaps. Equal bins are planned as
one group with a count. Every piece then finds its bin from its rank among the pieces of its length; ranks come from
salted counts, so a length that a third of all pieces share is never gathered.

Defined results: a null text counts as empty, and an empty text is one piece that holds the end id alone; repeated
rows are packed each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernlake.llm.common import chunks, known_id, stored, text_bytes

PIECES = "doc_id long, known boolean, piece int, start long, length long, ids_crc32 long"
#: Words whose ids a Python worker remembers before it starts afresh.
CACHE_WORDS = 600_000
#: New words that are encoded in one call.
MARKED_WORDS = 20_000
#: Lower-case Latin-1 letters in UTF-8, then ASCII marks that begin no contraction and no special token.
_PLAIN = re.compile(rb"((?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+)([!-&(-/:;=?@\[-`{-~]*)")
#: Byte-level vocabularies write bytes that aren't printable as characters from 256 on.
_BYTE_CHARS = np.arange(256, dtype="<u2")
_BYTE_CHARS[[*range(33), *range(127, 161), 173]] = np.arange(256, 324)
_BYTE_CHARS[32] = 32


class WordEncoder:
    """Ids of texts, by way of the ids of their words between ASCII white space, which no token crosses."""

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok, self.end_id = Tokenizer.from_file(path), end_id
        special = [(i, t.content) for i, t in self.tok.get_added_tokens_decoder().items() if t.special]
        self.mark_id, self.mark = special[-1] if special else (-1, "")
        # plain words need neither normalisation nor the pattern: each is one piece, and its last token ends a word
        self.bare = Tokenizer(self.tok.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.ends = np.zeros(self.tok.get_vocab_size() + 1, bool)
        self.ends[[i for t, i in self.tok.get_vocab(with_added_tokens=False).items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.code: dict[bytes, int] = {b" ": 0}  # no word is a blank: it stands for the end
        self.flat, self.begin = np.full(1, self.end_id, np.uint32), np.array([0, 1], np.int64)

    def _marked(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and how many each has."""
        texts = [w.decode("utf-8", "surrogatepass") for w in words]
        # a special token between words keeps them apart in one call, and its id tells where each ends
        if self.mark and not any("<" in t for t in texts):
            ids = np.array(self.tok.encode_batch_fast([self.mark.join(texts)], add_special_tokens=False)[0].ids, np.int64)
            cuts = np.flatnonzero(ids == self.mark_id)
            if len(cuts) == len(texts) - 1:
                return ids[ids != self.mark_id], np.diff(np.concatenate(([-1], cuts, [len(ids)]))) - 1
        each = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for e in each for i in e], np.int64), np.array([len(e) for e in each], np.int64)

    def _plain(self, found: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words that are letters and then marks, given as these two pieces."""
        text = b" ".join([a + b" " + b if b else a for a, b in found])
        text = _BYTE_CHARS[np.frombuffer(text, np.uint8)].tobytes().decode("utf-16-le")
        ids = np.array(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
        pieces = np.cumsum([2 if b else 1 for _, b in found])
        return ids, np.diff(np.flatnonzero(self.ends[ids])[pieces - 1] + 1, prepend=0)

    def learn(self, new: list[bytes]) -> None:
        plain, found, rest, odd = [], [], [], []
        for w in new:
            if m := _PLAIN.fullmatch(w):
                plain.append(w)
                found.append(m.groups())
            else:
                (odd if b"<" in w else rest).append(w)
        if plain:
            self._add(plain, *self._plain(found))
        for i in range(0, len(rest), MARKED_WORDS):
            self._add(rest[i : i + MARKED_WORDS], *self._marked(rest[i : i + MARKED_WORDS]))
        if odd:
            self._add(odd, *self._marked(odd))

    def _add(self, words: list[bytes], ids: np.ndarray, n: np.ndarray) -> None:
        first = len(self.begin) - 1
        self.code.update(zip(words, range(first, first + len(words)), strict=True))
        self.flat = np.concatenate([self.flat, ids.astype(np.uint32)])
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(n)])

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by the end id, and where each text begins."""
        if len(self.code) > CACHE_WORDS:
            self.clear()
        flat: list[bytes] = []
        counts = []
        for t in texts:
            ws = (t.lower() if b"<|" not in t else t).split()
            flat += ws
            flat.append(b" ")
            counts.append(len(ws) + 1)
        if new := set(flat).difference(self.code):
            self.learn(list(new))
        codes = np.fromiter(map(self.code.__getitem__, flat), np.int64, len(flat))
        at, n = self.begin[codes], np.diff(self.begin)[codes]
        ends = np.cumsum(n)
        ids = self.flat[np.repeat(at - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.concatenate(([0], ends[np.cumsum(counts) - 1]))


_encoders: dict[tuple[str, int], WordEncoder] = {}


def encoder(path: str, end_id: int) -> WordEncoder:
    """The worker's encoder. A task's own function holds copies of the globals it names, so it calls this one of the module."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = WordEncoder(path, end_id)
    return _encoders[path, end_id]


def tokenised(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        enc = encoder(tokenizer, end_id)
        for b in batches:
            texts, rows = text_bytes(b["text"]), []
            for lo, hi in chunks(texts):
                ids, begin = enc.encode(texts[lo:hi])
                raw = ids.astype("<u4").tobytes()
                for doc, known, s, e in zip(b["doc_id"].iloc[lo:hi], b["known"].iloc[lo:hi], begin[:-1].tolist(), begin[1:].tolist(), strict=True):
                    for p, x in enumerate(range(s, e, capacity)):
                        y = min(x + capacity, e)
                        rows.append((doc, known, p, x - s, y - x, zlib.crc32(raw[4 * x : 4 * y])))
            yield pd.DataFrame(rows, columns=["doc_id", "known", "piece", "start", "length", "ids_crc32"])

    return docs.mapInPandas(run, PIECES)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank after the last, pieces of that length to a bin, first bin, offset in the bin)."""
    left, rank, out, bins = dict(counts), dict.fromkeys(counts, 0), [], 0
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> groups of (first bin, bins)
    order: list[int] = []

    def free(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((first, n))

    def put(size: int, k: int, first: int, n: int, gap: int) -> None:
        """k pieces of a size into each of n bins that have this gap; frees the rest of the gap."""
        out.append((size, rank[size], rank[size] + k * n, k, first, capacity - gap))
        rank[size] += k * n
        left[size] -= k * n
        free(gap - k * size, first, n)

    def opened(size: int, k: int, n: int) -> None:
        nonlocal bins
        bins += n
        put(size, k, bins - n, n, capacity)

    def fill(size: int, most: int) -> None:
        while left[size] and (i := bisect_left(order, size)) < len(order):
            gap = order[i]
            first, n = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], order[i]
            k = min(gap // size, most)
            whole = min(n, left[size] // k)
            rest = min(left[size] - whole * k, k - 1) if whole < n else 0
            if whole:
                put(size, k, first, whole, gap)
            if rest:
                put(size, rest, first + whole, 1, gap)
            free(gap, first + whole + bool(rest), n - whole - bool(rest))

    sizes = sorted(counts, reverse=True)
    for size in (s for s in sizes if 2 * s > capacity):
        opened(size, 1, left[size])
    middle = [s for s in sizes if capacity < 3 * s and 2 * s <= capacity]
    for size in middle:
        fill(size, 1)
    waiting: list[tuple[int, int]] = []  # one bin that holds a single middle piece
    for size in middle:
        if left[size] and waiting:
            gap, first = waiting.pop()
            put(size, 1, first, 1, gap)
        if left[size] > 1:
            opened(size, 2, left[size] // 2)
        if left[size]:
            bins += 1
            out.append((size, rank[size], rank[size] + 1, 1, bins - 1, 0))
            rank[size], left[size] = rank[size] + 1, 0
            waiting.append((capacity - size, bins - 1))
    for gap, first in waiting:
        free(gap, first, 1)
    for size in (s for s in sizes if 3 * s <= capacity):
        fill(size, capacity)
        if left[size]:
            k = capacity // size
            if left[size] >= k:
                opened(size, k, left[size] // k)
            if left[size]:
                opened(size, left[size], 1)
    return out


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = stored(tokenised(docs.select(known_id(F.col(id_col)).alias("doc_id"), F.col(id_col).isNotNull().alias("known"), F.col(text_col).alias("text")), tokenizer, capacity, end_id))
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = np.array(sorted(plan(counts, capacity)) or np.zeros((0, 6)), np.int64).reshape(-1, 6)
    salts = min(4096, max(1, sum(counts.values()) // 256))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    base = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")
    base = base.select("length", "salt", before.alias("before"))
    local = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "known", "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("local", local).join(base, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("local"))
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = sent.value
        key = (t[:, 0] << 48) + t[:, 1]
        for b in batches:
            r = b["rank"].to_numpy()
            row = t[np.searchsorted(key, (b["length"].to_numpy() << 48) + r, "right") - 1]
            nth = r - row[:, 1]
            yield b[["doc_id", "known", "piece", "start", "length", "ids_crc32"]].assign(sequence_id=row[:, 4] + nth // row[:, 3], offset=row[:, 5] + nth % row[:, 3] * row[:, 0])

    placed = ranked.select("doc_id", "known", "piece", "start", "length", "ids_crc32", "rank").mapInPandas(place, PIECES + ", sequence_id long, offset long")
    return placed.withColumn("doc_id", F.when(F.col("known"), F.col("doc_id"))).drop("known")
