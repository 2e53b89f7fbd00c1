"""Language-model scores from a probabilistic suffix tree over words.

The root of the tree is the smoothed distribution of single tokens. A node is a context of up to ``DEPTH`` previous
words of one document; it may be in the tree if it is repeated (``LEAST`` = 2) in the training documents, and it
stays if its next-token distribution diverges from its parent's in a way that predicts: the log-likelihood gain over
the parent, every occurrence scored without itself, must exceed ``GAIN``. A node's distribution is its counts smoothed
by ``WEIGHT`` draws from its parent's distribution, so it sums to one over the known tokens and the unknown one. A
token is scored by the longest retained suffix of its history.

Nothing of the tree is gathered in one place. Documents become blocks of token numbers, stored once, and so do replies,
under the same buckets, so neither is dealt again in later rounds. Blocks ask for the totals of their tokens and of
their (context, token) pairs, and then for the gains of the contexts of one depth together with the pairs of the next
one, as pairs depend on counts alone; a gain is answered by one bit. Only repeated contexts are extended. Totals cover
all training documents, whatever their number.

Defined results: a null text counts as empty, and an empty text is the end token alone; without training documents
every token has probability one (the base formula then reads 0.1 / 0.1); repeated rows are learned and scored each;
rows without an id are learned from; extra columns are
ignored; an empty table gives an empty result. Tokens and contexts are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernlake.llm.blocks import REQUEST, Replies, answer, answer_bits, ask, block_table, from_planes, key_ranges, over_blocks, pack_sorted, planes, text_size, totals, unpack_sorted
from quernlake.llm.common import chunks, crc_mod, id_or_null, known_id, mix64, prefix_hash, span_hash, words

DEPTH, LEAST, GAIN, WEIGHT = 5, 2, 4.0, 20.0
BLOCK_BYTES = 4 << 20
END = np.uint64(0x5851F42D4C957F2D)
_STEP, _NEXT = np.uint64(0x9FB21C651E98DF25), np.uint64(0xC3A5C85C97CB3127)
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_log double, score double"


def _encode(b: pd.DataFrame, texts: list[bytes]) -> tuple:
    """Ids, fold flags, tokens of each document, the vocabulary (sorted hashes) and all tokens as numbers in it."""
    found, lens = [], []
    for lo, hi in chunks(texts):
        buf, s, e, first = words(texts[lo:hi])
        w = span_hash(prefix_hash(buf), s, e)
        n = np.diff(first)
        found.append(np.insert(w, first[1:], END))  # one end after the words of each document
        lens.append(n + 1)
    vocab, codes = np.unique(np.concatenate(found), return_inverse=True)
    return b["doc_id"].to_numpy(np.int64).tobytes(), b["held_out"].to_numpy(np.bool_).tobytes(), np.concatenate(lens).astype(np.int64).tobytes(), pack_sorted(vocab), planes(codes.astype(np.int32))


class Tree:
    """What one block knows of the tree, as far as the replies go. Kinds: 0 tokens, 2d - 1 pairs and 2d gains of depth d.

    Tokens that have a context of the present depth that is repeated are at ``at``; ``code`` is the context's number among
    the sorted ``contexts`` of the block, and ``seen`` its count.
    """

    def __init__(self, row, replies: dict, n: int, v: int):
        self.ids, self.held = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["held"], np.bool_)
        self.lens = np.frombuffer(row["lens"], np.int64)
        self.vocab, self.codes = unpack_sorted(row["vocab"], np.uint64), from_planes(row["codes"], np.int32)
        self.replies = replies
        self.train = np.repeat(~self.held, self.lens)
        begin = np.cumsum(self.lens) - self.lens
        self.last = np.zeros(len(self.codes), bool)
        self.last[begin + self.lens - 1] = True
        if 0 in replies:
            self.count = answer(replies, 0)[self.codes]
            self.base = (self.count + 0.1) / (n + 0.1 * (v + 1))
            self.prob = self.base.copy()
            before = np.flatnonzero(~self.last).astype(np.int32)
            self._follow(before, self.vocab, self.codes[before], self.count[before])

    def _follow(self, before: np.ndarray, contexts: np.ndarray, code: np.ndarray, seen: np.ndarray) -> None:
        """The contexts that end with the tokens ``before``, none of them a document's last one."""
        keep = seen >= LEAST
        self.at, self.contexts, self.code, self.seen = before[keep] + 1, contexts, code[keep], seen[keep]

    def tokens(self) -> tuple[np.ndarray, np.ndarray]:
        return self.vocab, np.bincount(self.codes[self.train], minlength=len(self.vocab))

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """The (context, token) pairs of this depth and their counts in this block's training documents."""
        keys = (self.contexts * _STEP)[self.code]
        keys += (self.vocab * _NEXT)[self.codes[self.at]]
        self.pair, inverse = np.unique(mix64(keys), return_inverse=True)
        self.pair_code = inverse.astype(np.int32)
        return self.pair, np.bincount(self.pair_code[self.train[self.at]], minlength=len(self.pair))

    def counted(self, depth: int) -> None:
        """Take the totals of the pairs of this depth."""
        self.pairs()
        self.both = answer(self.replies, 2 * depth - 1)[self.pair_code]

    def _open(self) -> np.ndarray:
        """The contexts of this block whose gain is to be asked for.

        A context that is seen twice and goes on differently has no gain, as any block knows that has one of these pairs
        in training or not; nobody adds to its gain, so blocks that have it with another token are told the same.
        """
        asked = np.zeros(len(self.contexts), bool)
        asked[self.code] = True
        asked[self.code[(self.seen == 2) & (self.both == 1)]] = False
        return asked

    def gains(self) -> tuple[np.ndarray, np.ndarray]:
        """The gain of each context over its parent in this block's training documents."""
        asked, train = self._open(), self.train[self.at]
        at, both, seen = self.at[train], self.both[train], self.seen[train]
        parent = self.prob[at]
        without = (both - 1 + WEIGHT * parent) / (seen - 1 + WEIGHT)
        gain = np.bincount(self.code[train], np.log(without / parent), minlength=len(asked))
        return self.contexts[asked], gain[asked].astype(np.float32)

    def decided(self, depth: int) -> None:
        """Take the decisions about the contexts of this depth and use the retained ones."""
        retained = self._open()
        retained[retained] = answer_bits(self.replies, 2 * depth)
        stays = retained[self.code]
        at = self.at[stays]
        self.prob[at] = (self.both[stays] + WEIGHT * self.prob[at]) / (self.seen[stays] + WEIGHT)

    def extend(self) -> None:
        """One word more of context: a pair is the context of the token after it."""
        go = ~self.last[self.at]
        self._follow(self.at[go], self.pair, self.pair_code[go], self.both[go])

    def scores(self) -> pd.DataFrame:
        begin = np.cumsum(self.lens) - self.lens
        total = lambda x: np.add.reduceat(x, begin)
        return pd.DataFrame({"doc_id": self.ids, "held_out": self.held, "n_tokens": self.lens, "n_known": total((self.count > 0).astype(np.int64)), "base_log": total(np.log10(self.base)), "score": total(np.log10(self.prob))})


def _rows(parts) -> pd.DataFrame:
    return pd.DataFrame(list(parts), columns=["part", "block", "keys", "counts"])


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, held_out: int = 0, depth: int = DEPTH) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities)."""
    held = F.coalesce(crc_mod(F.col(id_col).cast("long"), folds) == held_out, F.lit(False))
    docs = docs.select(known_id(F.col(id_col)).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), held.alias("held_out"))
    size = text_size(docs)
    ranges = key_ranges(size)
    blocks = block_table(docs, size, BLOCK_BYTES, _encode, "ids binary, held binary, lens binary, vocab binary, codes binary")

    def tokens(row, _) -> pd.DataFrame:
        return _rows(ask(row["block"], *Tree(row, {}, 0, 0).tokens(), ranges))

    replies = Replies(docs.sparkSession, size)
    replies.add(totals(over_blocks(blocks, None, tokens, REQUEST), ranges, [(0, None)]))
    told = replies.table().agg(F.sum("total"), F.sum("distinct")).first()
    n, v = int(told[0] or 0), int(told[1] or 0)

    def known(row, r: dict, d: int) -> Tree:
        """The tree after all decisions up to depth d - 1, at the contexts of depth d."""
        tree = Tree(row, r, n, v)
        for k in range(1, d):
            tree.counted(k)
            tree.decided(k)
            tree.extend()
        return tree

    def pairs(row, r) -> pd.DataFrame:
        return _rows(ask(row["block"], *known(row, r, 1).pairs(), ranges))

    if depth:
        replies.add(totals(over_blocks(blocks, replies.table(), pairs, REQUEST), ranges, [(1, None)]))
    for d in range(1, depth + 1):

        def gains(row, r, d=d) -> pd.DataFrame:
            tree = known(row, r, d)
            tree.counted(d)
            asked = list(ask(row["block"], *tree.gains(), ranges))
            if d < depth:
                tree.extend()
                asked.extend(ask(row["block"], *tree.pairs(), ranges, ranges))
            return _rows(asked)

        replies.add(totals(over_blocks(blocks, replies.table(), gains, REQUEST), ranges, [(2 * d, GAIN), (2 * d + 1, None)]))

    def final(row, r) -> pd.DataFrame:
        return known(row, r, depth + 1).scores()

    out = over_blocks(blocks, replies.table(), final, SCORES)
    return out.select(id_or_null("doc_id"), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), F.col("base_log").alias("base_score"), "score")
