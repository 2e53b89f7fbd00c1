"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

Every benchmark item is cut into windows of ``width`` consecutive words (a shorter item is one window). A
document holds a window only if it holds all of its words, so one prefix token is necessary: the window's rarest
word by document frequency in the corpus. Document words are joined with the prefix tokens alone; position and
length bounds drop candidates whose window would stick out of the document, and the remaining ones are verified
word by word at their place.

Words are runs of anything but ASCII non-alphanumerics, after A-Z is lower-cased. Defined results: null and empty
texts have no words; items without words are ignored; repeated items count once; an empty benchmark leaves all
documents clean; every row, repeated or without an id, has the figures of its own text (hits are found by the MD5 of
texts, whatever their ids); extra columns of either table are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernlake.llm.common import ascii_lower, small, stored, text_id, unused

GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows up to which the prefix index is broadcast (about 200 bytes each); more are joined by a shuffle.
BROADCAST_WINDOWS = 200_000


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAPS), "")


def windows_of(items: DataFrame, width: int) -> DataFrame:
    """item, window (its words) for every distinct window of every item."""
    w = items.select(F.col("item_id").cast("string").alias("item"), word_array(F.col("text")).alias("w")).where(F.size("w") > 0)
    k = w.select("item", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))).alias("k"))
    return k.select("item", F.slice("w", F.col("k"), width).alias("window")).distinct()


def prefix_index(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """token, at, window, items: each distinct window under its rarest word. Words that no document has drop the window."""
    grouped = windows.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))
    tokens = grouped.select("window", "items", F.posexplode("window").alias("at", "token"))
    wanted = stored(tokens.select("token").distinct())
    held = docs.select(F.explode(F.array_distinct(word_array(F.col("text")))).alias("token"))
    df = held.join(small(wanted, wanted.count()), "token", "left_semi").groupBy("token").count()
    ranked = tokens.join(stored(df), "token", "left")
    rarest = ranked.groupBy("window").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("df"), "token", "at", "items")).alias("r"))
    return rarest.where("r.df > 0").select("r.token", "r.at", "window", "r.items")


def matches(docs: DataFrame, index: DataFrame, n_windows: int) -> DataFrame:
    """tid, start (from 0), length, items for every occurrence of a window in a document's text."""
    d = docs.select(text_id(F.col("text")).alias("tid"), word_array(F.col("text")).alias("w"))
    start = F.col("pos") - F.col("at")
    inside = (start >= 0) & (start + F.size("window") <= F.size("w"))
    same = F.slice("w", start + 1, F.size("window")) == F.col("window")
    if n_windows <= BROADCAST_WINDOWS:
        found = d.select("tid", "w", F.posexplode("w").alias("pos", "token")).join(F.broadcast(index), "token")
        return found.where(inside & same).select("tid", start.alias("start"), F.size("window").alias("length"), "items")
    d = d.dropDuplicates(["tid"])
    tokens = stored(index.select("token").distinct())
    words = d.select("tid", F.posexplode("w").alias("pos", "token")).join(small(tokens, tokens.count()), "token", "left_semi")
    found = words.join(index, "token").select("tid", "pos", "at", "window", "items")
    return found.join(d, "tid").where(inside & same).select("tid", start.alias("start"), F.size("window").alias("length"), "items")


def hits(docs: DataFrame, benchmark: DataFrame, width: int) -> DataFrame:
    """tid, spans, items, n_hit of the texts (column ``text``) that hold a window."""
    windows = stored(windows_of(benchmark, width))
    n = windows.count()
    index = stored(prefix_index(docs, windows))
    found = (
        matches(docs, index, n)
        .groupBy("tid")
        .agg(F.array_sort(F.collect_set(F.struct("start", "length"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    )
    covered = F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1)))
    return found.select("tid", "spans", "items", F.size(F.array_distinct(covered)).alias("n_hit"))


def uncontaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text holds no window; columns stay as they are."""
    tid = unused("_tid", docs.columns)
    gone = stored(hits(docs.select(F.col(text_col).alias("text")), benchmark, width).select(F.col("tid").alias(tid)))
    return docs.join(small(gone, gone.count()), text_id(F.col(text_col)) == F.col(tid), "left_anti")


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans, items.

    ``spans`` lists the (start, length) of the windows found, in words; ``items`` their item ids as strings.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = docs.select("doc_id", text_id(F.col("text")).alias("tid"), F.size(word_array(F.col("text"))).cast("long").alias("n_words")).join(hits(docs, benchmark, width), "tid", "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        "spans",
        items.alias("items"),
    )
