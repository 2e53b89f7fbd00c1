"""The corpus pipeline: language ID, line dedup, near dedup, decontamination, packing. Each stage calls one operator.

Every function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernlake.llm.common import shared_dir, unused
from quernlake.llm.decontaminate import uncontaminated
from quernlake.llm.language_id import fit, predicted
from quernlake.llm.line_dedup import dedup_lines
from quernlake.llm.near_dedup import one_of_each
from quernlake.llm.packing import pack
from quernlake.llm.queries import tokenizer_path

#: Mean window probability below which a document counts as being in no known language.
LEAST_SCORE = 0.4
#: Edits up to which two lines are copies, and percent of the shorter one that these may be.
LINE_EDITS, LINE_PERCENT = 8, 5
#: Percent of shared five-word shingles from which documents are near-duplicates.
NEAR_PERCENT = 80


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled rows teach; those without letters or with a low score go."""
    net = fit(docs, "doc_id", "text", "lang")
    p = unused("_language", docs.columns)
    scored = docs.withColumn(p, predicted(net, F.col("text")))
    return scored.where((F.col(f"{p}.lang_pred") != "und") & (F.col(f"{p}.score") >= LEAST_SCORE)).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated lines; ``n_chars`` follows the text."""
    out = dedup_lines(docs, edits=LINE_EDITS, percent=LINE_PERCENT)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates; documents without words stay."""
    return one_of_each(docs, percent=NEAR_PERCENT)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 4096 tokens."""
    return pack(docs, tokenizer_path(), capacity=4096, end_id=1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language_stage),
    ("line dedup", line_stage),
    ("near dedup", near_stage),
    ("decontamination", benchmark_stage),
    ("packing", packing_stage),
]

#: Network inference, edit joins and tokenisation have no SQL form; the tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's rows written as Parquet in the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{shared_dir(spark)}-{uuid.uuid4().hex[:8]}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{i}")
        docs = spark.read.parquet(f"{root}/{i}")
    return docs
