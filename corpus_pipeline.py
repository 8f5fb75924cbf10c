"""A training corpus from raw documents: toxicity, near copies, benchmark passages, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``documents``, whatever further ones there are and however they are named;
the last returns token ids and their digests. ``n_chars`` is brought up to date where a stage changes a text.

In every stage a null text is as an empty one (and stays null), very long texts are taken whole, rows with a null id are documents like
others, an empty table gives no rows. Repeated rows pass all stages but that of near copies, where they are copies; of ties there the least id stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import bpe, common, decontaminate, nearcopies, pii, toxicity
from palisade.llm.registered import tokenizer_path


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def _changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """The columns of ``documents`` with n_chars of the text as it is now."""
    return after.withColumn("n_chars", F.length("text").cast("long")).select(*_columns(before)) if "n_chars" in before.columns else after.select(*_columns(before))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score of 0.5 or more) go; those without words stay, as do all where no label is toxic."""
    weights = toxicity.train(docs, common.table(spark, sf_dir, "labels"), training=common.fold() != 0)
    score = common.unused("__score", docs.columns)
    return toxicity.score(docs, weights, out=score).filter(F.col(score) < 0.5).select(*_columns(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the least id; documents without words are copies of each other."""
    return nearcopies.without_copies(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; a document goes if no word is left of it. Documents without a passage stay, those without words too."""
    removed = common.unused("__removed", docs.columns)
    out = decontaminate.remove(docs, common.table(spark, sf_dir, "benchmark"), removed=removed)
    left = F.col("text").rlike("[0-9A-Za-z\\x{80}-\\x{10FFFF}]")
    return _changed(docs, out.filter((F.col(removed) == 0) | left))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to marks such as [EMAIL]; every row stays."""
    return _changed(docs, pii.redact(docs))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token_ids, and the digests of the ids and of the text that they decode to; every row stays."""
    out = bpe.encode(docs.select("doc_id", "text"), tokenizer_path(), decoded="decoded")
    return out.select("doc_id", "token_ids", *bpe.digests(out))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_benchmark_passages),
    ("personal_data", redact_personal_data),
    ("tokens", tokenize),
]

#: Training and byte-pair encoding are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
