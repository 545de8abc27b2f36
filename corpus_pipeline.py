"""A training corpus from raw documents: filter, clean, deduplicate twice, pack.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from catalogloom.llm import jaccard_join, line_dedup, packing, suffix_dedup, toxicity
from catalogloom.llm.common import stored, table


def _apart(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``stage`` on (doc_id, text, rest0, rest1, ...), given back under the columns of ``docs``.

    The other columns get names that no operator uses, so that none is taken for one of its own; n_chars
    follows the text.
    """
    names = {c: c if c in ("doc_id", "text") else f"rest{k}" for k, c in enumerate(docs.columns)}
    done = stage(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]))
    length = F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in names else None
    return done.select(*[(length if c == "n_chars" else F.col(n)).alias(c) for c, n in names.items()])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon does not call toxic.

    Null text counts as empty, which is not toxic. Rows are judged one by one, repeated ones alike.
    """
    lexicon = toxicity.learn(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), toxicity.train_rows)
    return _apart(docs, lambda rows: toxicity.scored(rows, lexicon).where(toxicity.predicted() == 0))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of recurring templates.

    Null text stays null. Rows that repeat a text lose the same lines, whatever their id.
    """
    return _apart(docs, line_dedup.drop_lines)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the smallest id, by its text where that id has several.

    Rows without id link like others and come last. Of rows with equal id and text one stays, whichever;
    null, empty and blank texts are one group.
    """
    joined = jaccard_join.join_documents(docs.select("doc_id", "text"))
    kept = joined.where("kept").select(F.col("doc_id").alias("id"), "text_key").distinct()

    def stage(rows: DataFrame) -> DataFrame:
        keyed = rows.withColumn("own_key", F.xxhash64(F.coalesce("text", F.lit(""))))
        mine = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("own_key") == F.col("text_key"))
        return keyed.join(kept, mine, "left_semi").dropDuplicates(["doc_id", "own_key"])

    return _apart(docs, stage)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without long passages that stand earlier in the corpus.

    Null text stays null; null ids come last. Rows of equal id and text are one document.
    """

    def cleaned(rows: DataFrame) -> DataFrame:
        found = suffix_dedup.remove_repeats(rows, whole_characters=True, nulls_last=True)
        return found.withColumn("text", F.when(F.col("text").isNotNull(), F.col("kept_bytes").cast("string")))

    return _apart(docs, cleaned)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, laid into sequences. Null text counts as empty; every row is packed."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("jaccard_join", drop_near_copies),
    ("suffix_dedup", drop_repeats),
    ("packing", pack),
]

#: SQL has neither the tokenizer nor a learned lexicon; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
