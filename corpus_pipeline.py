"""A corpus pipeline of five stages, each one of the package's operators.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet in the shared folder and read again as the next one's documents, so a
lost executor costs no more than the stage at hand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrollmill.llm import decontaminate, mixing, pii, simhash, toxicity
from scrollmill.llm.common import materialize, release, table, written


def _apart(docs: DataFrame, name: str) -> tuple[DataFrame, list[Column]]:
    """``docs`` with a column called ``name`` under another name, longer than any
    in use, and the columns that give ``docs`` back."""
    other = "_".join([name, *docs.columns])
    return docs.withColumnRenamed(name, other), [F.col(f"`{other if c == name else c}`").alias(c) for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go.

    Null and empty texts score as empty ones, a very long text as a whole, repeated
    rows alike (all stay or go); without labels nothing is rejected unless most are
    toxic. An empty table gives an empty one, and other columns stay as they are.
    """
    own, columns = _apart(docs, "toxicity")
    return toxicity.score(own, table(spark, sf_dir, "labels")).where("toxicity < 0.5").select(*columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of smallest id.

    Of rows that share an id (ties) that whose text has the smallest hash stays,
    repeated rows stay once, and a row without an id only if its group has none.
    Null texts count as empty, and all empty ones are one group; very long texts
    are hashed whole. An empty table gives an empty one; other columns stay.
    """
    return simhash.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go.

    Null, empty and word-less texts hold none; very long texts are searched whole;
    rows of one id are judged by their own texts, repeated rows go or stay together.
    An empty table gives an empty one; other columns stay.
    """
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated")
    bad = materialize(found.select(F.col("doc_id").alias("b_id"), F.col("text_key").alias("b_key")).distinct(), "contaminated")
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["b_id"]) & (F.xxhash64(docs["text"]) == bad["b_key"]), "left_anti")


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind; lengths follow.

    A null text stays null, and its length is null; very long texts are searched whole; repeated rows are masked alike. An empty table gives an empty
    one; other columns stay, whatever they are called.
    """
    own, columns = _apart(docs, "spans")
    found = pii.with_spans(own).withColumn("text", pii.masked())
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix, one row a slot of the output shards: shard, slot, source, block,
    its words, the documents they are of, and the text.

    Texts without words (null, empty) take no part; very long ones are cut into
    blocks of their source; repeated rows count as often as they stand. An empty
    table gives an empty one; no other column is taken over."""
    mix = mixing.blocks(mixing.sized(docs))
    each = lambda name: F.transform("parts", lambda p: p[name])
    return mix.select("shard", "slot", "source", "block", "words", each("doc_id").alias("doc_ids"), F.array_join(each("text"), "\n").alias("text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
]

#: SQL cannot express the first two stages; tests hold each of the first four against
#: brute force on its own input, and the run against their sequence.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, start = table(spark, sf_dir, "documents"), written()
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        release(spark, start)  # what led to the stage's table; the table stays
    return STAGES[-1][1](spark, docs, sf_dir)
