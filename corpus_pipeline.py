"""A pipeline from raw ``documents`` to packed training sequences.

Each stage calls one operator of ``quire.llm`` on all that the stage before kept, and its decisions
take effect; stages are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import langid, minhash_dedup, packing, quality, suffix_dedup
from quire.llm.scratch import Scratch


#: How near duplicates are found; what the distances miss is in the README.
NEAR = {"words": 5, "percent": 80, "distance": 23, "chunk": 5}


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and texts whose language is ambiguous."""
    model = langid.fit_languages(docs)
    found = langid.identify(docs, model)
    return found.where("lang_pred != 'und' and not ambiguous").select(docs.columns)


def judge_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that score below 0.3."""
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score_quality(docs, model).where("score >= 0.3").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8), the document of the smallest id stays.

    Of equal rows one stays, and different texts under one id are judged each by itself; rows without an id
    can't be named as a duplicate and stay.
    """
    return minhash_dedup.first_of_duplicates(docs, **NEAR).union(docs.where("doc_id is null"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts strings of 240 bytes (some 40 words) that start at two places, but for the first one; a text of which nothing is left goes.

    First is by id, then by the text's hash and the place in it; equal texts under one id are one text. Null texts go.
    """
    cut = suffix_dedup.remove_repeats(docs, length=240, characters=True, first=True)
    text = cut["kept"].cast("string")
    return cut.withColumn("text", text).withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"])).where("text != ''").select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs byte-level tokens, an end mark a document, into sequences of several permitted lengths: a row tells where a piece of a
    document goes. Rows whose id repeats are documents of their own."""
    return packing.pack_documents(docs, F.coalesce(F.octet_length("text"), F.lit(0)) + 1)


STAGES = [
    ("language_id", identify_language),
    ("quality_classifier", judge_quality),
    ("minhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("best_fit_packing", pack_sequences),
]

#: The models of the first two stages are learnt; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
