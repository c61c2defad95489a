"""Mixing sources to target weights, in DataFrame functions only.

Words are summed by source, sources get a share of all words by weight, and a share above ``most`` times the source's
own words stops there, what it leaves being shared among the others by weight until none is above. A source's rate is its
target over its words: each of its documents is emitted floor(rate) times, and once more with a probability of the
rest, drawn by a hash of the document, so that a rerun or a lost executor gives the same mix.

Only sums by source are shuffled, combined before. Sources are ranked in range partitions (there may be any number), and
Spark picks a broadcast for their table by its size on disk, or else a sort-merge join that AQE splits at a hot source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.scratch import Scratch

WEIGHTS, MOST, SEED = (5, 2, 1), 3, "mix"
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """The number of runs of anything but ASCII white space; null has none."""
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def draw(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A number of [0, 1) that only the id, the text and the seed decide."""
    own = F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(own), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def _weighed(scratch: Scratch, sums: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """``sums`` with each source's weight: sources in order of their code points, null last, take the weights in turn.

    Range partitions are ranked each by itself, after the number of sources in the partitions before.
    """
    n = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.col("source").asc_nulls_last()
    dealt = scratch.keep(sums.repartitionByRange(n, order).withColumn("part", F.spark_partition_id()), "sources")
    before = F.coalesce(F.sum("count").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    first = dealt.groupBy("part").count().select("part", before.alias("first"))  # a row a partition
    place = F.row_number().over(W.partitionBy("part").orderBy(order)) - 1 + F.col("first")
    each = F.array(*(F.lit(float(w)) for w in weights))
    return dealt.join(first, "part").select("source", "source_size", F.get(each, (place % len(weights)).cast("int")).alias("weight"))


def plan_mixture(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, weight, target, rate) of each source of ``sizes`` (source, size).

    Targets add up to all sizes. A source without words has the target and the rate 0. A few small Spark jobs run when this
    is called: one for each time that what capped sources leave is shared anew.
    """
    scratch = Scratch(sizes.sparkSession, "mixing")
    sums = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("source_size"))
    sources = scratch.keep(_weighed(scratch, sums, weights), "weighed")
    limit, capped, stopped = F.col("source_size") * float(most), F.lit(False), -1
    share, weight = 0.0, 1.0
    while True:
        left = sources.agg(
            F.count_if(capped).alias("stopped"), F.sum("source_size").alias("all"),
            F.sum(F.when(capped, F.col("source_size")).otherwise(0)).alias("taken"), F.sum(F.when(~capped, F.col("weight")).otherwise(0.0)).alias("weight"),
        ).first()
        if left["stopped"] == stopped or not left["weight"]:
            break
        stopped, share, weight = left["stopped"], float(left["all"] - most * left["taken"]), left["weight"]
        capped = limit <= F.col("weight") * share / weight
    target = F.when(capped, limit).otherwise(F.col("weight") * share / weight)
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    return sources.withColumn("target", target).withColumn("rate", rate)


def copies(drawn: DataFrame, mixture: DataFrame) -> DataFrame:
    """``drawn`` (source and draw among its columns) with its source's ``source_size``, ``target`` and ``rate``, and ``copies``."""
    m = mixture.select(F.col("source").alias("mixed_source"), "source_size", "target", "rate")
    rows = drawn.join(m, drawn["source"].eqNullSafe(m["mixed_source"]), "left").drop("mixed_source")
    whole = F.floor("rate")
    return rows.withColumn("copies", whole + F.when(F.col("draw") < F.col("rate") - whole, 1).otherwise(0))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, draw) of each row."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), draw(F.col(id_col), F.col(text_col), seed).alias("draw"))


def mix_counts(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, **columns: str) -> DataFrame:
    """(doc_id, source, size, draw, source_size, target, rate, copies) of each row of ``docs``.

    Null and empty texts have a size of 0. Null sources are one source, the last. Rows are documents each, whatever their
    id; rows that are alike in id and text have one draw. Other columns are not looked at.
    """
    rows = Scratch(docs.sparkSession, "mixing").keep(measured(docs, **columns), "measured")
    return copies(rows, plan_mixture(rows, weights, most))


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with ``copy`` (from 1); a given column of that name is replaced."""
    mixture = plan_mixture(docs.select(F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size")), weights, most)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(source_col).cast("string").alias("source"), draw(F.col(id_col), F.col(text_col), seed).alias("draw"))
    often = copies(rows, mixture).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return often.select(*(F.col("row").getField(c).alias(c) for c in docs.columns if c != "copy"), "copy")
