"""Search, samples, quality and stability of topic tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators.validate import look_up
from quire.storage import Scratch


def search(topics: DataFrame, query: str) -> DataFrame:
    """Topics whose title, summary or quote holds the query, whatever the case; a blank query finds all."""
    q = query.lower().strip()
    held = F.lit(not q)
    for c in SEARCHED:
        held = held | F.lower(c).contains(q)
    return topics.where(held)


SEARCHED = ("topic", "summary", "supporting_quote")
GRAM = 3


def _grams(text: Column) -> Column:
    """The distinct runs of ``GRAM`` characters of a text in lower case: what is ahead of each of its places."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))


def search_index(scratch: Scratch, topics: DataFrame) -> DataFrame:
    """(gram, doc_id, candidate_id) of the searched fields of ``topics``, written in buckets of the gram and sorted by it."""
    grams = F.array_distinct(F.flatten(F.array(*(F.coalesce(_grams(F.lower(c)), F.array().cast("array<string>")) for c in SEARCHED))))
    return scratch.keep_bucketed(topics.select("doc_id", "candidate_id", F.explode(grams).alias("gram")), ["gram"], "grams")


def search_indexed(topics: DataFrame, index: DataFrame, query: str) -> DataFrame:
    """``search`` by an index: of topics that have all of the query's runs of three letters, those that hold it. A query
    of fewer letters is looked for in all topics. Ids of topics have to be unique and not null."""
    q = query.lower().strip()
    wanted = sorted({q[k : k + GRAM] for k in range(len(q) - GRAM + 1)})
    if not wanted:
        return search(topics, query)
    held = index.where(F.col("gram").isin(wanted)).groupBy("doc_id", "candidate_id").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted))
    return search(topics.join(held.drop("n"), ["doc_id", "candidate_id"], "left_semi"), query)


def fully_verified() -> Column:
    return (F.col("confidence") == 1) & ~F.col("needs_human_review")


def within_chunks(topics: DataFrame, bounds: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, candidate_id) of topics that begin in a chunk's pages or later and end a page after it at most: what
    stands in for a chunk whose extraction failed."""
    held = bounds.select("doc_id", "chunk_id", F.col("start_page").alias("lo"), F.col("end_page").alias("hi"))
    page = lambda first, last: F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>")))
    inside = held.withColumn("page", page(F.col("lo"), F.col("hi") + 1))
    t = topics.select("doc_id", "candidate_id", "start_page", "end_page")
    whole = (F.col("start_page") >= F.col("lo")) & (F.col("end_page") <= F.col("hi") + 1)
    # a topic that isn't inverted begins on a page of its chunk; of the others, which may begin anywhere after it, the end decides
    straight = t.where("start_page <= end_page").withColumn("page", F.col("start_page").cast("int")).join(inside, ["doc_id", "page"])
    inverted = t.where("start_page > end_page").join(held, "doc_id")
    return straight.where(whole).select("doc_id", "chunk_id", "candidate_id").union(inverted.where(whole).select("doc_id", "chunk_id", "candidate_id"))


def highlighted(topics: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, candidate_id, n_lines, first_gid, last_gid) of the lines that a topic's range highlights."""
    from quire.operators.validate import lines_of_topics, page_limits

    g = F.col("global_line_id")
    return lines_of_topics(topics, lines, page_limits(lines)).groupBy("doc_id", "candidate_id").agg(F.count("*").alias("n_lines"), F.min(g).alias("first_gid"), F.max(g).alias("last_gid"))


def numbered(topics: DataFrame) -> DataFrame:
    """``topics`` with ``num``, from 1, in the order of coordinates and arrival."""
    order = ["start_page", "start_line", "end_page", "end_line", "candidate_id"]
    return topics.withColumn("num", F.row_number().over(W.partitionBy("doc_id").orderBy(*order)))


def systematic_sample(topics: DataFrame, most: int = 20) -> DataFrame:
    """Every so many topics of a document, ``most`` of them or all if there are fewer."""
    n = F.count("*").over(W.partitionBy("doc_id"))
    rows = numbered(topics).withColumn("n", n).withColumn("k", F.least(F.lit(most), F.col("n")))
    step = F.greatest(F.lit(1), F.floor(F.col("n") / F.col("k"))).cast("long")
    at = F.col("num") - 1
    return rows.where((at % step == 0) & (at < F.col("k") * step)).withColumn("num", (at / step + 1).cast("int")).drop("n", "k")


def audit_matrix(topics: DataFrame, index: DataFrame, most: int = 20) -> DataFrame:
    """The sample's rows: num, topic, range, whether both lines exist, the fixed relevance and boundary scores, and the quote.

    Relevance is 1 by definition, and boundaries score 0.95, or 0.8 if a line is beyond 25.
    """
    rows = look_up(look_up(systematic_sample(topics, most), index, "start"), index, "end")
    place = F.format_string("P%d:L%d - P%d:L%d", "start_page", "start_line", "end_page", "end_line")
    return rows.select(
        "doc_id", "num", "topic", place.alias("range"),
        F.when(F.col("start_gid").isNotNull() & F.col("end_gid").isNotNull(), F.lit(1.0)).otherwise(F.lit(0.0)).alias("location"),
        F.lit(1.0).alias("relevance"),
        F.when((F.col("start_line") <= 25) & (F.col("end_line") <= 25), F.lit(0.95)).otherwise(F.lit(0.8)).alias("boundary"),
        F.when(F.col("supporting_quote") != "", F.concat(F.substring("supporting_quote", 1, 80), F.lit("..."))).otherwise("(Verified)").alias("quote"),
    )


def quality_means(matrix: DataFrame) -> DataFrame:
    mean = lambda c: F.round(F.avg(c) * 100, 1).alias(f"avg_{c}")
    return matrix.groupBy("doc_id").agg(F.count("*").alias("sampled"), mean("location"), mean("relevance"), mean("boundary"))


def redundancy(topics: DataFrame) -> DataFrame:
    """(doc_id, n_topics, n_verified, redundancy_pct): the share of topics that begin where another does."""
    rows = topics.groupBy("doc_id").agg(F.count("*").alias("n_topics"), F.count_if(F.col("verified")).alias("n_verified"), F.count_distinct(F.struct("start_page", "start_line")).alias("d"))
    return rows.select("doc_id", "n_topics", "n_verified", F.round(100.0 * (1 - F.col("d") / F.col("n_topics")), 1).alias("redundancy_pct"))


#: How often letters come in English text, in percent, about; the rest is rarer than any.
LETTER_SHARES = {
    " ": 18.0, "e": 10.3, "t": 7.5, "a": 6.5, "o": 6.2, "n": 5.7, "i": 5.7, "s": 5.3, "r": 5.0, "h": 5.0, "l": 3.3, "d": 3.3, "u": 2.3,
    "c": 2.2, "m": 2.0, "f": 2.0, "w": 1.7, "g": 1.6, "p": 1.5, "y": 1.4, "b": 1.3, "v": 0.8, "k": 0.6, "x": 0.1, "j": 0.1, "q": 0.1, "z": 0.1,
}


def letters(label: Column) -> Column:
    """Each letter of a label with the number of its occurrence, the rarest first: two labels share as many of them as they have
    letters in common."""
    rarity = F.lit([-8.0, *(math.log(share / 100) for share in LETTER_SHARES.values())])
    known = F.lit("".join(LETTER_SHARES))

    def token(chars: Column, c: Column, i: Column) -> Column:
        k = i + 2 - F.array_position(chars, c)  # the letters are sorted, so like ones are in a row
        return F.struct((k * F.element_at(rarity, F.instr(known, c) + 1)).alias("rarity"), F.concat(c, k.cast("string")).alias("token"))

    own = F.sort_array(F.when(F.length(label) > 0, F.split(label, "")).otherwise(F.array().cast("array<string>")))
    each = F.element_at(F.transform(F.array(own), lambda chars: F.transform(chars, lambda c, i: token(chars, c, i))), 1)
    return F.transform(F.sort_array(each), lambda x: x["token"])


def _labels_met(asked: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, run_b, x) of the rows of ``asked`` (doc_id, run_b, x, p) of which a label (doc_id, run_b, y, q) is alike; p and q are ``letters``.

    Likeness of ``threshold`` needs a number of common letters. So labels meet only if they share one of their rarest letters, as many of
    these as could be spared and one more; of the pairs that meet, those with too few common letters are dropped, and the
    similarity of the others is computed. A pair counts under its first shared letter only.
    """
    def prefixed(rows: DataFrame, name: str) -> DataFrame:
        spared = F.size(name) - F.ceil(F.size(name) * (threshold / (2 - threshold)) - 1e-9)
        rows = rows.withColumn(f"{name}_rare", F.slice(name, F.lit(1), (spared + 1).cast("int")))
        return rows.withColumn("letter", F.explode(f"{name}_rare"))

    # the tables are small as files and many times larger once their letters are exploded: neither side may be broadcast by its file's size
    met = prefixed(asked, "p").join(prefixed(labels, "q").hint("merge"), ["doc_id", "run_b", "letter"])
    first = F.col("letter") == F.element_at(F.array_intersect("p_rare", "q_rare"), 1)
    enough = 2.0 * F.size(F.array_intersect("p", "q")) >= threshold * (F.size("p") + F.size("q")) - 1e-9
    return met.where(first & enough).where(T.matched_ratio(F.col("x"), F.col("y")) >= threshold).select("doc_id", "run_b", "x").distinct()


def _met_runs(runs: DataFrame) -> DataFrame:
    """(doc_id, label, own, letters, runs): each label of a document, the runs that have it with how often, its letters, and all runs of the
    document; written once, in as many parts as shuffles have, as what reads it computes more than it moves."""
    scratch = Scratch(runs.sparkSession, "stability")
    n = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    labels = runs.groupBy("doc_id", F.lower(T.stripped(F.col("topic"))).alias("label"), "run_id").agg(F.count("*").alias("n"))
    labels = scratch.keep(labels, "labels")
    known = labels.groupBy("doc_id").agg(F.collect_set("run_id").alias("runs")).withColumnRenamed("doc_id", "d")
    rows = labels.repartition(n, "doc_id", "label").groupBy("doc_id", "label").agg(F.collect_list(F.struct("run_id", "n")).alias("own")).withColumn("letters", letters(F.col("label")))
    return scratch.keep(rows.join(known.hint("merge"), F.col("doc_id").eqNullSafe(F.col("d"))).drop("d"), "met")  # a row a document


def _similarity(met: DataFrame, threshold: float) -> DataFrame:
    own = F.transform("own", lambda o: o["run_id"])
    rows = met.where("doc_id is not null").withColumn("runs_with", own)
    asked = rows.select("doc_id", F.col("label").alias("x"), F.col("letters").alias("p"), "own", "runs_with", F.explode("runs").alias("run_b")).where(F.array_min("runs_with") < F.col("run_b"))
    asked = asked.withColumn("same", F.col("x").isNotNull() & F.array_contains("runs_with", F.col("run_b")))
    if threshold <= 1:
        others = rows.where("label is not null").select("doc_id", F.col("label").alias("y"), F.col("letters").alias("q"), F.explode("runs_with").alias("run_b"))
        alike = _labels_met(asked.where("not same").select("doc_id", "run_b", "x", "p"), others, threshold).withColumn("alike", F.lit(True))
        asked = asked.join(alike, ["doc_id", "run_b", "x"], "left").withColumn("same", F.col("same") | F.coalesce("alike", F.lit(False)))
    each = asked.select("doc_id", "run_b", "same", F.explode("own").alias("o")).where(F.col("o.run_id") < F.col("run_b"))
    found = F.sum(F.when(F.col("same"), F.col("o.n")).otherwise(0)) / F.sum("o.n")
    return each.groupBy("doc_id", F.col("o.run_id").alias("run_a"), "run_b").agg(found.alias("similarity"))


def label_similarity(runs: DataFrame, threshold: float = 0.70) -> DataFrame:
    """(doc_id, run_a, run_b, similarity): of the labels of one run, the share with a like one in the other; not symmetric.

    ``threshold`` is more than 0; over 1, only equal labels are alike. Runs and labels of one document meet, never those of
    different ones; a null label is like no other. Two tables are written when this is called.
    """
    return _similarity(_met_runs(runs), threshold)


def run_stability(runs: DataFrame, threshold: float = 0.70) -> DataFrame:
    """(doc_id, runs, count_variance, mean_similarity): the spread of topic counts and the mean over pairs of runs."""
    met = _met_runs(runs)
    counts = met.select("doc_id", F.explode("own").alias("o")).groupBy("doc_id", "o.run_id").agg(F.sum("o.n").alias("n")).groupBy("doc_id").agg(F.count("*").alias("runs"), (F.max("n") - F.min("n")).alias("count_variance"))
    mean = _similarity(met, threshold).groupBy("doc_id").agg(F.round(F.avg("similarity"), 6).alias("mean_similarity"))
    return counts.join(mean, "doc_id", "left")
