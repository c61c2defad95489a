"""Spelling variants: words that one edit parts, by an even-partition pigeonhole join.

A word of l code points is split into two segments, of l // 2 code points and the rest. If one inserted, deleted or replaced code
point parts it from a word of the same length or one longer, the edit spares one of the segments: the other word
begins with the first, or ends with the second (which is moved by one in a longer word). So each word is indexed under both
segments with its length, and probes the segments of words of its own length and of one less.

The segment that may hold the edit is *open*. A key under which over ``MOST`` words are indexed is split again, by halving its open
segment: a pair goes to the right half if all before it is equal, and to the left half otherwise. So short segments
that many words share are no hot keys, a word meets a bounded number of words under each key, and each pair comes up under one
key only, with nothing to sort out afterwards. An open segment of one code point is not split: it bounds its key
by the alphabet.

All is joins and aggregations of DataFrames; texts are counted where they are, and only distinct words are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.scratch import Scratch

MOST, LEAST_LENGTH, LEAST_COUNT, SLIP = 64, 5, 3, 97
LETTERS = r"[A-Za-zÀ-ÿ]+"


def _cut(word: Column, start: Column, end: Column) -> Column:
    """Code points from ``start`` to before ``end``, from 0."""
    return F.substring(word, start + 1, end - start)


def slipped(doc_id: Column, run: Column, every: int = SLIP) -> Column:
    """The run, or without one code point where a hash of document and run says so."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % every == 0, F.concat(_cut(run, F.lit(0), at), _cut(run, at + 1, F.char_length(run)))).otherwise(run)


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slips: int | None = None) -> DataFrame:
    """(word, n, l): the runs of letters of all texts with A-Z lower-cased, that have ``LEAST_LENGTH`` code points and come
    ``LEAST_COUNT`` times at least. With ``slips``, one in so many runs has lost a letter first."""
    low = F.translate(F.col(text_col).cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(low, F.lit(LETTERS), F.lit(0))).alias("run")).where(F.char_length("run") >= LEAST_LENGTH)
    word = slipped(F.col("id"), F.col("run"), slips) if slips else F.col("run")
    found = runs.select(word.alias("word")).where(F.char_length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n"))
    return found.where(F.col("n") >= LEAST_COUNT).withColumn("l", F.char_length("word"))


def _keyed(rows: DataFrame) -> DataFrame:
    """``rows`` (word, n, l, longer, a, b) with a hash of the length and of what surrounds the open segment from a to b."""
    rest = F.substring(F.col("word"), F.col("b") + F.col("longer") + 1, F.col("l"))
    return rows.withColumn("key", F.xxhash64("l", "a", "b", _cut(F.col("word"), F.lit(0), F.col("a")), rest))


def _halves(rows: DataFrame, a: Column, b: Column) -> DataFrame:
    h = a + F.floor((b - a) / 2).cast("int")
    both = F.array(F.struct(a.alias("a"), h.alias("b")), F.struct(h.alias("a"), b.alias("b")))
    return _keyed(rows.withColumn("open", F.explode(both)).select("word", "n", "l", "longer", "open.a", "open.b"))


def _pairs(index: DataFrame, probes: DataFrame) -> DataFrame:
    """The pairs of words one edit apart that meet under a key, each under the one that is its own."""
    s, r = F.col("s.word"), F.col("r.word")
    a, b, longer = F.col("s.a"), F.col("s.b"), F.col("r.longer")
    met = index.alias("s").join(probes.alias("r"), ["key", "l", "a", "b"])
    around = (_cut(s, F.lit(0), a) == _cut(r, F.lit(0), a)) & (F.substring(s, b + 1, F.col("s.l")) == F.substring(r, b + longer + 1, F.col("s.l")))
    own = (b == F.col("s.l")) | (_cut(s, F.lit(0), b) != _cut(r, F.lit(0), b))
    near = met.where(((longer == 1) | (s < r)) & around & own & (F.levenshtein(s, r, 1) == 1))
    return near.select(s.alias("word"), F.col("s.n").alias("n"), r.alias("other"), F.col("r.n").alias("other_n"))


def near_words(scratch: Scratch, words: DataFrame) -> DataFrame:
    """(word, n, other, other_n) of the pairs of ``words`` (word, n, l; distinct) that one edit parts, each once."""
    zero, l = F.lit(0), F.col("l")
    index = _halves(words.withColumn("longer", zero), zero, l)
    asked = words.withColumn("longer", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("l", F.col("l") - F.col("longer")).where("l > 0")
    probes = _halves(asked, zero, l)
    found = []
    while True:
        index, probes = scratch.keep(index, "index"), scratch.keep(probes, "probes")
        sizes = index.groupBy("key").agg(F.count("*").alias("size"), F.max(F.col("b") - F.col("a")).alias("width"))
        hot = scratch.keep(sizes.where(f"size > {MOST} and width > 1").select("key"), "hot")
        found.append(scratch.keep(_pairs(index.join(hot, "key", "left_anti"), probes), "pairs"))
        if hot.isEmpty():
            break
        last = (index, probes, hot)
        index, probes = (_halves(x.join(hot, "key", "left_semi"), F.col("a"), F.col("b")) for x in (index, probes))
    scratch.drop(*last) if len(found) > 1 else None
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def roots(scratch: Scratch, forms: DataFrame) -> DataFrame:
    """(word, root) of the rows of ``forms`` (word, form), by following forms to the last; each round doubles the steps taken."""
    now = scratch.keep(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not now.where("moved").isEmpty():
        step = now.select(F.col("word").alias("at"), F.col("root").alias("beyond"))
        moved = now.join(step, now["root"] == step["at"], "left")
        after = scratch.keep(moved.select("word", F.coalesce("beyond", "root").alias("root"), F.col("at").isNotNull().alias("moved")), "roots")
        scratch.drop(now)
        now = after
    return now.select("word", "root")


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slips: int | None = None) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of each word of the texts of ``docs``.

    Words are as in ``count_words``. n_near counts the words one edit apart. The form is the most frequent of them (ties: the first
    by code points) if it is at least twice as frequent as the word, else null; the root is where forms lead in the end, the
    word itself if it has none. Null and empty texts have no words; rows that repeat count each; a null id is hashed as
    an empty one. Other columns are not looked at. Spark jobs run when this is called.
    """
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.keep(count_words(docs, id_col, text_col, slips), "words")
    pairs = near_words(scratch, words)
    both = pairs.union(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    likely = -F.col("best.less") >= 2 * F.col("n")
    known = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(likely, F.col("best.other")).alias("form"), F.when(likely, -F.col("best.less")).alias("form_n"))
    known = scratch.keep(known, "known")
    last = roots(scratch, known.where("form is not null"))
    return known.join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))
