"""The pipeline stage by stage, and the queries of the subpackage."""

import collections
import hashlib
import itertools

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import minhash_dedup
from quire.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


def first_places(rows, length):
    """What is left of texts (in order) of whose repeated strings only the first place stays; characters stay whole."""
    seen, out = set(), {}
    for r in rows:
        b = r.text.encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if b[p : p + length] in seen:
                gone[p : p + length] = True
            seen.add(b[p : p + length])
        at, left = 0, []
        for c in r.text:
            n = len(c.encode())
            if not gone[at : at + n].all():
                left.append(c)
            at += n
        out[r.doc_id] = "".join(left)
    return {d: text for d, text in out.items() if text}


def least_of_groups(rows):
    """The ids that stay of documents whose shingle sets are alike."""
    sets = {r.doc_id: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for r in rows if (w := (r.text or "").encode().lower().split()) or True}
    sets = {d: s - {()} for d, s in sets.items()}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d for d in sets if find(d) == d}


def test_stages_work_on_what_is_kept(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        given = docs.withColumn("h", F.xxhash64("text")).orderBy("doc_id", "h").collect()
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert out.columns == columns and 0 < out.count() <= before
            before, docs = out.count(), out
        if name == "minhash_near_dedup":
            assert {r.doc_id for r in out.collect()} == least_of_groups(given)
        if name == "suffix_array_dedup":
            assert {r.doc_id: r.text for r in out.collect()} == first_places(given, 240)
            assert all(r.n_chars == len(r.text) for r in out.collect())
    assert out.select("doc_id").distinct().count() == before and out.where("offset + length > capacity").count() == 0


def test_stages_take_odd_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(None, "words without a number stand here and there", "en", None, 3), (-1, None, None, None, None), (-2, "", "en", "s", 0), (-3, "123 ...", "en", "s", 7)], docs.schema)
    docs = docs.union(odd).union(odd)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
    assert docs.count() > 0


def test_texts_under_one_id_are_judged_each_by_itself(spark):
    words = [" ".join(f"{a}{k}" for k in range(80)) for a in "abcd"]
    rows = [(5, words[0]), (5, words[1]), (5, words[1]), (7, words[1] + " x"), (2, words[2]), (5, words[2]), (9, words[3]), (9, words[3] + " x"), (8, ""), (8, None), (None, words[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id or 0, r.text or "") for r in corpus_pipeline.drop_near_duplicates(spark, docs, DATA).collect()))
    nine = [t for k, t in got if k == 9]
    assert len(nine) == 1 and nine[0].startswith(words[3])
    assert [x for x in got if x[0] != 9] == sorted([(0, words[0]), (2, words[2]), (5, words[0]), (5, words[1]), (8, ""), (8, "")])
    found = minhash_dedup.near_duplicates(docs).where("doc_id is not null").collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == sorted([(5, 5), (5, 5), (5, 5), (7, 5), (2, 2), (5, 2), (9, 9), (9, 9), (8, 8), (8, 8)])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries(spark, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    assert got
    if name in ORACLE_SQL:
        c = duckdb.connect()
        for t in ("documents", "embeddings"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
        # nulls and words don't compare
        assert sorted(got, key=repr) == sorted(c.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall(), key=repr)


def test_repeats_of_a_whole_table_are_those_of_all_windows(spark):
    """Each passage of 400 bytes or more that another place has goes, and nothing else."""
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    seen = collections.Counter(hash(b[p : p + 400]) for b in texts.values() for p in range(len(b) - 399))
    cut = 0
    for r in QUERIES["op5_suffix_array_dedup"](spark, DATA).collect():
        b = texts[r.doc_id]
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - 399):
            if seen[hash(b[p : p + 400])] > 1:
                gone[p : p + 400] = True
        left = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        assert (r.n_bytes, r.n_removed, r.n_kept, r.n_spans) == (len(b), len(b) - len(left), len(left), int((gone[1:] < gone[:-1]).sum()))
        assert r.kept_sha256 == hashlib.sha256(left).hexdigest() and r.text == left.decode("utf-8", "replace")
        cut += gone.any()
    assert cut > 20


def test_run(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.select(F.sum("length")).first()[0] > 0
