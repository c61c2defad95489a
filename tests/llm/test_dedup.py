"""Near duplicates, repeats and embeddings against brute force, with odd inputs."""

import hashlib
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import clusters, embed_dedup, minhash_dedup, suffix_dedup
from quire.llm.scratch import Scratch, connected_components

DOCS = "doc_id long, text string, key string, n_shingles string"
WORDS = [f"w{k}" for k in range(400)]


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def shingles(text, n=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def near_texts(seed=1):
    rng, out = random.Random(seed), []
    for _ in range(45):
        base = [rng.choice(WORDS) for _ in range(rng.choice([3, 8, 60, 150]))]
        for _ in range(rng.choice([1, 2, 9])):
            w = [*base]
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            out.append(rng.choice([" ", "\n", "\t "]).join(w))
    return out


def test_components_of_long_chains(spark):
    rng = random.Random(3)
    links = [(k, k + 1) for k in range(60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(300, k) for k in range(301, 340)] + [(5, 5)]
    rng.shuffle(links)
    got = dict(connected_components(Scratch(spark, "t"), spark.createDataFrame(links, "a long, b long")).collect())
    want = components({x for a, b in links if a != b for x in (a, b)}, links)
    assert got == want
    assert connected_components(Scratch(spark, "t"), spark.createDataFrame([], "a long, b long")).count() == 0


def test_chunk_plan_guarantees_the_distance():
    for values, distance, size in ((64, 20, 6), (64, 23, 5), (8, 3, 2), (10, 4, 3)):
        plan = minhash_dedup.chunk_plan(values, distance, size)
        assert sum(e + 1 for *_, e in plan) >= distance + 1 and plan[-1][1] <= values
    plan, rng = minhash_dedup.chunk_plan(), np.random.default_rng(1)
    for _ in range(300):
        a = rng.integers(0, 256, (1, 64)).astype(np.uint8)
        b = a.copy()
        b[0, rng.choice(64, 20, replace=False)] ^= 1
        assert set(minhash_dedup.chunk_keys(a, plan)[0]) & set(minhash_dedup.chunk_keys(b, plan)[0])
    with pytest.raises(ValueError):
        minhash_dedup.chunk_plan(4, 20, 2)


def test_sketches_prove_what_they_drop():
    """No pair of sets at or over the threshold is dropped, whatever the sizes; most others are."""
    rng, kept, over = np.random.default_rng(2), 0, 0
    for n in (1, 2, 7, 60, 500, 4000, 30000):
        for share in (0.0, 0.5, 0.7, 0.8, 0.85, 0.9, 1.0):
            both = round(2 * share * n / (1 + share))
            all_ = rng.integers(0, 2**63, 2 * n - both, dtype=np.uint64)
            a, b = all_[:n], np.concatenate([all_[:both], all_[n:]])
            x, y = (np.frombuffer(clusters.sketch(s), np.uint8)[None] for s in (a, b))
            reaches = 100 * both >= 85 * (2 * n - both)
            assert clusters.may_reach(x, y, 85)[0] or not reaches
            kept, over = kept + int(clusters.may_reach(x, y, 85)[0] and not reaches), over + int(not reaches)
    assert kept < over / 2


@pytest.mark.parametrize("most", [1, 7, 1 << 14])
def test_pairs_across_components_are_those_of_each_cell(monkeypatch, most):
    """Cells of one and of two blocks, one without a second block, and one within a component; however many pairs are tried at once."""
    monkeypatch.setattr(clusters, "PAIRS", most)
    rng, rows, want = np.random.default_rng(3), [], set()
    test = lambda a, b: (a[:, 0] ^ b[:, 0]) % 3 == 0
    first = lambda a, b, slot: (a[:, 1] + b[:, 1]) % 2 == slot
    for cell, (one, two) in enumerate([(0, 0), (0, 1), (2, 2), (1, 3), (0, 4), (5, 5)]):
        blocks = [one] * 12 if cell == 4 else [one] * 9 + [two] * 14
        own = [(cell, int(n), 7 if cell == 5 else int(rng.integers(0, 4)), one, two, block, cell % 2, rng.integers(0, 256, 8).astype(np.uint8)) for n, block in zip(rng.permutation(40), blocks)]
        rows += sorted(own, key=lambda r: r[5])
        for x, y in itertools.combinations(own, 2):
            if (one == two or x[5] != y[5]) and x[2] != y[2] and test(x[7][None], y[7][None])[0] and first(x[7][None], y[7][None], cell % 2)[0]:
                want.add((min(x[1], y[1]), max(x[1], y[1])))
    names = ["cell", "node", "component", "one", "two", "own", "slot", "sig"]
    table = pa.table({c: [r[k].tobytes() if c == "sig" else r[k] for r in rows] for k, c in enumerate(names)})
    batches = clusters._across(test, 8, first)(iter(table.to_batches(max_chunksize=10)))
    got = {p for b in batches for p in zip(b.column("a").to_pylist(), b.column("b").to_pylist())}
    assert got == want and len(want) > 20


def test_no_candidate_within_the_distance_is_lost():
    """The multi-index join passes on every pair within the distance that may reach the threshold, on settings of queries and pipeline."""
    rng = np.random.default_rng(6)
    for percent, distance, chunk in ((85, minhash_dedup.DISTANCE, minhash_dedup.ERROR_CHUNK), tuple(corpus_pipeline.NEAR[k] for k in ("percent", "distance", "chunk"))):
        plan, test = minhash_dedup.chunk_plan(64, distance, chunk), minhash_dedup.candidates(distance, percent)
        base = np.frombuffer(clusters.sketch(np.arange(50, dtype=np.uint64)), np.uint8)
        for _ in range(100):
            a = np.concatenate([rng.integers(0, 256, 64).astype(np.uint8), base])[None]
            b = a.copy()
            b[0, rng.choice(64, distance, replace=False)] ^= 1
            assert test(a, b)[0] and set(minhash_dedup.chunk_keys(a[:, :64], plan)[0]) & set(minhash_dedup.chunk_keys(b[:, :64], plan)[0])


def test_recall_of_the_pipelines_settings():
    """Pairs of sets at exactly the threshold that lie within the distance: at least 0.99, by the operator's own signatures."""
    rng = np.random.default_rng(9)
    for percent, distance in ((85, minhash_dedup.DISTANCE), (corpus_pipeline.NEAR["percent"], corpus_pipeline.NEAR["distance"])):
        near = 0
        for _ in range(1000):
            united, both = 200, 2 * percent
            members = rng.integers(0, 2**63, united, dtype=np.uint64)
            own = (united - both) // 2
            a, b = members[: both + own], np.concatenate([members[:both], members[both + own :]])
            sig = minhash_dedup.signatures(np.concatenate([a, b]), np.array([0, len(a)]))
            near += int((sig[0] != sig[1]).sum() <= distance)
        assert near >= 990


def test_near_duplicates_are_those_of_all_pairs(spark):
    texts = [*near_texts(), "", None, "one two", "ONE\ttwo", "É a", "x " * 3000, "x " * 3000]
    rows = [(k, t, "k", "n") for k, t in enumerate(texts)] + [(None, texts[0], "k", "n"), (0, texts[0], "k", "n")]
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    sets = {k: shingles(t) for k, t in enumerate(texts)}
    links = [(a, b) for a in sets for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = components(sets, links)
    assert len(got) == len(rows) and len(links) > 20
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), want[r.doc_id])


def test_one_hot_group_of_near_copies(spark):
    """Copies that differ from each other more than from some middle: links that only the exhaustive step finds."""
    rng = random.Random(5)
    base = [rng.choice(WORDS) for _ in range(140)]
    texts = []
    for _ in range(120):
        w = [*base]
        for k in rng.sample(range(140), rng.choice([1, 2, 3, 4, 6])):
            w[k] = rng.choice(WORDS)
        texts.append(" ".join(w))
    sets = {k: shingles(t) for k, t in enumerate(texts)}
    want = components(sets, [(a, b) for a in sets for b in range(a) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])])
    got = minhash_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    assert minhash_dedup.near_duplicates(docs).count() == 0
    assert suffix_dedup.remove_repeats(docs).count() == 0
    assert embed_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


# --- repeats ----------------------------------------------------------------------------------------


def removed(texts, length):
    seen = {}
    for d, b in enumerate(texts):
        for p in range(len(b) - length + 1):
            seen.setdefault(b[p : p + length], []).append((d, p))
    cover = [set() for _ in texts]
    for at in seen.values():
        if len(at) > 1:
            for d, p in at:
                cover[d].update(range(p, p + length))
    return cover


def repeating_texts(seed=2):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéü日") for _ in range(rng.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(40) for _ in range(5)]
    texts = [prose(rng.randrange(1, 60)) + rng.choice(passages)[rng.randrange(30) :] + prose(rng.randrange(40)) for _ in range(40)]
    return [*texts, texts[0], "z" * 700, "z" * 90, "line of junk, over and over\n" * 30, "", None, passages[0] + passages[0], prose(30) + "short", "éé" * 300]


@pytest.mark.parametrize("most_kinds", [1024, 2])
def test_repeats_are_those_of_all_windows(spark, monkeypatch, most_kinds):
    """With few kinds allowed, anchors are split by further hashes; the outcome is the same."""
    monkeypatch.setattr(suffix_dedup, "KINDS", most_kinds)
    texts = repeating_texts()
    raw = [(t or "").encode() for t in texts]
    rows = [(k, t, "c", "n") for k, t in enumerate(texts)] + [(None, texts[1], "c", "n"), (3, texts[3], "c", "n")]
    raw_all = [*raw, raw[1], raw[3]]
    cover = removed(raw_all, 120)
    cut = suffix_dedup.remove_repeats(spark.createDataFrame(rows, DOCS).withColumnRenamed("key", "kept"), length=120).collect()
    by_text = {}
    for b, c in zip(raw_all, cover, strict=True):
        by_text[b] = (bytes(x for p, x in enumerate(b) if p not in c), sum(1 for p in c if p - 1 not in c))
    assert len(cut) == len(rows) and any(len(c) for c in cover)
    for r in cut:
        b = raw[r.doc_id] if r.doc_id is not None else raw[1]
        assert (bytes(r.kept), len(r.repeat_spans), r.n_bytes) == (*by_text[b], len(b))


@pytest.mark.parametrize("most_kinds", [1024, 2])
def test_one_place_of_each_repeat_stays(spark, monkeypatch, most_kinds):
    monkeypatch.setattr(suffix_dedup, "KINDS", most_kinds)
    texts = [t for t in repeating_texts(4)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(3, texts[3])], "doc_id long, text string").withColumn("twin", F.xxhash64(F.coalesce("text", F.lit(""))))
    order = [(r.doc_id, r.twin, (r.text or "").encode()) for r in docs.distinct().orderBy("doc_id", "twin").collect()]
    seen, cover = set(), {}
    for d, _, b in order:
        cover[d] = set()
        for p in range(len(b) - 119):
            if b[p : p + 120] in seen:
                cover[d].update(range(p, p + 120))
            seen.add(b[p : p + 120])
    left = {}
    for r in suffix_dedup.remove_repeats(docs.select("doc_id", "text"), length=120, first=True).collect():
        b = (texts[r.doc_id] or "").encode()
        left[r.doc_id] = bytes(r.kept)
        assert left[r.doc_id] == bytes(x for p, x in enumerate(b) if p not in cover[r.doc_id])
    assert left[0] == (texts[0] or "").encode() and any(cover.values())


def test_batches_give_what_one_gives(spark, tmp_path):
    texts = repeating_texts(7)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    raw = [(t or "").encode() for t in texts]
    index, found = suffix_dedup.SuffixIndex(spark, str(tmp_path / "index"), 120), [set() for _ in raw]
    for lo, hi in ((0, 25), (25, 31), (31, 33), (33, 60)):
        index = suffix_dedup.SuffixIndex(spark, str(tmp_path / "index"), 120)  # opened again
        for r in index.add(docs.where(f"doc_id >= {lo} and doc_id < {hi}")).collect():
            for a, b in r.spans:
                found[r.doc_id].update(range(a, b))
        sizes = [x[3] for x in index.levels()]
        assert all(a > 2 * b for a, b in zip(sizes[:-1], sizes[1:], strict=True)) and sum(sizes) == min(hi, len(texts))
    assert found == removed(raw, 120)
    assert index.add(docs.where("doc_id < 0")).count() == 0


def test_repeats_by_characters_and_length_limits(spark):
    docs = spark.createDataFrame([(1, "é" * 200), (2, "x" + "é" * 200)], "doc_id long, text string")
    for r in suffix_dedup.remove_repeats(docs, length=101, characters=True).collect():
        bytes(r.kept).decode()
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(docs, length=10).count()


def test_suffix_family_levels_grow_geometrically():
    rng, length = random.Random(1), 80
    pieces = [bytes(rng.choice(b"ab") for _ in range(3)) * 40 for _ in range(60)] + [bytes(rng.choice(b"abc\x00\xff") for _ in range(150)) for _ in range(40)]
    pieces += [rng.choice(pieces)[rng.randrange(9) :] for _ in range(60)]
    rng.shuffle(pieces)
    for first in (False, True):
        family, told, levels, n = suffix_dedup.SuffixFamily(length, first), [], 0, 0
        for lo in range(0, len(pieces), 9):
            part = pieces[lo : lo + 9]
            size = np.array([len(p) for p in part])
            start = np.cumsum(size) - size
            count = size - length + 1
            held = suffix_dedup.Pieces(np.frombuffer(b"".join(part), np.uint8), start, np.arange(lo, lo + len(part)), np.zeros(len(part), np.int64), np.zeros(len(part), np.int64))
            at = np.concatenate([np.arange(a, a + c) for a, c in zip(start, count, strict=True)])
            for doc, _, place in family.add(held, at, np.zeros(len(at), bool)):
                told += zip(doc.tolist(), place.tolist(), strict=True)
            levels, n = max(levels, len(family.levels)), n + len(at)
            for level in family.levels:
                suffixes = [level.pieces.buf[a : a + length].tobytes() for a in level.at]
                assert all(a < b for a, b in zip(suffixes[:-1], suffixes[1:], strict=True))
        where = {}
        for d, p in enumerate(pieces):
            for k in range(len(p) - length + 1):
                where.setdefault(p[k : k + length], []).append((d, k))
        sizes = [len(x.at) for x in family.levels]
        assert levels > 1 and sum(sizes) == len(where) and all(a > 2 * b for a, b in zip(sizes[:-1], sizes[1:], strict=True))
        assert sorted(told) == sorted(x for v in where.values() if len(v) > 1 for x in v[first:])


def test_sha_of_kept(spark):
    r = suffix_dedup.remove_repeats(spark.createDataFrame([(1, "abc")], "doc_id long, text string")).select(F.sha2("kept", 256).alias("h")).first()
    assert r.h == hashlib.sha256(b"abc").hexdigest()


# --- embeddings ---------------------------------------------------------------------------------------


def test_vectors_link_as_in_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "TILE", 40)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 16))
    x = [(centres[rng.integers(6)] + rng.normal(scale=0.15, size=16)).astype(np.float32) for _ in range(150)]
    x += [x[0], x[0] * 2, x[1]]
    rows = [(k, [float(y) for y in v], int(k % 3), "z") for k, v in enumerate(x)]
    odd = [(900, None, 0, ""), (901, [0.0] * 16, 0, ""), (902, [float("nan")] * 16, 0, ""), (903, [None] + [1.0] * 15, 0, ""), (904, rows[0][1], None, ""), (905, [1.0, 2.0], 0, ""), (906, [1.0, 2.0], 0, ""), (907, [], 0, ""), (None, rows[0][1], 0, "")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int, n_links string").repartition(3)
    got = {r.vec_id: r for r in embed_dedup.near_vectors(df, threshold=0.98).collect()}
    assert len(got) == len(rows) + len(odd)
    v = np.array(x, float)
    cos = v @ v.T / np.sqrt(np.outer((v * v).sum(1), (v * v).sum(1)))
    links = [(a, b) for a in range(len(x)) for b in range(a) if a % 3 == b % 3 and cos[a, b] >= 0.98]
    want = components(range(len(x)), links)
    assert len(links) > 30
    for k in range(len(x)):
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (sum(k in p for p in links), want[k], want[k] == k)
    for k in (900, 901, 902, 903, 904, 907):
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (0, k, True)
    assert (got[905].n_links, got[906].component_id, got[906].kept) == (1, 905, False)
    assert got[None].component_id is None and not got[None].kept


def test_tiles_are_numbered_over_batches(monkeypatch):
    monkeypatch.setattr(embed_dedup, "TILE", 4)
    rng = random.Random(2)
    rows = sorted((rng.randrange(4), rng.choice([2, 3])) for _ in range(90))
    cuts = [0, 1, 5, 5, 30, 31, 70, 90]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows[a:b]], pa.int64()), pa.array([r[1] for r in rows[a:b]], pa.int32())], ["label", "dim"]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    got = [x for b in embed_dedup._tiles(iter(batches)) for x in b.column("tile").to_pylist()]
    want, last, seen, tile = [], None, 0, -1
    for r in rows:
        if r != last or seen == 4:
            last, seen, tile = r, 0, tile + 1
        seen += 1
        want.append(tile)
    assert got == want


def test_suffix_bounds_lose_no_pair():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(700, 24)), rng.normal(size=(30, 24))
    y[:10] = x[:10] + 0.01
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1].copy()
    cos = (x / np.linalg.norm(x, axis=1)[:, None]) @ (y / np.linalg.norm(y, axis=1)[:, None]).T
    for t in (0.3, 0.98):
        assert set(zip(*map(list, embed_dedup.linked_blocks(x, y, axes, t, False)), strict=True)) == set(zip(*np.nonzero(cos >= t), strict=True))


def test_columns_of_any_name_stay_when_duplicates_go(spark):
    text = "one two three four five six seven"
    rows = [(5, text, "a", 1, "x", None), (3, text + " ", "b", 2, "y", 0), (4, "other words stand here and there", "c", 3, "z", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id string, _digest int, digest string, row int")
    got = minhash_dedup.first_of_duplicates(df)
    assert got.columns == df.columns and sorted(map(tuple, got.collect())) == [rows[1], rows[2]]
