"""Source mixing, hard negatives and spelling variants against plain loops, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quire.llm import hard_negatives, mixing, spelling
from quire.llm.queries import QUERIES
from quire.llm.scratch import Scratch

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string"

# --- mixing ------------------------------------------------------------------------------------


def plain_mix(rows, weights=(5, 2, 1), most=3):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += size(text)
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, free, left = {}, set(names), sum(sizes.values())
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] >= most * sizes[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = float(most * sizes[s])
            free.discard(s)
        left -= sum(target[s] for s in over)
    out = []
    for doc_id, text, source in rows:
        rate = target[source] / sizes[source] if sizes[source] else 0
        own = hashlib.md5(f"mix:{'' if doc_id is None else doc_id}:{text or ''}".encode()).hexdigest()
        n = math.floor(rate) + (int(own[:13], 16) / 2**52 < rate - math.floor(rate))
        out.append((doc_id, size(text), sizes[source], round(target[source], 6), size(text) * n))
    return sorted(out, key=repr)


def mixed(df):
    return sorted(((r.doc_id, r["size"], r.source_size, round(r.target, 6), r["size"] * r.copies) for r in mixing.mix_counts(df).collect()), key=repr)


def some_docs(n=300, seed=3):
    rng = random.Random(seed)
    sources = ["a", "b", "B", "é", "", None, "zz", "\U0001f600", "￮"]
    rows = [(k if k % 11 else None, " ".join(["wörd", "x"][rng.randrange(2)] for _ in range(rng.randrange(40))), rng.choice(sources[: 1 + k % 9])) for k in range(n)]
    return rows + [rows[5]] * 3 + [(7, None, "only empty"), (8, " \t\n ", "only empty"), (9, "w " * 50000, "a")]


def test_mix_is_the_plain_one(spark):
    rows = some_docs()
    assert mixed(spark.createDataFrame(rows, DOCS)) == plain_mix(rows)


def test_mix_of_capped_sources_and_of_none(spark):
    # a takes 5 of 8 parts of 104 words, but has one word; what it leaves is shared until nobody is above three times its own
    rows = [(1, "one", "a"), (2, "w " * 100, "b"), (3, "x y z", "c")]
    got = mixed(spark.createDataFrame(rows, DOCS))
    assert got == plain_mix(rows) and {r[0]: r[3] for r in got} == {1: 3.0, 2: 92.0, 3: 9.0}
    assert mixing.mix_counts(spark.createDataFrame([], DOCS)).count() == 0
    assert mixed(spark.createDataFrame([(1, None, None), (2, "", None)], DOCS)) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_mix_emits_each_row_as_often_as_it_counts(spark):
    df = spark.createDataFrame([(*r, "given", 1) for r in some_docs()], DOCS + ", copy string, rate int")
    want = Counter()
    for r in mixing.mix_counts(df).collect():
        want[r.doc_id, r.source, r["size"]] += r.copies
    got = mixing.mix_documents(df)
    rows = got.collect()
    assert got.columns == ["doc_id", "text", "source", "rate", "copy"] and {r.rate for r in rows} == {1}
    count = Counter((r.doc_id, r.source, len((r.text or "").split())) for r in rows)
    assert count == Counter({k: n for k, n in want.items() if n})


def test_mix_comes_near_its_targets(spark):
    rows = [(k, "w " * (1 + k % 7), f"s{k % 4}") for k in range(20000)]
    taken, target = Counter(), {}
    for r in mixing.mix_counts(spark.createDataFrame(rows, DOCS)).collect():
        taken[r.source] += r["size"] * r.copies
        target[r.source] = r.target
    assert sum(target.values()) == pytest.approx(sum(1 + k % 7 for k in range(20000)))
    assert all(taken[s] == pytest.approx(t, rel=0.05) for s, t in target.items())


def test_mix_stays_in_the_jvm(spark, capsys):
    QUERIES["op11_source_mixing"](spark, DATA).explain()
    assert not re.search("Python|Arrow|Pandas", capsys.readouterr().out)


# --- hard negatives -----------------------------------------------------------------------------


def plain_negatives(rows, every=100, positives=5, negatives=10):
    own = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v, *_ in rows if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out, seen = [], set()
    for a, label, q in own:
        if a % every or (a, label, tuple(q)) in seen:
            continue
        seen.add((a, label, tuple(q)))
        score = [(-sum(x * y for x, y in zip(q, v, strict=True)), i, other) for i, other, v in own if i != a and len(v) == len(q)]
        for s, p, _ in sorted(x for x in score if x[2] == label)[:positives]:
            fit = sorted(x[:2] for x in score if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s)[:negatives]
            out += [(a, p, k + 1, n, -s, -t) for k, (t, n) in enumerate(fit)]
    return sorted(out)


def mined(df):
    return sorted(tuple(r) for r in hard_negatives.mine_negatives(df, "vec_id % 100 = 0").collect())


VECS = "vec_id long, label int, embedding array<float>, score string, tile int"


def vectors(n, dim, seed, labels=3, spread=0.3):
    rng = np.random.default_rng(seed)
    mid = rng.normal(size=(labels + 2, dim))
    return [(k * 20, int(k % labels), (mid[rng.integers(labels + 2)] + spread * rng.normal(size=dim)).astype(np.float32).tolist(), "x", 1) for k in range(n)]


@pytest.mark.parametrize(("n", "dim", "tile"), [(400, 8, 2048), (600, 5, 16), (300, 1, 16)])
def test_negatives_are_those_of_a_full_search(spark, monkeypatch, n, dim, tile):
    monkeypatch.setattr("quire.llm.embed_dedup.TILE", tile)
    rows = vectors(n, dim, n)
    assert mined(spark.createDataFrame(rows, VECS)) == plain_negatives(rows)


def test_negatives_of_odd_rows(spark):
    rows = vectors(120, 6, 1)
    nan, inf = float("nan"), float("inf")
    same = rows[5][2]
    rows += [(None, 1, same, "x", 1), (100000, None, same, "x", 1), (100100, 1, None, "x", 1), (100200, 1, [], "x", 1), (100300, 1, [nan] * 6, "x", 1), (100400, 2, [1.0, inf, 0.0, 0.0, 0.0, 0.0], "x", 1), (100500, 2, [1.0, None, 0.0, 0.0, 0.0, 0.0], "x", 1)]
    rows += [(100600, 0, [1.0, 2.0], "x", 1), (100700, 0, [0.0] * 6, "x", 1)] + [(k, k % 3, same, "x", 1) for k in range(200001, 200040)]  # another length, zeros, ties
    rows += [rows[7]] * 2 + [rows[0]]  # repeated rows, one of them an anchor
    assert mined(spark.createDataFrame(rows, VECS)) == plain_negatives(rows)
    assert mined(spark.createDataFrame([], VECS)) == []
    huge = [*rows[:40], (50, 1, [3e38] * 6, "x", 1)]
    assert mined(spark.createDataFrame(huge, VECS)) == plain_negatives(rows[:40])


def test_brackets_hold():
    rng = np.random.default_rng(0)
    x = np.floor(256 * rng.normal(size=(200, 7)))
    top = (x * x).sum(1).max()
    pivots = hard_negatives.farthest_first(hard_negatives.augmented(x, top), 5)
    d, q = hard_negatives.distances(hard_negatives.augmented(x, top), pivots), hard_negatives.distances(np.pad(x, ((0, 0), (0, 1))), pivots)
    true = np.sqrt((x * x).sum(1)[:, None] + top - 2 * x @ x.T)
    assert (np.abs(q[:, None] - d).max(2) <= true + 1e-3).all() and ((q[:, None] + d).min(2) >= true - 1e-3).all()


# --- spelling -----------------------------------------------------------------------------------


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_groups(rows):
    upper = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(upper)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = defaultdict(set)
    by_less = defaultdict(set)
    for w in words:
        for k in range(len(w)):
            by_less[w[:k] + w[k + 1 :]].add(w)
    for x, own in by_less.items():
        for a in own | ({x} & words.keys()):
            near[a] |= {b for b in own | ({x} & words.keys()) if one_edit(a, b)}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda b: (-words[b], b), default=None)
        form[w] = best if best and words[best] >= 2 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n, len(near[w]), form[w], words[form[w]] if form[w] else None, root))
    return sorted(out)


def grouped(df):
    return sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.spelling_groups(df, slips=97).collect())


def test_groups_are_those_of_all_words(spark):
    """The query on its whole table."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in QUERIES["op13_spelling_variants"](spark, DATA).collect())
    assert got == plain_groups(rows) and any(r[3] for r in got)


@pytest.mark.parametrize("most", [64, 3])
def test_near_words_with_hot_segments(spark, monkeypatch, most):
    """Short alphabets make segments that many words share; with 3 words a key most of them are split."""
    monkeypatch.setattr(spelling, "MOST", most)
    rng = random.Random(most)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randrange(1, 9))) for _ in range(1500)} | {"a" * 40, "a" * 41, "a" * 20 + "b" + "a" * 20})
    df = spark.createDataFrame([(w, k, len(w)) for k, w in enumerate(words)], "word string, n long, l int")
    got = spelling.near_words(Scratch(spark, "test"), df).collect()
    assert len(got) == len({frozenset((r.word, r.other)) for r in got})
    assert {frozenset((r.word, r.other)) for r in got} == {frozenset((a, b)) for a in words for b in words if a < b and one_edit(a, b)}
    assert all(words[r.n] == r.word and words[r.other_n] == r.other for r in got)


def test_words_of_odd_texts(spark):
    rows = [(k, "Straße straßen STRASSE naïve naive nave word-word Ünder ünder under", "x") for k in range(60)]
    rows += [(None, "naive naive", None), (3, None, "x"), (4, "", "x"), (5, "abc", "x"), (6, "x" * 100000 + " " + "lang" * 500, "x"), (6, "lang" * 500 + " naive×naïve", "x"), (6, "lang" * 500, "x")] + [(7, "under wonder", "x")] * 500
    df = spark.createDataFrame(rows, "doc_id long, text string, word string")
    assert grouped(df) == plain_groups(rows)
    assert grouped(spark.createDataFrame([], "doc_id long, text string")) == []


def test_roots_of_long_chains(spark):
    links = [(f"w{k}", f"w{k + 1}") for k in range(40)] + [("v", "w3")]
    got = {r.word: r.root for r in spelling.roots(Scratch(spark, "test"), spark.createDataFrame(links, "word string, form string")).collect()}
    assert set(got.values()) == {"w40"} and len(got) == 41
