from __future__ import annotations

import itertools
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from trackweave.llm import components, embedding_dedup, ngram_join, queries


def roots(nodes, links):
    up = {x: x for x in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


# -- components


def test_components_against_union_find(spark):
    rnd = random.Random(3)
    links = [(rnd.randrange(600), rnd.randrange(600)) for _ in range(330)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(2001, 2100)] + [(5000, 5000), (-7, 4), (-7, 4)]
    rows = components.components(spark.createDataFrame([*links, (None, 3)], "a long, b long")).collect()
    assert {r.node: r.component for r in rows} == roots({x for p in links for x in p}, links)
    assert len(rows) == len({x for p in links for x in p})


# -- n-gram Jaccard join


def brute_components(docs, words, num, den):
    sets = [(i, cases.shingle_set(t, words)) for i, t in docs]
    links = []
    lists = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for x in s:
            lists[x].append(k)
    seen = {(a, b) for own in lists.values() for a, b in itertools.combinations(own, 2)}
    for a, b in seen:
        x, y = sets[a][1], sets[b][1]
        if den * len(x & y) >= num * len(x | y):
            links.append((a, b))
    root = roots(range(len(sets)), links)
    least = {}
    for k, r in root.items():
        if sets[k][0] is not None:
            least[r] = min(least.get(r, sets[k][0]), sets[k][0])
    return sorted((str(sets[k][0]), len(sets[k][1]), str(least.get(root[k]))) for k in range(len(sets)))


def got(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in df.collect())


def test_op2_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{cases.SF}/documents.parquet").collect()]
    assert got(queries.op2_ngram_join(spark, cases.SF)) == brute_components(docs, 4, 85, 100)


def edits(rnd, words, share):
    out = []
    for w in words:
        x = rnd.random()
        if x < share / 3:
            continue
        out.append(f"new{rnd.randrange(10**6)}" if x < 2 * share / 3 else w)
        if x > 1 - share / 3:
            out.append(f"put{rnd.randrange(10**6)}")
    return out


@pytest.mark.parametrize(("words", "num", "den"), [(4, 85, 100), (5, 80, 100), (1, 85, 100)])
def test_links_at_the_threshold(spark, monkeypatch, words, num, den):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "SCAN_ROWS", 40)
    monkeypatch.setattr(ngram_join, "TOGETHER", 2)
    monkeypatch.setattr(ngram_join, "LOOSE", 1)
    monkeypatch.setattr(ngram_join, "HELD_PAIRS", 30)
    rnd = random.Random(words)
    texts = []
    passage = [f"p{i}" for i in range(60)]
    for base in range(12):
        size = rnd.choice([3, 5, 8, 9, 12, 15, 17, 20, 40, 150, 600])
        own = [f"w{base}x{i}" for i in range(size)]
        for _ in range(rnd.choice([1, 4, 25])):
            texts.append(" ".join(edits(rnd, own, rnd.choice([0, 0.01, 0.02, 0.04]))))
    for k in range(30):
        own = [f"u{k}x{i}" for i in range(20)]
        texts.append(" ".join(own[:10] + passage + own[10:]))
    docs = list(enumerate(texts)) + [(r[0] + 1000 if r[0] else r[0], r[1]) for r in cases.odd_rows()]
    rnd.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("key", F.lit("clash")).repartition(3)
    wanted = brute_components(docs, words, num, den)
    for shows, small in ((0, 48), (1, 3)):
        # half the lists are dealt in parts in the second round
        monkeypatch.setattr(ngram_join, "HOT_LIST", 4 if shows else 50_000)
        monkeypatch.setattr(ngram_join, "SALTS", 3)
        monkeypatch.setattr(ngram_join, "SHOWS", shows)
        monkeypatch.setattr(ngram_join, "SMALL", small)
        assert got(ngram_join.jaccard_components(df, words, num, den)) == wanted


@pytest.mark.parametrize("n", [1024, 4096])
def test_sets_of_words_built_to_collide(spark, n):
    a, b = cases.complements(n)
    docs = [(1, a), (2, b), (3, f"{a} x y z {b}"), (4, f"{b} x y z {a}"), (5, b)]
    assert got(ngram_join.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1))) == brute_components(docs, 4, 85, 100)


@pytest.mark.parametrize("blind", [False, True])
def test_pairs_are_compared_by_their_words(monkeypatch, blind):
    import pyarrow as pa

    from trackweave.llm import text as tx

    if blind:
        monkeypatch.setattr(tx, "word_numbers", lambda data, start, end, fold=False: (end - start).astype(np.uint64))
    rnd = random.Random(2)
    texts = [" ".join(rnd.choices(["ab", "AB", "ba", "c", "cc", "é", "x" * 300, "y" * 300], k=rnd.randint(0, 30))) for _ in range(60)] + [None, *(r[1] for r in cases.odd_rows())]
    for n in (1, 4, 5):
        numbers = tx.exact_shingles(pa.array(texts, pa.string()), n)
        plain = [cases.shingle_set(t, n) for t in texts]
        for x, p in zip(numbers, plain, strict=True):
            assert len(x) == len(p)
            assert all(len(np.intersect1d(x, y)) == len(p & q) for y, q in zip(numbers, plain, strict=True))


def test_tables_too_large_to_broadcast_give_the_same(spark, monkeypatch):
    from trackweave.llm import packing, sharding, url_filter

    rnd = random.Random(9)
    passage = [f"p{i}" for i in range(40)]
    docs = [(k, " ".join(edits(rnd, passage, 0.03))) for k in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    near = spark.createDataFrame(vectors()[:200], "vec_id long, embedding array<float>")
    pages = spark.createDataFrame([(i, f"http://h{i % 3}.test/{'a' if i % 2 else 'b'}/{i}") for i in range(60)], "page_id long, url string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    items = spark.range(0, 3000, 1, 8).select("id", F.when(F.col("id") % 300 == 0, 300).otherwise(600).alias("length"))
    answers = [
        lambda: got(ngram_join.jaccard_components(df)),
        lambda: sorted(embedding_dedup.near_duplicates(near).collect(), key=str),
        lambda: sorted(url_filter.judge(pages, labels).collect(), key=str),
        lambda: sorted(sharding.two_pass_shuffle(df, "doc_id", F.octet_length("text"), shards=3, bucket_bytes=500).select("doc_id", "shard", "slot").collect()),
        lambda: packing.pack(items).select("sequence_id").distinct().count(),
    ]
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 7)
    before = [f() for f in answers]
    for module, name in ((ngram_join, "BROADCAST_GROUPS"), (embedding_dedup, "BROADCAST_BUCKETS"), (url_filter, "BROADCAST_BYTES"), (sharding, "BROADCAST_BUCKETS"), (packing, "BROADCAST_BINS")):
        monkeypatch.setattr(module, name, 0)
    assert [f() for f in answers] == before


def test_empty_join(spark):
    assert ngram_join.jaccard_components(cases.tables(spark)["empty"]).count() == 0


def test_boundary_follows_the_sizes():
    assert ngram_join.boundary({}) >= 0
    assert 6 <= ngram_join.boundary({n: 10 for n in range(1, 60)}) <= 20
    assert ngram_join.subsets(6) == 1 and ngram_join.subsets(7) == 8


def test_bitmaps_never_lose_a_link():
    rng = np.random.default_rng(0)
    for _ in range(300):
        x = np.unique(rng.integers(0, 2**64, rng.integers(1, 3000), dtype=np.uint64))
        y = np.unique(np.concatenate((x[rng.random(len(x)) > rng.random() * 0.2], rng.integers(0, 2**64, rng.integers(1, 200), dtype=np.uint64))))
        a, b = ngram_join.bitmap(x), ngram_join.bitmap(y)
        size = 8 * min(len(a), len(b))
        differing = int(np.bitwise_count(ngram_join.folded(a, size) ^ ngram_join.folded(b, size)).sum())
        assert differing <= len(np.setxor1d(x, y))


def test_subsets_of_equal_numbers_stay_apart(spark):
    """With six bits most subsets share their numbers; what links is decided by the words."""
    rnd = random.Random(11)
    docs = [(i, " ".join(f"w{rnd.randrange(10**6)}" for _ in range(11))) for i in range(200)]
    near = [(1000 + i, docs[i][1] + f" w{i}") for i in range(30)] + [(2000 + i, f"v{i} " + docs[i][1]) for i in range(10)]
    both = docs + near
    frame = spark.createDataFrame(both, "doc_id long, text string").repartition(5)
    for words, num, den in ((4, 80, 100),):
        wanted = brute_components(both, words, num, den)
        assert 200 <= len({c for _, _, c in wanted}) < len(both)
        assert got(ngram_join.jaccard_components(frame, words, num, den)) == wanted
        assert got(ngram_join.jaccard_components(frame, words, num, den, subset_bits=6)) == wanted


# -- embeddings


def brute_links(rows, cosine):
    usable = [(k, np.array(v, float)) for k, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = [(a, b) for (a, x), (b, y) in itertools.combinations(usable, 2) if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine]
    return links


def vectors(seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.standard_normal(16).astype(np.float32).tolist()) for i in range(150)]
    for c in range(6):
        centre = rng.standard_normal(16)
        rows += [(200 + 40 * c + i, (centre + rng.standard_normal(16) * 0.08).astype(np.float32).tolist()) for i in range(30)]
    rows += [(900 + i, rows[0][1]) for i in range(5)] + [(910, [2 * x for x in rows[1][1]])]
    rows += [(920, None), (921, []), (922, [0.0] * 16), (923, [float("nan")] * 16), (924, [None] + [1.0] * 15), (925, [float("inf")] * 16), (926, [1.0] * 4), (927, [1.0] * 4), (None, rows[2][1]), (928, rows[2][1]), (928, rows[2][1])]
    return rows


def test_links_within_recall(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 7)
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("data", F.lit("clash"))
    out = embedding_dedup.near_duplicates(df).collect()
    assert len(out) == len(rows)
    links = brute_links(rows, 0.95)
    want = defaultdict(int)
    for a, b in links:
        want[rows[a][0]] += 1
        want[rows[b][0]] += 1
    have = defaultdict(int)
    for r in out:
        have[r.vec_id] = max(have[r.vec_id], r.n_links)
        assert r.kept == (r.vec_id == r.component_id)
    for i in (920, 921, 922, 923, 924, 925):
        assert have[i] == 0
    assert have[926] == have[927] == 1 and have[900] == 5 and have[910] == 1
    ids = [i for i, _ in rows if i is not None and i != 928]
    assert all(have[i] <= want[i] for i in ids)
    assert sum(have[i] for i in ids) >= 0.9 * sum(want[i] for i in ids)
    root = roots(range(len(rows)), links)
    by_id = {rows[k][0]: rows[root[k]][0] for k in range(len(rows))}
    inside = [r for r in out if r.vec_id is not None]
    assert sum(r.component_id == min(rows[k][0] for k in range(len(rows)) if root[k] == root[j] and rows[k][0] is not None) for j, r in ((next(j for j in range(len(rows)) if rows[j][0] == r.vec_id), r) for r in inside)) >= 0.97 * len(inside)
    assert by_id[0] == 0


def test_op4_recall_on_the_test_table(spark):
    out = {r.vec_id: r for r in queries.op4_embedding_dedup(spark, "/root/testdata/sf0.01").collect()}
    rows = [(r.vec_id, list(r.embedding) if r.embedding is not None else None) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    links = brute_links(rows, 0.95)
    assert set(out) == {i for i, _ in rows}
    assert sum(r.n_links for r in out.values()) >= 0.9 * 2 * len(links)
    assert sum(r.n_links for r in out.values()) <= 2 * len(links)


def test_no_vectors(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_plan_grows_slowly():
    assert embedding_dedup.plan(0)[0] >= 1 and embedding_dedup.plan(10**9)[1] <= 45
    small, large = embedding_dedup.plan(10_000), embedding_dedup.plan(10_000_000)
    assert small[0] < large[0] <= small[0] + 10
