from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import cases
from tests.llm.test_pairs import brute_components
from tests.llm.test_packing_mixing_files import check_packed
from tests.llm.test_suffix_dedup import brute
from trackweave.llm import ngram_join, quality, queries, suffix_dedup, url_filter

SF = "/root/testdata/sf0.01"


# -- quality


def test_trees_learn_a_rule():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 5))
    y = ((x[:, 1] > 0.6) ^ (x[:, 3] > 0.5)).astype(float)
    forest = quality.train(x[:3000], y[:3000])
    assert ((forest.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.97
    node_scores = [_walk(forest, row) for row in x[:20]]
    assert np.allclose(forest.score(x[:20]), node_scores)


def _walk(forest, row):
    total = forest.prior
    for node in forest.start:
        while forest.left[node] != node:
            node = forest.left[node] if row[forest.feature[node]] <= forest.threshold[node] else forest.right[node]
        total += forest.value[node]
    return 1 / (1 + np.exp(-total))


def plain_train(x, y, trees, depth, bins, rate):
    """Scores of the training rows by trees grown one node at a time, every split tried by its definition."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    total = np.full(len(y), np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        worth = lambda rows: g[rows].sum() ** 2 / (h[rows].sum() + 1)  # noqa: B023, E731

        def grow(rows, left):
            best = (1e-6, None, None)
            for f in range(x.shape[1]) if left else ():
                for e in edges[f]:
                    a, b = rows[x[rows, f] <= e], rows[x[rows, f] > e]
                    if h[a].sum() >= 1 and h[b].sum() >= 1 and worth(a) + worth(b) - worth(rows) > best[0] + 1e-9:  # noqa: B023
                        best = (worth(a) + worth(b) - worth(rows), a, b)  # noqa: B023
            if best[1] is None:
                total[rows] += g[rows].sum() / (h[rows].sum() + 1) * rate  # noqa: B023
                return
            grow(best[1], left - 1)
            grow(best[2], left - 1)

        grow(np.arange(len(y)), depth)
    return 1 / (1 + np.exp(-total))


def test_trees_against_plain_ones():
    rng = np.random.default_rng(4)
    x = np.column_stack((rng.random((300, 3)), rng.integers(0, 4, 300), np.ones(300)))
    y = ((x[:, 0] + x[:, 3] / 4 + rng.random(300) * 0.3) > 0.9).astype(float)
    forest = quality.train(x, y, trees=6, depth=3, bins=8)
    assert np.allclose(forest.score(x), plain_train(x, y, 6, 3, 8, quality.RATE))
    assert np.allclose(forest.score(x), [_walk(forest, row) for row in x])


def test_sample_bounds_what_the_driver_gets(spark, monkeypatch):
    docs = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    got = []
    monkeypatch.setattr(quality, "train", lambda x, y: got.append((len(x), len(y))))
    quality.fit(docs, labels, sample=100)
    assert got == [(100, 100)]


def test_features_are_of_each_text_alone():
    texts = [r[1] for r in cases.odd_rows()]
    together = quality.features(pa.array(texts, pa.string()))
    alone = np.concatenate([quality.features(pa.array([t], pa.string())) for t in texts])
    assert np.allclose(together, alone) and np.isfinite(together).all()
    f = dict(zip(quality.FEATURES, quality.features(pa.array(["One two\nTWO 2 two!"]))[0], strict=True))
    assert f["log_words"] == pytest.approx(np.log1p(5)) and f["distinct_words"] == pytest.approx(4 / 5)
    assert f["max_word"] == 4 and f["bang"] == pytest.approx(1 / 5) and f["distinct_lines"] == 1


def test_op5_on_held_out_rows(spark):
    rows = {r.doc_id: r for r in queries.op5_quality(spark, SF).collect()}
    import zlib

    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows.values())
    labels = [(r.quality, rows[r.doc_id].score) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.doc_id in rows and rows[r.doc_id].held_out]
    good, bad = ([s for q, s in labels if q == k] for k in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.95
    assert sum((s >= 0.7) == q for q, s in labels) >= 0.95 * len(labels)


def test_quality_takes_odd_tables(spark):
    every = cases.tables(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(1, 1, 0), (6, 0, 0), (12, 1, 0), (None, 1, 0), (8, None, 0)], "doc_id long, quality int, toxic int")
    for labels in (none, odd):
        forest = quality.fit(every["odd"], labels)
        rows = quality.scored(every["odd"].withColumn("score", F.lit("clash")).withColumn("a.b", F.lit(1)), forest).collect()
        assert len(rows) == len(cases.odd_rows()) and all(0 <= r.score <= 1 for r in rows)
        assert quality.scored(every["empty"], forest).count() == 0


# -- URL filters


def test_rules_and_parts(spark):
    urls = {
        "https://A.Example.COM/en/7x?q#f": ("a.example.com", "/en/7x", "example.com/en/7", "allow"),
        "http://example.com/en/8": ("example.com", "/en/8", "com/en/", "block"),
        "http://notexample.com/en/7": ("notexample.com", "/en/7", "com/en/", "block"),
        "http://x.net/de/81": ("x.net", "/de/81", "net/de/", "allow"),
        "http://www.example.net/de/81": ("www.example.net", "/de/81", "example.net/de/8", "block"),
        "http://net": ("net", "", None, None),
        "http://a.org?x=/es/": ("a.org", "", None, None),
        "ftp://org/es/": ("org", "/es/", "org/es/", "block"),
        "no scheme": ("", "", None, None),
        "x://y://z/w": ("y:", "//z/w", None, None),
        None: ("", "", None, None),
    }
    pages = spark.createDataFrame([(i, u, "extra") for i, u in enumerate(urls)], "page_id long, url string, host string")
    rows = {r.page_id: r for r in url_filter.judge(pages, None).collect()}
    for i, (host, path, rule, verdict) in enumerate(urls.values()):
        assert (rows[i].host, rows[i].path, rows[i].rule, rows[i].verdict) == (host, path, rule, verdict or "allow")
    assert url_filter.judge(pages.limit(0), None).count() == 0


def test_templates_merge_and_reject(spark):
    pages, labels = [], []
    for i in range(400):
        pages.append((i, f"http://mixed.test/{'bad' if i % 4 == 0 else ('fr', 'en', 'de')[i % 3]}/{i}.html"))
        labels.append((i, int(i % 4 != 0 or i % 40 == 0), 0))
    for i in range(400, 600):
        pages.append((i, f"http://farm.test/s{i}-slug/{i}"))
        labels.append((i, 0, 0))
    pages.append((601, "http://mixed.test/bad/99999"))
    pages.append((602, "http://new.test/99999"))
    p = spark.createDataFrame(pages, "page_id long, url string")
    found = {r.page_id: r for r in url_filter.judge(p, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rules=()).collect()}
    assert found[0].verdict == "block" and found[0].template == "/bad/{n}.html"
    assert found[1].template == found[2].template == found[3].template == "/*/{n}.html" and found[1].verdict == "allow"
    assert found[450].verdict == "block" and found[450].template == "/*/{n}"
    assert found[602].verdict == "allow"


def test_templates_go_as_deep_as_paths(spark):
    kinds = {i: "spam" if i < 80 else "news" for i in range(200)}
    pages = spark.createDataFrame([(i, f"http://deep.test/a/b/c/{k}/d/slug-{i}") for i, k in kinds.items()], "page_id long, url string")
    labels = spark.createDataFrame([(i, int(k == "news"), 0) for i, k in kinds.items()], "doc_id long, quality int, toxic int")
    found = {r.page_id: (r.template, r.verdict) for r in url_filter.judge(pages, labels, rules=()).collect()}
    assert found == {i: (f"/a/b/c/{k}/d/*", "block" if k == "spam" else "allow") for i, k in kinds.items()}


@pytest.mark.parametrize("copies", [1, 6])
def test_variable_segments_keep_bad_branches(spark, copies):
    section = {i: i % 60 for i in range(360)}
    pages = spark.createDataFrame([(i, f"http://many.test/s{k}x/{i}") for i, k in section.items()] * copies, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(k >= 10), 0) for i, k in section.items()], "doc_id long, quality int, toxic int")
    found = {r.page_id: (r.template, r.verdict) for r in url_filter.judge(pages, labels, rules=()).collect()}
    for i, k in section.items():
        assert found[i] == ((f"/s{k}x/{{n}}", "block") if k < 10 else ("/*/{n}", "allow"))


def test_more_urls_of_every_child_change_no_verdict(spark):
    labels = spark.createDataFrame([(i, int(i % 60 >= 10), 0) for i in range(1140)], "doc_id long, quality int, toxic int")
    found = []
    for more in (1, 30):
        # 60 children of 19 urls that carry labels, and so many times as many distinct ones in all
        pages = [(i, f"http://many.test/s{i % 60}x/{'a' * k}{i}") for i in range(1140) for k in range(1 if more == 1 else 2)]
        pages += [(i, f"http://many.test/s{i % 60}x/{'b' * k}-{i}-") for i in range(1140) for k in range(1, more)]
        rows = url_filter.judge(spark.createDataFrame([(n, u) for n, (_, u) in enumerate(pages)], "page_id long, url string"), labels, rules=()).collect()
        found.append({pages[r.page_id][0] % 60: r.verdict for r in rows if pages[r.page_id][1].endswith(f"/{pages[r.page_id][0]}")})
    assert found[0] == found[1] == {k: "block" if k < 10 else "allow" for k in range(60)}


def test_deep_paths_cost_few_rounds(spark, monkeypatch):
    rounds = []
    branched = url_filter._branched
    monkeypatch.setattr(url_filter, "_branched", lambda rows: (rounds.append(1), branched(rows))[1])
    deep = "/".join(f"l{k}" for k in range(2000))
    pages = [(0, f"http://deep.test/{deep}"), (1, f"http://two.test/{deep}/x"), (2, f"http://two.test/{deep}/y/z"), (3, f"http://two.test/{deep}")]
    rows = {r.page_id: r.template for r in url_filter.judge(spark.createDataFrame(pages, "page_id long, url string"), None, rules=()).collect()}
    assert rows[0] == f"/{deep}" and rows[1] == f"/{deep}/*new" and rows[2] == f"/{deep}/*new/z" and rows[3] == f"/{deep}"
    assert len(rounds) < 5


def by_sql(spark, pages, labels):
    import duckdb

    con = duckdb.connect()
    for name, df in (("pages", pages), ("labels", labels)):
        own = df.toPandas()  # noqa: F841
        con.execute(f"create table {name} as select * from own")
    found = con.execute(queries.ORACLES["op3_url_filters"])
    names = [c[0] for c in found.description]
    return {r[names.index("page_id")]: tuple(r[names.index(c)] for c in ("host", "path", "rule", "verdict", "template", "purity")) for r in found.fetchall()}


def test_trees_against_sql(spark):
    import random

    rnd = random.Random(8)
    hosts = ["a.test", "b.example.com", "net", "www.Example.NET", "c.org"]
    pages = []
    for i in range(3000):
        parts = rnd.choices(["en", "de", "7up", "81", "news", "spam", f"s{rnd.randrange(200)}", f"{rnd.randrange(16**9):09x}", f"{rnd.randrange(9999)}.html", "x-y"], k=rnd.randrange(0, 7))
        pages.append((i, rnd.choice(["http://", "HTTPS://", ""]) + "/".join([rnd.choice(hosts), *parts, str(rnd.randrange(3000))]) + rnd.choice(["", "?q=/de/", "#f"])))
    pages += [(4000, None), (4001, ""), (4002, "http://" + "/".join(["deep.test", *(f"l{k}" for k in range(30))])), (4003, "http://a.test/" + "x" * 50_000), (4004, pages[0][1]), (4005, "http://a.test//")]
    # topics without labels in a host that has both kinds
    pages += [(5000 + i, f"http://mixed.test/{'good' if i < 200 else 'bad' if i < 500 else f't{i % 10}'}/{5000 + i}") for i in range(800)]
    labels = [(i, int("spam" not in (pages[i][1] or "")), 0) for i in range(0, 3000, 2)] + [(5000 + i, int(i < 200), 0) for i in range(500)] + [(None, 1, 0), (7, None, 0)]
    p, n = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict, r.template, r.purity) for r in url_filter.judge(p, n).withColumn("purity", F.round("purity", 6)).collect()}
    assert len(found) == len(pages) and found == by_sql(spark, p, n)
    assert {found[5000 + i][3] for i in range(500, 800)} == {"block"} and found[5600][4] == "/*new/{n}"
    assert found[5000][3] == "allow" and found[4002][4].count("/") == 30


def test_op3_takes_every_page(spark):
    rows = queries.op3_url_filters(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/pages.parquet").count()
    assert {r.verdict for r in rows} <= {"allow", "block"}


# -- the pipeline


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{cases.SF}/documents.parquet")
    columns = docs.columns
    start = {r.doc_id: r.text for r in docs.collect()}
    stage = dict(corpus_pipeline.STAGES)

    good = stage["quality classifier"](spark, docs, cases.SF)
    assert good.columns == columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{cases.SF}/labels.parquet").collect()}
    kept = {r.doc_id: r.text for r in good.collect()}
    assert all(start[i] == t for i, t in kept.items())
    assert sum((i in kept) == q for i, q in labels.items()) >= 0.95 * len(labels)

    one = stage["n-gram Jaccard join"](spark, good, cases.SF)
    assert one.columns == columns
    groups = {c for _, _, c in brute_components(list(kept.items()), 5, 80, 100)}
    single = {r.doc_id: r.text for r in one.collect()}
    assert {str(i) for i in single} == groups

    cut = stage["suffix-array dedup"](spark, one, cases.SF)
    assert cut.columns == columns
    order = sorted(single)
    raw = [(single[i] or "").encode() for i in order]
    wanted = {}
    for i, r, gone in zip(order, raw, brute(raw), strict=True):
        edges = np.flatnonzero(np.diff(gone.astype(int), prepend=0, append=0)).tolist()
        text = suffix_dedup.without(r, suffix_dedup.whole_characters(r, list(zip(edges[::2], edges[1::2], strict=True)))).decode()
        if text == single[i] or cases.words(text):
            wanted[i] = text
    short = {r.doc_id: (r.text, r.n_chars) for r in cut.collect()}
    assert short == {i: (t, len(t)) for i, t in wanted.items()}

    mixed = stage["mixing sources to target weights"](spark, cut, cases.SF)
    assert mixed.columns == columns
    rows = mixed.collect()
    assert all(wanted[r.doc_id] == r.text for r in rows)
    total, taken = (sum(len(cases.words(t)) for t in x) for x in (wanted.values(), [r.text for r in rows]))
    assert 0.97 * total <= taken <= total

    packed = stage["best-fit packing"](spark, mixed.dropDuplicates(["doc_id"]), cases.SF).collect()
    check_packed(packed, {r.doc_id: r.text for r in rows})


def test_run_gives_packed_pieces(spark):
    rows = queries.QUERIES["pipeline"](spark, cases.SF)
    assert {"doc_id", "piece", "start", "length", "sequence_id", "offset"} <= set(rows.columns) and rows.count() > 0


def test_stages_take_odd_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, docs in cases.tables(spark).items():
        extra = docs.withColumn("score", F.lit("clash")).withColumn("component", F.lit("clash"))
        for step, stage in corpus_pipeline.STAGES:
            out = stage(spark, extra, str(tmp_path))
            n = out.count()
            assert n == 0 if name == "empty" else n > 0, step
    odd = spark.createDataFrame(cases.odd_rows(), cases.DOCS)
    one = ngram_join.one_of_each(odd, 5, 80, 100).collect()
    assert sorted(r.doc_id for r in one if r.doc_id in (1, 2, 3, 4, 5, 14, 15)) == [1, 3, 4, 5, 14, 15, 15]
