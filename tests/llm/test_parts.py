from __future__ import annotations

import numpy as np
import pyarrow as pa

from tests.llm import cases
from trackweave.llm import ranges, store, tally
from trackweave.llm import text as tx


def test_parts_count_the_cuts_below(spark):
    ids = [None, -5, 0, 3, 3, 7, 8, 100, 2**40]
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    for bounds in ([], [3], [0, 3, 8], list(range(-3, 60, 2))):
        got = {r.doc_id: r.p for r in df.select("doc_id", ranges.part_of("doc_id", bounds).alias("p")).collect()}
        assert all(got[i] == (0 if i is None else int(np.searchsorted(bounds, i, side="right"))) for i in ids)


def test_cuts_split_evenly(spark):
    bounds = ranges.cuts(spark.range(10_000).withColumnRenamed("id", "doc_id"), "doc_id", 8)
    assert len(bounds) == 7 and bounds == sorted(bounds)
    assert max(np.diff([0, *bounds, 10_000])) < 1_400
    assert ranges.cuts(spark.range(0).withColumnRenamed("id", "doc_id"), "doc_id", 8) == []


def test_bit_sets_hold_every_member(spark):
    keys = spark.range(500).selectExpr("xxhash64(id) AS key")
    bits = np.unpackbits(tally.members(keys, "key", 1 << 12))
    assert all(bits[r.key & ((1 << 12) - 1)] for r in keys.collect()) and bits.sum() <= 500


def test_tables_are_read_back_and_dropped(spark):
    df = store.written(spark.range(10), "numbers", few=True)
    assert df.count() == 10
    store.drop(df)
    try:
        assert df.count() != 10
    except Exception as e:  # noqa: BLE001
        assert "FILE" in str(e).upper()


def test_hashes_depend_on_content_alone():
    texts = ["one two three four five six", "zero one two three four five six", " ONE\ttwo  three four five six\n", "", None, "é one"]
    data, offsets = tx.flat(pa.array(texts))
    h, at = tx.shingles(data, offsets, 5)
    lists = [h[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
    assert lists[0] == lists[2] == lists[1][1:] and lists[3] == lists[4] == [] and len(lists[5]) == 1
    sliced = pa.array(texts).slice(1, 2)
    data, offsets = tx.flat(sliced)
    h2, at2 = tx.shingles(data, offsets, 5)
    assert h2[at2[0] : at2[1]].tolist() == lists[1]


def test_words_are_the_contracts_words():
    texts = [r[1] for r in cases.odd_rows()]
    data, offsets = tx.flat(pa.array(texts, pa.string()))
    _, _, counts = tx.words(data, offsets)
    assert counts.tolist() == [len(cases.words(t)) for t in texts]
    for i, j in tx.pieces(offsets, 100):
        assert j > i and (j == i + 1 or offsets[j] - offsets[i] <= 100)


def test_spans_are_told_apart_by_their_bytes():
    data = np.frombuffer(b"abcdefghij" * 80 + b"abcdefghiX", np.uint8)
    lanes = tx.eights(data)
    start, size = np.array([0, 0, 0, 0, 5, 0, 0]), np.array([9, 10, 10, 800, 700, 700, 0])
    other, other_size = np.array([10, 800, 790, 0, 15, 110, 40]), np.array([9, 10, 10, 800, 700, 700, 0])
    wanted = [bytes(data[i : i + n]) == bytes(data[j : j + m]) for i, n, j, m in zip(start, size, other, other_size, strict=True)]
    assert tx.same_spans(lanes, start, size, lanes, other, other_size).tolist() == wanted
    h = tx.word_numbers(data, start, start + size)
    assert (h[[0, 3]] == tx.word_numbers(data, other, other + other_size)[[0, 3]]).all()


def long_texts() -> list[str]:
    """Two near copies above a batch's bytes, and a passage of them."""
    words = [f"w{i * 7919 % 100_003}" for i in range(230_000)]
    one = " ".join(words)
    other = " ".join([*words[:100_000], "put", "in", *words[100_000:]])
    assert min(len(one), len(other)) > tx.BATCH_BYTES
    return [one, "short words here", other, "z" * 60 + " " + " ".join(words[500:560]), ""]


def test_texts_above_a_batch_as_a_whole():
    from trackweave.llm import fingerprints, ngram_join, quality, tokens

    texts = long_texts()
    column = pa.array(texts)
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        e = tokens.Encoder(tokens.path(name))
        ids, at = e.encode(column)
        assert [ids[i:j].tolist() for i, j in zip(at[:-1], at[1:], strict=True)] == e.whole(texts)
    plain = [cases.shingle_set(t, 5) for t in texts]
    numbers = tx.exact_shingles(column, 5)
    assert [len(x) for x in numbers] == [len(p) for p in plain] == [len(x) for x in ngram_join.sets_of(column, 5)]
    assert len(np.intersect1d(numbers[0], numbers[2])) == len(plain[0] & plain[2])
    a, b = fingerprints.sketches(column)[0], fingerprints.sketches(column)[2]
    assert len(a) == 128 and abs(fingerprints.resemblance(a, b) - len(plain[0] & plain[2]) / len(plain[0] | plain[2])) < 0.1
    assert np.isfinite(quality.features(column)).all()
    assert np.allclose(quality.features(column), np.concatenate([quality.features(pa.array([t])) for t in texts]))


def test_long_texts_through_the_tables(spark):
    from tests.llm.test_suffix_dedup import brute, digest
    from trackweave.llm import mixing, ngram_join, packing, suffix_dedup, tokens

    texts = long_texts()
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    links = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs).collect()}
    assert links == {i: (len(cases.shingle_set(t, 4)), 0 if i == 2 else i) for i, t in enumerate(texts)}
    raw = [t.encode() for t in texts]
    found = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digests(docs).collect())
    assert found == [(i, *digest(r, g)) for i, (r, g) in enumerate(zip(raw, brute(raw), strict=True))]
    pieces = packing.pack(packing.pieces(docs, tokens.path("byte_bpe_50k.json"))).groupBy("doc_id").agg({"length": "sum"}).collect()
    whole = tokens.Encoder(tokens.path("byte_bpe_50k.json")).whole(texts)
    assert {r[0]: r[1] for r in pieces} == {i: len(w) + 1 for i, w in enumerate(whole)}
    assert {r.doc_id: r["size"] for r in mixing.planned(docs).collect()} == {i: len(cases.words(t)) for i, t in enumerate(texts)}
