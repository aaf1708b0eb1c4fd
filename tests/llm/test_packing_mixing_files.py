from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from trackweave.llm import fingerprints, mixing, packing, queries, sharding, store, token_files, tokens
from trackweave.llm import text as tx


def tokenizer(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.path(name))
    t.encode_special_tokens = True
    return t


def documents(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{cases.SF}/documents.parquet").collect()}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# -- tokens


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_units_give_the_librarys_ids(name):
    import random

    rnd = random.Random(5)
    alphabet = [*"ab1 '\n\t,.!é—ñsŚ\u00a0\u2009\u3000\u0301 ", "'s", "'ll", "  ", "\r\n", "\x1c"]
    texts = ["".join(rnd.choices(alphabet, k=rnd.randint(0, 25))) for _ in range(4000)] + [r[1] for r in cases.odd_rows() if r[1]]
    ids, at = tokens.Encoder(tokens.path(name)).encode(pa.array(texts))
    t = tokenizer(name)
    assert [ids[i:j].tolist() for i, j in zip(at[:-1], at[1:], strict=True)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_forgetting_units_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 20)
    e, t = tokens.Encoder(tokens.path("byte_bpe_50k.json")), tokenizer("byte_bpe_50k.json")
    for k in range(6):
        texts = [f"some words {k} {i} again and again" for i in range(30)]
        ids, at = e.encode(pa.array(texts))
        assert [ids[i:j].tolist() for i, j in zip(at[:-1], at[1:], strict=True)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_built_to_collide_stay_apart(spark, n):
    a, b = cases.complements(n)
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        t, e = tokenizer(name), tokens.Encoder(tokens.path(name))
        for texts in ([a, b, f"x {a} {b}"], [b, a]):
            ids, at = e.encode(pa.array(texts))
            assert [ids[i:j].tolist() for i, j in zip(at[:-1], at[1:], strict=True)] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    x, y = fingerprints.sketches(pa.array([a, b]))
    assert x.tolist() != y.tolist()
    docs = spark.createDataFrame([(1, a, "s"), (2, b, "s")], "doc_id long, text string, source string").coalesce(1)
    check_packed(packing.pack(packing.pieces(docs, tokens.path("byte_bpe_50k.json"))).collect(), {1: a, 2: b})
    path = store.new_path(spark, "complements")
    token_files.write(docs, path, tokens.path("word_bpe_49k.json"))
    t = tokenizer("word_bpe_49k.json")
    assert {r.doc_id: r.ids_crc32 for r in token_files.read_documents(spark, path).collect()} == {i: crc(t.encode(x, add_special_tokens=False).ids + [1]) for i, x in ((1, a), (2, b))}


def test_colliding_hashes_change_no_ids(monkeypatch):
    monkeypatch.setattr(tx, "word_numbers", lambda data, start, end, fold=False: (end - start).astype(np.uint64) * np.uint64(2))
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        t, e = tokenizer(name), tokens.Encoder(tokens.path(name))
        for texts in (["one two six", "ten"], ["ten"], ["one"], ["two two", None, "a" * 700 + " " + "b" * 700]):
            ids, at = e.encode(pa.array(texts, pa.string()))
            assert [ids[i:j].tolist() for i, j in zip(at[:-1], at[1:], strict=True)] == [t.encode(x or "", add_special_tokens=False).ids for x in texts]


# -- packing


def test_best_fit_fills_and_keeps_everything():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 1025, 5000)
    bins = packing.best_fit(sizes)
    assert sorted(i for b in bins for i in b) == list(range(5000))
    assert max(sizes[b].sum() for b in bins) <= 1024
    assert len(bins) <= 1.01 * sizes.sum() / 1024 + 1
    with pytest.raises(ValueError):
        packing.best_fit(np.array([1025]))


def check_packed(rows, texts):
    t = tokenizer("byte_bpe_50k.json")
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for doc, own in by_doc.items():
        ids = t.encode(texts[doc], add_special_tokens=False).ids + [2]
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert [r.length for r in own] == packing.cut_lengths(len(ids))
        for r in own:
            assert r.ids_crc32 == crc(ids[r.start : r.start + r.length])
        assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist()
    for own in by_seq.values():
        own.sort(key=lambda r: r.offset)
        at = 0
        for r in own:
            assert r.offset == at
            at += r.length
        assert at <= 1024
    return len(by_seq), sum(r.length for r in rows)


def test_op8_against_plain_encoding(spark):
    rows = queries.op8_packing(spark, cases.SF).collect()
    n, total = check_packed(rows, documents(spark))
    assert n <= 1.02 * total / 1024 + 1


def test_packing_takes_odd_tables(spark):
    odd = spark.createDataFrame([r for r in cases.odd_rows() if r[0] not in (14, 15)], cases.DOCS).withColumn("offset", F.lit("x")).withColumn("length", F.lit("y"))
    rows = packing.pack(packing.pieces(odd, tokens.path("byte_bpe_50k.json"))).collect()
    check_packed(rows, {r[0]: r[1] or "" for r in cases.odd_rows() if r[0] not in (14, 15)})
    every = cases.tables(spark)
    assert packing.pack(packing.pieces(every["odd"], tokens.path("byte_bpe_50k.json"))).filter("doc_id = 14").count() == 2
    assert packing.pack(packing.pieces(every["empty"], tokens.path("byte_bpe_50k.json"))).count() == 0


def test_rounds_merge_underfull_bins(spark):
    items = spark.range(4000).select(F.col("id").alias("name"), (F.col("id") % 97 + 1).alias("length")).repartition(16)
    rows = packing.pack(items).collect()
    assert len(rows) == 4000
    assert len({r.sequence_id for r in rows}) <= sum(i % 97 + 1 for i in range(4000)) / 1024 * 1.01 + 1


def test_bins_without_partners_leave(spark, monkeypatch):
    seen = []
    write = store.written
    monkeypatch.setattr(store, "written", lambda df, name, few=False: (lambda t: (seen.append((name, t.count())), t)[1])(write(df, name, few)))
    items = spark.range(0, 20_000, 1, 16).select(F.col("id").alias("a:b"), F.when(F.col("id") % 1000 == 0, 300).otherwise(600).alias("length"))
    rows = packing.pack(items).collect()
    fills = defaultdict(int)
    for r in rows:
        fills[r.sequence_id] += r["length"]
    assert sorted(r["a:b"] for r in rows) == list(range(20_000)) and max(fills.values()) <= 1024
    assert len(fills) == 19_980
    assert all(n <= 2 * 16 for name, n in seen if name.startswith("bins") and name != "bins0")


def test_partners_are_the_fullest_that_fit():
    assert packing.partners({600: 20_000}) == {}
    assert packing.partners({600: 20_000, 500: 3}) == {500: 3}
    assert packing.partners({600: 20_000, 700: 5, 310: 7}) == {310: 7, 700: 5, 600: 2}
    assert packing.partners({512: 1}) == packing.partners({}) == {}
    assert packing.partners({512: 2, 100: 1, 900: 4}) == {512: 2, 100: 1, 900: 1}


# -- token files


def test_planes_round_trip():
    rng = np.random.default_rng(2)
    for n in (0, 1, token_files.BLOCK, 3 * token_files.BLOCK + 7):
        for top in (200, 50_000, 1 << 32):
            ids = rng.integers(0, top, n).astype("<u4")
            planes, index = token_files.pack_planes(ids)
            assert (token_files.unpack_planes(planes, index, n) == ids).all()
    some = token_files.unpack_planes(planes, index, n, 1, 2)
    assert (some == ids[token_files.BLOCK : 2 * token_files.BLOCK]).all()


def test_op10_against_plain_encoding(spark):
    texts, t, start = documents(spark), tokenizer("word_bpe_49k.json"), 0
    rows = {r.doc_id: r for r in queries.op10_token_files(spark, cases.SF).collect()}
    assert set(rows) == set(texts)
    for doc in sorted(texts):
        ids = t.encode(texts[doc], add_special_tokens=False).ids + [1]
        assert (rows[doc].start, rows[doc].n_tokens, rows[doc].ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)


def test_token_files_take_odd_tables(spark, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT", 50)
    t = tokenizer("word_bpe_49k.json")
    for name, docs in cases.tables(spark).items():
        path = store.new_path(spark, "odd")
        token_files.write(docs.withColumn("start", F.lit("clash")), path, tokens.path("word_bpe_49k.json"))
        rows = sorted(token_files.read_documents(spark, path).collect(), key=lambda r: r.start)
        wanted = sorted(([] if name == "empty" else cases.odd_rows()), key=lambda r: (r[0] is not None, r[0] or 0))
        assert [r.doc_id for r in rows] == [r[0] for r in wanted]
        assert sum(r.n_tokens for r in rows) == sum(len(t.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in wanted)


# -- sharding


def test_op9_is_a_shuffle_by_key(spark):
    rows = queries.op9_sharding(spark, cases.SF).collect()
    texts = documents(spark)
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    slots = defaultdict(list)
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert r.grown_shard in (r.shard, 16) and 0 <= r.shard < 16
        slots[r.shard].append((r.slot, r.doc_id))
    for own in slots.values():
        assert sorted(s for s, _ in own) == list(range(len(own)))
    in_order = sum([d for _, d in sorted(own)] == sorted(d for _, d in own) for own in slots.values() if len(own) > 3)
    assert in_order == 0
    assert sorted(rows) == sorted(queries.op9_sharding(spark, cases.SF).collect())


def test_jump_shards_are_even_and_only_grow(spark):
    ids = spark.range(40_000).select(F.col("id").alias("doc_id"))
    rows = ids.select(*(sharding.jump_shard("doc_id", n).alias(f"s{n}") for n in (1, 15, 16, 17))).collect()
    assert {r.s1 for r in rows} == {0}
    assert all(r.s16 in (r.s15, 15) and r.s17 in (r.s16, 16) for r in rows)
    counts = np.bincount([r.s16 for r in rows])
    assert counts.min() > 0.9 * 2500 and counts.max() < 1.1 * 2500


def test_fisher_yates_permutes():
    for n in (0, 1, 2, 1000):
        assert sorted(sharding.fisher_yates(n, 3, 4).tolist()) == list(range(n))
    assert (sharding.fisher_yates(50, 3, 4) == sharding.fisher_yates(50, 3, 4)).all()
    firsts = [int(sharding.fisher_yates(4, 3, b)[0]) for b in range(4000)]
    assert np.bincount(firsts).min() > 850


def test_op9_reads_back_the_shards_it_writes(spark, monkeypatch):
    paths = []
    write = sharding.write_shards
    monkeypatch.setattr(sharding, "write_shards", lambda docs, path, *more: (paths.append(path), write(docs, path, *more))[1])
    df = queries.op9_sharding(spark, cases.SF)
    assert len(paths) == 1 and any(paths[0].rsplit("/", 1)[1] in f for f in df.inputFiles())
    files = {(r.shard, r._at): (r.doc_id, r.text) for r in spark.read.parquet(paths[0]).collect()}
    rows = df.collect()
    assert len(files) == len(rows) == spark.read.parquet(f"{cases.SF}/documents.parquet").count()
    # these texts are one bucket a shard, so places in buckets are slots
    assert all(files[r.shard, r.slot][0] == r.doc_id and zlib.crc32((files[r.shard, r.slot][1] or "").encode()) == r.text_crc32 for r in rows)


def plain_shard(doc_id, shards):
    """Jump hashing by the book: the engine's 64-bit hash of (seed, step, is null, key), chained over the fields."""
    import struct

    import xxhash

    found = 0
    for k in range(1, shards):
        h = 42
        for field in (struct.pack("<i", sharding.SEED), struct.pack("<i", k), struct.pack("<i", int(doc_id is None)), *([struct.pack("<q", doc_id)] if doc_id is not None else [])):
            h = xxhash.xxh64(field, seed=h).intdigest()
        if (h - (1 << 64) if h >> 63 else h) % (k + 1) == 0:
            found = k
    return found


def plain_shuffle(rows, bucket):
    """Fisher-Yates from the last place down, with the bucket's own generator."""
    rows, rng = list(rows), np.random.Generator(np.random.Philox(key=[sharding.SEED, bucket]))
    draws = rng.integers(0, np.arange(1, len(rows) + 1))
    for i in reversed(range(1, len(rows))):
        rows[i], rows[draws[i]] = rows[draws[i]], rows[i]
    return rows


def test_op9_against_a_plain_shuffle(spark):
    rows = queries.op9_sharding(spark, cases.SF).collect()
    by_shard = defaultdict(list)
    for r in rows:
        assert (r.shard, r.grown_shard) == (plain_shard(r.doc_id, 16), plain_shard(r.doc_id, 17))
        by_shard[r.shard].append(r)
    for shard, own in by_shard.items():
        assert [r.doc_id for r in sorted(own, key=lambda r: r.slot)] == plain_shuffle(sorted(r.doc_id for r in own), shard)


def test_null_ids_fill_all_buckets_of_their_shard(spark):
    rows = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.lit("z" * 200)).otherwise(F.concat(F.lit("y" * 190), F.col("id").cast("string"))).alias("text"))
    out = sharding.two_pass_shuffle(rows, "doc_id", F.octet_length("text") + 1, shards=4, bucket_bytes=100_000)
    found = out.groupBy("shard").agg(F.count("*").alias("n"), F.count_distinct("slot").alias("slots"), F.max("slot").alias("last")).collect()
    assert [(r.n, r.slots, r.last) for r in found] == [(20_000, 20_000, 19_999)] and found[0].shard == plain_shard(None, 4)
    tasks = sharding.scattered(rows, "doc_id", F.octet_length("text") + 1, shards=4, bucket_bytes=100_000).groupBy("_bucket").count().collect()
    assert len(tasks) >= 9 and max(r["count"] for r in tasks) < 3_000


def test_sharding_takes_odd_tables(spark):
    size = F.octet_length(F.coalesce("text", F.lit(""))) + 1
    for name, docs in cases.tables(spark).items():
        clash = docs.withColumn("slot", F.lit("mine")).withColumn("a.b", F.lit(1))
        out = sharding.two_pass_shuffle(clash, "doc_id", size, shards=4, bucket_bytes=1000)
        rows = out.collect()
        assert len(rows) == (0 if name == "empty" else len(cases.odd_rows()))
        for s in range(4):
            own = sorted(r.slot for r in rows if r.shard == s)
            assert own == list(range(len(own)))
        if name == "odd":
            assert sorted(str(r.text) for r in rows) == sorted(str(r[1]) for r in cases.odd_rows())
            path = store.new_path(spark, "shards")
            sharding.write_shards(docs, path, "doc_id", size, 4)
            assert sharding.read_shards(spark, path).count() == len(rows)


# -- mixing


def shares(weights, most, budget):
    """The budget split by weight, no share above its most; excess goes to the others by weight."""
    out, free, left = [0.0] * len(weights), [i for i in range(len(weights)) if most[i] > 0], budget
    while free:
        weight = sum(weights[i] for i in free)
        full = [i for i in free if left * weights[i] / weight > most[i]]
        for i in full or free:
            out[i] = float(most[i]) if full else left * weights[i] / weight
        if not full:
            break
        left -= sum(most[i] for i in full)
        free = [i for i in free if i not in full]
    return out


def plain_mix(docs, budget_share=1.0):
    """Words taken of each (doc_id, source, text): one sorted list of all copies, cut where the budget ends."""
    sizes = defaultdict(int)
    for _, source, text in docs:
        sizes[source] += len(cases.words(text))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    total = sum(sizes.values())
    target = dict(zip(names, shares([(5, 2, 1)[i % 3] for i in range(len(names))], [3 * sizes[n] for n in names], budget_share * total), strict=True))
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    key = lambda d: md5(f"{mixing.SEED}:{'' if d[0] is None else d[0]}:{md5(d[2] or '')}")
    copies = []
    for place, name in enumerate(names):
        at = 0
        for _ in range(3):
            for k, d in sorted(((k, d) for k, d in enumerate(docs) if d[1] == name), key=lambda x: key(x[1])):
                n = len(cases.words(d[2]))
                at += n
                if n and target[name]:
                    copies.append((at / target[name], place, n, k))
    budget, spent, taken = min(budget_share * total, 3 * total), 0, [0] * len(docs)
    for _, _, n, k in sorted(copies, key=lambda c: c[:2]):
        over = spent + n > budget
        if over and not spent + n - budget < budget - spent:
            break
        spent += n
        taken[k] += n
        if over:
            break
    return [(d[0], n) for d, n in zip(docs, taken, strict=True)], target


def mixed(spark, docs):
    rows = mixing.mix(spark.createDataFrame(docs, "doc_id long, source string, text string").repartition(3)).collect()
    return sorted(((r.doc_id, r.copies * len(cases.words(r.text))) for r in rows), key=str)


def planned(spark, docs):
    return sorted(((r.doc_id, r.copies * r["size"]) for r in mixing.planned(spark.createDataFrame(docs, "doc_id long, source string, text string")).collect()), key=str)


@pytest.mark.parametrize("case", ["equal", "giant", "one", "many", "alike", "weights"])
def test_mix_against_a_plain_queue(spark, monkeypatch, case):
    import random

    rnd = random.Random(case)
    text = lambda n: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))
    docs = {
        "equal": [(i, "a", text(10)) for i in range(8)],
        "giant": [(i, "a", text(10)) for i in range(8)] + [(100, "b", text(3000))],
        "one": [(1, None, text(7))],
        "many": [(i, f"s{i % 11}" if i % 12 else None, text(rnd.randrange(0, 60))) for i in range(400)],
        "alike": [(None, "a", "the same row")] * 50 + [(i, "b", text(9)) for i in range(30)] + [(7, "c", "twice")] * 2,
        "weights": [(s * 100 + i, "abc"[s], text(20)) for s in range(3) for i in range(24)],
    }[case]
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 5)
    monkeypatch.setattr(mixing, "FEW", 3)
    wanted = plain_mix(docs)[0]
    if case == "equal":
        assert sum(n for _, n in wanted) == 80
    if case == "giant":
        assert dict(wanted)[100] == 3000
    assert planned(spark, docs) == mixed(spark, docs) == sorted(wanted, key=str)
    if case == "many":
        monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
        assert planned(spark, docs) == mixed(spark, docs) == sorted(wanted, key=str)


def test_op7_meets_its_targets(spark):
    rows = queries.op7_mixing(spark, cases.SF).collect()
    texts = documents(spark)
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{cases.SF}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    sums = defaultdict(lambda: [0, 0, 0.0, 0])
    for r in rows:
        assert r.size == len(cases.words(texts[r.doc_id]))
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
        s = sums[source[r.doc_id]]
        s[0] += r.size
        s[1] += r.taken
        s[2], s[3] = r.target, max(s[3], r.size)
        assert r.source_size == sum(len(cases.words(texts[d])) for d in texts if source[d] == source[r.doc_id])
    names = sorted(sums)
    weights = [(5, 2, 1)[i % 3] for i in range(len(names))]
    total = sum(s[0] for s in sums.values())
    wanted = shares(weights, [3 * sums[n][0] for n in names], total)
    for n, w in zip(names, wanted, strict=True):
        assert sums[n][2] == pytest.approx(w)
        assert abs(sums[n][1] - w) <= 2 * sums[n][3] + 1
    taken = sum(s[1] for s in sums.values())
    assert abs(total - taken) <= max(s[3] for s in sums.values()) / 2
    assert sorted(rows) == sorted(queries.op7_mixing(spark, cases.SF).collect())


def test_mixing_takes_odd_tables(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 2)
    for name, docs in cases.tables(spark).items():
        rows = mixing.mix(docs.withColumn("size", F.lit("clash")).withColumn("copies", F.lit("clash"))).collect()
        assert len(rows) == (0 if name == "empty" else len(cases.odd_rows()))
        assert all(r.copies == 0 for r in rows if not cases.words(r.text))
        assert all(r["size"] == "clash" for r in rows)
        if rows:
            wanted = plain_mix([(r[0], r[3], r[1]) for r in cases.odd_rows()])[0]
            assert sorted(((r.doc_id, r.copies * len(cases.words(r.text))) for r in rows), key=str) == sorted(wanted, key=str)


# -- fingerprints


def test_op1_against_brute_force(spark):
    texts = documents(spark)
    order = sorted(texts)
    rows = {r.doc_id: r for r in queries.op1_fingerprints(spark, cases.SF).collect()}
    assert set(rows) == set(texts)
    error = []
    for doc, after in zip(order, order[1:] + order[:1], strict=True):
        text, r = texts[doc], rows[doc]
        q = len(text) // 4
        changed = text[: len(text) - q] + texts[after][:q]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        a, b, c = (cases.shingle_set(x, 5) for x in (text, changed, texts[after]))
        assert len(fingerprints.from_string(r.fingerprint)) == min(len(a), 128)
        assert r.edited_fingerprint == fingerprints.to_string(fingerprints.sketches(pa.array([changed]))[0])
        error.append(r.near_edited - len(a & b) / len(a | b))
        assert abs(r.near_next - (len(a & c) / len(a | c) if a | c else 1)) < 0.2
        assert r.distinct_shingles == pytest.approx(len(a), rel=0.4)
    assert np.abs(error).max() < 0.2 and np.sqrt(np.mean(np.square(error))) < 0.05


def test_fingerprints_merge_and_compare():
    a, b = (np.unique(np.random.default_rng(s).integers(0, 2**64, 3000, dtype=np.uint64)) for s in (1, 2))
    c = np.concatenate((a[::2], b))
    sk = [fingerprints.bottom(np.sort(x)[::-1]) for x in (a, b, np.union1d(a, b))]
    assert (fingerprints.merge(sk[:2]) == sk[2]).all()
    assert fingerprints.resemblance(fingerprints.bottom(a), fingerprints.bottom(c)) == pytest.approx(len(np.intersect1d(a, c)) / len(np.union1d(a, c)), abs=0.15)
    assert fingerprints.containment(fingerprints.bottom(a), fingerprints.bottom(np.union1d(a, b))) == pytest.approx(1, abs=0.2)
    none = np.zeros(0, np.uint64)
    assert fingerprints.resemblance(none, none) == 1 and fingerprints.resemblance(none, sk[0]) == 0
    assert fingerprints.from_string(fingerprints.to_string(none)).size == 0


def test_fingerprints_take_odd_tables(spark):
    every = cases.tables(spark)
    rows = fingerprints.with_successor(every["odd"].withColumn("fingerprint", F.lit("clash"))).collect()
    order = sorted(cases.odd_rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    assert sorted((r.doc_id or 0, r.n_chars) for r in rows) == sorted((r[0] or 0, len(r[1] or "")) for r in order)
    for this, after in zip(order, order[1:] + order[:1], strict=True):
        digest = hashlib.sha256(fingerprints.edited(this[1] or "", after[1] or "").encode()).hexdigest()
        assert digest in {r.edited_sha256 for r in rows if r.doc_id == this[0]}
    assert fingerprints.with_successor(every["empty"]).count() == 0
    one = fingerprints.with_successor(every["odd"].filter("doc_id = 1")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_merge_by_matches_the_whole(spark):
    rows = [("x", "a b c d e f g h"), ("x", "f g h i j k"), (None, "q r s t u v"), ("z", None)]
    parts = fingerprints.fingerprint(spark.createDataFrame(rows, "name string, text string"))
    got = {r.name: r.fingerprint for r in fingerprints.merge_by(parts, ["name"]).collect()}
    for name in ("x", None, "z"):
        wanted = fingerprints.merge(fingerprints.sketches(pa.array([t for n, t in rows if n == name], pa.string())))
        assert got[name] == fingerprints.to_string(wanted)
