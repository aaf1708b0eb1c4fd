from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from trackweave.llm import queries, suffix_dedup


def brute(texts: list[bytes], least: int = 100) -> list[np.ndarray]:
    """Texts in order: which bytes lie in a string of ``least`` bytes that starts earlier too."""
    seen: set[bytes] = set()
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - least + 1):
            s = t[i : i + least]
            if s in seen:
                gone[i : i + least] = True
            seen.add(s)
        out.append(gone)
    return out


def digest(raw: bytes, gone: np.ndarray):
    spans = int(np.sum(np.diff(gone.astype(int), prepend=0) == 1))
    return len(raw), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest()


def random_texts(seed: int, n: int = 60) -> list[str]:
    rnd = random.Random(seed)
    base = ["".join(rnd.choices("abcdefgh é", k=rnd.randint(50, 900))) for _ in range(8)]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rnd.randint(1, 4)):
            b = rnd.choice(base)
            i, j = sorted(rnd.choices(range(len(b) + 1), k=2))
            parts += ["".join(rnd.choices("xyz", k=rnd.randint(0, 30))), b[i:j]]
        out.append("".join(parts))
    return [*out, "ab" * 400, "ab" * 300, "a" * 700, base[0], base[0], base[1][:99], base[1][:100], ""]


def got(df):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


@pytest.mark.parametrize(("hot", "chunk"), [(20_000, 2_000), (10, 2_000), (10, 4)])
def test_removes_what_brute_force_removes(spark, monkeypatch, hot, chunk):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "HOT_CHUNK", chunk)
    monkeypatch.setattr(suffix_dedup, "CHUNK_ROWS", 50)
    texts = random_texts(hot + chunk)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    raw = [t.encode() for t in texts]
    assert got(suffix_dedup.digests(df)) == sorted((str(i), *digest(r, g)) for i, (r, g) in enumerate(zip(raw, brute(raw), strict=True)))


def test_long_texts_in_stretches_give_the_same_rows(monkeypatch):
    import pyarrow as pa

    from trackweave.llm import text as tx

    texts = [*random_texts(3, 20), "é" * 333 + "".join(random_texts(4, 12)) * 2, "q" * 1500]
    n = len(texts)
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([0] * n, pa.int64()), pa.array(texts)], ["id", "tie", "text"])
    rows = lambda found: sorted(tuple(r.values()) for b in found for r in b.to_pylist())
    spots = [[2 * p + h for p in range(0, max(0, len(t.encode()) - 24), 37) for h in (0, 1)] for t in texts]
    spans = pa.array([[] for _ in texts], pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))
    asked = pa.RecordBatch.from_arrays([*batch.columns, pa.array(spots, pa.list_(pa.int64())), spans], ["id", "tie", "text", "spots", "spans"])
    whole = rows(suffix_dedup._anchor_rows(iter([batch]))), rows(suffix_dedup._around(iter([asked])))
    for size in (100, 333, 2000):
        monkeypatch.setattr(tx, "BATCH_BYTES", size)
        assert rows(suffix_dedup._anchor_rows(iter([batch]))) == whole[0]
        assert rows(suffix_dedup._around(iter([asked]))) == whole[1]


def test_maximal_repeats_remove_the_same(spark):
    raw = [t.encode() for t in random_texts(7, 25)]
    repeats = suffix_dedup.maximal_repeats(raw)
    for a, b in zip(suffix_dedup.removed_by(repeats, raw), brute(raw), strict=True):
        assert (a == b).all()
    for length, where in repeats:
        assert len(where) > 1 and len({raw[k][i : i + length] for k, i in where}) == 1
    assert suffix_dedup.maximal_repeats([]) == []
    found = dict((length, sorted(w)) for length, w in suffix_dedup.maximal_repeats([b"xabcabcy", b"zabcq"], 3))
    assert found == {3: [(0, 1), (0, 4), (1, 1)]}


@pytest.mark.parametrize("hot", [20_000, 10])
def test_groups_of_a_table(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "CHUNK_ROWS", 50)
    texts = random_texts(hot + 1, 40)
    raw = [t.encode() for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    groups: dict = {}
    for r in suffix_dedup.repeat_groups(docs).collect():
        groups.setdefault((r.group_id, r.length, r.whole), []).append((r.doc_id, r.start))
    told = {}
    for (_, length, whole), where in groups.items():
        strings = {raw[k][i : i + length] for k, i in where}
        assert len(strings) == 1 and len(where) == len(set(where)) > 1
        (string,) = strings
        assert len(string) == length >= suffix_dedup.LEAST and string not in told
        told[string] = whole, sorted(where)
    # every group has all occurrences of its bytes
    for string, (_, where) in told.items():
        assert where == [(k, i) for k, t in enumerate(raw) for i in range(len(t) - len(string) + 1) if t.startswith(string, i)]
    # what ends on both sides inside an anchor's surroundings is a maximal repeat of the texts
    maximal = {raw[w[0][0]][w[0][1] : w[0][1] + n]: sorted(w) for n, w in suffix_dedup.maximal_repeats(raw)}
    found = {s: w for s, (whole, w) in told.items() if whole}
    assert found and all(maximal.get(s) == w for s, w in found.items())
    # and what isn't the first of its group is what brute force removes
    gone = suffix_dedup.removed_by([(len(s), w) for s, (_, w) in told.items()], raw)
    for a, b in zip(gone, brute(raw), strict=True):
        assert (a == b).all()


def test_groups_are_the_maximal_repeats_around_an_anchor():
    rnd = random.Random(5)
    for n in (2, 3, 7, 40):
        rows = sorted({bytes(rnd.choice(b"ab") if abs(i - 76) % 25 == 24 else 97 for i in range(176)) for _ in range(n)})
        left, right = np.full(len(rows), 76), np.full(len(rows), 100)
        around = np.frombuffer(b"".join(rows), np.uint8).reshape(-1, 176)
        wanted = set()
        for i in range(len(rows)):
            for j in range(i):
                l = next((k for k in range(76) if rows[i][75 - k] != rows[j][75 - k]), 76)
                r = next((k for k in range(100) if rows[i][76 + k] != rows[j][76 + k]), 100)
                if l + r >= 100 and r >= 24:
                    wanted.add((l, r, tuple(k for k in range(len(rows)) if rows[k][76 - l : 76 + r] == rows[i][76 - l : 76 + r])))
        found = []
        for members, sizes, ls, rs in suffix_dedup.anchored_groups(np.zeros(len(rows), np.int64), left, right, around):
            for m, l, r in zip(np.split(members, np.cumsum(sizes)[:-1]), ls.tolist(), rs.tolist(), strict=True):
                found.append((l, r, tuple(sorted(m.tolist()))))
        assert len(found) == len(set(found)) and set(found) == wanted


def test_zero_bytes_at_the_end_are_bytes(spark):
    rnd = random.Random(6)
    base = "".join(rnd.choices("abcdefgh", k=140))
    texts = [base + "\0" * 30, base, base + "\0" * 50, base + "\0" * 40 + "x", "q" + base + "\0" * 60 + "y"]
    raw = [t.encode() for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert got(suffix_dedup.digests(docs)) == sorted((str(i), *digest(r, g)) for i, (r, g) in enumerate(zip(raw, brute(raw), strict=True)))


def test_groups_take_odd_tables(spark):
    every = cases.tables(spark)
    rows = suffix_dedup.repeat_groups(every["odd"].withColumn("group_id", F.lit("clash")).withColumn("spans", F.lit("clash"))).collect()
    assert {8, 9, 10} <= {r.doc_id for r in rows} and 3 not in {r.doc_id for r in rows}
    assert suffix_dedup.repeat_groups(every["empty"]).count() == 0


def test_intervals_nest():
    assert list(suffix_dedup.intervals([0, 2, 3, 1, 0, 4])) == [(3, 1, 2), (2, 0, 2), (1, 0, 3), (4, 4, 5)]
    assert list(suffix_dedup.intervals([], 1)) == []


def test_op6_on_the_test_table(spark):
    rows = sorted(spark.read.parquet(f"{cases.SF}/documents.parquet").collect(), key=lambda r: r.doc_id)
    raw = [(r.text or "").encode() for r in rows]
    wanted = sorted((str(r.doc_id), *digest(t, g)) for r, t, g in zip(rows, raw, brute(raw), strict=True))
    assert got(queries.op6_suffix_dedup(spark, cases.SF)) == wanted


def test_takes_odd_tables(spark):
    every = cases.tables(spark)
    rows = suffix_dedup.digests(every["odd"].withColumn("spans", F.lit("clash")).withColumn("doc", F.lit("clash"))).collect()
    assert len(rows) == len(cases.odd_rows())
    same = [r for r in rows if r.doc_id == 14]
    assert len(same) == 2 and same[0] == same[1] and same[0].n_removed == 0
    assert suffix_dedup.digests(every["empty"]).count() == 0
    kept = suffix_dedup.deduplicated(every["odd"].withColumn("spans", F.lit("clash")).withColumn("a.b", F.lit(1))).drop("a.b")
    assert kept.columns == every["odd"].columns
    assert {r.doc_id: r.text for r in kept.collect()}[3] is None


def test_cuts_whole_characters():
    raw = "aéb".encode()
    assert suffix_dedup.whole_characters(raw, [(0, 2)]) == [(0, 1)]
    assert suffix_dedup.whole_characters(raw, [(2, 4)]) == [(3, 4)]
    assert suffix_dedup.whole_characters(raw, [(1, 3)]) == [(1, 3)]
    assert suffix_dedup.whole_characters(raw, [(2, 3)]) == []
