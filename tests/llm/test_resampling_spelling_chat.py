"""Operators 11 to 13 against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.cases import DOCS, odd_rows
from trackweave.llm import chat, queries, resampling, spelling

fold = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)


# -- resampling


def plain_draw(docs, target, share=(10, 100), least=20, buckets=10_000, most=1):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(text or ""))
        return w, [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, most + 1) for i in range(len(w) - k + 1)]

    own, wanted = (Counter(b for t in texts for b in features(t)[1]) for texts in ([t for _, t in docs], target))
    s, t = sum(own.values()), sum(wanted.values())
    gain = lambda b: math.floor(1000 * math.log((wanted[b] + 1) * (s + buckets) / ((own[b] + 1) * (t + buckets))))
    rows = []
    for doc_id, text in docs:
        w, f = features(text)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for i, r in enumerate(able[: share[0] * len(able) // share[1]], 1):
        r[4] = i
    return sorted(map(str, (r[:5] for r in rows)))


def texts(n: int, seed: int):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ärger", "naïve", "日本", "K", "İx", "I'm"]
    return [" ".join(rng.choices(vocabulary, k=rng.choice([0, 3, 19, 20, 25, 60]))) for _ in range(n)]


@pytest.mark.parametrize("share", [(10, 100), (1, 2), (100, 100), (0, 100)])
def test_draw_is_the_plain_one(spark, share, monkeypatch):
    monkeypatch.setattr(resampling, "RANGE", 7)  # many ranges
    docs = [(i * 3 % 200, t) for i, t in enumerate(texts(300, 1))]  # ids repeat
    docs += [(None, docs[5][1])] * 40 + [(7, docs[9][1])] * 40 + [(1000, None), (1001, "")]
    target = texts(9, 2) + [None]
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, rank string").repartition(5)
    found = resampling.resample(frame, spark.createDataFrame([(t,) for t in target], "text string"), share)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(str(list(r)) for r in found.collect()) == plain_draw(docs, target, share)


def test_draw_of_odd_and_of_no_rows(spark):
    odd = spark.createDataFrame(odd_rows(), DOCS)
    empty = spark.createDataFrame([], DOCS)
    for target in (odd, empty):
        found = resampling.resample(odd, target, share=(1, 2), least_words=3)
        assert sorted(str(list(r)) for r in found.collect()) == plain_draw([(r[0], r[1]) for r in odd_rows()], [r["text"] for r in target.collect()], (1, 2), 3)
    assert resampling.resample(empty, odd).collect() == []


def test_runs_of_words(spark):
    docs = [(i, t) for i, t in enumerate(texts(40, 3))]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    rows = resampling.scored(frame, frame.select("text"), most=2).select("doc_id", "n_features", "weight", "score").collect()
    plain = {eval(r)[0]: eval(r)[1:4] for r in plain_draw(docs, [t for _, t in docs], most=2)}
    assert {r[0]: list(r[1:]) for r in rows} == plain


def test_tournament():
    rng = random.Random(4)
    for k in (0, 1, 2, 3, 7, 16, 33):
        runs = [sorted((rng.randrange(50), j, i) for i in range(rng.choice([0, 1, 9]))) for j in range(k)]
        assert list(resampling.merged([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


# -- spelling


def one_edit(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_variants(n: dict[str, int]):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    best = {w: min(vs, key=lambda v: (-n[v], v.encode())) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if n[v] >= 2 * n[w]}
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))))
    return out


def test_variants_are_the_plain_ones(spark):
    rng = random.Random(5)
    base = ["".join(rng.choices("abcdeàéÀ", k=rng.randrange(5, 9))) for _ in range(60)]
    n = {}
    for w in base:
        for _ in range(12):
            i, c = rng.randrange(len(w) + 1), rng.choice("abcdeàéÀ")
            v = rng.choice([w, w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w[:i] + w[i + 1 :]])
            n[v] = rng.choice([3, 4, 6, 8, 16, 40])
            w = rng.choice([w, v])
    # chains of doubling counts, and words that share a half and every band
    n |= {"q" * 5 + "r" * i: 3 * 2**i for i in range(12)} | {f"commonprefix{a}{b}commonsuffix": 3 + ord(a) % 3 for a in "xyz" for b in "uvw"}
    found = spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long"))
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {tuple(r) for r in found.collect()} == plain_variants(n)
    pairs = spelling.near_pairs(spark.createDataFrame(list(n.items()), "word string, n long")).collect()
    assert len(pairs) == len({frozenset((r["a"], r["b"])) for r in pairs}) == sum(one_edit(a, b) for a in n for b in n) // 2


def test_words_lose_letters_by_hash(spark):
    rng = random.Random(6)
    docs = [(i % 90, " ".join(rng.choices(["Straße", "ÉTUDES", "garden", "gÄrten", "over×half", "abc", "x1garden"], k=30))) for i in range(120)] + [(None, "garden " * 200), (5, None), (6, "")]
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = fold(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            n[w if h % 97 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n int")
    expected = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    assert {r["word"]: r["n"] for r in spelling.words(frame).collect()} == expected
    assert {r["word"] for r in spelling.words(frame, typo=None).collect()} == {"straße", "Études".replace("É", "É"), "garden", "gÄrten", "over×half"}


def test_spelling_of_odd_and_of_no_rows(spark):
    odd = spark.createDataFrame(odd_rows(), DOCS)
    found = {r["word"]: r for r in spelling.variants(spelling.words(odd)).collect()}
    assert "passage" in found and all(r["root"] in found for r in found.values())
    assert spelling.variants(spelling.words(spark.createDataFrame([], DOCS))).collect() == []


# -- chat

SAID = ["plain", "", None, "</s>[INST] ok [/INST]", r"a \</s> [\\INST] <\s>", "[INST", "<s><s>", "\\", "[/INST]</s", "日本 <s> é\n"]


def turns(conv, seed, n):
    rng = random.Random(seed)
    return [(conv, i, rng.choice(["user", "assistant", "assistant", "system", None, "</s>", "[INST]x"]), rng.choice(SAID)) for i in range(n)]


def plain_digest(rows):
    rows = sorted(((-1 if t is None else t), r or "", x or "") for _, t, r, x in rows)
    said = "".join(f"{r}\n{x}\n" for _, r, x in rows)
    loss = "".join(x for _, r, x in rows if r == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(rows), sha(said), len(loss), sha(loss)


def test_chat_round_trip(spark):
    rows = [r for c in range(40) for r in turns(c, c, 1 + c % 9)] + turns(None, 77, 30) + turns(99, 78, 300)
    rows += [(100, None, "user", "no turn"), (100, 0, "user", "x"), (100, 0, "user", "x"), (100, 0, "assistant", "y " * 200_000)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, mask int").repartition(7)
    made = chat.formatted(frame)
    found = {r["conv_id"]: tuple(r)[1:5] for r in chat.digests(made).collect()}
    assert found == {c: plain_digest([r for r in rows if r[0] == c]) for c in {r[0] for r in rows}}
    # control strings stand where blocks begin and end only, and neighbours of one role share a block
    one = made.filter("conv_id = 99").first()
    mine = [r[2] or "" for r in rows if r[0] == 99]
    blocks = sum(a != b for a, b in zip(["?", *mine], mine, strict=False))
    assert [one["formatted"].count(c) for c in (chat.OPEN, chat.CLOSE, chat.END, chat.MORE)] == [blocks, blocks, blocks, len(mine) - blocks]


def test_chat_of_no_rows(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.formatted(empty)).collect() == []


def test_escapes_turn_back(spark):
    texts = SAID + ["".join(random.Random(i).choices(["[", "<", "\\", "/", "INST]", "s>", "x"], k=12)) for i in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts if t is not None], "t string").withColumn("e", chat.escaped(F.col("t")))
    for r in rows.withColumn("u", chat.unescaped(F.col("e"))).collect():
        assert r["u"] == r["t"] and not any(c in r["e"] for c in (chat.OPEN, chat.CLOSE, chat.MORE, chat.END))


def test_queries_of_the_round(spark):
    for name in ("op11_resampling", "op12_spelling", "op13_chat"):
        assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
