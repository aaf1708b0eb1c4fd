"""Target-distribution importance resampling: the documents that look most like a target, at random.

Features (words, or runs of words) are hashed into buckets and counted for the corpus and for the target;
a bucket's gain is the log ratio of their smoothed shares, one array for all buckets. A document's weight
is the mean gain of its features, its score the weight plus a Gumbel draw that its id decides, and the
documents of highest score are drawn, which is drawing without replacement by weight.

The draw is an external merge sort that stops at the count. Every task sorts its eligible rows into a run
and cuts it at common splitters; a range of the order then gets its slice of each run, in blocks of rows,
and a tournament tree merges the slices, the next winner for log(runs) comparisons. Ranges are merged by
tasks of their own, each with the number of rows that stand before it, so ranks need no second pass. What
lies under the last score that is drawn is never sorted, shuffled or merged.

To the driver come BUCKETS counts, the number of rows of each score (whole numbers within some ten
thousands of 0: a logarithm of counts and a Gumbel draw of 32 bits, in thousandths), and a few keys a range.

Defined results: null and empty texts have no words, weight 0, and are never drawn; a null doc_id draws as
an empty one and stands last among equals; repeated rows each count and each take a rank (rows alike in
everything are told apart by their place in the table); very long texts are one row; an empty target has
gains too; an empty table gives no rows; other columns pass by.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.llm import store
from trackweave.llm.columns import lowered

#: Words: runs of digits, letters and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BUCKETS, SEED, MOST, LEAST_WORDS, SHARE = 10_000, 2024, 1, 20, (10, 100)
#: Rows of a range of the merge, more or less, and sampled keys a range.
RANGE, SAMPLES = 250_000, 32

_RUN = "range int, run int, block int, rows int, score array<long>, doc_id array<long>, n_features array<long>, weight array<long>, item array<long>"


def words_of(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0)), lowered)


def buckets_of(words: Column, most: int = MOST, buckets: int = BUCKETS) -> Column:
    """The buckets of all runs of 1 to ``most`` words, in an array."""
    hashed = lambda s: (F.crc32(s.cast("binary")) % buckets).cast("int")
    one = F.transform(words, hashed)
    runs = [F.transform(F.sequence(F.lit(1), F.size(words) - k + 1), lambda i, k=k: hashed(F.array_join(F.slice(words, i, F.lit(k)), " "))) for k in range(2, most + 1)]
    return F.concat(one, *(F.when(F.size(words) >= k, r).otherwise(F.array().cast("array<int>")) for k, r in enumerate(runs, 2))) if runs else one


def _counts(texts: DataFrame, most: int, buckets: int) -> list[int]:
    rows = texts.select(F.explode(buckets_of(words_of(F.col("text")), most, buckets)).alias("b")).groupBy("b").count()
    out = [0] * buckets
    for b, n in rows.collect():  # as many rows as buckets
        out[b] = n
    return out


def gains(docs: DataFrame, target: DataFrame, most: int = MOST, buckets: int = BUCKETS) -> list[int]:
    """Each bucket's gain: the log ratio of its shares in target and corpus, in thousandths, rounded down."""
    own, wanted = _counts(docs, most, buckets), _counts(target, most, buckets)
    all_own, all_wanted = sum(own), sum(wanted)
    return [math.floor(1000 * math.log((t + 1) * (all_own + buckets) / ((s + 1) * (all_wanted + buckets)))) for s, t in zip(own, wanted, strict=True)]


def scored(docs: DataFrame, target: DataFrame, most: int = MOST, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, item (a number of its own) of every row; a written table."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # one literal, folded before anything runs
    by_bucket = F.split(F.lit(",".join(map(str, gains(own, target.select("text"), most, buckets)))), ",").cast("array<bigint>")
    rows = own.select("doc_id", words_of(F.col("text")).alias("words")).select("doc_id", F.size("words").cast("long").alias("n_words"), buckets_of(F.col("words"), most, buckets).alias("b"))
    rows = rows.select("doc_id", "n_words", F.size("b").cast("long").alias("n_features"), F.aggregate("b", F.lit(0).cast("long"), lambda a, b: a + F.get(by_bucket, b)).alias("gain"))
    weight = F.when(F.col("n_features") == 0, F.lit(0)).otherwise(F.expr("(gain - pmod(gain, n_features)) div n_features"))
    draw = F.conv(F.substr(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), F.lit(1), F.lit(8)), 16, 10).cast("double")
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((draw + 0.5) / 4294967296.0)))
    rows = rows.select("doc_id", "n_words", "n_features", weight.cast("long").alias("weight")).withColumn("score", (F.col("weight") + gumbel).cast("long"))
    return store.written(rows.withColumn("item", F.monotonically_increasing_id()), "scored")


# -- runs, ranges, tournaments


def merged(runs: list[Iterator[tuple]]) -> Iterator[tuple]:
    """The items of sorted runs in one order, by a tree of losers: the winner's next item plays its way up."""
    done = (math.inf,)
    runs = [iter(r) for r in runs]
    heads = [next(r, done) for r in runs]
    size = 1 << max(0, len(runs) - 1).bit_length()
    heads += [done] * (size - len(heads))
    won, lost = [0] * size + list(range(size)), [0] * size
    for node in range(size - 1, 0, -1):
        x, y = won[2 * node], won[2 * node + 1]
        won[node], lost[node] = (y, x) if heads[y] < heads[x] else (x, y)
    winner = won[1]
    while heads[winner] is not done:
        yield heads[winner]
        heads[winner] = next(runs[winner], done)
        node = (size + winner) // 2
        while node:
            if heads[lost[node]] < heads[winner]:
                winner, lost[node] = lost[node], winner
            node //= 2


def _key(score, doc_id, n_features, item) -> tuple:
    """What rows are ordered by: the highest score, the smallest doc_id (null last), and then any fixed order."""
    return (-score, doc_id is None, doc_id or 0, n_features, item)


def _keys(columns: list[list]) -> list[tuple]:
    return [_key(s, d, f, i) for s, d, f, _, i in zip(*columns, strict=True)]


_ORDER = ("score", "doc_id", "n_features", "weight", "item")


def _cutter(splitters: list[tuple]) -> Callable:
    """Cuts a task's sorted rows into blocks, each of one range."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = TaskContext.get().partitionId()
        for number, batch in enumerate(batches):
            keys = _keys([batch.column(c).to_pylist() for c in _ORDER])
            if not keys:
                continue
            first, last = bisect.bisect_right(splitters, keys[0]), bisect.bisect_right(splitters, keys[-1])
            ends = [bisect.bisect_left(keys, s) for s in splitters[first:last]] + [len(keys)]
            rows, begin = [], 0
            for r, end in enumerate(ends, first):
                if end > begin:
                    rows.append({"range": r, "run": run, "block": number, "rows": end - begin} | {c: batch.column(c).slice(begin, end - begin).to_pylist() for c in _ORDER})
                begin = end
            yield from pa.Table.from_pylist(rows, pa.schema([pa.field(f, pa.int32()) for f in ("range", "run", "block", "rows")] + [pa.field(f, pa.list_(pa.int64())) for f in _ORDER])).to_batches()

    return cut


def _ranker(before: dict[int, int], drawn: int) -> Callable:
    """Merges the slices of a range; ``before``: the rows of the ranges before it."""

    def rank(key: tuple, table: pa.Table) -> pa.Table:
        slices: dict[int, list] = {}
        for row in sorted(table.to_pylist(), key=lambda r: (r["run"], r["block"])):
            columns = [row[c] for c in _ORDER]
            slices.setdefault(row["run"], []).extend((*k, *rest) for k, *rest in zip(_keys(columns), *columns[:4], strict=True))
        place, out = before[key[0].as_py()], []
        for place, row in enumerate(merged(list(slices.values())), place + 1):
            out.append((*row[5:], place))
            if place == drawn:  # no more is merged: the rest of the range goes as it came
                out += [(*other[5:], None) for s in slices.values() for other in s if other > row]
                break
        score, doc, features, weight, ranks = zip(*out, strict=True)
        return pa.table({n: pa.array(v, pa.int64()) for n, v in (("doc_id", doc), ("n_features", features), ("weight", weight), ("score", score), ("rank", ranks))})

    return rank


def drawn(rows: DataFrame, share: tuple[int, int] = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score, rank of scored rows: the highest of those of ``least_words`` or more
    have ranks, ``share`` of their number rounded down."""
    able = F.col("n_words") >= least_words
    histogram = sorted(rows.filter(able).groupBy("score").count().collect(), reverse=True)
    count = share[0] * sum(n for _, n in histogram) // share[1]
    out = ["doc_id", "n_features", "weight", "score"]
    if not count:
        return rows.select(*out, F.lit(None).cast("long").alias("rank"))
    asked, cut = 0, histogram[0][0]
    for cut, n in histogram:
        asked += n
        if asked >= count:
            break
    wanted = able & (F.col("score") >= cut)
    top = rows.filter(wanted).select(*_ORDER)
    ranges = max(store.partitions_for(rows), -(-asked // RANGE))
    every = max(1, asked // (SAMPLES * ranges))
    sample = sorted(_key(*r) for r in top.filter(F.pmod(F.xxhash64("item"), F.lit(every)) == 0).select("score", "doc_id", "n_features", "item").collect())
    splitters = sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)}) if sample else []
    runs = top.sortWithinPartitions(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "n_features", "item")
    blocks = store.written(runs.mapInArrow(_cutter(splitters), _RUN), "runs")
    before, total = {}, 0
    for r, n in sorted(blocks.groupBy("range").agg(F.sum("rows")).collect()):  # one row a range
        before[r], total = total, total + n
    last = max(r for r, n in before.items() if n < count)
    ranked = blocks.filter(F.col("range") <= last).groupBy("range").applyInArrow(_ranker(before, count), "doc_id long, n_features long, weight long, score long, rank long")
    beyond = blocks.filter(F.col("range") > last).select(F.explode(F.arrays_zip(*out)).alias("r")).select(*(f"r.{c}" for c in out))
    rest = rows.filter(~wanted).select(*out).unionByName(beyond)
    return ranked.unionByName(rest.withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, share: tuple[int, int] = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of ``docs`` (doc_id, text), drawn by likeness to
    ``target`` (text)."""
    return drawn(scored(docs, target, seed=seed), share, least_words)
