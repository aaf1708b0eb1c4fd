"""N-gram Jaccard join: exact, by a size-aware light and heavy part.

A document is the set of its distinct word shingles; two link when ``den * |x & y| >= num * |x | y|``.

*Light* sets (few shingles): every linked pair shares a subset of at least ``ceil(num/den * n)`` of
either's elements, so all subsets of those sizes are enumerated and hashed; in a subset's group a link to
its smallest member connects all, if the words agree with the number; else the group stays open, as below.
Groups of subsets all of whose shingles are frequent are scanned in parts, as long lists are.

*Heavy* sets: inverted lists over prefixes. In a common order of shingles (rare ones first) a linked
pair shares one of either's first ``n - ceil(num/den * n) + 1``. The lists are scanned as sorted
streams, those of frequent shingles in parts; each member is checked against the list's (or part's) first
member of fitting size and against ``DRAWN`` members drawn by hash, and the parts' first members are one
more list. Where a list then still spans several components, its members are shown to a few of
the others, each in that of its lists which has the largest component, which joins loose groups; and what still lies in
different components of a list is compared by parity bitmaps (which bound the symmetric difference from
below, so they never lose a link) in blocks, the largest component's members with the others only. What
passes is checked on the whole texts. No list is ever expanded into all pairs.

The boundary is the set size that makes the cost of enumerated subsets and scanned list entries least
over the sizes the table has; sets near it are indexed both ways.

"Rare first" comes from counting all shingles of all documents into a fixed number of buckets; a
bucket far above the mean is common. Any order gives the same links, so bucket sharing is harmless.

Equal sets are one node with the smallest doc_id. Node numbers and the shingles that find candidates are
64-bit hashes (of words by :mod:`trackweave.llm.text`, so no words can be built to agree); a candidate pair
links by its shingles' words themselves.

Defined results: a text without words is an empty set and links with nothing; null text is empty; a very
long text is one set of all its shingles; a similarity at the threshold links; a null doc_id never names a
component unless it has no other (then null); rows with equal doc_id but different texts are separate
nodes; an empty table gives no rows; other columns pass by.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackweave.llm import components, store, tally
from trackweave.llm import text as tx
from trackweave.llm.embedding_dedup import groups

WORDS, NUM, DEN = 4, 85, 100
#: Buckets of the shingle counts; bits, least and most, of the set of texts that a check needs (16 a text;
#: beyond some ten million such texts it lets others through too).
COUNT_BUCKETS, LEAST_BITS, MOST_BITS = 1 << 22, 1 << 20, 1 << 27
#: Shingles that a task counts in one go.
COUNT_ROWS = 1 << 20
#: Cost of a list entry in enumerated subsets, for the boundary between light and heavy.
ENTRY_COST = 16.0
#: Rows of a list compared as one block; lists up to SMALL are compared many at a time.
BLOCK, SMALL = 512, 48
#: Members drawn from a list of three or more, that all others are checked against.
DRAWN = 3
#: Members of an open list's block that the block's members of other components are shown to, rounds of it,
#: and members that a list's largest component has to have for it.
SHOWN, SHOWS, LOOSE = 12, 1, 4
#: Members of an open list's largest component from which all lists of that component are compared together.
TOGETHER = 32
#: Occurrences of a shingle's bucket from which its lists are dealt in SALTS parts by the hash of the member.
HOT_LIST, SALTS = 50_000, 64
#: Rows of one list that a scan holds before it hands on what it has.
SCAN_ROWS = 50_000
#: Pairs that a task holds to hand each on once.
HELD_PAIRS = 200_000
#: Bits of a set's parity bitmap, least and most.
BITMAP, MOST_BITMAP = 256, 1 << 16
#: Broadcast bounds: groups of lists that are dealt in blocks (three numbers each).
BROADCAST_GROUPS = 1_000_000


def as_long(x: np.ndarray) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def need(n: int, num: int = NUM, den: int = DEN) -> int:
    """Least overlap that a set of n elements has with any set it links to."""
    return -(-num * n // den)


def subsets(n: int, num: int = NUM, den: int = DEN) -> int:
    """How many subsets a light set of n elements is enumerated into."""
    return sum(math.comb(n, r) for r in range(n - need(n, num, den) + 1))


def boundary(sizes: dict[int, int], num: int = NUM, den: int = DEN) -> int:
    """The largest light size: least total cost over the table's set sizes."""
    best, cost, at = 0.0, 0.0, 0
    for n in range(1, 200):
        light = subsets(n, num, den)
        if light > 1e6:
            break
        cost += sizes.get(n, 0) * (light - ENTRY_COST * (n - need(n, num, den) + 1))
        if cost <= best:
            best, at = cost, n
    return at


def sets_of(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    data, offsets = tx.flat(column)
    for i, j in tx.pieces(offsets):
        h, at = tx.shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            own = np.sort(h[a:b])
            new = np.empty(b - a, bool)
            new[:1] = True
            np.not_equal(own[1:], own[:-1], out=new[1:])
            yield own[new]


def set_key(u: np.ndarray) -> int:
    """A number for the set, whatever the order: its hashes' sum and parity, scrambled."""
    both = int(u.sum(dtype=np.uint64)) ^ (int(np.bitwise_xor.reduce(u)) << 1 if len(u) else 0)
    return _scrambled((both + 0x5851F42D4C957F2D * len(u)) & (1 << 64) - 1)


def _scrambled(x: int) -> int:
    """As ``mix64``, of one number, as a signed one."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> shift) * factor & (1 << 64) - 1
    x ^= x >> 31
    return x - (1 << 64) if x >> 63 else x


def bitmap(u: np.ndarray) -> bytes:
    """Parity of the elements in every bucket of a power of two of buckets, near the set's size."""
    size = min(MOST_BITMAP, max(BITMAP, 1 << (len(u) - 1).bit_length()))
    return np.packbits((np.bincount((u >> tx.U64(7)).astype(np.int64) & (size - 1), minlength=size) & 1).astype(np.uint8)).tobytes()


def folded(map_: bytes, size: int) -> np.ndarray:
    """The bitmap for fewer buckets: halves laid over each other."""
    m = np.frombuffer(map_, np.uint64)
    while len(m) * 64 > size:
        half = len(m) // 2
        m = m[:half] ^ m[half:]
    return m


def surely_apart(differing, total, num: int, den: int):
    """Whether sets of ``total`` elements together that differ in so many or more can't link."""
    return differing * (den + num) > total * (den - num)


# -- pass 1: sets, and counts of all shingles


def _profiles(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNT_BUCKETS, np.uint32)
        shift = tx.U64(64 - (COUNT_BUCKETS - 1).bit_length())
        held, waiting = [], 0
        for b in batches:
            keys, sizes, maps = [], [], []
            for u in sets_of(b.column("text"), words):
                held.append((u >> shift).astype(np.int32))
                waiting += len(u)
                if waiting > COUNT_ROWS:
                    counts += np.bincount(np.concatenate(held), minlength=COUNT_BUCKETS).astype(np.uint32)
                    held, waiting = [], 0
                keys.append(set_key(u) if len(u) else None)
                sizes.append(len(u))
                maps.append(bitmap(u) if len(u) else None)
            yield _row_batch(b.num_rows, doc_id=b.column("doc_id"), text_hash=b.column("text_hash"), n=pa.array(sizes, pa.int64()), key=pa.array(keys, pa.int64()), payload=pa.array(maps, pa.binary()))
        if held:
            counts += np.bincount(np.concatenate(held), minlength=COUNT_BUCKETS).astype(np.uint32)
        parts = tally.slices(counts)
        if parts:
            yield _row_batch(len(parts), slice=pa.array([i for i, _ in parts], pa.int32()), payload=pa.array([p for _, p in parts], pa.binary()))

    rows = docs.withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInArrow(tx.tidy(run), "doc_id bigint, text_hash bigint, n bigint, key bigint, slice int, payload binary")


def _row_batch(rows: int, **cols) -> pa.RecordBatch:
    kinds = {"doc_id": pa.int64(), "text_hash": pa.int64(), "n": pa.int64(), "key": pa.int64(), "slice": pa.int32(), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([cols.get(c, pa.nulls(rows, t)) for c, t in kinds.items()], list(kinds))


#: A list's entries; of a list that is dealt in parts the part's number, from 1, else 0.
ENTRY = "token bigint, salt int, overlap int, n int, node bigint"
FOUND = "kind int, token bigint, a bigint, b bigint"


# -- pass 2: subsets of light sets, prefixes of heavy ones


def _entries(docs: DataFrame, words: int, num: int, den: int, common: np.ndarray, hot: np.ndarray, light: int, subset_bits: int) -> DataFrame:
    packed, packed_hot, salts = np.packbits(common), np.packbits(hot) if hot.any() else None, SALTS
    both_from = need(light + 1, num, den)

    mask = (1 << subset_bits) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_common = np.unpackbits(packed).astype(bool)
        is_hot = None if packed_hot is None else np.unpackbits(packed_hot).astype(bool)
        shift = tx.U64(64 - (COUNT_BUCKETS - 1).bit_length())
        for b in batches:
            tokens, overlap, salt, sizes, keys, seen = [], [], [], [], [], set()
            for u in sets_of(b.column("text"), words):
                n = len(u)
                key = set_key(u) if n else None
                if not n or key in seen:
                    continue
                seen.add(key)
                if n <= light:
                    # a list can't be longer than those of all its shingles
                    cold = u[:0] if is_hot is None else u[~is_hot[(u >> shift).astype(np.int64)]]
                    got = list(_subset_keys(u, need(n, num, den), cold))
                    tokens.append(np.array([t & mask for t, _, _ in got], np.uint64))
                    overlap.append(np.array([c for _, c, _ in got], np.int64))
                    salt.append(np.zeros(len(got), np.int64) if is_hot is None else np.where([w for _, _, w in got], 1 + key % salts, 0))
                    sizes.append((n, len(got)))
                    keys.append(key)
                if n > light or n >= both_from:
                    late = is_common[(u >> shift).astype(np.int64)]
                    prefix = np.concatenate((u[~late], u[late]))[: n - need(n, num, den) + 1]
                    tokens.append(prefix)
                    overlap.append(np.zeros(len(prefix), np.int64))
                    salt.append(np.zeros(len(prefix), np.int64) if is_hot is None else np.where(is_hot[(prefix >> shift).astype(np.int64)], 1 + key % salts, 0))
                    sizes.append((n, len(prefix)))
                    keys.append(key)
            if tokens:
                many = [m for _, m in sizes]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(as_long(np.concatenate(tokens))), pa.array(np.concatenate(salt).astype(np.int32)), pa.array(np.concatenate(overlap).astype(np.int32)), pa.array(np.repeat([n for n, _ in sizes], many).astype(np.int32)), pa.array(np.repeat(np.array(keys, np.int64), many))],
                    ["token", "salt", "overlap", "n", "node"],
                )

    return docs.mapInArrow(tx.tidy(run), ENTRY)


def _subset_keys(u: np.ndarray, least: int, cold: np.ndarray) -> Iterator[tuple[int, int, bool]]:
    """A number and the size of every subset of at least ``least`` elements, and whether it has none that is cold."""
    scrambled = lambda x: [int(v) for v in tx.mix64(x ^ tx.U64(0xA0761D6478BD642F))]
    values, colds = scrambled(u), scrambled(cold)
    whole, n = sum(values), len(values)
    for left_out in range(n - least + 1):
        for out in combinations(values, left_out):
            warm = len(colds) <= left_out and all(c in out for c in colds)
            yield (whole - sum(out) + 0x9E3779B97F4A7C15 * (n - left_out)) % (1 << 64), n - left_out, warm


# -- the scan of the lists


def _scan(num: int, den: int):
    """Over rows sorted by token, salt, overlap, n, node: what links, what has to be checked, what stays open.

    kind 0: nodes a, b are to be checked. 2: node a, of b elements, is in the list of token, which has three
    members or more (two are settled by the check of kind 0) or is one of several parts. 3: node a, of b
    elements, is a first member of a part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        carry = None  # the first member of a list of which a part was handed on
        for b in batches:
            cols = [b.column(c).to_numpy() for c in ("token", "salt", "overlap", "n", "node")]
            if rest is not None:
                cols = [np.concatenate((r, c)) for r, c in zip(rest, cols, strict=True)]
            if not len(cols[0]):
                continue
            new = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])) + 1
            last = int(new[-1]) if len(new) else 0
            if len(cols[0]) - last > SCAN_ROWS:
                out, carry = _lists(cols, carry, num, den, True)
                rest = None
            else:
                rest = [c[last:] for c in cols]
                out, after = _lists([c[:last] for c in cols], carry, num, den, False)
                carry = carry if not last else None
            yield from out
        if rest is not None:
            yield from _lists(rest, carry, num, den, False)[0]

    return run


def _lists(cols: list[np.ndarray], carry, num: int, den: int, goes_on: bool):
    token, salt, overlap, n, node = (c.astype(np.int64) for c in cols)
    if not len(token):
        return [], carry
    rows = np.arange(len(token))
    starts = np.ones(len(token), bool)
    starts[1:] = (token[1:] != token[:-1]) | (salt[1:] != salt[:-1]) | (overlap[1:] != overlap[:-1])
    head = np.maximum.accumulate(np.where(starts, rows, 0))
    fresh = np.ones(len(token), bool)
    fresh[1:] = starts[1:] | (node[1:] != node[:-1])
    continued = carry is not None and carry[:3] == (token[0], salt[0], overlap[0])
    if continued:
        fresh[0] &= node[0] != carry[4]
    run_no = np.cumsum(starts) - 1
    distinct = np.bincount(run_no, weights=fresh).astype(np.int64)
    first_n, first_node = n[head], node[head]
    if continued:
        own = run_no == 0
        first_n[own], first_node[own] = carry[3], carry[5]
        distinct[0] += 3
    members = distinct[run_no]
    # a heavy list's first member hands over where sizes no longer fit
    misfit = (overlap == 0) & (num * n > den * first_n)
    for r in np.unique(run_no[misfit]):
        own = np.flatnonzero((run_no == r) & misfit)
        c_n, c_node = n[own[0]], node[own[0]]
        for i in own:
            if num * n[i] > den * c_n:
                c_n, c_node = n[i], node[i]
            first_n[i], first_node[i] = c_n, c_node
    # besides the list's first member, a few drawn by hash, so that one outlier doesn't leave a list open
    drawn = []
    for k in range(DRAWN):
        h = tx.mix64(node.view(np.uint64) ^ tx.U64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1))
        order = np.lexsort((h, run_no))
        of_run = order[np.searchsorted(run_no[order], np.arange(run_no[-1] + 1))]
        d_node, d_n = node[of_run], n[of_run]
        if continued:
            d_node[0], d_n[0] = carry[6][k]
        drawn.append((d_node, d_n))
    pair = fresh & (node != first_node)
    linked = pair & (overlap > 0) & (den * overlap >= num * (n + first_n - overlap))
    listed = fresh & ((members > 2) | (salt > 0))
    out, stars = [], []
    for c_node, c_n, some in [(first_node, first_n, pair & (overlap == 0)), *((d_node[run_no], d_n[run_no], listed & (overlap == 0)) for d_node, d_n in drawn)]:
        check = some & (node != c_node) & (num * np.maximum(n, c_n) <= den * np.minimum(n, c_n))
        stars.append(np.column_stack((np.minimum(node[check], c_node[check]), np.maximum(node[check], c_node[check]))))
    # of light sets those that a subset links, unless its number is another subset's too
    stars.append(np.column_stack((np.minimum(node[linked], first_node[linked]), np.maximum(node[linked], first_node[linked]))))
    ab = np.unique(np.concatenate(stars), axis=0)
    if len(ab):
        out.append(_scan_batch(0, None, ab[:, 0], ab[:, 1]))
    if listed.any():
        out.append(_scan_batch(2, token[listed], node[listed], n[listed]))
    dealt = salt > 0
    if dealt.any():
        heads = np.unique(np.column_stack((token[dealt], first_node[dealt], first_n[dealt])), axis=0)
        out.append(_scan_batch(3, *np.ascontiguousarray(heads.T)))
    after = (token[-1], salt[-1], overlap[-1], first_n[-1], node[-1], first_node[-1], [(a[-1], b[-1]) for a, b in drawn]) if goes_on else None
    return out, after


def _scan_batch(kind: int, token, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    k = len(a)
    return pa.RecordBatch.from_arrays([pa.array(np.full(k, kind, np.int32)), pa.nulls(k, pa.int64()) if token is None else pa.array(token), pa.array(a), pa.array(b)], ["kind", "token", "a", "b"])


# -- checks of pairs


def _fit(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose bitmaps leave open that they link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y, total in zip(b.column("map_a").to_pylist(), b.column("map_b").to_pylist(), b.column("total").to_pylist(), strict=True):
                size = 8 * min(len(x), len(y))
                keep.append(not surely_apart(int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum()), total, num, den))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda s: classes.select(F.col("key").alias(s), F.col("n").alias(f"n_{s}"), F.col("map").alias(f"map_{s}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", (F.col("n_a") + F.col("n_b")).alias("total"), "map_a", "map_b")
    return rows.mapInArrow(tx.tidy(run), "a bigint, b bigint")


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, words: int, num: int, den: int, parts: int) -> tuple[DataFrame, list[DataFrame]]:
    """The pairs whose texts' sets link, and tables to drop afterwards. Only texts that the pairs may need
    are shuffled.

    The end of a pair that is in more pairs is its centre. Members go to their centres' blocks, of BLOCK
    members each, and each block gets the centre's text once; so a centre of a large group is many tasks.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count("*").alias("many"))
    wanted = store.written(ends.join(classes.select("key", "text_hash"), "key"), "wanted", few=True)
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * max(1, wanted.count()) - 1).bit_length()))
    asked = tally.members(wanted, "text_hash", size)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            h = b.column("text_hash").to_numpy()
            at = np.flatnonzero((asked[(h & (size - 1)) >> 3] >> (7 - (h & 7)).astype(np.uint8)) & 1)
            rows = []
            for i in at.tolist():
                if h[i] not in seen:
                    seen.add(h[i])
                    rows.append(i)
            yield b.take(pa.array(rows, pa.int64()))

    found = docs.select(F.xxhash64("text").alias("text_hash"), "text").mapInArrow(tx.tidy(fetch), "text_hash bigint, text string")
    texts = store.written(found.join(wanted.select("key", "text_hash"), "text_hash").groupBy("key").agg(F.first("text").alias("text")), "texts", few=True)

    side = lambda s: wanted.select(F.col("key").alias(s), F.col("many").alias(f"many_{s}"))
    turned = pairs.join(side("a"), "a").join(side("b"), "b")
    turn = F.col("many_a") >= F.col("many_b")
    turned = turned.select(F.when(turn, F.col("a")).otherwise(F.col("b")).alias("centre"), F.when(turn, F.col("b")).otherwise(F.col("a")).alias("member"), F.ceil(F.greatest("many_a", "many_b") / BLOCK).cast("int").alias("blocks"))
    turned = turned.withColumn("block", F.pmod(F.hash("member"), F.col("blocks")))
    heads = turned.select("centre", "block").distinct().join(texts, F.col("centre") == F.col("key")).select("centre", "block", F.lit(0).alias("kind"), F.col("centre").alias("member"), "text")
    others = turned.join(texts, F.col("member") == F.col("key")).select("centre", "block", F.lit(1).alias("kind"), "member", "text")
    dealt = heads.unionByName(others).repartition(parts, "centre", "block").sortWithinPartitions("centre", "block", "kind", "member")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None  # the centre's text that goes on
        for b in batches:
            kind, centre, member = (b.column(c).to_numpy() for c in ("kind", "centre", "member"))
            column = b.column("text").cast(pa.large_string())
            keep = np.zeros(b.num_rows, bool)
            for i, j in tx.pieces(tx.flat(column)[1]):
                sets = tx.exact_shingles(pa.concat_arrays([pa.array([head], pa.large_string()), column.slice(i, j - i)]), words)
                own = np.maximum.accumulate(np.where(kind[i:j] == 0, np.arange(1, j - i + 1), 0))
                for k in np.flatnonzero(kind[i:j] == 1).tolist():
                    x, y = sets[own[k]], sets[k + 1]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep[i + k] = den * both >= num * (len(x) + len(y) - both)
                if own[-1]:
                    head = column[i + int(own[-1]) - 1].as_py()
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(centre, member)[keep]), pa.array(np.maximum(centre, member)[keep])], ["a", "b"])

    return dealt.mapInArrow(tx.tidy(compare), "a bigint, b bigint"), [wanted, texts]


def _open_members(lists: DataFrame, found: DataFrame, classes: DataFrame, once: bool = False) -> DataFrame:
    """The members of lists that span several components: token, a, n, component; and of each list
    ``members``, ``giant``, its largest component, and how many members that has (``inside``).

    With ``once`` each member comes in one of its lists only, the one with the largest component, and
    only if that has LOOSE members or more.
    """
    known = lists.join(found.select(F.col("node").alias("a"), "component"), "a", "left").withColumn("component", F.coalesce("component", "a"))
    counts = known.groupBy("token", "component").agg(F.count("*").alias("k")).groupBy("token").agg(F.sum("k").alias("members"), F.count("*").alias("spans"), F.max(F.struct("k", "component")).alias("top"))
    open_ = counts.filter((F.col("spans") > 1) & (F.col("top.k") >= (LOOSE if once else 0))).select("token", "members", F.col("top.component").alias("giant"), F.col("top.k").alias("inside"))
    rows = known.join(open_, "token")
    if once:
        rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.col("inside").desc(), F.col("members").desc(), "token"))).filter("r = 1").drop("r")
    return rows.select("token", "a", "n", "component", "members", "giant", "inside")


def _with_maps(rows: DataFrame, classes: DataFrame) -> DataFrame:
    return rows.join(classes.select(F.col("key").alias("a"), "map"), "a")


def _to_some(members: DataFrame, classes: DataFrame, parts: int, num: int, den: int, draw: int) -> tuple[DataFrame, list[DataFrame]]:
    """Pairs of each member with SHOWN members of its list's block, drawn by hash, of other components, and tables to drop afterwards."""
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    rows = _with_maps(members.withColumn("own", F.pmod(F.hash("a"), blocks)), classes).select("token", "own", "a", "n", "component", "map")
    dealt = rows.repartition(parts, "token", "own").sortWithinPartitions("token", "own", "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        count = 0
        for g in groups(batches, ["token", "own"]):
            node, n, comp = (g.column(c).to_numpy() for c in ("a", "n", "component"))
            maps = g.column("map").to_pylist()
            sizes = np.array([8 * len(m) for m in maps])
            h = tx.mix64(node.view(np.uint64) ^ tx.U64(0xD6E8FEB86659FD93 + draw))
            for i in np.argsort(h)[:SHOWN]:
                near = (sizes == sizes[i]) | (sizes == 2 * sizes[i]) | (2 * sizes == sizes[i])
                other = np.flatnonzero(near & (comp != comp[i]) & (num * np.maximum(n, n[i]) <= den * np.minimum(n, n[i])))
                if not len(other):
                    continue
                least = int(min(sizes[i], sizes[other].min()))
                mine = folded(maps[i], least)
                differing = np.bitwise_count(np.stack([folded(maps[k], least) for k in other]) ^ mine).sum(axis=1).astype(np.int64)
                other = other[~surely_apart(differing, n[other] + n[i], num, den)]
                if len(other):
                    held.append(np.column_stack((np.minimum(node[other], node[i]), np.maximum(node[other], node[i]))))
                    count += len(other)
            if count > 20_000:
                yield _pair_batch(held)
                held, count = [], 0
        if held:
            yield _pair_batch(held)

    return dealt.mapInArrow(tx.tidy(run), "a bigint, b bigint"), []


def _across(members: DataFrame, classes: DataFrame, parts: int, num: int, den: int) -> tuple[DataFrame, list[DataFrame]]:
    """Pairs of members of one list and different components that their bitmaps leave open, and tables to
    drop afterwards.

    Lists with the same largest component, if it is large, have mostly the same members; they are dealt
    out alike, list after list in one task, which hands on a pair once. A list above BLOCK members is dealt
    out as pairs of blocks, by the hash of the member. Its largest component has blocks of its own, which
    only meet those of the other members.
    """
    members = store.written(members.withColumn("group", F.when(F.col("inside") >= TOGETHER, F.xxhash64(F.col("giant"))).otherwise(F.col("token"))), "members")
    widest = members.groupBy("group").agg(F.max("members").alias("most"), F.max(F.col("members") - F.col("inside")).alias("others"), F.max("inside").alias("giants")).filter(F.col("most") > BLOCK)
    widest = store.written(widest.select("group", F.ceil(F.col("others") / BLOCK).cast("int").alias("apart"), F.ceil(F.col("giants") / BLOCK).cast("int").alias("of_giant")), "widest", few=True)
    few = widest.count() <= BROADCAST_GROUPS
    rows = members.join(F.broadcast(widest) if few else widest, "group", "left")
    rows = rows.withColumns({"in_giant": F.col("apart").isNotNull() & (F.col("component") == F.col("giant")), "apart": F.coalesce("apart", F.lit(1)), "of_giant": F.coalesce("of_giant", F.lit(0))})
    own = F.when(F.col("in_giant"), F.col("apart") + F.pmod(F.hash("a"), F.col("of_giant"))).otherwise(F.pmod(F.hash("a"), F.col("apart")))
    last = F.when(F.col("in_giant"), F.col("apart") - 1).otherwise(F.col("apart") + F.col("of_giant") - 1)
    rows = _with_maps(rows.withColumn("own", own).withColumn("last", last).select("group", "token", "own", "last", "a", "n", "component"), classes)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    rows = rows.select("group", "token", (F.least("own", "other").cast("long") * (1 << 31) + F.greatest("own", "other")).alias("pair"), "own", "a", "n", "component", "map")
    dealt = rows.repartition(parts, "group", "pair").sortWithinPartitions("group", "pair", "token", "a").drop("group")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        count = 0
        for small, g in _runs(batches):
            pairs = _small_lists(g, num, den) if small else _large_list(g, num, den)
            held.append(pairs)
            count += len(pairs)
            if count > HELD_PAIRS:
                held = [np.unique(np.concatenate(held), axis=0)]
                count = len(held[0])
                if 2 * count > HELD_PAIRS:
                    yield _pair_batch(held)
                    held, count = [], 0
        if count:
            yield _pair_batch(held)

    return dealt.mapInArrow(tx.tidy(run), "a bigint, b bigint"), [members, widest]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.Table]]:
    """Whole lists (or pairs of blocks) from sorted batches: many of at most SMALL members, or a larger one."""
    rest: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b] if rest is None else [*rest.to_batches(), b])
        token, pair = (t.column(c).to_numpy() for c in ("token", "pair"))
        cuts = np.flatnonzero((token[1:] != token[:-1]) | (pair[1:] != pair[:-1])) + 1
        last = int(cuts[-1]) if len(cuts) else 0
        yield from _by_size(t.slice(0, last), np.concatenate(([0], cuts)))
        rest = t.slice(last)
    if rest is not None and rest.num_rows:
        yield rest.num_rows <= SMALL, rest


def _by_size(t: pa.Table, cuts: np.ndarray) -> Iterator[tuple[bool, pa.Table]]:
    sizes = np.diff(cuts)
    small = np.repeat(sizes <= SMALL, sizes)
    if small.any():
        yield True, t.filter(pa.array(small))
    for k in np.flatnonzero(sizes > SMALL).tolist():
        yield False, t.slice(int(cuts[k]), int(sizes[k]))


NO_PAIRS = np.zeros((0, 2), np.int64)


def _ordered(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.column_stack((np.minimum(x, y), np.maximum(x, y)))


def _small_lists(t: pa.Table, num: int, den: int) -> np.ndarray:
    """The open pairs of many whole lists, each row with the row k after it, for every k that lists reach."""
    token, pair, node, n, comp, own = (t.column(c).to_numpy() for c in ("token", "pair", "a", "n", "component", "own"))
    data, offsets = tx.flat(t.column("map"))
    size = np.diff(offsets)
    least = np.zeros((len(node), BITMAP // 64), np.uint64)
    for s in np.unique(size):
        rows = np.flatnonzero(size == s)
        m = np.ascontiguousarray(data[offsets[rows][:, None] + np.arange(s)]).view(np.uint64)
        while m.shape[1] > BITMAP // 64:
            m = m[:, : m.shape[1] // 2] ^ m[:, m.shape[1] // 2 :]
        least[rows] = m
    # blocks of different numbers stand for a pair of blocks, whose members meet across only
    cross = (pair >> 31) != (pair & (1 << 31) - 1)
    out = []
    for k in range(1, SMALL):
        i = np.flatnonzero((token[k:] == token[:-k]) & (pair[k:] == pair[:-k]))
        if not len(i):
            break
        j = i + k
        fits = (comp[i] != comp[j]) & (num * np.maximum(n[i], n[j]) <= den * np.minimum(n[i], n[j])) & (~cross[i] | (own[i] != own[j]))
        i, j = i[fits], j[fits]
        fits = ~surely_apart(np.bitwise_count(least[i] ^ least[j]).sum(axis=1).astype(np.int64), n[i] + n[j], num, den)
        i, j = i[fits], j[fits]
        wide = np.flatnonzero(np.minimum(size[i], size[j]) * 8 > BITMAP)
        if len(wide):
            keep = np.ones(len(i), bool)
            for q in wide.tolist():
                x, y = (data[offsets[r] : offsets[r + 1]].tobytes() for r in (i[q], j[q]))
                bits = 8 * min(len(x), len(y))
                keep[q] = not surely_apart(int(np.bitwise_count(folded(x, bits) ^ folded(y, bits)).sum()), int(n[i[q]] + n[j[q]]), num, den)
            i, j = i[keep], j[keep]
        out.append(_ordered(node[i], node[j]))
    return np.concatenate(out) if out else NO_PAIRS


def _large_list(t: pa.Table, num: int, den: int) -> np.ndarray:
    """The open pairs of one list, or of one pair of its blocks."""
    node, n, comp, own = (t.column(c).to_numpy() for c in ("a", "n", "component", "own"))
    pair = t.column("pair")[0].as_py()
    cross = pair >> 31 != pair & (1 << 31) - 1
    maps = t.column("map").to_pylist()
    sizes = np.array([8 * len(m) for m in maps])
    out = []
    for s in np.unique(sizes):
        rows = np.flatnonzero((sizes == s) | (sizes == 2 * s))
        m = np.stack([folded(maps[i], int(s)) for i in rows])
        small = sizes[rows] == s
        for i in range(len(rows)):
            r = rows[i]
            j = np.flatnonzero((small | small[i]) & (np.arange(len(rows)) > i) & (comp[rows] != comp[r]))
            if cross:
                j = j[own[rows[j]] != own[r]]
            other = rows[j]
            fits = num * np.maximum(n[other], n[r]) <= den * np.minimum(n[other], n[r])
            fits[fits] &= ~surely_apart(np.bitwise_count(m[j[fits]] ^ m[i]).sum(axis=1).astype(np.int64), (n[other] + n[r])[fits], num, den)
            out.append(_ordered(node[other[fits]], np.full(int(fits.sum()), node[r])))
    return np.concatenate(out) if out else NO_PAIRS


def _pair_batch(held: list[np.ndarray]) -> pa.RecordBatch:
    ab = np.unique(np.concatenate(held), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], ["a", "b"])


def jaccard_components(docs: DataFrame, words: int = WORDS, num: int = NUM, den: int = DEN, subset_bits: int = 64) -> DataFrame:
    """doc_id, n_shingles, component_id of every row (see the module's text).

    Also ``component``, a number of the component that exists without any doc_id (null for empty sets),
    and ``text_hash``, which tells apart texts of equal doc_id. Subsets are numbered by ``subset_bits``
    bits; fewer make more candidates and no other links.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = store.partitions_for(docs)
    profiles = store.written(_profiles(docs, words), "profiles")
    rows = profiles.filter("slice is null")
    counts = tally.counts(profiles.filter("slice is not null"), COUNT_BUCKETS)
    mean = float(counts.mean())
    common, hot = counts > mean + 8 * math.sqrt(mean) + 24, counts > HOT_LIST
    classes = store.written(rows.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("payload").alias("map"), F.min("text_hash").alias("text_hash")), "classes", few=True)
    sizes = {r["n"]: r["count"] for r in classes.filter("n < 200").groupBy("n").count().collect()}
    light = boundary(sizes, num, den)

    scanned = lambda rows: rows.repartition(parts, "token", "salt").sortWithinPartitions("token", "salt", "overlap", "n", "node").mapInArrow(tx.tidy(_scan(num, den)), FOUND)
    scan = store.written(scanned(_entries(docs, words, num, den, common, hot, light, subset_bits)), "scan")
    pairs = scan.filter("kind = 0").select("a", "b")
    if hot.any():
        heads = scan.filter("kind = 3").select("token", F.lit(0).alias("salt"), F.lit(0).alias("overlap"), F.col("b").cast("int").alias("n"), F.col("a").alias("node")).distinct()
        pairs = pairs.unionByName(scanned(heads).filter("kind = 0").select("a", "b"))
    checked = store.written(_fit(pairs.distinct(), classes, num, den), "checked", few=True)
    links, used = _verified(checked, classes, docs, words, num, den, parts)
    links = store.written(links, "links", few=True)
    found = components.components(links)
    spent = [*used, links]

    lists = store.written(scan.filter("kind = 2").select("token", "a", F.col("b").alias("n")), "lists", few=True)
    store.drop(scan)
    tried, done = checked, [checked, lists]
    # members that no centre took are shown to some of the other components, and what is left to all
    for turn in range(SHOWS + 1):
        members = _open_members(lists, found, classes, turn < SHOWS)
        pairs, used = _to_some(members, classes, parts, num, den, turn) if turn < SHOWS else _across(members, classes, parts, num, den)
        pairs = pairs.distinct().join(tried, ["a", "b"], "left_anti")
        more = store.written(_fit(pairs, classes, num, den), "more", few=True)
        spent += used
        if more.isEmpty():
            continue
        tried = tried.unionByName(more)
        late, used = _verified(more, classes, docs, words, num, den, parts)
        late = store.written(late, "links", few=True)
        spent += [*used, late, found]
        done.append(more)
        found = components.components(late.unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b"))))
        for table in spent:
            store.drop(table)
        spent = []
    for table in [*done, *spent]:
        store.drop(table)
    nodes = classes.select("key", "least").join(found.select(F.col("node").alias("key"), "component"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    names = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = nodes.join(names, "component").select("key", "component", "component_id")
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), "key", "text_hash").join(named, "key", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "component", "text_hash")


def one_of_each(docs: DataFrame, words: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """``docs`` with one document of each component: the one of least doc_id (nulls last). Empty sets stay."""
    found = store.written(jaccard_components(docs, words, num, den).select("doc_id", "component", "text_hash"), "components", few=True)
    place = F.row_number().over(Window.partitionBy("component").orderBy(F.col("doc_id").asc_nulls_last(), "text_hash"))
    firsts = found.filter(F.col("component").isNotNull()).withColumn("place", place).filter("place = 1").drop("place")
    kept = firsts.unionByName(found.filter(F.col("component").isNull()).distinct()).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("component").isNotNull().alias("_single"))
    rows = docs.withColumn("_text", F.xxhash64(F.col("text").cast("string")))
    joined = rows.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_hash")))
    if not found.groupBy("doc_id", "text_hash").count().filter("count > 1").isEmpty():
        again = F.row_number().over(Window.partitionBy("_id", "_hash").orderBy(F.lit(0)))
        joined = joined.withColumn("_again", again).filter((F.col("_again") == 1) | ~F.col("_single"))
    return joined.select(*(f"`{c}`" for c in docs.columns))
