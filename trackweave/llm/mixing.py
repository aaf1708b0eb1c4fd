"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in seeded random order, gone through up to three times. A copy's
virtual finish time is the source's cumulative words up to and including it, divided by the source's
target. All copies stand in one order, by finish time (equal ones by source), and are taken until the
total budget is spent, so at any point every source has had its share. The copy that crosses the budget
is taken if the total comes nearer to the budget with it than without.

Targets: the budget is split by weight (5, 2, 1, repeating over the sources by code point, null last);
a target stops at three times its source's size and the excess is shared again by weight.

Texts are read once, for sizes; everything after that is over a table of one narrow row a document (rows
equal in doc_id, source and text share one). Cumulative sums never gather a source in one task: rows are
cut into blocks of their key, block sums are accumulated over a table with one row a block, and a window
runs inside each block only. The cut is searched in a histogram of finish times, whose buckets are summed
in the executors, until few enough copies are left to look at one by one; so it is exact. In a source
every document has either ``full`` copies or one more, and those with more come first in its queue, so
one key a source, the last of them, tells which document of a table has how many: no text is shuffled.

Defined results: null text has size 0; a document of size 0 is never taken; a very long text is one
document like others, taken whole or not; null is a source of its own, and so is each other value; ties
are in the order of the key, a digest of seed, doc_id and text, and of equal rows any may be the one with
the further copy; an empty table gives no rows; other columns pass by. Reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackweave.llm import store

WEIGHTS = (5.0, 2.0, 1.0)
MOST_REPEATS = 3
SEED = 7_919
#: Rows of a block, on average; a block is what one window frame holds at once.
BLOCK_ROWS = 4_096
#: Sources up to which their table (a name and some numbers each) is broadcast.
BROADCAST_ROWS = 100_000
BUCKETS = 1_024
#: Copies that the driver looks at one by one (three numbers each).
FEW = 4_096
OWN = ("source_size", "target", "copies", "_key", "_source", "_m", "_n", "_rank", "_full", "_edge", "_some", "_all", "_i", "_s", "_p")
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def key_of(text: str, seed: int) -> Column:
    """A random but repeatable place in the queue, as 32 hexadecimal digits."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")))))


def queue_items(docs: DataFrame, text: str = "text", seed: int = SEED) -> DataFrame:
    """doc_id, _source, _key, size and _m, how many rows are like this one. One scan of the texts."""
    rows = docs.select("doc_id", F.col("source").cast("string").alias("_source"), key_of(text, seed).alias("_key"), word_count(text).alias("size"))
    return rows.groupBy("doc_id", "_source", "_key", "size").agg(F.count("*").alias("_m"))


def targets(items: DataFrame, weights: tuple[float, ...] = WEIGHTS, most_repeats: int = MOST_REPEATS, budget_share: float = 1.0) -> DataFrame:
    """One row a source: _source, _rank by code point, _n rows, source_size, target.

    Sources fill up in the order of ``most / weight``; the level is what is left, over the weights left,
    when the next one in that order wouldn't fill up. One task sorts the table of sources, never documents.
    """
    sizes = items.groupBy("_source").agg(F.sum(F.col("size") * F.col("_m")).alias("source_size"), F.count("*").alias("_n"))
    rank = F.row_number().over(Window.orderBy(F.col("_source").isNull(), "_source")) - 1
    rows = sizes.withColumn("_rank", rank).withColumn("w", F.get(F.array(*map(F.lit, weights)), F.pmod(F.col("_rank"), F.lit(len(weights)))))
    rows = rows.withColumn("most", F.col("source_size") * most_repeats)
    by_fill = Window.orderBy(F.col("most") / F.col("w"), "_rank")
    whole = Window.partitionBy(F.lit(0))
    rows = rows.withColumns({"spent": F.coalesce(F.sum("most").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "weights": F.sum("w").over(by_fill.rowsBetween(0, Window.unboundedFollowing)), "budget": F.sum("source_size").over(whole) * F.lit(budget_share)})
    rows = rows.withColumn("level", (F.col("budget") - F.col("spent")) / F.col("weights"))
    rows = rows.withColumn("fills", F.col("level") * F.col("w") > F.col("most"))
    rows = rows.withColumn("level", F.min(F.when(~F.col("fills"), F.struct(F.col("most") / F.col("w"), "_rank", "level"))).over(whole)["level"])
    return rows.select("_source", "_rank", "_n", "source_size", F.when(F.col("fills"), F.col("most").cast("double")).otherwise(F.col("w") * F.col("level")).alias("target"))


def queued(items: DataFrame, goals: DataFrame, few_sources: bool) -> DataFrame:
    """``items`` with their source's numbers and ``before``: the source's words ahead of the row."""
    goals = goals.withColumnRenamed("_source", "_goal")
    rows = items.join(F.broadcast(goals) if few_sources else goals, F.col("_source").eqNullSafe(F.col("_goal"))).drop("_goal")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("_n") / BLOCK_ROWS))
    # the first 32 bits of the key, so blocks follow each other as keys do
    rows = rows.withColumn("_block", F.floor(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") / F.lit(2.0**32) * blocks).cast("int"))
    words = F.col("size") * F.col("_m")
    sums = rows.groupBy("_rank", "_block").agg(F.sum(words).alias("_words"))
    base = F.coalesce(F.sum("_words").over(Window.partitionBy("_rank").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sums.select("_rank", "_block", base.alias("_base"))
    inside = F.coalesce(F.sum(words).over(Window.partitionBy("_rank", "_block").orderBy("_key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_inside", inside).join(bases, ["_rank", "_block"]).withColumn("before", F.col("_base") + F.col("_inside")).drop("_block", "_base", "_inside")


def finish(epoch: Column, i: Column) -> Column:
    """Virtual finish time of the i-th of a row's likes in the given pass over its source."""
    return (epoch * F.col("source_size") + F.col("before") + i * F.col("size")).cast("double") / F.col("target")


def cutoff(queue: DataFrame, budget: float, most_repeats: int = MOST_REPEATS) -> tuple[float, int, bool] | None:
    """Finish time and source's rank of the copy at which the budget runs out, and whether it is taken.

    None where all copies fit. Each step hands the driver one row a bucket. Bucket numbers only fall or
    rise with the time, so equal times are never parted; where one bucket holds a single time, sources
    are told apart by rank, and a source has one copy at a time.
    """
    pending = queue.filter((F.col("target") > 0) & (F.col("size") > 0))
    epochs = F.sequence(F.lit(0).cast("long"), F.lit(most_repeats - 1).cast("long"))
    copies = pending.select("*", F.explode(epochs).alias("e")).select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_m"))).alias("i"))
    rest = copies.select("size", F.col("_rank").cast("long").alias("rank"), finish(F.col("e"), F.col("i")).alias("time"))
    spent, column, low, high = 0, "time", 0.0, 2.0
    while True:
        width = max((high - low) / BUCKETS, 5e-324)
        bucket = F.greatest(F.lit(0), F.least(F.lit(BUCKETS - 1), F.floor((F.col(column) - F.lit(low)) / F.lit(width)))).cast("int")
        sums = rest.groupBy(bucket.alias("k")).agg(F.sum("size").alias("words"), F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()
        for r in sorted(sums, key=lambda r: r["k"]):
            if spent + r["words"] > budget:
                break
            spent += r["words"]
        else:
            return None
        rest, low, high = rest.filter(bucket == r["k"]), float(r["low"]), float(r["high"])
        if r["n"] <= FEW:
            break
        if low == high:
            column, low, high = "rank", 0.0, float(rest.agg(F.max("rank")).first()[0])
    for r in sorted(rest.collect(), key=lambda r: (r["time"], r["rank"])):
        if spent + r["size"] > budget:
            return r["time"], r["rank"], spent + r["size"] - budget < budget - spent
        spent += r["size"]
    return None


def _taken(queue: DataFrame, cut: tuple[float, int, bool] | None, most_repeats: int) -> Column:
    """Copies of the row that are taken, one row for each of its likes (``_i``)."""
    fits = (F.col("target") > 0) & (F.col("size") > 0)
    if cut is None:
        return F.when(fits, F.lit(most_repeats)).otherwise(0)
    time, rank, too = cut
    passes = []
    for e in range(most_repeats):
        own = finish(F.lit(e), F.col("_i"))
        edge = F.col("_rank") <= rank if too else F.col("_rank") < rank
        passes.append(F.when((own < time) | ((own == time) & edge), 1).otherwise(0))
    return F.when(fits, sum(passes[1:], passes[0])).otherwise(0)


def planned(docs: DataFrame, text: str = "text", weights: tuple[float, ...] = WEIGHTS, most_repeats: int = MOST_REPEATS, seed: int = SEED, budget_share: float = 1.0) -> DataFrame:
    """One row for each row of ``docs``, without texts: doc_id, size, source_size, target, copies, and
    internal columns that :func:`mix` needs."""
    items = store.written(queue_items(docs, text, seed), "items")
    goals = store.written(targets(items, weights, most_repeats, budget_share), "goals", few=True)
    about = goals.agg(F.count("*").alias("n"), F.sum("source_size").alias("size")).first()
    queue = store.written(queued(items, goals, about["n"] <= BROADCAST_ROWS), "queue")
    store.drop(items)
    total = int(about["size"] or 0)
    cut = cutoff(queue, min(budget_share * total, most_repeats * total), most_repeats)
    each = queue.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_m"))))
    return each.withColumn("copies", _taken(each, cut, most_repeats).cast("int")).drop("before", "_n")


def mix(docs: DataFrame, text: str = "text", weights: tuple[float, ...] = WEIGHTS, most_repeats: int = MOST_REPEATS, seed: int = SEED, budget_share: float = 1.0) -> DataFrame:
    """``docs`` with source_size, target and copies: how often the mix takes the document. No text is shuffled."""
    columns = [c for c in docs.columns if c not in OWN]
    plan = planned(docs, text, weights, most_repeats, seed, budget_share)
    taken = plan.filter("size > 0").groupBy("_source", "source_size", "target").agg(F.min("copies").alias("_full"), F.max("copies").alias("_top"), F.max(F.struct("copies", "_key")).alias("_last"))
    edge = F.when(F.col("_top") > F.col("_full"), F.col("_last._key"))
    taken = taken.select(F.col("_source").alias("_s"), "source_size", "target", "_full", edge.alias("_edge"))
    # of rows that are alike, the last in a queue may be taken in part
    parts = plan.filter("_m > 1 AND size > 0").groupBy("_source", "_key").agg(F.min("copies").alias("a"), F.max("copies").alias("b"), F.sum(F.col("copies")).alias("c"), F.count("*").alias("n")).filter("a < b")
    parts = parts.select(F.col("_source").alias("_s"), (F.col("c") - F.col("a") * F.col("n")).alias("_some"))
    taken = store.written(taken.join(parts.withColumnRenamed("_s", "_p"), F.col("_s").eqNullSafe(F.col("_p")), "left").drop("_p"), "taken", few=True)
    few = taken.count() <= BROADCAST_ROWS
    rows = docs.select(*(f"`{c}`" for c in columns), key_of(text, seed).alias("_key")).join(F.broadcast(taken) if few else taken, F.col("source").cast("string").eqNullSafe(F.col("_s")), "left")
    more = F.when(F.col("_key") <= F.col("_edge"), 1).otherwise(0)
    worded = F.coalesce(F.col(text).cast("string").rlike(WORD), F.lit(False)) & F.col("_full").isNotNull()
    out = [*(F.col(f"`{c}`") for c in columns), "source_size", "target"]
    split = F.coalesce(worded & F.col("_some").isNotNull() & (F.col("_key") == F.col("_edge")), F.lit(False))
    found = rows.filter(~split).select(*out, F.when(worded, F.col("_full") + more).otherwise(0).cast("int").alias("copies"))
    if taken.filter("_some IS NOT NULL").isEmpty():
        return found
    alike = rows.filter(split).groupBy(*(f"`{c}`" for c in columns), "source_size", "target", "_full", "_some").agg(F.count("*").alias("_all"))
    ahead = F.coalesce(F.sum("_all").over(Window.partitionBy("source").orderBy(*(F.col(f"`{c}`") for c in columns)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    alike = alike.withColumn("_some", F.col("_some") - ahead).withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_all"))))
    return found.unionByName(alike.select(*out, (F.col("_full") + F.when(F.col("_i") <= F.col("_some"), 1).otherwise(0)).cast("int").alias("copies")))
