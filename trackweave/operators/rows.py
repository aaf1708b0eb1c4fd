"""Order-aware row operators: first wins, last wins, runs, running sums."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by order; nulls in a key equal each other. Ranked before the shuffle too."""
    return _ranked(df, keys, [F.col(c).asc() for c in order])


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return _ranked(df, keys, [F.col(c).desc() for c in order])


def _ranked(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rank = 1").drop("_rank")


def drop_consecutive(df: DataFrame, line: list[str], order: list[str], values: list[str], long: bool = False) -> DataFrame:
    """Without rows that repeat the row before them on their line (null equals null). ``long``: lines may be
    longer than a task holds."""
    if long:
        marked = before(spread(df, line, order), line, order, {f"_l_{v}": v for v in values})
        again = ~F.col("_first") & F.struct(*(F.col(f"_l_{v}").alias(v) for v in values)).eqNullSafe(F.struct(*values))
        return marked.filter(~again).select(*df.columns)
    w = Window.partitionBy(*line).orderBy(*order)
    last, now = F.struct(*(F.lag(v).over(w).alias(v) for v in values)), F.struct(*values)
    marked = df.withColumn("_again", (F.row_number().over(w) > 1) & last.eqNullSafe(now))
    return marked.filter(~F.col("_again")).drop("_again")


def with_next(df: DataFrame, line: list[str], order: list[str], columns: dict[str, str]) -> DataFrame:
    """Adjacent pairs: each named column's value on the next row of the line; the last row of a line has none."""
    w = Window.partitionBy(*line).orderBy(*order)
    return df.withColumns({new: F.lead(old).over(w) for new, old in columns.items()}).withColumn("has_next", F.lead(F.lit(True)).over(w).isNotNull())


def running_sum(value: Column, line: list[str], order: list[str]) -> Column:
    return F.sum(value).over(Window.partitionBy(*line).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def first_seen(df: DataFrame, keys: list[str], columns: list[str], order: str, **more: Column) -> DataFrame:
    """One row a key with the values of its first row, and further aggregates by name. ``order`` is unique."""
    picked = F.min_by(F.struct(*columns), F.col(order)).alias("_first")
    rows = df.groupBy(*keys).agg(picked, F.min(order).alias("first_pos"), *(c.alias(name) for name, c in more.items()))
    return rows.select(*keys, *(F.col(f"_first.{c}").alias(c) for c in columns), "first_pos", *more)


# -- lines longer than a task


def spread(df: DataFrame, line: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """``df`` with ``_block``: ranges of (line, order) of about equal size, numbered in that order; written.

    A line then lies in one block or in several after one another, so windows over (line, block) are bounded
    whatever a line's length. :func:`before` and :func:`running` carry one row a border. ``order`` tells
    the rows of a line apart; keys of lines aren't null.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(df.repartitionByRange(parts, *line, *order).withColumn("_block", F.spark_partition_id()))


def _in_block(line: list[str], order: list[str]):
    return Window.partitionBy(*line, "_block").orderBy(*order)


def before(blocks: DataFrame, line: list[str], order: list[str], columns: dict[str, str]) -> DataFrame:
    """Spread rows with the named columns of the row before them on their line; ``_first`` where there is none."""
    w = _in_block(line, order)
    last = blocks.groupBy(*line, "_block").agg(F.max_by(F.struct(*columns.values()), F.struct(*order)).alias("_last"))
    over = last.select(*line, "_block", F.lag("_last").over(Window.partitionBy(*line).orderBy("_block")).alias("_carried"))
    rows = blocks.join(over, [*line, "_block"]).withColumn("_place", F.row_number().over(w))
    values = {new: F.when(F.col("_place") == 1, F.col(f"_carried.{old}")).otherwise(F.lag(old).over(w)) for new, old in columns.items()}
    first = (F.col("_place") == 1) & F.col("_carried").isNull()
    return rows.withColumns(values | {"_first": first}).drop("_carried", "_place")


def running(blocks: DataFrame, value: Column, line: list[str], order: list[str], name: str) -> DataFrame:
    """Spread rows with ``name``, the sum of ``value`` (not null) from the line's start to the row."""
    rows = blocks.withColumn("_value", value)
    sums = rows.groupBy(*line, "_block").agg(F.sum("_value").alias("_sum"))
    earlier = F.sum("_sum").over(Window.partitionBy(*line).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    based = sums.select(*line, "_block", earlier.alias("_base"))
    inside = F.sum("_value").over(_in_block(line, order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(based, [*line, "_block"]).withColumn(name, F.coalesce("_base", F.lit(0)) + inside).drop("_base", "_value")


# -- tables


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the checkpoint folder of the session; a local session without one gets a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        found = context.getConf().get("spark.checkpoint.dir")
        if not found and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        context.setCheckpointDir(found or tempfile.mkdtemp(prefix="trackweave-"))
    return f"{context.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows as a table in the checkpoint folder.

    A table rather than a checkpoint: a checkpoint hands on what the optimizer has inferred about its
    columns, which in loops of joins grows from round to round.
    """
    path = shared_path(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free(df: DataFrame) -> None:
    """Deletes the files of a table made by :func:`cut_lineage` once nothing reads it any more."""
    context = df.sparkSession.sparkContext
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        if "/rows-" in folder:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
