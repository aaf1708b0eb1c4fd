"""Chat formatting: the turns of a conversation as one training text with a loss mask.

Spark expressions only. The turns of a conversation are collected as structs and sorted; runs of one
role become blocks by array functions; the blocks are concatenated. A block is

    [INST]role[/INST]text</s>        or, of several turns, [INST]role[/INST]text<s>text</s>

and what stands in a role or text and looks like one of the four control strings gets a backslash behind
its bracket (one more if it has some already), so that reading is exact: :func:`turns_of` gives back role
and text of every row, the turns of merged blocks one by one.

The mask says which code points of the text a loss is taken of: the texts of the role ``LOSS``, as they
stand there (with their backslashes), without anything between them.

Defined results: a null role or text is an empty one; rows of one turn stand by role, then text, a null
turn before all; repeated rows are turns of their own; rows whose conv_id is null are one conversation;
an empty table gives no rows; other columns pass by. A conversation is one row of the result, so it has
to fit into one text (2 GB); texts of many conversations never meet in a task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The control strings.
OPEN, CLOSE, MORE, END = "[INST]", "[/INST]", "<s>", "</s>"
LOSS = "assistant"
#: Lengths that are summed together before sums of sums.
BLOCK = 64

_PLAIN = r"([\[<])(\\*)(/?(?:INST\]|s>))"
_ESCAPED = r"([\[<])\\(\\*)(/?(?:INST\]|s>))"


def escaped(text: Column) -> Column:
    """``text`` without control strings: each gets a backslash behind its bracket."""
    return F.regexp_replace(text, _PLAIN, r"$1$2\\$3")


def unescaped(text: Column) -> Column:
    """What :func:`escaped` made ``text`` of."""
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, wherever the body refers to it, inside lambdas too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda a, x: a + x)


def _before(lengths: Column) -> Column:
    """For each element the sum of those before it, by sums of blocks."""
    block = lambda i: F.floor(i / BLOCK).cast("int")
    sums = F.transform(F.sequence(F.lit(0), block(F.size(lengths))), lambda b: _total(F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK))))
    bases = lambda blocks: F.transform(blocks, lambda _, b: _total(F.slice(blocks, F.lit(1), b)))
    each = lambda base: F.transform(lengths, lambda _, i: F.get(base, block(i)) + _total(F.slice(lengths, block(i) * BLOCK + 1, F.pmod(i, F.lit(BLOCK)))))
    return _let(sums, lambda blocks: _let(bases(blocks), each))


def _blocks(turns: Column) -> Column:
    """Sorted turns (role, text) as blocks (head, texts, loss): neighbours of one role are one."""
    role = lambda i: F.get(turns, i)["role"]
    starts = F.filter(F.sequence(F.lit(0), F.size(turns) - 1), lambda i: (i == 0) | (role(i) != role(i - 1)))
    head = lambda r: F.concat(F.lit(OPEN), escaped(r), F.lit(CLOSE))
    texts = lambda begin, end: F.transform(F.slice(turns, begin + 1, end - begin), lambda r: escaped(r["text"]))
    block = lambda begin, end: F.struct(head(role(begin)).alias("head"), texts(begin, end).alias("texts"), (role(begin) == LOSS).alias("loss"))
    return _let(starts, lambda s: F.transform(s, lambda begin, k: block(begin, F.coalesce(F.get(s, k + 1), F.size(turns)))))


def _mask(blocks: Column) -> Column:
    """start and length of each text that counts for the loss."""
    lead = lambda b, j: F.when(j == 0, F.length(b["head"])).otherwise(len(MORE))
    tail = lambda b, j: F.when(j == F.size(b["texts"]) - 1, len(END)).otherwise(0)
    place = lambda b: F.transform(b["texts"], lambda t, j: F.struct(b["loss"].alias("loss"), lead(b, j).alias("lead"), F.length(t).alias("length"), tail(b, j).alias("tail")))
    start = lambda places, sums: F.transform(places, lambda p, i: F.struct((F.get(sums, i) + p["lead"]).alias("start"), p["length"].alias("length"), p["loss"].alias("loss")))
    spans = lambda places: _let(_before(F.transform(places, lambda p: p["lead"] + p["length"] + p["tail"])), lambda sums: start(places, sums))
    every = _let(F.flatten(F.transform(blocks, place)), spans)
    return F.transform(F.filter(every, lambda s: s["loss"]), lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length")))


def formatted(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, mask (array of start, length in code points) of every conversation."""
    filled = conversations.select("conv_id", F.struct("turn", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))).alias("row"))
    rows = filled.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("turns"))
    body = lambda blocks: F.array_join(F.transform(blocks, lambda b: F.concat(b["head"], F.array_join(b["texts"], MORE), F.lit(END))), "")
    made = _let(_blocks(F.col("turns")), lambda blocks: F.struct(body(blocks).alias("formatted"), _mask(blocks).alias("mask")))
    return rows.select("conv_id", made.alias("made")).select("conv_id", "made.formatted", "made.mask")


def turns_of(text: Column) -> Column:
    """The turns (array of role, text) that a formatted text holds."""
    blocks = F.filter(F.split(text, END, -1), lambda b: b != "")
    parts = F.transform(blocks, lambda b: F.split(F.substr(b, F.lit(len(OPEN) + 1)), r"\[/INST\]", 2))
    turn = lambda role, t: F.struct(role.alias("role"), unescaped(t).alias("text"))
    turns = lambda p: _let(unescaped(F.get(p, F.lit(0))), lambda role: F.transform(F.split(F.get(p, F.lit(1)), MORE, -1), lambda t: turn(role, t)))
    return F.flatten(F.transform(parts, turns))


def loss_text(text: Column, mask: Column) -> Column:
    """What stands under the mask, end to end, unescaped span by span."""
    return F.array_join(F.transform(mask, lambda s: unescaped(F.substr(text, s["start"] + 1, s["length"]))), "")


def digests(rows: DataFrame) -> DataFrame:
    """conv_id and what is read back of formatted rows: turns and text under the mask, by number and digest."""
    said = lambda turns: F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    turns = _let(turns_of(F.col("formatted")), lambda t: F.struct(F.size(t).cast("long").alias("n"), F.sha2(said(t), 256).alias("sha")))
    loss = _let(loss_text(F.col("formatted"), F.col("mask")), lambda t: F.struct(F.length(t).cast("long").alias("n"), F.sha2(t, 256).alias("sha")))
    read = rows.select("conv_id", turns.alias("turns"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return read.select("conv_id", F.col("turns.n").alias("n_turns"), F.col("turns.sha").alias("turns_sha256"), F.col("loss.n").alias("loss_chars"), F.col("loss.sha").alias("loss_sha256"), "formatted_chars")
