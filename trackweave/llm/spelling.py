"""Spelling variants: words one edit apart, grouped under their most frequent form.

A word's mask has a bit for each letter that it holds an odd number of times; one edit flips two bits at
most, so of three bands of the mask one stays. Words are candidates if a band is equal, their lengths
differ by one at most, and the half of the word that the edit is not in is equal too: an edit lies in one
half, so nothing is lost, and a band that half of all words share (few of the letters in it are frequent)
is dealt out by halves of words instead of meeting in one place. All of that is one equi-join; each
pair counts in the first band and half that it shares, and the edit distance decides.

A word's form is its near word of largest count, if that is twice its own or more. Counts double from form
to form, so chains end after some forty steps, and their ends are found by doubled strides.

Defined results: null and empty texts have no words; a null doc_id is an empty one in what is hashed; rows
may repeat and count each time; ties of counts go to the first word in code-point order; a very long run
of letters is a word; an empty table gives no rows; other columns pass by.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.llm import store
from trackweave.llm.columns import lowered

#: Runs of Latin letters; the least length and count of a word; the ratio of counts that makes a form.
LETTERS = "[A-Za-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT, RATIO = 5, 3, 2
#: Of so many occurrences one loses a letter.
TYPO = 97
#: Bits of a mask; letter c has bit c mod BITS, and bit b is in band b mod BANDS.
BITS, BANDS = 63, 3
_BAND = [sum(1 << b for b in range(k, BITS, BANDS)) for k in range(BANDS)]


def words(docs: DataFrame, typo: int | None = TYPO) -> DataFrame:
    """word and n of every word of LEAST_LENGTH and LEAST_COUNT; with ``typo``, occurrences that the hash
    of document and word picks have lost a letter."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(F.regexp_extract_all("text", F.lit(LETTERS), F.lit(0))).alias("run"))
    runs = runs.select("d", lowered(F.col("run")).alias("w"))
    if typo:
        h = F.crc32(F.concat("d", F.lit(":"), "w").cast("binary"))
        runs = runs.withColumn("h", h).withColumn("at", (F.col("h") % F.length("w")).cast("int"))
        cut = F.concat(F.substr("w", F.lit(1), F.col("at")), F.substr("w", F.col("at") + 2))
        runs = runs.withColumn("w", F.when(F.col("h") % typo == 0, cut).otherwise(F.col("w")))
    return runs.filter(F.length("w") >= LEAST_LENGTH).groupBy(F.col("w").alias("word")).agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _keyed(masked: DataFrame, longer: int) -> DataFrame:
    """Each word under its bands and halves, as what a word ``longer`` letters shorter would meet."""
    size = F.length("word") - longer
    half = F.floor(size / 2).cast("int")
    sides = (F.substr("word", F.lit(1), half), F.right("word", size - half))
    keys = [F.struct(F.lit(BANDS * s + k).alias("code"), F.xxhash64(F.lit(BANDS * s + k), size, side, F.col("mask").bitwiseAND(band)).alias("key")) for s, side in enumerate(sides) for k, band in enumerate(_BAND)]
    return masked.select("word", "n", "mask", F.lit(longer).alias("longer"), F.explode(F.array(*keys)).alias("k")).select("word", "n", "mask", "longer", "k.code", "k.key")


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """a, a_n, b, b_n: each pair of words (word, n) one edit apart, once. Words are distinct."""
    masked = vocabulary.withColumn("mask", F.expr(f"aggregate(split(word, ''), 0L, (m, c) -> m ^ shiftleft(1L, ascii(c) % {BITS}))"))
    own = _keyed(masked, 0)
    a, b = own.drop("longer").alias("a"), own.unionByName(_keyed(masked, 1)).alias("b")
    flips = F.col("a.mask").bitwiseXOR(F.col("b.mask"))
    band = F.pmod(F.col("a.code"), F.lit(BANDS))
    first = F.when(flips.bitwiseAND(_BAND[0]) == 0, 0).when(flips.bitwiseAND(_BAND[1]) == 0, 1).otherwise(2)
    half = F.floor(F.length("a.word") / 2).cast("int")
    new = (F.col("a.code") < BANDS) | (F.substr("a.word", F.lit(1), half) != F.substr("b.word", F.lit(1), half))
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.code") == F.col("b.code")))
    met = met.filter(((F.col("b.longer") == 1) | (F.col("a.word") < F.col("b.word"))) & (F.bit_count(flips) <= 2) & (band == first) & new)
    found = met.filter(F.levenshtein("a.word", "b.word", 1) == 1)
    return found.select(F.col("a.word").alias("a"), F.col("a.n").alias("a_n"), F.col("b.word").alias("b"), F.col("b.n").alias("b_n"))


def _roots(formed: DataFrame) -> DataFrame:
    """word and root: where the forms of ``formed`` (word, form) lead to in the end."""
    at = store.written(formed.select("word", F.col("form").alias("root")), "roots", few=True)
    while True:
        on = at.alias("x").join(at.alias("y"), F.col("x.root") == F.col("y.word"), "left")
        step = store.written(on.select("x.word", F.coalesce("y.root", "x.root").alias("root"), F.col("y.root").isNotNull().alias("moved")), "roots", few=True)
        store.drop(at)
        at = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return at


def variants(vocabulary: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word (word, n)."""
    vocabulary = store.written(vocabulary.select("word", "n"), "words", few=True)
    pairs = near_pairs(vocabulary)
    end = lambda x, y: F.struct(F.col(x).alias("word"), F.struct((-F.col(f"{y}_n")).alias("less"), F.col(y).alias("other")).alias("best"))
    each = pairs.select(F.explode(F.array(end("a", "b"), end("b", "a"))).alias("e")).select("e.word", "e.best")
    near = each.groupBy("word").agg(F.count("*").alias("n_near"), F.min("best").alias("best"))
    rows = vocabulary.join(near, "word", "left")
    formed = -F.col("best.less") >= RATIO * F.col("n")
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best.other")).alias("form"), F.when(formed, -F.col("best.less")).alias("form_n"))
    rows = store.written(rows, "forms", few=True)
    roots = _roots(rows.filter("form IS NOT NULL"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
