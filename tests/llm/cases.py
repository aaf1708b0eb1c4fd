"""Small tables that every corpus operator has to take, and the words and shingles by plain Python."""

from __future__ import annotations

import re

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SF = "/root/testdata/sf0.001"


def odd_rows() -> list[tuple]:
    """Nulls in any column, empty and long texts, ties, repeated rows, odd characters."""
    passage = "the same long passage of words stands in more than one document and goes on past a hundred bytes so that it counts "
    rows = [
        (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "a", 45),
        (2, "alpha beta gamma delta epsilon zeta eta theta", "en", "a", 45),
        (3, None, "en", "b", None),
        (4, "", None, None, 0),
        (5, " \n\t ", "en", None, 4),
        (6, "one", "en", "b", 3),
        (7, "Σas é á don't — x y ​ 12 345 !!A <|endoftext|>", "en", "c", 40),
        (8, passage + "tail eight", "en", "a", 130),
        (9, "head nine " + passage, "en", "a", 130),
        (10, passage * 3, "en", "c", 350),
        (11, "word " * 3000, "en", "c", 15000),
        (12, " ".join(f"w{i % 701}x{i % 13}" for i in range(6000)), "en", "d", 40000),
        (13, "a\x1cb c  d \r\n e", "en", "d", 12),
        (None, "a text without an id", "en", "d", 20),
        (14, "repeated row with the same id", "en", "a", 29),
        (14, "repeated row with the same id", "en", "a", 29),
        (15, "tie of ids one", None, "b", None),
        (15, "tie of ids two", None, "b", None),
    ]
    return rows


def complements(n: int) -> tuple[str, str]:
    """Two words of n letters, a power of two, that every weighted sum of bytes modulo 2**64 confuses."""
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def words(text: str | None) -> list[str]:
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def shingle_set(text: str | None, n: int) -> set[tuple[str, ...]]:
    w = words(text)
    if not w:
        return set()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or {tuple(w)}


def tables(spark):
    """Named documents tables: odd rows, no rows, and one with extra columns of clashing names."""
    odd = spark.createDataFrame(odd_rows(), DOCS)
    empty = spark.createDataFrame([], DOCS)
    return {"odd": odd, "empty": empty}
