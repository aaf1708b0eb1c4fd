"""Large JSON documents, item by item: the objects in one array of the root, read in byte ranges.

A file is cut into ranges of so many bytes. Where it has several, a job looks at each without knowing what stands before it:
a quote turns inside and outside around, so it notes the brackets for both cases, and what they open and
close. Put together, in order and as little as a few numbers a range, that tells each range in which brackets
it begins and how many items begin before it; a second job then reads every item in the range it begins in.
No task holds more than a range and an item, and an item's position is its place in the array.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

RANGE = 64 << 20
#: Bytes before an array in which its key is looked for, and by which an item is read on.
BACK, ON = 256, 1 << 20

_TOKEN = re.compile(rb'\\.|["\[\]{}]', re.DOTALL)


def files_of(path: str) -> list[tuple[str, int]]:
    """The files at a path (a file or a folder, of any file system that Arrow reads) and their sizes."""
    from pyarrow import fs

    files, root = opened(path)
    info = files.get_file_info(root)
    found = [info] if info.is_file else [f for f in files.get_file_info(fs.FileSelector(root)) if f.is_file]
    scheme = path.split("://")[0] + "://" if "://" in path else ""
    return sorted((scheme + f.path, f.size) for f in found)


def opened(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class _Range:
    """Bytes [start, end) of a file, and tokens in them as (place, sign): quotes, brackets, and @ for the
    array of the key."""

    def __init__(self, path: str, start: int, end: int, key: str):
        files, name = opened(path)
        self.file, self.start, self.end = files.open_input_file(name), start, end
        self.key = re.compile(rb'"' + re.escape(key.encode()) + rb'"\s*:\s*$')

    def bytes_at(self, start: int, end: int) -> bytes:
        return self.file.read_at(max(0, end - start), start)

    def tokens(self, start: int, end: int) -> Iterator[tuple[int, bytes]]:
        first = max(0, start - BACK)
        while first and self.bytes_at(first, start).strip(b"\\") == b"":
            first = max(0, first - BACK)
        data = self.bytes_at(first, end)
        before = data[: start - first]
        # a sign behind an odd number of backslashes is taken away by them
        escaped = (len(before) - len(before.rstrip(b"\\"))) % 2
        for m in _TOKEN.finditer(data, start - first + escaped):
            sign = m[0]
            if len(sign) == 1:
                if sign == b"[" and self.key.search(data, max(0, m.start() - BACK), m.start()):
                    sign = b"@"
                yield first + m.start(), sign


def summary(tokens: Iterator[tuple[int, bytes]]) -> dict:
    """What a range does to brackets where it begins outside of a string (0) and inside (1): closed, opened, and
    how many objects it opens at which depth in what; and whether it has an odd number of quotes."""
    cases = [{"closed": 0, "opened": "", "objects": Counter()} for _ in range(2)]
    quotes = 0
    for _, sign in tokens:
        case = cases[quotes]
        if sign == b'"':
            quotes ^= 1
        elif sign in b"]}":
            if case["opened"]:
                case["opened"] = case["opened"][:-1]
            else:
                case["closed"] += 1
        else:
            if sign == b"{":
                case["objects"][len(case["opened"]) - case["closed"], case["opened"][-1:]] += 1
            case["opened"] += sign.decode()
    for case in cases:
        case["objects"] = [[depth, parent, n] for (depth, parent), n in case["objects"].items()]
    return {"cases": cases, "quotes": quotes}


def begun(summaries: list[dict]) -> list[tuple[bool, str, int]]:
    """Of each range of a file: whether it begins in a string, in which brackets, after how many items."""
    inside, stack, items, out = 0, "", 0, []
    for s in summaries:
        out.append((bool(inside), stack, items))
        case = s["cases"][inside]
        for depth, parent, n in case["objects"]:
            at = len(stack) + depth
            parent = parent or stack[at - 1 : at]
            items += n if at == 2 and parent == "@" else 0
        stack = stack[: len(stack) - case["closed"]] + case["opened"]
        inside ^= s["quotes"]
    return out


def items(source: _Range, inside: bool, stack: str) -> Iterator[bytes]:
    """The items that begin in the range."""
    begin, held, upto = None, b"", source.start
    start, end = source.start, source.end
    while True:
        for place, sign in source.tokens(start, end):
            if sign == b'"':
                inside = not inside
            elif inside:
                continue
            elif sign in b"]}":
                stack = stack[:-1]
                if begin is not None and len(stack) == 2:
                    yield held + source.bytes_at(upto, place + 1)
                    begin, held = None, b""
                    if start >= source.end:
                        return
            else:
                if sign == b"{" and stack == "{@" and start < source.end:
                    begin, upto = place, place
                stack += sign.decode()
        if begin is None or end <= start:
            return
        # the last item goes on behind the range
        held, upto = held + source.bytes_at(upto, end), end
        start, end = end, end + ON
        if not source.bytes_at(start, start + 1):
            return


def read_items(spark: SparkSession, path: str, key: str, size: int = RANGE) -> DataFrame:
    """file, pos, value (text) of every object in the root's array ``key`` of the files at ``path``.

    A file that isn't such a document gives no rows, or those items that it has whole.
    """
    files = files_of(path)
    ranges = [(name, start, min(total, start + size)) for name, total in files if total > size for start in range(0, total, size)]
    schema = "file string, start long, end long"
    # small files share tasks
    tasks = max(1, min(len(files) + len(ranges), sum(total for _, total in files) // size + spark.sparkContext.defaultParallelism))

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, start, end in zip(frame["file"], frame["start"], frame["end"], strict=True):
                found = summary(_Range(file, int(start), int(end), key).tokens(int(start), int(end)))
                yield pd.DataFrame({"file": [file], "start": [start], "found": [json.dumps(found)]})

    # a file of one range begins outside of everything, so only files of several are looked at
    told = [(name, 0, total, False, "", 0) for name, total in files if 0 < total <= size]
    if ranges:
        rows = spark.createDataFrame(ranges, schema).repartition(min(tasks, len(ranges)), "file", "start")
        known = {(r.file, r.start): json.loads(r.found) for r in rows.mapInPandas(look, "file string, start long, found string").collect()}  # some numbers a range
        for _, some in groupby(ranges, key=lambda r: r[0]):
            own = list(some)
            told += [(*r, *state) for r, state in zip(own, begun([known[r[:2]] for r in own]), strict=True)]

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # small files share frames
        held, held_bytes = ([], [], []), 0
        for frame in frames:
            for file, start, end, inside, stack, before in frame.itertuples(index=False):
                for place, value in enumerate(items(_Range(file, int(start), int(end), key), bool(inside), stack), int(before)):
                    for column, x in zip(held, (file, place, value.decode()), strict=True):
                        column.append(x)
                    held_bytes += len(file) + len(value)
                    if held_bytes > 8 << 20:
                        yield pd.DataFrame(dict(zip(("file", "pos", "value"), held, strict=True)))
                        held, held_bytes = ([], [], []), 0
        if held[0]:
            yield pd.DataFrame(dict(zip(("file", "pos", "value"), held, strict=True)))

    states = spark.createDataFrame(told, f"{schema}, inside boolean, stack string, before long").repartition(tasks, "file", "start")
    return states.mapInPandas(read, "file string, pos int, value string")
