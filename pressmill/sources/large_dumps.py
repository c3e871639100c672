"""Large JSON dumps, each read by many tasks.

A dump is one JSON document, so its elements have no line to be cut at.  Files are dealt into ranges of bytes:

1. Every range is summed up for both cases, that it begins inside a string or outside: quotes that are not
   escaped, brackets that open and close.  A window over the ranges of a file, one row each, turns the sums into what
   holds at every start: inside a string or not, and the depth.
2. With these, every range tells its elements of ``articles`` and where that array begins; another window gives the position of its first.
3. Every range reads the elements that begin in it, the last one beyond its end.

What holds for a file, its source, goes with the rows of its ranges to the elements, so texts meet no other table.
The rows of ranges are small whatever they stand for: they are dealt into as many tasks as a shuffle has, as Spark would
gather them into few by their size.

Brackets, commas and quotes inside strings are told from the others, and a range may begin anywhere, also in an escape.
A range holds at most one element in memory beside a chunk.  Files are in UTF-8.
"""

import re
import sys

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Window
from pyspark.sql import functions as F

from pressmill import schema

# Workers get what they run with the task and need no module.
register_pickle_by_value(sys.modules[__name__])

PART_BYTES = 64 << 20
CHUNK_BYTES = 4 << 20
QUOTE, ESCAPE, COMMA = b'"'[0], b"\\"[0], b","[0]
STEPS = np.zeros(256, np.int8)
STEPS[list(b"{[")] = 1
STEPS[list(b"}]")] = -1
MARKS = STEPS != 0
MARKS[COMMA] = True


def _open(uri):
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + uri[len("file:"):].lstrip("/"))
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


class _Range:
    """Brackets and commas of a range, chunk by chunk, with the parity of the quotes since its start."""

    def __init__(self, file, start, chunk):
        self.file, self.at, self.chunk, self.parity = file, start, chunk, 0
        self.escapes, before = 0, start      # backslashes right before the start
        while before:
            size = min(before, 4096)
            tail = file.read_at(size, before - size)
            run = size - len(tail.rstrip(b"\\"))
            self.escapes += run
            if run < size:
                break
            before -= size

    def read(self, size):
        """start, bytes, places of marks, parities there."""
        start, raw = self.at, self.file.read_at(min(size, self.chunk), self.at)
        held = np.frombuffer(raw, np.uint8)
        # A quote counts after an even number of backslashes.
        last = np.maximum.accumulate(np.where(held != ESCAPE, np.arange(len(held)), -1))
        quotes = np.flatnonzero(held == QUOTE)
        ahead = np.where(quotes > 0, last[quotes - 1], -1)
        run = np.where(ahead >= 0, quotes - 1 - ahead, quotes + self.escapes)
        quotes = quotes[run % 2 == 0]
        marks = np.flatnonzero(MARKS[held])
        parities = (np.searchsorted(quotes, marks) + self.parity) & 1
        self.parity = (self.parity + len(quotes)) & 1
        if len(held):
            self.escapes = len(held) - 1 - int(last[-1]) if last[-1] >= 0 else self.escapes + len(held)
        self.at += len(held)
        return start, raw, marks, parities


def _rows(task):
    """A function of batches from one of the values of a row, which gives a list of rows."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                with _open(row["path"]) as file:
                    yield from task(file, row)
    return run


SUMS = "path string, start long, stop long, quotes int, delta0 long, delta1 long"


def _sums(chunk):
    def task(file, row):
        part, deltas = _Range(file, row["start"], chunk), [0, 0]
        while part.at < row["stop"]:
            _, raw, marks, parities = part.read(row["stop"] - part.at)
            if not raw:
                break
            steps = STEPS[np.frombuffer(raw, np.uint8)[marks]]
            for inside in (0, 1):      # a mark counts if it isn't in a string
                deltas[inside] += int(steps[parities == inside].sum(dtype=np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(
            (row["path"], row["start"], row["stop"], part.parity, *deltas), (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))],
            [c.split()[0] for c in SUMS.split(", ")])
    return _rows(task)


def _names(file, place, name):
    """Whether the value at ``place`` belongs to the key ``name``."""
    size = 256
    while True:
        size = min(size, place)
        before = file.read_at(size, place - size)
        if size == place or len(before.rstrip(b" \t\r\n:")) > len(name) + 3:
            return re.search(rb'(?<!\\)"' + name + rb'"[ \t\r\n]*:[ \t\r\n]*\Z', before) is not None
        size *= 2


def _borders(part, size, inside, depth):
    """Of the next chunk: start, bytes, borders of values two levels down as (place, opens, closes), depth after it."""
    start, raw, marks, parities = part.read(size)
    marks = marks[parities == inside]
    steps = STEPS[np.frombuffer(raw, np.uint8)[marks]]
    after = depth + np.cumsum(steps, dtype=np.int64)
    at = np.flatnonzero((after == 2) & (steps >= 0) | (after == 1) & (steps < 0))
    return start, raw, zip(marks[at].tolist(), (steps[at] > 0).tolist(), (steps[at] < 0).tolist()), int(after[-1]) if len(after) else depth


FOUND = "path string, start long, stop long, inside int, depth long, carried long, own long, last boolean, info string"


def _found(chunk):
    """Elements that begin in a range, apart for the array that is open at its start and those that open in it."""
    def info_at(file, place):
        part, depth, parts = _Range(file, place, chunk), 1, []
        while True:
            start, raw, borders, depth = _borders(part, chunk, 0, depth)
            for at, _, closes in borders:
                if closes:
                    return (b"".join(parts) + raw[:at + 1]).decode("utf-8", "replace")
            if not raw:
                return None
            parts.append(raw)

    def task(file, row):
        part, depth = _Range(file, row["start"], chunk), row["depth"]
        carried, own, last, info = 0, 0, None, None
        while part.at < row["stop"]:
            start, raw, borders, depth = _borders(part, row["stop"] - part.at, row["inside"], depth)
            if not raw:
                break
            for at, opens, closes in borders:
                if opens:
                    last = raw[at:at + 1] == b"[" and _names(file, start + at, b"articles")
                    if raw[at:at + 1] == b"{" and _names(file, start + at, b"export_info"):
                        info = info_at(file, start + at)
                elif closes:
                    last = False
                if not closes:
                    if last is None:
                        carried += 1
                    elif last:
                        own += 1
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
        values = (row["path"], row["start"], row["stop"], row["inside"], row["depth"], carried, own, last, info)
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], [c.split()[0] for c in FOUND.split(", ")])
    return _rows(task)


def _elements(chunk, at_once=1024):
    def task(file, row):
        part, depth = _Range(file, row["start"], chunk), row["depth"]
        listed, number = row["listed"], row["before"]     # in the array; position of the next element
        parts, out = None, []                              # bytes of the element that is open

        def batch():
            made = pa.RecordBatch.from_arrays([pa.array([row["path"]] * len(out), pa.string()), pa.array([row["source"]] * len(out), pa.string()),
                                               pa.array([n for n, _ in out], pa.int64()), pa.array([v for _, v in out], pa.string())],
                                              ["path", "source", "pos", "value"])
            out.clear()
            return made

        while part.at < row["stop"] or parts is not None:
            beyond = part.at >= row["stop"]
            start, raw, borders, depth = _borders(part, chunk if beyond else row["stop"] - part.at, row["inside"], depth)
            if not raw:
                break
            begin = 0
            for at, opens, closes in borders:
                if opens:
                    listed = raw[at:at + 1] == b"[" and _names(file, start + at, b"articles")
                elif parts is not None:
                    value = b"".join([*parts, raw[begin:at]]).strip()
                    if value:
                        out.append((number - 1, value.decode("utf-8", "replace")))
                    parts = None
                if beyond:
                    break
                if closes:
                    listed = False
                elif listed:
                    parts, begin, number = [], at + 1, number + 1
            else:
                if parts is not None:
                    parts.append(raw[begin:])
            if len(out) >= at_once:
                yield batch()
            if beyond and parts is None:
                break
        yield batch()
    return _rows(task)


def _dealt(ranges):
    """Every range to a task by its hash; the number is given, so ranges aren't gathered for being small rows."""
    tasks = max(int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return ranges.repartition(tasks, F.xxhash64("path", "start"))


def dump_ranges(spark, path, pattern="*.json", part_bytes=PART_BYTES, chunk_bytes=CHUNK_BYTES):
    """One row per range of every file: what holds at its start, the number of elements before it, and the file's ``info``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length")
    ranges = files.filter("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(part_bytes).cast("long"))).alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("start") + part_bytes, "length").alias("stop"))
    sums = _dealt(ranges).mapInArrow(_sums(chunk_bytes), SUMS)
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("inside", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2).cast("int"))
    sums = sums.withColumn("delta", F.when(F.col("inside") == 0, F.col("delta0")).otherwise(F.col("delta1")))
    known = sums.select("path", "start", "stop", "inside", F.coalesce(F.sum("delta").over(before), F.lit(0)).alias("depth"))
    found = _dealt(known).mapInArrow(_found(chunk_bytes), FOUND)
    found = found.withColumn("listed", F.coalesce(F.last("last", ignorenulls=True).over(before), F.lit(False)))
    found = found.withColumn("n", F.col("own") + F.when(F.col("listed"), F.col("carried")).otherwise(0))
    return found.select("path", "start", "stop", "inside", "depth", "listed", "n", F.max("info").over(Window.partitionBy("path")).alias("info"),
                        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))


def read_large_dumps(spark, path, pattern="*.json", part_bytes=PART_BYTES, chunk_bytes=CHUNK_BYTES):
    """Articles of dump files with their position in the file, as ``dumps.dump_articles`` gives them.

    Elements that are null or not an article have null fields.  A file without ``articles`` gives no row; one that is
    cut off gives the elements that are whole.
    """
    info = F.from_json("info", schema.DUMP["export_info"].dataType)
    ranges = dump_ranges(spark, path, pattern, part_bytes, chunk_bytes).filter("n > 0").withColumn("source", info["source"]).drop("info")
    elements = _dealt(ranges).mapInArrow(_elements(chunk_bytes), "path string, source string, pos long, value string")
    return (elements.withColumn("article", F.from_json("value", schema.DUMP_ARTICLE))
            .select(F.element_at(F.split("path", "/"), -1).alias("file"), "source", "pos", "article.*"))
