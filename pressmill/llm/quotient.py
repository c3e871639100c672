"""Operator 9: exact duplicates, by counting quotient filters.

1. One pass over the texts stores doc_id, a 64-bit fingerprint and the SHA-256 of every
   normalised text (each run of white space becomes one space).
2. Every task builds counting quotient filters of its fingerprints, one per segment of the
   fingerprint range: the high bits (quotients) are places in a bitmap, the low bits (remainders) lie
   sorted in the run of their quotient, each with a counter.  Filters of one segment merge
   by their sorted remainders without any loss, as no bit of a fingerprint is dropped.
3. Fingerprints with a count above one route their documents to byte verification: the
   normalised texts themselves are compared, copies first inside the tasks.  Texts whose fingerprint a
   bounded filter of these excludes are not shuffled.
4. Verified groups are joined back; of a group the row with the smallest doc_id stays.

A text that is null counts as empty.  Rows without doc_id come after all others; among rows
with equal doc_id and equal text exactly one stays.  keep_id is null where a whole group has no doc_id.
An empty input gives no rows.  Extra columns are kept by ``drop_duplicates`` and not read.
A group may hold any part of all rows: copies are counted inside the tasks before anything
is shuffled, and joins on a group are salted.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pressmill.llm.common import keep_unmarked, slices, split_by_keys, stored, with_package

SPACE = r"[\x20\x09-\x0D]+"
SALTS = 8


def normalised(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


# ------------------------------------------------------------------ the filter

def build_filter(values, counts, bits, quotient_bits):
    """A filter of sorted, distinct values of ``bits`` bits, with their counts."""
    rest = np.uint64(bits - quotient_bits)
    quotients = (values >> rest).astype(np.int64)
    remainders = values & np.uint64((1 << int(rest)) - 1)
    occupied, runs = np.unique(quotients, return_counts=True)
    bitmap = np.zeros(1 << quotient_bits, dtype=bool)
    bitmap[occupied] = True
    width = -(-int(rest) // 8)
    head = np.asarray([bits, quotient_bits, len(occupied), len(values)], dtype="<i8")
    low = remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return b"".join([head.tobytes(), np.packbits(bitmap).tobytes(), runs.astype("<u4").tobytes(), low.tobytes(),
                     counts.astype("<u8").tobytes()])


def read_filter(raw):
    """The distinct values of a filter, sorted, and their counts."""
    bits, quotient_bits, n_runs, n = np.frombuffer(raw, "<i8", 4).tolist()
    at = 32
    size = -(-(1 << quotient_bits) // 8)
    bitmap = np.unpackbits(np.frombuffer(raw, np.uint8, size, at), count=1 << quotient_bits)
    at += size
    runs = np.frombuffer(raw, "<u4", n_runs, at)
    at += 4 * n_runs
    width = -(-(bits - quotient_bits) // 8)
    low = np.zeros((n, 8), dtype=np.uint8)
    low[:, :width] = np.frombuffer(raw, np.uint8, n * width, at).reshape(n, width)
    at += n * width
    quotients = np.repeat(np.flatnonzero(bitmap), runs).astype(np.uint64)
    values = (quotients << np.uint64(bits - quotient_bits)) | low.reshape(-1).view("<u8")
    return values, np.frombuffer(raw, "<u8", n, at).astype(np.int64)


def merged(first, second):
    """Both lists of sorted values as one, counts of equal values added."""
    values = np.concatenate([first[0], second[0]])
    order = np.argsort(values, kind="stable")   # merges sorted runs
    values, counts = values[order], np.concatenate([first[1], second[1]])[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = values[1:] != values[:-1]
    starts = np.flatnonzero(new)
    return values[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def quotient_bits_for(n):
    """Places for ``n`` values at a load of three quarters at most."""
    return max(1, int(np.ceil(np.log2(max(n, 1) / 0.75))))


def _segment_filters(segment_bits):
    bits = 64 - segment_bits

    def run(batches):
        held = [b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for b in batches]
        if not held:
            return
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        segments = (values >> np.uint64(bits)).astype(np.int64) if segment_bits else np.zeros(len(values), np.int64)
        low = values & np.uint64((1 << bits) - 1)
        ends = np.flatnonzero(np.diff(segments)) + 1
        for own in np.split(np.arange(len(values)), ends):
            if len(own):
                raw = build_filter(low[own], counts[own], bits, quotient_bits_for(len(own)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(segments[own[0]])], pa.int32()), pa.array([raw], pa.binary())], ["segment", "filter"])
    return run


def _merge_segment(key, batches):
    lists = [read_filter(f.as_py()) for b in batches for f in b.column("filter")]
    bits = 0
    for b in batches:
        for f in b.column("filter"):
            bits = int(np.frombuffer(f.as_py(), "<i8", 1)[0])
    while len(lists) > 1:
        lists = [merged(lists[i], lists[i + 1]) if i + 1 < len(lists) else lists[i] for i in range(0, len(lists), 2)]
    values, counts = lists[0]
    raw = build_filter(values, counts, bits, quotient_bits_for(len(values)))
    return pa.table({"segment": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([raw], pa.binary())})


def merged_filters(fingerprints):
    """One merged filter per segment of the range of ``fingerprints`` (one column of longs).

    There are as many segments as shuffles have partitions, rounded up to a power of two,
    so that the fingerprints of one segment fit a task.
    """
    segment_bits = max(slices(with_package(fingerprints).sparkSession) - 1, 0).bit_length()
    parts = fingerprints.mapInArrow(_segment_filters(segment_bits), "segment int, filter binary")

    def merge(key, table):
        return _merge_segment(key, table.to_batches())

    return parts.groupBy("segment").applyInArrow(merge, "segment int, filter binary")


def _repeated(batches):
    for batch in batches:
        for segment, raw in zip(batch.column(0), batch.column(1)):
            raw = raw.as_py()
            values, counts = read_filter(raw)
            bits = int(np.frombuffer(raw, "<i8", 1)[0])
            full = values[counts > 1]
            if bits < 64:
                full = full | np.uint64(segment.as_py() << bits)
            yield pa.RecordBatch.from_arrays([pa.array(full.view(np.int64), pa.int64()),
                                              pa.array(counts[counts > 1], pa.int64())], ["fp", "n"])


def repeated_fingerprints(filters):
    """fp, n: fingerprints that filters have counted more than once."""
    return with_package(filters).select("segment", "filter").mapInArrow(_repeated, "fp long, n long")


# ------------------------------------------------------------------ duplicates

def _salted(df):
    return df.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _own_salt():
    return (F.monotonically_increasing_id() % SALTS).cast("int")


def find_duplicates(docs, text="text"):
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of ``docs``."""
    norm = normalised(F.col(text))
    slim = stored(docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.xxhash64(norm).alias("fp"),
                              F.sha2(norm, 256).alias("sha")), "fingerprints")
    suspects = stored(repeated_fingerprints(merged_filters(slim.select("fp"))).select("fp"), "suspects")
    texts = docs.select(norm.alias("norm")).select("norm", F.xxhash64("norm").alias("fp"), _own_salt().alias("_salt"))
    texts = split_by_keys(texts, F.col("fp"), suspects)[1]   # only these are shuffled, however many suspects there are
    # Salted, as one text may be a third of all rows.  Equal texts meet inside the tasks first.
    equal = (texts.join(_salted(suspects), ["fp", "_salt"], "left_semi")
             .groupBy("fp", "norm").agg(F.count("*").alias("n")).filter("n > 1")
             .select("fp", F.sha2("norm", 256).alias("sha"), F.col("n").alias("group_size")))
    first = slim.groupBy("fp", "sha").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("keep"), F.count("*").alias("n"))
    groups = stored(equal.join(first.filter("n > 1"), ["fp", "sha"]).select(
        "fp", "sha", "group_size", F.col("keep.doc_id").alias("keep_id"), F.col("keep.row").alias("keep_row")),
        "duplicate-groups")
    joined = slim.withColumn("_salt", _own_salt()).join(_salted(groups), ["fp", "sha", "_salt"], "left")
    single = F.col("group_size").isNull()
    return joined.select(
        "doc_id", F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("row") == F.col("keep_row"))).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_duplicates(docs, text="text"):
    """The rows of ``docs`` that stay, columns unchanged."""
    def mark(sha):
        return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), sha)

    repeated = find_duplicates(docs, text).filter("group_size > 1")
    marks = repeated.groupBy(mark(F.col("text_sha256")).alias("mark")).agg(F.max("kept").alias("some"), F.min("kept").alias("every"))
    marks = stored(marks.filter("NOT every").select("mark", "some"), "dropped")
    return keep_unmarked(docs, mark(F.sha2(normalised(F.col(text)), 256)), marks)
