"""Operator 2: documents packed into sequences, by bulk-synchronous best fit.

Every round matches unplaced pieces with open gaps, as best fit decreasing would:

* pieces and gaps are ranged by size and ranked inside their size, distributedly;
* a successor sweep from large to small lets each piece take the smallest gap that is
  free in this round and holds it; it runs over the counts per size, which the tasks have
  summed (at most one row per size up to the capacity), and yields intervals of ranks;
* pieces that want the same gap are told apart by rank: rank r of a size gets gap
  r div k of the interval, as its (r mod k)-th piece, where k pieces of that size fit;
* gaps are updated from the intervals and stored; then the next round begins.  New
  sequences are opened for pieces that are larger than every gap left: for each piece over
  half the capacity, for others as many as their tokens fill at least.

Only documents longer than the capacity are cut.  Null texts count as empty.  Null and
repeated doc_ids are packed like all others, each row as a document of its own.  An empty input gives no rows.
Documents without any id (no text and no end id) take no place.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pressmill.llm.common import ranked, stored, with_package
from pressmill.llm.tokens import encoder_for

CAPACITY = 2048
STRETCH = 4096
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
INTERVALS = ("round int, size int, low long, high long, gap int, gap_low long, gap_high long, each int, "
             "sequence long")


def _pieces(vocabulary, end_id, capacity, with_ids):
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids

    def run(batches):
        encoder = encoder_for(vocabulary)
        end = np.asarray([] if end_id is None else [end_id], dtype="<u4").tobytes()
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(keys), 256):
                rows = []
                for doc_id, text in zip(keys[at:at + 256], texts.slice(at, 256)):
                    raw = encoder.encode(text.as_py()) + end
                    for k, first in enumerate(range(0, len(raw), 4 * capacity)):
                        cut = raw[first:first + 4 * capacity]
                        rows.append((doc_id, k, first // 4, len(cut) // 4, zlib.crc32(cut), cut)[:len(names)])
                columns = list(zip(*rows)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)
    return run


def cut_into_pieces(docs, vocabulary, end_id=0, capacity=CAPACITY, with_ids=False):
    """Pieces of at most ``capacity`` ids of every whole text; ``ids`` (little-endian
    unsigned 32-bit) if wanted."""
    return with_package(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _pieces(vocabulary, end_id, capacity, with_ids), PIECES + (", ids binary" if with_ids else ""))


def sweep(supply, gaps, capacity, number, next_rank, next_sequence):
    """One round over counts per size.

    ``supply`` and ``gaps`` are arrays of counts by size; ``next_rank`` is the first
    unplaced rank per size.  Returns the intervals and the number of sequences after the
    round; updates ``supply`` and ``next_rank``.
    """
    out, stack = [], []
    after = gaps.copy()
    used_of = np.zeros(capacity + 1, dtype=np.int64)

    def place(size, gap, fit, use, sequence):
        put = int(min(supply[size], use * fit))
        low, gap_low = int(next_rank[size]), int(used_of[gap]) if sequence is None else 0
        out.append((number, int(size), low, low + put, int(gap), gap_low, gap_low + int(use), int(fit), sequence))
        full, part = divmod(put, fit)
        after[gap - fit * size] += full
        if part:
            after[gap - part * size] += 1
        supply[size] -= put
        next_rank[size] += put

    for size in range(capacity - 1, 0, -1):
        if gaps[size]:
            stack.append([size, int(gaps[size])])
        while supply[size] and stack:
            gap, free = stack[-1]
            fit = gap // size
            use = min(free, -(-int(supply[size]) // fit))
            place(size, gap, fit, use, None)
            after[gap] -= use
            used_of[gap] += use
            stack[-1][1] -= use
            if not stack[-1][1]:
                stack.pop()
    open_gaps = np.flatnonzero(after[1:])
    largest = int(open_gaps[-1]) + 1 if len(open_gaps) else 0
    wanted = -(-int((supply[:capacity] * np.arange(capacity)).sum()) // capacity)
    opened = 0
    for size in range(capacity - 1, largest, -1):
        if not supply[size]:
            continue
        fit = capacity // size
        use = -(-int(supply[size]) // fit)
        if fit > 1:
            use = min(use, wanted - opened)
            if use <= 0:
                break
        place(size, capacity, fit, use, next_sequence + opened)
        opened += use
    return out, next_sequence + opened


def _filled(gap, size, low, high, each, index):
    """Room left in the ``index``-th sequence of an interval."""
    return F.col(gap) - F.col(size) * F.least(F.col(each).cast("long"), F.col(high) - F.col(low) - index * F.col(each))


def pack(pieces, capacity=CAPACITY):
    """Add ``sequence_id`` and ``offset`` to ``pieces`` (which have ``length`` from 1 to
    ``capacity``); other columns are kept."""
    spark = pieces.sparkSession
    pieces = stored(ranked(stored(pieces, "pieces"), "length", [F.lit(0)], "_rank"), "ranked-pieces")
    supply = np.zeros(capacity + 1, dtype=np.int64)
    for row in pieces.groupBy("length").count().collect():   # a row per size up to the capacity
        supply[row["length"]] = row["count"]
    full = int(supply[capacity])
    supply[capacity] = 0
    next_rank = np.zeros(capacity + 1, dtype=np.int64)
    gaps, matched, intervals, sequences, number = None, [], [], full, 0
    while supply.any():
        free = np.zeros(capacity + 1, dtype=np.int64)
        if gaps is not None:
            for row in gaps.groupBy("room").count().collect():   # likewise
                free[row["room"]] = row["count"]
        found, sequences = sweep(supply, free, capacity, number, next_rank, sequences)
        intervals += found
        if not supply.any() and all(i[8] is not None for i in found):
            break   # nothing was put into gaps, and no gap is needed any more
        here = F.broadcast(spark.createDataFrame(found, INTERVALS))   # at most two rows per size
        parts = []
        if gaps is not None:
            g, i = ranked(gaps, "room", [F.lit(0)]).alias("g"), here.filter("sequence IS NULL").alias("i")
            at = F.col("g.rank") - F.col("i.gap_low")
            parts.append(g.join(i, (F.col("g.room") == F.col("i.gap")) & (at >= 0)
                                & (F.col("g.rank") < F.col("i.gap_high")), "left")
                         .select("g.sequence_id", F.lit(number).alias("round"), F.col("g.room").alias("gap"), "g.rank",
                                 F.col("i.size").isNotNull().alias("taken"),
                                 F.coalesce(_filled("g.room", "i.size", "i.low", "i.high", "i.each", at),
                                            F.col("g.room")).cast("int").alias("room")))
        opened = [i for i in found if i[8] is not None]
        if opened:
            first, last = opened[0][8], opened[-1][8] + opened[-1][6]
            # Met by stretches of ids, so that it is an equality join.
            stretch = F.expr(f"explode(sequence(sequence DIV {STRETCH}, (sequence + gap_high - 1) DIV {STRETCH}))")
            i = spark.createDataFrame(opened, INTERVALS).withColumn("stretch", stretch).alias("i")
            new = spark.range(first, last).withColumn("stretch", F.expr(f"id DIV {STRETCH}")).alias("n")
            at = F.col("n.id") - F.col("i.sequence")
            parts.append(new.join(i, (F.col("n.stretch") == F.col("i.stretch")) & (at >= 0) & (at < F.col("i.gap_high")))
                         .select(F.col("n.id").alias("sequence_id"), F.lit(number).alias("round"),
                                 F.lit(capacity).alias("gap"), at.alias("rank"), F.lit(False).alias("taken"),
                                 _filled("i.gap", "i.size", "i.low", "i.high", "i.each", at).cast("int").alias("room")))
        state = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        state = stored(state, "gaps")
        matched.append(state.filter("taken").select("sequence_id", "round", "gap", "rank"))
        gaps = state.filter("room > 0").select("sequence_id", "room")
        number += 1
    return _placed(spark, pieces, intervals, matched, capacity)


def _placed(spark, pieces, intervals, matched, capacity):
    keep = [c for c in pieces.columns if c != "_rank"]
    plan = F.broadcast(spark.createDataFrame(intervals, INTERVALS)).alias("i")   # two rows per size and round
    p = pieces.alias("p")
    own = [F.col(f"p.{c}") for c in keep]
    whole = p.filter(F.col("p.length") == capacity).select(
        *own, F.col("p._rank").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    index = F.col("p._rank") - F.col("i.low")
    by_rank = p.join(plan, (F.col("p.length") == F.col("i.size")) & (index >= 0) & (F.col("p._rank") < F.col("i.high")))
    slot = (index % F.col("i.each")) * F.col("i.size")
    place = F.floor(index / F.col("i.each"))
    opened = by_rank.filter("i.sequence IS NOT NULL").select(
        *own, (F.col("i.sequence") + place).alias("sequence_id"), slot.alias("offset"))
    out = whole.unionByName(opened)
    if matched:
        gaps = matched[0]
        for m in matched[1:]:
            gaps = gaps.unionByName(m)
        taken = by_rank.filter("i.sequence IS NULL").select(
            *own, F.col("i.round").alias("round"), F.col("i.gap").alias("gap"),
            (F.col("i.gap_low") + place).alias("rank"), (capacity - F.col("i.gap") + slot).alias("offset"))
        out = out.unionByName(taken.join(gaps, ["round", "gap", "rank"]).select(*keep, "sequence_id", "offset"))
    return out.select(*keep, F.col("sequence_id").cast("long").alias("sequence_id"),
                      F.col("offset").cast("long").alias("offset"))


def pack_documents(docs, vocabulary, end_id=0, capacity=CAPACITY, with_ids=False):
    """Pieces of ``docs`` with their places: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset, and ids if wanted."""
    return pack(cut_into_pieces(docs, vocabulary, end_id, capacity, with_ids), capacity)
