"""Operator 1: token ids as files, in a canonical length-limited Huffman code.

1. Every whole text is encoded once; ids are stored compactly (two bytes where they fit).
2. Global counts of ids: summed inside the tasks that encode, then grouped; at most one row per id of the
   vocabulary reaches the driver, which derives code lengths by package-merge.
3. Documents are coded where they lie, dealt by ranges of doc_id, sorted, and joined into
   blocks.  The files are Parquet tables with one block per row: ``part`` and ``block``
   give the order, ``payload`` holds the bits, ``checkpoints`` the bit offset of every
   ``LANE`` tokens.  Each block is decoded by itself, with a table, all its lanes at once.
   ``code`` holds the code lengths, which is all that a canonical code needs.

Null texts count as empty.  Null doc_ids come first; rows with equal doc_id follow each
other in any order, each with ids of its own.  An empty input gives empty tables.  Extra columns
are not read.  Documents of over ``PIECE`` tokens span several blocks, so no block or row
grows with a document.
"""

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from pressmill.llm.common import slices, stored, with_package
from pressmill.llm.tokens import encoder_for
from pressmill.session import new_shared_path

LONGEST = 16       # bits of the longest code word; 2 ** LONGEST entries decode it
LANE = 128         # tokens between two checkpoints
PIECE = 65_536     # tokens of one document in one block, at most
BLOCK = 262_144    # tokens after which a block is closed
CODED_AT_ONCE = 400_000


# ------------------------------------------------------------------ the code

def code_lengths(counts, longest=LONGEST):
    """Lengths of an optimal prefix code of at most ``longest`` bits (package-merge).

    ``counts`` is an array over all symbols; symbols with count zero get length zero.
    """
    counts = np.asarray(counts, dtype=np.int64)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    used = np.flatnonzero(counts)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    while 2 ** longest < len(used):
        longest += 1
    order = used[np.argsort(counts[used], kind="stable")]
    coins = counts[order]
    weights, rows = coins, []
    for _ in range(longest - 1):
        pairs = len(weights) // 2
        packages = weights[0:2 * pairs:2] + weights[1:2 * pairs:2]
        both = np.concatenate([coins, packages])
        place = np.argsort(both, kind="stable")
        rows.append(place < len(coins))   # which entries of this level are single coins
        weights = both[place]
    take, depth = 2 * len(coins) - 2, np.zeros(len(coins), dtype=np.int64)
    for single in reversed(rows):
        n = int(single[:take].sum())
        depth[:n] += 1
        take = 2 * (take - n)
    depth[:take] += 1
    lengths[order] = depth
    return lengths


def code_words(lengths):
    """Canonical code words: in order of length, then of symbol."""
    lengths = np.asarray(lengths)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    words = np.zeros(len(lengths), dtype=np.uint64)
    word = last = 0
    for symbol in order.tolist():
        length = int(lengths[symbol])
        word <<= length - last
        words[symbol] = word
        word, last = word + 1, length
    return words


def decode_table(lengths):
    """Symbol and length for every pattern of as many bits as the longest word has."""
    bits = max(int(np.max(lengths, initial=1)), 1)
    words = code_words(lengths)
    symbols, sizes = np.zeros(2 ** bits, dtype=np.uint32), np.ones(2 ** bits, dtype=np.int64)
    used = np.flatnonzero(lengths)
    first = words[used].astype(np.int64) << (bits - lengths[used].astype(np.int64))
    order = np.argsort(first)
    used, spans = used[order], (1 << (bits - lengths[used][order].astype(np.int64)))
    total = int(spans.sum())
    symbols[:total] = np.repeat(used, spans)
    sizes[:total] = np.repeat(lengths[used].astype(np.int64), spans)
    return bits, symbols, sizes


def lanes_of(lengths, lane=LANE):
    """For pieces of the given lengths: piece of each lane, and its first token in the piece."""
    lanes = -(-lengths // lane)
    piece = np.repeat(np.arange(len(lengths)), lanes)
    within = np.arange(len(piece)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    return lanes, piece, within * lane


def pack_bits(ids, counts, lengths, words):
    """Code pieces that begin at whole bytes.

    Returns the bytes of each piece and the bit offsets of its lanes, from its own start.
    """
    counts = np.asarray(counts, dtype=np.int64)
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    firsts = np.cumsum(counts) - counts
    padded = np.concatenate([ends, [0]])
    bits_before = np.where(firsts > 0, padded[firsts - 1], 0)
    lasts = np.cumsum(counts)
    bits = np.where(lasts > 0, padded[lasts - 1], 0) - bits_before
    taken = (bits + 7) // 8
    starts = (np.cumsum(taken) - taken) * 8
    at = ends - size + np.repeat(starts - bits_before, counts)
    word, off = at >> 5, at & 31
    shifted = words[ids] << (64 - off - size).astype(np.uint64)
    total = int(taken.sum()) // 4 + 2
    # Codes fill disjoint bits, so these sums stay below 2 ** 32 and are exact.
    high = np.bincount(word, (shifted >> np.uint64(32)).astype(np.float64), total)
    low = np.bincount(word + 1, (shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), total)
    raw = (high + low).astype(">u4").tobytes()
    lanes, piece, within = lanes_of(counts)
    offsets = (at[firsts[piece] + within] - starts[piece]).astype("<i4").tobytes()
    payloads = [raw[s:s + n] for s, n in zip((starts // 8).tolist(), taken.tolist())]
    lane_ends = (np.cumsum(lanes) * 4).tolist()
    return payloads, [offsets[e - 4 * n:e] for e, n in zip(lane_ends, lanes.tolist())]


def unpack_bits(payload, checkpoints, counts, table):
    """Ids of all pieces of a block, in a row."""
    bits, symbols, sizes = table
    counts = np.asarray(counts, dtype=np.int64)
    b = np.frombuffer(payload + b"\0" * 8, dtype=np.uint8).astype(np.uint32)
    window = (b[:-3] << np.uint32(24)) | (b[1:-2] << np.uint32(16)) | (b[2:-1] << np.uint32(8)) | b[3:]
    window = window.astype(np.int64)
    _, piece, within = lanes_of(counts)
    firsts = (np.cumsum(counts) - counts)[piece] + within
    n = np.minimum(counts[piece] - within, LANE)
    order = np.argsort(-n, kind="stable")
    at, firsts, n = np.asarray(checkpoints, dtype=np.int64)[order], firsts[order], n[order]
    out, mask = np.zeros(int(counts.sum()), dtype="<u4"), (1 << bits) - 1
    left = len(n) - np.cumsum(np.bincount(n, minlength=LANE + 1))
    for step in range(int(n.max(initial=0))):
        live = int(left[step])   # lanes with more tokens than ``step``
        at, firsts = at[:live], firsts[:live]
        seen = (window[at >> 3] >> (32 - bits - (at & 7))) & mask
        out[firsts + step] = symbols[seen]
        at = at + sizes[seen]
    return out


def crc32_joined(pieces):
    """CRC-32 of a row of byte strings from (crc, bytes) of each."""
    def times(matrix, vector):
        out, i = 0, 0
        while vector:
            if vector & 1:
                out ^= matrix[i]
            vector, i = vector >> 1, i + 1
        return out

    total, first = 0, True
    for crc, n in pieces:
        if first:
            total, first = crc, False
            continue
        step = [0xEDB88320] + [1 << i for i in range(31)]   # one zero bit
        for _ in range(3):                                  # eight: one zero byte
            step = [times(step, v) for v in step]
        while n:
            if n & 1:
                total = times(step, total)
            step, n = [times(step, v) for v in step], n >> 1
        total ^= crc
    return total


# ------------------------------------------------------------------ writing

def _encoded(vocabulary, end_id, dtype, size):
    """Rows (doc_id, ids), and behind them one row per task (counted) with the ids it used and their counts."""
    names = ["doc_id", "ids", "counted"]
    counted = pa.list_(pa.struct([("id", pa.int64()), ("n", pa.int64())]))

    def run(batches):
        encoder = encoder_for(vocabulary)
        end = np.asarray([] if end_id is None else [end_id], dtype="<u4").tobytes()
        counts = np.zeros(size, dtype=np.int64)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for at in range(0, len(keys), 256):
                ids = [np.frombuffer(encoder.encode(t.as_py()) + end, "<u4").astype(dtype) for t in texts.slice(at, 256)]
                counts += np.bincount(np.concatenate(ids), minlength=size)
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(at, 256).cast(pa.int64()), pa.array([i.tobytes() for i in ids], pa.binary()), pa.nulls(len(ids), counted)], names)
        used = np.flatnonzero(counts)
        pairs = pa.StructArray.from_arrays([pa.array(used, pa.int64()), pa.array(counts[used], pa.int64())], ["id", "n"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(used)], pa.int32()), pairs)], names)
    return run


def _coded(dtype, lengths, bounds):
    """Rows (part, doc_id, row, piece, pieces, n, lanes, payload): documents, coded."""
    names = ["part", "doc_id", "row", "piece", "pieces", "n", "lanes", "payload"]

    def run(batches):
        words = code_words(lengths)

        def flush(meta, parts):
            counts = [m[5] for m in meta]
            payloads, lanes = pack_bits(np.concatenate(parts), counts, lengths, words)
            columns = list(zip(*meta)) + [lanes, payloads]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for batch in batches:
            meta, parts, held = [], [], 0
            for doc_id, row, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                ids = np.frombuffer(ids.as_buffer(), dtype)
                part = 0 if doc_id is None else int(np.searchsorted(bounds, doc_id))
                pieces = max(-(-len(ids) // PIECE), 1)
                for k in range(pieces):
                    cut = ids[k * PIECE:(k + 1) * PIECE]
                    meta.append((part, doc_id, row, k, pieces, len(cut)))
                    parts.append(cut)
                    held += len(cut)
                    if held >= CODED_AT_ONCE:
                        yield flush(meta, parts)
                        meta, parts, held = [], [], 0
            if meta:
                yield flush(meta, parts)
    return run


BLOCK_TYPE = ("part int, block int, n_tokens long, doc_ids array<long>, rows array<long>, pieces array<int>, "
              "piece_counts array<int>, counts array<int>, checkpoints array<int>, payload binary")


def _blocks(batches):
    """Join coded documents, sorted by part, into blocks."""
    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("n_tokens", pa.int64()),
                        ("doc_ids", pa.list_(pa.int64())), ("rows", pa.list_(pa.int64())),
                        ("pieces", pa.list_(pa.int32())), ("piece_counts", pa.list_(pa.int32())),
                        ("counts", pa.list_(pa.int32())), ("checkpoints", pa.list_(pa.int32())),
                        ("payload", pa.binary())])
    part = block = size = 0
    held = []

    def flush():
        lanes, shift = [], 0
        for r in held:
            lanes.append(np.frombuffer(r["lanes"], "<i4") + 8 * shift)
            shift += len(r["payload"])
        values = [part, block, size, [r["doc_id"] for r in held], [r["row"] for r in held],
                  [r["piece"] for r in held], [r["pieces"] for r in held], [r["n"] for r in held],
                  np.concatenate(lanes), b"".join(r["payload"] for r in held)]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)

    for batch in batches:
        for r in batch.to_pylist():
            if held and (r["part"] != part or size >= BLOCK):
                yield flush()
                block = block + 1 if r["part"] == part else 0
                held, size = [], 0
            elif r["part"] != part:
                block = 0
            part = r["part"]
            held.append(r)
            size += r["n"]
    if held:
        yield flush()


def write_token_files(docs, path, vocabulary, end_id=None, text="text"):
    """Encode ``docs`` (doc_id, text) and write ``path``/blocks and ``path``/code."""
    from tokenizers import Tokenizer

    spark = with_package(docs).sparkSession
    size = max(max(Tokenizer.from_file(vocabulary).get_vocab().values()), end_id or 0) + 1
    dtype = "<u2" if size <= 65_536 else "<u4"
    encoded = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
                     .mapInArrow(_encoded(vocabulary, end_id, dtype, size),
                                 "doc_id long, ids binary, counted array<struct<id:long,n:long>>"), "token-ids")
    ids = encoded.filter("counted IS NULL").select("doc_id", "ids")
    counts = np.zeros(size, dtype=np.int64)
    summed = encoded.select(F.inline("counted")).groupBy("id").agg(F.sum("n").alias("n"))
    for row in summed.collect():   # at most one row per id of the vocabulary
        counts[row["id"]] = row["n"]
    lengths = code_lengths(counts)
    used = np.flatnonzero(lengths)
    code = spark.createDataFrame(pd.DataFrame({"id": used.astype("int64"), "bits": lengths[used].astype("int32")}),
                                 "id long, bits int").coalesce(1)
    code.write.parquet(f"{path}/code")
    parts = slices(spark)
    shares = [i / parts for i in range(1, parts)]
    bounds = ids.select(F.percentile_approx("doc_id", shares, 100 * parts) if shares
                        else F.array().cast("array<long>")).first()[0]
    bounds = np.unique(np.asarray(bounds or [], dtype=np.int64))
    coded = (ids.select("doc_id", F.monotonically_increasing_id().alias("row"), "ids")
             .mapInArrow(_coded(dtype, lengths, bounds),
                         "part int, doc_id long, row long, piece int, pieces int, n int, lanes binary, payload binary"))
    (coded.repartitionById(len(bounds) + 1, F.col("part"))
     .sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "row", "piece")
     .mapInArrow(_blocks, BLOCK_TYPE)
     .write.option("compression", "uncompressed").parquet(f"{path}/blocks"))
    return path


# ------------------------------------------------------------------ reading

def _read_code(spark, path):
    rows = spark.read.parquet(f"{path}/code").collect()   # bounded by the vocabulary
    lengths = np.zeros(max([r["id"] for r in rows], default=0) + 1, dtype=np.uint8)
    for r in rows:
        lengths[r["id"]] = r["bits"]
    return lengths


PIECE_TYPE = "part int, block int, place long, doc_id long, row long, piece int, pieces int, n int, crc long"


def _decoded(lengths, with_ids):
    def run(batches):
        table = decode_table(lengths)
        for batch in batches:
            for b in range(batch.num_rows):
                r = {name: batch.column(i)[b] for i, name in enumerate(batch.schema.names)}
                counts = np.asarray(r["counts"].values, dtype=np.int64)
                ids = unpack_bits(r["payload"].as_py(), r["checkpoints"].values, counts, table)
                raw, ends = ids.tobytes(), np.cumsum(counts)
                cuts = [raw[4 * s:4 * e] for s, e in zip((ends - counts).tolist(), ends.tolist())]
                k = len(counts)
                columns = [pa.array([r["part"].as_py()] * k, pa.int32()), pa.array([r["block"].as_py()] * k, pa.int32()),
                           pa.array(ends - counts, pa.int64()), r["doc_ids"].values, r["rows"].values,
                           r["pieces"].values, r["piece_counts"].values, r["counts"].values,
                           pa.array([zlib.crc32(c) for c in cuts], pa.int64())]
                names = ["part", "block", "place", "doc_id", "row", "piece", "pieces", "n", "crc"]
                if with_ids:
                    columns, names = columns + [pa.array(cuts, pa.binary())], names + ["ids"]
                yield pa.RecordBatch.from_arrays(columns, names)
    return run


def read_pieces(spark, path, with_ids=False):
    """Pieces of documents from the files: place in the block, length, CRC-32, and the ids
    (little-endian unsigned 32-bit) if wanted."""
    blocks = with_package(spark.read.parquet(f"{path}/blocks")).select(
        "part", "block", "doc_ids", "rows", "pieces", "piece_counts", "counts", "checkpoints", "payload")
    return blocks.mapInArrow(_decoded(_read_code(spark, path), with_ids),
                             PIECE_TYPE + (", ids binary" if with_ids else ""))


def _joined_crc(pieces):
    return crc32_joined([(p["crc"], 4 * p["n"]) for p in pieces])


def read_documents(spark, path):
    """One row per document, from the files alone: doc_id, start (ids of all documents
    before it), n_tokens, ids_crc32."""
    headers = spark.read.parquet(f"{path}/blocks").select("part", "block", "n_tokens")
    parts = headers.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # One row per part of the files.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = headers.select("part", "block", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("block_start"))
    starts = starts.join(parts, "part").select(
        "part", "block", (F.col("part_start") + F.col("block_start")).alias("block_start"))
    pieces = stored(read_pieces(spark, path), "pieces").join(starts, ["part", "block"]).withColumn(
        "start", F.col("block_start") + F.col("place"))
    whole = pieces.filter("pieces = 1").select("doc_id", "start", F.col("n").cast("long").alias("n_tokens"),
                                               F.col("crc").alias("ids_crc32"))
    # Few: documents of over PIECE tokens, each with as many entries as it has pieces.
    cut = (pieces.filter("pieces > 1").groupBy("row")
           .agg(F.first("doc_id").alias("doc_id"), F.min("start").alias("start"),
                F.sum("n").cast("long").alias("n_tokens"),
                F.sort_array(F.collect_list(F.struct("piece", "n", "crc"))).alias("all"))
           .select("doc_id", "start", "n_tokens", F.udf(_joined_crc, "long")("all").alias("ids_crc32")))
    return whole.unionByName(cut)


def token_files(docs, vocabulary, end_id=2):
    """Write ``docs`` to new files in the shared folder; returns their path."""
    return write_token_files(docs, new_shared_path(docs.sparkSession, "token-files"), vocabulary, end_id)
