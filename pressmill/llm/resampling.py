"""Operator 11: documents that resemble a target, drawn by hashed n-gram importance weights.

1. Texts are read as UTF-8 bytes.  One table of 256 bytes lower-cases A-Z and blanks whatever separates
   words (ASCII other than letters and digits); ``bytes.split`` then yields the words.  Bytes of other
   letters are never ASCII, so nothing needs to be decoded.
2. Features are all runs of one to three words.  The CRC-32 of a run is that of the run before, with
   the next blank and word as its continuation: ``zlib.crc32`` is seeded with what it gave.
3. Counters in the tasks count features by bucket (CRC-32 modulo ``BUCKETS``); at most ``BUCKETS`` rows of a
   task are summed in Spark, and ``BUCKETS`` rows reach the driver.
4. A bucket's gain is the logarithm of its share in the target over its share in the documents, in
   thousandths, rounded down.  The gains (80 kB) go to all tasks; a document's weight is the sum over its features.
5. Weight plus Gumbel noise, derived from the doc_id, ranks the documents: the highest are a draw without
   replacement by importance.  Ranks come from ranges of scores that the tasks sort.

Long texts are read in slices that end at a blank, the last two words carried on.  Null and empty
texts have no features, weight 0 and no rank, as have all texts of fewer than ``least`` words.  A null doc_id has
the noise of an empty one and comes last among ties; rows that repeat a doc_id have the same noise and are ranked
each by itself, by n_features where the scores tie.  An empty target makes every gain that of no
observation; an empty table gives no rows.  Extra columns are not read.
"""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pressmill.llm.common import stored, with_package
from pressmill.operators.numbering import number_rows

BUCKETS = 10_000
LONGEST = 3                # words of a feature
LEAST_WORDS = 20           # words of a document that can be drawn
PERCENT = 5
SEED = 42
SLICE = 1 << 20            # bytes of a text that are split at once


def translation():
    """The byte table: A-Z become a-z; ASCII but letters and digits becomes a blank."""
    table = bytearray(range(256))
    for c in range(128):
        letter = chr(c).lower()
        table[c] = ord(letter) if letter.isalnum() else 0x20
    return bytes(table)


def word_slices(raw, table, size=SLICE):
    """Words of a text given as bytes, in lists of about ``size`` bytes."""
    at = 0
    while at < len(raw):
        end = at + size
        cut = raw[at:end].translate(table)
        # A word is not torn: the slice goes on to the next blank.
        while end < len(raw) and not cut.endswith(b" "):
            more = raw[end:end + 4096].translate(table)
            stop = more.find(b" ")
            cut += more if stop < 0 else more[:stop + 1]
            end += len(more) if stop < 0 else stop + 1
        yield cut.split()
        at = end


def feature_hashes(words, before=(), longest=LONGEST):
    """CRC-32 of every run of one to ``longest`` words that ends in ``words``; ``before`` holds the words
    in front of them."""
    before = list(before)[-(longest - 1):] if longest > 1 else []
    every = before + words
    spaced = [b" " + w for w in every]
    out, seeds = [], list(map(zlib.crc32, every))
    out.extend(seeds[len(before):])
    for n in range(1, longest):
        seeds = list(map(zlib.crc32, spaced[n:], seeds))
        out.extend(seeds[max(len(before) - n, 0):])
    return out


def _buckets(raw, table, buckets, longest):
    """Arrays of the buckets of a text's features, and counts of words, slice by slice."""
    before = []
    for words in word_slices(raw, table):
        hashes = feature_hashes(words, before, longest)
        yield np.asarray(hashes, np.int64) % buckets, len(words)
        before = (before + words)[-(longest - 1):] if longest > 1 else []


def _counted(table, buckets, longest):
    def run(batches):
        counts = Counter()
        for batch in batches:
            for text in batch.column(0):
                for found, _ in _buckets(text.as_py() or b"", table, buckets, longest):
                    counts.update(found.tolist())
        yield pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["bucket", "n"])
    return run


def bucket_counts(texts, text="text", buckets=BUCKETS, longest=LONGEST):
    """How many features of all ``texts`` are in each bucket: an array."""
    rows = with_package(texts).select(F.col(text).cast("binary")).mapInArrow(
        _counted(translation(), buckets, longest), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = [0] * buckets
    for row in rows.collect():   # at most one row per bucket
        counts[row["bucket"]] = row["n"]
    return counts


def gains(source, target):
    """Thousandths of the logarithm of the smoothed share in ``target`` over that in ``source``, rounded down."""
    size, s, t = len(source), float(sum(source) + len(source)), float(sum(target) + len(target))
    return np.asarray([math.floor(1000 * math.log((float(target[b] + 1) * s) / (float(source[b] + 1) * t))) for b in range(size)], np.int64)


def _weighed(table, gain, longest):
    def run(batches):
        for batch in batches:
            n_words, n_features, weights = [], [], []
            for text in batch.column(1):
                words = features = weight = 0
                for found, n in _buckets(text.as_py() or b"", table, len(gain), longest):
                    words, features, weight = words + n, features + len(found), weight + int(gain[found].sum())
                n_words.append(words)
                n_features.append(features)
                weights.append(weight)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in (n_words, n_features, weights))],
                                             ["doc_id", "n_words", "n_features", "weight"])
    return run


def noise(doc_id, seed=SEED):
    """Gumbel noise in thousandths, rounded down, from the SHA-256 of ``seed:doc_id``."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weights(docs, target, text="text", target_text="text", buckets=BUCKETS, longest=LONGEST):
    """doc_id, n_words, n_features, weight: one row per document."""
    gain = gains(bucket_counts(docs, text, buckets, longest), bucket_counts(target, target_text, buckets, longest))
    return with_package(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(
        _weighed(translation(), gain, longest), "doc_id long, n_words long, n_features long, weight long")


def resample(docs, target, percent=PERCENT, least=LEAST_WORDS, text="text", target_text="text", buckets=BUCKETS, longest=LONGEST, seed=SEED):
    """doc_id, n_words, n_features, weight, score, rank: one row per document; rank is null where it isn't drawn.

    Of the N documents of ``least`` words or more, floor(percent * N / 100) are drawn.
    """
    scored = weights(docs, target, text, target_text, buckets, longest)
    scored = stored(scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored")
    long_enough = F.col("n_words") >= least
    drawn = percent * scored.filter(long_enough).count() // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features")]
    ranked = number_rows(scored.filter(long_enough), order, out="rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranked.unionByName(scored.filter(~long_enough).withColumn("rank", F.lit(None).cast("long")))
