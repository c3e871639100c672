"""What the operators share: inputs, stored intermediate tables, ranks inside hot groups."""

import os
import tempfile
import zipfile

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

import pressmill
from pressmill.session import new_shared_path


def with_package(df):
    """``df``, after its session has sent this package to the workers, once.

    Functions that run in Python workers import it there; Spark's file server carries it.
    """
    context = df.sparkSession.sparkContext
    if not getattr(context, "_pressmill_sent", False):
        top = os.path.dirname(os.path.abspath(pressmill.__file__))
        path = os.path.join(tempfile.mkdtemp(), "pressmill-package.zip")
        with zipfile.ZipFile(path, "w") as package:
            for folder, _, names in os.walk(top):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        package.write(full, os.path.relpath(full, os.path.dirname(top)))
        context.addPyFile(path)
        context._pressmill_sent = True
    return df


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def stored(df, label, compression="zstd", partition_by=()):
    """Write to the shared folder and read back: cuts lineage, survives lost executors, and
    gives the next steps a known size.  Folders by ``partition_by`` can be read alone."""
    path = new_shared_path(df.sparkSession, label)
    df.write.option("compression", compression).partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(spark):
    """Into how many parts hot groups are dealt: as many as shuffles have partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


def ranked(df, key, order, out="rank", extra=()):
    """Add 0, 1, ... inside every value of ``key``; groups of any size.

    Rows are dealt into slices of a group, numbered there, and shifted by the sizes of the
    slices before; no task holds more than a slice of a group.  Store the result before
    it is used twice: ties may be numbered in any order.
    """
    n = slices(df.sparkSession)
    dealt = df.withColumn("_slice", F.monotonically_increasing_id() % n)
    inside = Window.partitionBy(key, "_slice").orderBy(*order)
    numbered = dealt.withColumn("_inside", F.row_number().over(inside).cast("long") - 1)
    sizes = dealt.groupBy(key, "_slice").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(key, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    return (numbered.join(shifts, [key, "_slice"])
            .withColumn(out, F.col("_inside") + F.col("_shift"))
            .drop("_slice", "_inside", "_shift"))


def keep_unmarked(docs, mark, marks):
    """Rows of ``docs`` without those whose ``mark`` (a string) is among ``marks``; of rows that share
    a mark with ``some``, one stays.

    ``marks`` is a stored table of mark and some.  Only rows that may have one of the marks are shuffled.
    """
    own = fresh(docs, "_mark")
    marked = docs.withColumn(own, mark)
    rest, possible = split_by_keys(marked, F.xxhash64(own), marks.select(F.xxhash64("mark").alias("key")))
    told = possible.alias("p").join(marks.alias("m"), F.col(f"p.{own}") == F.col("m.mark"), "left")
    carried = [F.col(f"p.`{c}`") for c in marked.columns]
    others = told.filter("m.mark IS NULL").select(*carried)
    twins = told.filter("m.some").select(*carried).dropDuplicates([own])
    return rest.unionByName(others).unionByName(twins).drop(own)


# ------------------------------------------------------------------ membership filters

MOST_BITS = 1 << 27        # bits of a membership filter at most: 16 MB
BUCKET = 32_768            # bits of one bucket of Spark's bitmaps
BITS_PER_KEY = 16


def bits_for(n):
    """Bits of a filter of ``n`` keys: a power of two, within a bound whatever the number."""
    return min(MOST_BITS, max(BUCKET, 1 << max(BITS_PER_KEY * n - 1, 1).bit_length()))


def bitmaps(keys, bits):
    """bucket, bitmap: the filter of a column of longs.  At most ``bits / BUCKET`` rows of 4 kB each."""
    bit = F.col(keys.columns[0]).bitwiseAND(F.lit(bits - 1)) + 1   # Spark's bitmaps count from one
    return (keys.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bitmap")))


def filter_bits(keys, bits):
    """The same filter as one array of bytes in the driver, ``bits / 8`` of them."""
    out = np.zeros(bits // 8, np.uint8)
    for row in bitmaps(keys, bits).collect():   # bounded by the size of the filter
        first = (row["bucket"] - 1) * (BUCKET // 8)
        out[first:first + BUCKET // 8] = np.frombuffer(row["bitmap"], np.uint8)
    return out


def may_be_in(filter_bytes, hashes):
    """Which of some unsigned 64-bit hashes a filter may hold; none that it holds is missed."""
    at = hashes & np.uint64(8 * len(filter_bytes) - 1)
    return (filter_bytes[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def fresh(df, name):
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def split_by_keys(df, key, keys):
    """Rows of ``df`` whose ``key`` (a column of longs) cannot be among ``keys``, and the others.

    ``keys`` is a stored table of one column of longs.  The filter that is broadcast has at most ``MOST_BITS``
    bits however many keys there are; beyond that more rows pass as possible ones, none is lost.
    So a join with the keys needs to shuffle only the rows that may meet one.
    """
    bits = bits_for(keys.count())
    bucket, bitmap, hit, own = (fresh(df, name) for name in ("_bucket", "_bitmap", "_hit", "_key"))
    filters = F.broadcast(bitmaps(keys, bits).select(F.col("bucket").alias(bucket), F.col("bitmap").alias(bitmap)))
    at = F.col(own).bitwiseAND(F.lit(bits - 1))
    place = F.shiftright(at, 3).bitwiseAND(F.lit(BUCKET // 8 - 1)).cast("int") + 1
    byte = F.conv(F.hex(F.substring(F.col(bitmap), place, F.lit(1))), 16, 10).cast("int")
    is_set = F.getbit(byte, at.bitwiseAND(F.lit(7)).cast("int")) == 1
    told = df.withColumn(own, key).withColumn(bucket, F.shiftright(at, 15) + 1).join(filters, bucket, "left").withColumn(hit, F.coalesce(is_set, F.lit(False)))
    told = told.select(*[F.col(f"`{c}`") for c in df.columns], hit)
    return told.filter(~F.col(hit)).drop(hit), told.filter(F.col(hit)).drop(hit)
