"""Consecutive numbers over data of any size.

``row_number()`` over an unpartitioned (or one hot) window sorts everything in one
task.  Here rows are range-partitioned by the sort keys and stored, each with its place
inside its range; places are then shifted by the sizes of the ranges before.  The rows carry their
numbers themselves: nothing is joined back by a key, so null and repeated keys are numbered like
all others, and rows are ranged once.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from pressmill.session import new_shared_path

RANGE = 33   # monotonically_increasing_id() holds the partition above this bit


def _fresh(df, name):
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def number_rows(df, order, out="row_no", group=()):
    """``df`` with 1..n in ``order``, restarting for every value of the columns ``group``.

    Rows that are equal in ``order`` are told apart by a hash of all their columns; of rows equal
    in everything, either may come first.  The hash also spreads such rows over ranges,
    so ``order`` need not be unique.  An empty table gives no rows.
    """
    spark, group = df.sparkSession, list(group)
    place, part = _fresh(df, "_place"), _fresh(df, "_range")
    hashable = [F.col(f"`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString()
                and "variant" not in f.dataType.simpleString()]
    keys = [F.col(f"`{g}`").asc_nulls_first() for g in group] + list(order) + [F.xxhash64(*hashable)]
    # The sampling of ranges reads its input once more: what is costly to compute, or may come out
    # in another way, is stored first.
    path = new_shared_path(spark, "unnumbered")
    df.write.option("compression", "zstd").parquet(path)
    df = spark.read.schema(df.schema).parquet(path)
    # All uses below must see the same ranges, so these are stored too.
    path = new_shared_path(spark, "numbered")
    (df.repartitionByRange(*keys).sortWithinPartitions(*keys)
     .withColumn(place, F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path))
    schema = df.withColumn(place, F.lit(0).cast("long")).schema
    ranged = spark.read.schema(schema).parquet(path).withColumn(part, F.shiftright(place, RANGE))
    aliased = [F.col(f"`{g}`").alias(f"g{i}") for i, g in enumerate(group)]
    names = [f"g{i}" for i in range(len(group))]
    chunks = (ranged.select(F.col(part).alias("part"), F.col(place).alias("place"), *aliased).groupBy("part", *names)
              .agg(F.count("*").alias("n"), F.min("place").alias("first")))
    # At most one row per range for one group: the window stays small.
    before = Window.partitionBy(*(names or [F.lit(0)])).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    if not group:
        chunks = F.broadcast(chunks)   # one row per range
    same = F.col(f"r.{part}") == F.col("c.part")
    for g, name in zip(group, names):
        same = same & F.col(f"r.`{g}`").eqNullSafe(F.col(f"c.{name}"))
    number = (F.col(f"r.{place}") - F.col("c.first") + F.col("c.before") + 1).alias(out)
    carried = [F.col(f"r.`{c}`") for c in df.columns if c != out]
    return ranged.alias("r").join(chunks.alias("c"), same).select(*carried, number)
