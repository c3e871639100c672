"""Incremental ingest and running counts with Structured Streaming."""

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from pressmill.functions import dates
from pressmill.operators.etl import insert_if_absent


def ingest_stream(stream, store_path, checkpoint, order, prepare=None):
    """Append articles with new URLs to a Parquet store as they arrive (STR1).

    Save or skip by URL, however late an article is: of a batch the first row per URL
    counts, and the batch is anti-joined with the store, so a URL enters it once.  No state
    is kept between batches.  A batch repeated after a failure finds its own rows and
    adds nothing.
    """
    def append(batch, _batch_id):
        spark = batch.sparkSession
        rows = prepare(batch) if prepare else batch
        try:
            store = spark.read.schema(rows.schema).parquet(store_path)
        except Exception as e:  # the first batch meets no store
            if "PATH_NOT_FOUND" not in str(e):
                raise
            store = spark.createDataFrame([], rows.schema)
        new = insert_if_absent(store, rows, order(rows)).select(*rows.columns)
        new.write.mode("append").parquet(store_path)

    return (stream.writeStream.foreachBatch(append)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


KEY_BUCKETS = 64           # folders of known URLs
BITMAP_BITS = 4_096 * 8    # bits of one bitmap of Spark's ``bitmap_construct_agg``
KEY_SCHEMA = "url string, bucket int"
FILTER_SCHEMA = "bucket int, slot long, bits binary"


def ingest_by_keys(stream, path, checkpoint, order, prepare=None, slots=64, merge_every=20):
    """Append articles with new URLs below ``path``, asking a table of keys instead of the whole store (STR1).

    Known URLs lie in ``KEY_BUCKETS`` folders by hash, and beside them one membership filter per bucket: ``slots``
    bitmaps of 32 768 bits.  The URLs of a batch meet the filters first, and only buckets that may
    hold one of them are read; a batch of new articles reads next to none.  A filter that is too full lets more
    buckets be read and loses nothing; choose ``slots`` so that a bucket has some 20 bits for each URL.

    Every batch replaces its own folders of rows, keys and filters and asks those of earlier batches, so one
    repeated after a failure changes nothing.  Of a batch the first row per URL counts, rows without URL are left out,
    and an article may be as late as it likes.  Keys and filters are merged after ``merge_every`` batches; rows stay as they are.
    """
    root = path.rstrip("/")

    def append(batch, batch_id):
        spark = batch.sparkSession
        rows = prepare(batch) if prepare else batch
        first = Window.partitionBy("url").orderBy(*order(rows))
        rows = (rows.filter("url IS NOT NULL").withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn"))
        # Read by the probe, the anti join and three writes.
        arrived = f"{root}/arrived/batch={batch_id}"
        rows.write.mode("overwrite").parquet(arrived)
        rows = spark.read.schema(rows.schema).parquet(arrived)
        known = known_keys(spark, root, rows, slots, before=batch_id)
        new = f"{root}/rows/batch={batch_id}"
        rows.join(known.select("url"), "url", "left_anti").select(*rows.columns).write.mode("overwrite").parquet(new)
        urls = _hashed(spark.read.schema(rows.schema).parquet(new), slots)
        urls.select("url", "bucket").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/keys/batch={batch_id}")
        (urls.groupBy("bucket", "slot").agg(F.bitmap_construct_agg("bit").alias("bits"))
         .write.mode("overwrite").parquet(f"{root}/filters/batch={batch_id}"))
        _dropped(f"{root}/arrived", f"batch={batch_id}")
        _merged(spark, f"{root}/keys", merge_every, lambda k: k.repartition("bucket"), KEY_SCHEMA, ["bucket"])
        _merged(spark, f"{root}/filters", merge_every, lambda f: f.groupBy("bucket", "slot").agg(F.bitmap_or_agg("bits").alias("bits")), FILTER_SCHEMA)

    return (stream.writeStream.foreachBatch(append)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def read_rows(spark, path, schema):
    """The articles of all batches."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{path.rstrip('/')}/rows")


def _hashed(rows, slots):
    """URLs with their bucket and their bit in its filter."""
    h = F.xxhash64("url")
    place = F.pmod(F.xxhash64("url", F.lit("bit")), F.lit(slots * BITMAP_BITS))
    return rows.select("url", F.pmod(h, F.lit(KEY_BUCKETS)).cast("int").alias("bucket"), (place / F.lit(BITMAP_BITS)).cast("long").alias("slot"),
                       (place % F.lit(BITMAP_BITS)).alias("bit"))


def known_keys(spark, path, rows, slots, before=None):
    """Keys of the buckets that may hold a URL of ``rows``, of batches before number ``before``."""
    filters = _folders(f"{path}/filters", before)
    if not filters:
        return spark.createDataFrame([], KEY_SCHEMA)
    # The byte of the bit, as Spark has no test of one bit of a binary.
    byte = F.conv(F.hex(F.substring("bits", (F.col("bit") / F.lit(8)).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.expr("bits IS NOT NULL") & (F.getbit(byte, (F.col("bit") % F.lit(8)).cast("int")) == 1)
    met = _hashed(rows, slots).join(spark.read.schema(FILTER_SCHEMA).parquet(*filters), ["bucket", "slot"]).filter(held)
    buckets = [r["bucket"] for r in met.select("bucket").distinct().collect()]   # at most KEY_BUCKETS
    return _read(spark, _folders(f"{path}/keys", before), KEY_SCHEMA).filter(F.col("bucket").isin(buckets))


def daily_counts(rows, time, *keys):
    """Counts per day and key of a batch or a table (STR2)."""
    return rows.groupBy(dates.day(time).alias("day"), *keys).agg(F.count("*").alias("cnt"))


def _listed(path):
    """File system, root, and the numbers of batches and of finished totals below ``path``."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    names = [f.base_name for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True))]
    batches = sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))
    totals = sorted(int(n.removeprefix("total=")) for n in names if n.startswith("total="))
    done = [n for n in totals if system.get_file_info(f"{root}/total={n}/_SUCCESS").is_file]
    return system, root, batches, done


def _folders(path, before=None):
    """Folders of the last total and of the batches after it; only of batches before a number, if one is given."""
    _, _, batches, done = _listed(path)
    if before is not None:
        batches, done = [n for n in batches if n < before], [n for n in done if n < before]
    since = done[-1] if done else -1
    return [f"{path}/total={since}"] * bool(done) + [f"{path}/batch={n}" for n in batches if n > since]


def _read(spark, folders, schema=None):
    """Rows of some folders, each of which may be partitioned."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reduce(lambda a, b: a.unionByName(b), [reader.parquet(f) for f in folders])


def _summed(counts):
    return counts.groupBy(*[c for c in counts.columns if c != "cnt"]).agg(F.sum("cnt").alias("cnt"))


def _dropped(path, *names):
    system, root, _, _ = _listed(path)
    for name in names:
        system.delete_dir(f"{root}/{name}")


def _merged(spark, path, merge_every, combine, schema=None, folders_by=()):
    """Combine the batches after the last total into a new one if there are ``merge_every``; can be repeated at any point."""
    _, _, batches, done = _listed(path)
    new = [n for n in batches if not done or n > done[-1]]
    if len(new) >= max(merge_every, 1):
        combine(_read(spark, _folders(path), schema)).write.mode("overwrite").partitionBy(*folders_by).parquet(f"{path}/total={new[-1]}")
        done.append(new[-1])
    if len(done) > 1:
        _dropped(path, *[f"total={n}" for n in done[:-2]], *[f"batch={n}" for n in batches if n <= done[-2]])


def keep_counts(stream, count, path, checkpoint, merge_every=20):
    """Write the counts of every batch of a stream below ``path``, and merge them now and then.

    ``count`` maps the rows of a batch to additive counts.  Batches hold their own rows
    only, so there is no state to keep and no row is too late; a batch repeated after a
    failure replaces its folder.

    After ``merge_every`` batches a total of all until then is written, ``total=N`` for the batches up to N.  It counts once
    its ``_SUCCESS`` is there, so readers see the old state or the new.  A batch that a total holds already adds nothing
    when it is repeated.  What the total before the last one holds is deleted: readers that began before the last merge end well,
    and at most two totals and twice ``merge_every`` batches are kept.
    """
    def write(batch, batch_id):
        path_ = path.rstrip("/")
        _, _, _, done = _listed(path_)
        if not done or batch_id > done[-1]:
            count(batch).write.mode("overwrite").parquet(f"{path_}/batch={batch_id}")
        merge_counts(batch.sparkSession, path_, merge_every)
    return (stream.writeStream.foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def merge_counts(spark, path, merge_every=1):
    """Merge the batches after the last total if there are ``merge_every``; can be repeated at any point."""
    _merged(spark, path, merge_every, _summed)


def read_counts(spark, path, *keys):
    """Sums over all batches."""
    return _read(spark, _folders(path) or [path]).groupBy("day", *keys).agg(F.sum("cnt").alias("cnt"))
