"""Substring search that does not read all bodies: trigram postings, intersected, then verified.

``build`` stores the articles as they are dealt, one shelf per input partition, so no text is shuffled.  Every row
gets a key, and every run of three characters of title and body, ASCII letters in lower case, gets a posting: the keys of a
shelf that hold it.  A posting is never longer than a shelf has rows, however common its trigram is.

A search cuts its pattern at the wildcards, reads the postings of the trigrams of what is left (few folders, and of
these only row groups that hold them), intersects them shelf by shelf, and compares the articles left with
the pattern.  What the postings let pass is a superset, so the rows are those of a full scan.  A pattern without
three characters in a row has no trigram; it scans all articles.

Null and empty titles and bodies have no trigrams and match as in the scan; rows that are equal, or share an id,
have keys of their own; an empty table gives no rows.
"""

import re
import string
import sys

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import functions as F

from pressmill.operators.browse import newest_first, preview, search_matches

BUCKETS = 64      # folders of postings
PARTS = 16        # a bucket is written by up to this many tasks, each with shelves of its own
SLICE = 100_000   # characters of a text that are cut into trigrams at a time
PAIRS = 1 << 20   # pairs of trigram and key that a task gathers before it sends them as lists
NAMED = 1_000     # so many keys go into the filter of the scan; more are joined

KEY, SHELF, BUCKET = "_index_key", "_index_shelf", "_index_bucket"
FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)

register_pickle_by_value(sys.modules[__name__])   # workers need not have the package


def build(df, path):
    """Store ``df`` and its postings below a new ``path``; columns ``title`` and ``content`` are indexed."""
    spark = df.sparkSession
    keyed = df.withColumn(KEY, F.monotonically_increasing_id())
    shelved = keyed.withColumn(SHELF, F.shiftright(KEY, 33).cast("int"))
    shelved.write.partitionBy(SHELF).option("compression", "zstd").parquet(f"{path}/articles")
    grams = _grams(spark.read.schema(shelved.schema).parquet(f"{path}/articles"))
    # Postings are complete after the first shuffle; the second moves finished lists to their folders.
    bucket = F.pmod(F.xxhash64("gram"), F.lit(BUCKETS)).cast("int")
    postings = (grams.groupBy("gram", SHELF).agg(F.sort_array(F.flatten(F.collect_list("keys"))).alias("keys"))
                .withColumn(BUCKET, bucket))
    (postings.repartition(BUCKET, F.pmod(SHELF, F.lit(PARTS))).sortWithinPartitions(BUCKET, "gram", SHELF)
     .write.partitionBy(BUCKET).option("compression", "zstd").parquet(f"{path}/postings"))
    return Index(spark, path, df.schema)


def _grams(stored):
    """Parts of postings, as (gram, shelf, keys): a task gathers the keys of many rows before it sends a trigram."""
    return stored.select(SHELF, KEY, "title", "content").mapInArrow(_parts, f"gram string, {SHELF} int, keys array<long>")


def _codes(raw):
    """Distinct trigrams of a text (UTF-8) as numbers of three times 21 bits; long texts by slices that overlap by two."""
    text, found = raw if raw.isascii() else raw.decode("utf-8", "replace"), []
    for at in range(0, len(text) - 2, SLICE):
        cut = text[at:at + SLICE + 2]
        c = np.frombuffer(cut, np.uint8) if cut.__class__ is bytes else np.frombuffer(cut.encode("utf-32-le"), "<u4")
        c = c.astype(np.int64)
        c += 32 * ((c >= 65) & (c <= 90))
        found.append(np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:]))
    return found


def _parts(batches):
    """Arrow function behind ``_grams``; holds some more than ``PAIRS`` pairs of trigram and key."""
    shelf, codes, keys, held = None, [], [], 0

    def part():
        code = np.concatenate(codes)
        order = np.argsort(code, kind="stable")
        code = code[order]
        key = np.repeat(np.asarray(keys, np.int64), [len(c) for c in codes])[order]
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        letters = np.stack([code[first] >> 42, code[first] >> 21 & 0x1FFFFF, code[first] & 0x1FFFFF], axis=1)
        text = letters.astype("<u4").tobytes().decode("utf-32-le")
        return pa.RecordBatch.from_arrays([
            pa.array([text[i:i + 3] for i in range(0, len(text), 3)], pa.string()),
            pa.array(np.full(len(first), shelf, np.int32)),
            pa.ListArray.from_arrays(pa.array(np.append(first, len(code)), pa.int32()), pa.array(key)),
        ], ["gram", SHELF, "keys"])

    for batch in batches:
        shelves, ids, titles, contents = batch.columns
        titles, contents = titles.cast(pa.binary()), contents.cast(pa.binary())
        for own, key, *texts in zip(shelves.to_pylist(), ids.to_pylist(), titles, contents):
            if held and (own != shelf or held > PAIRS):
                yield part()
                codes, keys, held = [], [], 0
            shelf = own
            found = [c for text in texts if text.is_valid for c in _codes(text.as_py())]
            if found:
                codes.append(found[0] if len(found) == 1 else np.unique(np.concatenate(found)))
                keys.append(key)
                held += len(codes[-1])
    if held:
        yield part()


def pattern_grams(query):
    """Trigrams that every match of a LIKE pattern holds."""
    runs = re.split("[%_]", query.translate(FOLD))
    return sorted({run[i:i + 3] for run in runs for i in range(len(run) - 2)})


class Index:
    """A stored index.  Open one that exists with the schema of its articles."""

    def __init__(self, spark, path, schema):
        self.spark, self.path = spark, path
        self.schema = schema
        self.columns = schema.fieldNames()

    def articles(self):
        names = f"{KEY} long, {SHELF} int"
        fields = spark_schema(self.schema, names)
        return self.spark.read.schema(fields).parquet(f"{self.path}/articles")

    def postings(self, grams):
        """Postings of some trigrams; only their folders are listed and read."""
        rows = self.spark.read.schema(f"gram string, {SHELF} int, keys array<long>, {BUCKET} int").parquet(f"{self.path}/postings")
        folders = [F.pmod(F.xxhash64(F.lit(g)), F.lit(BUCKETS)).cast("int") for g in grams]
        return rows.filter(F.col(BUCKET).isin(folders) & F.col("gram").isin(grams))

    def candidates(self, query):
        """Shelf and key of the rows that hold all trigrams of the pattern, or None if it has none."""
        grams = pattern_grams(query)
        if not grams:
            return None
        # One list per trigram, none longer than the shelf.
        lists = self.postings(grams).groupBy(SHELF).agg(F.collect_list("keys").alias("lists")).filter(F.size("lists") == len(grams))
        common = F.aggregate("lists", F.element_at("lists", 1), F.array_intersect)
        return lists.select(SHELF, F.explode(common).alias(KEY))

    def matches(self, query):
        """The rows of ``browse.search_matches``, read through the postings (Q3)."""
        articles, found = self.articles(), self.candidates(query)
        if found is not None:
            named = found.limit(NAMED + 1).collect()   # decides the plan, not the rows
            if len(named) <= NAMED:
                # Shelves are folders and keys ascend in a file, so other pages aren't read.
                articles = articles.filter(F.col(SHELF).isin(sorted({r[SHELF] for r in named})) & F.col(KEY).isin([r[KEY] for r in named]))
            else:
                articles = articles.join(found, [SHELF, KEY], "left_semi")
        return search_matches(articles, query).select(*self.columns)

    def search(self, query, limit=20):
        """The rows of ``browse.search``."""
        return preview(self.matches(query), 300).orderBy(*newest_first()).limit(limit)


def spark_schema(schema, more):
    """``schema`` with the fields of a DDL text behind it."""
    from pyspark.sql.types import StructType

    return StructType(list(schema.fields) + list(StructType.fromDDL(more).fields))
