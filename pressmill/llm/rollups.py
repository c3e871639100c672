"""Operator 3: token counts as rollups that are maintained by deltas.

A rollup is a folder.  A batch brings changes, one row each: ``op`` (insert, delete,
revise), doc_id, source, lang, version (of the tokenizer) and n_tokens.  Changes become signed
entries; the entries of a batch are written below ``entries/`` and their sums per source,
language and version below ``deltas/``, and then a row below ``commits/`` makes them count.  Totals are the sums
of the committed deltas: additive, so no batch reads the corpus again.

A batch id that is committed already changes nothing.  A batch that broke off before its
commit has written files that no commit names; the next attempt has names of its own.
Deletes and revisions look up what is recorded of their documents, by a join on doc_id and
version with the committed entries, summed first inside the tasks.

Insert adds a row's tokens and one document.  Delete takes back all that is recorded of a doc_id and
version, wherever it was counted; its other columns are not read.  Revise does the same and
then counts the new row.  Deletes and revisions of what isn't recorded take nothing back.  Several
revisions of one document in a batch all count, as inserts do.  Within a batch, deletes and
revisions see only what earlier batches committed.  Null sources, languages and versions are groups of their own; null doc_ids are
counted and found again like any other value; null n_tokens count as 0.  Extra columns are not read.
"""

from pyspark.sql import functions as F

from pressmill.llm.common import stored
from pressmill.session import new_shared_path

KEY = ["source", "lang", "version"]
ENTRIES = "doc_id long, source string, lang string, version string, docs long, tokens long"
DELTAS = "source string, lang string, version string, docs long, tokens long"
COMMITS = "batch string, attempt string"


def _attempt():
    import uuid

    return uuid.uuid4().hex


class Rollup:
    """A rollup below ``path``, a folder that all executors share."""

    def __init__(self, spark, path):
        self.spark, self.path = spark, path.rstrip("/")
        commits = f"{self.path}/commits"
        if not self._exists(commits):
            spark.createDataFrame([], COMMITS).write.mode("ignore").parquet(commits)

    def _exists(self, path):
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place)

    def commits(self):
        """batch, attempt: committed batches; of two commits of one batch the smaller attempt counts."""
        rows = self.spark.read.schema(COMMITS).parquet(f"{self.path}/commits")
        return {r["batch"]: r["attempt"] for r in rows.groupBy("batch").agg(F.min("attempt").alias("attempt")).collect()}

    def _committed(self, part, schema):
        paths = [f"{self.path}/{part}/{attempt}" for attempt in self.commits().values()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def entries(self):
        return self._committed("entries", ENTRIES)

    def apply(self, batch, changes):
        """Commit a batch of changes; returns whether it was new."""
        if batch in self.commits():
            return False
        changes = stored(changes.select(
            "op", F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in KEY],
            F.coalesce(F.col("n_tokens"), F.lit(0)).cast("long").alias("tokens")), "changes")
        added = changes.filter("op IN ('insert', 'revise')").select(
            "doc_id", *KEY, F.lit(1).cast("long").alias("docs"), "tokens")
        named = changes.filter("op IN ('delete', 'revise')").select("doc_id", "version").distinct()
        recorded = self.entries().groupBy("doc_id", *KEY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        e, n = recorded.alias("e"), named.alias("n")
        same = F.col("e.doc_id").eqNullSafe(F.col("n.doc_id")) & F.col("e.version").eqNullSafe(F.col("n.version"))
        taken = e.join(n, same, "left_semi").filter("docs <> 0 OR tokens <> 0").select(
            "doc_id", *KEY, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens"))
        attempt = _attempt()
        place = f"{self.path}/entries/{attempt}"
        added.unionByName(taken).write.option("compression", "zstd").parquet(place)
        (self.spark.read.schema(ENTRIES).parquet(place).groupBy(*KEY)
         .agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
         .write.parquet(f"{self.path}/deltas/{attempt}"))
        self.spark.createDataFrame([(batch, attempt)], COMMITS).coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        return True

    def totals(self):
        """source, lang, version, docs, tokens; groups without any document left are absent."""
        return (self._committed("deltas", DELTAS).groupBy(*KEY)
                .agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter("docs <> 0 OR tokens <> 0"))


def new_rollup(spark):
    """An empty rollup in the shared folder."""
    return Rollup(spark, new_shared_path(spark, "rollup"))


# Versions of a tokenizer of words: by white space, and by letters, digits and signs.
VERSIONS = {"words-1": r"[^\x20\x09-\x0D]+", "words-2": r"\p{L}+|\p{N}|[^\x20\x09-\x0D\p{L}\p{N}]+"}


def n_tokens(text, version):
    """Tokens of a text under a version; a null text has none, and a long one is counted whole."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(VERSIONS[version])), F.lit(0))


def counted(docs, version, op="insert", text="text"):
    """Changes of ``docs`` under a version of the tokenizer."""
    return docs.select(F.lit(op).alias("op"), "doc_id", "source", "lang", F.lit(version).alias("version"), n_tokens(text, version).alias("n_tokens"))
