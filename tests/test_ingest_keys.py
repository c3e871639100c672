"""Stream ingest that asks a table of keys."""

import pathlib

import pytest
from pyspark.sql import functions as F

from pressmill.streaming import ingest

SCHEMA = "id long, url string, title string"


def land(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/landed")


def run(spark, path, **options):
    pathlib.Path(f"{path}/landed").mkdir(exist_ok=True)
    pathlib.Path(f"{path}/store/rows").mkdir(parents=True, exist_ok=True)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/landed")
    ingest.ingest_by_keys(stream, f"{path}/store", f"{path}/checkpoint", lambda rows: ["id"], **options).awaitTermination()
    return sorted((r["id"], r["url"]) for r in ingest.read_rows(spark, f"{path}/store", stream.schema).collect())


def expected(batches):
    seen, kept = set(), []
    for rows in batches:
        for row_id, url, _ in sorted(rows, key=lambda r: r[0]):
            if url is not None and url not in seen:
                seen.add(url)
                kept.append((row_id, url))
    return sorted(kept)


# Repeated in a batch, repeated after many, null and empty URLs, a batch of nothing new.
BATCHES = [[(b * 10 + i, f"u{(b * 7 + i * 3) % 31}", "t") for i in range(6)] for b in range(7)]
BATCHES[2] += [(900, None, "no url"), (901, "", "empty"), (902, "", "again")]
BATCHES[5] = list(BATCHES[0])


@pytest.mark.parametrize("merge_every,slots", [(100, 4), (2, 1)])
def test_every_url_enters_once(spark, tmp_path, merge_every, slots):
    for rows in BATCHES:
        land(spark, tmp_path, rows)
        got = run(spark, tmp_path, merge_every=merge_every, slots=slots)
    assert got == expected(BATCHES)
    folders = [f.name for f in (tmp_path / "store" / "keys").iterdir()]
    assert len(folders) == 7 if merge_every == 100 else any(f.startswith("total=") for f in folders)
    assert len(folders) <= 7 and not list((tmp_path / "store" / "arrived").iterdir())
    # The last batch is repeated after a failure: once with its merge done, and it finds itself nowhere.
    newest = max(pathlib.Path(f"{tmp_path}/checkpoint/commits").glob("[0-9]*"), key=lambda f: int(f.name))
    newest.unlink()
    (newest.parent / f".{newest.name}.crc").unlink()
    assert run(spark, tmp_path, merge_every=merge_every, slots=slots) == got


def test_a_batch_reads_the_buckets_it_may_meet(spark, tmp_path):
    land(spark, tmp_path, [(i, f"https://example.com/{i}", "t") for i in range(3000)])
    run(spark, tmp_path, slots=16)
    def files(urls):
        rows = spark.createDataFrame([(0, u, "t") for u in urls], SCHEMA)
        known = ingest.known_keys(spark, f"{tmp_path}/store", rows, slots=16)
        found = {r["url"] for r in known.collect()}
        leaf = known._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
        return found, leaf.metrics().apply("numFiles").value() if leaf.metrics().contains("numFiles") else 0
    none, read = files([f"https://example.org/new/{i}" for i in range(100)])
    # A filter has one bit in some 170 set, so a hundred new URLs meet about one bucket of 64.
    assert read <= 8 and not none & {f"https://example.org/new/{i}" for i in range(100)}
    some, read = files(["https://example.com/7", "https://example.com/8"])
    assert some >= {"https://example.com/7", "https://example.com/8"} and 1 <= read <= 2
    every, read = files([f"https://example.com/{i}" for i in range(3000)])
    assert len(every) == 3000 and read == ingest.KEY_BUCKETS


def test_filters_hold_every_key(spark, tmp_path):
    """A URL that was stored is never missed, whatever its bit."""
    urls = [f"x{i}" for i in range(2000)]
    land(spark, tmp_path, [(i, u, "t") for i, u in enumerate(urls)])
    run(spark, tmp_path, slots=1)
    rows = spark.createDataFrame([(0, u, "t") for u in urls], SCHEMA)
    assert ingest.known_keys(spark, f"{tmp_path}/store", rows, slots=1).filter(F.col("url").startswith("x")).count() == 2000


def test_an_empty_stream(spark, tmp_path):
    assert run(spark, tmp_path) == []
    land(spark, tmp_path, [(1, None, "t")])
    assert run(spark, tmp_path) == []
    land(spark, tmp_path, [(2, "a", "t")])
    assert run(spark, tmp_path) == [(2, "a")]
