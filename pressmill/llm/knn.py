"""Operator 7: exact top-k inner products, as a Voronoi kNN join.

Components become integers, floor(scale * x); scores are integers, so results are exact.
The largest inner product is the smallest distance once data vectors get one more
component, sqrt(M^2 - |x|^2), with M the largest length, and queries a zero.

1. A few vectors are drawn as pivots.  Queries and data are grouped by their nearest pivot.
2. Summaries, merged from those of all tasks: for every query group its radius U; for every
   (data group, query group) the smallest distance of the data to the pivot of the queries;
   for every query group the k + 1 smallest such distances.  The last of those plus U bounds
   the distance of the k-th neighbour of every query of the group (one of them may be the query itself).
3. A data vector goes to a query group only if its distance to the group's pivot, less U, is
   within the bound; whole data groups are skipped by the summary.
4. Both sides of a group are dealt into blocks; every pair of blocks is solved by one matrix product,
   and the best k of all blocks of a query are merged.

Vectors that are null or hold null or non-finite components take no part; vectors of
different length count as padded with zeros.  Of equal scores the smaller vec_id wins, rows without vec_id
come last; rows with equal vec_id are different vectors, and a query leaves out only its own row.  Empty
vectors have score 0.  Without data there are no rows.  Extra columns are not read.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from pressmill.llm.common import stored, with_package

PIVOTS = 8
DATA_BLOCK = 4096
QUERY_BLOCK = 1024
SLACK = 1e-6       # for rounding of distances; bounds only widen by it


def _integers(scale, width):
    def run(batches):
        for batch in batches:
            rows = [[], [], [], []]
            for row, vec_id, query, vector in zip(*(batch.column(i).to_pylist() for i in range(4))):
                x = np.zeros(width)
                x[:len(vector)] = np.floor(scale * np.asarray(vector, dtype=np.float64))
                for out, value in zip(rows, (row, vec_id, query, x.astype("<i8").tobytes())):
                    out.append(value)
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds)], ["row", "vec_id", "query", "x"])
    return run


def _matrix(column, width):
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, width)


def _query_distance(q, pivots):
    q = q.astype(np.float64)
    square = (q * q).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * q @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def _data_distance(x, pivots, most):
    square = most + (pivots * pivots).sum(1)[None] - 2 * x.astype(np.float64) @ pivots.T
    return np.sqrt(np.maximum(square, 0))


SUMMARY = "kind string, data_group int, query_group int, value double"


def _summaries(pivots, most, k):
    """Per task: radius of query groups, least distance per pair of groups, k + 1 least per query group."""
    def run(batches):
        n = len(pivots)
        radius, least = np.full(n, -1.0), np.full((n, n), np.inf)
        nearest = np.empty((n, 0))
        for batch in batches:
            x = _matrix(batch.column(1), pivots.shape[1])
            query = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
            if query.any():
                d = _query_distance(x[query], pivots)
                np.maximum.at(radius, d.argmin(1), d.min(1))
            d = _data_distance(x, pivots, most)
            np.minimum.at(least, d.argmin(1), d)
            nearest = np.sort(np.concatenate([nearest, d.T], axis=1), axis=1)[:, :k + 1]
        rows = [("radius", 0, i, r) for i, r in enumerate(radius) if r >= 0]
        rows += [("least", j, i, least[j, i]) for j in range(n) for i in range(n) if np.isfinite(least[j, i])]
        rows += [("near", 0, i, v) for i in range(n) for v in nearest[i]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
            zip(*rows) if rows else [[]] * 4, [pa.string(), pa.int32(), pa.int32(), pa.float64()])],
            ["kind", "data_group", "query_group", "value"])
    return run


def _read_summaries(summaries, n, k):
    """Merged summaries: n rows, n * n rows and n * (k + 1) rows, for n pivots."""
    merged = summaries.filter("kind <> 'near'").groupBy("kind", "data_group", "query_group").agg(
        F.max("value").alias("most"), F.min("value").alias("least")).collect()
    order = Window.partitionBy("query_group").orderBy("value")
    near = summaries.filter("kind = 'near'").withColumn("place", F.row_number().over(order)).filter(
        F.col("place") <= k + 1).collect()
    radius, least, lists = np.full(n, -1.0), np.full((n, n), np.inf), [[] for _ in range(n)]
    for r in merged:
        if r["kind"] == "radius":
            radius[r["query_group"]] = r["most"]
        else:
            least[r["data_group"], r["query_group"]] = r["least"]
    for r in near:
        lists[r["query_group"]].append(r["value"])
    bound = np.asarray([radius[i] + sorted(v)[k] if len(v) > k else np.inf for i, v in enumerate(lists)])
    return radius, least, bound


def _deal_queries(pivots, data_blocks, query_blocks):
    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(2), pivots.shape[1])
            group = _query_distance(x, pivots).argmin(1)
            rows = batch.column(0).to_numpy()
            chunk = rows % query_blocks[group]
            for block in range(data_blocks):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(group.astype("int32")), pa.array(chunk.astype("int32")),
                     pa.array(np.full(len(rows), block, "int32")), batch.column(0), batch.column(1), batch.column(2)],
                    ["group", "chunk", "block", "row", "vec_id", "x"])
    return run


def _deal_data(pivots, most, radius, least, bound, data_blocks, query_blocks):
    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(2), pivots.shape[1])
            d = _data_distance(x, pivots, most)
            own = d.argmin(1)
            rows = batch.column(0).to_numpy()
            for group in np.flatnonzero(radius >= 0):
                reach = (bound[group] + radius[group]) * (1 + SLACK) + SLACK
                useful = np.flatnonzero(least[own, group] <= reach)       # data groups, by the summary
                useful = useful[d[useful, group] <= reach]                # their vectors
                if not len(useful):
                    continue
                take = pa.array(useful)
                for chunk in range(query_blocks[group]):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(useful), group, "int32")), pa.array(np.full(len(useful), chunk, "int32")),
                         pa.array((rows[useful] % data_blocks).astype("int32")), batch.column(0).take(take),
                         batch.column(1).take(take), batch.column(2).take(take)],
                        ["group", "chunk", "block", "row", "vec_id", "x"])
    return run


BEST = "query_row long, query_id long, row long, vec_id long, score long"


def _solve(k, width):
    names = [c.split()[0] for c in BEST.split(", ")]

    def best(queries, data):
        out = [np.empty(0, np.int64)] * 3
        if queries.num_rows and data.num_rows:
            row, ids = data["row"].to_numpy(), data["vec_id"].to_pandas().astype("Int64")
            order = np.lexsort((row, ids.fillna(0).to_numpy(np.int64), ids.isna().to_numpy()))
            data, row = data.take(pa.array(order)), row[order]
            q = _matrix(queries["x"], width)
            x = _matrix(data["x"], width)
            largest = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(width, 1)
            scores = (q.astype(np.float64) @ x.T.astype(np.float64)) if largest < 2 ** 53 else (q @ x.T).astype(np.float64)
            own = queries["row"].to_numpy()[:, None] == row[None]
            scores[own] = -np.inf
            at = min(k, scores.shape[1]) - 1
            last = -np.partition(-scores, at, axis=1)[:, at]
            i, j = np.nonzero((scores >= last[:, None]) & np.isfinite(scores))
            order = np.lexsort((j, -scores[i, j], i))
            i, j = i[order], j[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            i, j = i[place < k], j[place < k]
            exact = (q[i] * x[j]).sum(1)
            out = [i, j, exact]
        i, j, exact = out
        return pa.table([queries["row"].take(pa.array(i)), queries["vec_id"].take(pa.array(i)), data["row"].take(pa.array(j)),
                         data["vec_id"].take(pa.array(j)), pa.array(exact, pa.int64())], names)
    return best


def top_k(vectors, k=20, scale=64, every=20, pivots=PIVOTS, id_col="vec_id", vector="embedding"):
    """query_id, rank, vec_id, score for the rows whose id is divisible by ``every``."""
    x = F.col(vector)
    sound = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    key = F.col(id_col).cast("long")
    clean = with_package(vectors).filter(sound).select(
        F.monotonically_increasing_id().alias("row"), key.alias("vec_id"),
        F.coalesce(key % every == 0, F.lit(False)).alias("query"), x.cast("array<double>").alias("x"))
    width = max(vectors.filter(sound).agg(F.max(F.size(x))).first()[0] or 0, 1)
    rows = stored(clean.mapInArrow(_integers(scale, width), "row long, vec_id long, query boolean, x binary"), "vectors")
    # A draw by hash; a pivot may be any vector.
    drawn = rows.orderBy(F.xxhash64("x"), "row").select("x").limit(4 * pivots).collect()
    points = np.unique(_matrix(pa.array([bytes(r["x"]) for r in drawn], pa.binary()), width), axis=0)[:pivots].astype(np.float64)
    if not len(points):
        points = np.zeros((1, width))

    def longest(batches):
        most = 0.0
        for batch in batches:
            m = _matrix(batch.column(0), width).astype(np.float64)
            most = max(most, float((m * m).sum(1).max(initial=0)))
        yield pa.RecordBatch.from_arrays([pa.array([most])], ["m"])

    most = rows.select("x").mapInArrow(longest, "m double").agg(F.max("m")).first()[0] or 0.0
    summaries = stored(rows.select("query", "x").mapInArrow(_summaries(points, most, k), SUMMARY), "summaries")
    radius, least, bound = _read_summaries(summaries, len(points), k)
    total, queries = rows.agg(F.count("*"), F.count(F.when(F.col("query"), 1))).first()
    data_blocks = max(-(-total // DATA_BLOCK), 1)
    query_blocks = np.full(len(points), max(-(-queries // QUERY_BLOCK), 1))
    kind = "group int, chunk int, block int, row long, vec_id long, x binary"
    columns = rows.select("row", "vec_id", "x")
    asked = rows.filter("query").select("row", "vec_id", "x").mapInArrow(
        _deal_queries(points, data_blocks, query_blocks), kind)
    offered = columns.mapInArrow(_deal_data(points, most, radius, least, bound, data_blocks, query_blocks), kind)
    found = (asked.groupBy("group", "chunk", "block").cogroup(offered.groupBy("group", "chunk", "block"))
             .applyInArrow(_solve(k, width), BEST))
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
