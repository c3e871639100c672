"""Operator 8: mixing sources to target weights, by entropy balancing.

The share of each source follows its weight: 5, 2, 1, repeating over the sources by code
point, null last.  All shares together are ``total`` times the words of all documents; a
share stops at ``most`` times its source, and the rest is dealt again by weight, until
none is above (the water level of that rule has a closed form over the sorted sources).

Document rates minimise the relative entropy to "every document once", under one token
constraint per source and a bound of ``most`` copies.  The solution is an exponential
tilt, rate = min(most, exp(lambda * size / mean size)), with one lambda per source: the
maximum of a convex dual.  Newton steps on the logarithm of the constraint, inside a
bracket that halves when a step leaves it, run as one grouping each over the counts of
(source, size).  Rates become whole copies: the whole part, and one more for the documents
whose fraction exceeds a number drawn from their doc_id by the most; two histograms of that
excess per source find the threshold at which the source meets its share.

Everything is a DataFrame expression.  Null texts have size 0 and are taken once for
nothing.  Sources that hold no words have target 0.  Rows with equal doc_id and size share
one draw.  An empty input gives no rows.  ``mix`` adds one struct column; a column of that
name is replaced, all others are kept.  Tables of parameters have one row per source; Spark
broadcasts them only while their files are small.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from pressmill.llm.common import fresh, stored

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
TOTAL = 1.5
MOST = 2.0
STEPS = 100         # Newton steps, after which an error says that they have not settled
CLOSE = 1e-9        # relative error of a constraint at which the steps end
BINS = 4096
PICKS = 3


def word_count(text):
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def _key(source):
    """A key that is never null and keeps null apart from every string."""
    return F.when(source.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), source.cast("string")))


def targets(sizes, weights=WEIGHTS, total=TOTAL, most=MOST):
    """One row per source: key, source_size, docs, target.  ``sizes`` has key, size, n."""
    catalog = sizes.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"),
                                       F.sum("n").alias("docs"))
    # Windows over the catalog hold one row per source.
    everything = Window.partitionBy(F.lit(0))
    by_name = everything.orderBy(F.substring("key", 1, 1).desc(), "key")
    place = (F.row_number().over(by_name) - 1) % len(weights)
    catalog = catalog.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), place + 1))
    catalog = catalog.withColumn("cap", F.lit(most) * F.col("source_size")).withColumn(
        "ratio", F.col("cap") / F.col("weight"))
    by_ratio = everything.orderBy("ratio", "key")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onwards = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    catalog = catalog.withColumn(
        "level", (F.lit(total) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        / F.sum("weight").over(onwards)).withColumn("order", F.row_number().over(by_ratio))
    found = F.when(F.col("level") <= F.col("ratio"), F.struct("order", "level"))
    level = F.min(found).over(everything)["level"]
    return catalog.select("key", "source_size", "docs", F.least("cap", level * F.col("weight")).alias("target"))


def solve(sizes, shares, most=MOST):
    """Add ``lam`` to ``shares``: the multiplier of each source's token constraint."""
    mean = F.greatest(F.col("source_size") / F.col("docs"), F.lit(1e-9))
    free = (F.col("target") > 0) & (F.col("target") < F.lit(most) * F.col("source_size") * (1 - 1e-12))
    state = shares.withColumn("mean", mean).select(
        "key", "source_size", "docs", "target", "mean",
        F.when(free, F.lit(0.0)).when(F.col("target") > 0, F.lit(1e9) * F.col("mean")).otherwise(F.lit(0.0)).alias("lam"),
        # At ``low`` even the smallest document falls below its share; at ``high`` all are at the bound.
        F.when(free, F.least(F.lit(0.0), mean * F.log(F.col("target") / F.col("source_size")) - 1)).alias("low"),
        F.when(free, mean * F.log(F.lit(most)) + 1).alias("high"), (~free).alias("done"))
    state = stored(state, "mix-state")
    for _ in range(STEPS):
        z = F.col("size") / F.col("mean")
        rate = F.least(F.lit(most), F.exp(F.col("lam") * z))
        weight = F.col("size") * F.col("n")
        sums = (sizes.join(state, "key").filter("NOT done").groupBy("key")
                .agg(F.sum(weight * rate).alias("words"),
                     F.sum(F.when(rate < most, weight * z * rate).otherwise(0.0)).alias("slope")))
        joined = state.join(sums, "key", "left")
        error = F.log(F.col("words") / F.col("target"))
        low = F.when(error < 0, F.col("lam")).otherwise(F.col("low"))
        high = F.when(error > 0, F.col("lam")).otherwise(F.col("high"))
        step = F.col("lam") - error * F.col("words") / F.col("slope")
        moved = F.when((F.col("slope") > 0) & (step > low) & (step < high), step).otherwise((low + high) / 2)
        done = F.col("done") | (F.abs(error) < CLOSE)
        state = stored(joined.select(
            "key", "source_size", "docs", "target", "mean", F.when(done, F.col("lam")).otherwise(moved).alias("lam"),
            low.alias("low"), high.alias("high"), done.alias("done")), "mix-state")
        if not state.filter("NOT done").limit(1).count():
            return state
    raise RuntimeError("multipliers did not settle")


def _draw(doc_id):
    """A number from 0 to 1 that depends on doc_id alone."""
    return F.pmod(F.xxhash64(doc_id), F.lit(1 << 40)) / F.lit(float(1 << 40))


def _rate(most):
    return F.least(F.lit(most), F.exp(F.col("lam") * F.col("size") / F.col("mean")))


def _excess(doc_id, most):
    """By how much the fraction of the rate exceeds the draw: -1 to 1."""
    rate = _rate(most)
    return rate - F.floor(rate) - _draw(doc_id)


def _bin(value, low, width):
    return F.least(F.floor((value - low) / width * BINS), F.lit(BINS - 1))


def thresholds(slim, state, most=MOST):
    """Add ``cut`` to ``state``: documents whose excess is at least that get one copy more."""
    docs = slim.join(state, "key").withColumn("excess", _excess(F.col("doc_id"), most)).withColumn(
        "whole", F.floor(_rate(most)))
    # Stored, so that its size is known and documents aren't dealt by source to meet it.
    base = stored(docs.groupBy("key").agg(F.sum(F.col("whole") * F.col("size")).alias("base")), "mix-base")
    able = docs.filter(F.col("whole") < most)

    def cut(rows, low, width, need, names):
        """The bin in which the running sum, from the top, passes what is needed."""
        bins = rows.withColumn("bin", _bin(F.col("excess"), low, width)).groupBy("key", "bin", *names).agg(
            F.sum("size").alias("words"))
        above = Window.partitionBy("key").orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, -1)
        running = bins.withColumn("above", F.coalesce(F.sum("words").over(above), F.lit(0)))
        return running.withColumn("need", need)

    first = cut(able.join(base, "key"), F.lit(-1.0), 2.0, F.col("target") - F.col("base"), ["target", "base"])
    # The first bin that the need doesn't fill; it holds the threshold.
    edge = (first.filter(F.col("above") + F.col("words") > F.col("need"))
            .groupBy("key").agg(F.max("bin").alias("edge"), F.max_by("above", "bin").alias("taken"),
                                F.max_by("need", "bin").alias("left")))
    edge = stored(edge, "mix-edges")
    low = F.lit(-1.0) + F.col("edge") * 2.0 / BINS
    inside = able.join(edge, "key").filter(_bin(F.col("excess"), F.lit(-1.0), 2.0) == F.col("edge"))
    second = cut(inside, low, 2.0 / BINS, F.col("left") - F.col("taken"), ["edge", "taken", "left"])
    fine = (second.filter(F.col("above") + F.col("words") <= F.col("need"))
            .groupBy("key").agg(F.min("bin").alias("fine")))
    cuts = edge.join(fine, "key", "left").select(
        "key", F.when(F.col("fine").isNull(), low + 2.0 / BINS)
        .otherwise(low + F.col("fine") * 2.0 / BINS / BINS).alias("cut"))
    # Where no bin passes the need, every document is wanted.
    return _filled_up(slim, state.join(cuts, "key", "left").select(
        "key", "source_size", "target", "mean", "lam", F.coalesce("cut", F.lit(-2.0)).alias("cut"),
        F.expr("CAST(array() AS array<struct<size: bigint, draw: double>>)").alias("picks")), most)


def _filled_up(slim, state, most):
    """Add ``picks``: the copies so far fall short of the target by less than a document; of
    the documents that could have one copy more, the largest that the rest holds is taken, ``PICKS`` times."""
    for turn in range(PICKS):
        state = stored(state, "mix-plan")
        rows = _decided(slim.join(state, "key"), most)
        if not turn:
            state = state.join(rows.groupBy("key").agg(F.sum("taken").alias("words")), "key", "left").select(
                *state.columns, (F.col("target") - F.coalesce("words", F.lit(0))).alias("rest"))
            state = stored(state, "mix-plan")
            rows = _decided(slim.join(state, "key"), most)
        able = rows.filter((F.col("copies") < most) & (F.col("size") > 0) & (F.col("size") <= F.col("rest"))
                           & ~_wanted_more(F.col("doc_id"), most))
        pick = able.groupBy("key").agg(F.max(F.struct("size", _draw(F.col("doc_id")).alias("draw"))).alias("pick"))
        state = state.join(pick, "key", "left").select(
            "key", "source_size", "target", "mean", "lam", "cut",
            F.when(F.col("pick").isNull(), F.col("picks")).otherwise(F.concat("picks", F.array("pick"))).alias("picks"),
            (F.col("rest") - F.coalesce("pick.size", F.lit(0))).alias("rest"))
    return state


def plan(docs, weights=WEIGHTS, total=TOTAL, most=MOST):
    """What the mix is made by: one row per source.  Reads every text once."""
    slim = stored(docs.select(F.col("doc_id"), _key(F.col("source")).alias("key"),
                              word_count(F.col("text")).alias("size")), "mix-sizes")
    sizes = stored(slim.groupBy("key", "size").agg(F.count("*").alias("n")), "mix-counts")
    state = solve(sizes, targets(sizes, weights, total, most), most)
    return slim, stored(thresholds(slim, state, most), "mix-plan")


def _wanted_more(doc_id, most):
    """Whether a document has its one copy more than the whole part of its rate."""
    chosen = F.array_contains("picks", F.struct("size", _draw(doc_id).alias("draw")))
    return (F.floor(_rate(most)) < most) & ((_excess(doc_id, most) >= F.col("cut")) | chosen)


def _decided(rows, most):
    whole = F.floor(_rate(most))
    extra = _wanted_more(F.col("doc_id"), most)
    copies = (whole + extra.cast("long")).cast("long")
    return rows.withColumn("copies", copies).withColumn("taken", copies * F.col("size"))


def mixed_sizes(docs, weights=WEIGHTS, total=TOTAL, most=MOST):
    """doc_id, size, source_size, target, copies, taken: one row per document."""
    slim, sources = plan(docs, weights, total, most)
    return _decided(slim.join(sources, "key"), most).select(
        "doc_id", "size", "source_size", "target", "copies", "taken")


def mix(docs, weights=WEIGHTS, total=TOTAL, most=MOST, out="mix"):
    """``docs`` with a struct of size, source_size, target, copies and taken."""
    _, sources = plan(docs, weights, total, most)
    kept = [c for c in docs.columns if c != out]
    rows = docs.select(F.struct(*kept).alias("doc"), F.col("doc_id"), _key(F.col("source")).alias("key"),
                       word_count(F.col("text")).alias("size"))
    decided = _decided(rows.join(sources, "key"), most)
    return decided.select("doc.*", F.struct("size", "source_size", "target", "copies", "taken").alias(out))


def repeated(docs, **parameters):
    """The mixed corpus: every document as often as the mix takes it, columns unchanged."""
    own, copy = fresh(docs, "_mix"), fresh(docs, "_copy")
    rows = mix(docs, out=own, **parameters)
    copies = F.explode(F.array_repeat(F.lit(0), F.col(f"{own}.copies").cast("int")))
    return rows.withColumn(copy, copies).select(*[F.col(f"`{c}`") for c in docs.columns])
