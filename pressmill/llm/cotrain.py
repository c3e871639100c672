"""Operator 6: quality of documents, by co-training.

Two logistic classifiers see different views of a document.  The content view has hashed
byte trigrams and figures of the words (share of distinct words, of the commonest word, of
capitals, of signs); the metadata view has source, language, stated and counted length and
the shape of the lines.  Both start from labelled rows.  In every round each
classifier gives the unlabelled rows that it is surest of to the other, with its label.
At last each is calibrated on labelled rows kept aside, and the calibrated views are combined.

Fitting uses a bounded sample: per quality the ``LABELLED`` labelled documents with the
smallest hash of doc_id, weighted back to the counts of all labels, and a pool of ``POOL`` documents
without a label.  Every document is scored, by its whole text.

Labels that are null are left out; of contradicting labels the worst counts.  Null texts
count as empty; null metadata is a value of its own.  Without labels of both kinds all documents have score 1
and are accepted.  Repeated rows give repeated results; an empty input gives no rows; extra columns are kept
by ``keep_good`` and not read.
"""

import pickle
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from pressmill.llm.common import with_package

LABELLED = 4_000
POOL = 6_000
ROUNDS = 4
RIDGE = 3e-4
SURE = 0.95        # least confidence of a pseudo-label
GIVEN = 400        # most pseudo-labels that a view gives in a round, per quality
ASIDE = 4          # one labelled row in so many is kept for calibration
ACCEPT = 0.25      # least probability of good quality; only what is clearly poor goes
TRIGRAMS = 1024
META = 256 + 32 + 16 + 16 + 16 + 8
WORD_FIGURES = 10
FEW_BYTES, FEW_WORDS = 300, 20     # figures of short texts are drawn to nothing by these


# ------------------------------------------------------------------ the views

def content_view(text):
    """Square roots of the shares of hashed byte trigrams, then figures of the words."""
    data = (text or "").encode("utf-8", "surrogatepass")
    b = np.frombuffer(data, np.uint8).astype(np.int32)
    out = np.zeros(TRIGRAMS + WORD_FIGURES, np.float32)
    if len(b) >= 3:
        code = (b[:-2] * 8191 + b[1:-1] * 131 + b[2:] * 31) % 65_521 % TRIGRAMS
        out[:TRIGRAMS] = np.sqrt(np.bincount(code, minlength=TRIGRAMS) / (len(code) + FEW_BYTES))
    words = data.split()
    if words:
        counts = Counter(words)
        n, distinct = len(words), len(counts)
        commonest = (max(counts.values()) - 1) / (n + FEW_WORDS)
        runs = sum(a == c for a, c in zip(words, words[1:])) / (n + FEW_WORDS)
        capitals = np.count_nonzero((b >= 65) & (b <= 90)) / len(b)
        signs = np.count_nonzero((b >= 33) & (b <= 64)) / len(b)
        others = np.count_nonzero(((b >= 91) & (b <= 96)) | ((b >= 123) & (b <= 126))) / len(b)
        expected = np.log1p(distinct) / np.log1p(n)
        out[TRIGRAMS:] = [distinct / n, expected, commonest, runs, 4 * capitals, 4 * signs, 4 * others,
                          min(len(b) / n / 20, 2.0), float(n < 5), float(n < 20)]
    else:
        out[-2:] = 1
    return out


def _level(value, most):
    return min(int(2 * np.log2(value + 1)), most - 1) if value and value > 0 else 0


def meta_view(text, source, lang, n_chars):
    """Which of ``META`` places are one: source, language, lengths, lines."""
    import zlib

    text = text or ""
    lines = text.count("\n") + 1
    stated = -1 if n_chars is None else int(n_chars)
    places = [255 if source is None else zlib.crc32(str(source).encode("utf-8", "surrogatepass")) % 255,
              256 + (31 if lang is None else zlib.crc32(str(lang).encode("utf-8", "surrogatepass")) % 31),
              288 + _level(len(text) / 8, 16), 304 + _level(lines / 2, 16), 320 + _level(len(text) / lines / 4, 16),
              336 + (0 if stated < 0 else 1 if stated == len(text) else 2 if stated > len(text) else 3)]
    return places


def _meta_matrix(places):
    out = np.zeros((len(places), META), np.float32)
    if len(places):
        out[np.arange(len(places))[:, None], np.asarray(places)] = 1
    return out


# ------------------------------------------------------------------ the classifiers

def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def fit_logistic(x, y, weight, ridge, steps=250):
    """Weights and bias of a logistic classifier, by Nesterov's gradient steps."""
    mean = x.mean(0, dtype=np.float64)
    scale = (np.sqrt(np.maximum(np.einsum("ij,ij->j", x, x, dtype=np.float64) / len(x) - mean * mean, 0)) + 1e-3).astype(np.float32)
    x /= scale   # a copy that the caller made; scaled in place, as it is the largest array of the driver
    weight = weight / weight.sum()
    w, b = np.zeros(x.shape[1], np.float32), float(np.log((weight @ y + 1e-6) / (1 - weight @ y + 1e-6)))
    vw, vb, last_w, last_b = w, b, w, b
    pace = 4.0 / (float(np.einsum("i,ij,ij->", weight, x, x)) + 1.0) * 8
    for t in range(1, steps + 1):
        error = (weight * (_sigmoid(x @ vw + vb) - y)).astype(np.float32)
        w, b = vw - pace * (error @ x + ridge * vw), vb - pace * float(error.sum())
        if not np.all(np.isfinite(w)):
            raise FloatingPointError("steps too long")
        vw, vb = w + t / (t + 3) * (w - last_w), b + t / (t + 3) * (b - last_b)
        last_w, last_b = w, b
    return (w / scale).astype(np.float32), b


def co_train(content, meta, y, weight, pool_content, pool_meta, rounds=ROUNDS, sure=SURE, given=GIVEN):
    """Both classifiers, after pseudo-labels have gone to and fro.

    Returns ((weights, bias), (weights, bias)), content first.
    """
    views = [(content, pool_content), (meta, pool_meta)]
    extra = [np.full(len(pool_content), np.nan) for _ in views]    # pseudo-labels that a view was given
    fitted = None
    for turn in range(rounds + 1):
        fitted = []
        for (own, pool), labels in zip(views, extra):
            has = ~np.isnan(labels)
            x = np.concatenate([own, pool[has]]).astype(np.float32)
            fitted.append(fit_logistic(x, np.r_[y, labels[has]], np.r_[weight, np.full(has.sum(), weight.mean() / 2)], RIDGE))
        if turn == rounds or not len(pool_content):
            break
        for giver in (0, 1):
            w, b = fitted[giver]
            p = _sigmoid(views[giver][1] @ w + b)
            taker = extra[1 - giver]
            for label, surety in ((1.0, p), (0.0, 1 - p)):
                able = np.flatnonzero((surety >= sure) & np.isnan(taker))
                taker[able[np.argsort(-surety[able], kind="stable")[:given]]] = label
    return fitted


def fit_few(x, y, weight, ridge=1e-3, steps=60):
    """Weights and bias of a logistic classifier of few inputs, by Newton's steps."""
    x = np.column_stack([x, np.ones(len(x))])
    weight, w = weight / weight.sum(), np.zeros(x.shape[1])
    shrink = ridge * np.r_[np.ones(x.shape[1] - 1), 1e-3]

    def loss(w):
        z = x @ w
        return float(weight @ (np.logaddexp(0, z) - y * z) + (shrink * w * w).sum() / 2)

    for _ in range(steps):
        p = _sigmoid(x @ w)
        grad = x.T @ (weight * (p - y)) + shrink * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(shrink + 1e-9), grad)
        pace = 1.0
        while pace > 1e-4 and loss(w - pace * step) > loss(w):
            pace /= 2
        w = w - pace * step
        if np.abs(pace * step).max() < 1e-9:
            break
    return w[:-1], float(w[-1])


def calibrate(logits, y, weight):
    """Platt's scale and shift of one view."""
    w, b = fit_few(logits[:, None], y, weight)
    return float(w[0]), b


class Model:
    """Two calibrated views and how they are combined."""

    def __init__(self, content, meta, scales, mix):
        self.content, self.meta, self.scales, self.mix = content, meta, scales, mix

    def scores(self, texts, sources, langs, counts):
        """Probabilities of good quality: by content, by metadata, combined."""
        a = np.asarray([content_view(t) @ self.content[0] for t in texts], np.float64) + self.content[1]
        places = np.asarray([meta_view(*row) for row in zip(texts, sources, langs, counts)], np.int64).reshape(-1, 6)
        b = self.meta[0][places].sum(1).astype(np.float64) + self.meta[1]
        a, b = self.scales[0][0] * a + self.scales[0][1], self.scales[1][0] * b + self.scales[1][1]
        both = self.mix[0][0] * a + self.mix[0][1] * b + self.mix[1]
        return _sigmoid(a), _sigmoid(b), _sigmoid(both)


def fit_views(rows):
    """A model from rows (content, meta places, label or nan, weight, kept aside), a list that is emptied."""
    content = np.asarray([r[0] for r in rows], np.float16)
    meta = _meta_matrix([r[1] for r in rows])
    y, weight = np.asarray([r[2] for r in rows], np.float64), np.asarray([r[3] for r in rows], np.float64)
    aside = np.asarray([r[4] for r in rows], bool)
    rows.clear()
    known = ~np.isnan(y)
    fit, test, pool = known & ~aside, known & aside, ~known
    fitted = co_train(content[fit], meta[fit], y[fit], weight[fit], content[pool], meta[pool])
    test = test if len(set(y[test])) == 2 else fit
    logits = [content[test] @ fitted[0][0] + fitted[0][1], meta[test] @ fitted[1][0] + fitted[1][1]]
    scales = [calibrate(z, y[test], weight[test]) for z in logits]
    both = np.stack([s * z + t for z, (s, t) in zip(logits, scales)], axis=1)
    w, b = fit_few(both, y[test], weight[test])
    return Model(fitted[0], fitted[1], scales, (w, float(b)))


# ------------------------------------------------------------------ in Spark

def _columns(docs):
    """Text and metadata; a column that the input lacks is null."""
    return [(F.col(c) if c in docs.columns else F.lit(None)).cast(kind).alias(c)
            for c, kind in (("text", "string"), ("source", "string"), ("lang", "string"), ("n_chars", "long"))]


def _views(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            cut = batch.slice(at, 256)
            rows = list(zip(*(cut.column(i).to_pylist() for i in range(3, 7))))
            content = [content_view(r[0]).astype(np.float16).tobytes() for r in rows]
            yield pa.RecordBatch.from_arrays(
                [cut.column(0), cut.column(1), cut.column(2), pa.array(content, pa.binary()),
                 pa.array([meta_view(*r) for r in rows], pa.list_(pa.int32()))],
                ["doc_id", "label", "weight", "content", "meta"])


def sample(docs, labels, labelled=LABELLED, pool=POOL):
    """doc_id, label, weight of at most ``2 * labelled + pool`` documents; label null in the pool."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.min(F.when(F.col("quality") > 0, 1.0).otherwise(0.0)).alias("label"))
    order = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = known.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= labelled).drop("place")
    # Weights that give each quality its share of all labels again.
    shares = known.groupBy("label").agg(F.count("*").alias("n")).withColumn(
        "weight", F.col("n") / F.least(F.col("n"), F.lit(labelled))).drop("n")
    chosen = chosen.join(shares, "label").select("doc_id", "label", "weight")
    ids = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"))
    rest = ids.join(known, "doc_id", "left_anti").orderBy(F.xxhash64("doc_id"), "doc_id").limit(pool).distinct()
    return chosen.unionByName(rest.select("doc_id", F.lit(None).cast("double").alias("label"), F.lit(1.0).alias("weight")))


def fit(docs, labels, labelled=LABELLED, pool=POOL):
    """A model, or None where labels don't hold both qualities."""
    chosen = F.broadcast(sample(docs, labels, labelled, pool))     # bounded by the parameters
    rows = with_package(docs).select(F.col("doc_id").cast("long").alias("doc_id"), *_columns(docs)).join(chosen, "doc_id")
    # One row per doc_id, that of the smallest text hash, reduced inside the tasks.
    least = F.min(F.struct(F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"), "text", "source", "lang", "n_chars", "label", "weight"))
    rows = rows.groupBy("doc_id").agg(least.alias("row"))
    views = rows.select("doc_id", "row.label", "row.weight", "row.text", "row.source", "row.lang", "row.n_chars").mapInArrow(
        _views, "doc_id long, label double, weight double, content binary, meta array<int>")
    # The bounded sample meets in one task, so the driver holds the model alone.
    found = views.repartition(1).mapInArrow(_fitted(fit_views), "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else None


def _fitted(learn):
    """One row with the pickled model, or none where labels don't hold both qualities."""
    def run(batches):
        table = [(np.frombuffer(c, np.float16), m, np.nan if y is None else y, w, i % ASIDE == 0, i)
                 for batch in batches for i, y, w, c, m in zip(*(batch.column(k).to_pylist() for k in range(5)))]
        table.sort(key=lambda r: (r[5], r[0].tobytes()))
        if {0.0, 1.0} <= {r[2] for r in table}:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(learn(table))], pa.binary())], ["model"])
    return run


def _scored(model):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                cut = batch.slice(at, 512)
                if model:
                    values = model.scores(*(cut.column(i).to_pylist() for i in range(1, 5)))
                else:
                    values = [np.ones(cut.num_rows)] * 3
                yield pa.RecordBatch.from_arrays(
                    [cut.column(0), *(pa.array(v, pa.float64()) for v in values), pa.array(values[2] >= ACCEPT)],
                    ["doc_id", "content_score", "meta_score", "score", "accepted"])
    return run


def score(docs, model):
    """doc_id, content_score, meta_score, score, accepted: one row per document."""
    return with_package(docs).select(F.col("doc_id").cast("long").alias("doc_id"), *_columns(docs)).mapInArrow(
        _scored(model), "doc_id long, content_score double, meta_score double, score double, accepted boolean")


def keep_good(docs, model):
    """The rows of ``docs`` that are accepted, columns unchanged."""
    if model is None:
        return docs

    def accepted(text: pd.Series, source: pd.Series, lang: pd.Series, n_chars: pd.Series) -> pd.Series:
        plain = [[None if pd.isna(v) else v for v in s] for s in (text, source, lang, n_chars)]
        return pd.Series(model.scores(*plain)[2] >= ACCEPT)

    return with_package(docs).filter(F.pandas_udf(accepted, "boolean")(*_columns(docs)))
