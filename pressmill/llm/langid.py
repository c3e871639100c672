"""Operator 5: language of texts, by a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are read in rows of ``SPAN`` bytes.  Two gated recurrent layers, one in
each direction, label every byte with probabilities of the languages; a document's
probabilities are the mean over all its bytes.  The network is trained in numpy by
backpropagation through time (Adam), on windows of a bounded sample: for every language the
``PER_LANGUAGE`` texts with the smallest hash of doc_id, ``WINDOWS`` windows of each, spread
over the whole text.  Prediction reads every byte of every text; lang, source and doc_id are not inputs.

Null texts and texts without a letter are ``und`` with score 0, as is every text where
there is nothing to learn from.  Rows without doc_id are predicted, not learned from; their held_out is
false.  Repeated rows give repeated results; an empty input gives no rows; extra columns are not read.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from pressmill.llm.common import with_package

HIDDEN = 8
SPAN = 64
PER_LANGUAGE = 400
WINDOWS = 4
STEPS = 260
BATCH = 256
RATE = 0.02
LANES = 4096       # rows of bytes that are read at once
SEED = 7
UNKNOWN = "und"


# ------------------------------------------------------------------ the network
# Arrays are (units, lanes).  Gates are in the order update, reset, candidate; weights of
# the first two are used halved, as sigmoid(x) = (1 + tanh(x / 2)) / 2.

def new_network(classes, rng):
    net = {}
    for d in ("f", "b"):
        net["x" + d] = rng.normal(0, 0.3, (3 * HIDDEN, 256))
        net["u" + d] = rng.normal(0, 1 / np.sqrt(HIDDEN), (3 * HIDDEN, HIDDEN))
        net["c" + d] = np.zeros((3 * HIDDEN, 1))
        net["o" + d] = rng.normal(0, 1 / np.sqrt(HIDDEN), (classes, HIDDEN))
    net["bias"] = np.zeros((classes, 1))
    return {k: v.astype(np.float32) for k, v in net.items()}


def _step(table, u, c, state, byte, keep=None):
    h = HIDDEN
    gx = np.take(table, byte, axis=1, mode="clip")
    gh = u @ state
    gh += c
    gates = gx[:2 * h] + gh[:2 * h]
    np.tanh(gates, out=gates)
    gates += 1
    gates *= 0.5
    update, reset = gates[:h], gates[h:]
    candidate = reset * gh[2 * h:]
    candidate += gx[2 * h:]
    np.tanh(candidate, out=candidate)
    new = state - candidate
    new *= update
    new += candidate
    if keep is not None:
        keep.append((state, gates, candidate, gh[2 * h:]))
    return new


def _halved(net):
    """Weights as ``_step`` uses them."""
    scale = np.r_[np.full(2 * HIDDEN, 0.5), np.ones(HIDDEN)].astype(np.float32)[:, None]
    return {k: (v * scale if k[0] in "xuc" else v) for k, v in net.items()}


def _softmax(logits):
    logits = logits - logits.max(0)
    np.exp(logits, out=logits)
    logits /= logits.sum(0)
    return logits


def position_sums(used, rows, lengths):
    """Sum of the label probabilities over the bytes of each row: (classes, rows).

    ``used`` are halved weights, ``rows`` (rows, SPAN) bytes, ``lengths`` bytes per row.
    """
    lanes, span = rows.shape
    columns = np.ascontiguousarray(rows.T).astype(np.intp)
    state, forward = np.zeros((HIDDEN, lanes), np.float32), []
    for t in range(span):
        state = _step(used["xf"], used["uf"], used["cf"], state, columns[t])
        forward.append(state)
    state, total = np.zeros((HIDDEN, lanes), np.float32), np.zeros((len(used["bias"]), lanes), np.float32)
    for t in range(span - 1, -1, -1):
        state = _step(used["xb"], used["ub"], used["cb"], state, columns[t])
        p = _softmax(used["of"] @ forward[t] + used["ob"] @ state + used["bias"])
        total += p * (t < lengths)
    return total


def _back(net, d, kept, order, deltas, columns, grads):
    """Backpropagation through time for one direction; ``deltas[t]`` comes from the output."""
    h = HIDDEN
    u, carry, all_gx = net["u" + d], 0.0, []
    gu, gc = np.zeros_like(u), np.zeros((3 * h, 1), np.float32)
    for t, (state, gates, candidate, inner) in zip(reversed(order), reversed(kept)):
        delta = deltas[t] + carry
        update, reset = gates[:h], gates[h:]
        d_candidate = delta * (1 - update) * (1 - candidate * candidate)
        d_update = delta * (state - candidate) * update * (1 - update)
        d_reset = d_candidate * inner * reset * (1 - reset)
        d_gh = np.concatenate([d_update, d_reset, d_candidate * reset])
        all_gx.append((t, np.concatenate([d_update, d_reset, d_candidate])))
        gu += d_gh @ state.T
        gc += d_gh.sum(1, keepdims=True)
        carry = delta * update + u.T @ d_gh
    gx = np.concatenate([g for _, g in all_gx], axis=1)
    where = np.concatenate([columns[t] for t, _ in all_gx])
    grads["x" + d] = np.stack([np.bincount(where, row, 256) for row in gx]).astype(np.float32)
    grads["u" + d], grads["c" + d] = gu, gc


def gradients(net, rows, lengths, labels):
    """Mean cross entropy over all bytes and its gradients."""
    used, columns = _halved(net), np.ascontiguousarray(rows.T).astype(np.intp)
    lanes, span = rows.shape
    states, kept = {}, {"f": [], "b": []}
    for d, order in (("f", range(span)), ("b", range(span - 1, -1, -1))):
        state = np.zeros((HIDDEN, lanes), np.float32)
        for t in order:
            state = _step(used["x" + d], used["u" + d], used["c" + d], state, columns[t], kept[d])
            states[d, t] = state
    truth = np.eye(len(net["bias"]), dtype=np.float32)[:, labels]
    weight, loss = 1.0 / max(int(lengths.sum()), 1), 0.0
    grads = {k: np.zeros_like(v) for k, v in net.items()}
    deltas = {"f": {}, "b": {}}
    for t in range(span):
        p = _softmax(net["of"] @ states["f", t] + net["ob"] @ states["b", t] + net["bias"])
        live = (t < lengths) * np.float32(weight)
        loss -= float((np.log(np.maximum((p * truth).sum(0), 1e-9)) * live).sum())
        error = ((p - truth) * live).astype(np.float32)
        grads["bias"] += error.sum(1, keepdims=True)
        for d in "fb":
            grads["o" + d] += error @ states[d, t].T
            deltas[d][t] = net["o" + d].T @ error
    for d, order in (("f", list(range(span))), ("b", list(range(span - 1, -1, -1)))):
        _back(net, d, kept[d], order, deltas[d], columns, grads)
    return loss, grads


def to_rows(data):
    """Bytes as rows of SPAN, the last one filled with zeros, and the bytes in each row."""
    n = -(-len(data) // SPAN)
    rows = np.zeros(n * SPAN, np.uint8)
    rows[:len(data)] = np.frombuffer(data, np.uint8)
    lengths = np.full(n, SPAN)
    if n:
        lengths[-1] = len(data) - SPAN * (n - 1)
    return rows.reshape(n, SPAN), lengths


def train(windows, labels, classes, steps=STEPS, rate=RATE, seed=SEED):
    """A network from byte strings of at most SPAN bytes and their labels."""
    rng = np.random.default_rng(seed)
    net = new_network(classes, rng)
    rows, lengths = np.zeros((len(windows), SPAN), np.uint8), np.asarray([min(len(w), SPAN) for w in windows])
    for row, w in zip(rows, windows):
        row[:min(len(w), SPAN)] = np.frombuffer(w[:SPAN], np.uint8)
    labels = np.asarray(labels)
    first = {k: np.zeros_like(v) for k, v in net.items()}
    second = {k: np.zeros_like(v) for k, v in net.items()}
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(windows), min(BATCH, len(windows)))
        _, grads = gradients(net, rows[pick], lengths[pick], labels[pick])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        clip, pace = min(1.0, 1.0 / max(norm, 1e-9)), rate * (1 - 0.9 * step / steps)
        for k, g in grads.items():
            g = g * clip
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.005 * (g * g - second[k])
            net[k] -= (pace * first[k] / (1 - 0.9 ** step) / (np.sqrt(second[k] / (1 - 0.995 ** step)) + 1e-7)).astype(np.float32)
    return net


def pooled(used, texts):
    """Probabilities of the languages of each text (bytes, none of them empty): (texts, classes)."""
    sums = np.zeros((len(texts), len(used["bias"])))
    held, held_lengths, owners, size = [], [], [], 0

    def flush():
        rows, lengths, owner = np.concatenate(held), np.concatenate(held_lengths), np.concatenate(owners)
        for at in range(0, len(rows), LANES):
            cut = slice(at, at + LANES)
            p = position_sums(used, rows[cut], lengths[cut])
            for c in range(sums.shape[1]):
                sums[:, c] += np.bincount(owner[cut], p[c], len(texts))

    for i, data in enumerate(texts):
        rows, lengths = to_rows(data)
        held.append(rows)
        held_lengths.append(lengths)
        owners.append(np.full(len(rows), i))
        size += len(rows)
        if size >= 4 * LANES:
            flush()
            held, held_lengths, owners, size = [], [], [], 0
    if size:
        flush()
    return sums / np.maximum(sums.sum(1, keepdims=True), 1e-12)


# ------------------------------------------------------------------ in Spark

def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_windows(docs, per_language=PER_LANGUAGE, windows=WINDOWS):
    """lang, text: at most ``per_language * windows`` short windows of every language.

    Tasks keep the first rows of each language before the shuffle.
    """
    learned = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
                          & F.col("text").rlike(r"\p{L}"))
    length = F.length("text")
    starts = [F.greatest(F.lit(1), F.floor((length - SPAN) * i / max(windows - 1, 1)).cast("int") + 1) for i in range(windows)]
    slim = learned.select("lang", "doc_id", F.array(*[F.substring(F.col("text"), s, F.lit(SPAN)) for s in starts]).alias("cuts"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ranked = slim.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= per_language)
    return ranked.select("lang", F.explode("cuts").alias("text"), "doc_id").distinct()


def _predict(net, languages):
    def run(batches):
        used = _halved(net) if net else None
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                cut = batch.slice(at, 1024)
                texts, letters = cut.column(2).to_pylist(), cut.column(3).to_pylist()
                able = [i for i, (t, ok) in enumerate(zip(texts, letters)) if ok and t and net]
                best, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
                if able:
                    p = pooled(used, [texts[i].encode("utf-8", "surrogatepass") for i in able])
                    for i, row in zip(able, p):
                        k = int(row.argmax())
                        best[i], score[i] = languages[k], float(min(max(row[k], 0.0), 1.0))
                yield pa.RecordBatch.from_arrays(
                    [cut.column(0), cut.column(1), pa.array(best, pa.string()), pa.array(score, pa.float64())],
                    ["doc_id", "held_out", "lang_pred", "score"])
    return run


def fit(docs, per_language=PER_LANGUAGE, windows=WINDOWS, steps=STEPS):
    """A network and its languages, in order of code points."""
    rows = sorted((r["lang"], r["doc_id"], r["text"]) for r in training_windows(docs, per_language, windows).collect())
    languages = sorted({r[0] for r in rows})
    if not languages:
        return None, []
    labels = [languages.index(r[0]) for r in rows]
    return train([r[2].encode("utf-8", "surrogatepass")[:SPAN] for r in rows], labels, len(languages), steps), languages


def predict(docs, net, languages):
    """doc_id, held_out, lang_pred, score: one row per document."""
    columns = with_package(docs).select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"),
                          F.col("text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return columns.mapInArrow(_predict(net, languages), "doc_id long, held_out boolean, lang_pred string, score double")
