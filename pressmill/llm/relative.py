"""Operator 13: passages that occurred before, by relative Lempel-Ziv parsing.

A window is ``WINDOW`` consecutive words of a document.  A word goes if a window covers it whose words also
start at a smaller position, positions being (doc_id, start).  All is judged on the input.

A document is parsed into factors, longest runs of words that an indexed reference block holds
earlier, and words that no block holds.  A factor of ``WINDOW`` words or more is a run of windows that
occurred before, so parsing works on windows and never on pairs of documents:

1. Every task takes its documents in reference blocks of bounded size.  A block is indexed by the hashes
   of its windows, sorted, with their positions; its documents are parsed against it.  Windows with an
   earlier place in the block are factors at once.  Only each window's first place goes on, so
   a passage that a third of all documents share leaves a block once.
2. Blocks are parsed against all other blocks where they can have something in common.  A window's
   anchor is the least hash among its runs of ``ANCHOR`` words; equal windows have equal anchors.
   Anchors that stand at one place in all documents can belong to no factor.  Spark counts them first, and a
   filter of those with more places, of bounded size, lets the other windows be left out.  What it lets
   pass needlessly costs rows and no result.
3. The runs of windows left are dealt by anchor; runs that share one meet, are indexed together and parsed again.
4. Factors end where an anchor, a block or a slice of a document ends.  As every window is judged
   by itself, nothing is lost at such a boundary: spans that touch or overlap are joined, per
   document, and a window over the boundary of two shorter factors is a factor of its own if it occurred.
5. Spans meet the texts.  Documents without any span, told by a filter of bounded size, aren't shuffled.

Words are cut at white space and compared unchanged, by their bytes: windows are equal if two 64-bit hashes agree, that of
the window and that of its anchor.  A null text has no words.  Rows that share a doc_id have equal
positions at equal starts, so neither is earlier than the other; both go if a smaller position has the
window.  A null doc_id comes after all others.  Every row has a row in the result; an empty table gives none.
Extra columns are not read.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pressmill.llm.common import bits_for, filter_bits, may_be_in, split_by_keys, stored, with_package

WINDOW = 20
ANCHOR = 10
BLOCK = 1 << 20            # words of a reference block; longer documents are parsed in slices
SLICE = 1 << 20            # bytes of a text that are split at once
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
RUNS = "doc_id long, text_hash long, anchor long, start long, length long, hashes binary"
SPANS = "doc_id long, text_hash long, start long, length long"


# ------------------------------------------------------------------ hashes of words, runs and windows

def word_slices(raw, size=SLICE):
    """Words of a text given as bytes, in lists; a word is never torn."""
    at = 0
    while at < len(raw):
        end = at + size
        while end < len(raw) and not raw[end - 1:end].isspace():
            end += 1
        yield raw[at:end].split()
        at = end


def word_hashes(raw):
    """Hash of every word of a text."""
    import xxhash

    digest, parts = xxhash.xxh64_intdigest, []
    for words in word_slices(raw):
        parts.append(np.fromiter(map(digest, words), np.uint64, len(words)))
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def run_hashes(words, n):
    """Hash of every run of ``n`` words: polynomials in an odd factor, built by doubling, then mixed."""
    def joined(left, right, size):
        return left[:len(left) - size] * power(size) + right[size:] if len(left) > size else left[:0]

    def power(size):
        return np.uint64(pow(int(_FACTOR), size, 1 << 64))

    def mixed(h):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))

    # ``whole`` covers ``size`` words, for the leading binary digits of n.
    whole, size = words, 1
    for digit in bin(n)[3:]:
        whole = joined(whole, whole, size)
        size *= 2
        if digit == "1":
            longer = len(whole) - 1
            whole = whole[:longer] * power(1) + words[size:size + longer] if longer > 0 else whole[:0]
            size += 1
    return mixed(whole[:max(len(words) - n + 1, 0)])


def _sliding(values, n, best):
    """``best`` (np.minimum or np.maximum) of every ``n`` values in a row."""
    out, size = values, 1
    while size * 2 <= n:
        out, size = best(out[:-size], out[size:]) if len(out) > size else out[:0], size * 2
    rest = n - size
    if rest and len(out) > rest:
        out = best(out[:-rest], out[rest:])
    return out[:max(len(values) - n + 1, 0)]


def windows_of(words, window=WINDOW, anchor=ANCHOR):
    """Hash and anchor of every window of a document's word hashes."""
    runs = run_hashes(words, anchor)
    return run_hashes(words, window), _sliding(runs, window - anchor + 1, np.minimum)


def anchor_places(words, window=WINDOW, anchor=ANCHOR):
    """The hash at every place that is the anchor of some window."""
    runs, span = run_hashes(words, anchor), window - anchor + 1
    if len(runs) < span:
        return runs[:0]
    least = _sliding(runs, span, np.minimum)
    around = np.zeros(len(least) + 2 * (span - 1), np.uint64)
    around[span - 1:span - 1 + len(least)] = least
    return runs[runs == _sliding(around, span, np.maximum)]


# ------------------------------------------------------------------ which anchors stand at several places

def _places(window, anchor):
    def run(batches):
        held, size = [], 0

        def flush():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64), pa.int64()), pa.array(np.minimum(counts, 2), pa.int64())], ["anchor", "n"])

        for batch in batches:
            for text in batch.column(0):
                found = anchor_places(word_hashes(text.as_py() or b""), window, anchor)
                held.append(found)
                size += len(found)
                if size >= BLOCK:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()
    return run


def shared_anchors(texts, window=WINDOW, anchor=ANCHOR):
    """A filter of the anchors that stand at more than one place of ``texts`` (one binary column)."""
    places = texts.mapInArrow(_places(window, anchor), "anchor long, n long")
    shared = stored(places.groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1").select("anchor"), "shared-anchors")
    return filter_bits(shared, bits_for(shared.count()))


# ------------------------------------------------------------------ parsing

def later_windows(hashes, anchors, ids, starts):
    """Which windows have an equal one at a smaller position; ``ids`` order the documents."""
    order = np.lexsort((starts, ids, anchors, hashes))
    h, a, i, s = hashes[order], anchors[order], ids[order], starts[order]
    new = np.ones(len(order), bool)
    new[1:] = (h[1:] != h[:-1]) | (a[1:] != a[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    out = np.zeros(len(order), bool)
    out[order] = (i != i[first]) | (s != s[first])
    return out


def _spans_of(rows, starts, later):
    """(row, start, length) of runs of windows that go; windows are in order of row and start."""
    at = np.flatnonzero(later)
    if not len(at):
        return at, at, at
    breaks = np.flatnonzero((rows[at][1:] != rows[at][:-1]) | (starts[at][1:] != starts[at][:-1] + 1)) + 1
    first = np.concatenate([[0], breaks])
    return rows[at[first]], starts[at[first]], np.diff(np.concatenate([first, [len(at)]]))


def _order_of(ids):
    """Numbers that order doc_ids, None last."""
    return np.asarray([np.iinfo(np.int64).max if i is None else i for i in ids], np.int64), np.asarray([i is None for i in ids], bool)


def _parsed_blocks(shared, window, anchor):
    """Documents, block by block: spans of windows with an earlier place in the block (no anchor, no
    hashes), and runs of the other windows that may have one elsewhere."""
    names = ["doc_id", "text_hash", "anchor", "start", "length", "hashes"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches):
        keys, held, seen, size = [], [], set(), 0

        def flush():
            rows = np.concatenate([np.full(len(h), r, np.int64) for r, _, h, _ in held])
            starts = np.concatenate([s for _, s, _, _ in held])
            hashes, anchors = np.concatenate([h for _, _, h, _ in held]), np.concatenate([a for _, _, _, a in held])
            ids, missing = _order_of([k[0] for k in keys])
            # Documents in order: nulls last.  Rows of one doc_id share a number.
            place = np.unique(np.stack([missing.astype(np.int64), ids]), axis=1, return_inverse=True)[1].reshape(-1)
            later = later_windows(hashes, anchors, place[rows], starts)
            r, s, n = _spans_of(rows, starts, later)
            open_ = np.flatnonzero(~later)
            ro, so, ao, ho = rows[open_], starts[open_], anchors[open_], hashes[open_]
            cut = np.flatnonzero((ro[1:] != ro[:-1]) | (so[1:] != so[:-1] + 1) | (ao[1:] != ao[:-1])) + 1
            firsts = np.concatenate([[0], cut]) if len(open_) else cut
            lengths = np.diff(np.concatenate([firsts, [len(open_)]])) if len(open_) else cut
            raw = ho.tobytes()
            ends = np.cumsum(lengths)
            blobs = [raw[8 * (e - k):8 * e] for e, k in zip(ends.tolist(), lengths.tolist())]
            doc_ids, text_hashes = [k[0] for k in keys], [k[1] for k in keys]
            of = np.concatenate([r, ro[firsts]]).tolist()
            columns = [[doc_ids[x] for x in of], [text_hashes[x] for x in of], [None] * len(r) + ao[firsts].view(np.int64).tolist(),
                       np.concatenate([s, so[firsts]]), np.concatenate([n, lengths]), [None] * len(r) + blobs]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for batch in batches:
            for doc_id, text_hash, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                words = word_hashes(text.as_py() or b"")
                for at in range(0, max(len(words) - window + 1, 0), BLOCK):
                    hashes, anchors = windows_of(words[at:at + BLOCK + window - 1], window, anchor)
                    may = np.flatnonzero(may_be_in(shared, anchors))
                    if len(may) and (doc_id, text_hash, at) not in seen:   # rows alike in both have the same spans
                        seen.add((doc_id, text_hash, at))
                        held.append((len(keys), at + may, hashes[may], anchors[may]))
                        keys.append((doc_id, text_hash))
                    size += len(hashes)
                    if size >= BLOCK:
                        if held:
                            yield flush()
                        keys, held, seen, size = [], [], set(), 0
        if held:
            yield flush()
    return run


def _parsed_anchors(batches):
    """Runs of windows, sorted by anchor: spans of windows with an earlier place."""
    names = ["doc_id", "text_hash", "start", "length"]

    def parse(table):
        hashes = [np.frombuffer(b, np.uint64) for b in table.column("hashes").to_pylist()]
        lengths = np.asarray([len(h) for h in hashes], np.int64)
        runs = np.repeat(np.arange(len(hashes)), lengths)
        within = np.arange(len(runs)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        starts = table.column("start").to_numpy()[runs] + within
        anchors = table.column("anchor").to_numpy().view(np.uint64)[runs]
        ids, missing = _order_of(table.column("doc_id").to_pylist())
        place = np.unique(np.stack([missing.astype(np.int64), ids]), axis=1, return_inverse=True)[1].reshape(-1)
        r, s, n = _spans_of(runs, starts, later_windows(np.concatenate(hashes), anchors, place[runs], starts))
        cut = table.select(["doc_id", "text_hash"]).take(pa.array(r))
        return pa.RecordBatch.from_arrays([cut.column(0).combine_chunks(), cut.column(1).combine_chunks(), pa.array(s, pa.int64()), pa.array(n, pa.int64())], names)

    held = []
    for batch in batches:
        # The last anchor of a batch may go on in the next one.
        table = pa.Table.from_batches([batch])
        last = np.flatnonzero(np.diff(table.column("anchor").to_numpy()))
        if not len(last):
            held.append(table)
            continue
        end = int(last[-1]) + 1
        yield parse(pa.concat_tables([*held, table.slice(0, end)]))
        held = [table.slice(end)]
    if held:
        yield parse(pa.concat_tables(held))


def repeated_spans(docs, window=WINDOW, anchor=ANCHOR, text="text"):
    """doc_id, text_hash, start, length: runs of ``length`` windows that occurred at smaller positions.

    Rows that agree in doc_id and text have the same spans, listed once or more.
    """
    slim = with_package(docs).select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash(text).alias("text_hash"), F.col(text).cast("binary").alias("text"))
    shared = shared_anchors(slim.select("text"), window, anchor)
    parsed = stored(slim.mapInArrow(_parsed_blocks(shared, window, anchor), RUNS), "parsed-blocks")
    met = parsed.filter("anchor IS NOT NULL")
    met = met.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_parsed_anchors, SPANS)
    return parsed.filter("anchor IS NULL").select("doc_id", "text_hash", "start", "length").unionByName(met)


def _text_hash(text):
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


# ------------------------------------------------------------------ what is left of the texts

def joined_spans(starts, lengths, window=WINDOW):
    """First words and ends of the spans that runs of windows cover, joined where they touch."""
    order = np.argsort(starts, kind="stable")
    starts = np.asarray(starts, np.int64)[order]
    ends = np.maximum.accumulate(starts + np.asarray(lengths, np.int64)[order] + window - 1)
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > ends[:-1]
    first = np.flatnonzero(new)
    return starts[first], ends[np.concatenate([first[1:] - 1, [len(starts) - 1]])]


def _judged(raw, spans, window, with_text):
    """n_words, n_removed, kept_sha256 and kept words of one text, slice by slice."""
    n = removed = 0
    digest, lines = hashlib.sha256(), []
    firsts, ends = joined_spans(*spans, window) if spans and spans[0] else (None, None)
    for words in word_slices(raw):
        kept = words
        if firsts is not None:
            at = np.arange(n, n + len(words))
            span = np.searchsorted(firsts, at, "right") - 1
            gone = (span >= 0) & (at < ends[span])
            kept = [w for w, g in zip(words, gone.tolist()) if not g]
        if kept:
            line = b" " * (removed < n) + b" ".join(kept)
            digest.update(line)
            if with_text:
                lines.append(line)
        n, removed = n + len(words), removed + len(words) - len(kept)
    return n, removed, digest.hexdigest(), b"".join(lines)


def _left(window, with_text):
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * with_text

    def run(batches):
        for batch in batches:
            spans = list(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())) if batch.num_columns > 2 else None
            for at in range(0, batch.num_rows, 256):
                columns = [[], [], [], []]
                for i in range(at, min(at + 256, batch.num_rows)):
                    for column, v in zip(columns, _judged(batch.column(1)[i].as_py() or b"", spans and spans[i], window, with_text)):
                        column.append(v)
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary()]
                out = [pa.array(c, k) for c, k in zip(columns, kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 256), *out[:3], *([out[3].cast(pa.string())] if with_text else [])], names)
    return run


def remove_repeats(docs, window=WINDOW, anchor=ANCHOR, text="text", with_text=False):
    """doc_id, n_words, n_removed, kept_sha256 and, if wanted, the kept words joined by one space."""
    spans = repeated_spans(docs, window, anchor, text)
    per_text = stored(spans.groupBy("doc_id", "text_hash").agg(
        F.collect_list("start").alias("starts"), F.collect_list("length").alias("lengths")), "spans")
    out = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    rows = with_package(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    key = F.xxhash64(F.coalesce("doc_id", F.lit(-1)), _text_hash("text"))
    keys = per_text.select(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "text_hash").alias("key"))
    clean, others = split_by_keys(rows, key, keys)
    others = others.withColumn("text_hash", _text_hash("text")).alias("o")
    same = F.col("o.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("o.text_hash") == F.col("s.text_hash"))
    met = others.join(per_text.alias("s"), same, "left").select("o.doc_id", F.col("o.text").cast("binary").alias("text"), "s.starts", "s.lengths")
    clean = clean.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_left(window, with_text), out)
    return clean.unionByName(met.mapInArrow(_left(window, with_text), out))
