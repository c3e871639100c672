"""Operator 12: phrases that belong together, by dynamic itemset counting.

Texts are lower-cased (A-Z), split into pieces at ``. , ; : ! ?`` and line ends, and pieces into words at
blanks and tabs.  Everything is counted per language.  The rows are dealt into ``SHARDS`` stored shards, which are
scanned in a cycle, one a step, with phrases of all lengths counted together:

* a phrase becomes active in the step after both its subphrases (all words but the last, all but the
  first) have reached the threshold; single words are active from the first step;
* an active phrase is looked for during one full cycle.  What reaches the threshold over all shards has
  at least a ``SHARDS``-th of it in one of them, so a phrase gets a counter at the first shard that holds so
  many; the counter then runs for one full cycle and is exact.  Rarer ones never need one;
* a counter that reaches the threshold, finished or not, lets longer phrases begin;
* the scans end when every counter has completed its cycle and nothing is left to look for.

So every phrase of up to ``longest`` words with the threshold's count gets an exact count: its
subphrases are at least as frequent, hence have counters that reach the threshold, and so on down to its words.

What tasks need to know of earlier steps (which phrases have reached the threshold, and when, and
which counters still run) is a table of ``SLOTS`` bytes addressed by hash, of fixed size whatever the data.
Phrases that share a slot are looked for needlessly, which costs rows but no result: a counter
covers the cycle it has run, and no phrase gets two.  Tasks count by word numbers of their own, in chunks of bounded size, and
give one row per phrase and chunk; Spark sums these before and behind the shuffle.

A null text is empty, a null language is ``und``; repeated rows count each; very long texts are read in
slices that end with a piece.  An empty table gives no rows; extra columns are not read.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from pressmill.llm.common import filter_bits, slices, stored, with_package

THRESHOLD = 30
LONGEST = 4
SHARDS = 2
TOP = 2000
SHARE = 80                 # a longer phrase with this percentage of the count displaces a shorter one
SCALE = 2_000_000
SLOTS = 1 << 24
CHUNK = 1 << 19            # words counted at once
NEVER = 127                # "has not reached the threshold"; steps are smaller
RUNS = 128                 # added while a counter runs
MARK = b"\xff"             # stands between pieces; no UTF-8 text holds this byte
COUNTS = "lang string, phrase string, n long"
COUNTER = "lang string, phrase string, words int, first int, reached int, n long"
_MIX = np.uint64(0xFF51AFD7ED558CCD)   # an odd factor


def translation():
    """The byte table: A-Z become a-z, ends of pieces become ``MARK``."""
    table = bytearray(range(256))
    for c in range(ord("A"), ord("Z") + 1):
        table[c] = c + 32
    for c in b".,;:!?\x0a\x0b\x0c\x0d":
        table[c] = MARK[0]
    return bytes(table)


def piece_slices(raw, table, size=CHUNK):
    """A text given as bytes, translated, in slices of about ``size`` bytes that end with a piece."""
    raw, at = raw.translate(table), 0
    while at < len(raw):
        end = raw.find(MARK, at + size)
        end = len(raw) if end < 0 else end + 1
        yield raw[at:end]
        at = end


def _then(first, second):
    """Hash of a phrase and the word behind it."""
    mixed = (first ^ (first >> np.uint64(29))) * _MIX + second
    return mixed ^ (mixed >> np.uint64(32))


class Numbers(dict):
    """Numbers of words in the order they are met; 0 is the mark."""

    def __init__(self):
        super().__init__({MARK: 0})
        self.words = [MARK]

    def __missing__(self, word):
        number = self[word] = len(self.words)
        self.words.append(word)
        return number


def phrase_hash(lang, phrase):
    """The hash by which a phrase finds its slot."""
    import xxhash

    seed = xxhash.xxh64_intdigest(lang.encode())
    out = None
    for word in phrase.encode().split(b" "):
        h = np.asarray([xxhash.xxh64_intdigest(word, seed)], np.uint64)
        out = h if out is None else _then(out, h)
    return int(out[0])


def _told(state, hashes):
    """Of phrases: the step in which they reached the threshold (or ``NEVER``), and whether a counter runs."""
    found = state[(hashes & np.uint64(len(state) - 1)).view(np.int64)]
    return found & 127, found >= RUNS


def count_chunk(ids, words, hashes, state, step, shards, longest):
    """(length, phrases, counts) of one chunk of word numbers of one language; in the first cycle the empty
    phrase counts all words.  ``words`` and ``hashes`` are those of the numbers.

    Pieces of ``ids`` are parted by the mark, number 0; it ends with one.
    """
    reached, runs = _told(state, hashes)
    reached[0] = NEVER
    counts = np.bincount(ids, minlength=len(hashes))
    if step < shards:
        yield 0, [b""], counts[1:].sum(keepdims=True)
        take = np.flatnonzero(counts[1:]) + 1
    else:
        runs[0] = False
        take = np.flatnonzero(runs & (counts > 0))
    yield 1, [words[i] for i in take.tolist()], counts[take]
    # at: where phrases of the length before start that reached the threshold; told: in which step they and
    # all their parts had.  A shared slot may tell a phrase before its parts, but it is met only after them.
    by_place, every = reached[ids], hashes[ids]
    at = np.flatnonzero(by_place < NEVER)
    told, own = by_place[at], every[at]
    for n in range(2, longest + 1):
        if len(at) < 2:
            return
        next_to = np.flatnonzero(at[1:] == at[:-1] + 1)
        begins = np.maximum(told[next_to], told[next_to + 1]) + 1
        at = at[next_to]
        own = _then(own[next_to], every[at + n - 1])
        told, runs = _told(state, own)
        # Looked for during one cycle from ``begins`` on, and while a counter runs.
        seen = np.flatnonzero(runs | ((begins <= step) & (begins + shards > step)))
        if len(seen):
            starts = at[seen]
            key = ids[starts]
            for k in range(1, n):
                if k > 1:
                    key = np.unique(key, return_inverse=True)[1]
                key = (key << 32) | ids[starts + k]
            _, first, found = np.unique(key, return_index=True, return_counts=True)
            word = words.__getitem__
            parts = [map(word, ids[starts[first] + k].tolist()) for k in range(n)]
            yield n, list(map(b" ".join, zip(*parts))), found
        keep = np.flatnonzero(told < NEVER)
        at, own, told = at[keep], own[keep], np.maximum(told, begins - 1)[keep]


def _numbered(table, shards, numbers_at_once):
    """Texts as chunks of word numbers, dealt into shards: each row holds the words of one chunk of one
    language and their numbers, so later scans split and look up no text."""
    def run(batches):
        held, size, numbers, dealt = {}, {}, {}, 0

        def flush(key):
            ids, words = np.concatenate(held.pop(key)).astype("<i4"), numbers.pop(key).words
            size.pop(key)
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]], pa.string()), pa.array([key[1]], pa.int32()), pa.array([b" ".join(words[1:])], pa.binary()),
                 pa.array([ids.tobytes()], pa.binary())], ["lang", "shard", "words", "ids"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                key, dealt = (lang, dealt % shards), dealt + 1
                for piece in piece_slices(text.as_py() or b"", table):
                    if key not in numbers:
                        numbers[key] = Numbers()
                    words = piece.replace(MARK, b" " + MARK + b" ").split()
                    words.append(MARK)
                    held.setdefault(key, []).append(np.fromiter(map(numbers[key].__getitem__, words), np.int64, len(words)))
                    size[key] = size.get(key, 0) + len(words)
                    if size[key] >= numbers_at_once:
                        yield flush(key)
            # Many languages together are bounded as well.
            if sum(size.values()) > 4 * shards * numbers_at_once:
                for key in list(held):
                    yield flush(key)
        for key in list(held):
            yield flush(key)
    return run


def _scan(state_of, step, shards, longest):
    def run(batches):
        import xxhash

        state, digest = np.frombuffer(state_of.value, np.uint8), xxhash.xxh64_intdigest
        for batch in batches:
            for lang, words, ids in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                words = [MARK, *words.as_py().split()]
                seed = digest(lang.encode())
                hashes = np.fromiter((digest(w, seed) for w in words), np.uint64, len(words))
                ids = np.frombuffer(ids.as_buffer(), "<i4").astype(np.int64)
                for n, phrases, counts in count_chunk(ids, words, hashes, state, step, shards, longest):
                    for at in range(0, len(phrases), 50_000):
                        cut = phrases[at:at + 50_000]
                        yield pa.RecordBatch.from_arrays(
                            [pa.repeat(pa.scalar(lang, pa.string()), len(cut)), pa.array(cut, pa.binary()).cast(pa.string()),
                             pa.array(counts[at:at + 50_000], pa.int64())], ["lang", "phrase", "n"])
    return run


def _slots(slots):
    def run(batches):
        for batch in batches:
            at = [phrase_hash(lang, phrase) & (slots - 1) for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), batch.column(2), batch.column(3)], ["slot", "reached", "running"])
    return run


def _slots_of(counters, reached, running, slots):
    """Which slots are those of phrases that are ``reached``, and of those ``running``: two arrays."""
    told = counters.filter(reached | running).select("lang", "phrase", F.coalesce(reached, F.lit(False)).alias("reached"), running.alias("running"))
    at = told.mapInArrow(_slots(slots), "slot long, reached boolean, running boolean")
    both = F.explode(F.filter(F.array(F.when(F.col("reached"), F.col("slot")), F.when(F.col("running"), F.col("slot") + slots)), lambda x: x.isNotNull()))
    bits = np.unpackbits(filter_bits(at.select(both.alias("slot")), 2 * slots), bitorder="little").view(bool)
    return bits[:slots].copy(), bits[slots:]


def count_phrases(docs, threshold=THRESHOLD, longest=LONGEST, shards=SHARDS, text="text", slots=SLOTS):
    """lang, phrase, words, n: every phrase of 1 to ``longest`` words with ``n`` of ``threshold`` or more, exactly,
    and for every language a row of 0 words with the count of all its words."""
    spark = with_package(docs).sparkSession
    heavy = -(-threshold // shards)
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col(text).cast("binary").alias("text"))
    dealt = stored(texts.mapInArrow(_numbered(translation(), shards, CHUNK), "lang string, shard int, words binary, ids binary"),
                   "shards", partition_by=["shard"])
    state = np.full(slots, NEVER, np.uint8)
    counters = spark.createDataFrame([], COUNTER)
    step, last = 0, -1
    while True:
        shared = spark.sparkContext.broadcast(state.tobytes())
        rows = dealt.filter(F.col("shard") == step % shards).select("lang", "words", "ids")
        found = rows.mapInArrow(_scan(shared, step, shards, longest), COUNTS)
        new = found.groupBy("lang", "phrase").agg(F.sum("n").alias("m"))
        both = new.join(counters, ["lang", "phrase"], "full").filter(
            F.col("first").isNotNull() | (F.col("m") >= heavy) | (F.col("phrase") == ""))
        # A counter that has completed its cycle stays as it is, even if a shared slot brings its phrase again.
        n = (F.when(F.col("first").isNull(), F.col("m"))
             .when(F.col("first") > step - shards, F.col("n") + F.coalesce("m", F.lit(0))).otherwise(F.col("n")))
        words = F.coalesce("words", F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " "))))
        told = both.select("lang", "phrase", words.alias("words"), F.coalesce("first", F.lit(step)).alias("first"), "reached", n.alias("n"))
        told = told.withColumn("reached", F.when(F.col("reached").isNotNull(), F.col("reached"))
                               .when((F.col("n") >= threshold) & (F.col("words") > 0), F.lit(step)).cast("int"))
        counters = stored(told, "counters")
        reached = (F.col("reached") == step) & (F.col("words") < longest)
        running = (F.col("first") > step + 1 - shards) & (F.col("words") > 0)
        now, runs = _slots_of(counters, reached, running, slots)
        state &= 127
        now &= state == NEVER   # the others share a slot whose longer phrases were looked for before
        if now.any():
            last = step
        state[now] = step
        state[runs] |= RUNS
        shared.unpersist()
        step += 1
        # After the last phrase that let longer ones begin, one cycle of looking; then no counter may run.
        if step > last + shards and not runs.any():
            break
        if step >= NEVER:
            raise RuntimeError("phrases did not settle")
    return counters.filter((F.col("n") >= threshold) | (F.col("words") == 0)).select("lang", "phrase", "words", "n")


def _joined(parts, first, count):
    return F.array_join(F.slice(parts, first, count), " ")


def score(counted, share=SHARE, scale=SCALE):
    """Candidates of ``counted`` (as ``count_phrases`` gives it) with their lowest cut: lang, phrase, a, l, r, n, score."""
    wide = "decimal(38,0)"
    parts = counted.filter("words > 0").select("lang", "phrase", F.col("n").alias("f"))
    own = counted.filter("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = own.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _joined("w", F.lit(1), F.col("k")).alias("head"),
                       _joined("w", F.col("k") + 1, F.col("words") - F.col("k")).alias("tail"))
    for name, out in (("head", "l"), ("tail", "r")):
        cuts = cuts.join(parts.select("lang", F.col("phrase").alias(name), F.col("f").alias(out)), ["lang", name])
    points = F.expr(f"CAST(CAST(a AS decimal(20,0)) * CAST({scale} AS decimal(10,0)) AS {wide}) div CAST(CAST(l AS decimal(20,0)) + r AS {wide})")
    lowest = cuts.withColumn("score", points.cast("long")).groupBy("lang", "phrase").agg(
        F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # The greatest count of a longer candidate that holds the phrase.
    spans = own.filter("words > 2").select("lang", "a", "w", "words", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    spans = spans.select("lang", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("at"))
    inside = spans.groupBy("lang", _joined("w", F.col("at"), F.col("size")).alias("phrase")).agg(F.max("a").alias("longer"))
    totals = counted.filter("words = 0").select("lang", "n")
    kept = lowest.join(inside, ["lang", "phrase"], "left").filter(
        F.col("longer").isNull() | (F.col("longer").cast(wide) * 100 < F.col("a").cast(wide) * share))
    return kept.join(totals, "lang").select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))


def collocations(docs, top=TOP, threshold=THRESHOLD, longest=LONGEST, shards=SHARDS, text="text", slots=SLOTS):
    """lang, rank, phrase, a, l, r, n, score: the best ``top`` phrases of every language.

    Parts of a language are ranked first, so the last ranking sees ``top`` rows of each part at most.
    """
    counted = stored(count_phrases(docs, threshold, longest, shards, text, slots), "phrases")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(slices(docs.sparkSession)))
    first = score(counted).withColumn("part", part).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top).drop("part", "rank")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
