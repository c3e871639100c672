"""Resampling, collocations and repeated passages against brute force, on rows with every odd case."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pressmill.llm import collocations, relative, resampling
from pressmill.llm.common import bits_for, filter_bits, may_be_in, split_by_keys

DOC_TYPE = "doc_id long, text string, lang string, source string, rank int, score string, bucket int, _hit int, phrase string, words int"
LONG = " ".join(f"word{i % 977} number" for i in range(40_000))


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 1, "x", 2, 3, "p", 4) for i, t, lang in rows], DOC_TYPE)


def passage(rng, n, tag="p"):
    return " ".join(f"{tag}{k}" for k in rng.integers(0, 500, n))


# ------------------------------------------------------------------ filters

def test_rows_that_may_meet_keys(spark):
    df = spark.range(3000).select(F.xxhash64("id").alias("h"), "id", F.lit(1).alias("_bucket"), F.lit(2).alias("_hit"))
    keys = df.filter("id < 100").select("h")
    rest, possible = split_by_keys(df, F.col("h"), keys)
    assert rest.columns == df.columns and rest.count() + possible.count() == 3000
    assert possible.filter("id < 100").count() == 100 and possible.count() < 500
    values = np.asarray([r[0] for r in df.select("h").collect()], np.int64).view(np.uint64)
    held = may_be_in(filter_bits(keys, bits_for(100)), values)
    assert held[:100].all() and held.sum() < 500
    rest, possible = split_by_keys(df, F.col("h"), keys.filter("false"))
    assert rest.count() == 3000 and possible.count() == 0


# ------------------------------------------------------------------ 11: resampling

def plain_features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return words, [" ".join(words[i:i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plain_resample(docs, target, percent=5, least=20):
    def bucket(f):
        return zlib.crc32(f.encode()) % 10_000

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, plain_features(text)[1]))
    for text in target:
        t.update(map(bucket, plain_features(text)[1]))
    size, goal = sum(s.values()), sum(t.values())
    rows = []
    for doc_id, text in docs:
        words, features = plain_features(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (size + 10_000) / ((s[b] + 1) * (goal + 10_000)))) for b in map(bucket, features))
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)))
    some = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    ranks = defaultdict(list)
    for k, r in enumerate(some, 1):
        ranks[r].append(k if k <= percent * len(some) // 100 else None)
    return Counter((*r[:4], ranks[r].pop() if ranks[r] else None) for r in rows)


ODD = [(None, LONG[:3000], "en"), (None, None, "de"), (1, "", None), (2, "Ünïcode ΣΑΣ İstanbul\x00don't_stop 12-34 " * 9, "en"),
       (3, LONG, "en"), (3, LONG, "en"), (4, " \n\t ", "xx"), (5, "one two three " * 7, "en"), (6, "one", "en"), (7, "é" * 3000 + " x" * 30, "de")]


def test_resampling(spark):
    rng = np.random.default_rng(4)
    rows = ODD + [(i, passage(rng, int(rng.integers(1, 90)), "ab"[i % 2]), "en") for i in range(100, 220)] + [(150, "again " * 25, "en")] * 3
    target = [passage(rng, 200, "b"), None, "", "Über-Text"]
    goal = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "doc_id long, text string")
    got = resampling.resample(docs_of(spark, rows), goal)
    assert Counter(tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in got.collect()) == plain_resample([r[:2] for r in rows], target)
    assert resampling.resample(docs_of(spark, []), goal).count() == 0
    few = docs_of(spark, rows[:8])
    got = resampling.resample(few, goal.filter("false"), percent=50).collect()
    assert Counter(tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in got) == plain_resample([r[:2] for r in rows[:8]], [], 50)


@settings(deadline=None, max_examples=60)
@given(st.lists(st.sampled_from(["a", "Bc", "ß", "日本", "-", "_", " ", "\x00", "7"]), max_size=60).map("".join), st.integers(1, 9))
def test_sliced_features(text, size):
    table, got, before = resampling.translation(), [], []
    for words in resampling.word_slices(text.encode(), table, size):
        got += resampling.feature_hashes(words, before)
        before = (before + words)[-2:]
    assert Counter(got) == Counter(zlib.crc32(f.encode()) for f in plain_features(text)[1])


# ------------------------------------------------------------------ 12: collocations

def plain_collocations(rows, threshold, top=2000, longest=4):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, tuple(words[i:i + k])) for i in range(len(words) - k + 1))
    cand = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= threshold}
    hidden = set()
    for (lang, words), a in cand.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                if 100 * a >= 80 * f[lang, words[i:i + k]]:
                    hidden.add((lang, words[i:i + k]))
    by_lang = defaultdict(list)
    for (lang, words), a in cand.items():
        if (lang, words) not in hidden:
            score, _, left, right = min((2_000_000 * a // (f[lang, words[:k]] + f[lang, words[k:]]), k, f[lang, words[:k]], f[lang, words[k:]]) for k in range(1, len(words)))
            by_lang[lang].append((-score, -a, " ".join(words).encode(), left, right))
    return Counter((lang, rank, p.decode(), -a, left, right, n[lang], -score) for lang, found in by_lang.items()
                   for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1))


FIELDS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def mixed_texts(seed=6, n=260):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{k}" for k in range(40)] + ["New", "York", "É!", "a.b", "x\x1cy", "ﬁ"]
    weights = 1 / np.arange(1, len(vocabulary) + 1)
    rows = []
    for i in range(n):
        words = list(rng.choice(vocabulary, int(rng.integers(0, 50)), p=weights / weights.sum()))
        if i % 3 == 0:
            words += ["New", "York", "City", "hall"] if i % 2 else ["in", "New", "York,", "City"]
        sep = ["\t", "  ", "\n", " ", ". "]
        rows.append((i, "".join(w + sep[int(rng.integers(0, 5))] for w in words), ["en", "de", None][i % 3 if i % 7 else 0]))
    return rows + [(None, "New York City hall " * 40, "en"), (1, None, "fr"), (2, "", None), (3, "aa aa aa aa aa aa " * 8, "es"), (4, "one two", "it")]


@pytest.mark.parametrize("threshold, shards, slots", [(30, 3, 1 << 16), (5, 3, 1 << 16), (5, 4, 1 << 15), (7, 1, 1 << 16)])
def test_collocations(spark, threshold, shards, slots):
    rows = mixed_texts()
    got = collocations.collocations(docs_of(spark, rows).repartition(5), threshold=threshold, shards=shards, slots=slots).collect()
    assert Counter(tuple(r[c] for c in FIELDS) for r in got) == plain_collocations(rows, threshold)


def test_collocations_cut_by_rank_and_of_nothing(spark, monkeypatch):
    rows = mixed_texts(9, 120)
    monkeypatch.setattr(collocations, "CHUNK", 50)   # many chunks, words forgotten between them
    got = collocations.collocations(docs_of(spark, rows), top=3, threshold=4, slots=1 << 15).collect()
    assert Counter(tuple(r[c] for c in FIELDS) for r in got) == plain_collocations(rows, 4, 3)
    assert collocations.collocations(docs_of(spark, []), slots=1 << 15).count() == 0


def test_a_full_table_of_slots_loses_nothing():
    """With every slot taken, phrases are looked for needlessly and counted all the same."""
    numbers = collocations.Numbers()
    ids = np.asarray([numbers[w] for w in b"a b a b c \xff a b".split()] + [0])
    state, hashes = np.zeros(64, np.uint8), np.arange(len(numbers), dtype=np.uint64)
    found = {n: dict(zip(p, c.tolist())) for n, p, c in collocations.count_chunk(ids, numbers.words, hashes, state, 1, 3, 4)}
    assert found[1] == {b"a": 3, b"b": 3, b"c": 1} and found[2] == {b"a b": 3, b"b a": 1, b"b c": 1}
    assert found[4] == {b"a b a b": 1, b"b a b c": 1}


def test_phrases_told_by_a_shared_slot_before_their_parts():
    """The slots of "a b" and "b c" were set in step 0 by other phrases, those of the words in step 3:
    the longer phrase is met from step 4 on and has to be looked for in a whole cycle."""
    numbers = collocations.Numbers()
    ids = np.asarray([numbers[w] for w in b"a b c".split()] + [0])
    hashes = np.asarray([collocations.phrase_hash("en", w) if w else 0 for w in ["", "a", "b", "c"]], np.uint64)
    state = np.full(1 << 16, collocations.NEVER, np.uint8)
    for phrase, step in (("a b", 0), ("b c", 0), ("a", 3), ("b", 3), ("c", 3)):
        state[collocations.phrase_hash("en", phrase) & ((1 << 16) - 1)] = step
    looked_for = [step for step in range(2, 9) if step > 3 and any(
        n == 3 for n, _, _ in collocations.count_chunk(ids, numbers.words, hashes, state, step, 2, 4))]
    assert looked_for == [4, 5]


# ------------------------------------------------------------------ 13: repeated passages

def plain_removed(rows, window=20):
    first = {}
    texts = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows]

    def position(i, start):
        return (i is None, i or 0, start)
    for i, words in texts:
        for s in range(len(words) - window + 1):
            key = tuple(words[s:s + window])
            first[key] = min(first.get(key, position(i, s)), position(i, s))
    out = Counter()
    for i, words in texts:
        gone = set()
        for s in range(len(words) - window + 1):
            if position(i, s) > first[tuple(words[s:s + window])]:
                gone.update(range(s, s + window))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out[i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


def passages(seed):
    rng = np.random.default_rng(seed)
    shared = [passage(rng, n) for n in (19, 20, 21, 55, 140)]
    rows = []
    for i in range(60):
        parts = [passage(rng, int(rng.integers(0, 60)), "q")]
        for k in rng.choice(len(shared), int(rng.integers(0, 4))):
            words = shared[k].split()
            cut = int(rng.integers(0, 12)) if i % 2 else 0
            parts += [" ".join(words[cut:]), passage(rng, int(rng.integers(0, 30)), "q")]
        rows.append((int(rng.permutation(500)[0]) * 100 + i, "\n ".join(parts), "en"))
    return rows


def removed(df, **options):
    return Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in relative.remove_repeats(df, **options).collect())


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_repeated_passages(spark, monkeypatch, block):
    """In one block per task, and in blocks smaller than documents."""
    monkeypatch.setattr(relative, "BLOCK", block)
    rows = passages(3)
    rows += ODD + [(8, "la " * 300, "en"), (9, "la " * 25 + "end", "en"), (rows[0][0], rows[0][1] + " tail", "en"), (None, rows[1][1], None), (None, rows[1][1], None),
                   (10, "do re mi fa " * 40, "en"), (11, rows[2][1], "en"), (11, rows[2][1], "en"), (11, rows[3][1], "en")]
    assert removed(docs_of(spark, rows).repartition(4)) == plain_removed(rows)


def test_a_passage_that_all_documents_share(spark):
    rng = np.random.default_rng(1)
    hot = passage(rng, 30)
    rows = [(i, f"{passage(rng, 9)} {hot} {passage(rng, 9)}" if i % 3 else passage(rng, 50), "en") for i in range(300)]
    df = docs_of(spark, rows).repartition(6)
    assert removed(df) == plain_removed(rows)
    with_text = relative.remove_repeats(df, with_text=True).collect()
    assert all(hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"] for r in with_text)


def test_repeats_of_nothing(spark):
    assert relative.remove_repeats(docs_of(spark, [])).count() == 0


@settings(deadline=None, max_examples=80)
@given(st.lists(st.integers(0, 3), max_size=70), st.integers(1, 9))
def test_hashes_of_windows(values, n):
    words = np.asarray(values, np.uint64) * np.uint64(2_654_435_761) + np.uint64(99)
    got = relative.run_hashes(words, n)
    runs = [tuple(values[i:i + n]) for i in range(len(values) - n + 1)]
    assert len(got) == len(runs) and len(set(zip(got.tolist(), runs))) == len(set(runs)) == len(set(got.tolist()))
    least = relative._sliding(got, 4, np.minimum)
    assert least.tolist() == [min(got[i:i + 4]) for i in range(len(got) - 3)]
    _, anchors = relative.windows_of(words, n + 3, n)
    assert anchors.tolist() == least.tolist() and set(relative.anchor_places(words, n + 3, n).tolist()) == set(least.tolist())


@given(st.binary(max_size=40), st.integers(1, 9))
def test_words_are_not_torn(raw, size):
    assert [w for part in relative.word_slices(raw, size) for w in part] == raw.split()
