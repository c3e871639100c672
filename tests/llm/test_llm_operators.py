"""Operators for training data against brute force, on rows with every odd case."""

import heapq
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pressmill.llm import (
    components, consensus, cotrain, huffman, knn, langid, mixing, packing, quotient, rollups, simhash)
from pressmill.llm.common import ranked
from pressmill.llm.tokens import ChunkEncoder, default_vocabulary

# Extra columns have names that operators use themselves.
DOC_TYPE = ("doc_id long, text string, lang string, source string, n_chars long, size string, fp long, rank int, _rank int, mix int, "
            "_mark string, _mix int, _copy int, mark int, some string, _key int")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"word{i % 977} number" for i in range(40_000))
TEXTS = [
    (None, None, None, None), (None, "No id here, but text.", "en", "b"), (1, "", "en", "a"), (2, "Same words in this text of eight words", "en", "a"),
    (2, "Same words in this text of eight words", "en", "a"), (3, "Same  words\nin this\ttext of eight words ", "en", None),
    (4, LONG, "de", "b"), (5, "12345 !!", None, "c"), (6, None, "en", "c"), (7, " \n\t ", "en", "a"),
    (8, "Ünïcode ΣΑΣ İstanbul don't <|endoftext|> naïve … 'quoted' a.b", "de", "b"), (9, "one", "de", "a"), (10, "one two", "de", None),
]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), "x", 1, 2, 3, 4, "m", 5, 6, 7, "s", 8) for i, t, lang, s in rows], DOC_TYPE)


@pytest.fixture(scope="module")
def docs(spark):
    return docs_of(spark, TEXTS)


@pytest.fixture(scope="module")
def none(spark):
    return docs_of(spark, [])


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_vocabulary())


def sample(spark, name="documents"):
    return spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


# ------------------------------------------------------------------ 1: token files

@settings(deadline=None, max_examples=40)
@given(st.text(alphabet=st.sampled_from(list("abcÄßéΣİ .,!'1\n\t ́\x1c…|<>")), max_size=60))
def test_chunks_have_the_ids_of_the_whole(text):
    encoder = _encoder()
    for _ in range(2):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


_ENCODER = []


def _encoder():
    if not _ENCODER:
        _ENCODER.append(ChunkEncoder(default_vocabulary()))
    return _ENCODER[0]


@settings(deadline=None, max_examples=40)
@given(st.lists(st.integers(0, 1000), min_size=2, max_size=60))
def test_code_lengths_are_optimal(counts):
    lengths = huffman.code_lengths(np.asarray(counts))
    heap = [c for c in counts if c]
    if len(heap) < 2:
        return
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    assert int((lengths * np.asarray(counts)).sum()) == cost
    assert sum(2.0 ** -int(n) for n in lengths if n) == 1
    short = huffman.code_lengths(np.asarray(counts), 6)
    assert short.max() <= 6 and sum(2.0 ** -int(n) for n in short if n) <= 1


@settings(deadline=None, max_examples=30)
@given(st.lists(st.lists(st.integers(0, 40), max_size=400), min_size=1, max_size=6))
def test_bits_round_trip(pieces):
    ids = np.asarray([i for p in pieces for i in p], dtype=np.int64)
    lengths = huffman.code_lengths(np.bincount(ids, minlength=41))
    payloads, lanes = huffman.pack_bits(ids, [len(p) for p in pieces], lengths, huffman.code_words(lengths))
    shifts = np.cumsum([0] + [8 * len(p) for p in payloads])
    checkpoints = np.concatenate([np.frombuffer(x, "<i4") + s for x, s in zip(lanes, shifts)])
    assert huffman.unpack_bits(b"".join(payloads), checkpoints, [len(p) for p in pieces], huffman.decode_table(lengths)).tolist() == ids.tolist()


@given(st.lists(st.binary(max_size=50), min_size=1, max_size=5))
def test_joined_crc(parts):
    assert huffman.crc32_joined([(zlib.crc32(p), len(p)) for p in parts]) == zlib.crc32(b"".join(parts))


def test_token_files(spark, docs, tokenizer):
    rows = huffman.read_documents(spark, huffman.token_files(docs, default_vocabulary())).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == sorted((t[0] for t in TEXTS), key=lambda i: (i is not None, i))
    start, want = 0, Counter()
    for i, t, _, _ in TEXTS:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        want[i, len(ids), crc(ids)] += 1
    for r in rows:
        assert r["start"] == start
        start += r["n_tokens"]
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == want
    assert max(r["n_tokens"] for r in rows) > huffman.PIECE    # one document spans blocks


def test_token_files_of_nothing(spark, none):
    assert huffman.read_documents(spark, huffman.token_files(none, default_vocabulary())).count() == 0


# ------------------------------------------------------------------ 2: packing

def check_packing(rows, capacity):
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for at in places.values():
        end = 0
        for offset, length in sorted(at):
            assert offset == end
            end += length
        assert end <= capacity
    return len(places)


def best_fit_decreasing(lengths, capacity):
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, r in enumerate(room) if r >= n]
        if fits:
            k = min(fits, key=lambda k: room[k])
            room[k] -= n
        else:
            room.append(capacity - n)
    return len(room)


def test_packing(spark, docs, tokenizer):
    rows = packing.pack_documents(docs, default_vocabulary(), with_ids=True).collect()
    check_packing(rows, 2048)
    want = Counter()
    for i, t, _, _ in TEXTS:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            want[i, k // 2048, k, len(ids[k:k + 2048]), crc(ids[k:k + 2048])] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in rows)


@pytest.mark.parametrize("kind", ["even", "small", "same", "pairs"])
def test_packing_is_nearly_best_fit(spark, kind):
    rng = np.random.default_rng(3)
    n, lengths = {"even": (64, rng.integers(1, 65, 700)), "small": (64, rng.integers(1, 6, 900)), "same": (64, np.full(300, 20)),
                  "pairs": (64, rng.integers(17, 24, 400))}[kind]
    pieces = spark.createDataFrame([(i, int(x)) for i, x in enumerate(lengths)], "doc_id long, length long")
    used = check_packing(packing.pack(pieces, n).collect(), n)
    assert used <= best_fit_decreasing(lengths.tolist(), n) * 1.04 + 1


def test_packing_of_nothing(spark, none):
    assert packing.pack_documents(none, default_vocabulary()).count() == 0


# ------------------------------------------------------------------ 3: rollups

CHANGE = "op string, doc_id long, source string, lang string, version string, n_tokens long, docs string"


def test_rollup(spark):
    rollup = rollups.new_rollup(spark)
    assert rollup.totals().count() == 0

    def send(batch, *rows):
        return rollup.apply(batch, spark.createDataFrame([(*r, "x") for r in rows], CHANGE))

    def totals():
        return {(r["source"], r["lang"], r["version"]): (r["docs"], r["tokens"]) for r in rollup.totals().collect()}

    first = [("insert", 1, "a", "en", "v1", 10), ("insert", 2, "a", "en", "v1", 5), ("insert", 3, None, None, None, None),
             ("insert", None, "b", "de", "v1", 7), ("insert", 1, "a", "en", "v1", 10)]
    assert send("one", *first)
    want = {("a", "en", "v1"): (3, 25), (None, None, None): (1, 0), ("b", "de", "v1"): (1, 7)}
    assert totals() == want
    assert not send("one", *first) and totals() == want
    assert send("two", ("revise", 2, "c", "en", "v1", 8), ("delete", None, None, None, "v1", 0), ("delete", 99, "a", "en", "v1", 3))
    assert totals() == {("a", "en", "v1"): (2, 20), ("c", "en", "v1"): (1, 8), (None, None, None): (1, 0)}
    assert send("three", ("delete", 1, "zzz", "zzz", "v1", 0), ("revise", 50, "d", "fr", "v2", 4))
    assert totals() == {("c", "en", "v1"): (1, 8), (None, None, None): (1, 0), ("d", "fr", "v2"): (1, 4)}
    assert send("empty") and len(rollup.commits()) == 4


def test_broken_attempt_leaves_no_trace(spark):
    rollup = rollups.new_rollup(spark)
    lost = spark.createDataFrame([("a", "en", "v1", 1, 9)], "source string, lang string, version string, docs long, tokens long")
    lost.write.parquet(f"{rollup.path}/deltas/attempt-without-commit")
    rollup.apply("one", spark.createDataFrame([("insert", 1, "a", "en", "v1", 3, "x")], CHANGE))
    assert [r[:] for r in rollup.totals().collect()] == [("a", "en", "v1", 1, 3)]


# ------------------------------------------------------------------ 4: SimHash

def plain_fingerprint(text, n):
    import xxhash

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORDS.findall(low)
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) < n else [" ".join(words[i:i + n]) for i in range(len(words) - n + 1)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("crowd", [1000, 3])
def test_links_join_all_within_three_bits(spark, crowd):
    rng = np.random.default_rng(5)
    seeds = rng.integers(-2 ** 62, 2 ** 62, 25)
    values = set(seeds.tolist()) | {0, -1}
    for s in [*seeds[:12].tolist(), 0]:
        for _ in range(12):
            flips = 0
            for b in rng.choice(64, rng.integers(1, 5), replace=False):
                flips |= 1 << int(b)
            values.add(int(np.uint64((s & (2 ** 64 - 1)) ^ flips).astype(np.int64)))
    values = sorted(values)
    near = [(a, b) for i, a in enumerate(values) for b in values[:i] if bin((a ^ b) & (2 ** 64 - 1)).count("1") <= 3]
    edges = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), crowd)
    found = [(r["a"], r["b"]) for r in edges.collect()]
    assert all(bin((a ^ b) & (2 ** 64 - 1)).count("1") <= 3 for a, b in found)
    if crowd == 1000:
        assert Counter(map(frozenset, found)) == Counter(map(frozenset, near))
    assert plain_components(values, found) == plain_components(values, near)


def test_near_duplicates(spark, docs):
    rows = simhash.near_duplicates(docs, 3).collect()
    want = Counter((i, plain_fingerprint(t, 3)) for i, t, _, _ in TEXTS)
    assert Counter((r["doc_id"], r["fp"] & (2 ** 64 - 1)) for r in rows) == want
    roots = {r["doc_id"]: r["component_id"] for r in rows}
    assert roots[2] == roots[3] == 2 and roots[7] == roots[6] == roots[1] == 1 and roots[4] == 4
    assert {r["component_id"] for r in rows if r["doc_id"] is None} == {1, None}


def test_near_duplicates_of_nothing(spark, none):
    assert simhash.near_duplicates(none, 3).count() == 0 and simhash.keep_one_each(none).count() == 0


def test_one_of_each_component_stays(spark, docs):
    kept = simhash.keep_one_each(docs)
    assert kept.columns == docs.columns
    assert {(r["_mark"], r["_mix"], r["mark"], r["some"]) for r in kept.collect()} == {("m", 5, 7, "s")}
    assert sorted((r["doc_id"] for r in kept.collect()), key=lambda i: (i is not None, i)) == [None, 1, 2, 4, 5, 8, 9, 10]


def plain_kept(texts):
    """doc_ids that stay of {doc_id: text}, by the similarity of all pairs."""
    sets = {}
    for i, text in texts.items():
        words = (text or "").lower().split()
        sets[i] = {tuple(words[k:k + 5]) for k in range(max(len(words) - 4, 1))}
    ids = sorted(sets)
    near = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:]
            if 5 * len(both := sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]) - len(both))]
    roots = plain_components(ids, near)
    return sorted(set(roots.values()))


def changed(words, places, tag):
    out = list(words)
    for k in places:
        out[k] = f"{tag}x{k}"
    return " ".join(out)


@pytest.mark.parametrize("group", [50, 4])
def test_families_stay_by_one(spark, group):
    rng = np.random.default_rng(8)
    texts = {}
    # Copies that are similar to an original, but not to each other.
    first = [f"w{k}" for k in range(400)]
    for i in range(160):
        texts[i] = changed(first, rng.choice(80, 8, replace=False) * 5, i)
    texts[900] = " ".join(first)
    # Documents over a vocabulary of 30 words, some with a near copy, and a line that all share.
    for i in range(1000, 1120):
        words = ["the", "very", "same", "line", "in", "all", "of", "them"] + [f"v{k}" for k in rng.integers(0, 30, 150)]
        texts[i] = " ".join(words)
        if i % 4 == 0:
            texts[i + 1000] = changed(words, rng.choice(150, int(rng.integers(1, 6)), replace=False), i)
    df = docs_of(spark, [(i, t, "en", "a") for i, t in texts.items()])
    want = plain_kept(texts)
    assert 0 in want and sum(i < 1000 for i in want) == 1
    assert sorted(r["doc_id"] for r in simhash.keep_one_each(df, group=group).collect()) == want


def test_near_stage_links_by_fingerprints(spark):
    """Texts whose fingerprints link while their sets of shingles differ; null and repeated rows stay as one."""
    import corpus_pipeline

    line = "one two three four five six seven " * 60
    rows = [(7, line + "a b c d e f g h i j", "en", "a"), (3, line + "k l m n o p q r s t", "en", "b"),
            (5, "something else that stands quite by itself here", "en", "a"), (5, "something else that stands quite by itself here", "en", "a"), (9, None, "en", "a"), (8, " ", "en", "a")]
    prints = [plain_fingerprint(t, 5) for _, t, _, _ in rows]
    assert bin(prints[0] ^ prints[1]).count("1") <= 3 and plain_kept({i: t for i, t, _, _ in rows[:2]}) == [3, 7]
    kept = corpus_pipeline.near(spark, docs_of(spark, rows), None)
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 5, 8]


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000)]
    rows = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    got = {r["node"]: r["root"] for r in rows if r["node"] != r["root"]}
    assert got == {**{i: 0 for i in range(1, 301)}, **{1000 + i: 1000 for i in range(1, 200)}}


# ------------------------------------------------------------------ 5: language

def test_gradients():
    rng = np.random.default_rng(0)
    net = {k: v.astype(np.float64) for k, v in langid.new_network(3, rng).items()}
    rows, lengths, labels = rng.integers(97, 110, (4, langid.SPAN)).astype(np.uint8), np.asarray([64, 10, 1, 33]), np.asarray([0, 1, 2, 1])
    _, grads = langid.gradients(net, rows, lengths, labels)
    for name, value in net.items():
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in value.shape)
            if name[0] == "x":
                at = (at[0], int(rows[0, 5]))
            old, change = value[at], 1e-4
            value[at] = old + change
            up, _ = langid.gradients(net, rows, lengths, labels)
            value[at] = old - change
            down, _ = langid.gradients(net, rows, lengths, labels)
            value[at] = old
            assert abs((up - down) / (2 * change) - grads[name][at]) < 2e-4


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.predict(docs, *langid.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    out = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert np.mean([r["lang_pred"] == r["lang"] for r in out]) > 0.95 and all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_odd_rows(spark, docs, none):
    rows = langid.predict(docs, *langid.fit(docs, steps=3)).collect()
    und = Counter(r["doc_id"] for r in rows if r["lang_pred"] == "und")
    assert und == Counter([None, 1, 5, 6, 7]) and len(rows) == len(TEXTS)
    assert {r["lang_pred"] for r in rows} <= {"und", "en", "de"}
    assert {r["lang_pred"] for r in langid.predict(docs, *langid.fit(none)).collect()} == {"und"}
    assert langid.predict(none, *langid.fit(none)).count() == 0


# ------------------------------------------------------------------ 6: quality

def test_quality_on_unseen_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").repartition(8)
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    seen, unseen = labels.filter("doc_id % 2 = 0"), labels.filter("doc_id % 2 = 1")
    rows = cotrain.score(docs, cotrain.fit(docs, seen)).join(unseen, "doc_id").collect()
    good, bad = [r for r in rows if r["quality"] == 1], [r for r in rows if r["quality"] == 0]
    assert np.mean([r["accepted"] for r in good]) > 0.99 and np.mean([r["accepted"] for r in bad]) < 0.15


def test_quality_of_odd_rows(spark, docs, none):
    kind = "doc_id long, quality int, toxic int, score double"
    labels = spark.createDataFrame([(2, 1, 0, 0.0), (2, 1, 0, 0.0), (8, 1, 0, 0.0), (5, 0, 0, 0.0), (7, 0, None, 0.0), (9, None, 1, 0.0), (None, 1, 1, 0.0)], kind)
    model = cotrain.fit(docs, labels)
    rows = cotrain.score(docs, model).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r["score"] <= 1 and r["accepted"] == (r["score"] >= cotrain.ACCEPT) for r in rows)
    assert Counter(r["doc_id"] for r in rows if r["accepted"]) == Counter(r["doc_id"] for r in cotrain.keep_good(docs, model).collect())
    one_kind = cotrain.fit(docs, labels.filter("quality = 1"))
    assert one_kind is None and cotrain.score(docs, None).filter("accepted AND score = 1").count() == len(TEXTS)
    assert cotrain.fit(none, labels) is None and cotrain.score(none, model).count() == 0


def test_repeated_ids_count_once_in_the_sample(spark, monkeypatch):
    rows = [(1, f"Text {k} of one id", "en", "a") for k in range(200)] + [(i, f"Words of document {i}", "en", "a") for i in range(2, 9)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 7)], "doc_id long, quality int")
    monkeypatch.setattr(cotrain, "fit_views", len)
    assert cotrain.fit(docs_of(spark, rows), labels) == 8


# ------------------------------------------------------------------ 7: top-k

def plain_top_k(rows, k, every):
    sound = [(i, v) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    ints = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in sound]
    out = Counter()
    for at, (q, v) in enumerate(ints):
        if q is None or q % every:
            continue
        scores = sorted(((-sum(a * b for a, b in zip(v, w)), i is None, i or 0, n) for n, (i, w) in enumerate(ints) if n != at))
        for rank, (score, missing, i, _) in enumerate(scores[:k], 1):
            out[q, rank, None if missing else i, -score] += 1
    return out


def test_top_k(spark):
    rng = np.random.default_rng(2)
    hot = rng.normal(size=6).tolist()
    rows = [(i, hot if i % 3 == 0 else rng.normal(size=6).tolist()) for i in range(240)]
    rows += [(None, rng.normal(size=6).tolist()), (400, None), (420, [1.0, None]), (440, [float("nan")] * 6), (460, [float("inf")]), (480, []),
             (500, [3.0, 4.0]), (20, rng.normal(size=6).tolist())]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, rank int, x string")
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = Counter(r[:] for r in knn.top_k(df, k=20, every=20).collect())
    assert got == plain_top_k(exact, 20, 20)
    assert Counter(r[:] for r in knn.top_k(df.limit(5), k=20, every=1).collect()) == plain_top_k(exact[:5], 20, 1)
    assert knn.top_k(df.filter("false")).count() == 0


# ------------------------------------------------------------------ 8: mixing

def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, free, out = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 2 * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = 2 * sizes[s]
        left -= sum(out[s] for s in over)
        free -= set(over)
    return out


@pytest.mark.parametrize("table", ["odd", "sample"])
def test_mixing(spark, docs, table):
    df = docs if table == "odd" else sample(spark)
    rows = mixing.mix(df).select("doc_id", "source", "text", "mix.*").collect()
    sizes = defaultdict(int)
    for r in rows:
        assert r["size"] == len(WORDS.findall(r["text"] or "")) and r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        sizes[r["source"]] += r["size"]
    want, taken, largest = plain_targets(sizes), defaultdict(int), defaultdict(int)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in want)
    again = {(r["doc_id"], r["size"]): r["taken"] for r in mixing.mixed_sizes(df.repartition(5)).collect()}
    assert again == {(r["doc_id"], r["size"]): r["taken"] for r in rows}


def test_mix_repeats_rows(spark, docs):
    out = mixing.repeated(docs)
    assert out.columns == docs.columns
    assert {(r["_mark"], r["_mix"], r["_copy"], r["mix"]) for r in out.collect()} == {("m", 5, 6, 4)}
    copies = Counter({r["doc_id"]: 0 for r in docs.collect()})
    for r in mixing.mixed_sizes(docs).collect():
        copies[r["doc_id"]] += r["copies"]
    assert Counter(r["doc_id"] for r in out.collect()) == +copies


def test_mixing_of_nothing(spark, none, docs):
    assert mixing.mixed_sizes(none).count() == 0 and mixing.repeated(none).count() == 0
    empty = docs.filter("doc_id IN (1, 6, 7)")
    assert all(r["taken"] == 0 and r["target"] == 0 for r in mixing.mixed_sizes(empty).collect())


# ------------------------------------------------------------------ 9: exact duplicates

@settings(deadline=None, max_examples=40)
@given(st.lists(st.lists(st.integers(0, 2 ** 60 - 1), max_size=50), min_size=1, max_size=4), st.integers(1, 8))
def test_filters_merge_without_loss(parts, quotient_bits):
    lists = []
    for part in parts:
        values, counts = np.unique(np.asarray(part, dtype=np.uint64), return_counts=True)
        raw = quotient.build_filter(values, counts, 60, quotient_bits)
        lists.append(quotient.read_filter(raw))
        assert dict(zip(lists[-1][0].tolist(), lists[-1][1].tolist())) == Counter(part)
    while len(lists) > 1:
        lists.append(quotient.merged(lists.pop(), lists.pop()))
    assert dict(zip(lists[0][0].tolist(), lists[0][1].tolist())) == Counter(x for p in parts for x in p)


def test_counts_of_filters(spark):
    rows = [(v,) for v in [5, -5, 5, 2 ** 62, -2 ** 63, 0, 0, 0, 2 ** 62]]
    filters = quotient.merged_filters(spark.createDataFrame(rows, "fp long").repartition(3))
    assert {r["fp"]: r["n"] for r in quotient.repeated_fingerprints(filters).collect()} == {5: 2, 0: 3, 2 ** 62: 2}


def test_exact_duplicates(spark, docs, none):
    import hashlib

    rows = quotient.find_duplicates(docs).collect()
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t, _, _ in TEXTS if i is not None}
    sizes = Counter(re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, _, _ in TEXTS)
    first = {}
    for i in sorted(norm):
        first.setdefault(norm[i], i)
    for r in rows:
        if r["doc_id"] is not None:
            text = norm[r["doc_id"]]
            assert (r["keep_id"], r["group_size"]) == (first[text], sizes[text])
            assert r["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert len(rows) == len(TEXTS) and sum(r["kept"] for r in rows) == len(sizes)
    kept = quotient.drop_duplicates(docs)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([None, 1, 2, 3, 4, 5, 7, 8, 9, 10])
    assert {(r["_mark"], r["_mix"], r["_copy"], r["mark"], r["some"], r["_key"]) for r in kept.collect()} == {("m", 5, 6, 7, "s", 8)}
    assert quotient.find_duplicates(none).count() == 0 and quotient.drop_duplicates(none).count() == 0


# ------------------------------------------------------------------ 10: main text

SHELL = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a = "<p>no</p>";</script></head><body>
<header><p>Site name and slogan of the site</p></header><nav><ul><li><a href="/">Home</a></li></ul></nav>%s
<aside><p>Sidebar text that is rather long, with commas, and words</p></aside><div class="cookie-notice">We use cookies, as everyone does.</div>
<section id="comments"><p>A reader wrote a long comment here, longer than the article itself could ever be.</p></section>
<form><p>Subscribe to our letter</p></form><footer>&copy; 2024</footer></body></html>"""


def test_main_text(spark):
    body = '<div class="story story-17"><h1>Head</h1><p>First&nbsp;part &amp; <b>bold</b>\n text.<p>Second &lt;tag&gt;, with commas, long enough to count.</p><ul><li>one<li>two</ul>a < b</div>'
    want = "Head\n\nFirst part & bold text.\n\nSecond <tag>, with commas, long enough to count.\n\none\n\ntwo\n\na < b"
    pages = [(i, f"https://h.com/{i}", SHELL % body.replace("17", str(i))) for i in range(12)]
    # A page whose other parts are longer follows its host.
    pages.append((90, "https://h.com/90", SHELL % ('<div class="story story-90"><p>Short.</p></div><div class="more">' + "<p>Other stories, of which there are many, are told here.</p>" * 9 + "</div>")))
    pages += [(91, None, None), (92, "nonsense", ""), (93, "https://x.org/", "<p>Only this, a sentence without any container"), (94, "https://x.org/2", "plain text"),
              (95, "https://x.org/3", "<article>Text <!-- no --> goes on<br>here</article><div class='ad'>Buy now, buy a lot, buy everything</div"), (0, "https://h.com/0", pages[0][2])]
    df = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, text string, host int")
    rows = consensus.main_texts(df).collect()
    got = {r["page_id"]: r["text"] for r in rows}
    assert len(rows) == len(pages) and all(r["n_chars"] == len(r["text"]) for r in rows)
    assert all(got[i] == want for i in range(12))
    assert got[90] == "Short." and got[91] == got[92] == "" and got[94] == "plain text"
    assert got[93] == "Only this, a sentence without any container" and got[95] == "Text goes on here"
    assert consensus.main_texts(df.filter("false")).count() == 0


def test_main_text_of_given_pages(spark):
    df = sample(spark, "pages")
    html = {r["page_id"]: r["html"] for r in df.collect()}
    import html as entities

    for r in consensus.main_texts(df).collect():
        inner = re.search(r"(?s)<article>(.*?)(?:</article>|\Z)", html[r["page_id"]])[1]
        blocks = [re.sub(r"\s+", " ", entities.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " ")))).strip() for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r["text"] == "\n\n".join(b for b in blocks if b)


LONG_P = "<p>An article goes on with many words, sentence after sentence.</p>"
LONG_T = "An article goes on with many words, sentence after sentence."


@pytest.mark.parametrize("page", [
    f'<body style="overflow:hidden"><div>{LONG_P}</div></body>', f'<div aria-hidden="false">{LONG_P}</div>', f'<div data-x="hidden">{LONG_P}</div>',
    f'<div data-id="comments" title="class=ad">{LONG_P}</div>', f"<body hidden><div>{LONG_P}</div>",
    f'<div>{LONG_P}<p hidden>no</p><p aria-hidden="true">no</p><p style="color:red; display: none">no</p></div>'])
def test_only_whole_attributes_hide(page):
    assert consensus.extract(page) == LONG_T


def test_links_are_not_unwanted_by_their_address():
    assert consensus.extract('<div><p>Read <a href="/p?id=ad-5">this</a> as well, please, all of you.</p></div>') == "Read this as well, please, all of you."


@pytest.mark.parametrize("opening, closing", [
    ('<div class="content has-sidebar">', "</div>"), ('<div class="main no-ads">', "</div>"), ('<div class="elementor-widget"><div class="widget">', "</div></div>"),
    ('<div class="layout with-header">', "</div>"), ('<form action="/"><div>', "</div></form>")])
def test_unwanted_words_do_not_drop_a_whole_page(opening, closing):
    menu = '<nav>Home and other pages of this site, all of them</nav><div class="ad">Buy now, buy a lot, buy everything</div>'
    assert consensus.extract(f"<body>{opening}{menu}{LONG_P * 3}{closing}</body>") == "\n\n".join([LONG_T] * 3)


def test_long_comments_do_not_displace_an_article():
    comments = '<div class="comments">' + "<p>A reader wrote a long comment here, and more of it.</p>" * 9 + "</div>"
    assert consensus.extract(f"<article>{LONG_P}</article>{comments}") == LONG_T


@pytest.mark.parametrize("one, two", [("lead", "body"), ("title", "text")])
def test_articles_in_two_unlike_containers_stay_whole(one, two):
    head = "A head that says what this article is about"
    links = '<div class="more">' + '<a href="/x">Another story of this site, to be read elsewhere</a>' * 3 + "</div>"
    page = f'<body><div class="page"><div class="{one}">{head}</div><div class="{two}">{LONG_P * 5}</div></div>{links}</body>'
    assert consensus.extract(page) == "\n\n".join([head] + [LONG_T] * 5)


def test_pages_follow_the_layout_they_have():
    page = f'<body><div class="a"><p>A teaser.</p></div><div class="b">{LONG_P * 3}</div></body>'
    assert consensus.extract(page, ("/body/div.a", "/body/div.b")) == "\n\n".join([LONG_T] * 3)


@pytest.mark.parametrize("page, want", [
    ("<body><p title=it's>Hello, in this paragraph we don't lose it.</p><p>Nor this one, that isn't lost.</p></body>",
     "Hello, in this paragraph we don't lose it.\n\nNor this one, that isn't lost."),
    (f"<div><p title=\"a > b\">{LONG_T}</p></div>", LONG_T), (f"<div><p title='a > \"b'>{LONG_T}</p></div>", LONG_T),
    (f'<div><p title="never closed>{LONG_T}</p></div>', LONG_T), (f"<div>{LONG_P}<!--> <b></b><!-- no --></div>", LONG_T),
    (f"<article>{LONG_P}</article><div class='user-discussion'>{LONG_P * 4}</div>", LONG_T)])
def test_tags_end_where_they_end(page, want):
    assert consensus.extract(page) == want


@pytest.mark.parametrize("page", [
    '<div class="ad">' * 5_000 + LONG_P, '<a title="' * 100_000, """<a title="x' b='y" """ * 50_000, "<!--" * 250_000, "<a " * 300_000,
    "<div>" * 50_000 + LONG_P, f"<div>{LONG_T}</div><div class=ad>" * 5_000])
def test_hostile_pages_take_time_by_their_length(page):
    start = time.time()
    consensus.best_path(consensus.containers_of(page))
    assert consensus.extract(page) in (LONG_T, "") and time.time() - start < 5


# ------------------------------------------------------------------ shared

def test_ranks_of_a_hot_group(spark):
    df = spark.range(2000).withColumn("k", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")))
    rows = ranked(df, "k", ["id"]).collect()
    assert sorted(r["rank"] for r in rows if r["k"] == 0) == list(range(667)) and {r["rank"] for r in rows if r["k"]} == {0}


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        if name == "exact dedup":
            norms = [re.sub(r"[\x20\x09-\x0D]+", " ", r["text"]) for r in docs.collect()]
            assert len(norms) == len(set(norms))
        if name == "near dedup":
            prints = [plain_fingerprint(r["text"], 5) for r in docs.collect()]
            assert all(bin(a ^ b).count("1") > 3 for i, a in enumerate(prints) for b in prints[:i])
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    check_packing(rows, 2048)
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.collect()} <= set(texts)


def test_pipeline_of_odd_rows(spark, docs, none):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    for start in (docs, none):
        table = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            table = spark.createDataFrame(stage(spark, table, sf).collect(), start.schema)
        check_packing(corpus_pipeline.STAGES[-1][1](spark, table, sf).collect(), 2048)
