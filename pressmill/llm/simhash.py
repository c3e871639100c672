"""Operator 4: near duplicates by SimHash, with deletion-variant signatures.

Fingerprints have 64 bits: texts are lower-cased (A-Z), cut at white space, and every
shingle of three words, repeats included, votes on every bit with its XXH64.  Documents
whose fingerprints differ in three bits or fewer are linked.

Of two segments of 32 bits, one differs in at most one bit.  So each distinct fingerprint
is indexed under both segments with each bit deleted in turn; an equality join on (segment,
deleted bit, rest) finds all pairs, and verifies them by their distance.  A pair is taken at one signature only:
that of the first segment that fits, with the differing bit (or bit 0) deleted.

Signatures shared by more than ``CROWD`` fingerprints are not joined, as their pairs grow
with the square.  Their fingerprints are linked over points instead: two fingerprints are
within three bits just if some point lies within one bit of the one and within two bits of
the other, so all fingerprints within two bits of a point hang together as soon as one is
within one bit of it.  That costs 2 081 rows for a fingerprint, whatever the crowd.

``drop_near_duplicates`` keeps one document of each component of these links; the pipeline uses it.

``keep_one_each`` is another measure, similar sets of shingles: texts whose five-word
shingles agree by 0.8 differ in about ten of 64 bits.  It joins the prefixes of their sets of
shingles, which finds all such pairs, and verifies them by the sets.

Null and empty texts, and texts of white space, have fingerprint zero and are linked like all
others.  Documents with equal fingerprints form a class, counted inside the tasks;
component_id is the smallest doc_id of a component, null if none of its rows has one.  Repeated rows
each have a row in the result.  An empty input gives no rows; extra columns are not read.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pressmill.llm.common import bits_for, filter_bits, keep_unmarked, may_be_in, split_by_keys, stored, with_package
from pressmill.llm.components import components

WORDS = 3
SEED = 42
DISTANCE = 3
SEGMENT = 32
CROWD = 1_000
HASHED_AT_ONCE = 65_536


def fingerprint(text, words=WORDS):
    """SimHash of one text as an unsigned integer."""
    import xxhash

    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    line = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[min(words, len(tokens)) - 1:]
    first = starts[:len(last)]
    digest, votes = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, len(last), HASHED_AT_ONCE):
        spans = zip(first[at:at + HASHED_AT_ONCE].tolist(), last[at:at + HASHED_AT_ONCE].tolist())
        hashes = np.asarray([digest(line[a:b], SEED) for a, b in spans], dtype="<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(last), bitorder="little").view("<u8")[0])


def _fingerprints(words):
    def run(batches):
        for batch in batches:
            values = np.asarray([fingerprint(t.as_py(), words) for t in batch.column(0)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(values.view(np.int64), pa.int64())], [*batch.schema.names[1:], "fp"])
    return run


def _text_hash(text):
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def fingerprints(docs, words=WORDS, text="text", with_text_hash=False):
    """doc_id, fp (the 64 bits as a signed long): one row per document; ``with_text_hash`` adds that of its text."""
    own = [F.col("doc_id").cast("long").alias("doc_id"), *([_text_hash(text).alias("text_hash")] if with_text_hash else [])]
    schema = "doc_id long, " + ("text_hash long, " if with_text_hash else "") + "fp long"
    return with_package(docs).select(F.col(text).alias("text"), *own).mapInArrow(_fingerprints(words), schema)


def _segment(fp, number):
    return F.shiftrightunsigned(fp, SEGMENT * number).bitwiseAND(F.lit((1 << SEGMENT) - 1))


def signatures(distinct):
    """One row per fingerprint, segment and deleted bit: signature (long), fp."""
    variant = distinct.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(2 * SEGMENT - 1))))
    part = F.when(F.col("v") < SEGMENT, _segment(F.col("fp"), 0)).otherwise(_segment(F.col("fp"), 1))
    rest = part.bitwiseAND(F.bitwise_not(F.expr(f"shiftleft(1L, v % {SEGMENT})")))
    return variant.select((F.col("v") * F.lit(1 << SEGMENT) + rest).alias("signature"), "fp")


def _canonical(signature, a, b):
    """Whether a pair is to be taken at this signature."""
    differ = a.bitwiseXOR(b)
    low, high = _segment(differ, 0), _segment(differ, 1)
    variant = F.shiftrightunsigned(signature, SEGMENT).cast("int")
    in_low = F.bit_count(low) <= 1
    # x - 1 has as many ones as the place of the only one in x.
    place = F.when(in_low, F.when(low == 0, 0).otherwise(F.bit_count(low - 1))).otherwise(
        F.when(high == 0, 0).otherwise(F.bit_count(high - 1)) + SEGMENT)
    return variant == place


def _pairs(index):
    a, b = index.alias("a"), index.alias("b")
    fa, fb = F.col("a.fp"), F.col("b.fp")
    near = (F.bit_count(fa.bitwiseXOR(fb)) <= DISTANCE) & _canonical(F.col("a.signature"), fa, fb)
    return a.join(b, (F.col("a.signature") == F.col("b.signature")) & (fa < fb) & near).select(
        fa.alias("a"), fb.alias("b"))


def _crowd_links(crowded):
    """Links among fingerprints of crowded signatures, over points near them."""
    flips = [np.int64(0)] + [np.uint64(1 << i).astype(np.int64) for i in range(64)]
    double = [np.uint64((1 << i) | (1 << j)).astype(np.int64) for i in range(64) for j in range(i)]

    def run(batches):
        masks = np.asarray(flips + double)
        inner = np.arange(len(masks)) < len(flips)
        for batch in batches:
            for fp in batch.column(0).to_numpy():
                yield pa.RecordBatch.from_arrays([pa.array(fp ^ masks), pa.array(np.full(len(masks), fp)), pa.array(inner)],
                                                 ["point", "fp", "inner"])

    points = with_package(crowded).mapInArrow(run, "point long, fp long, inner boolean")
    hubs = points.groupBy("point").agg(F.min(F.when(F.col("inner"), F.col("fp"))).alias("hub"),
                                       F.count("*").alias("n")).filter("hub IS NOT NULL AND n > 1").drop("n")
    return points.join(hubs, "point").filter("fp <> hub").select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct()


def links(distinct, crowd=CROWD):
    """Edges (a, b) whose components are those of all pairs of ``distinct`` (fp) within
    three bits; each edge is such a pair."""
    index = stored(signatures(distinct), "signatures")
    crowds = stored(index.groupBy("signature").agg(F.count("*").alias("n")).filter(F.col("n") > crowd), "crowds")
    if not crowds.limit(1).count():
        return _pairs(index)
    few = index.join(crowds, "signature", "left_anti")
    many = index.join(crowds, "signature", "left_semi").select("fp").distinct()
    return _pairs(few).unionByName(_crowd_links(many))


def near_duplicates(docs, words=WORDS, crowd=CROWD, text="text"):
    """doc_id, fp, component_id: one row per document."""
    slim = stored(fingerprints(docs, words, text), "fingerprints")
    classes = slim.groupBy("fp").agg(F.min("doc_id").alias("first"))
    classes = stored(classes, "fingerprint-classes")
    roots = stored(components(links(classes.select("fp"), crowd)), "roots")
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = stored(rooted.join(least, "root").select("fp", "component_id"), "component-ids")
    return slim.join(ids, "fp").select("doc_id", "fp", "component_id")


def _first_row():
    """Of a group: its row with the smallest doc_id, without any the one with the smallest text hash."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))


def _keep_firsts(docs, slim, classes, roots, text):
    """Rows of ``docs`` without all but the first of each component; of rows with equal doc_id and text one stays.

    ``slim`` has doc_id, text_hash and node of each row, ``classes`` the first row (keep) and the rows of each
    node, ``roots`` the root of every node that has a link.
    """
    firsts = classes.select("node", "keep", "rows")
    rooted = firsts.join(roots, "node", "left").select("node", "keep", "rows", F.coalesce("root", "node").alias("root"))
    keeps = rooted.groupBy("root").agg(F.min("keep").alias("best"), F.sum("rows").alias("rows")).filter("rows > 1")
    keepers = stored(rooted.select("node", "root").join(keeps, "root").select("node", "best"), "keepers")

    def mark(doc_id, text_hash):
        return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("-")), text_hash.cast("string"))

    same = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_hash") == F.col("best.text_hash"))
    marks = slim.join(keepers, "node").groupBy(mark(F.col("doc_id"), F.col("text_hash")).alias("mark")).agg(
        F.max(same).alias("some"), F.count("*").alias("n")).filter("NOT some OR n > 1")
    marks = stored(marks.select("mark", "some"), "dropped")
    return keep_unmarked(docs, mark(F.col("doc_id"), _text_hash(text)), marks)


def drop_near_duplicates(docs, words=WORDS, crowd=CROWD, text="text"):
    """Of documents whose fingerprints link, the row with the smallest doc_id; columns unchanged.

    Links and components are those of ``near_duplicates``.  In a component without any doc_id the smallest text
    hash stays; of rows with equal doc_id and text one stays.
    """
    slim = stored(fingerprints(docs, words, text, with_text_hash=True).withColumnRenamed("fp", "node"), "fingerprints")
    classes = stored(slim.groupBy("node").agg(_first_row().alias("keep"), F.count("*").alias("rows")), "fingerprint-classes")
    roots = stored(components(links(classes.select(F.col("node").alias("fp")), crowd)), "roots")
    return _keep_firsts(docs, slim, classes, roots, text)


def hex_digits(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# ------------------------------------------------------------------ similar texts

BITMAP = [f"b{i}" for i in range(8)]
WIDE = "doc_id long, text_hash long, node long, n long, " + ", ".join(f"{c} long" for c in BITMAP) + ", prefix array<long>"
GROUP = 50                 # groups of more texts are linked over hubs before their pairs are made
SAMPLE = 10_000            # documents, about, whose shingles are counted for the order of shingles
COMMON = 100_000           # most shingles that the order puts last
COMMON_FROM = 3            # documents of the sample that a common shingle is in


def shingle_set(text, words=5):
    """Hashes of the different shingles of a text, sorted; a text of fewer words is one shingle."""
    import xxhash

    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    line = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    last = ends[min(words, len(tokens)) - 1:].tolist()
    first = [0, *(ends[:-1] + 1).tolist()][:len(last)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(line[a:b]) for a, b in zip(first, last)), np.uint64, len(last)))


def _prefix(own, common):
    """The shingles of which texts that are similar by 0.8 share one at least.

    Rare shingles come first, by hash; those of ``common`` (sorted hashes and their places) last.
    """
    n = len(own)
    if n and len(common[0]):
        at = np.minimum(np.searchsorted(common[0], own), len(common[0]) - 1)
        known = common[0][at] == own
        if known.any():
            own = own[np.lexsort((own, np.where(known, common[1][at] + 1, 0)))]
    return own[:n - (4 * n + 4) // 5 + 1] if n else own


def _bitmap(own):
    """Parities of the counts in 512 parts: two sets differ in as many elements as bits at least."""
    odd = np.bincount((own >> np.uint64(55)).astype(np.int64), minlength=512) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def _wide(words, common):
    def run(batches):
        import xxhash

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                cut = batch.slice(at, 512)
                sets = [shingle_set(t.as_py(), words) for t in cut.column(2)]
                nodes = np.asarray([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
                bits = np.asarray([_bitmap(s) for s in sets], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [cut.column(0), cut.column(1), pa.array(nodes), pa.array([len(s) for s in sets], pa.int64()),
                     *(pa.array(c) for c in bits.T.copy()),
                     pa.array([_prefix(s, common).view(np.int64) for s in sets], pa.list_(pa.int64()))],
                    ["doc_id", "text_hash", "node", "n", *BITMAP, "prefix"])
    return run


def _packed(batches):
    """Texts, deflated: a tenth of the size of their sets of shingles."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            cut = batch.slice(at, 512)
            packed = [zlib.compress((t.as_py() or "").encode("utf-8", "surrogatepass"), 1) for t in cut.column(1)]
            yield pa.RecordBatch.from_arrays([cut.column(0), pa.array(packed, pa.binary())], ["node", "packed"])


def _agreeing(words):
    """Of pairs (a, b) with their deflated texts, those whose sets of shingles agree by 0.8."""
    def run(batches):
        known = {}   # sets of the texts met last, as a hub comes many times

        def own(node, packed):
            found = known.get(node)
            if found is None:
                if len(known) >= 64:
                    known.clear()
                text = zlib.decompress(packed.as_py()).decode("utf-8", "surrogatepass")
                found = known[node] = shingle_set(text, words)
            return found

        for batch in batches:
            a, b, keep = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for i in range(batch.num_rows):
                x, y = own(a[i], batch.column(2)[i]), own(b[i], batch.column(3)[i])
                keep.append(9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * (len(x) + len(y)))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])
    return run


def _sets(words):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                cut = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays(
                    [cut.column(0), pa.array([shingle_set(t.as_py(), words).view(np.int64) for t in cut.column(1)],
                                             pa.list_(pa.int64()))], ["node", "shingles"])
    return run


def common_shingles(columns, words, sample=SAMPLE, most=COMMON):
    """Sorted hashes of shingles that many documents hold, and their places by count.

    They only order the shingles, so pairs don't depend on the sample; its documents and ``most`` bound them.
    """
    rows = columns.count()
    some = columns if rows <= sample else columns.sample(sample / rows, seed=SEED)
    counted = (some.select(F.lit(0).cast("long").alias("node"), "text").mapInArrow(_sets(words), "node long, shingles array<long>")
               .select(F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n"))
               .filter(F.col("n") >= COMMON_FROM).orderBy(F.col("n").desc(), "shingle").limit(most).toArrow())
    hashes = counted.column("shingle").to_numpy().astype(np.int64).view(np.uint64)
    counts = counted.column("n").to_numpy().astype(np.int64)
    order = np.argsort(hashes)
    places = np.empty(len(hashes), np.int64)
    places[np.lexsort((hashes, counts))] = np.arange(len(hashes))
    return hashes[order], places[order]


def _may_be_similar(x, y):
    """What similarity 0.8 takes, by sizes and bitmaps: no similar pair is lost."""
    bits = F.lit(0)
    for c in BITMAP:
        bits = bits + F.bit_count(F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}")))
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    return (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & (9 * bits <= n + m)


def _pairs_inside(members, also=None):
    x, y = members.alias("x"), members.alias("y")
    on = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.node") < F.col("y.node")) & _may_be_similar("x", "y")
    return x.join(y, on if also is None else on & also).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def _pairs_with_hubs(members, order):
    """Each member of a group with the one that is last in ``order``, if their labels differ."""
    hubs = members.groupBy("shingle").agg(F.max_by(F.struct("node", "n", *BITMAP, "label"), order).alias("hub"))
    hubs = hubs.select("shingle", "hub.*")
    on = ((F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.node") != F.col("y.node"))
          & (F.col("x.label") != F.col("y.label")) & _may_be_similar("x", "y"))
    return members.alias("x").join(hubs.alias("y"), on).select(
        F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def _similar(pairs, texts, words):
    """Those pairs whose sets agree by 0.8, counted.  Deflated texts travel to the pairs; their sets are made there."""
    both = (pairs.join(texts.select(F.col("node").alias("a"), F.col("packed").alias("own")), "a")
            .join(texts.select(F.col("node").alias("b"), F.col("packed").alias("other")), "b"))
    return with_package(both).select("a", "b", "own", "other").mapInArrow(_agreeing(words), "a long, b long")


def _maybe_shared(shared):
    def run(batches):
        for batch in batches:
            nodes, lists = batch.column(0).to_numpy(), batch.column(1)
            values = lists.flatten().to_numpy().view(np.uint64)
            rows = np.repeat(np.arange(len(nodes)), np.diff(lists.offsets.to_numpy()))
            keep = np.flatnonzero(may_be_in(shared, values))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[rows[keep]], pa.int64()), pa.array(values[keep].view(np.int64), pa.int64())], ["node", "shingle"])
    return run


def shared_prefixes(wide):
    """node, shingle: of the stored prefixes, the shingles that several sets may share.

    Most shingles stand in one prefix only.  They are counted first, as bare hashes; a filter of
    bounded size lets those that occur more than once pass, and of the others a few.
    """
    counted = wide.select(F.explode("prefix").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n"))
    shared = stored(counted.filter("n > 1").select("shingle"), "shared-shingles")
    bits = filter_bits(shared, bits_for(shared.count()))
    return stored(wide.select("node", "prefix").mapInArrow(_maybe_shared(bits), "node long, shingle long").distinct(), "prefixes")


def similar_edges(classes, index, texts_of, words=5, group=GROUP):
    """Pairs (a, b) of ``classes`` similar by 0.8, whose components are those of all such pairs.

    ``classes`` has node, n and the bitmap of each set, ``index`` node and shingle of the prefixes; ``texts_of`` gives
    node and deflated text for a table of nodes.  Similar sets share a shingle of their prefixes, so each shingle has
    a group; groups of the same texts are one.  Pairs of a group are filtered by size and bitmap and
    verified by their sets.  In groups of more than ``group`` texts each is first compared with
    the one that shares most, then with one by chance in each group; then all pairs
    that aren't yet in one component follow, so nothing is left out.
    """
    shared = index.groupBy("shingle").agg(
        F.count("*").alias("size"), F.bit_xor(F.xxhash64("node")).alias("one"),
        F.bit_xor(F.xxhash64("node", F.lit(1))).alias("two")).filter("size > 1")
    groups = stored(shared.groupBy("size", "one", "two").agg(F.min("shingle").alias("shingle")), "groups")
    members = index.join(groups.select("shingle", "size"), "shingle").join(classes.select("node", "n", *BITMAP), "node")
    members = stored(members.withColumn("label", F.col("node")), "members")
    pairs = _pairs_inside(members.filter(F.col("size") <= group))
    large = members.filter(F.col("size") > group)
    if not large.limit(1).count():
        pairs = stored(pairs, "candidates")
        texts = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        return stored(_similar(pairs, texts, words), "similar")
    weights = large.groupBy("node").agg(F.sum("size").alias("weight"))
    stars = _pairs_with_hubs(large.join(weights, "node"), F.struct("weight", "node"))
    pairs = stored(pairs.unionByName(stars).distinct(), "candidates")
    texts = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(large.select("node")).distinct())
    edges = stored(_similar(pairs, texts, words), "similar")

    def labelled():
        roots = components(edges).withColumnRenamed("root", "_root")
        found = large.join(roots, "node", "left").withColumn("label", F.coalesce("_root", "label")).drop("_root")
        return stored(found, "labelled")

    by_chance = _pairs_with_hubs(labelled(), F.xxhash64("node", "shingle"))
    edges = edges.unionByName(stored(_similar(stored(by_chance, "candidates"), texts, words), "similar"))
    rest = labelled()
    split = rest.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("shingle")
    rest = stored(rest.join(split, "shingle", "left_semi"), "split-groups")
    rest = stored(_pairs_inside(rest, F.col("x.label") != F.col("y.label")), "candidates")
    return edges.unionByName(stored(_similar(rest, texts, words), "similar"))


def keep_one_each(docs, words=5, group=GROUP, text="text"):
    """Of near duplicates by shingles of ``words`` words, the row with the smallest doc_id; columns unchanged.

    Texts are near duplicates if their sets of shingles agree by 0.8 (shared of all) or
    others join them.  In a component without any doc_id the smallest text hash stays; of
    rows with equal doc_id and text one stays.
    """
    columns = with_package(docs).select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash(text).alias("text_hash"), F.col(text).alias("text"))
    wide = stored(columns.mapInArrow(_wide(words, common_shingles(columns, words)), WIDE), "shingle-prefixes")
    slim = wide.select("doc_id", "text_hash", "node")
    # Rows of a class first, inside the tasks; then classes of a component.
    classes = wide.groupBy("node").agg(_first_row().alias("keep"), F.count("*").alias("rows"), *[F.max(c).alias(c) for c in ("n", *BITMAP)])
    classes = stored(classes, "shingle-classes")

    def texts_of(nodes):
        wanted = classes.join(nodes, "node", "left_semi").select("node", F.col("keep.doc_id").alias("_id"), F.col("keep.text_hash").alias("_hash"))
        wanted = stored(wanted, "wanted-sets")
        possible = split_by_keys(columns, F.col("text_hash"), wanted.select("_hash"))[1]
        found = possible.join(wanted, (F.col("text_hash") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_id")))
        packed = found.select("node", "text").mapInArrow(_packed, "node long, packed binary")
        return stored(packed.groupBy("node").agg(F.first("packed").alias("packed")), "packed-texts")

    roots = stored(components(similar_edges(classes, shared_prefixes(wide), texts_of, words, group)), "roots")
    return _keep_firsts(docs, slim, classes, roots, text)
