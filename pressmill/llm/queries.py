"""Registered queries of the operators in this folder, each over its whole table."""

from pyspark.sql import functions as F

from pressmill.llm import (
    collocations, consensus, cotrain, huffman, knn, langid, mixing, packing, quotient, relative, resampling, rollups, simhash)
from pressmill.llm.common import documents, stored
from pressmill.llm.tokens import default_vocabulary


def op1_token_files(spark, sf_dir):
    """Ids of every document, written to coded files and read back from them."""
    path = huffman.token_files(documents(spark, sf_dir), default_vocabulary(), end_id=2)
    return huffman.read_documents(spark, path)


def op2_best_fit_packing(spark, sf_dir):
    """All documents packed into sequences of 2048 ids."""
    return packing.pack_documents(documents(spark, sf_dir), default_vocabulary(), end_id=0, capacity=2048)


def op3_token_rollups(spark, sf_dir):
    """Token counts by source, language and tokenizer version after four batches.

    All documents under the first version; all under the second; documents labelled toxic
    deleted from both; documents of low quality revised to their distinct lines.  The second batch is sent again
    and changes nothing.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rollup = rollups.new_rollup(spark)
    # Texts are counted, whole and revised, where they lie; only ids and counts meet the labels.
    lines = F.array_join(F.array_distinct(F.split("text", "\n")), "\n")
    texts = documents(spark, sf_dir).select("doc_id", "source", "lang", "text", lines.alias("lines"))
    docs = stored(texts.select("doc_id", "source", "lang", *[rollups.n_tokens(t, v).alias(f"{v} {t}") for v in rollups.VERSIONS for t in ("text", "lines")]),
                  "token-counts")

    def changes(rows, op, version, text):
        return rows.select(F.lit(op).alias("op"), "doc_id", "source", "lang", F.lit(version).alias("version"), F.col(f"`{version} {text}`").alias("n_tokens"))

    first, second = (changes(docs, "insert", v, "text") for v in rollups.VERSIONS)
    rollup.apply("first", first)
    rollup.apply("second", second)
    rollup.apply("second", second)
    toxic = labels.filter("toxic = 1").select("doc_id").distinct()
    gone = [changes(docs.join(toxic, "doc_id", "left_semi"), "delete", v, "text") for v in rollups.VERSIONS]
    rollup.apply("toxic", gone[0].unionByName(gone[1]))
    poor = labels.filter("quality = 0 AND toxic = 0").select("doc_id").distinct()
    revised = [changes(docs.join(poor, "doc_id", "left_semi"), "revise", v, "lines") for v in rollups.VERSIONS]
    rollup.apply("distinct lines", revised[0].unionByName(revised[1]))
    return rollup.totals()


def op4_simhash(spark, sf_dir):
    """Fingerprints of all documents and the components of near duplicates."""
    return simhash.near_duplicates(documents(spark, sf_dir), words=3).select(
        "doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op5_language(spark, sf_dir):
    """The language of every document."""
    docs = documents(spark, sf_dir)
    return langid.predict(docs, *langid.fit(docs))


def op6_quality(spark, sf_dir):
    """The quality of every document."""
    docs = documents(spark, sf_dir)
    return cotrain.score(docs, cotrain.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op7_top_k(spark, sf_dir):
    """The 20 largest inner products of every twentieth vector with all others."""
    return knn.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=20, scale=64, every=20)


def op8_mixing(spark, sf_dir):
    """How many words of every document the mix of sources takes."""
    return mixing.mixed_sizes(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op9_exact_dedup(spark, sf_dir):
    """Groups of documents with equal text."""
    return quotient.find_duplicates(documents(spark, sf_dir))


def op10_main_text(spark, sf_dir):
    """The main text of every page."""
    return consensus.main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op11_resampling(spark, sf_dir):
    """Documents drawn by how much they resemble the benchmark texts."""
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return resampling.resample(documents(spark, sf_dir), target).select("doc_id", "n_features", "weight", "score", "rank")


def op12_collocations(spark, sf_dir):
    """The best phrases of every language."""
    return collocations.collocations(documents(spark, sf_dir))


def op13_substring_dedup(spark, sf_dir):
    """What is left of all documents without passages of 20 words that occurred before."""
    return relative.remove_repeats(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (
    op1_token_files, op2_best_fit_packing, op3_token_rollups, op4_simhash, op5_language, op6_quality, op7_top_k,
    op8_mixing, op9_exact_dedup, op10_main_text, op11_resampling, op12_collocations, op13_substring_dedup)}

_SPACE = "[\\x20\\x09-\\x0D]+"
_V2 = "\\p{L}+|\\p{N}|[^\\x20\\x09-\\x0D\\p{L}\\p{N}]+"

ORACLES = {
    "op3_token_rollups": f"""
WITH toxic AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1),
poor AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0 AND toxic = 0),
kept AS (
  SELECT source, lang, CASE WHEN doc_id IN (SELECT doc_id FROM poor)
      THEN array_to_string(list_distinct(string_split(text, chr(10))), chr(10)) ELSE text END AS text
  FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM toxic)),
counted AS (
  SELECT source, lang, 'words-1' AS version, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n FROM kept
  UNION ALL
  SELECT source, lang, 'words-2', len(regexp_extract_all(coalesce(text, ''), '{_V2}')) FROM kept)
SELECT source, lang, version, count(*) AS docs, sum(n)::BIGINT AS tokens FROM counted GROUP BY ALL""",
    "op9_exact_dedup": f"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{_SPACE}', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)""",
    "op7_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x::DOUBLE[], c.x::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op12_collocations": """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
runs AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM w, (SELECT unnest([1, 2, 3, 4]) AS k)),
f AS (SELECT lang, k AS words, phrase, count(*) AS f FROM runs GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE words = 1 GROUP BY lang),
cand AS (SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE words > 1 AND f >= 30),
cuts AS (SELECT lang, phrase, a, w, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail
  FROM cand, (SELECT unnest([1, 2, 3]) AS k) WHERE k < words),
cost AS (SELECT c.lang, c.phrase, c.a, k, h.f AS l, t.f AS r, (2000000::HUGEINT * c.a // (h.f + t.f))::BIGINT AS score
  FROM cuts c JOIN f h ON h.lang = c.lang AND h.phrase = c.head JOIN f t ON t.lang = c.lang AND t.phrase = c.tail),
best AS (SELECT * FROM cost QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM cand g WHERE g.lang = b.lang AND len(g.w) > len(string_split(b.phrase, ' '))
  AND contains(' ' || g.phrase || ' ', ' ' || b.phrase || ' ') AND 100 * g.a >= 80 * b.a)),
ranked AS (SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
  FROM kept JOIN total ON total.lang = kept.lang)
SELECT * FROM ranked WHERE rank <= 2000""",
    "op13_substring_dedup": """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, unnest(list_transform(range(1, len(w) - 18), lambda i: array_to_string(w[i:i + 19], ' '))) AS s FROM w),
later AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
gone AS (SELECT doc_id, list_sort(list_distinct(flatten(list(range(i, i + 20))))) AS g FROM later GROUP BY doc_id),
left_over AS (SELECT w.doc_id, len(w) AS n_words, coalesce(len(g), 0) AS n_removed,
  CASE WHEN g IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(g, x[2])), lambda x: x[1]) END AS kept
  FROM w LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM left_over""",
}
