"""Dumps derived from ``documents``: damaged fields in the manner of real exports.

One SQL text serves Spark and DuckDB.
"""

N = "CAST(doc_id AS STRING)"
HEAD = "substr(split_part(text, chr(10), 1), 1, 60)"
NL = "chr(10)"

DUMP_COLUMNS = f"""
doc_id AS id,
CASE WHEN doc_id % 19 = 0 THEN '' WHEN doc_id % 29 = 0 THEN ' x ' WHEN doc_id % 10 = 0 THEN 'Web3 极客日报 #' || {N}
  ELSE CASE doc_id % 6 WHEN 0 THEN {HEAD} || ' #' || {N} WHEN 1 THEN '第 ' || {N} || ' 期 ' || {HEAD}
  WHEN 2 THEN {HEAD} || ' Vol. ' || {N} WHEN 3 THEN {HEAD} || ' (' || {N} || ')' WHEN 4 THEN '【' || {N} || '】 ' || {HEAD}
  ELSE {HEAD} END END AS title,
CASE doc_id % 11 WHEN 0 THEN 'htps://example.com/' || {N} WHEN 1 THEN 'example.com/x/' || {N}
  WHEN 2 THEN '中文版：http://example.com/' || {N} WHEN 3 THEN ' see http://example.com/' || {N} || ' https://b.com '
  WHEN 4 THEN 'https://example.com/中文/' || {N} WHEN 5 THEN '' WHEN 6 THEN '/local.path/' || {N}
  WHEN 7 THEN 'note:http://example.com:80/' || {N} WHEN 8 THEN 'hu.baittps://example.com/' || {N}
  ELSE 'https://example.com/a/' || CAST(doc_id - doc_id % 40 AS STRING) END AS url,
CASE WHEN doc_id % 23 = 0 THEN NULL WHEN doc_id % 31 = 0 THEN '  ' ELSE source END AS author,
CASE WHEN doc_id % 3 = 0 THEN '#' || CAST(doc_id % 50 AS STRING) ELSE '' END AS episode,
CASE doc_id % 7 WHEN 0 THEN '2024-1-5' WHEN 1 THEN '2024-01-' || CAST(10 + doc_id % 20 AS STRING) || ' 10:20:30' WHEN 2 THEN '2023/12/5'
  WHEN 3 THEN '2022年1月5日' WHEN 4 THEN '' WHEN 5 THEN 'soon' ELSE '2021-03-04' END AS time,
CASE doc_id % 4 WHEN 0 THEN text || {NL} || '点击下方' || {NL} || '阅读原文，查看更多' || {NL} || '====='
  WHEN 1 THEN '长按图片识别二维码关注' || {NL} || {NL} || {NL} || text || {NL} || '来源：https://example.org/x y'
  WHEN 2 THEN text || {NL} || ' ' || {NL} || ' ' || {NL} || '-_-' || {NL} || {NL} || {NL} || 'end ' ELSE text END AS content
"""

# A digest: sentences become the introductions of numbered items.
DIGEST_COLUMNS = f"""
doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN '极客日报 #' || {N} ELSE {HEAD} END AS title,
'https://example.com/' || {N} AS url, source AS author,
CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN '2024-1-5 10:20:30' ELSE '2022年1月5日' END AS time,
CASE WHEN doc_id % 4 = 0 THEN text ELSE '1. Opening by Ann' || {NL} || replace(text, '. ',
  '.' || {NL} || ' 2、 Middle part （Bob）' || {NL} || {NL} || 'https://example.com/i' || {NL} || '3.Third item' || {NL}) END AS content
"""

# A collection: every sentence is followed by a link and a signed remark.
COLLECTION_COLUMNS = f"""
doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN {HEAD} ELSE 'Web3 极客日报' END AS title,
'https://example.com/' || {N} AS url, source AS author,
replace(replace(text, '. ', '.' || {NL} || 'Read https://example.com/' || {N} || ' now' || {NL} || 'Ann: '),
  'er ', 'er' || {NL} || 'https://example.org/y' || {NL}) AS content
"""


def documents(spark, sf_dir):
    from pressmill.sources.articles import dealt

    return dealt(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")


def _select(df, columns):
    df.createOrReplaceTempView("_dump_source")
    return df.sparkSession.sql(f"SELECT {columns} FROM _dump_source")


def raw_dump(spark, sf_dir):
    return _select(documents(spark, sf_dir), DUMP_COLUMNS)


def digests(spark, sf_dir):
    return _select(documents(spark, sf_dir), DIGEST_COLUMNS)


def collections(spark, sf_dir):
    return _select(documents(spark, sf_dir), COLLECTION_COLUMNS)


DUMP_SQL = f"raw_dump AS (SELECT {DUMP_COLUMNS} FROM documents)"
DIGEST_SQL = f"digests AS (SELECT {DIGEST_COLUMNS} FROM documents)"
COLLECTION_SQL = f"collections AS (SELECT {COLLECTION_COLUMNS} FROM documents)"
