"""Registered queries: tagging and quality."""

from pyspark.sql import functions as F

from pressmill import fixed_values as fv
from pressmill.functions.text import SPACE, WORD
from pressmill.operators import quality, tags
from pressmill.plans.common import (
    AS_OF, IN_WINDOW, PROBE_LEXICON, articles, day_sql, hits_sql, present_sql, quote, sql_list, strip_sql,
    with_articles)
from pressmill.sources.articles import crawled_within

QUERIES, ORACLES = {}, {}


def register(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


WHERE30 = IN_WINDOW.format(days=30)
TEXT = "lower(title || ' ' || content)"

# ------------------------------------------------------------------ tagging


def level_sql(level):
    needles, patterns = fv.DIFFICULTY[level]
    def spelled(pattern):
        return pattern.replace(r"\s", f"[{SPACE}]").replace(r"\w", f"[{WORD}]")
    patterns = " + ".join(f"2 * regexp_matches(lt, {quote(spelled(q))})::INT" for q in patterns)
    return f"{present_sql('lt', needles)} + {patterns}"


def tagging_ctes(lexicon, where="TRUE"):
    """Tagging by lists: hits per category, scores by repeated addition, lists of tags."""
    every = list(dict.fromkeys(k for _, keys in lexicon.values() for k in keys))
    hit_cols = ", ".join(f"list_filter({sql_list(keys)}, lambda k: list_contains(hits, k)) AS hits_{c}"
                         for c, (_, keys) in lexicon.items())

    def score(c):
        weight, keys = lexicon[c]
        sums, total = [], 0.0
        for _ in keys:
            total += weight
            sums.append(repr(total) + "e0")
        return f"CASE WHEN len(hits_{c}) = 0 THEN 0e0 ELSE [{', '.join(sums)}][len(hits_{c})] END AS score_{c}"
    n_tech = " + ".join(f"len(hits_{c})" for c in lexicon)
    bumps = {
        "beginner": "(length(content) <= 2000)::INT",
        "intermediate": f"(length(content) > 2000 AND length(content) <= 5000)::INT + (({n_tech}) > 5 AND ({n_tech}) <= 10)::INT",
        "expert": f"(length(content) > 5000)::INT + (({n_tech}) > 10)::INT",
    }
    levels = ", ".join(f"{level_sql(lv)} + {b} AS lv_{lv}" for lv, b in bumps.items())
    types = ", ".join(f"{present_sql('lt', keys)} AS ty_{t}" for t, keys in fv.CONTENT_TYPES.items())

    def first_max(prefix, names):
        best = f"greatest({', '.join(prefix + n for n in names)})"
        return "CASE " + " ".join(f"WHEN {prefix}{n} = {best} THEN {quote(n)}" for n in names) + " END", best
    level, level_best = first_max("lv_", list(bumps))
    kind, kind_best = first_max("ty_", list(fv.CONTENT_TYPES))
    main, main_best = first_max("score_", list(lexicon))
    level_sum = " + ".join(f"lv_{n}" for n in bumps)
    kind_sum = " + ".join(f"ty_{n}" for n in fv.CONTENT_TYPES)

    def tag(name, group, confidence, frequency, related):
        return (f"{{'name': {name}, 'category': {quote(group)}, 'confidence': {confidence}, "
                f"'frequency': {frequency}, 'related': {related}}}")
    tech = [f"CASE WHEN len(hits_{c}) > 0 THEN " + tag(quote(c), fv.TAG_GROUP_TECH, f"least(score_{c} / 5, 1e0)",
                                                       f"floor(score_{c})::INT", f"hits_{c}[1:5]") + " END" for c in lexicon]
    rest = [tag("difficulty", fv.TAG_GROUP_DIFFICULTY, "difficulty_confidence", "1", "[]::VARCHAR[]"),
            tag("content_type", fv.TAG_GROUP_TYPE, "type_confidence", "1", "[]::VARCHAR[]")]
    stack = "[" + ", ".join(f"hits_{c}[1:3]" for c in lexicon) + "]"
    return [
        f"tg0 AS (SELECT *, {TEXT} AS lt, {hits_sql(TEXT, every)} AS hits FROM articles WHERE {where})",
        f"tg1 AS (SELECT *, {hit_cols} FROM tg0)",
        f"tg2 AS (SELECT *, {', '.join(score(c) for c in lexicon)}, {levels}, {types} FROM tg1)",
        f"tg3 AS (SELECT *, {level} AS difficulty, {level_best} / ({level_sum})::DOUBLE AS difficulty_confidence, "
        f"CASE WHEN {kind_sum} = 0 THEN 'article' ELSE {kind} END AS content_type, "
        f"CASE WHEN {kind_sum} = 0 THEN 0.5e0 ELSE {kind_best} / ({kind_sum})::DOUBLE END AS type_confidence, "
        f"CASE WHEN {main_best} > 0 THEN {main} ELSE 'general' END AS main_category, "
        # keep the first occurrence of every word of the flattened lists
        f"flatten({stack}) AS st FROM tg2)",
        "tagged AS (SELECT *, list_filter(st, lambda x, i: list_position(st, x) = i)[1:5] AS tech_stack, "
        f"list_filter([{', '.join(tech + rest)}], lambda t: t IS NOT NULL) AS tags FROM tg3)",
    ]


TAG_ROWS = "tag_rows AS (SELECT id, publish_time, t.name AS name, t.category AS category, t.confidence AS confidence, t.frequency AS frequency, t.related AS related FROM (SELECT id, publish_time, unnest(tags) AS t FROM tagged))"


def _tagged(s, d, lexicon=None):
    return tags.with_tags(articles(s, d), lexicon)


for label, lexicon in (("", fv.TAG_LEXICON), ("_probe", PROBE_LEXICON)):
    CTES = tagging_ctes(lexicon)
    register(f"g1_category_hits{label}",
             lambda s, d, x=lexicon: _tagged(s, d, x).select("id", *[
                 F.array_join(f"hits_{c}", "|").alias(f"hits_{c}") for c in x]),
             with_articles("SELECT id, " + ", ".join(f"array_to_string(hits_{c}, '|') AS hits_{c}" for c in lexicon) + " FROM tagged", *CTES))
    register(f"g2_category_tags{label}",
             lambda s, d, x=lexicon: tags.tag_rows(_tagged(s, d, x)).filter(F.col("category") == fv.TAG_GROUP_TECH).select(
                 "id", "name", "confidence", "frequency", F.array_join("related_keywords", "|").alias("related")),
             with_articles("SELECT id, name, confidence, frequency, array_to_string(related, '|') AS related FROM tag_rows "
                           f"WHERE category = {quote(fv.TAG_GROUP_TECH)}", *CTES, TAG_ROWS))
    register(f"g5_main_category{label}",
             lambda s, d, x=lexicon: _tagged(s, d, x).select(
                 "id", "main_category", F.array_join("tech_stack", "|").alias("tech_stack"),
                 F.round("tag_confidence", 9).alias("tag_confidence")),
             with_articles("SELECT id, main_category, array_to_string(tech_stack, '|') AS tech_stack, "
                           "round(list_sum(list_transform(tags, lambda t: t.confidence)) / len(tags), 9) AS tag_confidence FROM tagged", *CTES))
    register(f"g9_tag_statistics{label}",
             lambda s, d, x=lexicon: tags.tag_statistics(_tagged(s, d, x)),
             with_articles("SELECT category, name, cnt, rank FROM (SELECT category, name, count(*) AS cnt, row_number() OVER (PARTITION BY category "
                           "ORDER BY count(*) DESC, name) AS rank FROM tag_rows GROUP BY 1, 2) WHERE rank <= 10", *CTES, TAG_ROWS))

CTES = tagging_ctes(fv.TAG_LEXICON)
register("g9_preview",
         lambda s, d: tags.tag_preview(articles(s, d)).select(
             "id", "main_category", "difficulty", F.array_join("tech_stack", "|").alias("tech_stack"),
             F.array_join(F.transform("tags", lambda t: t["name"]), "|").alias("tags")),
         with_articles("SELECT id, main_category, difficulty, array_to_string(tech_stack, '|') AS tech_stack, array_to_string(list_transform(tags, lambda t: t.name), '|') AS tags "
                       "FROM tagged", *tagging_ctes(fv.TAG_LEXICON, "id IN (SELECT id FROM articles ORDER BY id LIMIT 50)")))
register("g3_difficulty",
         lambda s, d: _tagged(s, d).select("id", "difficulty", "difficulty_confidence"),
         with_articles("SELECT id, difficulty, difficulty_confidence FROM tagged", *CTES))
register("g4_content_type",
         lambda s, d: _tagged(s, d).select("id", "content_type", "type_confidence"),
         with_articles("SELECT id, content_type, type_confidence FROM tagged", *CTES))
register("g8_tag_list",
         lambda s, d: tags.tag_rows(_tagged(s, d, PROBE_LEXICON)).select("id", "name", "category", "confidence", "frequency"),
         with_articles("SELECT id, name, category, confidence, frequency FROM tag_rows", *tagging_ctes(PROBE_LEXICON), TAG_ROWS))
RECOMMEND = [c.replace("tg0 AS (SELECT *,", "tg0 AS (SELECT * REPLACE (left(content, 100) AS title),", 1).replace(
    TEXT, "lower(left(content, 100) || ' ' || content)") for c in tagging_ctes(PROBE_LEXICON)]
register("g10_recommendations",
         lambda s, d: tags.recommend(articles(s, d), lexicon=PROBE_LEXICON),
         with_articles("SELECT id, name || ' (' || category || ')' AS recommendation FROM tag_rows WHERE confidence > 0.3e0",
                       *RECOMMEND, TAG_ROWS))
WINDOW = tagging_ctes(PROBE_LEXICON, WHERE30)


def _recent(s, d):
    return tags.with_tags(crawled_within(articles(s, d), AS_OF, 30), PROBE_LEXICON)


DATED = "dated AS (SELECT * FROM tag_rows WHERE publish_time IS NOT NULL)"
register("g11_tag_trends", lambda s, d: tags.tag_trends(_recent(s, d)),
         with_articles("SELECT category, name, cnt, percentage, rank FROM (SELECT category, name, count(*) AS cnt, count(*) / (SELECT count(*) FROM dated e "
                       "WHERE e.category = dated.category)::DOUBLE * 100 AS percentage, row_number() OVER (PARTITION BY category ORDER BY count(*) DESC, name) "
                       "AS rank FROM dated GROUP BY category, name) WHERE rank <= 10", *WINDOW, TAG_ROWS, DATED))
register("g12_daily_tags", lambda s, d: tags.daily_tags(_recent(s, d)),
         with_articles(f"SELECT {day_sql('publish_time')} AS day, category || ':' || name AS tag, count(*) AS cnt FROM dated GROUP BY 1, 2",
                       *WINDOW, TAG_ROWS, DATED))
register("g13_tag_summary", lambda s, d: tags.tag_trend_summary(_recent(s, d)),
         with_articles("SELECT (SELECT category FROM dated GROUP BY 1 ORDER BY count(*) DESC, list_position("
                       f"{sql_list([fv.TAG_GROUP_TECH, fv.TAG_GROUP_DIFFICULTY, fv.TAG_GROUP_TYPE])}, category) LIMIT 1) AS most_popular_category, "
                       "(SELECT count(*) FROM (SELECT DISTINCT category, name FROM dated)) AS total_unique_tags, "
                       "(SELECT count(*) FROM dated) / (SELECT count(*) FROM tagged)::DOUBLE AS average_tags_per_article",
                       *WINDOW, TAG_ROWS, DATED))

# ------------------------------------------------------------------ quality

CODE = "'```[\\s\\S]*?```'"
INLINE = "'`[^`]+`'"
IMAGE = "'!\\[[^\\n]*?\\]\\([^\\n]*?\\)'"
LINK = "'\\[[^\\n]*?\\]\\([^\\n]*?\\)'"


def n_sql(c, pattern):
    return f"len(regexp_extract_all({c}, {pattern}))"


READ_PLAIN = (f"regexp_replace(regexp_replace(regexp_replace(content, {CODE}, '', 'g'), {INLINE}, '', 'g'), "
              f"'[^一-鿿{WORD}{SPACE}.,!?;:]', ' ', 'g')")
QUALITY_CTES = [
    f"q0 AS (SELECT *, {TEXT} AS lt, {READ_PLAIN} AS plain, list_filter(list_transform(string_split_regex(content, '[.!?。！？]'), "
    f"lambda x: {strip_sql('x')}), lambda x: length(x) > 10) AS long_sentences, {n_sql('content', CODE)} AS blocks, {n_sql('content', INLINE)} AS inlines, "
    f"len(list_filter(string_split(content, chr(10) || chr(10)), lambda x: regexp_matches(x, '[^{SPACE}]'))) AS paragraphs FROM articles)",
    f"q1 AS (SELECT *, len(list_filter(string_split_regex(plain, '[.!?。！？]'), lambda x: regexp_matches(x, '[^{SPACE}]'))) AS sentences, "
    f"{n_sql('plain', quote('[一-鿿]'))} + len(list_filter(string_split_regex(plain, '[^{WORD}]+'), lambda x: regexp_full_match(x, '[a-zA-Z]+'))) AS words, "
    f"{present_sql('lt', fv.TECH_DEPTH['high'])} + CASE WHEN blocks > 5 OR inlines > 20 THEN 2 ELSE 0 END AS high, "
    f"{present_sql('lt', fv.TECH_DEPTH['medium'])} + CASE WHEN blocks > 5 OR inlines > 20 THEN 0 WHEN blocks > 2 OR inlines > 10 THEN 1 ELSE 0 END AS medium, "
    f"{present_sql('lt', fv.TECH_DEPTH['low'])} AS low, len(list_filter(string_split_regex(lt, '[{SPACE}]+'), lambda x: x <> '')) AS tokens FROM q0)",
    "q2 AS (SELECT *, words / sentences::DOUBLE AS mean_words, length(content) / paragraphs::DOUBLE AS mean_paragraph, "
    "(high * 3 + medium * 2 + low) / tokens::DOUBLE AS density FROM q1)",
    "q3 AS (SELECT *, CASE WHEN length(content) = 0 OR sentences = 0 THEN 0e0 ELSE CASE WHEN mean_words >= 10 AND mean_words <= 25 THEN 1e0 "
    "WHEN mean_words >= 5 AND mean_words <= 35 THEN 0.8e0 WHEN mean_words <= 50 THEN 0.6e0 ELSE 0.4e0 END * 0.7e0 + "
    "CASE WHEN paragraphs <= 1 THEN 0.5e0 WHEN mean_paragraph >= 200 AND mean_paragraph <= 800 THEN 1e0 "
    "WHEN mean_paragraph >= 100 AND mean_paragraph <= 1200 THEN 0.8e0 ELSE 0.6e0 END * 0.3e0 END AS readability, "
    "least(((high + (density > 0.1e0)::INT) * 3 + (medium + (density > 0.05e0 AND density <= 0.1e0)::INT) * 2 + low) / 10e0, 1e0) AS technical_depth, "
    f"CASE WHEN length(content) = 0 THEN 0e0 ELSE greatest(1e0 - {present_sql('content', fv.NON_ORIGINAL_MARKERS)} * 0.2e0 "
    "- CASE WHEN len(long_sentences) > 1 THEN (1 - len(list_distinct(long_sentences)) / len(long_sentences)::DOUBLE) * 0.3e0 ELSE 0e0 END "
    f"- CASE WHEN {n_sql('content', quote(f'https?://[^{SPACE}]+'))} > 10 THEN 0.2e0 ELSE 0e0 END, 0e0) END AS originality, "
    f"CASE WHEN length(content) = 0 THEN 0e0 ELSE least(({n_sql('content', quote(f'#+[{SPACE}]+'))} * 2 + "
    f"{n_sql('content', quote(f'[0-9]+[.][{SPACE}]+'))} + {n_sql('content', quote(f'[-*][{SPACE}]+'))} + blocks + inlines + "
    f"{n_sql('content', LINK)} + {n_sql('content', IMAGE)}) / (length(content) / 1000e0) / 5, 1e0) END AS structure, "
    f"least(({present_sql('lt', fv.ENGAGEMENT_PHRASES)} + least({n_sql('content', quote('[?？]'))} / 3e0, 2e0)) / 5, 1e0) AS engagement, "
    f"least(CASE WHEN length({strip_sql('title')}) > 5 THEN 0.2e0 ELSE 0e0 END + CASE WHEN length(content) > 2000 THEN 0.4e0 WHEN length(content) > 1000 THEN 0.3e0 "
    "WHEN length(content) > 500 THEN 0.2e0 WHEN length(content) > 100 THEN 0.1e0 ELSE 0e0 END + "
    f"CASE WHEN {present_sql('lower(content)', fv.CONCLUSION_WORDS)} > 0 THEN 0.2e0 ELSE 0e0 END + CASE WHEN blocks > 0 THEN 0.1e0 ELSE 0e0 END + "
    f"CASE WHEN regexp_matches(content, {IMAGE}) THEN 0.1e0 ELSE 0e0 END, 1e0) AS completeness FROM q2)",
    "scored0 AS (SELECT *, " + " + ".join(f"{n} * {w}e0" for n, w in fv.QUALITY_WEIGHTS) + " AS overall, length(content) AS word_count, "
    "greatest(1, length(content) // 200)::INT AS reading_time FROM q3)",
    "scored AS (SELECT *, CASE WHEN overall >= 0.8e0 THEN 'A' WHEN overall >= 0.6e0 THEN 'B' WHEN overall >= 0.4e0 THEN 'C' ELSE 'D' END AS grade FROM scored0)",
]
for number, metric in enumerate(["readability", "technical_depth", "originality", "structure", "engagement", "completeness"], 1):
    register(f"c{number}_{metric}",
             lambda s, d, m=metric: quality.with_metrics(articles(s, d), [m]).select("id", F.round(m, 9).alias(m)),
             with_articles(f"SELECT id, round({metric}, 9) AS {metric} FROM q3", *QUALITY_CTES[:4]))


def _scored(s, d):
    return quality.with_quality(articles(s, d))


register("c7_overall",
         lambda s, d: _scored(s, d).select("id", F.round("overall", 9).alias("overall"), "grade", "word_count", "reading_time"),
         with_articles("SELECT id, round(overall, 9) AS overall, grade, word_count, reading_time FROM scored", *QUALITY_CTES))
HEADS = f"regexp_extract_all(content, '#+[{SPACE}]+([^\\n]+)', 1)"
ITEMS = f"regexp_extract_all(content, '(?m)(?:[-*][{SPACE}]+|^[0-9]+\\.[{SPACE}]+)([^\\n]+)', 1)"
SENTENCES = (f"list_filter(list_transform(string_split_regex(content, '[.!?。！？]'), lambda x: {strip_sql('x')}), "
             f"lambda x: length(x) > 20 AND length(x) < 200 AND {present_sql('lower(x)', fv.KEY_SENTENCE_WORDS)} > 0)")
POINTS = f"list_concat(list_concat({HEADS}, {ITEMS}), {SENTENCES})[1:5]"
register("c10_key_points",
         lambda s, d: quality.with_key_points(articles(s, d)).select("id", F.array_join("key_points", "\n").alias("key_points")),
         with_articles(f"SELECT id, array_to_string({POINTS}, chr(10)) AS key_points FROM articles"))
ADVICE = ("list_filter([" + ", ".join(
    f"CASE WHEN {cond} THEN {quote(fv.ADVICE[k])} END" for cond, k in [
        ("readability < 0.6e0", "readability"), ("technical_depth < 0.5e0", "technical_depth"), ("structure < 0.5e0", "structure"),
        ("originality < 0.7e0", "originality"), ("engagement < 0.4e0", "engagement"), ("word_count < 500", "too_short"),
        ("word_count > 5000", "too_long"), ("completeness < 0.7e0", "completeness")]) + "], lambda x: x IS NOT NULL)")
register("c11_suggestions",
         lambda s, d: quality.with_suggestions(_scored(s, d)).select("id", F.array_join("suggestions", "|").alias("suggestions")),
         with_articles(f"SELECT id, array_to_string({ADVICE}, '|') AS suggestions FROM scored", *QUALITY_CTES))


def rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


QUALITY_SUMMARY_SQL = with_articles("SELECT count(*) AS total_articles, " + ", ".join(f"count(*) FILTER (grade = '{g}') AS grade_{g.lower()}" for g in "ABCD") + ", "
                       + ", ".join(f"round(avg({m}), 6) AS avg_{m}" for m in ["overall", *quality.METRICS]) + ", "
                       "round(count(*) FILTER (grade IN ('A', 'B')) / count(*)::DOUBLE * 100, 6) AS high_quality_rate, "
                       "round(count(*) FILTER (grade = 'D') / count(*)::DOUBLE * 100, 6) AS needs_improvement_rate, "
                       "round(avg(word_count), 6) AS average_word_count, round(avg(reading_time), 6) AS average_reading_time FROM scored", *QUALITY_CTES)
register("c12_quality_summary", lambda s, d: rounded(quality.quality_summary(_scored(s, d))), QUALITY_SUMMARY_SQL)
register("c13_quality_listing",
         lambda s, d: quality.quality_listing(articles(s, d)).select(
             "id", "grade", F.round("overall", 9).alias("overall"), "word_count", "reading_time",
             F.array_join("key_points", "\n").alias("key_points"), "improvement_count"),
         with_articles(f"SELECT id, grade, round(overall, 9) AS overall, word_count, reading_time, array_to_string(({POINTS})[1:3], chr(10)) AS key_points, "
                       f"len({ADVICE}) AS improvement_count FROM scored ORDER BY id LIMIT 50", *QUALITY_CTES))
register("c14_quality_insights",
         lambda s, d: rounded(quality.quality_insights(_scored(s, d), 0.4)),
         with_articles("SELECT count(*) AS sample_count, round(avg(word_count), 6) AS average_word_count, "
                       "round(avg((structure > 0.7e0)::INT), 6) AS structured_share, array_to_string(list_filter(["
                       f"CASE WHEN avg(word_count) > 1500 THEN {quote(fv.INSIGHT_LONG)} END, CASE WHEN avg((structure > 0.7e0)::INT) > 0.6e0 THEN "
                       f"{quote(fv.INSIGHT_STRUCTURED)} END], lambda x: x IS NOT NULL), '; ') AS common_patterns FROM scored WHERE overall >= 0.4e0",
                       *QUALITY_CTES))
