"""Six-part quality score of articles.

Everything is counted on the text as it stands: no intermediate copies of it are built
except where code blocks have to be left out.
"""

from pyspark.sql import functions as F

from pressmill import fixed_values as fv
from pressmill.functions.matching import column_contains, contains_one_of, count_present, with_cjk_flag
from pressmill.functions.text import CJK, SPACE, WORD, WORD_END, WORD_START, strip, text_of

CODE_BLOCK = r"```[\s\S]*?```"
INLINE_CODE = r"`[^`]+`"
SENTENCE_MARKS = ".!?。！？"
IMAGE = r"!\[[^\n]*?\]\([^\n]*?\)"
LINK = r"\[[^\n]*?\]\([^\n]*?\)"


def _count(text, pattern, needs=None):
    """Occurrences of a pattern that is never empty; a literal it needs is looked for first.

    They are counted as the cuts of a split: Spark's count first makes a list of all matches,
    with a copy of the matcher for each.
    """
    n = F.size(F.split(text, pattern)) - 1
    return n if needs is None else F.when(F.contains(text, F.lit(needs)), n).otherwise(0)


def _prepared(df):
    """Add the texts that several metrics read."""
    df = df.withColumn("_body", F.coalesce(F.col("content"), F.lit("")))
    df = df.withColumn("_lower", F.lower(text_of())).withColumn("_ticks", F.contains("_body", F.lit("`")))
    df = with_cjk_flag(df, "_lower")
    body, ticks = F.col("_body"), F.col("_ticks")
    no_code = F.regexp_replace(F.regexp_replace(body, CODE_BLOCK, ""), INLINE_CODE, "")
    return df.withColumns({
        "_plain": F.when(ticks, no_code).otherwise(body),
        "_len": F.length(body),
        "_blocks": F.when(ticks, F.regexp_count(body, F.lit(CODE_BLOCK))).otherwise(0),
        "_inline": F.when(ticks, F.regexp_count(body, F.lit(INLINE_CODE))).otherwise(0),
    })


def stripped_sentences(text):
    """Pieces between sentence marks without surrounding white space; some are empty."""
    return F.transform(F.split(text, f"[{SENTENCE_MARKS}]"), strip)


def _tokens(text):
    """Number of stretches without white space: each becomes one character, with the space around it."""
    runs = F.length(F.regexp_replace(text, f"[{SPACE}]*+[^{SPACE}]++[{SPACE}]*+", "x"))
    return F.when(text.rlike(f"[^{SPACE}]"), runs).otherwise(0)


def with_readability(df):
    """0.7 sentence band + 0.3 paragraph band.

    A sentence is a stretch between ASCII ``. ! ?`` that holds a letter, digit or one of
    ``_ , ; :``.  (The full-width marks count as special characters, which separate
    nothing.)  Its words are CJK letters plus runs of Latin letters.
    """
    plain, body = F.col("_plain"), F.col("_body")
    df = df.withColumns({
        "_sentences": _count(plain, rf"[{WORD},;:][^.!?]*"),
        "_words": _count(plain, f"(?=[a-zA-Z]){WORD_START}[a-zA-Z]++{WORD_END}")
        + F.when(F.col("_cjk"), _count(plain, f"[{CJK}]")).otherwise(0),
        # A new paragraph begins behind every white space that holds an empty line.
        "_paragraphs": F.lit(1) + F.when(
            F.contains(body, F.lit("\n\n")),
            F.regexp_count(F.regexp_replace(body, rf"^[{SPACE}]+", ""), F.lit(rf"\n\n[{SPACE}]*[^{SPACE}]"))).otherwise(0),
    })
    mean = F.col("_words") / F.col("_sentences")
    band = (F.when(mean.between(10, 25), 1.0).when(mean.between(5, 35), 0.8)
            .when(mean <= 50, 0.6).otherwise(0.4))
    size = F.col("_len") / F.col("_paragraphs")
    spread = (F.when(F.col("_paragraphs") <= 1, 0.5).when(size.between(200, 800), 1.0)
              .when(size.between(100, 1200), 0.8).otherwise(0.6))
    score = band * 0.7 + spread * 0.3
    return df.withColumn("readability", F.when((F.col("_len") == 0) | (F.col("_sentences") == 0), 0.0)
                         .otherwise(score)).drop("_sentences", "_words", "_paragraphs")


def with_technical_depth(df):
    """Indicators in three strengths, code and density, at most 1."""
    text = F.col("_lower")
    df = df.withColumns({f"_{level}": count_present("_lower", needles, "_cjk")
                         for level, needles in fv.TECH_DEPTH.items()})
    much = (F.col("_blocks") > 5) | (F.col("_inline") > 20)
    some = ~much & ((F.col("_blocks") > 2) | (F.col("_inline") > 10))
    df = df.withColumns({
        "_high": F.col("_high") + F.when(much, 2).otherwise(0),
        "_medium": F.col("_medium") + F.when(some, 1).otherwise(0),
        "_tokens": _tokens(text),
    })
    points = F.col("_high") * 3 + F.col("_medium") * 2 + F.col("_low")
    density = F.when(F.col("_tokens") > 0, points / F.col("_tokens")).otherwise(0.0)
    # A dense text gains one indicator of the upper (3 points) or middle strength (2).
    total = points + F.when(density > 0.1, 3).when(density > 0.05, 2).otherwise(0)
    return df.withColumn("technical_depth", F.least(total / 10, F.lit(1.0))).drop(
        "_high", "_medium", "_low", "_tokens")


def with_originality(df):
    """1 minus reprint markers, repeated sentences and many links, at least 0."""
    body = F.col("_body")
    df = df.withColumns({
        "_long": F.filter(stripped_sentences(body), lambda s: F.length(s) > 10),
        "_markers": count_present("_body", fv.NON_ORIGINAL_MARKERS, "_cjk"),
        "_links": _count(body, rf"https?://[^{SPACE}]+", "://"),
    })
    n = F.size("_long")
    repeated = F.when(n > 1, (F.lit(1) - F.size(F.array_distinct("_long")) / n) * 0.3).otherwise(0.0)
    score = F.lit(1.0) - F.col("_markers") * F.lit(0.2) - repeated - F.when(F.col("_links") > 10, 0.2).otherwise(0.0)
    return df.withColumn("originality", F.when(F.col("_len") == 0, 0.0).otherwise(F.greatest(score, F.lit(0.0)))).drop(
        "_long", "_markers", "_links")


def with_structure(df):
    """Markdown elements per 1000 characters, five of them giving 1 (C4)."""
    body = F.col("_body")
    elements = (
        _count(body, f"#+[{SPACE}]+", "#") * 2
        + _count(body, rf"\p{{Nd}}+\.[{SPACE}]+", ".")
        + _count(body, f"[-*][{SPACE}]+")
        + F.col("_blocks") + F.col("_inline")
        + _count(body, LINK, "](") + _count(body, IMAGE, "]("))
    density = elements / (F.col("_len") / 1000)
    return df.withColumn("structure", F.when(F.col("_len") == 0, 0.0).otherwise(F.least(density / 5, F.lit(1.0))))


def with_engagement(df):
    """Phrases addressed to readers and questions, five giving 1."""
    questions = F.least(_count(F.col("_body"), "[?？]") / 3, F.lit(2.0))
    phrases = count_present("_lower", fv.ENGAGEMENT_PHRASES, "_cjk")
    return df.withColumn("engagement", F.least((phrases + questions) / 5, F.lit(1.0)))


def with_completeness(df):
    """Title, length, conclusion, code and images."""
    body, n = F.col("_body"), F.col("_len")
    # The combined text holds the word whenever the body does, so the body is lowered rarely.
    concludes = column_contains("_lower", fv.CONCLUSION_WORDS, "_cjk") & contains_one_of(
        F.lower(body), fv.CONCLUSION_WORDS)
    has_image = F.contains(body, F.lit("](")) & body.rlike(IMAGE)
    score = F.when(F.length(strip(F.coalesce(F.col("title"), F.lit("")))) > 5, 0.2).otherwise(0.0)
    score = score + F.when(n > 2000, 0.4).when(n > 1000, 0.3).when(n > 500, 0.2).when(n > 100, 0.1).otherwise(0.0)
    for cond, points in ((concludes, 0.2), (F.col("_blocks") > 0, 0.1), (has_image, 0.1)):
        score = score + F.when(cond, points).otherwise(0.0)
    return df.withColumn("completeness", F.least(score, F.lit(1.0)))


METRICS = {
    "readability": with_readability, "technical_depth": with_technical_depth,
    "originality": with_originality, "structure": with_structure,
    "engagement": with_engagement, "completeness": with_completeness,
}
_TEXTS = ["_body", "_lower", "_ticks", "_cjk", "_plain", "_len", "_blocks", "_inline"]


def with_metrics(df, names=tuple(METRICS)):
    """Add some or all of the six metrics."""
    df = _prepared(df)
    for n in names:
        df = METRICS[n](df)
    return df.drop(*_TEXTS)


def grade(score):
    """A from 0.8, B from 0.6, C from 0.4, else D."""
    return F.when(score >= 0.8, "A").when(score >= 0.6, "B").when(score >= 0.4, "C").otherwise("D")


def with_quality(df):
    """Add metrics, overall score, grade, length and reading minutes."""
    df = with_metrics(df)
    overall = None
    for name, weight in fv.QUALITY_WEIGHTS:
        term = F.col(name) * F.lit(weight)
        overall = term if overall is None else overall + term
    df = df.withColumn("overall", overall)
    words = F.length(F.coalesce(F.col("content"), F.lit("")))
    return df.withColumns({
        "grade": grade(F.col("overall")),
        "word_count": words,
        "reading_time": F.greatest(F.lit(1), F.floor(words / 200)).cast("int"),
    })


def key_points(content, n=5):
    """Headings, then list items, then sentences on technology, at most n."""
    headings = F.regexp_extract_all(content, F.lit(rf"#+[{SPACE}]+([^\n]+)"), F.lit(1))
    items = F.regexp_extract_all(
        content, F.lit(rf"(?dm)(?:[-*][{SPACE}]+|^\p{{Nd}}+\.[{SPACE}]+)([^\n]+)"), F.lit(1))
    on_topic = "|".join(fv.KEY_SENTENCE_WORDS)
    sentences = F.filter(stripped_sentences(content), lambda s: (
        (F.length(s) > 20) & (F.length(s) < 200) & F.lower(s).rlike(on_topic)))
    # Few texts hold one of the words; the others aren't cut into sentences.
    sentences = F.when(contains_one_of(F.lower(content), fv.KEY_SENTENCE_WORDS), sentences).otherwise(F.array().cast("array<string>"))
    return F.slice(F.concat(headings, items, sentences), 1, n)


def with_key_points(df, n=5):
    return df.withColumn("key_points", key_points(F.coalesce(F.col("content"), F.lit("")), n))


def suggestions():
    """Advice that follows from the metrics (C11)."""
    rules = [
        (F.col("readability") < 0.6, "readability"),
        (F.col("technical_depth") < 0.5, "technical_depth"),
        (F.col("structure") < 0.5, "structure"),
        (F.col("originality") < 0.7, "originality"),
        (F.col("engagement") < 0.4, "engagement"),
        (F.col("word_count") < 500, "too_short"),
        (F.col("word_count") > 5000, "too_long"),
        (F.col("completeness") < 0.7, "completeness"),
    ]
    return F.array_compact(F.array(*[F.when(cond, F.lit(fv.ADVICE[k])) for cond, k in rules]))


def with_suggestions(scored):
    return scored.withColumn("suggestions", suggestions())


def quality_summary(scored):
    """Grades, mean metrics and rates over all articles (C12): one row."""
    share = {"high_quality_rate": F.col("grade").isin("A", "B"), "needs_improvement_rate": F.col("grade") == "D"}
    return scored.agg(
        F.count("*").alias("total_articles"),
        *[F.count_if(F.col("grade") == g).alias(f"grade_{g.lower()}") for g in "ABCD"],
        *[F.avg(m).alias(f"avg_{m}") for m in ["overall", *METRICS]],
        *[(F.count_if(cond) / F.count("*") * 100).alias(name) for name, cond in share.items()],
        F.avg("word_count").alias("average_word_count"),
        F.avg("reading_time").alias("average_reading_time"))


def quality_listing(articles, limit=50):
    """First articles by id with three key points and the number of suggestions.

    Only these are scored.
    """
    first = with_quality(articles.orderBy("id").limit(limit))
    return with_suggestions(with_key_points(first, 3)).select(
        "id", "grade", "overall", "word_count", "reading_time", "key_points",
        F.size("suggestions").alias("improvement_count"), *METRICS)


def quality_insights(scored, min_score=0.0):
    """What articles from a score upwards have in common (C14): one row.

    The threshold sits inside the aggregates: a filter would be pushed below the score's
    projections and compute every metric a second time.
    """
    kept = F.col("overall") >= min_score
    out = scored.agg(
        F.count_if(kept).alias("sample_count"),
        F.avg(F.when(kept, F.col("word_count"))).alias("average_word_count"),
        F.avg(F.when(kept, (F.col("structure") > 0.7).cast("double"))).alias("structured_share"))
    return out.withColumn("common_patterns", F.array_join(F.array_compact(F.array(
        F.when(F.col("average_word_count") > 1500, F.lit(fv.INSIGHT_LONG)),
        F.when(F.col("structured_share") > 0.6, F.lit(fv.INSIGHT_STRUCTURED)))), "; "))
