"""Rule-based tagging: technology categories, difficulty, content type."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from pressmill import fixed_values as fv
from pressmill.functions import dates
from pressmill.functions.matching import (
    count_present, string_array, with_cjk_flag, with_whole_words)
from pressmill.functions.text import text_of, unicode_words

TAG_TYPE = ("array<struct<name:string,category:string,confidence:double,"
            "frequency:int,related_keywords:array<string>>>")


def _no_strings():
    return F.array().cast("array<string>")


def with_category_hits(df, lexicon=None):
    """Add one array of matched keywords per category (G1).

    ``df`` has ``_lower``.  The text is searched once for the words of all categories;
    a word listed under two categories then counts in both.
    """
    lexicon = lexicon or fv.TAG_LEXICON
    every = list(dict.fromkeys(k for _, keys in lexicon.values() for k in keys))
    df = with_whole_words(df, "_lower", every, "_found")
    hits = {f"hits_{name}": F.array_intersect(string_array(keys), F.col("_found"))
            for name, (_, keys) in lexicon.items()}
    return df.withColumns(hits).drop("_found")


def _repeated_sum(weight, n):
    """0, w, w+w, ...: scores are sums of equal weights, added one by one."""
    sums = [0.0]
    for _ in range(n):
        sums.append(sums[-1] + weight)
    return sums


def category_score(name, lexicon=None):
    """Sum of the weights of a category's hits."""
    weight, keys = (lexicon or fv.TAG_LEXICON)[name]
    sums = F.expr("array(" + ", ".join(f"{v!r}D" for v in _repeated_sum(weight, len(keys))) + ")")
    return F.get(sums, F.size(f"hits_{name}"))


def _level_score(level, text):
    """One per substring, two per pattern that occurs."""
    needles, patterns = fv.DIFFICULTY[level]
    score = count_present("_lower", needles, "_cjk")
    for pattern in patterns:
        first = pattern.split("\\s")[0]
        hit = F.contains(text, F.lit(first)) & text.rlike(unicode_words(pattern))
        score = score + hit.cast("int") * 2
    return score


def with_tag_features(df, lexicon=None):
    """Add the columns that every tagging result is made of.

    hits and scores per category, difficulty and content type with confidence.
    """
    lexicon = lexicon or fv.TAG_LEXICON
    df = df.withColumn("_lower", F.lower(text_of()))
    df = with_category_hits(with_cjk_flag(df, "_lower"), lexicon)
    text = F.col("_lower")
    df = df.withColumns({
        **{f"score_{c}": category_score(c, lexicon) for c in lexicon},
        **{f"_level_{n}": _level_score(n, text) for n in fv.DIFFICULTY},
        **{f"_type_{n}": count_present("_lower", k, "_cjk") for n, k in fv.CONTENT_TYPES.items()},
    })
    df = with_difficulty(df, lexicon)
    return with_content_type(df).drop("_lower", "_cjk")


def _argmax(names, column):
    """First name, in declaration order, whose column is the greatest."""
    best = F.greatest(*[column(n) for n in names])
    out = None
    for n in names:
        hit = column(n) == best
        out = F.when(hit, F.lit(n)) if out is None else out.when(hit, F.lit(n))
    return out, best


def with_difficulty(df, lexicon):
    """Difficulty with confidence (G3): indicators, text length and number of tech words."""
    length = F.length(F.coalesce(F.col("content"), F.lit("")))
    tech = sum((F.size(f"hits_{c}") for c in lexicon), F.lit(0))
    bump = {
        "beginner": (length <= 2000).cast("int"),
        "intermediate": ((length > 2000) & (length <= 5000)).cast("int")
        + ((tech > 5) & (tech <= 10)).cast("int"),
        "expert": (length > 5000).cast("int") + (tech > 10).cast("int"),
    }
    df = df.withColumns({f"_level_{n}": F.col(f"_level_{n}") + b for n, b in bump.items()})
    level, best = _argmax(list(bump), lambda n: F.col(f"_level_{n}"))
    total = sum((F.col(f"_level_{n}") for n in bump), F.lit(0))
    return df.withColumns({"difficulty": level, "difficulty_confidence": best / total}).drop(
        *[f"_level_{n}" for n in bump])


def with_content_type(df):
    """Content type with confidence (G4); ``article`` when nothing indicates a type."""
    names = list(fv.CONTENT_TYPES)
    kind, best = _argmax(names, lambda n: F.col(f"_type_{n}"))
    total = sum((F.col(f"_type_{n}") for n in names), F.lit(0))
    return df.withColumns({
        "content_type": F.when(total == 0, F.lit("article")).otherwise(kind),
        "type_confidence": F.when(total == 0, F.lit(0.5)).otherwise(best / total),
    }).drop(*[f"_type_{n}" for n in names])


def with_tags(df, lexicon=None):
    """Add the tagging result of every article.

    ``tags`` (technology tags in category order, then difficulty, then content type),
    ``main_category``, ``tech_stack`` and ``tag_confidence``.
    """
    lexicon = lexicon or fv.TAG_LEXICON
    df = with_tag_features(df, lexicon)

    def tag(name, group, confidence, frequency, keywords):
        return F.struct(name.alias("name"), F.lit(group).alias("category"),
                        confidence.alias("confidence"), frequency.cast("int").alias("frequency"),
                        keywords.alias("related_keywords"))

    tech_tags = [
        F.when(F.size(f"hits_{c}") > 0, F.array(tag(
            F.lit(c), fv.TAG_GROUP_TECH, F.least(F.col(f"score_{c}") / 5, F.lit(1.0)),
            F.floor(f"score_{c}"), F.slice(f"hits_{c}", 1, 5))))
        .otherwise(F.array().cast(TAG_TYPE)) for c in lexicon]
    rest = F.array(
        tag(F.col("difficulty"), fv.TAG_GROUP_DIFFICULTY, F.col("difficulty_confidence"), F.lit(1), _no_strings()),
        tag(F.col("content_type"), fv.TAG_GROUP_TYPE, F.col("type_confidence"), F.lit(1), _no_strings()))
    main, best = _argmax(list(lexicon), lambda c: F.col(f"score_{c}"))
    stack = F.slice(F.array_distinct(F.concat(*[F.slice(f"hits_{c}", 1, 3) for c in lexicon])), 1, 5)
    # Mean of the confidences, added in tag order.
    total, count = F.lit(0.0), F.lit(2)
    for c in lexicon:
        total = total + F.when(F.size(f"hits_{c}") > 0, F.least(F.col(f"score_{c}") / 5, F.lit(1.0))).otherwise(0.0)
        count = count + (F.size(f"hits_{c}") > 0).cast("int")
    overall = (total + F.col("difficulty_confidence") + F.col("type_confidence")) / count
    return df.withColumns({
        "main_category": F.when(best > 0, main).otherwise("general"),
        "tech_stack": stack,
        "tag_confidence": overall,
        "tags": F.concat(*tech_tags, rest),
    })


def tag_rows(tagged):
    """One row per article and tag.

    Every article has tags, so the outer form gives the same rows; the inner form would
    make Spark test the size of ``tags`` below the projections and compute them twice.
    """
    return tagged.select("id", "publish_time", F.explode_outer("tags").alias("t")).select(
        "id", "publish_time", "t.*")


def tag_statistics(tagged, n=10):
    """Most frequent tags of each tag group (G9).  The tag vocabulary is fixed and small."""
    counts = tag_rows(tagged).groupBy("category", "name").agg(F.count("*").alias("cnt"))
    w = Window.partitionBy("category").orderBy(F.desc("cnt"), "name")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def tag_preview(articles, limit=50, lexicon=None):
    """Tagging results of the first articles by id (G9); only these are tagged."""
    return with_tags(articles.orderBy("id").limit(limit), lexicon).select(
        "id", "main_category", "difficulty", "tech_stack",
        F.bround("tag_confidence", 3).alias("tag_confidence"), "tags")


def recommend(texts, text="content", lexicon=None, threshold=0.3):
    """Tags worth giving to new texts, as ``name (group)``.

    ``texts`` has ``id`` and the text; its first 100 characters stand in for a title.
    """
    articles = texts.select("id", F.left(F.col(text), F.lit(100)).alias("title"),
                            F.col(text).alias("content"), F.lit(None).cast("timestamp_ntz").alias("publish_time"))
    return (tag_rows(with_tags(articles, lexicon)).filter(F.col("confidence") > threshold)
            .select("id", F.format_string("%s (%s)", "name", "category").alias("recommendation")))


def tag_trends(tagged, n=10):
    """Most frequent tags per group among dated articles, with their share."""
    counts = (tag_rows(tagged.filter("publish_time IS NOT NULL"))
              .groupBy("category", "name").agg(F.count("*").alias("cnt")))
    group = Window.partitionBy("category")
    return (counts.withColumn("percentage", F.col("cnt") / F.sum("cnt").over(group) * 100)
            .withColumn("rank", F.row_number().over(group.orderBy(F.desc("cnt"), "name")))
            .filter(F.col("rank") <= n))


def daily_tags(tagged):
    """Dated articles per day and ``group:tag``."""
    return (tag_rows(tagged.filter("publish_time IS NOT NULL"))
            .groupBy(dates.day("publish_time").alias("day"),
                     F.concat_ws(":", "category", "name").alias("tag"))
            .agg(F.count("*").alias("cnt")))


def tag_trend_summary(tagged):
    """Largest tag group, number of different tags, tags per article.

    Undated articles count as articles but their tags do not.  Groups of the same size
    are taken in the order in which articles list them.
    """
    dated = F.col("publish_time").isNotNull()
    rows = tagged.select(
        F.explode(F.when(dated, F.transform("tags", lambda t: F.struct(t["category"], t["name"])))
                  .otherwise(F.array().cast("array<struct<category:string,name:string>>"))).alias("t"))
    sizes = rows.groupBy("t.category", "t.name").agg(F.count("*").alias("cnt"))
    order = {g: -i for i, g in enumerate([fv.TAG_GROUP_TECH, fv.TAG_GROUP_DIFFICULTY, fv.TAG_GROUP_TYPE])}
    rank = F.coalesce(*[F.when(F.col("category") == g, F.lit(i)) for g, i in order.items()])
    groups = sizes.groupBy("category").agg(
        F.sum("cnt").alias("cnt"), F.count("*").alias("different")).withColumn("_rank", rank)
    total = tagged.agg(F.count("*").alias("n")).scalar()
    return groups.agg(
        F.coalesce(F.max_by("category", F.struct("cnt", "_rank")), F.lit(fv.NO_CATEGORY)).alias("most_popular_category"),
        F.coalesce(F.sum("different"), F.lit(0)).alias("total_unique_tags"),
        F.coalesce(F.sum("cnt"), F.lit(0)).alias("_all"),
    ).select("most_popular_category", "total_unique_tags", (F.col("_all") / total).alias("average_tags_per_article"))


