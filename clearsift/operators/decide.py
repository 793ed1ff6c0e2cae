"""The decision table: from features and ranked articles to one level for each document, under any profile of thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Levels, variants and label groups.
STRONG, CAUTION, NOT_FOUND = "kuat", "hati_hati", "tidak_ditemukan"
SIMILAR, SATIRE, CONFLICT, FEATURES_ONLY, REFERENCE = "mirip", "satir", "konflik", "ciri_saja", "rujukan"
REFUTED, CONFLICTING = ("salah", "penipuan"), ("benar", "klarifikasi", "satir")
#: The profile that is shipped, and the older one.
PROFILES = {
    "final": dict(similar=0.85, match=0.88, bypass=0.90, relevance_least=0.40, gap=0.02, combine=True, combine_score=0.86, combine_relevance=0.7, combine_words=4, satire=True, most=3),
    "old": dict(similar=0.85, match=0.88, bypass=0.88, relevance_least=0.40, gap=0.02, combine=False, combine_score=0.86, combine_relevance=0.7, combine_words=4, satire=True, most=3),
}
_EPSILON = 1e-9


def profiles(spark, table: dict[str, dict] | None = None) -> DataFrame:
    """One row for each profile; there are as many as were asked for."""
    table = table or PROFILES
    names = list(next(iter(table.values())))
    kinds = ", ".join(f"{n} {'boolean' if isinstance(v, bool) else 'int' if isinstance(v, int) else 'double'}" for n, v in next(iter(table.values())).items())
    return spark.createDataFrame([(p, *[row[n] for n in names]) for p, row in table.items()], f"profile string, {kinds}")


def is_strong_match(score: Column, relevance: Column, title_words_found: Column) -> Column:
    combined = F.col("combine") & (score >= F.col("combine_score")) & (relevance >= F.col("combine_relevance")) & (title_words_found >= F.col("combine_words"))
    return (score >= F.col("match")) | combined


def enough_for_caution(n_high: Column, n_features: Column) -> Column:
    """One feature of high confidence, or two of any."""
    return (n_high >= 1) | (n_features >= 2)


def decide(candidates: DataFrame, features: DataFrame, docs: DataFrame, profile_table: DataFrame) -> DataFrame:
    """One row for each document and profile: level, variant, deciding article, shown articles, hidden features.

    candidates: doc_id, article_id, score, label, relevance, title_words_found. features: doc_id, confidence. docs:
    doc_id. Thresholds are columns, so that a sweep is the same plan over more profiles. All articles of a document
    are few (those retrieved); they are ranked by windows and folded by one aggregate, no row meets another.
    """
    ranked = candidates.crossJoin(F.broadcast(profile_table))  # profiles: a stated, small set
    by = ["profile", "doc_id"]
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "article_id")
    ranked = ranked.withColumn("rank", F.row_number().over(order))
    label = F.lower(F.trim(F.coalesce("label", F.lit(""))))
    first = (F.col("rank") == 1) & (F.col("score") >= F.col("bypass"))
    near = ranked.filter(F.col("score") >= F.col("similar")).withColumns({"label": label, "relevant": first | (F.col("relevance") >= F.col("relevance_least"))})
    near = near.withColumn("strong", is_strong_match(F.col("score"), F.col("relevance"), F.col("title_words_found")))
    kept = near.filter("relevant")
    refuted = F.col("label").isin(*REFUTED)
    # The deciding article: the first refuted one that is a strong match, else the first refuted one.
    decider = F.min(F.when(refuted, F.struct((~F.col("strong")).alias("weak"), "rank", "article_id", "score", "strong")))
    all_rows = Window.partitionBy(*by)
    with_decider = kept.withColumn("d", decider.over(all_rows))
    conflicting = F.coalesce(F.col("label").isin(*CONFLICTING) & (F.col("d.score") - F.col("score") <= F.col("gap") + _EPSILON), F.lit(False))
    deciding = F.coalesce(F.col("article_id") == F.col("d.article_id"), F.lit(False))
    shown_order = Window.partitionBy(*by).orderBy(F.when(deciding, 0).when(conflicting, 1).otherwise(2), "rank")
    flagged = with_decider.withColumns({"conflicting": conflicting, "shown_at": F.row_number().over(shown_order)})
    articles = flagged.groupBy(*by).agg(
        F.first("d").alias("d"),
        F.max("conflicting").alias("conflict"),
        F.max((F.col("label") == "satir") & (F.col("score") >= F.col("match"))).alias("satire_match"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("shown_at") <= F.col("most"), F.struct("rank", "article_id")))), lambda x: x["article_id"]).alias("shown"),
    )
    hidden = near.filter("NOT relevant").groupBy(*by).agg(F.count("*").alias("n_filtered"))
    marks = features.groupBy("doc_id").agg(F.count_if(F.col("confidence") == "tinggi").alias("n_high"), F.count("*").alias("n_features"))
    grid = docs.select("doc_id").distinct().crossJoin(F.broadcast(profile_table.select("profile", "satire")))
    whole = grid.join(articles, by, "left").join(hidden, by, "left").join(marks, "doc_id", "left")
    match, conflict = F.coalesce("d.strong", F.lit(False)), F.coalesce("conflict", F.lit(False))
    any_refuted, satire = F.col("d").isNotNull(), F.coalesce("satire_match", F.lit(False)) & F.col("satire")
    enough = enough_for_caution(F.coalesce("n_high", F.lit(0)), F.coalesce("n_features", F.lit(0)))
    shown = F.coalesce("shown", F.array().cast(dict(articles.dtypes)["shown"]))
    level = F.when(match & ~conflict, STRONG).when(match | satire | any_refuted | enough, CAUTION).otherwise(NOT_FOUND)
    variant = (
        F.when(match & ~conflict, "").when(match, CONFLICT).when(satire, SATIRE).when(any_refuted, SIMILAR).when(enough, FEATURES_ONLY)
        .when(F.size(shown) > 0, REFERENCE).otherwise("")
    )
    return whole.select(
        *by,
        level.alias("level"),
        variant.alias("variant"),
        F.col("d.article_id").alias("deciding_id"),
        F.when(any_refuted, F.when(match & ~conflict, "tinggi").otherwise("sedang")).alias("refuted_confidence"),
        shown.alias("shown"),
        F.coalesce("n_filtered", F.lit(0)).alias("n_filtered"),
        F.when(level == NOT_FOUND, F.coalesce("n_features", F.lit(0))).otherwise(F.lit(0)).alias("n_hidden_features"),
    )


def claim_cascade(docs: DataFrame) -> DataFrame:
    """The claim from the first source that has one: model, evidence, best sentence (4.0 points if the model's was rejected, else 3.0)."""
    least = F.when(F.col("model_rejected"), F.lit(4.0)).otherwise(F.lit(3.0))
    sentence = F.when(F.col("sentence_score") >= least, F.col("sentence"))
    model = F.when(~F.col("model_rejected"), F.col("model_claim"))
    source = F.when(model.isNotNull(), "llm").when(F.col("evidence_claim").isNotNull(), "bukti").when(sentence.isNotNull(), "heuristik")
    return docs.withColumns({"claim": F.coalesce(model, "evidence_claim", sentence), "claim_source": source})


def limited_checks(model_ran: Column, search_ran: Column) -> Column:
    """Which checks did not run."""
    return F.array_compact(F.array(F.when(~model_ran, F.lit("llm")), F.when(~search_ran, F.lit("pencarian"))))


def forced(level: Column, to: str | None) -> Column:
    """The level of a demonstration, where one is forced."""
    return level if to is None else F.lit(to)


def without_articles(features: DataFrame, docs: DataFrame, profile_table: DataFrame) -> DataFrame:
    """(doc_id, profile, level) by features alone: what a verdict is where no article is near."""
    kinds = "doc_id bigint, article_id bigint, score double, label string, relevance double, title_words_found int"
    return decide(docs.sparkSession.createDataFrame([], kinds), features, docs, profile_table).select("doc_id", "profile", "level")
