"""The whole screening of documents as one plan: clean, detect, retrieve, decide, explain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearsift.functions.arrays import closest_passage, content_words, word_in_misread
from clearsift.functions.text import alnum_count, bare_title, cut_at_word, squeeze
from clearsift.operators import claims, decide, features, lines, retrieval
from clearsift.operators.resolve import checkpointed

#: Names of levels for people; variants have their own text.
LEVEL_TEXT = {
    ("kuat", ""): "Indikasi kuat", ("hati_hati", "konflik"): "Perlu hati-hati: artikel berbeda pendapat", ("hati_hati", "satir"): "Perlu hati-hati: mirip satir",
    ("hati_hati", "mirip"): "Perlu hati-hati: mirip artikel cek fakta", ("hati_hati", "ciri_saja"): "Perlu hati-hati: ada ciri", ("tidak_ditemukan", "rujukan"): "Tidak ditemukan indikasi; ada rujukan",
    ("tidak_ditemukan", ""): "Tidak ditemukan indikasi",
}


def lookup(table: dict, *keys: Column, default: Column) -> Column:
    """A dimension of fixed values by one or more keys, with a default."""
    flat = {("\x1f".join(k) if isinstance(k, tuple) else k): v for k, v in table.items()}
    found = F.element_at(F.create_map(*[F.lit(x) for p in flat.items() for x in p]), F.concat_ws("\x1f", *keys))
    return F.coalesce(found, default)


def level_text(level: Column, variant: Column) -> Column:
    return lookup(LEVEL_TEXT, level, variant, default=level)


def refuted_evidence(texts: DataFrame, verdict: DataFrame, articles: DataFrame, fallback: DataFrame, most: int = 140, least: int = 3) -> DataFrame:
    """(doc_id, profile, refuted_evidence): of each text that an article refutes, the passage closest to the article.

    texts: doc_id, text. verdict: doc_id, profile, deciding_id. articles: doc_id, title_words, narrative_words. Of all
    sentences the passage with most of the title's words counts, then of all of the article's, at least `least`; the
    earliest of equals. Without one, the best sentence of `fallback` (doc_id, sentence), else the first line.
    """
    decided = verdict.filter("deciding_id IS NOT NULL").select("doc_id", "profile", "deciding_id")
    about = decided.select("doc_id", "deciding_id").distinct().join(articles.select(F.col("doc_id").alias("deciding_id"), "title_words", "narrative_words"), "deciding_id")
    asked = texts.join(about, "doc_id").select("doc_id", "deciding_id", "title_words", "narrative_words", F.posexplode(claims.split_sentences(F.col("text"))).alias("pos", "sentence"))
    near = asked.withColumn("p", closest_passage(F.col("sentence"), F.col("title_words"), F.col("narrative_words"), most)).filter(F.col("p.in_all") >= least)
    best = near.groupBy("doc_id", "deciding_id").agg(F.max_by("p.passage", F.struct("p.in_title", "p.in_all", "p.share", (-F.col("pos")).alias("before"))).alias("passage"))
    first = F.get(F.filter(F.transform(F.split("text", "\n"), lambda t: F.trim(t)), lambda t: t != ""), 0)
    found = decided.join(best, ["doc_id", "deciding_id"], "left").join(texts.select("doc_id", first.alias("first_line")), "doc_id").join(fallback, "doc_id", "left")
    return found.select("doc_id", "profile", cut_at_word(squeeze(F.coalesce("passage", "sentence", "first_line")), most).alias("refuted_evidence"))


def screen(pages: DataFrame, embeddings: DataFrame, articles: DataFrame, profile_table: DataFrame, least_alnum: int = 20) -> DataFrame:
    """One row for each read page and profile: doc_id, profile, level, variant, claim, features, shown, limited, error.

    pages: doc_id, pos, text, box, height (read lines). embeddings: vec_id (doc_id), embedding, of the pages that are
    searched for. articles: vec_id, embedding, label, title, narrative. An article's relevance is the weight of its
    title's words that the page holds (rare words weigh more, misread ones count). Nothing fails a row: without
    readable text it has an error, without a vector its search is listed as not run. Clean texts, features and the words
    found of each pair are written, as several steps read them.
    """
    cleaned = checkpointed(lines.clean_text(lines.classify_lines(pages)).withColumn("readable", alnum_count(F.col("text")) >= least_alnum))
    good = cleaned.filter("readable").select("doc_id", "text")
    rules = features.detect_features(good)
    no_model = good.select("doc_id", F.lit(False).alias("ok"))
    no_quotes = good.limit(0).select("doc_id", F.lit("").alias("feature_id"), F.array().cast("array<string>").alias("quotes"))
    merged = checkpointed(features.merge_features(rules, no_quotes, no_model))
    found = retrieval.top_k(embeddings.join(good, embeddings["vec_id"] == good["doc_id"], "left_semi"), articles.select("vec_id", "embedding"), 5)
    details = articles.select(F.col("vec_id").alias("doc_id"), "label", content_words(bare_title(F.col("title"))).alias("title_words"), content_words(F.col("narrative")).alias("narrative_words"))
    words = good.select(F.col("doc_id").alias("query_id"), content_words(F.col("text")).alias("words"))
    held = F.filter("title_words", lambda t: word_in_misread(t, F.col("words")))
    scored = checkpointed(found.join(details.drop("narrative_words"), "doc_id").join(words, "query_id").withColumn("held", held).drop("words"))
    pair = F.struct("query_id", "doc_id").alias("pair_id")
    # Frequencies of the titles' words alone, counted over whole articles.
    asked = details.select(F.explode("title_words").alias("token")).distinct()
    idf = retrieval.document_frequencies(details.select(F.array_union("title_words", "narrative_words").alias("w")), F.col("w")).join(asked, "token", "left_semi")
    relevance = retrieval.title_relevance(scored.select(pair, "title_words", "held"), idf, F.lit(articles.count()))
    weighed = scored.join(relevance.select("pair_id.query_id", "pair_id.doc_id", "relevance"), ["query_id", "doc_id"])
    candidates = weighed.select(
        F.col("query_id").alias("doc_id"), F.col("doc_id").alias("article_id"), "score", "label", "relevance", F.size("held").alias("title_words_found")
    )
    verdict = decide.decide(candidates, merged.select("doc_id", "confidence"), good.select("doc_id"), profile_table)
    quotes = merged.groupBy("doc_id").agg(F.flatten(F.collect_list("evidence")).alias("evidence"), F.sort_array(F.collect_list(F.struct("ord", "feature_id", "confidence"))).alias("features"))
    sentences = claims.best_sentences(lines.explode_lines(good), quotes.select("doc_id", "evidence"))
    refuted = refuted_evidence(good, verdict, details, sentences.select("doc_id", "sentence"))
    searched = embeddings.select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("searched"))
    named = F.concat(F.when(F.col("refuted_evidence").isNotNull(), F.array(F.lit(features.FEATURE_IDS[0]))).otherwise(F.array().cast("array<string>")), F.coalesce(F.transform("features", lambda f: f["feature_id"]), F.array().cast("array<string>")))
    return (
        cleaned.select("doc_id", F.when(~F.col("readable"), F.lit("teks_tidak_terbaca")).alias("error"))
        .join(verdict, "doc_id", "left")
        .join(refuted, ["doc_id", "profile"], "left")
        .join(quotes.select("doc_id", "features"), "doc_id", "left")
        .join(sentences, "doc_id", "left")
        .join(searched, "doc_id", "left")
        .select(
            "doc_id", "profile", "level", "variant", level_text(F.col("level"), F.col("variant")).alias("level_text"), F.when(F.col("score") >= 3.0, F.col("sentence")).alias("claim"),
            F.when(F.col("level") != "tidak_ditemukan", named).alias("features"), "refuted_evidence", "shown",
            decide.limited_checks(F.lit(False), F.coalesce("searched", F.lit(False))).alias("limited"), "error",
        )
    )
