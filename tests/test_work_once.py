"""Operators do each piece of work once: patterns run once a text, and what several steps read is written."""

from pyspark.sql import functions as F

from clearsift.operators import claims, features, lines, masking
from clearsift.operators.phrases import Matcher


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_without_a_first_word_are_not_cut_into_tokens(monkeypatch):
    looked = []
    found = Matcher._starting
    monkeypatch.setattr(Matcher, "_starting", lambda self, token, at: looked.append(token) or found(self, token, at))
    matcher = Matcher(features.PHRASES)
    assert matcher.find("Kalimat biasa tentang cuaca " * 1000) == [] and looked == []
    assert [m[:2] for m in matcher.find("Cuaca; Bagikan ke semua grup")] == [("ajakan_menyebarkan", "kuat"), ("ajakan_menyebarkan", "lemah")] and len(looked) < 4


def test_a_sentence_is_scored_once(spark):
    pages = spark.createDataFrame([(1, 0, "Pemerintah resmi menutup 12 pasar di kota mulai besok."), (2, 0, "Apa?")], "doc_id long, pos int, text string")
    best = claims.best_sentences(pages, spark.createDataFrame([], "doc_id long, evidence array<string>"))
    assert [(r.doc_id, r.score) for r in best.collect()] == [(1, 5.0)]
    assert plan(best).count("mengumumkan") == 1  # the pattern of assertions


def test_what_loops_over_places_read_is_computed_once(spark):
    """Shouted sentences and strong links are no part of a loop's body, evidence is collected once a row."""
    docs = spark.createDataFrame([(1, "THE OLD MAN!! THE NEW SEA!! Buka bit.ly/x dan www.a.id/b.")], "doc_id long, text string")
    found = features.detect_features(docs)
    evidence = {r.feature_id: (r.strength, r.evidence, r.n_strong) for r in found.collect()}
    assert evidence["kapital_tanda_seru"][0] == evidence["link_mencurigakan"][0] == "kuat" and evidence["kapital_tanda_seru"][2] == 1
    spans = plan(docs.select(features.capital_spans(F.col("text")).alias("p")))
    assert spans.count(features.CAPITAL_SENTENCE) == 3 and "substring" not in spans  # asked, cut and extracted; runs are judged by their match
    links = plan(docs.select(features.link_spans(F.col("text")).alias("p")))
    assert links.count(features.LINKS[2]) == 3
    assert plan(found).count("sort_array(") == 1


def test_places_are_counted_over_blocks(spark):
    """Matches of several blocks stand where a plain search finds them; every suspicious link has the sign that is asked first."""
    import re

    texts = ["!!", "", "a", "x!! ! !!!y" * 7, "ab !! c" * 50 + "!"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(c.s, c.e, c.strength) for c in r.p] for r in docs.select("doc_id", features.exclamation_runs(F.col("text")).alias("p")).collect()}
    assert got == {i: [(*m.span(), "kuat" if m[0].count("!") >= 3 else "lemah") for m in re.finditer(r"!(?:\s?!)+", t)] for i, t in enumerate(texts)}
    hosts = [f"{h}/a" for h in (*features.SHORTENERS, "chat.whatsapp.com")] + [f"a.{t}" for t in features.CHEAP_TLDS] + features.FREE_HOSTS
    links = spark.createDataFrame([(f"Lihat {h.upper() if i % 2 else h} ya",) for i, h in enumerate(hosts)], "text string")
    assert all([c.strength for c in r.p] == ["kuat"] for r in links.select(features.link_spans(F.col("text")).alias("p")).collect())


def test_a_long_sentence_is_cut_into_words_once(spark):
    """Words and their places are no part of the loops over starts; a passage of a thousand words is the best of all runs."""
    from clearsift.functions.arrays import closest_passage

    words = [f"kata{k % 97}" for k in range(1000)]
    words[700:703] = ["gempa", "kota", "lama"]
    rows = spark.createDataFrame([(" ".join(words), ["gempa", "kota"], ["lama"])], "s string, t array<string>, n array<string>")
    found = rows.select(closest_passage(F.col("s"), F.col("t"), F.col("n"), 40).alias("p"))
    assert found.first().p.passage == "gempa kota lama" and tuple(found.first().p)[1:3] == (2, 3)
    assert plan(found).count("split(") == 1


def test_lines_are_told_from_interface_once(spark):
    pages = spark.createDataFrame([(1, 0, "Satu baris yang belum"), (1, 1, "selesai di sini.")], "doc_id long, pos int, text string")
    joined = claims.paragraphs(pages)
    assert [r.text for r in joined.collect()] == ["Satu baris yang belum selesai di sini."]
    assert plan(joined).count("bukan kontak") == 1 and plan(joined).count(claims.META_LINE[:30]) == 1


def test_masking_groups_only_lines_that_may_be_accounts(spark):
    docs = spark.createDataFrame([(1, "namaakun1\nnamaakunku\nnamaakunmu\nKalimat biasa\nhalo"), (2, None), (3, "Tulis ke a@b.co\n\n0812-3456-7890 ya")], "doc_id long, text string")
    masked = masking.mask_documents(docs)
    assert dict(masked.collect()) == {1: "[AKUN]\n[AKUN]\n[AKUN]\nKalimat biasa\nhalo", 2: "", 3: "Tulis ke [EMAIL]\n\n[NOMOR] ya"}
    assert plan(masked).count("Join") == 1 and "_fits" not in plan(masked)


def test_a_search_holds_the_scores_of_few_queries_at_a_time(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from clearsift.operators import retrieval

    shapes, scores = [], retrieval._scores
    monkeypatch.setattr(retrieval, "_scores", lambda *a: (x := scores(*a), shapes.append(x.shape))[0])
    vectors = np.random.default_rng(1).random((300, 8))
    rows = lambda name: pa.table({name: pa.array(range(300)), "vector": pa.array(vectors.tolist())})
    found = retrieval._met(rows("query_id"), rows("doc_id"), 2, 6, False)
    whole = np.round(vectors @ vectors.T, 6) - 9 * np.eye(300)
    assert [s for s in found["score"].to_pylist()] == [s for r in whole for s in sorted(r, reverse=True)[:2]]
    assert max(s[0] for s in shapes) <= retrieval.SCORED_ROWS and sum(s[0] for s in shapes) == 300


def test_records_of_a_large_batch_are_handed_on_in_pieces():
    import pyarrow as pa

    from clearsift.sources import html_pages

    page = "<h1>T</h1><article><p>eins</p><p>zwei</p></article>"
    parts = list(html_pages.article_record.func(iter([pa.array([page, None] * 500)])))
    assert max(len(p) for p in parts) <= html_pages.PAGES_AT_ONCE and sum(len(p) for p in parts) == 1000
    assert parts[0][0].as_py() == {"title": "T", "date": None, "blocks": ["eins", "zwei"], "narrative": None} and parts[0][1].as_py()["blocks"] is None


def test_cells_are_read_by_patterns_made_once(monkeypatch):
    import datetime as dt
    from xml.etree import ElementTree

    from pyspark.sql import types as T

    from clearsift.sources import xlsx

    monkeypatch.setattr(xlsx.re, "fullmatch", lambda *a: (_ for _ in ()).throw(AssertionError("a pattern for each cell")))
    cell = lambda v: xlsx._value(ElementTree.fromstring(f'<c xmlns="{xlsx.MAIN}"><v>{v}</v></c>'), [], set(), xlsx.EPOCHS[False])
    assert [cell("12"), cell("1.5"), cell("-3")] == [12, 1.5, -3]
    assert xlsx.convert(True, T.LongType()) == 1 and xlsx.convert(2, T.DoubleType()) == 2.0 and xlsx.convert(dt.datetime(2020, 1, 2), T.DateType()) == dt.date(2020, 1, 2)
