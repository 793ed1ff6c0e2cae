import datetime

from pyspark.sql import functions as F

from clearsift.functions import helpers
from clearsift.operators import reports
from clearsift.sources import readers, sinks


def col(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_helpers(spark):
    assert col(spark, helpers.with_synonyms(F.lit("Beredar kabar, beredar."), {"beredar": "tersebar"})) == "Tersebar kabar, tersebar."
    s = F.array(F.lit("A."), F.lit("B."), F.lit("C."))
    assert col(spark, helpers.rotated(s)) == "B. C. A." and col(spark, helpers.chain_letter(s, "Info!", "Sebarkan")) == "Info! A. B. C. Sebarkan"
    assert col(spark, helpers.thresholds_from_text(F.lit("s=0.5, r = 0.4,x=1,s2=y"), {"s": "similar", "r": "relevance", "s2": "score"})) == {"similar": 0.5, "relevance": 0.4}
    assert col(spark, helpers.forbidden_path(F.lit("a/.env/b"), [".env"])) and not col(spark, helpers.forbidden_path(F.lit("a/env"), [".env"]))
    box = F.struct(*[F.lit(float(v)).alias(n) for n, v in (("l", 10), ("t", 10), ("r", 30), ("b", 40))])
    at = lambda x, y: col(spark, helpers.handle_at(box, F.lit(float(x)), F.lit(float(y)), 4.0))
    assert (at(11, 12), at(10, 25), at(20, 20), at(90, 90)) == ("kiri_atas", "kiri", "dalam", None)
    assert tuple(col(spark, helpers.moved_box(box, F.lit(100.0), F.lit(-50.0), F.lit(50.0), F.lit(50.0)))) == (30.0, 0.0, 50.0, 30.0)
    assert col(spark, helpers.retry_wait(F.array(F.lit(429)), F.lit(500.0))) == 90.0 and col(spark, helpers.retry_wait(F.array(F.lit(200)), F.lit(5.0))) is None


def test_counts(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "id string, v double")
    assert tuple(reports.average_with_exclusion(rows, "v", F.col("id") == "b").first()) == (3.0, 2.0, 1)
    ref = spark.createDataFrame([(1, "Satu dua tiga")], "doc_id long, text string")
    read = spark.createDataFrame([(1, "satu"), (1, "xduax")], "doc_id long, text string")
    assert reports.words_never_read(ref, read).first().never_read == ["tiga"]
    calls = spark.createDataFrame([("d", 0.0, 1, 10), ("d", 0.5, 2, 10), ("d", 5.0, 3, 10), ("d", 9.0, 4, 100)], "day string, at double, seq int, tokens int")
    assert [r.allowed for r in reports.allowed_calls(calls, 1.0, 10, 50).orderBy("seq").collect()] == [True, False, True, False]
    lines = spark.createDataFrame([(1, 0, "Adapter satu:"), (1, 1, "  IPv4 Address. . : 10.0.0.2"), (1, 2, "Adapter dua:"), (1, 3, "   x"), (1, 4, "  IPv4 : 10.0.0.3")], "doc_id long, pos int, text string")
    assert [(r.adapter, r.address) for r in reports.carried_forward(lines).orderBy("pos").collect()] == [("Adapter satu", "10.0.0.2"), ("Adapter dua", "10.0.0.3")]
    assert {r.name: r.n_broken for r in reports.confirm(rows, {"positive": F.col("v") > 0, "small": F.col("v") < 4}).collect()} == {"positive": 0, "small": 1}
    assert reports.quota_sample(rows, {"a": 1}, "id", "v").count() == 1 and reports.seeded_sample(rows, "v", 2, 1).count() == 2
    assert reports.prompt_list(spark.createDataFrame([(2, "b", "y"), (1, "a", "x")], "ord int, id string, explanation string")).first().prompt == "- a: x\n- b: y"


def test_targets_and_queries(spark):
    articles = spark.createDataFrame([(1, "https://x.id/a", "[SALAH] Judul"), (2, "https://x.id/b", "Lain")], "article_id long, url string, title string")
    queries = spark.createDataFrame([(1, "http://www.x.id/a/", ""), (2, "", "Lain"), (3, "z", "zz")], "query_id long, url string, title string")
    assert {r.query_id: r.article_id for r in reports.find_targets(queries, articles).collect()} == {1: 1, 2: 2, 3: None}
    news = spark.createDataFrame([("o", 1, "JAKARTA, Koran - " + "Kalimat pertama yang cukup panjang untuk dipakai di sini. Kalimat kedua. Ketiga."), ("o", 2, "Pendek.")], "outlet string, id long, text string")
    assert [r["query"] for r in reports.negative_queries(news, 5, 1).collect()] == ["Kalimat pertama yang cukup panjang untuk dipakai di sini. Kalimat kedua."]
    days = spark.createDataFrame([(datetime.date(y, 1, 1),) for y in (2020, 2021, 2021, 2022, 2023)], "date date")
    assert [(r.year, r.n) for r in reports.latest_years(days).collect()] == [(2023, 1), (2022, 1), (2021, 2)]


def test_more_files(spark, tmp_path):
    (tmp_path / "n.csv").write_text("id,judul,narasi,label\n1,A,b,1\n2,C,,0\n3,D,e,x\n")
    assert {r.doc_id: r.text for r in readers.read_false_news(spark, str(tmp_path / "n.csv"), True).collect()} == {"1": "A. b", "2": "C"}
    (tmp_path / "t1.txt").write_text("isi [UI]menu[/UI] a[?]")
    (tmp_path / "t2.txt").write_text("DRAF isi")
    assert sorted(r.text or "" for r in readers.read_transcripts(spark, str(tmp_path / "t*.txt")).collect()) == ["", "isi \x01menu\x01 a\x00"]
    (tmp_path / "r.md").write_text("# x\n| a | b |\n|---|---|\n| 1 | 2 |\n")
    assert [r.cells for r in readers.read_markdown_table(spark, str(tmp_path / "r.md")).orderBy("pos").collect()] == [["a", "b"], ["1", "2"]]
    sinks.write_vectors(spark.createDataFrame([(1, [0.5, 0.5])], "id long, embedding array<float>"), str(tmp_path / "v"), "base", "abc")
    assert spark.read.json(str(tmp_path / "v" / "meta")).first().dimensi == 2


def test_index_map_patterns_and_tables(spark):
    from clearsift.operators.features import pattern_of
    from clearsift.operators.spans import with_index_map

    rows = with_index_map(spark.createDataFrame([(1, " Satu\n\n DUA "), (2, None)], "id long, t string"), "t").orderBy("id").collect()
    assert rows[0].norm == "satu dua" and [" Satu\n\n DUA "[i].lower() for i in rows[0]["at"] if not " Satu\n\n DUA "[i].isspace()] == list("satudua") and rows[1].norm == ""
    patterns = [("kuat", r"\bsatu dua\b"), ("lemah", r"\bdua\b")]
    assert col(spark, pattern_of(F.lit("satu dua"), patterns, F.lit(5), F.lit(8))) == 1 and col(spark, pattern_of(F.lit("satu dua"), patterns, F.lit(0), F.lit(4))) is None
    a, b = spark.createDataFrame([("m", 1.0)], "k string, v double"), spark.createDataFrame([("m", 2.0)], "k string, v double")
    assert tuple(reports.comparison_table({"x": a, "y": b}, "k", "v").first()) == ("m", 1.0, 2.0)
    texts = spark.createDataFrame([("a" * n,) for n in (5, 1, 9, 3)], "text string")
    assert [len(r.text) for r in reports.length_sorted(texts, 2).collect()] == [1, 3, 5, 9]
    judged = spark.createDataFrame([("en", 1, 1), ("en", 0, 1), ("de", 1, 0)], "lang string, expected int, actual int")
    out = reports.evaluation_report(judged, spark.createDataFrame([(1,), (None,)], "rank int"), "lang")
    assert out["slices"].count() == 3 and out["ranking"].first().mrr == 0.5 and out["confusion"].count() == 2
