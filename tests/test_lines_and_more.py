import random

from pyspark.sql import functions as F

from clearsift.operators import alignment, evaluation, lines, messages, retrieval, screen
from clearsift.sources.html_pages import article_record

BOX = "array<struct<x:double,y:double>>"


def page(rows):
    return [(1, i, t, [(0.0, y), (10.0, y)], 1000) for i, (t, y) in enumerate(rows)]


def reasons(spark, rows, **kw):
    table = spark.createDataFrame(page(rows), f"doc_id long, pos int, text string, box {BOX}, height int")
    return {r.pos: r.reason for r in lines.classify_lines(table, **kw).collect()}


def test_single_lines(spark):
    cases = {"12 rb suka": "angka interaksi", "Suka Balas Bagikan": "tombol atau aksi", "Beranda": "menu situs", "2 jam lalu": "penanda waktu", "0 jam": None, "10.45 dibaca": "jam obrolan", "Lihat terjemahan": "terjemahan atau sponsor", "Ketik pesan": "UI aplikasi pesan", "•••": "tanpa huruf atau angka", "Pemerintah menutup pasar": None, "Suka makan bakso": None}
    got = reasons(spark, [(t, 400.0 + 50 * i) for i, t in enumerate(cases)])
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_status_bar_needs_the_top(spark):
    got = reasons(spark, [("10:45 4G 97%", 20.0), ("10:45 4G 97%", 500.0), ("10:45 berita", 20.0)])
    assert got == {0: "bilah status (pita atas)", 1: None, 2: None}
    assert reasons(spark, [("Baca juga: lain", 500.0)], read_also=True)[0] == "baca juga"


def test_menu_rows_and_banners(spark):
    got = reasons(spark, [("Home", 300.0), ("Ekonomi", 305.0), ("Olahraga", 310.0), ("Kalimat panjang yang bukan menu sama sekali", 302.0), ("Wisata", 700.0)])
    assert got == {0: "menu situs", 1: "deret menu", 2: "deret menu", 3: None, 4: None}
    got = reasons(spark, [("Pesan dan panggilan terenkripsi secara", 300.0), ("end-to-end. Ketuk untuk info selengkapnya.", 340.0), ("Isi pesan", 380.0)])
    assert got == {0: "banner sistem", 1: "banner sistem", 2: None}


def test_distances_match_plain_recurrences():
    rng = random.Random(4)

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for _ in range(60):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(2))
        assert alignment.character_errors(a, b) == (edits(a, b), len(a))
        pieces = [b[i:j] for i in range(len(b) + 1) for j in range(i, len(b) + 1)]
        assert alignment.substring_distance(a, b) == min(edits(a, p) for p in pieces)
    assert alignment.character_errors("ab\x01menu\x01cd", "abcd") == (0, 4) and alignment.character_errors("ab\x01menu\x01cd", "abmenucd") == (0, 4)


def test_highlights(spark):
    rows = spark.createDataFrame([(1, "aa  a b", ["aa", "b"]), (2, None, ["x"]), (3, "abab ab", ["ab a"])], "id long, t string, q array<string>")
    got = {r.id: [tuple(x) for x in r.s] for r in rows.select("id", alignment.highlight_spans("t", "q").alias("s")).collect()}
    assert got == {1: [(0, 5), (6, 7)], 2: [], 3: [(0, 6)]}


def test_top_k_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_ROWS", 2)
    monkeypatch.setattr(retrieval, "CORPUS_ROWS", 25)
    rng = random.Random(3)
    vectors = [(i, [float(rng.randint(-2, 2)) for _ in range(4)]) for i in range(60)]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    got = {(r.query_id, r.rank): r.doc_id for r in retrieval.top_k(table.filter("vec_id < 5"), table, 4).collect()}
    for q in range(5):
        order = sorted((-sum(a * b for a, b in zip(vectors[q][1], v, strict=True)), i) for i, v in vectors if i != q)
        assert [got[(q, k)] for k in range(1, 5)] == [i for _, i in order[:4]]
    pooled = table.limit(1).select(retrieval.mean_pool(F.array(F.array(F.lit(3.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(9.0))), F.array(F.lit(1), F.lit(0))).alias("v")).first().v
    assert pooled == [1.0, 0.0]


def test_metrics(spark):
    runs = spark.createDataFrame([("a", 1, "k", ["x", "y"]), ("a", 2, "k", ["x"]), ("b", 1, "k", ["z"]), ("b", 2, "m", ["z"])], "code string, run int, claim string, features array<string>")
    got = {r.code: (r.same_claim, r.unstable) for r in evaluation.run_stability(runs).collect()}
    assert got == {"a": (True, ["y"]), "b": (False, [])}
    values = spark.createDataFrame([(float(x),) for x in (1, 1, 2, 3, 9)], "v double")
    assert evaluation.nearest_rank_percentile(values, "v", 0.5).first().value == 2.0
    found = spark.createDataFrame([(i, "f", "kuat") for i in range(5)], "doc_id long, feature_id string, strength string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, label int")
    got = {r.label: (r.n_texts, r.examples, r.percent) for r in evaluation.detector_counts(found, labels, labels).collect()}
    assert got == {0: (3, [0, 2, 4], 100.0), 1: (2, [1, 3], 66.67)}


def test_article_pages(spark):
    html = '<h1>Judul</h1><article><time datetime="2024-01-02"></time><h3>Narasi</h3><p>Isi <b>tebal</b></p><h3>Penjelasan</h3><p>Lain</p></article>'
    rows = spark.createDataFrame([(html,), ("<p>x</p>",), (None,)], "html string").select(article_record("html").alias("r")).select("r.*").collect()
    assert tuple(rows[0]) == ("Judul", "2024-01-02", ["Isi tebal", "Lain"], "Isi tebal") and rows[1].title is None and rows[2].title is None


def test_messages(spark):
    row = spark.range(1).select(screen.level_text(F.lit("hati_hati"), F.lit("mirip")).alias("a"), screen.level_text(F.lit("lain"), F.lit("")).alias("b"), messages.comparison_message(F.lit("percaya"), F.lit("hati_hati"), messages.caution_cause(F.lit(0), F.array(F.lit("satir")))).alias("c"), messages.article_label(F.lit(None).cast("string"))["text"].alias("d")).first()
    assert tuple(row) == ("Perlu hati-hati: mirip artikel cek fakta", "lain", "banding_pesan_hati_hati_percaya_satir", "hasil_label_rujukan")


def test_compatible_forms_equal_the_unicode_database(spark):
    """Every assigned character, alone and between others, and sequences of letters and marks."""
    import unicodedata

    rng = random.Random(2)
    every = [chr(c) for c in range(0x20, 0x20000) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co")]
    marks = [c for c in every if unicodedata.combining(c)] + list("ᅡᆨা")
    texts = ["".join(every[i : i + 7]) for i in range(0, len(every), 7)] + [f"a{c}b" for c in every if unicodedata.normalize("NFKC", c) != c]
    texts += [rng.choice("aeoAEOαιи가ᄀकé") + "".join(rng.choice(marks) for _ in range(rng.randint(1, 4))) for _ in range(4000)]
    from clearsift.functions.text import compatible

    rows = spark.createDataFrame(list(enumerate(texts)) + [(-1, None), (-2, "")], "i long, t string").select("i", compatible(F.col("t")).alias("t")).collect()
    assert {r.i: r.t for r in rows} == {i: unicodedata.normalize("NFKC", t) for i, t in enumerate(texts)} | {-1: None, -2: ""}
