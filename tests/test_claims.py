from pyspark.sql import functions as F

from clearsift.operators import claims, faithful


def col(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_sentences(spark):
    s = lambda t: col(spark, claims.split_sentences(F.lit(t)))
    assert s("Satu dua. Tiga empat! Lima?") == ["Satu dua.", "Tiga empat!", "Lima?"]
    assert s("Menurut dr. Budi ini benar. Selesai.") == ["Menurut dr. Budi ini benar.", "Selesai."]
    assert s("Harga 12. 16 rupiah. Baru.") == ["Harga 12. 16 rupiah.", "Baru."]
    assert s("Lihat www.contoh.id. Lalu pulang.") == ["Lihat www.contoh.id. Lalu pulang."]
    assert s("Oleh A. Rahman kemarin. lanjut kecil.") == ["Oleh A. Rahman kemarin. lanjut kecil."]
    assert s("") == [] and s(None) == []


def test_paragraphs(spark):
    text = ["Pemerintah mengumumkan bahwa", "harga naik mulai besok.", "", "Beranda", "Menteri Keuangan Terlibat", "Korupsi Besar Sekali", "Senin, 3 Mei 2024", "Catatan"]
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(text)], "doc_id long, pos int, text string")
    got = [r.text for r in claims.paragraphs(lines).orderBy("paragraph").collect()]
    assert got == ["Pemerintah mengumumkan bahwa harga naik mulai besok.", "Menteri Keuangan Terlibat Korupsi Besar Sekali", "Senin, 3 Mei 2024", "Catatan"]


def test_scores(spark):
    none = F.array().cast("array<string>")
    s = lambda t, e=none: col(spark, claims.sentence_score(F.lit(t), e))
    assert s("Pemerintah resmi menutup 12 pasar di kota itu mulai besok.") == 5.0
    assert s("Pemerintah resmi menutup 12 pasar di kota itu mulai besok.", F.array(F.lit("12 pasar"))) == 6.0
    assert s("Apakah benar pemerintah menutup pasar besok?") is None
    assert s("Empat kata saja ini") is None
    assert s("Kamu harus segera datang ke kantor itu sekarang.") is None
    assert s("Badan Penanggulangan Bencana Daerah Kota Jakarta Selatan Utara") == 1.0


def test_best_sentence_and_claims(spark):
    lines = spark.createDataFrame([(1, 0, "Halo semua orang di sana ya. Pemerintah resmi menutup 12 pasar di kota itu mulai besok.")], "doc_id long, pos int, text string")
    none = spark.createDataFrame([], "doc_id long, evidence array<string>")
    row = claims.best_sentences(lines, none).first()
    assert row.sentence.startswith("Pemerintah") and row.score == 5.0
    assert col(spark, claims.claim_from_evidence(F.lit("bank akan menutup rekening nasabah dan di"))) == "bank akan menutup rekening nasabah"
    assert col(spark, claims.claim_from_evidence(F.lit("akun kamu akan ditutup besok"))) is None
    assert col(spark, claims.addresses_reader(F.lit("rumahmu besar"))) and not col(spark, claims.addresses_reader(F.lit("ilmu dan tamu")))
    reason = lambda c, t: col(spark, claims.claim_reject_reason(F.lit(c), F.lit(t), ["palsu"]))
    assert reason("", "x") == "kosong" and reason("Berita palsu beredar", "Berita beredar") == "penilaian_baru"
    assert reason("Berita beredar", "Berita beredar luas") is None and reason("gajah terbang", "kucing tidur") == "tidak_setia"


def test_faithfulness(spark):
    text = "Presiden Prabowo mengumumkan bantuan 1,5 juta rupiah untuk 200 warga Bandung pada 3 Nov. Warga tidak dipungut biaya."
    cases = [
        ("Presiden Prabowo mengumumkan bantuan 1,5 juta rupiah", None),
        ("Presiden Prabowo mengumumkan bantuan 2 juta rupiah", "angka_baru"),
        ("Presiden Prabowo bertemu Jokowi mengumumkan bantuan", "entitas_baru"),
        ("Presiden Prabowo mengumumkan bantuan palsu", "kata_berat_baru"),
        ("Presiden mengumumkan pertandingan sepakbola internasional", "kata_baru_banyak"),
        ("Warga dipungut biaya", "negasi"),
        ("Bantuan untuk warga Bandung pada November", None),
        ("Presiden Prabowoo mengumumkan bantuan", None),
    ]
    pairs = spark.createDataFrame([(i, c, text) for i, (c, _) in enumerate(cases)], "id long, claim string, text string")
    got = {r.id: r.reason for r in faithful.check_faithfulness(pairs).collect()}
    assert got == {i: e for i, (_, e) in enumerate(cases)}


def test_word_forms(spark):
    forms = lambda w: set(col(spark, faithful.stem_candidates(F.lit(w))))
    assert "tipu" in forms("menipu") and "sapu" in forms("menyapu") and "bantu" in forms("bantuan") and forms("air") == {"air"}
    assert col(spark, faithful.months_in(F.lit("1 Nov, lalu 26/1/2026 dan Mei"))) == [1, 5, 11]
    assert [float(x) for x in col(spark, faithful.number_set(F.lit("1.500.000 dan 2,5 juta"), False))] == [1500000.0, 2500000.0]
