import datetime
import json
import random
import re

from pyspark.sql import functions as F

from clearsift.functions import dates_numbers, json_replies, labels, text
from clearsift.operators import masking, resolve
from clearsift.sources import readers, sinks
from clearsift.streaming import ingest


def col(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_jsonl(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"id": 1}\n\n{"id": 2}\n[3]\n{"id": \n')
    assert readers.read_jsonl(spark, str(tmp_path / "none"), "id int").count() == 0
    assert [r.id for r in readers.read_jsonl(spark, str(p), "id int").orderBy("id").collect() if r.id] == [1, 2]
    problems = [r.problem for r in readers.account_jsonl(spark, str(p)).collect()]
    assert sorted(x or "" for x in problems) == ["", "", "bukan json", "bukan objek"]


def test_csv_and_adapters(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('﻿title,url,date,content\n"[SALAH] Judul ""satu""","https://x.id/a","Oktober 30, 2024","[NARASI]: isi\nberita. [PENJELASAN]: bukan"\nB,,2024-01-01,\n')
    rows = readers.read_csv(spark, str(p), "title string, url string, date string, content string")
    out = readers.adapt_titled(rows, "s1").collect()
    assert len(out) == 1 and out[0].label_raw == "SALAH" and out[0].narrative == "isi berita." and out[0].date == datetime.date(2024, 10, 30)
    body = spark.createDataFrame([("T", "u", "1/2/2024", "Penjelasan : Beredar kabar. Faktanya, salah. Link Counter https://a.id/x. https://b.id/y")], "title string, url string, date string, body string")
    ref = readers.adapt_with_references(body, "s3").first()
    assert ref.narrative == "Beredar kabar." and ref.ref_urls == ["https://a.id/x", "https://b.id/y"] and ref.date == datetime.date(2024, 2, 1)


def test_labels_and_titles(spark):
    cases = {"SALAH": "salah", "Penipuan": "penipuan", "belum  terbukti": "belum_terbukti", "KLARIFIKASI": "klarifikasi", "satire": "satir", "BENAR": "benar", "Fakta": "benar", "EDUKASI": "bukan_cek_fakta", "CEK FAKTA": "bukan_cek_fakta", "": "lainnya", "ISU": "lainnya", "DISINFOMASI": "salah"}
    for raw, expected in cases.items():
        assert col(spark, labels.normal_label(F.lit(raw))) == expected, raw
    assert col(spark, labels.label_with_verdict(F.lit("ISU"), F.lit("Benar"))) == "klarifikasi"
    assert col(spark, labels.label_with_verdict(F.lit("SALAH"), F.lit("Benar"))) == "salah"
    for title, label, bare in [("[SALAH] Judul", "SALAH", "Judul"), ("(ISU) : Judul", "ISU", "Judul"), ("HOAX: Judul", "HOAX", "Judul"), ("[SALAH Judul lain", "SALAH", "Judul lain"), ("Salah] Judul", "Salah", "Judul"), ("Judul biasa", "", "Judul biasa")]:
        assert col(spark, text.title_label(F.lit(title))) == label and col(spark, text.bare_title(F.lit(title))) == bare, title


def test_keys_dates_numbers(spark):
    assert col(spark, text.slug_key(F.lit("https://x.id/2024/10/30/slug-a/"))) == col(spark, text.slug_key(F.lit("https://x.id/articles/123-slug-a?x=1"))) == "slug-a"
    assert col(spark, text.url_key(F.lit(" HTTPS://www.X.id/a/#b "))) == "x.id/a"
    for raw, day in [("2026-10-06 23:06:00", datetime.date(2026, 10, 6)), ("08/10/2026", datetime.date(2026, 10, 8)), ("Oktober 30, 2024", datetime.date(2024, 10, 30)), ("0000-00-00", None), ("31/2/2024", None), ("x", None)]:
        assert col(spark, dates_numbers.parse_date(F.lit(raw))) == day, raw
    for raw, value in [("1.500.000", 1500000), ("1,5", 1.5), ("1.500,25", 150025), ("12", 12)]:
        assert float(col(spark, dates_numbers.number_value(F.lit(raw)))) == value
    for raw, value in [("2m59.56s", 179.56), ("50ms", 0.05), ("6", 6.0), ("x", None)]:
        got = col(spark, dates_numbers.duration_seconds(F.lit(raw)))
        assert got is None if value is None else abs(got - value) < 1e-9
    assert col(spark, dates_numbers.unit_score(F.lit(1.7))) == 1.0 and col(spark, dates_numbers.nearest_rank(F.array(*[F.lit(x) for x in (4, 1, 3, 2)]), 0.5)) == 3
    view = F.struct(F.lit(100.0).alias("w"), F.lit(200.0).alias("h"))
    image = F.struct(F.lit(50).alias("w"), F.lit(50).alias("h"))
    box = F.struct(F.lit(0.0).alias("l"), F.lit(50.0).alias("t"), F.lit(50.0).alias("r"), F.lit(100.0).alias("b"))
    assert tuple(col(spark, dates_numbers.view_to_pixels(box, view, image))) == (0, 0, 25, 25)


def test_text_cuts_and_links(spark):
    assert col(spark, text.tidy(F.lit(' "satu dua tiga" '), 8)) == "satu…" and col(spark, text.cut_at_word(F.lit("satu dua tiga"), 8)) == "satu dua"
    assert col(spark, text.repair_links(F.lit("lihat https://\ncontoh.id/a segera\nlagi"))) == "lihat https://contoh.id/a\nsegera\nlagi"
    assert col(spark, text.repair_links(F.lit("https://\nSilakan klik"))) == "https://\nSilakan klik"
    assert col(spark, text.passage_text(F.lit("[SALAH] A"), F.lit("b"))) == "passage: A. b" and col(spark, text.whole_sentences(F.array(F.lit("a b."), F.lit("c d."), F.lit("e")), 9)) == "a b. c d."


def test_masking(spark):
    mask = lambda t: col(spark, masking.mask_text(F.lit(t)))
    assert mask("hubungi 0812-3456-7890 atau a.b@c.id") == "hubungi [NOMOR] atau [EMAIL]"
    assert mask("jam 08.30 tanggal 08-08-2026") == "jam 08.30 tanggal 08-08-2026"
    assert mask("lihat https://x.id/0812345678901 dan @akun_saya") == "lihat https://x.id/0812345678901 dan [AKUN]"
    assert mask("+62 82") == "[NOMOR]" and mask(None) == ""
    docs = spark.createDataFrame([(1, "humaspolresmerangin\nfpolresmerangin\nKalimat biasa di sini")], "doc_id long, text string")
    assert masking.mask_documents(docs).first().text == "[AKUN]\n[AKUN]\nKalimat biasa di sini"
    assert col(spark, masking.is_account_line(F.lit("user_satu dua.tiga9"))) and not col(spark, masking.is_account_line(F.lit("kalimat biasa saja")))


def test_replies(spark):
    ids = ["a", "b"]
    reply = '```json\n{"klaim_utama": "k", "ciri": [{"id": "a", "kutipan": ["x", 1, "y", "z", "w"]}, {"id": "q", "kutipan": ["x"]}, {"id": "a", "kutipan": ["later"]}, {"id": "b"}]}\n```'
    got = col(spark, json_replies.parse_reply(F.lit(reply), ids))
    assert got.claim == "k" and [(f.id, f.quotes) for f in got.features] == [("a", ["x", "y", "z"])]
    for bad in ("[]", "x", '{"klaim_utama": 1, "ciri": []}', '{"klaim_utama": "k"}'):
        assert col(spark, json_replies.parse_reply(F.lit(bad), ids)) is None, bad
    p = col(spark, json_replies.reply_problems(F.lit('{"klaim_utama": 1, "ciri": [{"id": "zz"}]}'), ids))
    assert p.problems == ["klaim bukan teks"] and p.foreign_ids == ["zz"]
    assert col(spark, json_replies.provider_error_code(F.lit('{"error": {"code": "rate_limit", "message": "m"}}'), F.lit(429))) == "rate_limit"
    assert col(spark, json_replies.provider_error_code(F.lit('{"errors": [{"code": 7009}]}'), F.lit(400))) == "cf_7009" and col(spark, json_replies.provider_error_code(F.lit("x"), F.lit(500))) == "http_500"
    assert tuple(col(spark, json_replies.quota_of(F.lit("Limit 6000, Used 5900, Requested 300. Please try again in 2m3.5s")))) == (6000, 5900, 300)
    assert col(spark, json_replies.wait_seconds(F.lit(None).cast("string"), F.lit("please try again in 2m3.5s."))) == 123.5
    assert tuple(col(spark, json_replies.token_usage(F.lit('{"usage": {"prompt_tokens": 5, "completion_tokens": "x"}}')))) == (5, None, None)


def test_resolution(spark):
    d = datetime.date
    rows = [
        (1, "a", "https://own.id/2024/01/02/judul-satu/", "[SALAH] Judul Panjang Sekali", "", d(2024, 1, 2), []),
        (2, "b", "https://own.id/articles/9-judul-satu", "Lain", "isi", None, []),
        (3, "b", "https://else.id/x", "Judul panjang sekali", "", d(2024, 1, 5), []),
        (4, "c", "https://else.id/y", "Judul panjang sekali", "", d(2025, 1, 5), []),
        (5, "c", "https://else.id/z", "Rujukan", "n", d(2024, 1, 5), ["https://else.id/y"]),
        (6, "c", "", "Tanpa alamat sama sekali", "n", None, []),
        (7, "d", "", "Tanpa alamat sama sekali", "n", None, []),
    ]
    table = spark.createDataFrame(rows, "seq long, source string, url string, title string, narrative string, date date, ref_urls array<string>")
    got = {r.seq: (r.n_merged, r.narrative, sorted(r.other_sources)) for r in resolve.resolve_articles(table, "own.id").collect()}
    assert got == {1: (2, "isi", ["b"]), 4: (1, "n", []), 6: (1, "n", ["d"])}
    best = resolve.best_by_key(spark.createDataFrame([("k", 1, 5, "x"), ("k", 2, 9, "y"), ("k", 3, 9, "z")], "key string, seq int, v int, w string"), "key", "seq", F.col("v")).first()
    assert best.w == "y" and best.first_seq == 1


def merged_one_by_one(rows):
    """The merge of articles by going through the rows in their order."""
    key = lambda u: re.sub(r"/+$", "", re.sub("#.*$", "", re.sub(r"^https?://(www\.)?", "", u.strip().lower())))
    slug = lambda u: re.sub(r"^\d+-", "", re.sub("^.*/", "", re.sub("/+$", "", re.sub(r"\?.*$", "", re.sub(r"^https?://[^/]+", "", u.lower()))))) if "own.id" in u.lower() else ""
    offered, root = {}, {}
    for seq, _, url, _, _, _, refs in rows:
        wanted = [("u", key(url)), ("s", slug(url))] + [x for r in refs for x in (("u", key(r)), ("s", slug(r)))]
        met = next((offered[w] for w in wanted if w[1] and w in offered), None)
        root[seq] = seq if met is None else root[met]
        for w in wanted[:2]:
            if w[1]:
                offered.setdefault(w, seq)
    day = {}
    for seq, *_, date, _ in rows:
        if date is not None:
            day.setdefault(root[seq], date)
    kept, home = {}, {}
    for seq, _, _, title, *_ in rows:
        t = re.sub("[^a-z0-9]+", "", title.lower())
        if root[seq] == seq and len(t) >= 12:
            near = [k for k in kept.get(t, []) if day.get(seq) is None or day.get(k) is None or abs((day[seq] - day[k]).days) <= 7]
            home[seq] = near[0] if near else seq
            if not near:
                kept.setdefault(t, []).append(seq)
    last = {seq: home.get(root[seq], root[seq]) for seq in root}
    while any(last[v] != v for v in last.values()):
        last = {k: last[v] for k, v in last.items()}
    return last


def test_resolution_matches_going_row_by_row(spark):
    rng = random.Random(12)
    rows = []
    for i in range(1, 121):
        url = rng.choice(["", f"https://else.id/{rng.randint(1, 40)}", f"https://own.id/articles/{i}-slug-{rng.randint(1, 25)}"])
        refs = [f"https://else.id/{rng.randint(1, 40)}" for _ in range(rng.choice([0, 0, 0, 1, 2]))]
        date = None if rng.random() < 0.2 else datetime.date(2024, 1, 1) + datetime.timedelta(days=rng.randint(0, 40))
        rows.append((i, rng.choice("abc"), url, f"Judul panjang nomor {rng.randint(1, 12)}", rng.choice(["", f"isi {i}"]), date, refs))
    table = spark.createDataFrame(rows, "seq long, source string, url string, title string, narrative string, date date, ref_urls array<string>")
    got = {r.seq: (r.n_merged, r.narrative) for r in resolve.resolve_articles(table, "own.id").collect()}
    last = merged_one_by_one(rows)
    members = {}
    for r in rows:
        members.setdefault(last[r[0]], []).append(r)
    assert got == {k: (len(m) - 1, next((r[4] for r in m if r[4]), "")) for k, m in members.items()} and len(got) < 100


def test_sinks_and_streams(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "b")], "id long, x string")
    sinks.write_jsonl(df.coalesce(1), str(tmp_path / "j"))
    assert {tuple(json.loads(x.value)) for x in spark.read.text(str(tmp_path / "j")).collect()} == {("id", "x")}
    seal = spark.createDataFrame(sinks.row_hashes(df, "id").collect())
    changed = spark.createDataFrame([(1, "new"), (3, "c")], "id long, x string")
    assert {(r.key, r.difference) for r in sinks.seal_differences(changed, "id", seal).collect()} == {(1, "berubah"), (2, "hilang"), (3, "baru")}
    at = datetime.datetime(2024, 1, 1)
    rows = [("https://x.id/a", None, at, None), ("http://www.x.id/a/", None, at, None), ("https://x.id/b", "galat", at, None)]
    spark.createDataFrame(rows, "url string, error string, crawled_at timestamp, date date").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("url string, error string, crawled_at timestamp, date date").parquet(str(tmp_path / "in"))
    ingest.start_ingest(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    batch = spark.createDataFrame([("https://x.id/a",), ("https://x.id/b",)], "url string")
    bronze = spark.read.parquet(str(tmp_path / "in"))
    assert [r.url for r in ingest.unseen(batch, bronze).collect()] == ["https://x.id/b"]
