"""Queries that plant cases into given tables: a row's id picks a case, its own words fill it, and SQL says what must come out."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clearsift.functions import arrays, dates_numbers, helpers, json_replies, labels, text
from clearsift.operators import alignment, claims, decide, evaluation, faithful, features, lines, masking, messages, reports, resolve, screen, spans
from clearsift.plans import fixture_queries
from clearsift.sources.html_pages import article_record, listing_rows
from clearsift.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Of each function: its name, the function, and pairs of a text in which {n}, {k} and {t} stand for a part's name (two lower-case
#: words), key and type (one upper-case word), and the SQL expression over n, k, ks (the key as text) and t of what must come out.
Cases = list[tuple[str, Callable[[Column], Column], list[tuple[str | None, str]]]]
_PART = "SELECT p_partkey AS k, p_partkey::VARCHAR AS ks, p_name AS n, p_type AS t FROM part"


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table whose rows lie in as many partitions as Spark shuffles into: planted cases make much work of a small file."""
    rows, n = fixture_queries.table(spark, d, name), int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n) if rows.rdd.getNumPartitions() < min(n, spark.sparkContext.defaultParallelism) else rows


def chosen(key: Column, values: list) -> Column:
    """The value of a list that a key picks."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))


def filled(template: Column) -> Column:
    for mark, column in (("{n}", "p_name"), ("{k}", "p_partkey"), ("{t}", "p_type")):
        template = F.replace(template, F.lit(mark), F.col(column).cast("string"))
    return template


def plain_double(name: str) -> Column:
    """A double as text without an exponent from ten million on, as SQL shows it."""
    x = F.col(name).cast("string")
    digits = F.regexp_replace(x.try_cast("decimal(38,18)").cast("string"), r"(\.\d+?)0+$", "$1")
    return F.when(F.abs(name).between(1e7, 1e15), digits).otherwise(x)


def function_cases(name: str, cases: Cases) -> None:
    """Registers a query (function, k, result) that applies every function to every part; results are shown as text or JSON."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        parts = []
        for function, f, pairs in cases:
            rows = table(spark, d, "part").select(F.col("p_partkey").alias("k"), filled(chosen(F.col("p_partkey"), [x for x, _ in pairs]).cast("string")).alias("x"))
            out = rows.select(F.lit(function).alias("function"), "k", f(F.col("x")).alias("result"))
            kind = out.schema["result"].dataType.typeName()
            shown = F.to_json("result") if kind in ("array", "struct", "map") else plain_double("result") if kind == "double" else F.col("result").cast("string")
            parts.append(out.select("function", "k", shown.alias("result")))
        return reduce(DataFrame.unionByName, parts)

    def sql(function: str, pairs: list) -> str:
        choices = " ".join(f"WHEN {i} THEN {y}" for i, (_, y) in enumerate(pairs))
        return f"SELECT '{function}' AS function, k, CASE k % {len(pairs)} {choices} END AS result FROM p"

    QUERIES[name] = run
    ORACLE_SQL[name] = f"WITH p AS ({_PART}) " + " UNION ALL ".join(sql(function, pairs) for function, _, pairs in cases)


def _sentences(x: Column) -> Column:
    return F.filter(F.split(F.coalesce(x, F.lit("")), r"\|"), lambda s: s != "")


def _two(x: Column) -> tuple[Column, Column]:
    """A case with two texts, divided by a bar."""
    return F.element_at(F.split(x, r"\|"), 1), F.element_at(F.split(x, r"\|"), 2)


_WORDS = "string_split(n, ' ')"

function_cases("text_functions", [
    ("squeeze", text.squeeze, [("  {n} \n {t} ", "n || ' ' || t"), (None, "''"), ("\t{n}", "n")]),
    ("normal_line", text.normal_line, [(" {n}\t{t} ", "n || ' ' || lower(t)"), ("ＡＢＣ　{k}", "'abc ' || ks"), ("ﬁ{n} … x²", "'fi' || n || ' ... x2'"), ("e\u0301{n} o\u0327\u0302 ㎏ ①", "'é' || n || ' ' || chr(244) || chr(807) || ' kg 1'")]),
    ("line_core", text.line_core, [("• {n}!", "n"), ("{k}%", "ks || '%'"), ("({k}G+)", "ks || 'g+'")]),
    ("line_tokens", lambda x: text.line_tokens(text.line_core(x)), [("{n} · {t}", f"""'["' || array_to_string({_WORDS}, '","') || '","' || lower(t) || '"]'"""), ("...", "'[]'")]),
    ("flatten_text", text.flatten_text, [("lihat https:// {t}.id\n/{k}", "'lihat https://' || t || '.id /' || ks"), ("{n}\n\n{n}", "n || ' ' || n")]),
    ("cut_at_word", lambda x: text.cut_at_word(x, 12), [("{n} {t} {k} x", "CASE WHEN length(n || ' ' || t) <= 12 THEN n || ' ' || t ELSE n END"), ("{t}", "t")]),
    ("tidy", lambda x: text.tidy(x, 12), [(' "{n} sangat panjang" ', "regexp_replace(substr(n || ' sangat', 1, 12), ' [^ ]*$', '') || '…'"), ("= {n} =", "n")]),
    ("cut_with_ellipsis", lambda x: text.cut_with_ellipsis(x, 13), [("{n} sangat panjang", "n || '…'"), ("{n}", "n")]),
    ("whole_sentences", lambda x: text.whole_sentences(_sentences(x), 14), [("{n}.|a b.|lebih panjang lagi dari itu.", "CASE WHEN length(n) <= 8 THEN n || '. a b.' ELSE n || '.' END"), ("kalimat {n} panjang sekali.|x", "'kalimat ' || n || ' panjang sekali.'")]),
    ("alnum_count", text.alnum_count, [("{n}-{k}!", "(length(n) - 1 + length(ks))::VARCHAR"), ("é ü{t}", "(2 + length(t))::VARCHAR"), (None, "'0'")]),
    ("digit_count", text.digit_count, [("{n}{k}x{k}", "(2 * length(ks))::VARCHAR")]),
    ("title_label", text.title_label, [("[{t}] Judul {n}", "t"), ("({t}) : {n}", "t"), ("HOAX: {n}", "'HOAX'"), ("[SALAH {n}", "'SALAH'"), ("Salah] {n}", "'Salah'"), ("{n}", "''")]),
    ("bare_title", text.bare_title, [("[{t}] Judul {n}", "'Judul ' || n"), ("({t}) : {n}", "n"), ("HOAX: {n}", "n"), ("[SALAH {n}", "n"), ("Salah] {n}", "n"), (" {n} ", "n")]),
    ("title_key", text.title_key, [("[SALAH] {n}, & {k}!", "replace(n, ' ', '') || ks"), (None, "''")]),
    ("url_key", text.url_key, [(" HTTPS://www.{t}.id/{k}/#b ", "lower(t) || '.id/' || ks"), ("http://{t}.id", "lower(t) || '.id'")]),
    ("slug_key", text.slug_key, [("https://x.id/2024/10/30/slug-{k}/", "'slug-' || ks"), ("https://x.id/articles/{k}-slug-{t}?x=1", "'slug-' || lower(t)")]),
    ("is_dated_permalink", lambda x: text.is_dated_permalink(x, r"x\.id"), [("https://x.id/2024/10/30/{t}/", "'true'"), ("https://x.id/articles/{k}-a", "'false'"), ("https://y.id/2024/10/30/{t}/", "'false'"), (None, "'false'")]),
    ("stable_id", text.stable_id, [("{n}{k}", "substr(sha1(n || ks), 1, 12)")]),
    ("passage_text", lambda x: text.passage_text(*_two(x)), [("[SALAH] {n}|{t} ", "'passage: ' || n || '. ' || t"), ("{n}|", "'passage: ' || n")]),
    ("narrative_section", text.narrative_section, [("[NARASI]: isi {n} [PENJELASAN]: bukan", "'isi ' || n"), ("{n}", "''"), ("NARASI: {n} Hasil Periksa Fakta {t}", "n")]),
    ("narrative_before_rebuttal", text.narrative_before_rebuttal, [("Penjelasan : Kabar {n}. Faktanya, salah.", "'Kabar ' || n || '.'")]),
    ("repair_links", text.repair_links, [("lihat https://\n{t}.id/{k} segera\nlagi", "'lihat https://' || t || '.id/' || ks || chr(10) || 'segera' || chr(10) || 'lagi'"), ("https://\n{n}", "'https://' || chr(10) || n")]),
    ("simple_sentences", text.simple_sentences, [("{n}. C{k}! D", """'["' || n || '.","C' || ks || '!","D"]'"""), (None, "'[]'")]),
    ("anonymous_trigger", text.anonymous_trigger, [("kirim {k} ke https://www.{t}.id/abc", "'kirim … ' || lower(t) || '.id'"), ("segera {k}", "'segera ' || repeat('#', length(ks))")]),
    ("search_link", lambda x: text.search_link("https://x.id/?s=", x), [(" {n}&c ", "'https://x.id/?s=' || replace(n, ' ', '+') || '%26c'")]),
    ("strip_code_fence", text.strip_code_fence, [('```json\n{"{n}": 1}\n```', """'{"' || n || '": 1}'"""), ("{t}", "t")]),
    ("bytes_for_people", lambda x: text.bytes_for_people(x.cast("long")), [("{k}", "CASE WHEN k < 1024 THEN ks || ' B' WHEN k < 1048576 THEN format('{:,.1f}', k / 1024.0) || ' KB' WHEN k < 1073741824 THEN format('{:,.1f}', k / 1048576.0) || ' MB' ELSE format('{:,.2f}', k / 1073741824.0) || ' GB' END"), ("3145728", "'3.0 MB'")]),
    ("clean_page_text", text.clean_page_text, [("[NARASI]:\nIsi  {n} https://x.id/{k} di sini\n\n\nLagi\nPenjelasan: bukan", "'Isi ' || n || ' di sini' || chr(10) || 'Lagi'"), (None, "''")]),
    ("server_address", text.server_address, [("10.0.2.{k}", "'http://10.0.2.' || ks || ':8000'"), ("{t}.id/", "'https://' || lower(t) || '.id'"), (" http://192.168.1.5:9000/ ", "'http://192.168.1.5:9000'"), ("", "NULL"), ("{t}.id/{n}", "NULL"), ("http://", "NULL"), ("http://{t}.id", "'http://' || lower(t) || '.id'")]),
])


def _box() -> Column:
    return F.struct(*[F.lit(float(v)).alias(n) for n, v in (("l", 10), ("t", 10), ("r", 30), ("b", 40))])


def _point(x: Column) -> tuple[Column, Column]:
    a, b = _two(x)
    return a.cast("double"), b.cast("double")


def _number(x: Column) -> Column:
    return F.regexp_extract(x, r"(\d+)", 1).try_cast("long")


def _pixels(x: Column) -> Column:
    view = F.struct(F.lit(100.0).alias("w"), F.lit(200.0).alias("h"))
    image = F.struct(F.lit(50).alias("w"), F.lit(50).alias("h"))
    side = lambda i: F.element_at(F.split(x, ","), i).cast("double")
    return dates_numbers.view_to_pixels(F.struct(side(1).alias("l"), side(2).alias("t"), side(3).alias("r"), side(4).alias("b")), view, image)


_DAY = "(DATE '2020-01-01' + (k % 2000)::INT)"
_MONTHS = "['Januari','Februari','Maret','April','Mei','Juni','Juli','Agustus','September','Oktober','November','Desember']"
_X = "(k % 61 - 5)"  # a coordinate on both sides of the box

function_cases("number_functions", [
    ("dates_near", lambda x: dates_numbers.dates_near(F.lit("2024-01-10").cast("date"), F.date_add(F.lit("2024-01-01").cast("date"), (_number(x) % 30).cast("int"))), [("{k}", "(k % 30 BETWEEN 2 AND 16)::VARCHAR")]),
    ("year_bucket", lambda x: dates_numbers.year_bucket(F.date_add(F.lit("2020-01-01").cast("date"), (_number(x) % 2000).cast("int"))), [("{k}", f"year({_DAY})::VARCHAR"), ("{n}", "'tanpa tanggal'")]),
    ("long_date", lambda x: dates_numbers.long_date(F.date_add(F.lit("2020-01-01").cast("date"), (_number(x) % 2000).cast("int"))), [("{k}", f"day({_DAY}) || ' ' || {_MONTHS}[month({_DAY})] || ' ' || year({_DAY})")]),
    ("months_in", faithful.months_in, [("1 Nov {n}, lalu 26/1/2026 dan Mei", "'[1,5,11]'"), ("{n} {k}", "'[]'"), ("pada 3 Juli {k}", "'[7]'")]),
    ("number_value", lambda x: dates_numbers.number_value(x).cast("double"), [("1.{k}", "CASE WHEN length(ks) = 3 THEN (1000 + k)::VARCHAR || '.0' ELSE ('1.' || ks)::DOUBLE::VARCHAR END"), ("{k},5", "(k + 0.5)::DOUBLE::VARCHAR"), ("1.500.000", "'1500000.0'")]),
    ("numbers_in", lambda x: F.array_join(F.transform(dates_numbers.numbers_in(x), lambda v: v.cast("long").cast("string")), ","), [("{n} {k} juta dan {k} ribu", "CASE WHEN k = 0 THEN '0' ELSE (k * 1000000) || ',' || (k * 1000) END"), ("{n}", "''"), ("1,5 juta x {k} milyar", "CASE WHEN k = 0 THEN '0,1500000' ELSE '1500000,' || (k * 1000000000) END")]),
    ("duration_seconds", lambda x: F.round(dates_numbers.duration_seconds(x), 2), [("{k}m30.5s", "(k * 60 + 30.5)::DOUBLE::VARCHAR"), ("{k}ms", "(floor(k / 10.0 + 0.5) / 100)::DOUBLE::VARCHAR"), ("{k}", "k::DOUBLE::VARCHAR"), ("{n}", "NULL")]),
    ("unit_score", lambda x: dates_numbers.unit_score(x.cast("double") / 1000), [("{k}", "least(1.0, k / 1000.0)::DOUBLE::VARCHAR"), ("-{k}", "CASE WHEN k = 0 THEN '-0.0' ELSE '0.0' END")]),
    ("fit_within", lambda x: dates_numbers.fit_within(*_point(x), 100), [("400|200", """'{"w":100,"h":50}'"""), ("{k}|20", """CASE WHEN k <= 100 THEN '{"w":' || ks || ',"h":20}' ELSE '{"w":100,"h":' || greatest(1, floor(2000.0 / k + 0.5)::INT) || '}' END""")]),
    ("view_to_pixels", _pixels, [("0,50,50,100", """'{"x":0,"y":0,"w":25,"h":25}'"""), ("-{k},0,1,51", """'{"x":0,"y":0,"w":1,"h":1}'""")]),
    ("centre_y", lambda x: dates_numbers.centre_y(F.transform(F.filter(F.split(x, ","), lambda v: v != ""), lambda v: F.struct(F.lit(0.0).alias("x"), v.cast("double").alias("y")))), [("{k},30", "((k + 30) / 2.0)::DOUBLE::VARCHAR"), ("", "'0.0'")]),
    ("handle_at", lambda x: helpers.handle_at(_box(), (_number(x) % 61 - 5).cast("double"), F.lit(25.0), 4.0), [("{k}", f"CASE WHEN {_X} BETWEEN 6 AND 14 THEN 'kiri' WHEN {_X} BETWEEN 26 AND 34 THEN 'kanan' WHEN {_X} BETWEEN 10 AND 30 THEN 'dalam' END")]),
    ("moved_box", lambda x: helpers.moved_box(_box(), (_number(x) % 61 - 30).cast("double"), F.lit(-50.0), F.lit(50.0), F.lit(50.0))["l"], [("{k}", "greatest(0, least(30, 10 + k % 61 - 30))::DOUBLE::VARCHAR")]),
    ("resized_box", lambda x: helpers.resized_box(_box(), F.lit("kiri"), (_number(x) % 61 - 5).cast("double"), F.lit(0.0), F.lit(50.0), F.lit(50.0), 5.0)["l"], [("{k}", f"greatest(0, least(25, {_X}))::DOUBLE::VARCHAR")]),
    ("drawn_box", lambda x: helpers.drawn_box(F.lit(30.0), F.lit(40.0), (_number(x) % 51).cast("double"), F.lit(20.0), F.lit(50.0), F.lit(50.0), 5.0)["t"], [("{k}", "'20.0'")]),
])

_IDS = ["a", "b"]
_FENCED = '```json\n{"klaim_utama": "{n}", "ciri": [{"id": "a", "kutipan": ["{t}", 1, "y", "z", "w"]}, {"id": "q", "kutipan": ["x"]}, {"id": "a", "kutipan": ["later"]}, {"id": "b"}]}\n```'

function_cases("reply_functions", [
    ("parse_reply", lambda x: json_replies.parse_reply(x, _IDS), [(_FENCED, """'{"claim":"' || n || '","features":[{"id":"a","quotes":["' || t || '","y","z"]}]}'"""), ("[]", "NULL"), ("{n}", "NULL"), ('{"klaim_utama": {k}, "ciri": []}', "NULL"), ('{"klaim_utama": "{n}"}', "NULL")]),
    ("reply_problems", lambda x: json_replies.reply_problems(x, _IDS), [('{"klaim_utama": {k}, "ciri": [{"id": "{t}"}]}', """'{"problems":["klaim bukan teks"],"foreign_ids":["' || t || '"]}'"""), ("{n}", """'{"problems":["bukan json"],"foreign_ids":[]}'""")]),
    ("provider_error_code", lambda x: json_replies.provider_error_code(x, F.lit(400)), [('{"error": {"code": "rate_{t}", "message": "m"}}', "'rate_' || t"), ('{"errors": [{"code": {k}}]}', "'cf_' || ks"), ("{n}", "'http_400'")]),
    ("gateway_error_code", lambda x: json_replies.gateway_error_code(F.lit(None).cast("string"), x), [("<p>err_ngrok_3{k}</p>", "'ERR_NGROK_3' || ks"), ("{n}", "NULL")]),
    ("quota_of", json_replies.quota_of, [("Limit 6000, Used {k}, Requested 300. Please try again in 2m3.5s", """'{"limit":6000,"used":' || ks || ',"requested":300}'""")]),
    ("wait_seconds", lambda x: json_replies.wait_seconds(F.lit(None).cast("string"), x), [("please try again in {k}m3.5s.", "(k * 60 + 3.5)::DOUBLE::VARCHAR"), ("{n}", "NULL")]),
    ("token_usage", lambda x: F.coalesce(json_replies.token_usage(x)["prompt"], F.lit(-1)), [('{"usage": {"prompt_tokens": {k}, "completion_tokens": "x"}}', "ks"), ('{"usage": {"prompt_tokens": "{k}.5"}}', "'-1'")]),
    ("reply_content", json_replies.reply_content, [('{"choices": [{"message": {"content": "{n}"}, "finish_reason": "length"}]}', """'{"content":"' || n || '","truncated":true}'"""), ('{"choices": [{"message": {"content": "{n}"}, "finish_reason": "stop"}]}', """'{"content":"' || n || '","truncated":false}'""")]),
    ("decode_enum", lambda x: json_replies.decode_enum(x, {"kuat": "merah"}), [("kuat", "'merah'"), ("{n}", "'tidak_dikenal'")]),
    ("normal_label", labels.normal_label, [("SALAH", "'salah'"), ("Penipuan", "'penipuan'"), ("belum  terbukti", "'belum_terbukti'"), ("KLARIFIKASI", "'klarifikasi'"), ("satire", "'satir'"), ("BENAR", "'benar'"), ("Fakta", "'benar'"), ("EDUKASI", "'bukan_cek_fakta'"), ("CEK FAKTA", "'bukan_cek_fakta'"), ("", "'lainnya'"), ("{n}", "'lainnya'"), ("DISINFOMASI", "'salah'")]),
    ("label_with_verdict", lambda x: labels.label_with_verdict(*_two(x)), [("ISU {n}|Benar", "'lainnya'"), ("ISU|Benar", "'klarifikasi'"), ("SALAH|Benar", "'salah'"), ("|salah", "'salah'")]),
    ("level_text", lambda x: screen.level_text(*_two(x)), [("hati_hati|mirip", "'Perlu hati-hati: mirip artikel cek fakta'"), ("{t}|", "t")]),
])


def _words(x: Column) -> Column:
    return F.split(x, " ")


_FIRST, _SECOND = "string_split(n, ' ')[1]", "string_split(n, ' ')[2]"

function_cases("array_functions", [
    ("content_words", lambda x: F.sort_array(arrays.content_words(x)), [("Yang ini {t} b{k} {t}", """CASE WHEN 'b' || ks < lower(t) THEN '["' || concat_ws('","', CASE WHEN length(ks) > 1 THEN 'b' || ks END, lower(t)) || '"]' ELSE '["' || lower(t) || '"]' END"""), (None, "'[]'")]),
    ("word_in", lambda x: arrays.word_in(_two(x)[0], _words(_two(x)[1])), [("kaya{k}|terkaya{k} lain", "'true'"), ("air|airnya {n}", "'false'"), ("air|air {n}", "'true'")]),
    ("word_in_misread", lambda x: arrays.word_in_misread(_two(x)[0], _words(_two(x)[1])), [("garuda|garudo {n}", "'true'"), ("merdeka|merdvka x", "'true'"), ("garuda|gerudo {n}", "'false'"), ("2024a|2025a {n}", "'false'"), ("abcd|abce {n}", "'false'")]),
    ("words_found", lambda x: arrays.words_found(_words(_two(x)[0]), _words(_two(x)[1])), [("garam {n} laut|garamnya laut", "'2'"), ("{n}|{n}", "'2'")]),
    ("jaccard", lambda x: arrays.jaccard(_words(_two(x)[0]), _words(_two(x)[1])), [("{n}|{n} x y", "'0.5'"), ("{n}|{n}", "'1.0'"), ("{n}|z", "'0.0'")]),
    ("quotes_found", lambda x: arrays.quotes_found(F.split(_two(x)[0], ";"), _two(x)[1]), [("Satu  {n};x|isi satu {n} tiga", "'1'")]),
    ("share_found", lambda x: arrays.share_found(_words(_two(x)[0]), _two(x)[1]), [("garam {t}|Garamnya asin", "'0.5'")]),
    ("merge_evidence", lambda x: arrays.merge_evidence(F.split(_two(x)[0], ";"), F.split(_two(x)[1], ";")), [("{n};cd|x{n}y;ef", """'["' || n || '","cd","ef"]'""")]),
    ("best_window", lambda x: F.array_join(arrays.best_window(_words(_two(x)[0]), _words(_two(x)[1]), 3), " "), [("a b c d {n}|d {n}", "'d ' || n"), ("{n}|a", "n")]),
    ("wrap_words", lambda x: arrays.wrap_words(_words(x), 9), [("satu dua tiga x{t}{t} {k}", """'["satu dua","tiga","x' || t || t || '","' || ks || '"]'""")]),
    ("class_runs", lambda x: arrays.class_runs(x, "0-9"), [("ab{k}{t}", """'["ab","' || ks || '","' || t || '"]'"""), ("", "'[]'")]),
    ("dedup_ordered", lambda x: arrays.dedup_ordered(_words(x)), [("b {n} b {n} c", f"""'["b","' || {_FIRST} || '","' || {_SECOND} || '","c"]'""")]),
    ("closest_passage", lambda x: arrays.closest_passage(_two(x)[0], _words(_two(x)[1]), F.array().cast("array<string>"), 30)["passage"], [("akun Air garam menyembuhkan x|garam menyembuhkan luka", "'Air garam menyembuhkan x'")]),
    ("masked_quote", lambda x: features.masked_source_quote(_two(x)[1], _two(x)[0]), [("hubungi [NOMOR] segera|Tolong hubungi 0812-3456-7{k} segera ya", "CASE WHEN length(ks) <= 6 THEN 'hubungi 0812-3456-7' || ks || ' segera' END"), ("kirim ke [EMAIL]|kirim ke {t}@c.id", "'kirim ke ' || t || '@c.id'"), ("tidak ada [AKUN]|{n}", "NULL")]),
    ("source_quote", lambda x: features.source_quote(_two(x)[1], _two(x)[0]), [("dua {t}|Satu  DUA\n{t}", "'DUA ' || t"), ("x|{n}", "NULL")]),
    ("link_kind", lambda x: features.link_kind(F.array(x)), [("lihat bit.ly/{k}", "'pemendek'"), ("{t}.xyz", "'situs_gratis'"), ("www.{t}.id", "'umum'")]),
    ("quote_reject_reason", lambda x: features.quote_reject_reason(_two(x)[0], _two(x)[1], F.lit(False)), [("link_mencurigakan|klik {n}", "'bukan_bentuk_tautan'"), ("kapital_tanda_seru|biasa {n}", "'bukan_kapital_atau_seru'"), ("judul_clickbait|{n}", "'terlalu_pendek'"), ("judul_clickbait|{n} penuh", "NULL")]),
    ("similar_ratio", lambda x: faithful.similar_ratio(*_two(x)), [("{n}|{n}x", "round(2.0 * length(n) / (2 * length(n) + 1), 4)::DOUBLE::VARCHAR"), ("{n}|#%!", "'0.0'"), ("|", "'1.0'")]),
    ("stem_candidates", lambda x: F.array_contains(faithful.stem_candidates(_two(x)[0]), _two(x)[1]), [("menipu|tipu", "'true'"), ("menyapu|sapu", "'true'"), ("bantuan|bantu", "'true'"), ("air|ir", "'false'"), ("{n}|zzz", "'false'")]),
    ("rotated", lambda x: helpers.rotated(_sentences(x)), [("{n}.|B.|C.", "'B. C. ' || n || '.'")]),
    ("chain_letter", lambda x: helpers.chain_letter(_sentences(x), "Info!", "Sebarkan"), [("{n}.|B.", "'Info! ' || n || '. B. Sebarkan'")]),
    ("with_synonyms", lambda x: helpers.with_synonyms(x, {"beredar": "tersebar"}), [("Beredar {n}, beredar.", "'Tersebar ' || n || ', tersebar.'")]),
    ("thresholds_from_text", lambda x: helpers.thresholds_from_text(x, {"s": "similar", "r": "relevance"}), [("s=0.5, r = {k},x=1", """'{"similar":0.5,"relevance":' || ks || '.0}'"""), ("s={n}", "'{}'")]),
    ("threshold_grid", lambda x: helpers.threshold_grid(x, {"s": "similar", "r": "relevance"}), [("s=0.5:0.6:0.1,r={k}", """'[{"similar":0.5,"relevance":' || ks || '.0},{"similar":0.6,"relevance":' || ks || '.0}]'"""), ("s=0.1/0.2", """'[{"similar":0.1},{"similar":0.2}]'"""), ("s=0:1:0.001", "NULL")]),
    ("settings_from_lines", helpers.settings_from_lines, [("# x\nA={k}\nB = '{n}' \nrusak\nA=2", """'{"A":"' || ks || '","B":"' || n || '"}'""")]),
    ("typed_setting", lambda x: helpers.typed_setting(x, 5.0), [("2,{k}", "NULL"), ("{k}.5", "(k + 0.5)::DOUBLE::VARCHAR"), ("-1", "NULL"), (None, "'5.0'"), (" ", "'5.0'")]),
    ("forbidden_path", lambda x: helpers.forbidden_path(x, [".env"]), [("{t}/.env/b", "'true'"), ("{t}/env", "'false'")]),
    ("retry_wait", lambda x: helpers.retry_wait(F.transform(F.split(_two(x)[0], ","), lambda v: v.cast("int")), _two(x)[1].cast("double")), [("429|{k}", "greatest(1, least(k, 90))::DOUBLE::VARCHAR"), ("200,429|5", "'5.0'"), ("200|{k}", "NULL")]),
    ("overlaid", lambda x: helpers.overlaid(x, F.lit("asal")), [("{n}", "n"), (None, "'asal'")]),
])

function_cases("line_functions", [
    ("line_reason", lines.line_reason, [
        ("{k} rb suka", "'angka interaksi'"), ("Ikuti Balas Kirim", "'tombol atau aksi'"), ("Komentar · Share · Simpan", "'tombol atau aksi'"), ("follow repost kirim save", "NULL"), ("Beranda", "'menu situs'"), ("Log in", "'menu situs'"), ("1{k} jam lalu", "'penanda waktu'"), ("0 menit", "NULL"),
        ("10.45 dibaca", "'jam obrolan'"), ("Lihat terjemahan", "'terjemahan atau sponsor'"), ("Ketik pesan", "'UI aplikasi pesan'"), ("•••", "'tanpa huruf atau angka'"), ("Warga melihat {n} di pasar", "NULL"), ("Kirim {n}", "NULL"), ("", "'tanpa huruf atau angka'"), ("{k} Mengikuti", "'angka interaksi'")]),
    ("status_bar", lambda x: lines.line_reason(x, F.lit(20.0), F.lit(1000)), [("10:45 4G 97%", "'bilah status (pita atas)'"), ("09.10 LTE | Wi-Fi 5%", "'bilah status (pita atas)'"), ("1.2KB/s VoLTE 23:59", "'bilah status (pita atas)'"), ("10:45 {n}", "NULL")]),
    ("below_the_bar", lambda x: lines.line_reason(x, F.lit(90.0), F.lit(1000)), [("10:45 4G 97%", "NULL")]),
    ("read_also", lambda x: lines.line_reason(x, read_also=True), [("Baca juga: {n}", "'baca juga'"), ("Lihat selengkapnya", "'baca juga'"), ("{n} baca juga", "NULL")]),
    ("mask_text", masking.mask_text, [("hubungi 0812-3456-7890 atau {t}@c.id", "'hubungi [NOMOR] atau [EMAIL]'"), ("jam 08.30 {n} 08-08-2026", "'jam 08.30 ' || n || ' 08-08-2026'"), ("lihat https://x.id/0812345678901 dan @akun_{t}", "'lihat https://x.id/0812345678901 dan [AKUN]'"), ("+62 82", "'[NOMOR]'"), (None, "''")]),
    ("is_account_line", masking.is_account_line, [("user_{k} dua.tiga9", "'true'"), ("kalimat {n} saja", "'false'")]),
    ("split_sentences", claims.split_sentences, [
        ("{n} satu. Tiga {t}! Lima?", """'["' || n || ' satu.","Tiga ' || t || '!","Lima?"]'"""), ("Kata dr. Joko {n}. Selesai.", """'["Kata dr. Joko ' || n || '.","Selesai."]'"""), ("Harga {k}. 16 rupiah. Baru.", """'["Harga ' || ks || '. 16 rupiah.","Baru."]'"""),
        ("Lihat www.{t}.id. Lalu pulang.", """'["Lihat www.' || t || '.id. Lalu pulang."]'"""), ("Oleh A. Rahman {n}. lanjut kecil.", """'["Oleh A. Rahman ' || n || '. lanjut kecil."]'"""), (None, "'[]'")]),
    ("addresses_reader", claims.addresses_reader, [("rumahmu {n}", "'true'"), ("ilmu dan tamu {t}", "'false'")]),
    ("sentence_score", lambda x: claims.sentence_score(x, F.array().cast("array<string>")), [("Pemerintah resmi menutup 12 pasar di kota {t} mulai besok.", "'5.0'"), ("Apakah benar pemerintah menutup pasar {n}?", "NULL"), ("{n} saja ini", "NULL")]),
    ("claim_from_evidence", claims.claim_from_evidence, [("bank akan menutup rekening {t} nasabah dan di", "'bank akan menutup rekening ' || t || ' nasabah'"), ("akun kamu akan ditutup {n}", "NULL")]),
    ("claim_reject_reason", lambda x: claims.claim_reject_reason(*_two(x), ["palsu"]), [("|{n}", "'kosong'"), ("Berita palsu beredar|Berita beredar {n}", "'penilaian_baru'"), ("Berita beredar|Berita beredar {n}", "NULL"), ("gajah terbang|{n} tidur", "'tidak_setia'")]),
])


_KINDS = ["url_belum_diatur", "tidak_terjangkau", "waktu_habis", "cleartext", "respons", "tidak_aktif", "server"]
_CODES = ["teks_tidak_terbaca", "terlalu_besar", "gambar_kosong", "bukan_gambar", "server_sibuk", "lain"]
_CARD_SQL = """CASE kind WHEN 'url_belum_diatur' THEN 'url' WHEN 'cleartext' THEN 'cleartext' WHEN 'server' THEN CASE code WHEN 'teks_tidak_terbaca' THEN 'teks' WHEN 'terlalu_besar' THEN 'besar' WHEN 'server_sibuk' THEN 'sibuk' WHEN 'lain' THEN 'server' ELSE 'gambar' END ELSE kind END"""


@query(f"""WITH e AS (SELECT c_custkey AS k, {_KINDS}[c_custkey % 7 + 1] AS kind, {_CODES}[c_custkey // 7 % 6 + 1] AS code FROM customer), f AS (SELECT *, {_CARD_SQL} AS name FROM e)
SELECT k, 'galat_isi_' || name AS body, CASE WHEN name IN ('url', 'cleartext', 'respons') THEN 'BUKA_PENGATURAN' WHEN name IN ('teks', 'besar', 'gambar') THEN 'PILIH_ULANG' ELSE 'COBA_LAGI' END AS action, name = 'tidak_terjangkau' AS settings,
CASE WHEN name IN ('url', 'cleartext') THEN 'galat_isi_server' WHEN name = 'respons' THEN 'galat_isi_respons_rilis' ELSE 'galat_isi_' || name END AS body_without, name IN ('teks', 'besar', 'gambar') AS choose_without,
CASE kind WHEN 'url_belum_diatur' THEN 'galat_url_belum_diatur' WHEN 'respons' THEN 'galat_respons_tidak_dikenali' WHEN 'tidak_aktif' THEN 'galat_server_tidak_aktif'
  WHEN 'server' THEN CASE code WHEN 'teks_tidak_terbaca' THEN 'galat_teks_tidak_terbaca' WHEN 'terlalu_besar' THEN 'galat_terlalu_besar' WHEN 'server_sibuk' THEN 'galat_server_sibuk' WHEN 'lain' THEN 'galat_server' ELSE 'galat_gambar_rusak' END ELSE 'galat_' || kind END AS message FROM f""")
def error_cards(spark: SparkSession, d: str) -> DataFrame:
    """Every kind of failure and code of the server over the customers: cards with and without settings, and messages."""
    kind, code = chosen(F.col("c_custkey"), _KINDS), chosen(F.floor(F.col("c_custkey") / 7), _CODES)
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), messages.error_card(kind, code, True).alias("a"), messages.error_card(kind, code, False).alias("b"), messages.error_message(kind, code).alias("message"))
    return rows.select("k", F.col("a.body").alias("body"), F.col("a.action").alias("action"), F.col("a.settings").alias("settings"), F.col("b.body").alias("body_without"), (F.col("b.action") == "PILIH_ULANG").alias("choose_without"), "message")


_LEVELS, _VIEWS, _LABELS = ["kuat", "hati_hati", "tidak_ditemukan", "baru"], ["percaya", "ragu", "tidak_percaya", "dilewati"], [" Salah", "penipuan", "klarifikasi", "SATIR", "belum_terbukti", "benar", "lain"]


@query(f"""WITH e AS (SELECT c_custkey AS k, {_LEVELS}[c_custkey % 4 + 1] AS level, {_VIEWS}[c_custkey // 4 % 4 + 1] AS seen, c_custkey // 16 % 2 AS n, c_custkey // 32 % 3 AS arts, {_LABELS}[c_custkey % 7 + 1] AS label FROM customer),
f AS (SELECT *, CASE WHEN n > 0 THEN 'ciri' WHEN arts = 2 THEN 'satir' WHEN arts = 1 THEN 'artikel' ELSE 'umum' END AS cause, lower(trim(label)) AS l FROM e)
SELECT k, cause, 'banding_pesan_' || CASE WHEN seen = 'dilewati' THEN seen WHEN level = 'baru' THEN 'tidak_dikenal' WHEN level = 'tidak_ditemukan' THEN level || '_' || seen WHEN seen <> 'percaya' THEN 'ada_ciri_waspada' WHEN level = 'kuat' THEN 'kuat_percaya' ELSE 'hati_hati_percaya_' || cause END AS message,
'hasil_label_' || CASE WHEN l IN ('benar', 'lain') THEN 'rujukan' ELSE l END AS label_text, CASE WHEN l IN ('salah', 'penipuan') THEN 'MERAH' ELSE 'NETRAL' END AS style,
CASE WHEN level = 'tidak_ditemukan' THEN 'hasil_terbatas_arti_tidak_ditemukan' ELSE 'hasil_terbatas_arti' END AS meaning, CASE n WHEN 0 THEN 'hasil_terbatas_lain,hasil_terbatas_ai' ELSE 'hasil_terbatas_cek_fakta,hasil_terbatas_lain' END AS limited FROM f""")
def client_messages(spark: SparkSession, d: str) -> DataFrame:
    """Levels, assessments, causes, labels and limited checks in all combinations over the customers."""
    k, part = F.col("c_custkey"), lambda n: F.floor(F.col("c_custkey") / n)
    articles = F.when(part(32) % 3 == 0, F.array().cast("array<string>")).when(part(32) % 3 == 1, F.array(F.lit("salah"))).otherwise(F.array(F.lit("salah"), F.lit("satir")))
    rows = table(spark, d, "customer").select(k.alias("k"), chosen(k, _LEVELS).alias("level"), chosen(part(4), _VIEWS).alias("seen"), (part(16) % 2).alias("n"), articles.alias("articles"), chosen(k, _LABELS).alias("label"))
    rows = rows.withColumn("cause", messages.caution_cause(F.col("n"), F.col("articles"))).withColumn("shown", messages.article_label(F.col("label")))
    limited = F.when(F.col("n") == 0, F.array(F.lit("x"), F.lit(" AI "), F.lit("y"))).otherwise(F.array(F.lit("cek_fakta"), F.lit("z"), F.lit("cek_fakta")))
    return rows.select("k", "cause", messages.comparison_message(F.col("seen"), F.col("level"), F.col("cause")).alias("message"), F.col("shown.text").alias("label_text"), F.col("shown.style").alias("style"), messages.limited_meaning(F.col("level")).alias("meaning"), F.array_join(messages.limited_sentences(limited), ",").alias("limited"))


_SWEEP = """WITH s AS (SELECT p_partkey AS k, v.p AS profile, CASE WHEN p_size >= v.hi THEN 'kuat' WHEN p_size >= v.lo THEN 'hati_hati' ELSE 'tidak_ditemukan' END AS level, p_partkey % 3 = 0 AS positive,
  CASE WHEN p_partkey % 3 = 0 THEN 'kuat' ELSE 'tidak_ditemukan' END AS wanted FROM part, (VALUES ('a', 40, 30), ('b', 30, 20)) v(p, hi, lo))"""


def _decisions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    parts, positive = table(spark, d, "part"), F.col("p_partkey") % 3 == 0
    profile = lambda p, hi, lo: parts.select(F.col("p_partkey").alias("doc_id"), F.lit(p).alias("profile"), F.when(F.col("p_size") >= hi, "kuat").when(F.col("p_size") >= lo, "hati_hati").otherwise("tidak_ditemukan").alias("level"))
    expected = parts.select(F.col("p_partkey").alias("doc_id"), positive.alias("is_positive"), F.when(positive, "kuat").otherwise("tidak_ditemukan").alias("wanted"), F.when(positive, F.array(F.lit("hati_hati"))).otherwise(F.array().cast("array<string>")).alias("allowed"))
    return profile("a", 40, 30).unionByName(profile("b", 30, 20)), expected


@query(_SWEEP + """ SELECT profile, count(*) FILTER (WHERE NOT positive AND level = 'kuat') AS false_strong, count(*) FILTER (WHERE NOT positive AND level = 'hati_hati') AS false_caution, count(*) FILTER (WHERE NOT positive) AS n_negative,
round(count(*) FILTER (WHERE positive AND level <> 'tidak_ditemukan') / count(*) FILTER (WHERE positive), 6) AS recall, count(*) FILTER (WHERE positive AND level = 'kuat') AS true_strong, count(*) FILTER (WHERE positive) AS n_positive,
count(*) FILTER (WHERE level = wanted) AS as_wanted, count(*) FILTER (WHERE level = wanted OR (positive AND level = 'hati_hati')) AS as_allowed FROM s GROUP BY profile""")
def sweep_report(spark: SparkSession, d: str) -> DataFrame:
    """Two profiles of thresholds over all parts, against what was expected."""
    return reports.sweep_table(*_decisions(spark, d))


@query(_SWEEP + " SELECT a.k AS doc_id, a.level AS before, b.level AS after FROM s a JOIN s b ON a.k = b.k AND a.profile = 'a' AND b.profile = 'b' WHERE a.level <> b.level")
def report_differences(spark: SparkSession, d: str) -> DataFrame:
    """The report of one profile against the other as its baseline: the rows that differ."""
    decisions, expected = _decisions(spark, d)
    of = lambda p: decisions.filter(F.col("profile") == p).drop("profile")
    rows = of("b").join(expected, "doc_id").select("doc_id", "level", (F.col("wanted") == "kuat").cast("int").alias("expected"), (F.col("level") == "kuat").cast("int").alias("actual"), F.lit("x").alias("part"))
    report = reports.evaluation_report(rows, spark.createDataFrame([], "rank int"), "part", sweep=(decisions, expected), baseline=(of("a"), of("b")))
    return report["differences"]


@query("""WITH a AS (SELECT o_orderkey AS id, 'https://x.id/' || o_custkey AS url, o_orderpriority AS title FROM orders), m AS (SELECT url, title, min(id) AS id FROM a GROUP BY ALL)
SELECT c_custkey, m.id AS article_id FROM customer LEFT JOIN m ON m.url = 'https://x.id/' || c_custkey AND m.title = '2-HIGH'""")
def articles_by_url_and_title(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of which only address and title are known get the first article with both."""
    articles = table(spark, d, "orders").select(F.col("o_orderkey").alias("article_id"), F.concat(F.lit("https://x.id/"), "o_custkey").alias("url"), F.col("o_orderpriority").alias("title"))
    asked = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("https://x.id/"), "c_custkey").alias("url"), F.lit("2-HIGH").alias("title"))
    return reports.article_ids(asked, articles).select("c_custkey", "article_id")


@query(f"WITH p AS ({_PART}) SELECT k AS doc_id, CASE k % 3 WHEN 0 THEN 'wa [NOMOR] atau [EMAIL] ' || n WHEN 1 THEN 'buka toko' || ks || '.id/0812345678901 lalu [AKUN] ' || n ELSE 'hubungi [NOMOR] ' || n END AS text FROM p")
def simply_masked(spark: SparkSession, d: str) -> DataFrame:
    """The simple masker: addresses of mail, then numbers and accounts outside links."""
    body = chosen(F.col("p_partkey"), ["wa +62 812-3456.7890 atau {t}@c.id {n}", "buka toko{k}.id/0812345678901 lalu @akun_{t} {n}", "hubungi +1 202-555-0143 {n}"])
    return table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), masking.mask_simply(filled(body)).alias("text"))


# Cases of several rows: each part's, customer's or supplier's key makes its own group of rows.


def rows_of(parts: DataFrame, fields: str, rows: list[str]) -> DataFrame:
    """For every part as many rows as there are tuples, written as SQL over its columns."""
    names = [f.split()[0] for f in fields.split(", ")]
    made = ", ".join("struct(" + ", ".join(f"CAST({v} AS {f.split(None, 1)[1]}) AS {f.split()[0]}" for v, f in zip(r, fields.split(", "), strict=True)) + ")" for r in (_values(x) for x in rows))
    return parts.selectExpr("p_partkey", "p_name", "p_type", f"explode(array({made})) AS _r").select(*[F.col(f"_r.{n}").alias(n) for n in names])


def _values(row: str) -> list[str]:
    return [v.strip() for v in row.split(";")]


@query(f"""WITH p AS ({_PART}) SELECT k AS doc_id, pos, reason FROM p, (VALUES (0, 'menu situs'), (1, 'deret menu'), (2, 'deret menu'), (3, NULL), (4, 'banner sistem'), (5, 'banner sistem'), (6, NULL), (7, 'bilah status (pita atas)')) v(pos, reason)
WHERE k % 3 = 0 UNION ALL SELECT k, pos, CASE WHEN pos = 0 THEN 'menu situs' WHEN pos = 7 AND k % 3 = 1 THEN 'bilah status (pita atas)' END FROM p, (VALUES (0), (3), (6), (7)) v(pos) WHERE k % 3 <> 0""")
def page_lines(spark: SparkSession, d: str) -> DataFrame:
    """Pages of lines with places: on a third a menu row and a banner over two lines; without neighbours a menu word stays alone."""
    every = ["p_partkey; 0; 'Beranda'; 300", "p_partkey; 3; concat('Kalimat panjang tentang ', p_name, ' yang bukan menu'); 302", "p_partkey; 6; concat('Isi pesan ', p_name); 680", "p_partkey; 7; '21.05 LTE 80%'; if(p_partkey % 3 = 2, 500, 20)"]
    some = ["p_partkey; 1; 'Ekonomi'; 305", "p_partkey; 2; p_type; 310", "p_partkey; 4; 'Pesan dan panggilan dienkripsi, jadi hanya'; 600", "p_partkey; 5; 'orang di chat ini. Ketuk untuk info selengkapnya.'; 640"]
    parts, fields = table(spark, d, "part"), "doc_id long, pos int, text string, y double"
    rows = rows_of(parts, fields, every).unionByName(rows_of(parts.filter("p_partkey % 3 = 0"), fields, some))
    placed = rows.select("doc_id", "pos", "text", F.array(F.struct(F.lit(0.0).alias("x"), F.col("y").alias("y")), F.struct(F.lit(10.0).alias("x"), F.col("y").alias("y"))).alias("box"), F.lit(1000).alias("height"))
    return lines.classify_lines(placed).select("doc_id", "pos", "reason")


#: Of each feature and strength ("" for none), sentences; {n} is filled with a part's name.
_SENTENCES: dict[tuple[str, str], list[str]] = {
    ("ajakan_menyebarkan", "kuat"): ["Ayo SEBARLUASKAN soal {n}", "teruskan {n} ini ke seluruh kontak", "bagikan video ini, {n}", "share sebanyaknya {n}", "mohon bantu viralkan {n}", "kirimkan {n} ke 5 orang", "Bagikan via Telegram. Sebarluaskan {n}"],
    ("ajakan_menyebarkan", "lemah"): ["Forward {n}", "boleh share, {n}", "teruskan {n}"],
    ("ajakan_menyebarkan", ""): ["Share : Twitter", "kirim lewat email {n}", "Teruskan ke salin tautan", "penyebar {n}"],
    ("desakan_waktu", "kuat"): ["Baca {n} sebelum keburu dihapusnya", "hari ini saja {n}", "penawaran terbatas {n}", "segera pesan {n} sebelum habis", "kartu {n} akan langsung diblokir"],
    ("desakan_waktu", "lemah"): ["Buruan, {n}", "mulai Kamis {n}", "dalam waktu 30 menit {n}", "dalam 2jam {n}"],
    ("desakan_waktu", ""): ["sebelum makan {n}", "dalam kotak {n}", "segeralah {n}"],
    ("sumber_tidak_jelas", "lemah"): ["Konon {n}", "info dr wa {n}", "dpt {n} teman lalu dapat kabar dari grup", "beredar luas {n}", "sumber : whatsapp {n}"],
    ("sumber_tidak_jelas", ""): ["info resmi {n}", "sumber air {n}"],
    ("judul_clickbait", "lemah"): ["GEGER! {n}", "gak bakal percaya {n}", "ternyata begini {n}", "wajib simak {n}", "bikin merinding {n}", "inilah rahasianya {n}"],
    ("judul_clickbait", ""): ["gegernya {n}", "wajib lapor {n}"],
    ("bahasa_provokatif", "kuat"): ["musnahkanlah {n} aseng"],
    ("bahasa_provokatif", "lemah"): ["laknat {n}", "mereka zalim, {n}"],
    ("permintaan_data_rahasia", "kuat"): [
        "sebutkan {n} sandi", "dia menanyakan password {n}", "masukkan kode 4 digit {n}", "tolong teruskan sms {n}", "harus lakukan verifikasi dua langkah {n}", "unlock {n} lewat ovo", "qris {n} error", "refund {n} via gopay", "wajib setor uang {n} dulu",
        "bayar {n} denda", "ketik pin {n}", "Jangan ragu, berikan kodenya {n}", "jangan sampai terlambat kirim otp {n}", "Dilarang parkir. Kirimkan token {n}"],
    ("permintaan_data_rahasia", ""): ["jangan pernah berikan otp {n}", "kirim pin peta {n}", "kami tidak akan pernah meminta sandi {n}", "Hindari memberi tahu, jangan kirimkan cvv {n}", "kode 12345 angka {n}"],
    ("link_mencurigakan", "kuat"): ["buka https://cutt.ly/{k}", "daftar di murah{k}.icu/x", "toko{k}.wixsite.com", "lewat chat.whatsapp.com/q{k}"],
    ("link_mencurigakan", "lemah"): ["lihat www.tempo.co dan https://asal{k}.net/a."],
    ("link_mencurigakan", ""): ["lihat https://www.republika.co.id/{k}", "surel {k}@s.id"],
    ("kapital_tanda_seru", "kuat"): ["Lihat {n}!!!", "Lihat ! ! ! {n}", "DENGARKAN KABAR BURUK! LARI DARI KOTA SEKARANG! {n}"],
    ("kapital_tanda_seru", "lemah"): ["Bagus!! {n}", "HARGA MINYAK GORENG NAIK LAGI DI SEMUA TOKO KOTA {n}"],
    ("kapital_tanda_seru", ""): ["Bagus! {n}", "CV ABC {n}"],
}
_DETECTED = [(f, s, t) for (f, s), texts in _SENTENCES.items() for t in texts]


@query(f"WITH p AS ({_PART}) SELECT k AS doc_id, f AS feature_id, s AS strength FROM p JOIN (VALUES " + ", ".join(f"({i}, '{f}', '{s or 'tidak ada'}')" for i, (f, s, _) in enumerate(_DETECTED)) + f") v(i, f, s) ON v.i = k % {len(_DETECTED)}")
def planted_features(spark: SparkSession, d: str) -> DataFrame:
    """A sentence for each part, with its name: which strength its feature has, each list once in some seventy parts."""
    which = lambda i: chosen(F.col("p_partkey"), [x[i] for x in _DETECTED])
    asked = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), filled(which(2)).alias("text"), which(0).alias("feature_id"))
    found = features.detect_features(asked).select("doc_id", "feature_id", "strength")
    return asked.join(found, ["doc_id", "feature_id"], "left").select("doc_id", "feature_id", F.coalesce("strength", F.lit("tidak ada")).alias("strength"))


@query(f"WITH p AS ({_PART}) SELECT k AS doc_id, 'desakan_waktu' AS feature_id, 'tujuh delapan segera ' || n || ' sembilan sepuluh' AS evidence, 0 AS n_strong FROM p UNION ALL SELECT k, 'sumber_tidak_jelas', 'konon ' || n || ' heboh sekali', 0 FROM p")
def feature_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Windows of evidence snap to blanks; an exclusion takes a match away."""
    parts = table(spark, d, "part")
    long = F.concat(F.lit("satuduatigaempat limaenamlimaenamlimaenam tujuh delapan segera "), "p_name", F.lit(" sembilan sepuluh sebelasduabelastigabelas"))
    texts = parts.select(F.col("p_partkey").alias("doc_id"), long.alias("text")).unionByName(parts.select((F.col("p_partkey") + 10_000_000).alias("doc_id"), F.concat(F.lit("konon "), "p_name", F.lit(" heboh sekali")).alias("text")))
    found = features.detect_features(texts, {"judul_clickbait": r"\bheboh sekali\b"})
    return found.select((F.col("doc_id") % 10_000_000).alias("doc_id"), "feature_id", F.array_join("evidence", ";").alias("evidence"), "n_strong")


@query(f"""WITH p AS ({_PART}), v(pos, kind, confidence, n) AS (VALUES (0, 'desakan_waktu', 'tinggi', 1), (0, 'judul_clickbait', 'sedang', 1), (1, 'judul_clickbait', 'tinggi', 1), (1, 'bahasa_provokatif', 'sedang', 1), (2, 'sumber_tidak_jelas', 'tinggi', 1))
SELECT k AS doc_id, kind AS feature_id, confidence, v.n FROM p JOIN v ON pos = k % 4""")
def feature_merge(spark: SparkSession, d: str) -> DataFrame:
    """The model failed on a quarter of the texts and ran on the others; weak rules alone go, quotes of the wrong form are no evidence."""
    parts, at = table(spark, d, "part"), lambda i: f"p_partkey % 4 = {i}"
    kinds = "doc_id long, feature_id string, strength string, e string"
    rules = [(0, "desakan_waktu", "kuat", "concat('segera sebelum ', p_name)"), (0, "judul_clickbait", "lemah", "'viral'"), (1, "judul_clickbait", "lemah", "'viral'"), (1, "sumber_tidak_jelas", "lemah", "'katanya'"), (2, "sumber_tidak_jelas", "lemah", "'katanya'"), (3, "judul_clickbait", "lemah", "'viral'")]
    found = reduce(DataFrame.unionByName, [rows_of(parts.filter(at(i)), kinds, [f"p_partkey; '{f}'; '{s}'; {e}"]) for i, f, s, e in rules])
    found = found.select("doc_id", "feature_id", "strength", F.array("e").alias("evidence"), (F.col("strength") == "kuat").cast("int").alias("n_strong"))
    model = [(1, "judul_clickbait", "concat('viral ', p_name)"), (1, "bahasa_provokatif", "concat('mereka ', p_name)"), (1, "kapital_tanda_seru", "'biasa saja kok'"), (2, "sumber_tidak_jelas", "'katanya begitu'"), (1, "link_mencurigakan", "'klik di sini saja'")]
    quotes = reduce(DataFrame.unionByName, [rows_of(parts.filter(at(i)), "doc_id long, feature_id string, q string", [f"p_partkey; '{f}'; {q}"]) for i, f, q in model]).select("doc_id", "feature_id", F.array("q").alias("quotes"))
    merged = features.merge_features(found, quotes, parts.select(F.col("p_partkey").alias("doc_id"), (F.col("p_partkey") % 4 > 0).alias("ok")))
    return merged.select("doc_id", "feature_id", "confidence", F.size("evidence").alias("n"))


_CLAIMS = [
    ("Menteri Rahayu membagikan 2,5 juta paket", None), ("Menteri Rahayu membagikan 7 juta paket", "angka_baru"), ("Menteri Rahayu menemui Kartono membagikan paket", "entitas_baru"), ("Menteri Rahayu membagikan paket palsu", "kata_berat_baru"),
    ("Menteri membagikan perlombaan mancanegara sepakbola", "kata_baru_banyak"), ("Pembeli membayar ongkos", "negasi"), ("Paket untuk pembeli Surabaya pada Oktober", None), ("Menteri Rahayuu membagikan paket", None),
]


@query(f"WITH p AS ({_PART}) SELECT k AS id, CASE k % 8 " + " ".join(f"WHEN {i} THEN '{r}'" for i, (_, r) in enumerate(_CLAIMS) if r) + " END AS reason FROM p")
def faithful_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims against a text that names the part: new numbers, names, judgements, too many new words, a lost denial."""
    body = F.concat(F.lit("Menteri Rahayu membagikan 2,5 juta paket "), F.col("p_name"), F.lit(" untuk 300 pembeli Surabaya pada 9 Okt. Pembeli tidak membayar ongkos."))
    pairs = table(spark, d, "part").select(F.col("p_partkey").alias("id"), chosen(F.col("p_partkey"), [c for c, _ in _CLAIMS]).alias("claim"), body.alias("text"))
    return faithful.check_faithfulness(pairs).select("id", "reason")


def _titled(spark: SparkSession, d: str) -> DataFrame:
    """Five articles for each supplier: one by the old form of its address, one by the new, one by a title within a week, one with
    the same title a year later, one that refers to that."""
    s = "s_suppkey"
    word = f"regexp_replace(concat('judul nomor ', translate(cast({s} AS string), '0123456789', 'abcdefghij'), ' panjang'), '  ', ' ')"
    rows = [
        f"{s} * 10 + 1; 'a'; concat('https://own.id/2024/01/02/slug-', {s}, '/'); concat('[SALAH] ', {word}); ''; date'2024-01-02'; ''",
        f"{s} * 10 + 2; 'b'; concat('https://own.id/articles/9-slug-', {s}); concat('lain ', {s}); 'isi'; NULL; ''",
        f"{s} * 10 + 3; 'b'; concat('https://else.id/x', {s}); {word}; ''; date'2024-01-05'; ''",
        f"{s} * 10 + 4; 'c'; concat('https://else.id/y', {s}); {word}; ''; date'2025-01-05'; ''",
        f"{s} * 10 + 5; 'c'; concat('https://else.id/z', {s}); concat('rujukan ', {s}); 'n'; date'2024-01-05'; concat('https://else.id/y', {s})",
    ]
    fields = "seq long, source string, url string, title string, narrative string, date date, ref string"
    suppliers = table(spark, d, "supplier").select("s_suppkey", F.lit(0).alias("p_partkey"), F.lit("").alias("p_name"), F.lit("").alias("p_type"))
    made = ", ".join("struct(" + ", ".join(f"CAST({v} AS {f.split(None, 1)[1]}) AS {f.split()[0]}" for v, f in zip(_values(r), fields.split(", "), strict=True)) + ")" for r in rows)
    exploded = suppliers.selectExpr(f"explode(array({made})) AS r").select("r.*")
    return exploded.withColumn("ref_urls", F.filter(F.array("ref"), lambda u: u != "")).drop("ref")


@query("""SELECT s_suppkey * 10 + v.i AS seq, v.n AS n_merged, v.narrative, v.others AS other_sources, v.day FROM supplier, (VALUES (1, 2, 'isi', 'b', '2024-01-02'), (4, 1, 'n', '', '2025-01-05')) v(i, n, narrative, others, day)""")
def article_merge(spark: SparkSession, d: str) -> DataFrame:
    """By slug, by a title within a week, by a referenced address; the same title a year later stays."""
    merged = resolve.resolve_articles(_titled(spark, d), "own.id")
    return merged.select("seq", "n_merged", "narrative", F.array_join("other_sources", ",").alias("other_sources"), F.col("date").cast("string").alias("day"))


@query("SELECT r AS reason, count(*) AS n FROM supplier, (VALUES ('slug'), ('rujukan'), ('judul')) v(r) GROUP BY r")
def merge_reasons(spark: SparkSession, d: str) -> DataFrame:
    return resolve.merge_links(_titled(spark, d), "own.id").groupBy("reason").agg(F.count("*").alias("n"))


@query("""WITH l AS (SELECT page_id % 4 AS s, page_id // 4 // 10 + 1 AS page, page_id, page_id % 3 = 0 OR (page_id // 4 // 10 + 1) IN (5, 6) AS seen FROM pages),
o AS (SELECT s, page, count(*) FILTER (WHERE NOT seen) AS fresh FROM l GROUP BY ALL),
z AS (SELECT s, min(page) AS stop FROM (SELECT *, fresh = 0 AND lag(fresh) OVER (PARTITION BY s ORDER BY page) = 0 AS idle FROM o) WHERE idle GROUP BY s)
SELECT page_id, page::INT AS page FROM l LEFT JOIN z USING (s) WHERE NOT seen AND (stop IS NULL OR page < stop)""")
def pages_to_fetch(spark: SparkSession, d: str) -> DataFrame:
    """Of listings of ten to a page, a third is seen already, and pages five and six as a whole: there the crawl stops."""
    page = (F.floor(F.floor(F.col("page_id") / 4) / 10) + 1).cast("int")
    listed = table(spark, d, "pages").select("page_id", (F.col("page_id") % 4).cast("string").alias("source"), page.alias("page"), F.concat(F.lit("https://x.id/"), F.col("page_id")).alias("url"), F.when(F.col("page_id") % 2 == 0, F.lit("2024-05-01").cast("date")).alias("date"))
    bronze = listed.filter("page_id % 3 = 0 OR page IN (5, 6)").select(F.concat(F.lit("http://www."), F.substring("url", 9, 99), F.lit("/")).alias("url"), F.lit(None).cast("string").alias("error"))
    failed = listed.filter("page_id % 3 = 1 AND page NOT IN (5, 6)").select("url", F.lit("galat").alias("error"))
    found = ingest.pages_to_fetch(listed.drop("page_id"), bronze.unionByName(failed), "2020-01-01", 2)
    return found.select(F.regexp_extract("url", r"(\d+)$", 1).cast("long").alias("page_id"), "page")


@query("SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'tanpa tanggal' ELSE year(o_orderdate)::VARCHAR END AS year, count(*) AS n FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY ALL")
def fetched_by_year(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate").cast("date")).alias("date"), F.when(F.col("o_orderkey") % 7 == 0, "galat").alias("error"))
    return ingest.fetched_by_year(rows)


@query(f"WITH p AS ({_PART}) SELECT k AS code, k % 2 = 0 AS same_claim, CASE WHEN k % 3 = 0 THEN 'y' ELSE '' END AS unstable FROM p")
def run_stability(spark: SparkSession, d: str) -> DataFrame:
    """Two runs over every part: every second claim differs, every third run finds a feature that the other does not."""
    runs = rows_of(table(spark, d, "part"), "code long, run int, claim string, f string", ["p_partkey; 1; p_name; if(p_partkey % 3 = 0, 'x,y', 'x')", "p_partkey; 2; if(p_partkey % 2 = 0, p_name, p_type); 'x'"])
    found = evaluation.run_stability(runs.withColumn("features", F.split("f", ",")).drop("f"))
    return found.select("code", "same_claim", F.array_join("unstable", ",").alias("unstable"))


@query(f"WITH p AS ({_PART}) SELECT k AS doc_id, v.pos, 'Adapter ' || CASE v.pos WHEN 1 THEN n ELSE t END AS adapter, '10.0.' || v.pos || '.' || k % 256 AS address FROM p, (VALUES (1), (4)) v(pos)")
def adapter_addresses(spark: SparkSession, d: str) -> DataFrame:
    rows = ["p_partkey; 0; concat('Adapter ', p_name, ':')", "p_partkey; 1; concat('  IPv4 Address. . : 10.0.1.', p_partkey % 256)", "p_partkey; 2; concat('Adapter ', p_type, ':')", "p_partkey; 3; '   x'", "p_partkey; 4; concat('  IPv4 : 10.0.4.', p_partkey % 256)"]
    return reports.carried_forward(rows_of(table(spark, d, "part"), "doc_id long, pos long, text string", rows)).select("doc_id", "pos", "adapter", "address")


@query(f"WITH p AS ({_PART}) SELECT k AS doc_id, n || ' ' || lower(t) AS norm, array_to_string(list_concat(range(1, length(n) + 2), range(length(n) + 3, length(n) + length(t) + 3)), ',') AS places FROM p")
def index_map(spark: SparkSession, d: str) -> DataFrame:
    """Where the characters of a normalised text stood: after a blank, before two line ends."""
    rows = spans.with_index_map(table(spark, d, "part").select("p_partkey", F.concat(F.lit(" "), "p_name", F.lit("\n\n"), "p_type", F.lit(" ")).alias("t")), "t")
    return rows.select(F.col("p_partkey").alias("doc_id"), "norm", F.array_join(F.transform("at", lambda x: x.cast("string")), ",").alias("places"))


@query(f"WITH p AS ({_PART}) SELECT k AS doc_id, profile, CASE WHEN k % 4 < 2 THEN 'hati_hati' ELSE 'tidak_ditemukan' END AS level FROM p, (VALUES ('final'), ('old')) v(profile)")
def verdict_without_articles(spark: SparkSession, d: str) -> DataFrame:
    """One high feature or two medium ones ask for caution; one medium one, or none, does not."""
    parts = table(spark, d, "part")
    found = rows_of(parts.filter("p_partkey % 4 < 3"), "doc_id long, confidence string", ["p_partkey; if(p_partkey % 4 = 0, 'tinggi', 'sedang')"])
    found = found.unionByName(rows_of(parts.filter("p_partkey % 4 = 1"), "doc_id long, confidence string", ["p_partkey; 'sedang'"]))
    return decide.without_articles(found, parts.select(F.col("p_partkey").alias("doc_id")), decide.profiles(spark))


@query(f"""WITH p AS ({_PART}) SELECT k AS doc_id, 'final' AS profile, CASE k % 3 WHEN 0 THEN 'Minyak ' || n || ' menyembuhkan demam.' WHEN 1 THEN 'Kalimat ' || n ELSE 'Baris ' || n END AS refuted_evidence FROM p WHERE k % 4 <> 3""")
def refuted_passages(spark: SparkSession, d: str) -> DataFrame:
    """The closest passage, the best sentence where none is close, the first line where there is none."""
    parts = table(spark, d, "part")
    body = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Halo semua. Minyak "), "p_name", F.lit(" menyembuhkan demam. Sekian."))).when(F.col("p_partkey") % 3 == 1, F.lit("Lain sekali. Tidak sama.")).otherwise(F.concat(F.lit("\nBaris "), "p_name", F.lit("\nkedua")))
    texts = parts.select(F.col("p_partkey").alias("doc_id"), body.alias("text"))
    article = (F.col("p_partkey") + 1_000_000).alias("doc_id")
    verdict = parts.select(F.col("p_partkey").alias("doc_id"), F.lit("final").alias("profile"), F.when(F.col("p_partkey") % 4 != 3, article).alias("deciding_id"))
    articles = parts.select(article, F.concat(F.array(F.lit("minyak"), F.lit("menyembuhkan"), F.lit("demam")), F.split("p_name", " ")).alias("title_words"), F.array(F.lit("dokter")).alias("narrative_words"))
    best = parts.filter("p_partkey % 3 = 1").select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("Kalimat "), "p_name").alias("sentence"))
    return screen.refuted_evidence(texts, verdict, articles, best)


@query(f"WITH p AS ({_PART}) SELECT k AS doc_id, 'hubungi 0812-3456-7' || lpad(ks, 5, '0') || ';segera ' || n AS quotes, 1 AS n_rejected FROM p")
def mapped_quotes(spark: SparkSession, d: str) -> DataFrame:
    """A model's quotes from a masked text: what stands for nothing is counted."""
    number = F.concat(F.lit("0812-3456-7"), F.lpad(F.col("p_partkey").cast("string"), 5, "0"))
    rows = table(spark, d, "part").select(
        "p_partkey", F.concat(F.lit("Tolong hubungi "), number, F.lit(" segera "), "p_name").alias("text"), F.concat(F.lit("Tolong hubungi [NOMOR] segera "), "p_name").alias("masked"),
        F.array(F.lit("hubungi [NOMOR]"), F.concat(F.lit("SEGERA "), "p_name"), number).alias("quotes"),
    )
    mapped = rows.select("p_partkey", features.map_quotes(F.col("quotes"), F.col("text"), F.col("masked")).alias("m"))
    return mapped.select(F.col("p_partkey").alias("doc_id"), F.array_join("m.quotes", ";").alias("quotes"), F.col("m.n_rejected").alias("n_rejected"))


@query("""SELECT p_brand AS brand, least(2, count(*) FILTER (WHERE p_partkey % 4 <> 1 AND p_size % 2 = 0 AND p_partkey % 5 <> 0)) AS n FROM part GROUP BY p_brand HAVING n > 0""")
def candidate_articles(spark: SparkSession, d: str) -> DataFrame:
    """Refuted articles with a long enough narrative without a link; two of each group are asked for."""
    long = "Kabar tentang barang ini beredar luas dan dibaca oleh banyak orang di kota. "
    body = F.when(F.col("p_size") % 2 == 1, F.lit("pendek")).when(F.col("p_partkey") % 5 == 0, F.lit(long * 3 + "http:")).otherwise(F.concat(F.lit("NARASI: " + long * 3), F.lit("https://x.id/"), "p_partkey"))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 4 == 1, "benar").otherwise("salah").alias("label"), F.col("p_name").alias("title"), body.alias("narrative"), F.col("p_brand").alias("brand"))
    return reports.candidate_articles(rows, "salah", 180, None, 2, 3, "brand").groupBy("brand").agg(F.count("*").alias("n"))


@query(f"WITH p AS ({_PART}) SELECT k AS doc_id, CASE WHEN k % 2 = 1 THEN 'tiga' WHEN contains(n, lower(t)) THEN '' ELSE lower(t) END AS never_read FROM p")
def words_never_read(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part")
    truth = parts.select(F.col("p_partkey").alias("doc_id"), F.concat("p_name", F.lit(" tiga "), "p_type").alias("text"))
    readings = rows_of(parts, "doc_id long, text string", ["p_partkey; concat('x', p_name, 'x')", "p_partkey; if(p_partkey % 2 = 0, 'tiga', p_type)"])
    return reports.words_never_read(truth, readings).select("doc_id", F.array_join("never_read", ",").alias("never_read"))


@query("""SELECT p_brand AS variant, round(avg(100.0 * (200 - p_size) / 200), 6) AS mean_saved, round(median(100.0 * (200 - p_size) / 200), 6) AS median_saved, count(*) FILTER (WHERE p_size % 10 = 0) AS changed FROM part GROUP BY p_brand""")
def saving_by_variant(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.col("p_brand").alias("variant"), F.col("p_partkey").alias("doc_id"), F.lit(200).cast("long").alias("bytes_before"), F.col("p_size").cast("long").alias("bytes_after"), (F.col("p_size") % 10 == 0).alias("text_changed"), F.lit(False).alias("level_changed"))
    out = reports.saving_by_variant(rows)
    return out.select("variant", F.round("mean_saved", 6).alias("mean_saved"), F.round("median_saved", 6).alias("median_saved"), F.col("n_text_changed").alias("changed"))


@query("SELECT count(*) AS n, count(*) FILTER (WHERE p_partkey % 3 <> 0) AS n_equal, sum(p_size)::BIGINT AS false_quotes_a, count(*) FILTER (WHERE p_partkey % 2 = 1) AS false_quotes_b FROM part")
def compare_providers(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part")
    a = parts.select(F.col("p_partkey").alias("doc_id"), F.array("p_name", "p_type").alias("features"), F.col("p_size").cast("long").alias("n_false_quotes"))
    b = parts.select(F.col("p_partkey").alias("doc_id"), F.when(F.col("p_partkey") % 3 == 0, F.array("p_name")).otherwise(F.array("p_type", "p_name")).alias("features"), (F.col("p_partkey") % 2).alias("n_false_quotes"))
    return reports.compare_providers(a, b)


@query("""SELECT 'Kalimat ' || p_name || ' yang cukup panjang untuk dipakai di sini. Kalimat kedua.' AS query FROM part WHERE p_partkey % 2 = 0""")
def negative_queries(spark: SparkSession, d: str) -> DataFrame:
    """The dateline goes, the first sentences stay; short texts are no queries. Each outlet may give all it has."""
    parts = table(spark, d, "part")
    body = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("JAKARTA, Koran - Kalimat "), "p_name", F.lit(" yang cukup panjang untuk dipakai di sini. Kalimat kedua. Ketiga."))).otherwise(F.lit("Pendek."))
    return reports.negative_queries(parts.select(F.col("p_brand").alias("outlet"), F.col("p_partkey").alias("id"), body.alias("text")), 1_000_000, 1).select("query")


@query("SELECT string_agg('- ' || n_name || ': ' || n_regionkey, chr(10) ORDER BY n_nationkey) AS prompt FROM nation")
def prompt_list(spark: SparkSession, d: str) -> DataFrame:
    """The nations as the items of a prompt, in their order."""
    return reports.prompt_list(table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("ord"), F.col("n_name").alias("id"), F.col("n_regionkey").cast("string").alias("explanation")))


@query(f"WITH p AS ({_PART}) SELECT k AS doc_id, concat_ws(',', CASE WHEN k % 2 = 1 THEN 'llm' END, CASE WHEN k % 3 = 1 THEN 'pencarian' END) AS limited FROM p")
def limited_checks(spark: SparkSession, d: str) -> DataFrame:
    limited = decide.limited_checks(F.col("p_partkey") % 2 == 0, F.col("p_partkey") % 3 != 1)
    return table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.array_join(limited, ",").alias("limited"))


@query(f"""WITH p AS ({_PART}) SELECT k AS doc_id, CASE k % 3 WHEN 0 THEN '[AKUN]' || chr(10) || '[AKUN]' || chr(10) || 'Kalimat ' || n || ' biasa' WHEN 1 THEN 'hubungi [NOMOR] atau [EMAIL] ' || n ELSE n || chr(10) || 'jam 08.30' END AS text FROM p""")
def masked_documents(spark: SparkSession, d: str) -> DataFrame:
    """Lines of account names that share letters in a row, and single patterns."""
    name = F.translate(F.lpad(F.col("p_partkey").cast("string"), 6, "0"), "0123456789", "abcdefghij")
    body = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("kabarkota"), name, F.lit("\nx"), F.lit("kabarkota"), name, F.lit("\nKalimat "), "p_name", F.lit(" biasa")))
    body = body.when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("hubungi 0813-9876-5432 atau "), "p_type", F.lit("@d.id "), "p_name")).otherwise(F.concat("p_name", F.lit("\njam 08.30")))
    return masking.mask_documents(table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), body.alias("text"))).select("doc_id", "text")


@query(f"""WITH p AS ({_PART}) SELECT k AS doc_id, v.i AS paragraph, CASE v.i WHEN 0 THEN 'Petani menanam ' || n || ' dan memanen padi besok.' WHEN 1 THEN 'Gubernur Baru Melantik ' || 'Pejabat Daerah Hari Ini' WHEN 2 THEN 'Rabu, 7 Juni 2023' ELSE 'Catatan' END AS text
FROM p, (VALUES (0), (1), (2), (3)) v(i)""")
def paragraphs_of_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines that go on are joined, an empty line ends a paragraph, headings and dates stand alone, menus go."""
    rows = ["concat('Petani menanam ', p_name)", "'dan memanen padi besok.'", "''", "'Masuk'", "'Gubernur Baru Melantik'", "'Pejabat Daerah Hari Ini'", "'Rabu, 7 Juni 2023'", "'Catatan'"]
    lines_ = rows_of(table(spark, d, "part"), "doc_id long, pos int, text string", [f"p_partkey; {i}; {t}" for i, t in enumerate(rows)])
    found = claims.paragraphs(lines_)
    from pyspark.sql.window import Window

    return found.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("paragraph")) - 1).alias("paragraph"), "text")


@query(f"WITH p AS ({_PART}) SELECT k AS id, '0-' || length(n) || ',' || (length(n) + 2) || '-' || (length(n) + 2 + length(t)) AS spans FROM p")
def highlighted_places(spark: SparkSession, d: str) -> DataFrame:
    """Evidence is found with other white space; two quotes that overlap become one place."""
    rows = table(spark, d, "part").select("p_partkey", F.concat("p_name", F.lit(" \n"), "p_type").alias("t"), F.array(F.replace("p_name", F.lit(" "), F.lit("")), F.col("p_type"), F.substring("p_type", 1, 3), F.lit("?")).alias("q"))
    shown = lambda x: F.concat_ws("-", x["s"].cast("string"), x["e"].cast("string"))
    return rows.select(F.col("p_partkey").alias("id"), F.array_join(F.transform(alignment.highlight_spans("t", "q"), shown), ",").alias("spans"))


@query(f"WITH p AS ({_PART}) SELECT k AS n, CASE WHEN k % 3 = 0 THEN round(1.0 / length(n), 4) ELSE 0.0 END::DOUBLE AS cer FROM p")
def character_errors_read(spark: SparkSession, d: str) -> DataFrame:
    """A wrong letter; interface text between marks may be read or not."""
    name, menu = F.col("p_name"), F.concat(F.substring("p_name", 1, 2), F.lit("\x01menu\x01"), F.expr("substring(p_name, 3)"))
    reference = F.when(F.col("p_partkey") % 3 == 0, name).otherwise(menu)
    reading = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("#"), F.expr("substring(p_name, 2)"))).when(F.col("p_partkey") % 3 == 1, name).otherwise(F.replace(menu, F.lit("\x01"), F.lit("")))
    return table(spark, d, "part").select(F.col("p_partkey").alias("n"), F.round(alignment.character_error_rate(reference, reading), 4).alias("cer"))


@query("""SELECT page_id, 'Judul ' || page_id AS title, strftime(DATE '2020-01-01' + (page_id % 1500)::INT, '%Y-%m-%d') AS day, 'Isi tebal ' || page_id || '|Lain' AS blocks, 'Isi tebal ' || page_id AS narrative FROM pages""")
def article_pages(spark: SparkSession, d: str) -> DataFrame:
    """Article pages made of the ids of `pages`: a title, a date, a narrative section and another one."""
    day = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("page_id") % 1500).cast("int")), "yyyy-MM-dd")
    html = F.concat(F.lit("<h1>Judul "), "page_id", F.lit('</h1><article><time datetime="'), day, F.lit('"></time><h3>Narasi</h3><p>Isi <b>tebal</b> '), "page_id", F.lit("</p><h3>Penjelasan</h3><p>Lain</p></article>"))
    found = table(spark, d, "pages").select("page_id", html.alias("html")).select("page_id", article_record("html").alias("r")).select("page_id", "r.*")
    names = found.columns[1:]
    return found.select("page_id", F.col(names[0]).alias("title"), F.col(names[1]).cast("string").alias("day"), F.array_join(names[2], "|").alias("blocks"), F.col(names[3]).alias("narrative"))


@query("""SELECT page_id, v.pos, CASE WHEN v.pos = 0 THEN 'https://own.id/articles/' || page_id || '-a' ELSE 'https://lain.id/articles/' || page_id || '-b' END AS url, CASE WHEN v.pos = 0 THEN '2026-10-08' END AS day, CASE WHEN v.pos = 0 THEN 'Judul ' || page_id ELSE '' END AS title
FROM pages, (VALUES (0), (1)) v(pos)""")
def listing_pages(spark: SparkSession, d: str) -> DataFrame:
    """Cards of listing pages: a repeated address counts once, a card without an article's address not at all."""
    card = '<div class="x news-card-h-alt"><div><a href="{0}">baca</a></div>{1}</div>'
    html = card.format("/articles/{k}-a", '<img alt="Judul {k}"><span>08/10/2026</span>') + card.format("/articles/{k}-a", "") + card.format("https://lain.id/articles/{k}-b", "<span>kemarin</span>") + card.format("/tentang", "")
    pages = table(spark, d, "pages").select("page_id", F.replace(F.lit(html), F.lit("{k}"), F.col("page_id").cast("string")).alias("html"))
    found = listing_rows(pages, "https://own.id")
    number = F.regexp_extract("url", r"articles/(\d+)", 1).cast("long")
    return found.select(number.alias("page_id"), "pos", "url", F.col("date").cast("string").alias("day"), "title")
