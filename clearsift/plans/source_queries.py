"""Queries that write given tables through a sink or a stream and read them back; each with the SQL that must give the same rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clearsift.functions import arrays
from clearsift.operators import alignment, features, reports, resolve
from clearsift.plans.fixture_queries import ORACLE_SQL as _OTHER
from clearsift.plans.fixture_queries import table
from clearsift.sources import readers, sinks
from clearsift.sources.commit_log import CommitLog
from clearsift.sources.xlsx import read_xlsx, write_xlsx
from clearsift.streaming import frames, listing

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        assert f.__name__ not in _OTHER
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return register


def scratch(spark: SparkSession, name: str) -> str:
    return resolve.shared_path(spark, name)


def placed(key: str, *choices: object) -> F.Column:
    """A value that a row's id picks from a list, so that every case stands in the table."""
    return F.element_at(F.array(*[F.lit(c) for c in choices]), (F.pmod(F.col(key), F.lit(len(choices))) + 1).cast("int"))


# Workbooks.


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate::DATE AS o_orderdate, o_orderpriority FROM orders")
def xlsx_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Orders as workbooks, numbers, shared texts and dates, read again with their types."""
    path = scratch(spark, "xlsx")
    rows = table(spark, d, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("date"))
    write_xlsx(rows, path, rows_per_workbook=40_000)
    return read_xlsx(spark, path, rows.schema)


@query("SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_mktsegment FROM customer")
def xlsx_as_texts(spark: SparkSession, d: str) -> DataFrame:
    """Customers as workbooks, read without a schema: the header names the columns."""
    path = scratch(spark, "xlsx")
    write_xlsx(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), path)
    return read_xlsx(spark, path)


# Crawls. Pages of `pages` are listed by four sources, a hundred to a page; a tenth is listed on the next page again.

_LISTED = """WITH p AS (SELECT page_id, url || '?p=' || page_id AS url, DATE '2020-01-01' + (page_id % 1500)::INT AS date, page_id % 7 = 3 AS fails FROM pages)"""


def _crawl(spark: SparkSession, d: str) -> str:
    """A crawl that is stopped after its first batch was written but before it was committed, resumed, then updated."""
    pages = table(spark, d, "pages").select(
        F.concat(F.lit("s"), F.col("page_id") % 4).alias("source"),
        (F.floor(F.floor(F.col("page_id") / 4) / 100) + 1).cast("int").alias("page"),
        F.concat_ws("?p=", "url", F.col("page_id")).alias("url"),
        F.concat(F.lit("article "), F.col("page_id")).alias("title"),
        F.date_add(F.lit(dt.date(2020, 1, 1)), (F.col("page_id") % 1500).cast("int")).alias("date"),
        "page_id",
    )
    again = pages.filter("page_id % 10 = 0").withColumn("page", F.col("page") + 1)
    site, target = scratch(spark, "site"), scratch(spark, "crawl")
    listing.write_site(pages.unionByName(again).drop("page_id"), site)
    number = F.regexp_extract("title", r"(\d+)$", 1).cast("long")
    fetch = lambda rows: rows.withColumn("error", F.when((number % 7 == 3) & (F.col("round") == 1), "tak_terbaca"))
    try:
        listing.crawl(spark, site, target, fetch, most_batches=1)
    except Exception as stopped:
        if "stopped" not in str(stopped):
            raise
    listing.crawl(spark, site, target, fetch)
    listing.crawl(spark, site, target, fetch, update=True)
    return target


@query(_LISTED + " SELECT url, date, CASE WHEN fails THEN 2 ELSE 1 END AS round, CASE WHEN fails THEN 1 + (page_id % 10 = 0)::INT ELSE 0 END AS failures FROM p")
def crawl_articles(spark: SparkSession, d: str) -> DataFrame:
    """Each address arrives once, after a restart and a replay too; those that failed arrive with the update."""
    rows = listing.crawled(spark, _crawl(spark, d))
    return rows.filter("status IN ('baru', 'gagal')").groupBy("url", "date").agg(
        F.max(F.when(F.col("status") == "baru", F.col("round"))).alias("round"), (F.count("*") - 1).alias("failures")
    )


@query(_LISTED + " SELECT year(date)::VARCHAR AS year, count(*) AS n FROM p GROUP BY ALL")
def crawl_years(spark: SparkSession, d: str) -> DataFrame:
    """The running number of articles of each year, which a replayed batch does not change."""
    found = listing.years(spark, _crawl(spark, d))
    return spark.createDataFrame(sorted(found.items()), "year string, n long")


# Captures. A user's day is a capture, asked for at eight o'clock; the user's events are its frames.

_RULES = frames.FrameRules(delay=2 * 3_600_000, limit=8 * 3_600_000, extra=4 * 3_600_000)
_CAPTURES = f"""WITH r AS (SELECT user_id * 100000 + date_diff('day', DATE '2000-01-01', ts::DATE) AS capture_id, event_id, epoch_us(ts) // 1000 - epoch_us(date_trunc('day', ts)) // 1000 - 28800000 AS at_ms FROM events),
c AS (SELECT DISTINCT capture_id FROM r), f AS (SELECT * FROM r WHERE at_ms BETWEEN 0 AND {_RULES.end}),
o AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY at_ms <> {_RULES.delay}, at_ms > {_RULES.delay}, CASE WHEN at_ms < {_RULES.delay} THEN -at_ms ELSE at_ms END, CASE WHEN at_ms < {_RULES.delay} THEN -event_id ELSE event_id END) AS k, count(*) OVER (PARTITION BY capture_id) AS n FROM f)
SELECT capture_id, event_id AS frame_id, at_ms, coalesce(n, 0) AS n_frames, coalesce(at_ms > {_RULES.limit}, true) AS is_fallback FROM c LEFT JOIN (SELECT * FROM o WHERE k = 1) USING (capture_id)"""


def _captures(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    day = F.date_trunc("day", "ts")
    capture = (F.col("user_id") * 100000 + F.datediff("ts", F.lit(dt.date(2000, 1, 1)))).alias("capture_id")
    asked = events.select(capture, (day + F.expr("INTERVAL 8 HOURS")).alias("ts")).distinct().withColumn("frame_id", F.lit(None).cast("long"))
    return asked.unionByName(events.select(capture, "ts", F.col("event_id").alias("frame_id")))


@query(_CAPTURES)
def frame_choice(spark: SparkSession, d: str) -> DataFrame:
    """Frames of captures as a stream of three batches a month, some rows a batch late; a last row far ahead brings the watermark past all timers."""
    rows, path, out = _captures(spark, d), scratch(spark, "frames"), scratch(spark, "chosen")
    late = F.when(F.col("frame_id") % 10 == 0, F.expr("INTERVAL 20 HOURS")).otherwise(F.expr("INTERVAL 0 HOURS"))
    part = F.least(F.floor(F.dayofmonth(F.col("ts") + late) / 11), F.lit(2)).cast("int")
    months = F.months_between(F.date_trunc("month", F.col("ts") + late), F.lit(dt.date(2000, 1, 1))).cast("int")
    aside = scratch(spark, "dealt")
    rows.withColumn("part", months * 3 + part).write.partitionBy("part").parquet(aside)
    dealt = spark.read.schema(f"{frames.CAPTURES}, part int").parquet(aside)
    for number in sorted(r.part for r in dealt.select("part").distinct().collect()):  # a handful of days' thirds
        dealt.filter(F.col("part") == number).drop("part").write.mode("append").parquet(path)
        frames.take_frames(spark, path, out, _RULES)
    end = dealt.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("long").alias("capture_id"), (F.col("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts"), F.lit(None).cast("long").alias("frame_id"))
    end.coalesce(1).write.mode("append").parquet(path)
    frames.take_frames(spark, path, out, _RULES)
    return spark.read.schema(frames.CHOSEN).parquet(out)


@query(_CAPTURES)
def frame_choice_at_rest(spark: SparkSession, d: str) -> DataFrame:
    return frames.choose_frames_at_rest(_captures(spark, d), _RULES)


# Files that are read strictly, with an account of what is wrong, or by one source's rules.


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def strict_jsonl(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "jsonl")
    sinks.write_jsonl(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), path)
    return readers.read_jsonl_strict(spark, path, "c_custkey long, c_name string, c_acctbal double")


@query("""SELECT CASE c_custkey % 4 WHEN 1 THEN 'bukan json' WHEN 2 THEN 'bukan objek' END AS problem, count(*) AS n, sum(c_custkey)::BIGINT AS keys
FROM customer WHERE c_custkey % 4 <> 3 GROUP BY ALL""")
def accounted_jsonl(spark: SparkSession, d: str) -> DataFrame:
    """A quarter of the lines is cut off, one is an array, one is blank."""
    path, key = scratch(spark, "lines"), F.col("c_custkey").cast("string")
    line = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit('{"k": '), key, F.lit("}"))).when(F.col("c_custkey") % 4 == 1, F.concat(F.lit('{"k": '), key)).when(F.col("c_custkey") % 4 == 2, F.concat(F.lit("["), key, F.lit("]"))).otherwise(F.lit("  "))
    table(spark, d, "customer").select(line.alias("value")).write.text(path)
    number = F.regexp_extract("line", r"(\d+)", 1).cast("long")
    return readers.account_jsonl(spark, path).groupBy("problem").agg(F.count("*").alias("n"), F.sum(number).alias("keys"))


_FIRST = "array_to_string(string_split(trim(regexp_replace(text, '[\\s]+', ' ', 'g')), ' ')[1:6], ' ')"
_ROWS = f"""WITH a AS (SELECT doc_id, {_FIRST} AS words, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'https://x.id/' || doc_id END AS url,
  ['[SALAH] ', '[HOAX] ', '', '(ISU) : '][doc_id % 4 + 1] AS prefix, ['SALAH', 'HOAX', '', 'ISU'][doc_id % 4 + 1] AS label, DATE '2021-01-01' + (doc_id % 300)::INT AS day FROM documents)"""


def _articles(spark: SparkSession, d: str) -> DataFrame:
    """Rows as four sites give them: titles with and without labels, dates in three forms, a fifth without an address."""
    words = F.array_join(F.slice(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " "), 1, 6), " ")
    day = F.date_add(F.lit(dt.date(2021, 1, 1)), (F.col("doc_id") % 300).cast("int"))
    shown = F.when(F.col("doc_id") % 3 == 0, F.date_format(day, "yyyy-MM-dd HH:mm:ss")).when(F.col("doc_id") % 3 == 1, F.date_format(day, "d/M/yyyy")).otherwise(F.date_format(day, "yyyy-MM-dd"))
    return table(spark, d, "documents").select(
        "doc_id", words.alias("words"),
        F.concat(placed("doc_id", "[SALAH] ", "[HOAX] ", "", "(ISU) : "), F.lit("judul "), F.col("doc_id")).alias("title"),
        F.when(F.col("doc_id") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit(" https://x.id/"), F.col("doc_id"), F.lit(" "))).alias("url"),
        shown.alias("date"),
    )


@query(_ROWS + " SELECT url, prefix || 'judul ' || doc_id AS title, day AS date, 'nomor ' || doc_id AS narrative, label AS label_raw FROM a WHERE url <> ''")
def titled_articles(spark: SparkSession, d: str) -> DataFrame:
    rows = _articles(spark, d).withColumn("content", F.concat(F.lit("[NARASI]: nomor "), F.col("doc_id"), F.lit(" [PENJELASAN]: bukan")))
    return readers.adapt_titled(rows, "satu").select("url", "title", "date", "narrative", "label_raw")


@query(_ROWS + " SELECT url, CASE WHEN doc_id % 2 = 0 THEN 'kutipan ' || doc_id ELSE 'nomor ' || doc_id END AS narrative FROM a WHERE url <> ''")
def articles_with_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Every second narrative comes from another table, by address."""
    rows = _articles(spark, d).withColumn("content", F.concat(F.lit("[NARASI]: nomor "), F.col("doc_id")))
    known = rows.filter("doc_id % 2 = 0").select(F.concat(F.lit("http://www."), F.substring_index(F.trim("url"), "//", -1), F.lit("/")).alias("url"), F.concat(F.lit("kutipan "), F.col("doc_id")).alias("narrative"), F.col("doc_id").alias("seq"))
    return readers.adapt_with_lookup(rows, "dua", known.filter("url <> 'http://www./'")).select("url", "narrative")


@query(_ROWS + """ SELECT url, 'HOAKS' AS label_raw, 'kabar ' || doc_id || '.' AS narrative, ['https://a.id/' || doc_id, 'https://b.id/' || doc_id] AS ref_urls FROM a""")
def articles_with_references(spark: SparkSession, d: str) -> DataFrame:
    number = F.col("doc_id").cast("string")
    body = F.concat(F.lit("Penjelasan : kabar "), number, F.lit(". Faktanya lain.\nLink Counter: https://a.id/"), number, F.lit(", https://b.id/"), number, F.lit(")."))
    return readers.adapt_with_references(_articles(spark, d).withColumn("body", body), "tiga").select("url", "label_raw", "narrative", "ref_urls")


@query(_ROWS + """ SELECT 'https://x.id/' || doc_id AS url, CASE WHEN doc_id % 6 = 1 THEN 'TETAP' ELSE label END AS label_raw, 'isi ' || doc_id AS narrative FROM a WHERE doc_id % 3 <> 2""")
def crawled_articles(spark: SparkSession, d: str) -> DataFrame:
    rows = _articles(spark, d).withColumns({
        "url": F.concat(F.lit("https://x.id/"), F.col("doc_id")),
        "label": F.when(F.col("doc_id") % 6 == 1, " TETAP ").when(F.col("doc_id") % 6 == 3, " "),
        "verdict": F.lit(None).cast("string"), "narrative": F.concat(F.lit(' "isi '), F.col("doc_id"), F.lit('" ')),
        "error": F.when(F.col("doc_id") % 3 == 2, "tak_terbaca"),
    })
    return readers.adapt_crawled(rows, "empat").select("url", "label_raw", "narrative")


_META = """WITH m AS (SELECT CASE WHEN c_custkey % 11 = 0 THEN 'g' || (c_custkey // 22) ELSE 'i' || c_custkey END AS id, ['dev', 'uji', 'lain'][CASE WHEN c_custkey % 10 = 3 THEN 3 ELSE c_custkey % 2 + 1 END] AS s,
  CASE WHEN c_custkey % 9 = 4 THEN ' ' ELSE 'hoaks' END AS label, c_custkey AS k FROM customer), j AS (SELECT *, count(*) OVER (PARTITION BY id) > 1 AS dup FROM m)"""


def _metadata(spark: SparkSession, d: str) -> str:
    k, path = F.col("c_custkey"), scratch(spark, "metadata")
    rows = table(spark, d, "customer").select(
        F.when(k % 11 == 0, F.concat(F.lit("g"), F.floor(k / 22))).otherwise(F.concat(F.lit("i"), k)).alias("id"), F.concat(k, F.lit(".png")).alias("berkas"),
        F.when(k % 10 == 3, "lain").when(k % 2 == 0, "dev").otherwise("uji").alias("set"), F.when(k % 9 == 4, " ").otherwise("hoaks").alias("label_harapan"),
        F.lit("hoaks;benar;").alias("label_boleh"), F.lit("x").alias("kategori"), F.when(k % 3 == 0, "ya").otherwise("0").alias("sintetis"), F.lit("").alias("id_artikel_sumber"),
    )
    sinks.write_csv(rows, path, rows.columns)
    return path


@query(_META + """ SELECT id, CASE WHEN dup THEN 'id ganda' WHEN s = 'lain' THEN 'set tidak dikenal' ELSE 'label kosong' END AS problem FROM j WHERE dup OR s = 'lain' OR label = ' '""")
def metadata_problems(spark: SparkSession, d: str) -> DataFrame:
    return readers.read_labelled_metadata(spark, _metadata(spark, d))[1]


@query(_META + """ SELECT id, s AS "set", k % 3 = 0 AS sintetis, 'hoaks,benar' AS allowed FROM j WHERE NOT dup AND s <> 'lain' AND label <> ' '""")
def labelled_metadata(spark: SparkSession, d: str) -> DataFrame:
    return readers.read_labelled_metadata(spark, _metadata(spark, d))[0].select("id", "set", "sintetis", F.array_join("label_boleh", ",").alias("allowed"))


@query("""SELECT p_partkey::VARCHAR AS doc_id, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_name || '. ' || p_type END AS text, (p_partkey % 4)::INT AS label FROM part WHERE p_partkey % 4 < 2""")
def false_news(spark: SparkSession, d: str) -> DataFrame:
    """Labels 0 and 1 are kept of four; a third has a blank narrative."""
    path = scratch(spark, "news")
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("judul"), F.when(F.col("p_partkey") % 3 == 0, " ").otherwise(F.col("p_type")).alias("narasi"), F.concat(F.lit(" "), F.col("p_partkey") % 4).alias("label"))
    sinks.write_csv(rows, path, rows.columns)
    return readers.read_false_news(spark, path, True)


_NATION_TEXT = "CASE WHEN n_nationkey % 5 = 0 THEN 'DRAF ' ELSE '' END || '[UI]Suka[/UI] ' || n_name || ' [?]'"


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 5 <> 0 THEN chr(1) || 'Suka' || chr(1) || ' ' || n_name || ' ' || '<?>' END AS text FROM nation""")
def transcripts(spark: SparkSession, d: str) -> DataFrame:
    """A transcript for each nation, whole files; drafts are refused. The mark for unreadable characters is shown as <?>."""
    path = scratch(spark, "transcripts")
    table(spark, d, "nation").select("n_nationkey", F.expr(_NATION_TEXT).alias("value")).repartition("n_nationkey").write.partitionBy("n_nationkey").text(path)
    found = readers.read_transcripts(spark, path)
    return found.select(F.regexp_extract("path", r"n_nationkey=(\d+)", 1).cast("int").alias("n_nationkey"), F.replace("text", F.lit("\x00"), F.lit("<?>")).alias("text"))


@query("""WITH q AS (SELECT lpad(p_partkey::VARCHAR, 9, '0') AS id, CASE WHEN p_partkey % 4 = 0 THEN p_type WHEN p_partkey % 4 = 1 THEN p_type WHEN p_partkey % 4 = 2 THEN p_name END AS query FROM part)
SELECT id, query FROM q WHERE query IS NOT NULL ORDER BY id LIMIT 100""")
def read_pages_as_queries(spark: SparkSession, d: str) -> DataFrame:
    """The clean text of a read page, else the raw one; the first hundred are asked for."""
    k, path = F.col("p_partkey"), scratch(spark, "readings")
    rows = table(spark, d, "part").select(F.lpad(k.cast("string"), 9, "0").alias("id"), F.when(k % 4 == 1, F.col("p_type")).when(k % 4 != 3, F.col("p_name")).alias("teks"), F.when(k % 4 == 0, F.col("p_type")).when(k % 4 == 1, F.lit(" ")).alias("teks_bersih"))
    sinks.write_jsonl(rows, path)
    return readers.read_queries(spark, path, 100)


@query("SELECT n_nationkey::VARCHAR AS a, n_name AS b FROM nation UNION ALL SELECT 'kunci', 'nama' FROM region")
def markdown_tables(spark: SparkSession, d: str) -> DataFrame:
    """A report for each region: a heading, a table of its nations, a closing line."""
    path = scratch(spark, "reports")
    line = F.concat(F.lit("| "), F.col("n_nationkey"), F.lit(" | "), F.col("n_name"), F.lit(" |"))
    body = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("t"))  # the nations of a region
    text = F.concat(F.lit("# Laporan\n\n| kunci | nama |\n|---|:--|\n"), F.col("t"), F.lit("\n\nselesai | bukan\n"))
    body.select("n_regionkey", text.alias("value")).repartition("n_regionkey").write.partitionBy("n_regionkey").text(path)
    return readers.read_markdown_table(spark, path).select(F.col("cells")[0].alias("a"), F.col("cells")[1].alias("b"))


@query("SELECT 'gambar-' || s_suppkey AS image, s_suppkey::VARCHAR AS article_id, 'https://x.id/' || s_suppkey AS url FROM supplier")
def image_sources(spark: SparkSession, d: str) -> DataFrame:
    path, k = scratch(spark, "images"), F.col("s_suppkey")
    rows = table(spark, d, "supplier").select(F.concat(F.lit("a/b/gambar-"), k, placed("s_suppkey", ".png", ".jpeg", "")).alias("image"), k.alias("article_id"), F.concat(F.lit("https://x.id/"), k).alias("url"))
    sinks.write_csv(rows, path, rows.columns)
    return readers.read_source_map(spark, path)


# Sinks.


@query("SELECT count(*) AS jumlah, max(len(embedding)) AS dimensi, 'kecil' AS varian, 'abc' AS teks_sha1, count(*) AS stored FROM embeddings")
def stored_vectors(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "vectors")
    sinks.write_vectors(table(spark, d, "embeddings"), path, "kecil", "abc")
    meta = spark.read.schema("jumlah long, dimensi int, varian string, teks_sha1 string").json(f"{path}/meta")
    return meta.withColumn("stored", F.lit(spark.read.parquet(f"{path}/vectors").count()))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '{"galat":{"kode":"teks_kurang"}}' ELSE '{"lang":"' || lang || '","n":' || n_chars || ',"note":null}' END AS body FROM documents""")
def result_bodies(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "lang", F.col("n_chars").alias("n"), F.lit(None).cast("string").alias("note"), F.when(F.col("doc_id") % 3 == 0, "teks_kurang").alias("error"))
    return sinks.envelope(rows)


@query("SELECT n_nationkey, sha256(n_name || chr(10)) AS sha256 FROM nation")
def hashed_files(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "files")
    table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("value")).repartition("n_nationkey").write.partitionBy("n_nationkey").text(path)
    found = sinks.file_hashes(spark, f"{path}/*/*.txt")
    return found.select(F.regexp_extract("path", r"n_nationkey=(\d+)", 1).cast("int").alias("n_nationkey"), "sha256")


@query("SELECT ceil(count(*) / 100)::BIGINT AS entries, count(*) AS last FROM region, supplier WHERE r_regionkey = 0")
def numbered_commits(spark: SparkSession, d: str) -> DataFrame:
    """Eight writers at once append the suppliers by hundreds, each adding to what the entry before it says."""
    from concurrent.futures import ThreadPoolExecutor

    n = table(spark, d, "supplier").count()
    sizes = [min(100, n - at) for at in range(0, n, 100)]
    log = CommitLog(spark, scratch(spark, "commits"))
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(lambda k: log.append(lambda last: {"total": (last["total"] if last else 0) + k}), sizes))
    return spark.createDataFrame([(len(log.numbers()), log.latest()[1]["total"])], "entries long, last long")


# What has no other query: file lists, retention of words, pieces of texts, orders and batches.


@query("""SELECT p_partkey, list_sort(list_distinct(list_filter(['a' || (p_partkey % 3), 'b' || (p_partkey % 5), 'c'], lambda x: x NOT IN ('a' || (p_partkey % 2), 'b' || (p_partkey % 3))))) AS gone FROM part""")
def files_gone(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    name = lambda letter, n: F.concat(F.lit(letter), k % n)
    return table(spark, d, "part").select("p_partkey", arrays.files_to_delete(F.array(name("a", 3), name("b", 5), F.lit("c")), F.array(name("a", 2), name("b", 3))).alias("gone"))




@query("""WITH w AS (SELECT p_partkey, list_distinct(regexp_extract_all(lower(p_name || ' ' || p_type), '\\w+')) AS a, list_distinct(regexp_extract_all(lower(p_type || ' ' || p_brand), '\\w+')) AS b FROM part)
SELECT p_partkey, len(list_filter(a, lambda x: list_contains(b, x))) AS kept, len(list_filter(a, lambda x: NOT list_contains(b, x))) AS lost FROM w""")
def words_retained(spark: SparkSession, d: str) -> DataFrame:
    found = alignment.word_retention(F.concat_ws(" ", "p_name", "p_type"), F.concat_ws(" ", "p_type", "p_brand"))
    return table(spark, d, "part").select("p_partkey", found.alias("r")).select("p_partkey", "r.kept", "r.lost")


@query("""WITH RECURSIVE t AS (SELECT p_partkey, lower(p_type) AS needle, lower(p_name) || ' ' || lower(substr(p_type, 1 + p_partkey % 3)) || ' x' AS hay FROM part WHERE p_partkey % 50 = 0),
r(p_partkey, needle, hay, j, v, best) AS (SELECT p_partkey, needle, hay, 0, range(length(needle) + 1), length(needle) FROM t
  UNION ALL SELECT p_partkey, needle, hay, j + 1, n, least(best, n[-1]) FROM (SELECT p_partkey, needle, hay, j, best,
    list_reduce(list_concat([[0]], list_transform(range(1, length(needle) + 1), lambda i: [least(v[i + 1] + 1, v[i] + (substr(needle, i, 1) <> substr(hay, j + 1, 1))::INT)])),
      lambda acc, x: list_append(acc, least(x[1], acc[-1] + 1))) AS n FROM r WHERE j < length(hay)))
SELECT p_partkey, min(best) AS distance FROM r GROUP BY p_partkey""")
def nearest_pieces(spark: SparkSession, d: str) -> DataFrame:
    """How far the nearest piece of a longer text is from a type; the stated queries are the parts whose key is divisible by 50."""
    parts = table(spark, d, "part").filter("p_partkey % 50 = 0")
    hay = F.concat(F.lower("p_name"), F.lit(" "), F.lower(F.expr("substring(p_type, 1 + CAST(p_partkey % 3 AS INT))")), F.lit(" x"))
    return parts.select("p_partkey", alignment.nearest_piece_distance(F.lower("p_type"), hay).alias("distance"))


@query("""SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size % 2 <> 0, p_size, p_partkey) AS place FROM part""")
def feature_places(spark: SparkSession, d: str) -> DataFrame:
    """The place of each row when features of high confidence come first, then the fixed order."""
    from pyspark.sql.window import Window

    rows = table(spark, d, "part").select("p_partkey", "p_brand", F.when(F.col("p_size") % 2 == 0, features.HIGH).otherwise("sedang").alias("confidence"), F.col("p_size").alias("ord"))
    return rows.select("p_partkey", F.row_number().over(Window.partitionBy("p_brand").orderBy(*features.feature_order(), "p_partkey")).alias("place"))


@query("""WITH o AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate::DATE END AS date FROM orders)
SELECT row_number() OVER (ORDER BY date DESC NULLS LAST, id DESC) AS place, id FROM o""")
def articles_in_order(spark: SparkSession, d: str) -> DataFrame:
    """Latest first, without a date last: the rows of the ordered files are numbered as they lie."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate").cast("date")).alias("date"))
    ordered = resolve.final_order(rows).select("id", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m"))
    path = scratch(spark, "ordered")
    ordered.write.parquet(path)
    from pyspark.sql.window import Window

    kept = spark.read.schema(ordered.schema).parquet(path)
    sizes = kept.groupBy("p").agg(F.count("*").alias("n"))
    before = sizes.select("p", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row for each file
    return kept.join(before, "p").select((F.row_number().over(Window.partitionBy("p").orderBy("m")) + F.col("before")).alias("place"), "id")


@query("SELECT count(*) AS n, true AS in_order, true AS apart FROM documents")
def batches_by_length(spark: SparkSession, d: str) -> DataFrame:
    """Whether texts lie by length inside each partition, and partitions hold ranges of lengths that meet at their ends only."""
    from pyspark.sql.window import Window

    dealt = reports.length_sorted(table(spark, d, "documents").select("doc_id", "text"), 4)
    rows = dealt.select(F.length("text").alias("n"), F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m"))
    path = scratch(spark, "lengths")
    rows.write.parquet(path)
    kept = spark.read.schema(rows.schema).parquet(path)
    steps = kept.withColumn("up", F.col("n") >= F.coalesce(F.lag("n").over(Window.partitionBy("p").orderBy("m")), F.lit(0)))
    ends = steps.groupBy("p").agg(F.count("*").alias("c"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("up").alias("up"))
    meets = ends.withColumn("apart", F.col("lo") >= F.coalesce(F.lag("hi").over(Window.orderBy("p")), F.lit(0)))  # a row for each partition
    return meets.agg(F.sum("c").alias("n"), F.min("up").alias("in_order"), F.min("apart").alias("apart"))


@query("""WITH s AS (SELECT c_custkey, c_acctbal, ['[a-e]\\w*', '\\d+', 'customer'][CASE WHEN c_custkey % 2 = 0 THEN 3 ELSE 2 END] AS p FROM customer)
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE 1 END AS pattern FROM s""")
def patterns_of_spans(spark: SparkSession, d: str) -> DataFrame:
    """Which of three patterns has a match at just a name's word, or at just its number."""
    patterns = [("kuat", "customer"), ("kuat", r"\d+"), ("lemah", r"[a-e]\w*")]
    even = F.col("c_custkey") % 2 == 0
    at = F.instr("c_name", "#")
    start, end = F.when(even, F.lit(0)).otherwise(at), F.when(even, F.lit(8)).otherwise(F.length("c_name"))
    return table(spark, d, "customer").select("c_custkey", features.pattern_of(F.lower("c_name"), patterns, start, end).alias("pattern"))
