"""Operators whose work grows with their input only, and whole results where a group has nothing to show."""

import datetime as dt

from pyspark.sql import functions as F

from clearsift.operators import evaluation, faithful, misread, reports
from clearsift.plans import fixture_queries, planted_queries
from clearsift.sources.commit_log import CommitLog
from clearsift.streaming import listing


def test_ids_of_groups_without_any(spark):
    """Every group has a row, that of a null and those without an id too; places count on over ranges."""
    rows = [(i, "a" if i % 3 else None, i) for i in range(40)] + [(100, "b", 1)]
    found = evaluation.ids_where(spark.createDataFrame(rows, "doc_id long, source string, n long"), F.col("n") >= 10, "source").collect()
    expected = [("a", k + 1, i) for k, i in enumerate(i for i in range(10, 40) if i % 3)] + [(None, k + 1, i) for k, i in enumerate(range(12, 40, 3))] + [("b", None, None)]
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, expected))


def test_commits_do_not_list_the_log(spark, tmp_path, monkeypatch):
    """The last number is found without a look at all entries, by a writer that has just come, too."""
    log = CommitLog(spark, str(tmp_path / "log"))
    monkeypatch.setattr(CommitLog, "numbers", lambda self: 1 / 0)
    for _ in range(21):
        log.append(lambda last: {"n": (last or {"n": 0})["n"] + 1})
    other = CommitLog(spark, str(tmp_path / "log"))
    assert other.latest() == (21, {"n": 21}) and other.append(lambda last: {"n": 0})[0] == 22 and log.latest()[0] == 22


def test_batches_of_a_crawl_grow(spark, tmp_path):
    """Forty pages of one source take six batches, each page once, in tasks of several pages."""
    site, target = str(tmp_path / "site"), str(tmp_path / "crawl")
    rows = [("s", p, f"https://s.id/{p}", "t", dt.date(2024, 1, 1)) for p in range(1, 41)]
    listing.write_site(spark.createDataFrame(rows, "source string, page int, url string, title string, date date"), site)
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    listing.crawl(spark, site, target, state_partitions=1)
    found = listing.crawled(spark, target)
    assert sorted(r.page for r in found.collect()) == list(range(1, 41)) and found.select("batch").distinct().count() == 6
    assert spark.conf.get("spark.sql.shuffle.partitions") == partitions
    reader = listing.ListingReader({"path": site, "cursor": str(tmp_path / "cursor")})
    assert len(reader.partitions({}, {"s": [1, 40]})) == 2


def test_a_crawl_keeps_addresses_that_differ_behind_a_hash(spark, tmp_path):
    """Two articles of one page, and one of them by another form of its address: two are new."""
    site, target = str(tmp_path / "site"), str(tmp_path / "crawl")
    rows = [("s", 1, f"https://s.id/de/7#top?p={k}", "t", dt.date(2023, 2, k)) for k in (1, 2)] + [("s", 2, "HTTP://www.s.id/de/7#top?p=2/", "t", None)]
    listing.write_site(spark.createDataFrame(rows, "source string, page int, url string, title string, date date"), site)
    listing.crawl(spark, site, target, state_partitions=1)
    assert sorted((r.url[-1], r.status) for r in listing.crawled(spark, target).collect()) == [("/", "sudah"), ("1", "baru"), ("2", "baru")]
    assert listing.years(spark, target) == {"2023": 2}


def test_misread_titles_do_not_meet_a_vocabulary(spark, monkeypatch):
    """Words are held against their pair's text only: equal ones, or misread from five letters on without digits."""
    monkeypatch.setattr(misread, "misread_pairs", lambda *_: 1 / 0)
    titles = spark.createDataFrame([(1, w) for w in ("garuda", "abcd", "ab12c", "merdeka", "kapal")] + [(2, "garuda")], "title_id int, token string")
    texts = spark.createDataFrame([(7, w) for w in ("garudo", "abce", "ab13c", "merdvkx", "kapalan")] + [(8, "garuda"), (8, "abcd"), (8, "x")], "text_id int, token string")
    pairs = spark.createDataFrame([(1, 1, 7), (2, 1, 8), (3, 2, 7), (4, 2, 9)], "pair_id int, title_id int, text_id int")
    assert dict(map(tuple, misread.words_found_misread(pairs, titles, texts).collect())) == {1: 2, 2: 2, 3: 1, 4: 0}


def test_ranges_of_length_are_not_a_few(spark):
    """A task's share of texts does not hang on the asked number of ranges alone, and texts of one length lie in several."""
    texts = spark.range(4000).select(F.lpad(F.col("id").cast("string"), 9, "0").alias("text"))
    dealt = reports.length_sorted(texts, 2).select(F.spark_partition_id().alias("p"))
    assert dealt.distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_small_files_are_spread(spark):
    """Rows of one file are worked on by all cores."""
    assert planted_queries.table(spark, "/root/testdata/sf0.001", "part").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_turned_claims(spark):
    """A word that the text denies and the claim does not, in another form; one that stands both ways is no change."""
    rows = [(1, "Pembeli membayar ongkos", "Pembeli tidak bayar ongkos hari ini"), (2, "Pembeli membayar ongkos", "Pembeli tidak bayar ongkos. Pembeli membayar ongkos")]
    found = faithful.check_faithfulness(spark.createDataFrame(rows, "id int, claim string, text string"))
    reasons = {r.id: r.reason for r in found.collect()}
    assert reasons == {1: faithful.NEGATION, 2: None}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "stems" in plan


def test_clean_texts_without_a_kept_line(spark, tmp_path):
    """No kept line is no text, no text has no line; an emoji, a mark and a joiner are no letters, numbers of any script are."""
    import duckdb

    texts = [None, "", "!!!", ".\n\n-", "a\n\nb", "\u2764\ufe0f\nok", "x\n\u0301", "x\n\u200c", "x\n\u0bf0", "x\n\u216f\n"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name, columns in (("clean_text", ["doc_id", "text", "n_dropped"]), ("line_drop_reasons", ["reason", "n"])):
        got = fixture_queries.QUERIES[name](spark, str(tmp_path)).select(*columns).collect()
        expected = duck.execute(f"SELECT {', '.join(columns)} FROM ({fixture_queries.ORACLE_SQL[name]})").fetchall()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))
