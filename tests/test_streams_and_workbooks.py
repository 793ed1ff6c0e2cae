"""Workbooks, numbered commits, crawls and captures: what files and streams must survive."""

import datetime as dt
import zipfile
from collections import Counter
from concurrent.futures import ThreadPoolExecutor
from types import SimpleNamespace

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from clearsift.operators.phrases import Gap, Matcher, Number, Words, phrase
from clearsift.sources import sinks
from clearsift.sources.commit_log import CommitLog
from clearsift.sources.xlsx import MAIN, RELATIONS, Workbook, convert, read_xlsx, write_xlsx
from clearsift.streaming import frames, listing

HEAD = f'<worksheet xmlns="{MAIN}"><sheetData>'


def workbook(path, sheets, shared="", formats="", date1904=False):
    """A workbook as other programs write it: given sheet rows, shared strings and styles."""
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{RELATIONS}"><workbookPr date1904="{int(date1904)}"/><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="/xl/worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        for i, rows in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/s{i}.xml", HEAD + rows + "</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">{shared}</sst>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{MAIN}"><numFmts>{formats}</numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/><xf numFmtId="165"/><xf numFmtId="14"/></cellXfs></styleSheet>')


def test_foreign_workbooks(spark, tmp_path):
    shared = '<si><t>id</t></si><si><r><t>na</t></r><r><t xml:space="preserve">me </t></r><rPh><t>x</t></rPh></si><si><t>a_x0041_b</t></si>'
    rows = '<row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>day</t></is></c><c r="D1" t="s"><v>1</v></c></row><row/>'
    rows += '<row><c r="A2"><v>1</v></c><c r="B2" s="1"><v>45000.5</v></c><c r="D2" t="s"><v>2</v></c></row><row><c r="B3" t="e"><v>#N/A</v></c></row>'
    rows += '<row><c r="A4"><v>2.5</v></c><c r="B4" s="2"><v>7</v></c><c r="D4" t="b"><v>1</v></c><c r="AB4" t="str"><v>far</v></c></row>'
    formats = '<numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/><numFmt numFmtId="165" formatCode="0 &quot;days&quot;"/>'
    workbook(tmp_path / "a.xlsx", {"one": rows, "two": '<row><c t="inlineStr"><is><t>id</t></is></c></row><row><c><v>9</v></c></row>'}, shared, formats)
    path = str(tmp_path / "a.xlsx")
    schema = "id int, day timestamp, `name ` string, missing string"
    got = [tuple(r) for r in read_xlsx(spark, path, schema).collect()]
    assert got == [(1, dt.datetime(2023, 3, 15, 12), "aAb", None), (None, None, "true", None)]
    assert read_xlsx(spark, path).columns == ["id", "day", "name "]
    assert Counter(r.id for r in read_xlsx(spark, path, "id int", sheet="all").collect()) == Counter([1, None, 9])
    assert [r.id for r in read_xlsx(spark, path, "id int", sheet="two").collect()] == [9]
    workbook(tmp_path / "b.xlsx", {"s": '<row><c t="inlineStr"><is><t>d</t></is></c></row><row><c s="3"><v>1</v></c></row>'}, date1904=True)
    assert read_xlsx(spark, str(tmp_path / "b.xlsx"), "d date").first().d == dt.date(1904, 1, 2)


def test_rows_of_a_sheet_are_streamed(tmp_path):
    workbook(tmp_path / "c.xlsx", {"s": "".join(f"<row><c><v>{i}</v></c></row>" for i in range(5000))})
    with zipfile.ZipFile(tmp_path / "c.xlsx") as z:
        rows = Workbook(z).rows("xl/worksheets/s0.xml")
        assert next(rows) == [0] and sum(1 for _ in rows) == 4999


def test_written_workbooks(spark, tmp_path):
    odd = ['<&>"', "a\x07b", "_x0041_", "  blanks  ", "né\n2", None, "", "x" * 40_000]
    rows = [(i, odd[i % len(odd)], i % 3 == 0, i / 8, dt.date(1999, 12, 31) + dt.timedelta(i), dt.datetime(2024, 5, 6, 7, 8, 9) + dt.timedelta(seconds=i)) for i in range(64)]
    df = spark.createDataFrame(rows, "id long, t string, b boolean, x double, d date, at timestamp_ntz").repartition(3)
    path = str(tmp_path / "w")
    write_xlsx(df, path, rows_per_workbook=11)
    assert read_xlsx(spark, path, df.schema).rdd.getNumPartitions() == 9
    for _ in range(2):  # written again, the old workbooks go
        write_xlsx(df, path)
        assert sorted(map(tuple, read_xlsx(spark, path, df.schema).collect())) == sorted(rows, key=lambda r: r[0])
    write_xlsx(df.limit(0), path)
    assert read_xlsx(spark, path, df.schema).count() == 0
    assert convert("x", df.schema["id"].dataType) is None and convert(3.0, df.schema["t"].dataType) == "3"


def test_a_number_is_taken_once(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"))
    assert log.latest() is None and log.put(1, {"a": 1}) and not log.put(1, {"a": 2}) and log.entry(1) == {"a": 1}
    with ThreadPoolExecutor(8) as pool:
        wins = list(pool.map(lambda k: [n for n in range(2, 30) if log.put(n, {"by": k})], range(8)))
    assert Counter(n for w in wins for n in w) == Counter(range(2, 30))
    assert all(n in wins[log.entry(n)["by"]] for n in range(2, 30))
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(lambda _: log.append(lambda last: {"n": last.get("n", 0) + 1}), range(40)))
    assert log.numbers() == list(range(1, 70)) and log.latest()[1] == {"n": 40}
    assert {p.name for p in (tmp_path / "log").iterdir()} == {f"{n:020d}.json" for n in range(1, 70)}


def test_versions_of_several_writers(spark, tmp_path):
    root = str(tmp_path / "table")
    with ThreadPoolExecutor(4) as pool:
        paths = list(pool.map(lambda k: sinks.replace_checked(spark.range(10 + k), root), range(4)))
    assert sinks.current_version(spark, root)[0] in paths and len(CommitLog(spark, f"{root}/versions").numbers()) == 4
    with pytest.raises(ValueError, match="instead of"):
        sinks.replace_checked(spark.range(2), root)


def test_crawl_restarts_and_updates(spark, tmp_path):
    """Three sources of unequal length; the crawl is stopped twice before a batch is committed; pages grow before the update."""
    site, target = str(tmp_path / "site"), str(tmp_path / "crawl")
    schema = "source string, page int, url string, title string, date date"
    day = dt.date(2024, 1, 1)
    rows = [(s, p, f"https://{s}.id/{p}-{i}", "t", day) for s, n in (("a", 5), ("b", 3), ("c", 1)) for p in range(1, n + 1) for i in range(4)]
    rows += [("b", 3, "http://www.a.id/1-0/", "known by another form", day), ("c", 1, "https://c.id/old", "too old", dt.date(2001, 1, 1))]
    listing.write_site(spark.createDataFrame(rows, schema), site)
    fetch = lambda df: df.withColumn("error", F.when(F.col("url").endswith("-3") & (F.col("round") == 1), "x"))
    run = lambda **more: listing.crawl(spark, site, target, fetch, floor=dt.date(2010, 1, 1), **more)
    for _ in range(2):
        with pytest.raises(Exception, match="stopped"):
            run(most_batches=2)
    run()
    new = lambda: Counter(r.url for r in listing.crawled(spark, target).filter("status = 'baru'").collect())
    first = {u for _, _, u, t, _ in rows if not u.endswith("-3") and t == "t"}
    assert new() == Counter(first) and listing.years(spark, target) == {"2024": len(first)}
    statuses = Counter(r.status for r in listing.crawled(spark, target).collect())
    assert statuses == {"baru": len(first), "gagal": 9, "sudah": 1, "lama": 1}
    more = spark.createDataFrame([("c", 1, "https://c.id/fresh", "t", None)], schema)
    listing.write_site(spark.createDataFrame(rows, schema).unionByName(more), site)
    run(update=True)
    assert new() == Counter({u for _, _, u, t, _ in rows if t == "t"} | {"https://c.id/fresh"})
    run(update=True)  # nothing is new: each source ends at its first page
    assert listing.Cursor(f"{target}/cursor").read("position") == {s: [3, 1] for s in "abc"}
    assert listing.years(spark, target)["tanpa tanggal"] == 1


def test_a_replayed_batch_counts_once(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "years"))
    batch = spark.createDataFrame([("2024-01-01",), ("2024-02-01",), (None,)], "d string").select(F.to_date("d").alias("date"))
    assert listing.count_years(batch, 0, log) == {"2024": 2, "tanpa tanggal": 1}
    assert listing.count_years(batch, 0, log) == {"2024": 2, "tanpa tanggal": 1}
    assert listing.count_years(batch, 1, log) == {"2024": 4, "tanpa tanggal": 2}


def test_captures(spark, tmp_path):
    """Kept, exact, later, forced, absent and unasked frames; rows out of order within the lateness."""
    rules = frames.FrameRules(delay=1000, limit=5000, extra=2000)
    base = dt.datetime(2024, 1, 1)
    at = lambda ms: base + dt.timedelta(milliseconds=ms)
    cases = {1: [100, 900, 1500], 2: [100, 1000, 1001], 3: [2000, 1200], 4: [6500], 5: [7001], 6: [], 7: [999, 998], 8: [5000]}
    rows = [(c, at(0), None) for c in cases] + [(c, at(ms), 10 * c + i) for c, many in cases.items() for i, ms in enumerate(many)] + [(9, at(50), 90)]
    table = spark.createDataFrame(rows, "capture_id long, ts timestamp, frame_id long")
    expected = {1: (11, 900, False), 2: (21, 1000, False), 3: (31, 1200, False), 4: (40, 6500, True), 5: (None, None, True), 6: (None, None, True), 7: (70, 999, False), 8: (80, 5000, False)}
    shown = lambda df: {r.capture_id: (r.frame_id, r.at_ms, r.is_fallback) for r in df.collect()}
    assert shown(frames.choose_frames_at_rest(table, rules)) == expected
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    later = F.col("frame_id").isNotNull() & (F.col("frame_id") % 2 == 0)
    table.filter(~later).coalesce(1).write.mode("append").parquet(source)
    table.filter(later).coalesce(1).write.mode("append").parquet(source)
    spark.createDataFrame([(-1, at(86_400_000), None)], table.schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = frames.choose_frames(stream, rules, "1 minute").writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-c").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert shown(spark.read.schema(frames.CHOSEN).parquet(out)) == expected


class Calls:
    """A state with one value and timers, that counts its calls."""

    def __init__(self):
        self.value, self.timers, self.n = None, set(), 0

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def called(self, result=None):
        self.n += 1
        return result

    def get(self):
        return self.called(self.value)

    def update(self, value):
        self.value = self.called(value)

    def registerTimer(self, ms):  # noqa: N802
        self.called(self.timers.add(ms))

    def deleteTimer(self, ms):  # noqa: N802
        self.called(self.timers.remove(ms))

    clear = called


def test_captures_of_a_slot_share_calls(spark):
    """a thousand captures cost as many calls of the state as one, frames before their request and late rows included."""
    choice, state = frames.FrameChoice(frames.FrameRules(delay=1000, limit=5000, extra=2000), True), Calls()
    choice.init(state)
    pack = lambda rows: Row(**dict(zip(("captures", "ms", "frames"), map(list, zip(*rows)))))
    at = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    packs = [pack([(c, 10_500, 2 * c) for c in range(1000)]), pack([(c, 10_000, None) for c in range(1000)])]
    assert not list(choice.handleInputRows((0,), iter(packs), at(0))) and state.timers == {11_000} and state.n <= 3
    later = [pack([(0, 10_900, 1), (7, 10_400, 1), (5000, 10_900, 1)])]
    assert not list(choice.handleInputRows((0,), iter(later), at(10_950))) and state.timers == {11_000} and state.n <= 5
    found = {r.capture_id: (r.frame_id, r.at_ms, r.n_frames) for r in choice.handleExpiredTimer((0,), at(12_000), None)}
    assert found == {c: (2 * c, 500, 1) for c in range(1000)} | {0: (1, 900, 2), 7: (14, 500, 2)} and state.n <= 7
    assert not list(choice.handleInputRows((0,), iter([pack([(3, 10_000, None), (3, 10_100, 9)])]), at(30_000)))


def test_batches_of_captures(spark, tmp_path):
    """a call takes what has come since the last one, in many files, as one batch; what comes for decided captures changes nothing."""
    rules, source, out = frames.FrameRules(delay=1000, limit=5000, extra=2000), str(tmp_path / "in"), str(tmp_path / "out")
    ts = lambda ms: F.timestamp_millis(F.lit(1_704_067_200_000) + F.col("capture_id") * 10 + ms)
    captures, kind = spark.range(3000, numPartitions=3).withColumnRenamed("id", "capture_id"), frames.CAPTURES
    asked = captures.select("capture_id", ts(F.lit(0)).alias("ts"), F.lit(None).cast("long").alias("frame_id"))
    shown = captures.join(spark.range(1, 4).withColumnRenamed("id", "k")).select("capture_id", ts((F.col("capture_id") * 7 + F.col("k") * 1900) % 8000).alias("ts"), (F.col("capture_id") * 4 + F.col("k")).alias("frame_id"))
    shown = shown.filter("capture_id % 5 > 0")
    first, second = asked.unionByName(shown.filter("frame_id % 2 = 0")), shown.filter("frame_id % 2 = 1")
    end = spark.createDataFrame([(-1, dt.datetime(2024, 1, 3), None)], kind)
    for batch in (first, second, end, asked.filter("capture_id < 9").unionByName(end)):
        batch.write.mode("append").parquet(source)
        frames.take_frames(spark, source, out, rules, "1 hour")
    found, expected = spark.read.schema(frames.CHOSEN).parquet(out), frames.choose_frames_at_rest(first.unionByName(second), rules)
    assert found.count() == 3000 and found.exceptAll(expected).count() == 0
    assert found.filter("frame_id IS NULL").count() == 600


def test_phrases():
    matcher = Matcher([
        phrase("r", "a", "one two_three", 2, "end*"), phrase("r", "a", "one"), phrase("n", "a", "in", Number(2, ("days",))), phrase("u", "a", Words(("pin",), unless=("map",))), phrase("c", "a", Words(("src",), colon=True), Gap(1, ("via",)), "x-y"),
    ])
    found = lambda t: [(r, t[s:e]) for r, _, s, e in matcher.find(t)]
    assert found("ONE a b ending. one two three END") == [("r", "ONE a b ending"), ("r", "one two three END")]
    assert found("one, end someone one-off") == [("r", "one"), ("r", "one")]
    assert found("in 3 days, in 12days in 123 days") == [("n", "in 3 days"), ("n", "in 12days")]
    assert found("pin map pin maps pin") == [("u", "pin"), ("u", "pin")]
    assert found("src: x-y src : via x-y src via via x-y src x-yz") == [("c", "src: x-y"), ("c", "src : via x-y")]
    assert found("") == [] and found("two") == []
