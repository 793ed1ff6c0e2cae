"""Readers of article sources, tolerant and strict, and the adapters to one article schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clearsift.functions.dates_numbers import parse_date
from clearsift.functions.text import narrative_before_rebuttal, narrative_section, squeeze, tidy, title_label

ARTICLE = "source string, title string, url string, date date, narrative string, label_raw string, verdict string, ref_urls array<string>"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, asked of the file system that Spark reads it from."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Tolerant: a missing file is an empty table; blank and malformed lines are skipped."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_jsonl_strict(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Fails on the first bad line."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def account_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(line, problem): every line that isn't blank, with what is wrong with it: bytes that are no UTF-8, no JSON, no object."""
    raw = spark.read.text(path).select(F.col("value").alias("line")).filter(F.trim("line") != "")
    parsed = F.try_parse_json("line")
    problem = (
        F.when(F.contains("line", F.lit("�")), F.lit("bukan utf-8"))
        .when(parsed.isNull(), F.lit("bukan json"))
        .when(~F.schema_of_variant(parsed).startswith("OBJECT"), F.lit("bukan objek"))
    )
    return raw.withColumn("problem", problem)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a header, quoted line breaks, a byte order mark and fields of any length."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("maxCharsPerColumn", -1).option("enforceSchema", True).csv(path)


def _article(rows: DataFrame, source: str, **columns: Column) -> DataFrame:
    empty = {"verdict": F.lit(None).cast("string"), "ref_urls": F.array().cast("array<string>")}
    return rows.select(F.lit(source).alias("source"), *[c.alias(n) for n, c in ({"title": F.lit(None)} | empty | columns).items()]).select("source", "title", "url", "date", "narrative", "label_raw", "verdict", "ref_urls")


def adapt_titled(rows: DataFrame, source: str) -> DataFrame:
    """Rows (title, url, date, content): without an address they are dropped; the narrative is the content's section."""
    kept = rows.filter(F.trim(F.coalesce("url", F.lit(""))) != "")
    return _article(kept, source, title=squeeze(F.col("title")), url=F.trim("url"), date=parse_date(F.col("date")), narrative=narrative_section(F.col("content")), label_raw=title_label(F.col("title")))


def adapt_with_lookup(rows: DataFrame, source: str, narratives: DataFrame) -> DataFrame:
    """Like adapt_titled; a narrative known by address key comes before the extracted one."""
    from clearsift.operators.resolve import enrich_narrative

    return enrich_narrative(adapt_titled(rows, source), narratives).select("source", "title", "url", "date", "narrative", "label_raw", "verdict", "ref_urls")


def adapt_with_references(rows: DataFrame, source: str, label: str = "HOAKS", marker: str = "Link Counter") -> DataFrame:
    """Rows (title, url, date, body): a fixed label, the narrative before the rebuttal, and the addresses after a marker."""
    after = F.regexp_extract("body", rf"(?s){marker}(.*)$", 1)
    refs = F.transform(F.regexp_extract_all(after, F.lit(r"https?://\S+"), F.lit(0)), lambda u: F.regexp_replace(u, r"[.,;:)\]]+$", ""))
    return _article(rows, source, title=squeeze(F.col("title")), url=F.trim("url"), date=parse_date(F.col("date")), narrative=narrative_before_rebuttal(F.col("body")), label_raw=F.lit(label), ref_urls=refs)


def adapt_crawled(rows: DataFrame, source: str) -> DataFrame:
    """Crawled rows (title, url, date, label, verdict, narrative, error): failed ones are dropped, a missing label is the title's."""
    kept = rows.filter("error IS NULL")
    label = F.coalesce(F.nullif(F.trim("label"), F.lit("")), title_label(F.col("title")))
    return _article(kept, source, title=squeeze(F.col("title")), url=F.trim("url"), date=parse_date(F.col("date")), narrative=tidy(F.col("narrative")), label_raw=label, verdict=F.col("verdict"))


def read_labelled_metadata(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The evaluation set's rows, and the rows that break a rule with the reason: ids must be unique, sets known."""
    schema = "id string, berkas string, `set` string, label_harapan string, label_boleh string, kategori string, sintetis string, id_artikel_sumber string"
    rows = read_csv(spark, path, schema)
    repeated = rows.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id", F.lit(True).alias("repeated"))
    problem = F.when(F.col("repeated"), "id ganda").when(~F.col("set").isin("dev", "uji") | F.col("set").isNull(), "set tidak dikenal").when(F.trim(F.coalesce("label_harapan", F.lit(""))) == "", "label kosong")
    judged = rows.join(repeated, "id", "left").withColumn("problem", problem).drop("repeated")
    good = judged.filter("problem IS NULL").drop("problem").withColumns({"label_boleh": F.filter(F.split("label_boleh", ";"), lambda x: F.trim(x) != ""), "sintetis": F.lower("sintetis").isin("1", "true", "ya")})
    return good, judged.filter("problem IS NOT NULL").select("id", "problem")


def image_problem(content: Column, most_bytes: int) -> Column:
    """The status of an upload that is no usable picture: 400 empty, 413 too large, 415 neither JPEG nor PNG; null for good."""
    n = F.coalesce(F.octet_length(content), F.lit(0))
    head = F.hex(F.substring(content, 1, 8))
    known = head.startswith("FFD8FF") | (head == "89504E470D0A1A0A")
    return F.when(n == 0, 400).when(n > most_bytes, 413).when(~known, 415)


def read_false_news(spark: SparkSession, path: str, with_narrative: bool) -> DataFrame:
    """(doc_id, text, label) of a labelled news set (id, judul, narasi, label): labels 0 and 1 only."""
    rows = read_csv(spark, path, "id string, judul string, narasi string, label string").filter(F.trim("label").isin("0", "1"))
    body = F.concat_ws(". ", "judul", F.nullif(F.trim("narasi"), F.lit(""))) if with_narrative else F.col("judul")
    return rows.select(F.col("id").alias("doc_id"), body.alias("text"), F.trim("label").cast("int").alias("label"))


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of transcripts, whole files; [UI]...[/UI] and [?] become the marks that the error rate knows.
    Files that begin with DRAF are refused by a null text."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("t"))
    marked = F.regexp_replace(F.regexp_replace("t", r"\[/?UI\]", "\x01"), r"\[\?\]", "\x00")
    return raw.select("path", F.when(~F.col("t").rlike(r"^\s*DRAF"), F.regexp_replace(marked, r"^\s+|\s+$", "")).alias("text"))


def read_queries(spark: SparkSession, path: str, n: int) -> DataFrame:
    """(id, query): of read pages in JSON files the clean text, else the raw one; the first n by id (the limit is asked for)."""
    rows = spark.read.schema("id string, teks string, teks_bersih string").json(path)
    return rows.select("id", F.coalesce(F.nullif(F.trim("teks_bersih"), F.lit("")), "teks").alias("query")).filter("query IS NOT NULL").orderBy("id").limit(n)


def read_markdown_table(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, cells): the rows of the tables of Markdown reports, by file and line, without headings' rules."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", r"\r?\n")).alias("pos", "t"))
    rows = lines.withColumn("t", F.trim("t")).filter(F.col("t").rlike(r"^\|.*\|$") & ~F.col("t").rlike(r"^\|[\s:|\-]+\|$"))
    return rows.select("path", "pos", F.transform(F.split(F.regexp_replace("t", r"^\||\|$", ""), r"\|"), lambda c: F.trim(c)).alias("cells"))


def read_source_map(spark: SparkSession, path: str) -> DataFrame:
    """(image, article_id, url) of a map of images to articles."""
    return read_csv(spark, path, "image string, article_id string, url string").withColumn("image", F.regexp_extract("image", r"([^/]+?)(?:\.\w+)?$", 1))
