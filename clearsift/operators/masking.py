"""Masking of e-mail addresses, phone numbers and account names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Tokens and patterns of what is masked.
NUMBER_TOKEN, EMAIL_TOKEN, ACCOUNT_TOKEN = "[NOMOR]", "[EMAIL]", "[AKUN]"
EMAIL = r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"
LINK = r"(?i:(?:https?://|www\.)\S+|\b[a-z0-9-]+(?:\.[a-z0-9-]+)*\.(?:com|id|co|net|org|me|ly|link|info|xyz|site|online|click|top|app)\b\S*)"
LOCAL_PHONE = r"(?<![\w])(?:\+?62|0)[ ]?8[\d \-.]{6,14}\d(?!\d)"
FOREIGN_PHONE = r"(?<![\w])\+\d{1,3}[ \-]?\d[\d \-]{7,12}\d(?!\d)"
CUT_PHONE = r"(?<![\w])\+62[ ]?8\d"
SIMPLE_PHONE = r"(?<![\w])(?:\+?62|0)\s?8[\d\s\-.]{7,13}\d(?!\d)|(?<![\w])\+\d{1,3}[\s-]?\d[\d\s-]{7,12}\d(?!\d)"
ANY_SIGN = r"@|\+\d|(?:62|0) ?8"  # each of the patterns above and below has one
ACCOUNT = r"(?<![\w/@])@[A-Za-z0-9_.]{2,}"


def mask_emails(x: Column) -> Column:
    return F.regexp_replace(F.coalesce(x, F.lit("")), EMAIL, EMAIL_TOKEN)


def _mask_counted(x: Column, pattern: str, least: int, most: int) -> Column:
    """Masks the matches with a number of digits in bounds, by cutting the text at all of them and joining it again."""
    found = F.regexp_extract_all(x, F.lit(pattern), F.lit(0))
    digits = lambda m: F.length(F.regexp_replace(m, r"\D", ""))
    new = F.transform(found, lambda m: F.when((digits(m) >= least) & (digits(m) <= most), F.lit(NUMBER_TOKEN)).otherwise(m))
    joined = F.array_join(F.zip_with(F.split(x, pattern, -1), new, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.when(x.rlike(pattern), joined).otherwise(x)


def _mask_piece(x: Column) -> Column:
    """Numbers and accounts of a text without links."""
    local = _mask_counted(x, LOCAL_PHONE, 10, 14)
    foreign = _mask_counted(local, FOREIGN_PHONE, 9, 15)
    return F.regexp_replace(F.regexp_replace(foreign, CUT_PHONE, NUMBER_TOKEN), ACCOUNT, ACCOUNT_TOKEN)


def mask_text(x: Column) -> Column:
    """E-mails first, then numbers and accounts between the links, which stay as they are. A text without the signs that all of
    them have is left alone."""
    text = mask_emails(x)
    links = F.regexp_extract_all(text, F.lit(LINK), F.lit(0))
    between = F.transform(F.split(text, LINK, -1), _mask_piece)
    joined = F.array_join(F.zip_with(between, links, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.when(~x.rlike(ANY_SIGN), x).when(text.rlike(LINK), joined).otherwise(_mask_piece(text))


def mask_simply(x: Column) -> Column:
    """The simpler masker of comparisons: no count of digits, no account lines, one pattern for numbers."""
    text = mask_emails(x)
    piece = lambda t: F.regexp_replace(F.regexp_replace(t, SIMPLE_PHONE, NUMBER_TOKEN), ACCOUNT, ACCOUNT_TOKEN)
    links = F.regexp_extract_all(text, F.lit(LINK), F.lit(0))
    return F.array_join(F.zip_with(F.transform(F.split(text, LINK, -1), piece), links, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def _letters_share_run(a: Column, b: Column, run: int = 6) -> Column:
    """Whether two tokens share a run of letters: whether their pieces of letters share a gram of that length."""
    grams = lambda t: F.flatten(F.transform(F.regexp_extract_all(t, F.lit(f"[a-z]{{{run},}}"), F.lit(0)), lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - run + 1), lambda i: F.substring(p, i, F.lit(run)))))
    return F.arrays_overlap(grams(a), grams(b))


def account_family(tokens: Column) -> Column:
    """Whether tokens are accounts of one family: two long ones share letters, all others are copies or marked."""
    partner = lambda t: F.exists(tokens, lambda o: (o != t) & (F.length(t) >= 10) & (F.length(o) >= 10) & _letters_share_run(t, o))
    family = F.filter(tokens, partner)
    return (F.size(family) >= 2) & F.forall(tokens, lambda t: F.array_contains(family, t) | t.rlike("[0-9._]"))


_TOKEN, _TLD, _AMOUNT = r"^[A-Za-z0-9._]{4,}$", r"(?i)\.(?:com|id|me|co|net|org|ly|link|xyz|top|app|site|info|online|click)$", r"(?i)^(?:rp|usd|idr)?[\d.,]+\w{0,3}$"


def is_account_line(line: Column) -> Column:
    """Whether a line holds nothing but account names: shaped so, no domain, no shouting, a family or half of them marked."""
    tokens = F.transform(F.filter(F.split(F.trim(line), r"\s+"), lambda t: t != ""), lambda t: F.regexp_replace(t, r"[.,;:!?]+$", ""))
    letters = lambda t: F.regexp_replace(t, "[^A-Za-z]", "")
    shaped = F.forall(tokens, lambda t: t.rlike(_TOKEN) & (letters(t) != "") & ~t.rlike(_TLD) & ~((F.length(letters(t)) >= 4) & (letters(t) == F.upper(letters(t)))))
    marked = F.size(F.filter(tokens, lambda t: t.rlike(r"[0-9_]|[A-Za-z0-9]\.[A-Za-z0-9]") & (F.length(letters(t)) >= 4) & ~t.rlike(_AMOUNT)))
    family = (F.size(tokens) >= 2) & account_family(F.transform(tokens, lambda t: F.lower(t)))
    few = line.rlike(r"^\s*+\S++(?:\s++\S++){0,7}+\s*+\z")  # one to eight tokens
    return few & shaped & (family | ((marked > 0) & (marked * 2 >= F.size(tokens))))


def account_lines(lines: DataFrame) -> DataFrame:
    """(doc_id, at): the places of account lines among lines (doc_id, pos, text; pos without gaps), of documents that have any.

    Lines are told by themselves, or as a run of single-token lines of one family. Only lines that may be either are
    grouped: the others, nearly all, are read once where they lie."""
    text = F.trim("text")
    single, own = text.rlike(_TOKEN) & F.col("text").rlike("[A-Za-z]") & ~text.rlike(_TLD), is_account_line(F.col("text"))
    possible = lines.filter(single | own).select("doc_id", "pos", single.alias("single"), own.alias("own"), F.lower(text).alias("token"))
    nth = F.row_number().over(Window.partitionBy("doc_id", "single").orderBy("pos"))
    runs = possible.withColumn("run", F.when(F.col("single"), F.col("pos") - nth)).groupBy("doc_id", "run").agg(
        F.collect_list("pos").alias("at"), F.collect_list(F.when(F.col("own"), F.col("pos"))).alias("own"), F.collect_list("token").alias("tokens")
    )
    family = F.col("run").isNotNull() & (F.size("at") >= 2) & account_family(F.col("tokens"))
    return runs.groupBy("doc_id").agg(F.flatten(F.collect_list(F.when(family, F.col("at")).otherwise(F.col("own")))).alias("at")).filter(F.size("at") > 0)


def mask_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, text): account lines first, token by token, then mask_text on the whole. Texts move once, to meet their account lines."""
    from clearsift.operators.lines import explode_lines

    at = account_lines(explode_lines(docs))
    tokens = lambda t: F.array_join(F.transform(F.filter(F.split(F.trim(t), r"\s+"), lambda w: w != ""), lambda w: F.lit(ACCOUNT_TOKEN)), " ")
    masked = F.array_join(F.transform(F.split("text", "\n"), lambda t, i: F.when(F.array_contains("at", i), tokens(t)).otherwise(t)), "\n")
    joined = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(at, "doc_id", "left")
    whole = joined.select("doc_id", F.when(F.col("at").isNull(), F.col("text")).otherwise(masked).alias("text"))
    return whole.select("doc_id", mask_text(F.col("text")).alias("text"))
