"""Paragraphs, sentences and the claim of a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clearsift.functions.text import core_of, count_of, cut_at_word, letter_ratio, normal_line
from clearsift.operators.lines import line_reason, reason_of, with_reason

#: Abbreviations after which a dot ends no sentence; words that never end a line's sentence.
ABBREVIATIONS = (
    "dr drs prof no hlm dll dsb dst tsb yth bpk sdr jl pt cv rp ir hj mr mrs vs st kec kab kel ka tgl tlp al sd an dkk dsj mis"
).split()
CONNECTIVES = "agar yang dan atau di ke untuk dengan karena bahwa dari pada serta sebagai dalam oleh akan jika kalau tetapi namun sehingga".split()
META_LINE = r"(?i)^(?:(?:senin|selasa|rabu|kamis|jumat|jum'at|sabtu|minggu)\b.*\d{4}|sumber\s*:|\d{1,2}\s+\w+\s+\d{4}\b.*(?:wib|wita|wit)?$)"
SENTENCE_END = r"[.!?]+[\"”’')\]]*$"
ASSERTIONS = (
    r"(?i)\b(?:mengumumkan|menyatakan|mengatakan|menyebut|mengaku|akan|wajib|dilarang|diwajibkan|ditutup|dibuka|mengandung|menyebabkan|dinyatakan|terbukti|resmi|berubah|disita|didenda"
    r"|dikenakan|dirawat|ditangkap|diberlakukan|usul|mengusulkan|tutup|menutup|melarang|mewajibkan|membatalkan|menghapus|menaikkan|menurunkan|gratis|terlibat|terungkap|ditemukan|meninggal"
    r"|menewaskan|dikabarkan|beredar|mengajak|meminta|harus|dapat|bisa|mendapat|menerima|memberikan|menghubungi|melanggar|dinonaktifkan|diblokir|dihapus|masuk|mulai|bakar|membakar|terbakar"
    r"|tertangkap|ketangkap|digelandang|gelandang|diduga|dituduh|diumumkan)\b"
)
SECOND_PERSON = "kamu anda engkau kau kalian dirimu".split()
NOT_SUFFIX_MU = "ilmu temu bertemu ketemu menemu jamu tamu bertamu semu ramu".split()
CHAT = r"(?i)\b(?:saya|aku|gue|gw|gua|kak|kakak|bro|sis|gan|min)\b"
LINK_LIKE = r"(?i)https?://|www\.|\b\w+\.(?:com|id|net|org|co|xyz|top)\b"
_LINK_MARK = r"(?i)://|www\.|\w\.(?:com|id|net|org|co|xyz|top)\b"  # every link has it; it is found without reading words again
LONG_LINE, MOST_CLAIM = 0.8, 200


def addresses_reader(x: Column) -> Column:
    """Whether a text addresses its reader, by a pronoun or the suffix -mu."""
    words = F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit("[a-z]+(?:-[a-z]+)*"), F.lit(0))
    return F.exists(words, lambda t: t.isin(*SECOND_PERSON) | ((F.length(t) > 3) & t.endswith("mu") & ~t.isin(*NOT_SUFFIX_MU)))


def has_link(x: Column) -> Column:
    return x.rlike(_LINK_MARK) & x.rlike(LINK_LIKE)


def _words(x: Column) -> Column:
    return F.filter(F.split(F.trim(x), r"\s+"), lambda w: w != "")


def _title_like(words: Column) -> Column:
    return (F.size(words) > 0) & (F.size(F.filter(words, lambda w: w.rlike(r"^[\p{Lu}\d]"))) / F.size(words) >= 0.6)


def paragraphs(lines: DataFrame) -> DataFrame:
    """(doc_id, paragraph, text): lines (doc_id, pos, text) joined where a sentence goes on.

    Interface lines and blank ones part paragraphs. A line goes on if it does not end a sentence and ends in a
    connective, or is about as long as the page's longest before a line of two words or more, or the next begins
    with a small letter, or both are the short halves of a headline. Decided by windows over neighbours.
    """
    by = Window.partitionBy("doc_id").orderBy("pos")
    own = with_reason(lines.select("doc_id", "pos", "text"))
    rows = own.select("doc_id", "pos", F.when(F.col("reason").isNull(), F.trim("text")).otherwise(F.lit("")).alias("t"))
    t = F.col("t")
    last = F.lower(F.regexp_replace(F.regexp_replace(t, r"(?s)^.*\s", ""), r"(?U)\W+$", ""))
    # What a line says by itself is computed once for it, before lines meet their neighbours.
    rows = rows.withColumns({"n": F.regexp_count(t, F.lit(r"\S+")), "meta": t.rlike(META_LINE), "connects": last.isin(*CONNECTIVES), "small": t.rlike(r"^\p{Ll}")})
    rows = rows.withColumns({"open": (t != "") & ~t.rlike(SENTENCE_END) & ~F.col("meta"), "half": F.col("n").between(2, 5) & ~F.col("meta") & _title_like(_words(t))})
    after = F.lead(F.struct("n", "small", "half")).over(by)
    rows = rows.withColumns({"next": after, "longest": F.max(F.length("t")).over(Window.partitionBy("doc_id"))})
    its = F.coalesce("next.n", F.lit(0))
    headline = F.col("half") & F.coalesce("next.half", F.lit(False)) & (F.col("n") + its <= 10)
    long_line = (F.length(t) >= LONG_LINE * F.col("longest")) & (its >= 2)
    rows = rows.withColumn("goes_on", F.col("open") & (F.col("connects") | long_line | F.coalesce("next.small", F.lit(False)) | headline))
    begins = (t == "") | F.col("meta") | ~F.coalesce(F.lag("goes_on").over(by), F.lit(False))
    rows = rows.withColumn("paragraph", F.sum(begins.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0))).filter("t <> ''")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "t"))), lambda x: x["t"]), " ")
    return rows.groupBy("doc_id", "paragraph").agg(joined.alias("text"))


def split_sentences(x: Column) -> Column:
    """Sentences of a paragraph: cut after . ! ? before white space, and joined again where that ends nothing.

    No end: before a small letter, after a link, an abbreviation or an initial, between digits."""
    pieces = F.split(F.trim(F.coalesce(x, F.lit(""))), r"(?<=[.!?])\s+(?![.!?])")
    start = F.array().cast("array<string>")

    def abbreviated(last: Column) -> Column:
        """Whether a sentence's last token, which ends in a dot, is a link, an abbreviation or an initial."""
        word = F.regexp_extract(last, r"(\S+)[.!?]+$", 1)
        bare = F.lower(F.regexp_replace(F.regexp_replace(word, r"^[(\[\"']+", ""), r"\.+$", ""))
        return bare.isin(*ABBREVIATIONS) | word.rlike(f"/|(?i)www|{LINK_LIKE}") | bare.rlike(r"^(?:[a-z]\.)+[a-z]$|^\p{L}$")

    def add(out: Column, piece: Column) -> Column:
        before = F.element_at(out, -1)
        last = F.array(F.regexp_replace(before, r"(?s)^.*\s", ""))
        no_end = piece.rlike(r"^[ \"“‘'(\[]*\p{Ll}") | (before.endswith(".") & ((piece.rlike(r"^\d") & before.rlike(r"\d\.$")) | F.exists(last, abbreviated)))
        return F.when((F.size(out) > 0) & no_end, F.concat(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), F.array(F.concat_ws(" ", before, piece)))).otherwise(F.concat(out, F.array(piece)))

    return F.aggregate(F.filter(pieces, lambda p: p != ""), start, add)


def _sentence_parts(s: Column) -> dict[str, Column]:
    """What a sentence's score is made of, but for its reason as a line."""
    number_of = lambda pattern: F.regexp_count(s, F.lit(pattern))
    return {"n": number_of(r"\S+"), "capitals": number_of(r"(?<!\S)\p{Lu}"), "asserts": s.rlike(ASSERTIONS), "number": s.rlike(r"\d")}


def _score(s: Column, evidence: Column, reason: Column, n: Column, capitals: Column, asserts: Column, number: Column, keep_chat: bool) -> Column:
    names = F.size(F.filter(F.slice(_words(s), F.lit(2), F.lit(1000)), lambda w: w.rlike(r"^\p{Lu}") & (w != F.upper(w))))
    listed = (n >= 7) & (capitals / n >= 0.7) & ~asserts & ~number
    low = F.lower(s)
    quoted = F.exists(evidence, lambda b: (b != "") & (F.contains(low, F.lower(b)) | F.contains(F.lower(b), low)))
    yes = lambda c, points: F.when(c, F.lit(float(points))).otherwise(F.lit(0.0))
    score = (
        F.when(n.between(8, 35), 2.0).when(n <= 60, 1.0).otherwise(0.0) + yes(s.rlike(r"\.[\"”’') ]*\z"), 1) + yes(s.rlike(r"!\s*$"), -1) + yes(asserts, 1)
        + yes(number | ((capitals >= 2) & (names >= 2)), 1) + yes(listed, -2) + yes(quoted, 1)
    )
    unfit = (n < 5) | s.rlike(r"\?[\"”’') ]*\z") | reason.isNotNull() | (letter_ratio(s) < 0.6) | has_link(s)
    if not keep_chat:
        unfit = unfit | addresses_reader(s) | s.rlike(CHAT)
    return F.when(~unfit, score)


def sentence_score(s: Column, evidence: Column, keep_chat: bool = False) -> Column:
    """How well a sentence states something; null if it can't be a claim."""
    return _score(s, evidence, line_reason(s), **_sentence_parts(s), keep_chat=keep_chat)


def with_sentence_score(rows: DataFrame, evidence: Column, keep_chat: bool = False) -> DataFrame:
    """Adds score to rows (sentence): its parts are columns of their own, computed once."""
    s = F.col("sentence")
    parts = _sentence_parts(s)
    read = rows.withColumns({"_line": normal_line(s)} | {f"_{k}": c for k, c in parts.items()}).withColumn("_core", core_of(F.col("_line")))
    scored = read.withColumn("score", _score(s, evidence, reason_of(F.col("_line"), F.col("_core")), **{k: F.col(f"_{k}") for k in parts}, keep_chat=keep_chat))
    return scored.drop("_line", "_core", *[f"_{k}" for k in parts])


def shorten(s: Column, most: int = MOST_CLAIM) -> Column:
    return F.when(F.length(s) <= most, s).otherwise(F.concat(F.regexp_replace(cut_at_word(s, most), "[ ,;:-]+$", ""), F.lit("…")))


def best_sentences(lines: DataFrame, evidence: DataFrame) -> DataFrame:
    """(doc_id, sentence, score): the best sentence of each text, of equals the earliest. evidence: doc_id, evidence."""
    parts = paragraphs(lines).select("doc_id", "paragraph", F.posexplode(split_sentences(F.col("text"))).alias("k", "sentence"))
    joined = parts.join(evidence, "doc_id", "left").withColumn("evidence", F.coalesce("evidence", F.array().cast("array<string>")))
    scored = with_sentence_score(joined, F.col("evidence"))
    # Sentences without a score have no place in the order; a filter on the score would compute it once more.
    order = F.when(F.col("score").isNotNull(), F.struct("score", (-F.col("paragraph")).alias("p"), (-F.col("k")).alias("k")))
    best = scored.groupBy("doc_id").agg(F.max_by(F.struct("sentence", "score"), order).alias("b")).filter("b IS NOT NULL")
    return best.select("doc_id", shorten(F.col("b.sentence")).alias("sentence"), F.col("b.score").alias("score"))


def claim_from_evidence(x: Column, least_words: int = 4) -> Column:
    """A claim from a slice of the text, without connectives at its end; null if it is short, chatty, a link or interface."""
    tail = rf"(?i)(?:\s+(?:{'|'.join(CONNECTIVES)})[,.;:]*)+$"
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " ")), "[ :;,-]+$", ""), tail, ""), "[ :;,-]+$", "")

    def claim(c: Column) -> Column:
        fit = (F.size(_words(c)) >= least_words) & ~addresses_reader(c) & ~c.rlike(CHAT) & ~has_link(c) & line_reason(c).isNull()
        return F.when(fit, shorten(c))

    return claim(bare)


def new_judgements(claim: Column, text: Column, judgements: list[str]) -> Column:
    """Words of judgement that a claim has and its text has not."""
    return F.filter(F.array(*[F.lit(w) for w in judgements]), lambda w: F.rlike(F.lower(claim), F.concat(F.lit(r"\b"), w, F.lit(r"\b"))) & ~F.contains(F.lower(text), w))


def claim_reject_reason(claim: Column, text: Column, judgements: list[str], least_share: float = 0.5, most: int = 300) -> Column:
    """Why a model's claim is rejected: the first reason in a fixed order, or null."""
    from clearsift.functions.arrays import content_words, share_found

    words = content_words(claim)
    return (
        F.when(F.trim(F.coalesce(claim, F.lit(""))) == "", F.lit("kosong"))
        .when(F.length(claim) > most, F.lit("terlalu_panjang"))
        .when(addresses_reader(claim), F.lit("kata_ganti_kedua"))
        .when(claim.rlike(LINK_LIKE), F.lit("tautan"))
        .when(F.size(new_judgements(claim, text, judgements)) > 0, F.lit("penilaian_baru"))
        .when(share_found(words, text) < least_share, F.lit("tidak_setia"))
    )


def count_sentences(x: Column) -> Column:
    return count_of(x, r"[.!?](?:\s|$)")
