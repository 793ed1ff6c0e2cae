"""Whether a claim says no more than its text: numbers, names, heavy words, replaced or new words, negation."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clearsift.functions.arrays import content_words
from clearsift.functions.dates_numbers import MONTHS, MULTIPLIERS, number_value

#: Reasons, in the order of the checks.
NEW_NUMBER, NEW_NAME, HEAVY, REPLACED, MANY_NEW, NEGATION = "angka_baru", "entitas_baru", "kata_berat_baru", "kata_pengganti", "kata_baru_banyak", "negasi"
#: Words that negate, words that end a negation's reach, words of judgement, and affixes.
NEGATIONS = "tidak tak bukan belum tanpa jangan enggak nggak gak ga ngga ndak".split()
NEGATION_ENDS = "dengan dan serta tetapi tapi namun atau karena sehingga untuk agar melainkan sedangkan padahal".split()
HEAVY_WORDS = "tipu hoaks hoax palsu bohong dusta fitnah korup korupsi curi maling salah benar fakta keliru sesat terbukti disinformasi scam tersangka tangkap bunuh pidana teror".split()
PREFIXES = {"meng": "k", "meny": "s", "men": "t", "mem": "p", "me": None, "peng": "k", "peny": "s", "pen": "t", "pem": "p", "pe": None, "di": None, "ber": None, "ter": None}
SUFFIXES = ("nya", "kan", "an")
SHORT_MONTHS = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "agu": 8, "ags": 8, "agt": 8, "sep": 9, "okt": 10, "nov": 11, "des": 12, "pebruari": 2, "nopember": 11}
NOT_NAMES = "rp wib wita wit".split()


@F.pandas_udf(T.DoubleType())
def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def similar_ratio(a: Column, b: Column, digits: int = 4) -> Column:
    """Twice the characters in the longest common blocks of two words, in the characters of both."""
    return F.round(_ratios(a, b), digits)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _alike(wanted: pd.Series, words: pd.Series, least: pd.Series) -> pd.Series:
    def one(names, known, bound):
        return [n for n in names if any(abs(len(w) - len(n)) <= 2 and SequenceMatcher(None, n.lower(), w).ratio() >= bound for w in known)]

    return pd.Series([one(*x) for x in zip(wanted, words, least, strict=True)])


def alike(wanted: Column, words: Column, least: float) -> Column:
    """Those of some words that one of others resembles by similar_ratio, at most two letters longer or shorter. Python
    runs in Arrow batches, on the few words that no built-in test has settled."""
    return _alike(wanted, words, F.lit(least))


def stem_candidates(w: Column) -> Column:
    """What a word may be derived from: itself, without a prefix (with the letter it swallowed), without a suffix."""
    without = [F.lit(None).cast("string")]
    for prefix, letter in PREFIXES.items():
        rest = F.substring(w, len(prefix) + 1, 1000)
        has = w.startswith(prefix) & (F.length(rest) >= 3)
        without.append(F.when(has & (F.length(rest) >= 4), rest))
        if letter:
            without.append(F.when(has, F.concat(F.lit(letter), rest)))
    bases = F.concat(F.array(w), F.array_compact(F.array(*without)))
    trimmed = F.flatten(F.transform(bases, lambda b: F.array(*[F.when(b.endswith(s) & (F.length(b) - len(s) >= 4), F.substring(b, F.lit(1), F.length(b) - len(s))) for s in SUFFIXES])))
    return F.array_distinct(F.array_compact(F.concat(bases, trimmed)))


def months_in(x: Column) -> Column:
    """Numbers of the months that a text names, in full, shortened after a day, or in a numeric date."""
    t = F.lower(F.coalesce(x, F.lit("")))
    full = F.array(*[F.when(t.rlike(rf"\b{m}\b"), F.lit(i + 1)) for i, m in enumerate(MONTHS)])
    names = F.create_map(*[F.lit(v) for pair in SHORT_MONTHS.items() for v in pair])
    short = F.transform(F.regexp_extract_all(t, F.lit(r"\b\d{1,2}\s*([a-z]{3,8})\b"), F.lit(1)), lambda m: F.element_at(names, m))
    numeric = F.transform(F.regexp_extract_all(t, F.lit(r"\b\d{1,2}[/.\-](\d{1,2})[/.\-]\d{2,4}\b"), F.lit(1)), lambda m: F.when(m.cast("int").between(1, 12), m.cast("int")))
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(full, short, numeric))))


def number_set(x: Column, loose: bool) -> Column:
    """Values of the numbers in a text; a loose set also holds those before a multiplier without it."""
    found = F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(r"\d[\d.,]*(?:\s*(?:ribu|rb|juta|jt|miliar|milyar|triliun)\b)?"), F.lit(0))
    plain = lambda m: number_value(F.regexp_replace(F.regexp_extract(m, r"^[\d.,]+", 0), "[.,]+$", ""), 6)

    def factor(m: Column) -> Column:
        chain = F.lit(1).cast("decimal(13,0)")
        for word, n in MULTIPLIERS.items():
            chain = F.when(F.regexp_extract(m, "[a-z]+$", 0) == word, F.lit(n).cast("decimal(13,0)")).otherwise(chain)
        return chain

    values = F.transform(found, lambda m: (plain(m) * factor(m)).cast("decimal(38,6)"))
    return F.array_distinct(F.array_compact(F.concat(values, F.transform(found, plain)) if loose else values))


def tolerance(n: Column) -> Column:
    """Edits that a misread word may have, by its length."""
    return F.when(n <= 4, 0).when(n <= 6, 1).otherwise(2)


def claim_names(claim: Column) -> Column:
    """Words of a claim that name someone or something: capitals that don't begin a sentence, acronyms, and a capital at
    the beginning before another capital."""
    shouted = (claim == F.upper(claim)) & claim.rlike("[A-Z]")
    tokens = F.regexp_extract_all(claim, F.lit(r"(?:^|[.!?:\n]\s*)?[A-Za-z][A-Za-z'\-]*"), F.lit(0))
    bare = lambda t: F.regexp_replace(F.regexp_replace(t, r"^[.!?:\n]\s*", ""), r"^['\-]+|['\-]+$", "")

    def is_name(t: Column, i: Column) -> Column:
        b = bare(t)
        starts = (i == 0) | t.rlike(r"^[.!?:\n]")
        capital, acronym = b.rlike("^[A-Z]"), (b == F.upper(b)) & (F.length(b) >= 2)
        next_capital = F.coalesce(bare(F.get(tokens, i + 1)).rlike("^[A-Z]"), F.lit(False))
        return (F.length(b) >= 2) & ~F.lower(b).isin(*NOT_NAMES) & F.when(acronym, ~shouted).otherwise(capital & (~starts | next_capital))

    return F.transform(F.filter(tokens, is_name), bare)


def name_present(name: Column, words: Column) -> Column:
    """Whether a name is among words: equal, run together with others, or misread."""
    t = F.lower(name)
    near = lambda w: (F.abs(F.length(w) - F.length(t)) <= 2) & (F.levenshtein(t, w) <= tolerance(F.length(t)))
    glued = (F.length(t) >= 5) & F.exists(words, lambda w: (F.length(w) >= 5) & F.contains(w, t))
    return F.array_contains(words, t) | ((F.length(t) >= 4) & (glued | F.exists(words, near)))


def _entity_present(name: Column, words: Column, months: Column) -> Column:
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(name)).cast("int")
    parts = F.filter(F.split(F.lower(name), "-"), lambda p: p != "")
    return name_present(name, words) | ((month > 0) & F.array_contains(months, month)) | ((F.size(parts) > 1) & F.forall(parts, lambda p: name_present(p, words)))


def negation_tokens(x: Column) -> Column:
    """Words, and | where a clause ends."""
    found = F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(r"[a-z0-9]+|[.,;:!?](?=\s|$)"), F.lit(0))
    return F.transform(found, lambda t: F.when(t.rlike("^[a-z0-9]"), t).otherwise(F.lit("|")))


def negated(tokens: Column, j: Column) -> Column:
    """Whether the token at j is within three tokens after a negation, with no end of its reach between."""
    window = F.slice(tokens, F.greatest(j - 2, F.lit(1)), F.least(j, F.lit(3)))
    fold = lambda state, t: F.when(t.isin(*NEGATIONS), F.lit(True)).when((t == "|") | t.isin(*NEGATION_ENDS), F.lit(False)).otherwise(state)
    return F.aggregate(window, F.lit(False), fold)


def check_faithfulness(pairs: DataFrame, same_name: float = 0.8, replaced_by: float = 0.7, most_new: float = 0.34) -> DataFrame:
    """Adds reason and n_bad to pairs (id, claim, text): the first check that fails, null for a faithful claim.

    Claims and texts are short; each step is a column, so that lambdas only read them. A name is in the text, too, if a
    word resembles it by `same_name`; a new word is a replaced one if a word of the text resembles it by `replaced_by`.
    """
    w = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))
    a = pairs.withColumns({"_w": F.array_distinct(w), "_months": months_in(F.col("text")), "_names": claim_names(F.col("claim")), "_nt": number_set(F.col("text"), True), "_nc": number_set(F.col("claim"), False)})
    a = a.withColumns({
        "_forms": F.array_distinct(F.flatten(F.transform("_w", stem_candidates))),
        "_low": F.transform("_names", lambda n: F.lower(n)),
        "_ct": negation_tokens(F.col("claim")),
        "_tt": negation_tokens(F.col("text")),
    })
    a = a.withColumns({
        "_bad_numbers": F.size(F.array_except("_nc", "_nt")),
        "_absent": F.filter("_names", lambda n: ~_entity_present(n, F.col("_w"), F.col("_months"))),
        "_words": F.array_except(F.filter(content_words(F.col("claim")), lambda k: ~k.rlike("[0-9]")), "_low"),
    })
    a = a.withColumn("_alike", alike(F.filter("_absent", lambda n: F.length(n) >= 4), F.col("_w"), same_name))
    a = a.withColumn("_bad_names", F.size(F.array_except("_absent", "_alike")))
    heavy = lambda k: F.arrays_overlap(stem_candidates(k), F.array(*[F.lit(h) for h in HEAVY_WORDS]))
    related = lambda k: F.arrays_overlap(stem_candidates(k), F.col("_forms")) | F.exists("_w", lambda x: (F.length(k) >= 5) & (F.length(x) >= 5) & F.contains(x, k))
    misread = lambda k: F.exists("_forms", lambda x: (F.least(F.length(k), F.length(x)) >= 5) & (F.abs(F.length(k) - F.length(x)) <= 2) & (F.levenshtein(k, x) <= tolerance(F.greatest(F.length(k), F.length(x)))))
    a = a.withColumn("_new", F.filter("_words", lambda k: ~related(k) & (heavy(k) | ~misread(k))))
    a = a.withColumn("_near", alike(F.filter("_new", lambda k: ~heavy(k)), F.filter("_w", lambda x: F.length(x) >= 4), replaced_by))
    a = a.withColumns({"_heavy": F.size(F.filter("_new", heavy)), "_replaced": F.size("_near")})
    a = a.withColumn("_plain", F.size("_new") - F.col("_heavy") - F.col("_replaced"))
    # A token, whether it is negated, and what it may be derived from: stems are made once for a token, not for each pair.
    with_stems = lambda found: F.transform(F.array_distinct(found), lambda x: F.struct(x["t"].alias("t"), x["n"].alias("n"), stem_candidates(x["t"]).alias("stems")))
    said = F.filter(F.transform("_ct", lambda t, i: F.struct(t.alias("t"), negated(F.col("_ct"), i).alias("n"))), lambda x: F.array_contains("_words", x["t"]))
    heard = F.transform("_tt", lambda t, i: F.struct(t.alias("t"), negated(F.col("_tt"), i).alias("n")))
    a = a.withColumns({"_said": said, "_heard": heard})
    a = a.withColumns({"_said": with_stems(F.col("_said")), "_heard": with_stems(F.col("_heard"))})
    same = lambda x, y: F.arrays_overlap(x["stems"], y["stems"])
    turned = F.filter("_said", lambda x: F.exists("_heard", lambda y: same(x, y)) & ~F.exists("_heard", lambda y: (x["n"] == y["n"]) & same(x, y)))
    count = lambda tokens: F.size(F.filter(tokens, lambda t: t.isin(*NEGATIONS)))
    negation = F.when((count("_ct") > 0) & (count("_tt") == 0), count("_ct")).otherwise(F.size(F.array_distinct(F.transform(turned, lambda x: x["t"]))))
    a = a.withColumn("_negation", negation)
    n = F.size("_words")
    steps = [(F.col("_bad_numbers"), NEW_NUMBER), (F.col("_bad_names"), NEW_NAME), (F.col("_heavy"), HEAVY), (F.col("_replaced"), REPLACED)]
    reason = F.when(steps[0][0] > 0, F.struct(F.lit(NEW_NUMBER).alias("r"), steps[0][0].alias("n")))
    for bad, name in steps[1:]:
        reason = reason.when(bad > 0, F.struct(F.lit(name).alias("r"), bad.alias("n")))
    reason = reason.when((n > 0) & (F.col("_plain") / F.greatest(n, F.lit(1)) > most_new), F.struct(F.lit(MANY_NEW).alias("r"), F.col("_plain").alias("n")))
    reason = reason.when(F.col("_negation") > 0, F.struct(F.lit(NEGATION).alias("r"), F.col("_negation").alias("n")))
    return a.withColumn("_v", reason).select(*pairs.columns, F.col("_v.r").alias("reason"), F.col("_v.n").alias("n_bad"))
