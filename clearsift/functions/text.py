"""Text functions: every one maps columns to a column, in built-in expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words that may stand as a label without brackets, or with one bracket missing.
LABEL_WORDS = "SALAH|HOAX|HOAKS|HASUT|FITNAH|DISINFORMASI|MISINFORMASI|PENIPUAN|BENAR|FAKTA|FALSE"
#: The four ways in which a title begins with a label: bracketed, never closed, before a colon, never opened.
LABEL_PREFIXES = (
    r"^\s*[\[(]\s*([^\])]+?)\s*[\])]\s*:?\s*",
    rf"(?i)^\s*\[\s*((?:{LABEL_WORDS}))\s+(?=\S)",
    rf"(?i)^\s*((?:{LABEL_WORDS}))\s*:\s*",
    rf"(?i)^\s*((?:{LABEL_WORDS}))\s*\]\s*",
)


#: Blocks whose characters most texts consist of: Latin, Greek, Cyrillic, punctuation and currency signs, kana, Han, Hangul.
_BLOCKS = ((0x80, 0x24F), (0x370, 0x52F), (0x2010, 0x2060), (0x20A0, 0x20BF), (0x3041, 0x30FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3))


def _stable_ranges() -> str:
    """Of the blocks, as a list of ranges of a pattern, the characters that normalisation leaves as they are whatever stands
    beside them: their own compatible form, no combining mark, and no second part of a composed character."""
    second = {d[1] for c in range(0x80, 0x11FFF) if (d := unicodedata.decomposition(chr(c)).split()) and len(d) == 2 and not d[0].startswith("<")}
    stable = lambda c: unicodedata.normalize("NFKC", chr(c)) == chr(c) and not unicodedata.combining(chr(c)) and f"{c:04X}" not in second and unicodedata.category(chr(c)) != "Cn"
    ranges: list[list[int]] = []
    for c in (c for low, high in _BLOCKS for c in range(low, high + 1) if stable(c)):
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "".join(f"\\u{a:04X}-\\u{b:04X}" for a, b in ranges)


_UNSTABLE = f"[^\\x00-\\x7F{_stable_ranges()}]"
#: Texts of nothing but these are told by one short class: ASCII, letters with one mark, common punctuation.
_PLAIN = "^[\\x00-\\x7F\\u00BF-\\u0131\\u0134-\\u013E\\u2013-\\u2016\\u2018-\\u201D]*+\\z"


@F.pandas_udf(StringType())
def _normalised(x: pd.Series) -> pd.Series:
    return x.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def compatible(x: Column) -> Column:
    """NFKC: compatible forms as plain characters, letters and combining marks composed, in canonical order. Only texts with a
    character that may change leave the built-in expressions; all others are passed on as they are."""
    return F.coalesce(_normalised(F.when(~x.rlike(_PLAIN) & x.rlike(_UNSTABLE), x)), x)


def text_or_empty(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def squeeze(x: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(text_or_empty(x), r"(?U)\s+", " "))


def normal_line(x: Column) -> Column:
    """Compatible forms as plain characters, squeezed and lower-cased."""
    return F.lower(squeeze(compatible(x)))


def core_of(line: Column) -> Column:
    """A normal line without punctuation at its ends; a closing % or + stays."""
    return F.regexp_replace(line, r"(?U)^[^\w]+|[^\w%+]+$", "")


def line_core(x: Column) -> Column:
    return core_of(normal_line(x))


def line_tokens(core: Column) -> Column:
    """Blank-separated tokens without punctuation at their ends."""
    bare = F.transform(F.split(core, " "), lambda t: F.regexp_replace(t, r"(?U)^[^\w+]+|[^\w+]+$", ""))
    return F.filter(bare, lambda t: t != "")


def flatten_text(x: Column) -> Column:
    """One line; a blank after :// is dropped, where a link was broken."""
    return F.regexp_replace(squeeze(x), r"(://) ", "$1")


def cut_at_word(x: Column, most: int) -> Column:
    """At most `most` characters, never inside a word."""
    head = F.substring(x, 1, most)
    whole = F.substring(x, most + 1, 1).rlike(r"\s")
    return F.when(F.length(x) <= most, x).when(whole, F.rtrim(head)).otherwise(F.regexp_replace(head, r"\s\S*$", ""))


def tidy(x: Column, most: int = 500) -> Column:
    """Squeezed, without quotes and equals signs at the ends, cut at a blank with an ellipsis."""
    bare = F.regexp_replace(squeeze(x), "^[ =\"'“”‘’]+|[ =\"'“”‘’]+$", "")
    short = F.regexp_replace(F.substring(bare, 1, most), r" [^ ]*$", "")
    return F.when(F.length(bare) <= most, bare).otherwise(F.concat(F.regexp_replace(short, "[ ,;:]+$", ""), F.lit("…")))


def cut_with_ellipsis(x: Column, most: int) -> Column:
    return F.when(F.length(x) <= most, x).otherwise(F.concat(cut_at_word(x, most - 1), F.lit("…")))


def whole_sentences(sentences: Column, most: int) -> Column:
    """The first sentences that fit into `most` characters together, joined by blanks; the first one at least."""
    start = F.struct(F.lit("").alias("text"), F.lit(True).alias("open"))

    def add(state: Column, s: Column) -> Column:
        longer = F.when(state["text"] == "", s).otherwise(F.concat_ws(" ", state["text"], s))
        fits = state["open"] & ((state["text"] == "") | (F.length(longer) <= most))
        return F.struct(F.when(fits, longer).otherwise(state["text"]).alias("text"), fits.alias("open"))

    return F.aggregate(sentences, start, add, lambda s: s["text"])


def alnum_count(x: Column) -> Column:
    return F.length(F.regexp_replace(text_or_empty(x), r"(?U)[^\p{IsAlphabetic}\p{IsDigit}]", ""))


def count_of(x: Column, pattern: str) -> Column:
    return F.regexp_count(text_or_empty(x), F.lit(pattern))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 for nothing."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def letter_count(x: Column) -> Column:
    """Letters of a text: what is left when all between them goes, a run at a time."""
    return F.length(F.regexp_replace(text_or_empty(x), r"\P{L}+", ""))


def letter_ratio(x: Column) -> Column:
    """Letters among the characters that aren't white space."""
    return ratio(letter_count(x), F.length(F.regexp_replace(text_or_empty(x), r"(?U)\s+", "")))


def capital_ratio(x: Column) -> Column:
    """Capitals among the letters."""
    return ratio(count_of(x, r"\p{Lu}"), letter_count(x))


def digit_count(x: Column) -> Column:
    return count_of(x, r"\d")


def title_label(title: Column) -> Column:
    """The label that a title begins with, or an empty text."""
    found = [F.nullif(F.trim(F.regexp_extract(text_or_empty(title), p, 1)), F.lit("")) for p in LABEL_PREFIXES]
    return F.coalesce(*found, F.lit(""))


def bare_title(title: Column) -> Column:
    """A title without its label."""
    chain = None
    for p in LABEL_PREFIXES:
        cut = F.trim(F.regexp_replace(text_or_empty(title), p, ""))
        hit = text_or_empty(title).rlike(p)
        chain = F.when(hit, cut) if chain is None else chain.when(hit, cut)
    return chain.otherwise(F.trim(text_or_empty(title)))


def title_key(title: Column) -> Column:
    return F.regexp_replace(F.lower(bare_title(title)), "[^a-z0-9]+", "")


def _without_scheme(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text_or_empty(url))), r"^https?://(www\.)?", "")


def url_key(url: Column) -> Column:
    """Without scheme, www, fragment and closing slashes, in lower case."""
    return F.regexp_replace(F.regexp_replace(_without_scheme(url), "#.*$", ""), "/+$", "")


def address_key(url: Column) -> Column:
    """Like url_key, but with the fragment: what stands behind a # may tell two listed articles apart."""
    return F.regexp_replace(_without_scheme(url), "/+$", "")


def slug_key(url: Column) -> Column:
    """The last part of a path without its number: old and new addresses of one article agree."""
    path = F.regexp_replace(F.lower(F.trim(text_or_empty(url))), r"^https?://[^/]+", "")
    path = F.regexp_replace(F.regexp_replace(path, r"\?.*$", ""), "/+$", "")
    return F.regexp_replace(F.regexp_replace(path, "^.*/", ""), r"^\d+-", "")


def is_dated_permalink(url: Column, host: str) -> Column:
    """Whether an address is host/yyyy/mm/dd/...: the site's old form."""
    return text_or_empty(url).rlike(rf"^https?://(www\.)?{host}/\d{{4}}/\d{{2}}/\d{{2}}/")


def stable_id(key: Column) -> Column:
    return F.substring(F.sha1(key.cast("binary")), 1, 12)


def passage_text(title: Column, narrative: Column) -> Column:
    """What is embedded of an article."""
    head = F.concat(F.lit("passage: "), bare_title(title))
    return F.when(text_or_empty(narrative) != "", F.concat_ws(". ", head, F.rtrim(narrative))).otherwise(head)


def simple_sentences(x: Column) -> Column:
    return F.filter(F.split(F.trim(text_or_empty(x)), r"(?<=[.!?])\s+"), lambda s: s != "")


def anonymous_trigger(x: Column) -> Column:
    """A trigger phrase for a report: digits become #, of links only the host stays, of long phrases the ends."""
    host = F.regexp_replace(F.lower(x), r"https?://(?:www\.)?([^/\s]+)\S*", "$1")
    marked = F.split(F.regexp_replace(host, r"\d", "#"), r"\s+")
    return F.when(F.size(marked) <= 2, F.concat_ws(" ", marked)).otherwise(F.concat(F.element_at(marked, 1), F.lit(" … "), F.element_at(marked, -1)))


def search_link(base: str, title: Column) -> Column:
    return F.concat(F.lit(base), F.url_encode(F.trim(text_or_empty(title))))


def strip_code_fence(x: Column) -> Column:
    return F.regexp_replace(F.trim(text_or_empty(x)), r"^```[A-Za-z]*\s*|\s*```$", "")


def narrative_section(x: Column) -> Column:
    """What stands between a narrative marker and the next section marker; empty without one."""
    begin = r"(?is)^.*?\[?\s*(?:NARASI|NARRATIVE)\s*\]?\s*:?"
    end = r"(?is)(?:(?:\[?\s*(?:PENJELASAN|EXPLANATION|PENELUSURAN|REFERENSI|REFERENCE|KATEGORI|CATEGORY|SUMBER|SOURCE)\s*\]?\s*:)|={3,}|(?:\s=){3,}|Hasil Periksa Fakta).*$"
    body = tidy(F.regexp_replace(F.regexp_replace(text_or_empty(x), begin, ""), end, ""))
    useless = body.rlike(r"(?i)narasi tidak ditampilkan|^\W*$")
    return F.when(text_or_empty(x).rlike(begin) & ~useless, body).otherwise(F.lit(""))


def narrative_before_rebuttal(x: Column) -> Column:
    body = F.regexp_replace(squeeze(x), r"(?i)^Penjelasan\s*:\s*", "")
    return tidy(F.regexp_replace(body, r"(?s)\b(?:Faktanya|Link Counter)\b.*$", ""))


def repair_links(x: Column) -> Column:
    """Joins a line that ends in the beginning of a link with the domain or path that begins the next line."""
    domain = r"[A-Za-z0-9](?:[\w\-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9][\w\-]*)*\.[A-Za-z]{2,}(?:[/?#]\S*)?"
    joined = F.regexp_replace(text_or_empty(x), rf"(?im)(https?://|ftp://|www\.)[ \t]*\n[ \t]*((?:{domain})|/\S+)(?=\s|$)[ \t]*", "$1$2\n")
    return F.regexp_replace(F.regexp_replace(joined, r"((?:https?://|ftp://|www\.)\S+)\n\n", "$1\n"), r"\n$", "")


def clean_page_text(x: Column) -> Column:
    """The account itself of an article's text: without links, what follows a section heading, its own heading, blanks."""
    bare = F.regexp_replace(text_or_empty(x), r"https?://\S+", "")
    head = F.regexp_replace(bare, r"(?ims)^\s*(?:penjelasan|kesimpulan|fakta|hasil cek|referensi|sumber)\b.*", "")
    body = F.regexp_replace(head, r"(?is)\A\s*\[?narasi[^:\n]*\]?\s*[:\n]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(body, r"[ \t]+", " "), r"\n\s*\n+", "\n"), r"\A\s+|\s+\z", ""))


def server_address(x: Column, local_port: int = 8000) -> Column:
    """scheme://host[:port] of a typed address, or null: no path, query or login. Private hosts are reached by http and,
    where no port is named, at `local_port`; others by https."""
    typed = F.regexp_replace(F.trim(text_or_empty(x)), "/+$", "")
    shape = r"^(?:(?i)(https?)://)?([A-Za-z0-9](?:[A-Za-z0-9.\-]*[A-Za-z0-9])?|\[[0-9A-Fa-f:]+\])(?::(\d{1,5}))?$"
    scheme, host, port = F.lower(F.regexp_extract(typed, shape, 1)), F.lower(F.regexp_extract(typed, shape, 2)), F.regexp_extract(typed, shape, 3)
    private = host.rlike(r"^(?:localhost|127\.\d+\.\d+\.\d+|10\.\d+\.\d+\.\d+|192\.168\.\d+\.\d+|172\.(?:1[6-9]|2\d|3[01])\.\d+\.\d+)$")
    named = F.when(scheme != "", scheme).when(private, "http").otherwise("https")
    at = F.when(port != "", F.concat(F.lit(":"), port)).when((named == "http") & private, F.lit(f":{local_port}")).otherwise("")
    cut_short = F.contains(F.trim(text_or_empty(x)), F.lit("://")) & ~F.contains(typed, F.lit("://"))
    return F.when(typed.rlike(shape) & ~cut_short, F.concat(named, F.lit("://"), host, at))


def bytes_for_people(n: Column) -> Column:
    kb, mb, gb = F.lit(1024.0), F.lit(1024.0**2), F.lit(1024.0**3)
    return (
        F.when(n < kb, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < mb, F.concat(F.format_number(n / kb, 1), F.lit(" KB")))
        .when(n < gb, F.concat(F.format_number(n / mb, 1), F.lit(" MB")))
        .otherwise(F.concat(F.format_number(n / gb, 2), F.lit(" GB")))
    )
