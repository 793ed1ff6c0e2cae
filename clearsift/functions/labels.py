"""Labels of articles: a small domain from many spellings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words by which a raw label is recognised, in the order of the rules.
FALSE_WORDS = "SALAH FALSE HOAX HOAKS FITNAH HASUT DISINFORMASI MISINFORMASI DISINFOMASI DISINFORMAS DISINFORMATION DIMANIPULASI".split()
NOT_CHECKS = "BERITA EDUKASI TOP ACARA ADMIN UPDATE DOKUMENTASI".split()
CLARIFIED, SATIRE = ["KLARIFIKASI", "CLARIFICATION"], "PARODI SATIR SATIRE KOMEDI".split()
VERDICTS = {"salah": "salah", "false": "salah", "klarifikasi": "klarifikasi", "clarification": "klarifikasi", "benar": "klarifikasi", "true": "klarifikasi"}


def normal_label(raw: Column) -> Column:
    """One of seven labels, or bukan_cek_fakta for what is no fact check."""
    text = F.trim(F.regexp_replace(F.upper(F.coalesce(raw, F.lit(""))), r"(?U)\s+", " "))
    words = F.regexp_extract_all(text, F.lit("[A-Z]+"), F.lit(0))
    has = lambda names: F.arrays_overlap(words, F.array(*[F.lit(n) for n in names]))
    return (
        F.when(text == "", "lainnya").when(has(["PENIPUAN", "SCAM"]), "penipuan").when(F.contains(text, F.lit("BELUM TERBUKTI")), "belum_terbukti").when(has(FALSE_WORDS), "salah")
        .when(has(CLARIFIED), "klarifikasi").when(has(SATIRE), "satir").when(has(["BENAR"]) | (text == "FAKTA"), "benar").when(has(NOT_CHECKS) | F.contains(text, F.lit("CEK FAKTA")), "bukan_cek_fakta")
        .otherwise("lainnya")
    )


def label_with_verdict(raw: Column, verdict: Column) -> Column:
    """The normal label; a missing one or ISU is completed by the page's verdict. A known label never changes."""
    label = normal_label(raw)
    open_ = (label == "lainnya") & F.upper(F.trim(F.coalesce(raw, F.lit("")))).isin("", "ISU")
    found = F.element_at(F.create_map(*[F.lit(x) for p in VERDICTS.items() for x in p]), F.lower(F.trim(F.coalesce(verdict, F.lit("")))))
    return F.when(open_, F.coalesce(found, F.lit("lainnya"))).otherwise(label)
