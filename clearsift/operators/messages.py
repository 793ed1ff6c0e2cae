"""What a client shows: names of texts, styles and actions by level, label, assessment and error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of texts, styles and actions.
RED, NEUTRAL = "MERAH", "NETRAL"
LABELS = {
    "salah": ("hasil_label_salah", RED), "penipuan": ("hasil_label_penipuan", RED), "klarifikasi": ("hasil_label_klarifikasi", NEUTRAL),
    "satir": ("hasil_label_satir", NEUTRAL), "belum_terbukti": ("hasil_label_belum_terbukti", NEUTRAL),
}
OTHER_LABEL = ("hasil_label_rujukan", NEUTRAL)
LIMITED = {"cek_fakta": "hasil_terbatas_cek_fakta", "ai": "hasil_terbatas_ai"}
RETRY, SETTINGS, CHOOSE = "COBA_LAGI", "BUKA_PENGATURAN", "PILIH_ULANG"
#: Of each kind of failure: the card's title and body, its action, and whether settings are offered beside it.
CARDS = {
    "url_belum_diatur": ("galat_judul_url", "galat_isi_url", SETTINGS, False), "tidak_terjangkau": ("galat_judul_tidak_terjangkau", "galat_isi_tidak_terjangkau", RETRY, True),
    "waktu_habis": ("galat_judul_waktu_habis", "galat_isi_waktu_habis", RETRY, False), "cleartext": ("galat_judul_cleartext", "galat_isi_cleartext", SETTINGS, False),
    "respons": ("galat_judul_respons", "galat_isi_respons", SETTINGS, False), "tidak_aktif": ("galat_judul_tidak_aktif", "galat_isi_tidak_aktif", RETRY, False),
}
BROKEN_IMAGE, BROKEN_SERVER = ("galat_judul_gambar", "galat_isi_gambar", CHOOSE, False), ("galat_judul_server", "galat_isi_server", RETRY, False)
SERVER_CARDS = {
    "teks_tidak_terbaca": ("galat_judul_teks", "galat_isi_teks", CHOOSE, False), "terlalu_besar": ("galat_judul_besar", "galat_isi_besar", CHOOSE, False),
    "gambar_kosong": BROKEN_IMAGE, "bukan_gambar": BROKEN_IMAGE, "server_sibuk": ("galat_judul_sibuk", "galat_isi_sibuk", RETRY, False),
}
#: Where a build has no settings for the address, these failures have other cards.
FIXED_ADDRESS = {"url_belum_diatur": BROKEN_SERVER, "cleartext": BROKEN_SERVER, "respons": ("galat_judul_respons", "galat_isi_respons_rilis", RETRY, False)}
MESSAGES = {
    "url_belum_diatur": "galat_url_belum_diatur", "tidak_terjangkau": "galat_tidak_terjangkau", "waktu_habis": "galat_waktu_habis", "cleartext": "galat_cleartext",
    "respons": "galat_respons_tidak_dikenali", "tidak_aktif": "galat_server_tidak_aktif",
}
SERVER_MESSAGES = {"teks_tidak_terbaca": "galat_teks_tidak_terbaca", "terlalu_besar": "galat_terlalu_besar", "gambar_kosong": "galat_gambar_rusak", "bukan_gambar": "galat_gambar_rusak", "server_sibuk": "galat_server_sibuk"}
BELIEVES, DOUBTS, SKIPPED = "percaya", "ragu", "dilewati"
FEATURES, SATIRE, ARTICLES, GENERAL = "ciri", "satir", "artikel", "umum"


def _choose(key: Column, table: dict, default: Column) -> Column:
    """The value that a fixed table has for a key, or the default."""
    chain = None
    for k, v in table.items():
        chain = (F if chain is None else chain).when(key == k, v)
    return chain.otherwise(default)


def _card(values: tuple) -> Column:
    return F.struct(*[F.lit(v).alias(n) for v, n in zip(values, ("title", "body", "action", "settings"), strict=True)])


def article_label(label: Column) -> Column:
    """struct(text, style) of an article's label; what is unknown, true or other is shown as a reference only."""
    shown = lambda v: F.struct(F.lit(v[0]).alias("text"), F.lit(v[1]).alias("style"))
    return _choose(F.lower(F.trim(F.coalesce(label, F.lit("")))), {k: shown(v) for k, v in LABELS.items()}, shown(OTHER_LABEL))


def limited_sentences(limited: Column) -> Column:
    """A sentence for each check that did not run, in their order, each once."""
    return F.array_distinct(F.transform(limited, lambda x: _choose(F.lower(F.trim(x)), {k: F.lit(v) for k, v in LIMITED.items()}, F.lit("hasil_terbatas_lain"))))


def limited_meaning(level: Column) -> Column:
    return F.when(level == "tidak_ditemukan", "hasil_terbatas_arti_tidak_ditemukan").otherwise("hasil_terbatas_arti")


def error_card(kind: Column, code: Column, has_settings: bool) -> Column:
    """struct(title, body, action, settings) of a failure: `code` is the server's, where the kind is `server`."""
    server = _choose(code, {k: _card(v) for k, v in SERVER_CARDS.items()}, _card(BROKEN_SERVER))
    cards = CARDS if has_settings else {k: FIXED_ADDRESS.get(k, (*v[:3], False)) for k, v in CARDS.items()}
    return _choose(kind, {k: _card(v) for k, v in cards.items()}, server)


def error_message(kind: Column, code: Column) -> Column:
    """The message of a failure; the server's own text is never shown."""
    server = _choose(code, {k: F.lit(v) for k, v in SERVER_MESSAGES.items()}, F.lit("galat_server"))
    return _choose(kind, {k: F.lit(v) for k, v in MESSAGES.items()}, server)


def caution_cause(n_features: Column, article_labels: Column) -> Column:
    """Why a result asks for caution: features, else satire among its articles, else other articles, else nothing special."""
    labels = F.coalesce(article_labels, F.array().cast("array<string>"))
    return F.when(n_features > 0, FEATURES).when(F.array_contains(labels, "satir"), SATIRE).when(F.size(labels) > 0, ARTICLES).otherwise(GENERAL)


def comparison_message(assessment: Column, level: Column, cause: Column) -> Column:
    """What a reader's assessment before the result compares to; the cause tells believers of a doubtful text apart."""
    not_found = F.when(assessment == BELIEVES, "percaya").when(assessment == DOUBTS, "ragu").otherwise("tidak_percaya")
    return (
        F.when(assessment == SKIPPED, "banding_pesan_dilewati")
        .when(~level.isin("kuat", "hati_hati", "tidak_ditemukan"), "banding_pesan_tidak_dikenal")
        .when(level == "tidak_ditemukan", F.concat(F.lit("banding_pesan_tidak_ditemukan_"), not_found))
        .when(assessment != BELIEVES, "banding_pesan_ada_ciri_waspada")
        .when(level == "kuat", "banding_pesan_kuat_percaya")
        .otherwise(F.concat(F.lit("banding_pesan_hati_hati_percaya_"), cause))
    )
