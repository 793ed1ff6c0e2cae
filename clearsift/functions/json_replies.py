"""Replies of hosted models and providers as JSON: validation item by item, error codes, quotas, usage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clearsift.functions.text import strip_code_fence

_REPLY = "struct<klaim_utama:string, ciri:array<string>>"
_ITEM = "struct<id:string, kutipan:array<string>>"


def parse_reply(reply: Column, known_ids: list[str], most_quotes: int = 3) -> Column:
    """struct(claim, features) of a reply, or null if it is no object with a claim and a list of features.

    Items without a known id or a list of quotes are dropped, of an id the first counts, quotes that are no texts
    are dropped, and at most three are kept.
    """
    body = strip_code_fence(reply)
    v = F.try_parse_json(body)
    claim_kind = F.schema_of_variant(F.try_variant_get(v, "$.klaim_utama", "variant"))
    list_kind = F.schema_of_variant(F.try_variant_get(v, "$.ciri", "variant"))
    valid = v.isNotNull() & (claim_kind == "STRING") & list_kind.startswith("ARRAY")
    items = F.coalesce(F.try_variant_get(v, "$.ciri", "array<variant>"), F.array().cast("array<variant>"))

    def item(x: Column) -> Column:
        quotes = F.try_variant_get(x, "$.kutipan", "array<variant>")
        texts = F.transform(F.filter(quotes, lambda q: F.schema_of_variant(q) == "STRING"), lambda q: F.try_variant_get(q, "$", "string"))
        return F.struct(F.try_variant_get(x, "$.id", "string").alias("id"), F.slice(texts, 1, most_quotes).alias("quotes"))

    good = F.filter(F.transform(items, item), lambda s: s["id"].isin(*known_ids) & s["quotes"].isNotNull())
    once = F.aggregate(good, F.array().cast("array<struct<id:string,quotes:array<string>>>"), lambda out, s: F.when(F.exists(out, lambda o: o["id"] == s["id"]), out).otherwise(F.concat(out, F.array(s))))
    return F.when(valid, F.struct(F.try_variant_get(v, "$.klaim_utama", "string").alias("claim"), once.alias("features")))


def reply_problems(reply: Column, known_ids: list[str]) -> Column:
    """What a strict reader finds wrong: no JSON, no object, no claim, no list; and the ids that are not known."""
    v = F.try_parse_json(strip_code_fence(reply))
    kind = F.schema_of_variant(v)
    ids = F.transform(F.coalesce(F.try_variant_get(v, "$.ciri", "array<variant>"), F.array().cast("array<variant>")), lambda x: F.try_variant_get(x, "$.id", "string"))
    foreign = F.filter(ids, lambda i: i.isNotNull() & ~i.isin(*known_ids))
    claim = F.schema_of_variant(F.try_variant_get(v, "$.klaim_utama", "variant"))
    features = F.schema_of_variant(F.try_variant_get(v, "$.ciri", "variant"))
    problems = F.array_compact(F.array(
        F.when(v.isNull(), F.lit("bukan json")),
        F.when(v.isNotNull() & ~kind.startswith("OBJECT"), F.lit("bukan objek")),
        F.when(kind.startswith("OBJECT") & ~F.coalesce(claim == "STRING", F.lit(False)), F.lit("klaim bukan teks")),
        F.when(kind.startswith("OBJECT") & ~F.coalesce(features.startswith("ARRAY"), F.lit(False)), F.lit("ciri bukan daftar")),
    ))
    return F.struct(problems.alias("problems"), F.array_distinct(foreign).alias("foreign_ids"))


def provider_error_code(body: Column, status: Column) -> Column:
    """error.code or error.type if short and plain, else cf_ and the number of a numeric code, else the HTTP status."""
    v = F.try_parse_json(body)
    plain = lambda x: F.when(x.rlike(r"^[A-Za-z][A-Za-z0-9_.\-]{0,39}$"), x)
    number = F.coalesce(F.try_variant_get(v, "$.errors[0].code", "int"), F.try_variant_get(v, "$.error.code", "int"))
    return F.coalesce(
        plain(F.try_variant_get(v, "$.error.code", "string")), plain(F.try_variant_get(v, "$.error.type", "string")), F.when(number.isNotNull(), F.concat(F.lit("cf_"), number.cast("string"))), F.concat(F.lit("http_"), status.cast("string"))
    )


def gateway_error_code(header: Column, body: Column) -> Column:
    return F.coalesce(F.nullif(F.upper(F.trim(header)), F.lit("")), F.nullif(F.upper(F.regexp_extract(F.coalesce(body, F.lit("")), r"(?i)ERR_NGROK_\d+", 0)), F.lit("")))


def quota_of(body: Column) -> Column:
    """struct(limit, used, requested) of a quota message, each null if it isn't named."""
    n = lambda word: F.regexp_extract(F.coalesce(body, F.lit("")), rf"(?i){word}[:\s]+(\d+)", 1).try_cast("long")
    return F.struct(n("Limit").alias("limit"), n("Used").alias("used"), n("Requested").alias("requested"))


def wait_seconds(header: Column, body: Column) -> Column:
    """How long to wait: the header's seconds, else the duration after 'try again in'."""
    from clearsift.functions.dates_numbers import duration_seconds

    named = F.regexp_extract(F.coalesce(body, F.lit("")), r"(?i)try again in ((?:\d+(?:\.\d+)?(?:ms|h|m|s))+|\d+(?:\.\d+)?)", 1)
    return F.coalesce(duration_seconds(header), duration_seconds(F.nullif(named, F.lit(""))))


def token_usage(body: Column) -> Column:
    """struct(prompt, completion, total); anything but whole numbers is null."""
    v = F.try_parse_json(body)
    whole = lambda name: F.when(F.get_json_object(body, f"$.usage.{name}").rlike(r"^\d+$"), F.get_json_object(body, f"$.usage.{name}").cast("long"))
    del v
    return F.struct(whole("prompt_tokens").alias("prompt"), whole("completion_tokens").alias("completion"), whole("total_tokens").alias("total"))


def reply_content(body: Column) -> Column:
    """struct(content, truncated) of the first choice."""
    return F.struct(F.get_json_object(body, "$.choices[0].message.content").alias("content"), (F.get_json_object(body, "$.choices[0].finish_reason") == "length").alias("truncated"))


def decode_enum(value: Column, known: dict[str, str], fallback: str = "tidak_dikenal") -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), value), F.lit(fallback))
