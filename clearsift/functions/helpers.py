"""Small column helpers: synonyms, paraphrases, thresholds as text, boxes, forbidden paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for p in table.items() for x in p])


def with_synonyms(x: Column, synonyms: dict[str, str]) -> Column:
    """Words replaced by synonyms, capitals and punctuation kept; `synonyms` is in lower case."""

    def one(token: Column) -> Column:
        word = F.regexp_extract(token, r"\p{L}+", 0)
        new = F.element_at(_map(synonyms), F.lower(word))
        cased = F.when(word.rlike(r"^\p{Lu}"), F.concat(F.upper(F.substring(new, 1, 1)), F.substring(new, 2, 1000))).otherwise(new)
        return F.when(new.isNotNull(), F.concat(F.regexp_extract(token, r"^[^\p{L}]*", 0), cased, F.regexp_replace(token, r"^[^\p{L}]*\p{L}+", ""))).otherwise(token)

    return F.array_join(F.transform(F.split(F.coalesce(x, F.lit("")), " "), one), " ")


def rotated(sentences: Column) -> Column:
    """A paraphrase by order: the first sentence goes last."""
    return F.concat_ws(" ", F.concat(F.slice(sentences, F.lit(2), F.greatest(F.size(sentences) - 1, F.lit(0))), F.slice(sentences, 1, 1)))


def chain_letter(sentences: Column, opening: str, closing: str) -> Column:
    """A paraphrase by style: between the opening and the closing of a chain letter."""
    return F.concat_ws(" ", F.lit(opening), F.concat_ws(" ", sentences), F.lit(closing))


def thresholds_from_text(x: Column, aliases: dict[str, str]) -> Column:
    """'name=value,name=value' as a map of full names to numbers; unknown names and values that are none are dropped."""
    pairs = F.transform(F.split(F.coalesce(x, F.lit("")), ","), lambda p: F.split(F.trim(p), r"\s*=\s*", 2))
    full = F.transform(F.filter(pairs, lambda p: F.size(p) == 2), lambda p: F.struct(F.element_at(_map(aliases), F.get(p, 0)).alias("key"), F.get(p, 1).try_cast("double").alias("value")))
    return F.map_from_entries(F.filter(full, lambda e: e["key"].isNotNull() & e["value"].isNotNull()))


def overlaid(profile: Column, default: Column) -> Column:
    """A profile's value, or the default where it sets none."""
    return F.coalesce(profile, default)


def forbidden_path(path: Column, names: list[str]) -> Column:
    """Whether any part of a path is one of the names."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(n) for n in names]))


def clamp_box(box: Column, width: Column, height: Column, least: float) -> Column:
    """A box (l, t, r, b) moved and shrunk into a view, at least so wide and high."""
    w, h = F.least(F.greatest(box["r"] - box["l"], F.lit(least)), width), F.least(F.greatest(box["b"] - box["t"], F.lit(least)), height)
    left, top = F.greatest(F.lit(0.0), F.least(box["l"], width - w)), F.greatest(F.lit(0.0), F.least(box["t"], height - h))
    return F.struct(left.alias("l"), top.alias("t"), (left + w).alias("r"), (top + h).alias("b"))


def moved_box(box: Column, dx: Column, dy: Column, width: Column, height: Column) -> Column:
    moved = F.struct((box["l"] + dx).alias("l"), (box["t"] + dy).alias("t"), (box["r"] + dx).alias("r"), (box["b"] + dy).alias("b"))
    return clamp_box(moved, width, height, 0.0)


def handle_at(box: Column, x: Column, y: Column, reach: float) -> Column:
    """The handle of a box under a point: the nearest corner in reach, else an edge, else the inside, else null."""
    corners = {"kiri_atas": ("l", "t"), "kanan_atas": ("r", "t"), "kiri_bawah": ("l", "b"), "kanan_bawah": ("r", "b")}
    far = {n: F.sqrt((box[a] - x) ** 2 + (box[b] - y) ** 2) for n, (a, b) in corners.items()}
    nearest = F.array_min(F.array(*[F.struct(d.alias("d"), F.lit(n).alias("n")) for n, d in far.items()]))
    inside_x, inside_y = x.between(box["l"], box["r"]), y.between(box["t"], box["b"])
    return (
        F.when(nearest["d"] <= reach, nearest["n"])
        .when((F.abs(box["l"] - x) <= reach) & inside_y, "kiri").when((F.abs(box["r"] - x) <= reach) & inside_y, "kanan")
        .when((F.abs(box["t"] - y) <= reach) & inside_x, "atas").when((F.abs(box["b"] - y) <= reach) & inside_x, "bawah")
        .when(inside_x & inside_y, "dalam")
    )


def retry_wait(retries: Column, suggested: Column, most: float = 90.0, least: float = 1.0) -> Column:
    """How long to wait after refused calls: the suggestion within bounds; null if none was refused."""
    return F.when(F.exists(retries, lambda s: s == 429), F.least(F.lit(most), F.greatest(F.lit(least), F.coalesce(suggested, F.lit(least)))))


def resized_box(box: Column, handle: Column, x: Column, y: Column, width: Column, height: Column, least: float) -> Column:
    """A box whose named edges (kiri, kanan, atas, bawah, or two of them) are drawn to a point inside the view; it keeps
    a least width and height."""
    in_x, in_y = F.greatest(F.lit(0.0), F.least(x, width)), F.greatest(F.lit(0.0), F.least(y, height))
    moves = lambda name: F.contains(handle, F.lit(name))
    return F.struct(
        F.when(moves("kiri"), F.least(in_x, box["r"] - least)).otherwise(box["l"]).alias("l"),
        F.when(moves("atas"), F.least(in_y, box["b"] - least)).otherwise(box["t"]).alias("t"),
        F.when(moves("kanan"), F.greatest(in_x, box["l"] + least)).otherwise(box["r"]).alias("r"),
        F.when(moves("bawah"), F.greatest(in_y, box["t"] + least)).otherwise(box["b"]).alias("b"),
    )


def drawn_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, least: float) -> Column:
    """The box between two points, whichever way it was drawn, inside the view and of a least size."""
    box = F.struct(F.least(x1, x2).alias("l"), F.least(y1, y2).alias("t"), F.greatest(x1, x2).alias("r"), F.greatest(y1, y2).alias("b"))
    return clamp_box(box, width, height, least)


def threshold_grid(x: Column, aliases: dict[str, str], most: int = 400) -> Column:
    """All combinations of 'name=from:to:step,name=a/b' as maps of full names to numbers; null if there are more than
    `most`. Unknown names are dropped."""
    parts = F.transform(F.split(F.coalesce(x, F.lit("")), ","), lambda p: F.split(F.trim(p), r"\s*=\s*", 2))

    def values(spec: Column) -> Column:
        ends = F.transform(F.split(spec, ":"), lambda v: v.try_cast("double"))
        a, b, c = (F.get(ends, i) for i in range(3))
        steps = F.round((b - a) / c).cast("int")
        spread = F.transform(F.sequence(F.lit(0), steps), lambda i: F.round(a + i * c, 6))
        return F.when(F.contains(spec, F.lit(":")), F.when((c > 0) & (b >= a), spread)).otherwise(F.transform(F.split(spec, "/"), lambda v: v.try_cast("double")))

    named = F.transform(F.filter(parts, lambda p: F.size(p) == 2), lambda p: F.struct(F.element_at(_map(aliases), F.get(p, 0)).alias("name"), values(F.get(p, 1)).alias("values")))
    known = F.filter(named, lambda e: e["name"].isNotNull() & e["values"].isNotNull())
    one = F.array(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>")))
    grow = lambda acc, e: F.flatten(F.transform(acc, lambda m: F.transform(e["values"], lambda v: F.map_concat(m, F.create_map(e["name"], v)))))
    size = F.aggregate(known, F.lit(1).cast("long"), lambda n, e: n * F.size(e["values"]))
    return F.when(size <= most, F.aggregate(known, one, grow))


def settings_from_lines(x: Column) -> Column:
    """Lines KEY=VALUE as a map: comments and other lines are left out, quotes around values go, the first of a key counts."""
    lines = F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), r"\r?\n"), lambda s: F.trim(s)), lambda s: ~s.startswith("#") & F.contains(s, F.lit("=")))
    pairs = F.transform(lines, lambda s: F.struct(F.trim(F.regexp_extract(s, "^([^=]*)=", 1)).alias("key"), F.regexp_replace(F.trim(F.regexp_replace(s, "^[^=]*=", "")), "^[\"']+|[\"']+$", "").alias("value")))
    first = F.aggregate(pairs, F.array().cast("array<struct<key:string,value:string>>"), lambda out, p: F.when(F.exists(out, lambda o: o["key"] == p["key"]), out).otherwise(F.concat(out, F.array(p))))
    return F.map_from_entries(first)


def typed_setting(x: Column, default: float) -> Column:
    """A setting that is a number of 0 or more: the default where it is empty, null where it is none such."""
    text = F.trim(F.coalesce(x, F.lit("")))
    value = text.try_cast("double")
    return F.when(text == "", F.lit(default)).when(value >= 0, value)
