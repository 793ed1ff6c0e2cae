"""PII surrogates: detected entities get keyed replacements of the same type, format, gender and script."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable

#: First names by gender, with which a following capitalised word is a surname.
FEMALE = (
    "Anna Maria Laura Julia Sarah Emma Sophie Claire Marie Camille Elena Lucia Carmen Isabel Petra Sabine Ursula Emily Alice Grace "
    "Mary Jane Susan Linda Karen Анна Мария Елена Ольга Наталья"
).split()
MALE = (
    "John James Peter Paul Michael David Thomas Robert William George Hans Klaus Stefan Jürgen Pierre Jean Luc Antoine Carlos Juan "
    "Miguel Pedro Luis Иван Пётр Алексей Дмитрий Сергей"
).split()
TITLES = "Mr Mrs Ms Dr Prof Herr Frau Mme Mlle Sr Sra Señor Señora".split()


def _any_of(names: list[str]) -> str:
    """A pattern for a list of words that branches by their first letters and fails at once on any other."""
    by: dict[str, list[str]] = {}
    for n in names:
        by.setdefault(n[0], []).append(n[1:])
    return f"(?=[{''.join(by)}])(?:{'|'.join(f'{c}(?:{"|".join(rest)})' for c, rest in by.items())})"


_FIRST, _TITLE = _any_of([*FEMALE, *MALE]), _any_of(TITLES)
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_NAME = r"\p{Lu}\p{Ll}+"
_SECRET_WORD = "(?i:password|passwd|pwd|token|secret|api_key|apikey)"
#: What is looked for, in this order where two begin at one place. Cheap looks at the next or last characters come
#: before dear ones, as every word of every text is tried.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+\-]++@(?:[A-Za-z0-9\-]+\.)+[A-Za-z]{2,}",
    "key": r"(?=[Ags])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9]{20,})\b",
    "secret": rf"(?<=[=:]\s{{0,3}}[\"']?)(?<=\b{_SECRET_WORD}\s{{0,3}}[=:]\s{{0,3}}[\"']?)[^\s\"']{{6,}}",
    "ip": rf"(?=\d)(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)",
    "iban": r"(?=[A-Z]{2}\d)[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}| [A-Z0-9]{4}(?: (?=[A-Z]*\d)[A-Z0-9]{4}){1,6}(?: (?=[A-Z]*\d)[A-Z0-9]{1,3})?)\b",
    "phone": r"(?=[+(\d])(?:\+\d{1,3}[ .\-]?\(?\d{2,4}\)?(?:[ .\-]?\d{2,4}){2,4}\b|\(\d{3}\) ?\d{3}-\d{4}\b|(?<![\d\-])\d{3}[\-.]\d{3}[\-.]\d{4}\b)",
    "national": r"(?=\d)(?<![\d\-])\d{3}-\d{2}-\d{4}\b",
    "card": r"(?=\d)(?:\d{13,19}|\d{4}(?:[ \-]\d{4}){3})(?!\d)",
    "name": rf"(?=\p{{Lu}}\p{{Ll}})(?<!\p{{L}})(?:{_FIRST}\b(?= {_NAME})|(?<= )(?:(?<=\b{_FIRST} )|(?<=\b{_TITLE}\.? )|(?<=\b{_TITLE}\.? \p{{Lu}}\p{{Ll}}{{1,20}} )){_NAME})",
}
#: An entity begins where no letter or digit of a word goes on.
EVERY = f"(?<![A-Za-z0-9])(?:{'|'.join(f'(?:{p})' for p in PATTERNS.values())})"
#: A text without any of these holds no entity: a digit or @, a secret's name with a value, a known name or title.
_MAYBE = ("[0-9@]", rf"[=:](?<={_SECRET_WORD}\s{{0,3}}[=:])", rf"{_FIRST}(?!\p{{L}})|{_TITLE}\b")

_KINDS = [  # what a found piece is, by itself: the first that it matches
    ("email", r"^[^\s@]+@[^\s@]+$"),
    ("key", r"^(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9]{20,})$"),
    ("ip", rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"),
    ("national", r"^\d{3}-\d{2}-\d{4}$"),
    ("card", r"^(?:\d{13,19}|\d{4}(?:[ \-]\d{4}){3})$"),
    ("phone", r"^[+(]?[\d ().\-]{9,24}$"),
    ("iban", r"^[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{1,4}){3,8})$"),
    ("female", rf"^(?:{'|'.join(FEMALE)})$"),
    ("male", rf"^(?:{'|'.join(MALE)})$"),
    ("surname", rf"^{_NAME}$"),
]
#: What made-up names are put together from, by script.
_SYLLABLES = {"latin": "ba be bo da de do fa fe ga go ha ja ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se so ta te to va ve wa za ze zo".split(),
              "cyrillic": "ба бе бо ва ве во га го да де до за зе ка ко ла ле ло ма ме мо на не но па пе ра ре ро са се со та те то фа хо ша".split()}
_ENDINGS = {("female", "latin"): ["la", "na", "ria", "lia"], ("male", "latin"): ["n", "r", "rd", "us"], ("surname", "latin"): ["ner", "ler", "mond", "berg"],
            ("female", "cyrillic"): ["на", "ла", "рия", "лия"], ("male", "cyrillic"): ["н", "р", "слав", "мир"], ("surname", "cyrillic"): ["нов", "ров", "лин", "ский"]}


#: From this attempt on, a surrogate may leave its value's length.
_EXACT = 5
_NAMES = ("female", "male", "surname")
#: Surnames that are months, too; their bare mentions stay.
MONTHS = "March April May June July August März Mai Juni Juli Mars Avril Juin Marzo Abril Mayo".split()


def canonical(kind: Column, value: Column) -> Column:
    """What two ways to write one entity have in common: addresses in lower case, numbers of cards and accounts without gaps."""
    return F.when(kind == "email", F.lower(value)).when(kind == "card", F.regexp_replace(value, r"\D", "")).when(kind == "iban", F.replace(value, F.lit(" "), F.lit(""))).otherwise(value)


def written_like(kind: Column, value: Column, surrogate: Column) -> Column:
    """A canonical surrogate with the gaps and capitals of the value that it stands for."""
    gap = F.regexp_extract(value, r"^.{4}([ \-])", 1)
    gaps = F.regexp_replace(surrogate, F.lit("(.{4})(?=.)"), F.concat(F.lit("$1"), gap))
    capital = F.array_join(F.transform(F.split(surrogate, ""), lambda c, i: F.when(F.substring(value, i + 1, F.lit(1)).rlike(r"\p{Lu}"), F.upper(c)).otherwise(c)), "")
    return F.when(kind.isin("card", "iban") & (gap != ""), gaps).when((kind == "email") & (value != F.lower(value)), capital).otherwise(surrogate)


def _mod_97(account: Column) -> Column:
    """The remainder of an account number by 97, its country and check digits put last, letters read as 10 to 35."""
    turned = F.concat(F.substring(account, 5, 60), F.substring(account, 1, 4))
    code = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda r, c: F.when(c == "", r).otherwise((r * F.when(c.rlike("[0-9]"), 10).otherwise(100) + code(c)) % 97))


def kind_of(value: Column) -> Column:
    chain = F.when(F.lit(False), F.lit(""))
    for name, pattern in _KINDS:
        chain = chain.when(value.rlike(pattern), F.lit(name))
    return chain.otherwise(F.lit("secret"))


def _draw(digest: Column, place: Column, n: int) -> Column:
    """A number under n from two bytes of a hexadecimal digest of 128 digits; each 32 places have a digest of their own."""
    block = F.floor(place / 32)
    own = F.when(block == 0, digest).otherwise(F.sha2(F.concat_ws("|", digest, block.cast("string")).cast("binary"), 512))
    return F.conv(F.substring(own, (place * 4) % 128 + 1, F.lit(4)), 16, 10).cast("int") % n


def _pick(options: list[str], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in options]), number + 1)


def _in_kind(value: Column, digest: Column, keep: Column) -> Column:
    """Each digit, lower-case and upper-case letter after the first `keep` characters becomes another of its kind.

    Hexadecimal texts stay hexadecimal."""
    is_hex = value.rlike(r"^[0-9a-f]+$")

    def one(c: Column, i: Column) -> Column:
        letter = F.when(is_hex, F.substring(F.lit("abcdef"), _draw(digest, i, 6) + 1, F.lit(1))).otherwise(F.chr(_draw(digest, i, 26) + 97))
        return (
            F.when(i < keep, c)
            .when(c.rlike("[0-9]"), _draw(digest, i, 10).cast("string"))
            .when(c.rlike("[a-z]"), letter)
            .when(c.rlike("[A-Z]"), F.chr(_draw(digest, i, 26) + 65))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _in_secret(value: Column, digest: Column) -> Column:
    """As _in_kind, for letters and digits of all scripts; a value without any gets other symbols."""
    bare = ~value.rlike(r"[\p{L}\p{N}]")
    alphabet = {s: "".join(sorted(set("".join(x)))) for s, x in _SYLLABLES.items()}["cyrillic"]

    def one(c: Column, i: Column) -> Column:
        cyrillic = _pick(list(alphabet), _draw(digest, i, len(alphabet)))
        latin = F.chr(_draw(digest, i, 26) + 97)
        letter = F.when(c.rlike(r"\p{IsCyrillic}"), cyrillic).otherwise(latin)
        return (
            F.when(c.rlike("[A-Za-z0-9]"), c)
            .when(c.rlike(r"\p{N}"), _draw(digest, i, 10).cast("string"))
            .when(c.rlike(r"\p{Lu}"), F.upper(letter))
            .when(c.rlike(r"\p{L}"), letter)
            .when(bare, _pick(list("!#%&*+?_~^"), _draw(digest, i, 10)))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(_in_kind(value, digest, F.lit(0)), ""), one), "")


def _luhn_sum(digits: Column, doubled: int) -> Column:
    """Luhn's sum of an array of digits counted from the right; those at places of parity `doubled` count twice."""
    twice = lambda d: F.when(d >= 5, d * 2 - 9).otherwise(d * 2)
    terms = F.transform(F.reverse(digits), lambda d, i: F.when(i % 2 == doubled, twice(d)).otherwise(d))
    return F.aggregate(terms, F.lit(0), lambda a, b: a + b)


def _digits(value: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(value, r"\D", ""), ""), lambda c: c.cast("int"))


def with_surrogates(entities: DataFrame, secret: str) -> DataFrame:
    """Adds the surrogate of each (kind, value) for its `attempt`; the same key, entity and attempt give the same.

    `domain` is the surrogate of an e-mail address's domain, itself an entity of the kind "domain", and else null.
    From attempt _EXACT on, surrogates are longer by one more piece with each attempt (a digit, letter or syllable), and
    the octets of an address are of any length, so that no format is ever used up. Keys, card numbers and IBANs have at
    least 10**11 surrogates and stay as they are.
    """
    value = F.col("value")
    material = lambda *x: F.sha2(F.concat_ws("|", F.lit(secret), *x).cast("binary"), 512)
    local = F.substring_index(value, "@", 1)
    base = entities.withColumn("digest", material(F.col("kind"), value, F.col("attempt").cast("string")))
    base = base.withColumn("drawn", F.when(F.col("kind").isin("card", "iban"), _in_kind(value, F.col("digest"), F.when(F.col("kind") == "card", 1).otherwise(2))))
    blank = F.concat(F.substring("drawn", 1, 2), F.lit("00"), F.substring("drawn", 5, 60))
    checked = F.concat(F.substring("drawn", 1, 2), F.lpad((98 - _mod_97(blank)).cast("string"), 2, "0"), F.substring("drawn", 5, 60))
    digest = F.col("digest")
    top = F.substring_index(value, ".", -1)
    host = F.expr("substring(value, 1, length(value) - length(substring_index(value, '.', -1)) - 1)")
    more = F.greatest(F.col("attempt") - (_EXACT - 1), F.lit(0))
    grown = lambda c: F.array_join(F.transform(F.slice(F.sequence(F.lit(0), more), F.lit(1), more), lambda i: c(i + 5)), "")
    digits, letters = grown(lambda i: _draw(digest, i, 10).cast("string")), grown(lambda i: F.chr(_draw(digest, i, 26) + 97))
    octet = lambda o, i: F.when(more > 0, 1 + _draw(digest, i, 255)).when(F.length(o) == 1, 1 + _draw(digest, i, 9)).when(F.length(o) == 2, 10 + _draw(digest, i, 90)).otherwise(100 + _draw(digest, i, 155)).cast("string")
    code = F.length(F.regexp_extract(value, r"^\+\d{1,3}(?=[ .\-(])|^\+", 0))
    last = (10 - _luhn_sum(_digits(F.expr("substring(drawn, 1, length(drawn) - 1)")), 0) % 10) % 10
    chain = (
        F.when(F.col("kind") == "email", F.concat(_in_kind(local, digest, F.lit(0)), letters, F.lit("@"), F.col("domain")))
        .when(F.col("kind") == "domain", F.concat(_in_kind(host, digest, F.lit(0)), letters, F.lit("."), top))
        .when(F.col("kind") == "key", _in_kind(value, digest, F.length(F.regexp_extract(value, r"^(?:AKIA|gh[pousr]_|sk-)", 0))))
        .when(F.col("kind") == "ip", F.array_join(F.transform(F.split(value, r"\."), octet), "."))
        .when(F.col("kind") == "phone", F.concat(_in_kind(value, digest, code), digits))
        .when(F.col("kind") == "national", F.concat(_in_kind(value, digest, F.lit(0)), digits))
        .when(F.col("kind") == "secret", F.concat(_in_secret(value, digest), letters))
        .when(F.col("kind") == "iban", F.when(_mod_97(value) == 1, checked).otherwise(F.col("drawn")))
        .when(
            F.col("kind") == "card",
            F.when(_luhn_sum(_digits(value), 1) % 10 == 0, F.concat(F.expr("substring(drawn, 1, length(drawn) - 1)"), last.cast("string"))).otherwise(F.col("drawn")),
        )
    )
    script = F.when(value.rlike(r"\p{IsCyrillic}"), F.lit("cyrillic")).otherwise(F.lit("latin"))
    for (kind, s), endings in _ENDINGS.items():
        syllables = [_pick(_SYLLABLES[s], _draw(digest, F.lit(i), len(_SYLLABLES[s]))) for i in range(3)]
        chain = chain.when((F.col("kind") == kind) & (script == s), F.initcap(F.concat(*syllables, grown(lambda i, s=s: _pick(_SYLLABLES[s], _draw(digest, i, len(_SYLLABLES[s])))), _pick(endings, _draw(digest, F.lit(3), len(endings))))))
    return base.withColumn("surrogate", chain.otherwise(_in_kind(value, digest, F.lit(0)))).drop("digest", "drawn")


def settle(entities: DataFrame, secret: str) -> DataFrame:
    """(kind, value, surrogate) of entities (kind, value, domain): no two share one, none is a value that occurs.

    Who collides draws again with the next attempt (of equal surrogates the least value keeps its own), until no
    collision is left; each round is written. As formats grow with the attempts, that happens.
    """
    keys = ["kind", "value", "domain", "attempt", "surrogate"]
    real = durable(entities.select("value").distinct().withColumnRenamed("value", "surrogate"), "pii-real")
    table = durable(with_surrogates(entities.distinct().withColumn("attempt", F.lit(0)), secret).select(*keys), "pii-surrogates")
    while True:
        owner = table.groupBy("surrogate").agg(F.min(F.struct("kind", "value")).alias("owner"))
        checked = table.join(owner, "surrogate").join(real.withColumn("taken", F.lit(True)), "surrogate", "left")
        bad = F.coalesce("taken", F.lit(False)) | (F.col("owner") != F.struct("kind", "value"))
        checked = durable(checked.select(*keys, bad.alias("bad")), "pii-checked")
        if not checked.filter("bad").limit(1).count():
            return checked.select("kind", "value", "surrogate")
        again = with_surrogates(checked.filter("bad").select("kind", "value", "domain", (F.col("attempt") + 1).alias("attempt")), secret)
        table = durable(checked.filter("NOT bad").select(*keys).unionByName(again.select(*keys)), "pii-surrogates")


def assign_surrogates(entities: DataFrame, secret: str) -> DataFrame:
    """One surrogate for each distinct (kind, value). The domains of e-mail addresses are settled first, as entities of
    their own: addresses that share one keep sharing one, and different domains stay different."""
    domain = F.when(F.col("kind") == "email", F.lower(F.substring_index("value", "@", -1)))
    found = durable(entities.select("kind", "value", domain.alias("of")).distinct(), "pii-entities")
    none = F.lit(None).cast("string").alias("domain")
    domains = settle(found.filter("of IS NOT NULL").select(F.lit("domain").alias("kind"), F.col("of").alias("value"), none), secret)
    domains = durable(domains.select(F.col("value").alias("of"), F.col("surrogate").alias("domain")), "pii-domains")
    return settle(found.join(domains, "of", "left").select("kind", "value", "domain"), secret)


def replace_pii(docs: DataFrame, secret: str = "clearsift-demo-key") -> DataFrame:
    """Replaces personal data and credentials in every whole text: doc_id, text, n_replaced.

    Found are e-mail addresses, access keys, values assigned to passwords and tokens, IPv4 addresses, IBANs, phone
    and national numbers, card numbers, and names after a title or a known first name. One entity has one surrogate
    in all documents (coreference), different entities different ones (distinctness), drawn with a keyed digest:
    separators, lengths, capitals, country codes, issuer digits, valid check digits, an e-mail's shared domain, a name's
    gender and script stay as they are. An address in other capitals, and a number of a card or account with other gaps,
    is the same entity. Names are replaced word by word, so that a surname alone still refers to
    the same person; a name that is found once in a document is replaced at its bare mentions there, too, unless the document has it as a
    word in lower case or it is a month. Where a format
    has too few surrogates, they grow longer. Only rows that hold an entity are shuffled.

    Names are only found after the listed titles and first names; others stay. A very long text is one row as any other.
    A null text stays null with n_replaced 0; null ids are passed on; repeated rows are treated alike; an empty
    table gives an empty result; further columns are ignored. Use a secret of your own.
    """
    maybe = F.col("text").rlike(_MAYBE[0]) | F.col("text").rlike(_MAYBE[1]) | F.col("text").rlike(_MAYBE[2])
    found = F.when(maybe, F.regexp_extract_all("text", F.lit(EVERY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    # Written with what was found, so that the patterns, by far the dearest step, run over each text once.
    seen = durable(docs.select("doc_id", "text", found.alias("found")).withColumn("row", F.monotonically_increasing_id()), "pii-seen")
    has = F.coalesce(F.size("found") > 0, F.lit(False))
    hits = seen.filter(has)
    pieces = hits.select("row", F.posexplode("found").alias("place", "value")).withColumn("kind", kind_of(F.col("value")))
    pieces = pieces.withColumnRenamed("value", "written").withColumn("value", canonical(F.col("kind"), F.col("written")))
    table = durable(assign_surrogates(pieces.select("kind", "value").distinct(), secret), "pii-table")
    put = F.struct("place", written_like(F.col("kind"), F.col("written"), F.col("surrogate")).alias("surrogate"), "kind", "value")
    named = pieces.join(table, ["kind", "value"]).groupBy("row").agg(F.sort_array(F.collect_list(put)).alias("new"))
    # A word that the text has in lower case, or a month, is no name where it stands alone.
    plain = lambda x: F.rlike("text", F.concat(F.lit(r"(?<![\p{L}\p{N}])"), F.lower(x.value), F.lit(r"(?![\p{L}\p{N}])")))
    sure = lambda x: x.kind.isin(*_NAMES) & ~x.value.isin(MONTHS) & ~plain(x)
    people = F.array_distinct(F.transform(F.filter("new", sure), lambda x: F.struct(x.value.alias("value"), x.surrogate.alias("surrogate"))))
    rebuilt = hits.join(named, "row").select("doc_id", F.split("text", EVERY, -1).alias("between"), F.col("new.surrogate").alias("new"), people.alias("people"))
    alone = lambda x: F.concat(F.lit(r"(?<![\p{L}\p{N}])"), x.value, F.lit(r"(?![\p{L}\p{N}])"))
    # No surrogate is a name that occurs, so that one name after the other can be replaced.
    others = F.transform("between", lambda t: F.aggregate("people", t, lambda t, x: F.regexp_replace(t, alone(x), x.surrogate)))
    n_alone = F.aggregate("between", F.lit(0), lambda n, t: n + F.aggregate("people", F.lit(0), lambda m, x: m + F.regexp_count(t, alone(x))))
    whole = F.array_join(F.zip_with(others, "new", lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    changed = rebuilt.select("doc_id", whole.alias("text"), (F.size("new") + n_alone).cast("long").alias("n_replaced"))
    return seen.filter(~has).select("doc_id", "text", F.lit(0).cast("long").alias("n_replaced")).unionByName(changed)
