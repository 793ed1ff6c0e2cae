"""SQL for DuckDB that gives the same rows as the queries of this subpackage, where SQL can."""

from __future__ import annotations

from .license_scan import BASE, LICENSES, compile_template
from .quality_rules import FENCES, REPEATS_FREE

_W = "regexp_extract_all({0}, '[^\\x20\\x09-\\x0D]+')"
_WORDS = _W.format("coalesce(text, '')")

# Sources in code-point order weigh 3, 1, 2; the level of the budgets is where the capped sum meets the target.
MIXING = f"""
WITH d AS (SELECT doc_id, source, len({_WORDS}) AS size, len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS symbols,
    (('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u FROM documents),
e AS (SELECT doc_id, source, size, greatest(0.05, 1.0 - symbols / greatest(size, 1)) AS quality, u FROM d),
k AS (SELECT *, -ln(u) / quality AS key FROM e),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight, 2.0 * source_size AS cap FROM s),
t AS (SELECT *, 1.5 * sum(source_size) OVER () AS budget, coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS remaining FROM w),
f AS (SELECT *, cap <= weight * (budget - before) / remaining AS filled FROM t),
g AS (SELECT source, source_size, CASE WHEN filled THEN cap ELSE weight * (budget - coalesce(sum(cap) FILTER (WHERE filled) OVER (), 0)) / sum(weight) FILTER (WHERE NOT filled) OVER () END AS target FROM f),
p AS (SELECT k.*, source_size, target, coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source),
q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM p),
r AS (SELECT *, epochs + CASE WHEN epochs < 2 AND 2 * start + size <= 2 * (target - epochs * source_size) THEN 1 ELSE 0 END AS copies FROM q)
SELECT doc_id, size, source_size, target, copies * size AS taken, source, quality, copies FROM r
"""

_BUCKET = "CASE WHEN v < 128 THEN v ELSE (v >> (length(bin(v)) - 7)) + 64 * (length(bin(v)) - 7) END"
_FLOOR = "CASE WHEN {0} < 128 THEN {0} ELSE ({0} - 64 * ({0} // 64 - 1)) << ({0} // 64 - 1) END"


def _bounds() -> str:
    parts = []
    for f in FENCES:
        spread = f"greatest(q3 - q1, {f.least})"
        parts.append(f"max(CASE WHEN metric = '{f.metric}' THEN q3 + {f.reach} * {spread} END) AS hi_{f.metric}")
        if f.two_sided:
            parts.append(f"max(CASE WHEN metric = '{f.metric}' THEN q1 - {f.reach} * {spread} END) AS lo_{f.metric}")
    return ", ".join(parts)


_INSIDE = " AND ".join(f"coalesce({f.metric} <= hi_{f.metric}, true)" + (f" AND coalesce({f.metric} >= lo_{f.metric}, true)" if f.two_sided else "") for f in FENCES)
_LONG = " UNION ALL ".join(f"SELECT lang, source, '{f.metric}' AS metric, {f.metric} AS v FROM m WHERE NOT base_failed AND {f.metric} IS NOT NULL" for f in FENCES)


def _quartiles(name: str, by: str) -> str:
    keys = f"{by}, " if by else ""
    return f"""{name}0 AS (SELECT {keys}metric, b, sum(n) AS n FROM sk GROUP BY {keys}metric, b),
{name}1 AS (SELECT *, sum(n) OVER (PARTITION BY {keys}metric ORDER BY b) AS seen, sum(n) OVER (PARTITION BY {keys}metric) AS total FROM {name}0),
{name}2 AS (SELECT {keys}metric, max(total) AS n, min(b) FILTER (WHERE 4 * seen >= total) AS b1, min(b) FILTER (WHERE 4 * seen >= 3 * total) AS b3 FROM {name}1 GROUP BY {keys}metric),
{name} AS (SELECT {keys}metric, n, {_FLOOR.format('b1')} AS q1, {_FLOOR.format('b3')} AS q3 FROM {name}2)"""


QUALITY_RULES = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
win AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS x FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM t WHERE len(w) >= 8)),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS c FROM win) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS j FROM dup) GROUP BY r),
ln AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM t),
fe AS (SELECT doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
    len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words FROM t JOIN ln USING (r) LEFT JOIN cov USING (r)),
m AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed, CASE WHEN n_words >= 100 THEN (100 * word_chars) // n_words END AS mean_len,
    CASE WHEN n_words > 0 THEN (1000 * n_symbols) // word_chars END AS symbols, CASE WHEN n_words > 0 THEN (1000 * n_dup_lines) // n_words END AS dup_lines,
    CASE WHEN n_words > 0 THEN (1000 * greatest(n_repeat_words - {REPEATS_FREE}, 0)) // n_words END AS repeats FROM fe),
lo AS ({_LONG}),
sk AS (SELECT lang, source, metric, {_BUCKET} AS b, count(*) AS n FROM lo GROUP BY ALL),
{_quartiles('o', 'lang, source')}, {_quartiles('l', 'lang')}, {_quartiles('a', '')},
g AS (SELECT * FROM (SELECT DISTINCT lang, source FROM sk), (SELECT unnest([{', '.join(repr(f.metric) for f in FENCES)}]) AS metric)),
pk AS (SELECT g.lang, g.source, g.metric, CASE WHEN o.n >= 50 THEN o.q1 WHEN l.n >= 50 THEN l.q1 ELSE a.q1 END AS q1, CASE WHEN o.n >= 50 THEN o.q3 WHEN l.n >= 50 THEN l.q3 ELSE a.q3 END AS q3
    FROM g LEFT JOIN o ON o.lang IS NOT DISTINCT FROM g.lang AND o.source IS NOT DISTINCT FROM g.source AND o.metric = g.metric
    LEFT JOIN l ON l.lang IS NOT DISTINCT FROM g.lang AND l.metric = g.metric LEFT JOIN a ON a.metric = g.metric),
bd AS (SELECT lang, source, {_bounds()} FROM pk GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_INSIDE} AS kept
FROM m LEFT JOIN bd ON m.lang IS NOT DISTINCT FROM bd.lang AND m.source IS NOT DISTINCT FROM bd.source
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
JACCARD_JOIN = f"""
WITH RECURSIVE t AS (SELECT doc_id, {_W.format(_LOWER)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) >= 3)
    UNION ALL SELECT doc_id, len(w) || ':' || array_to_string(w, ' ') FROM t WHERE len(w) BETWEEN 1 AND 2)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM i JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM t UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM t LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x) c USING (doc_id)
"""

SUBSTRING_DEDUP = f"""
WITH t AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM t WHERE len(w) >= 13)),
seen AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY x) AS first FROM win),
gone AS (SELECT DISTINCT doc_id, j FROM (SELECT doc_id, unnest(range(i, i + 13)) AS j FROM seen WHERE first < doc_id)),
kept AS (SELECT u.doc_id, string_agg(u.word, ' ' ORDER BY u.j) AS k FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM t) u ANTI JOIN gone ON gone.doc_id = u.doc_id AND gone.j = u.j GROUP BY u.doc_id)
SELECT t.doc_id, len(w) AS n_words, coalesce(g.n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM t LEFT JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g USING (doc_id)
"""

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_W.format("lower(coalesce(text, ''))")} AS w FROM documents), b AS (SELECT item_id, {_W.format("lower(coalesce(text, ''))")} AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
    UNION ALL SELECT doc_id, len(w) || ':' || array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4)),
bs AS (SELECT DISTINCT item_id, g FROM (SELECT item_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM b WHERE len(w) >= 5)
    UNION ALL SELECT item_id, len(w) || ':' || array_to_string(w, ' ') FROM b WHERE len(w) BETWEEN 1 AND 4)),
n AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id), s AS (SELECT doc_id, item_id, count(*) AS c FROM ds JOIN bs USING (g) GROUP BY ALL)
SELECT doc_id, item_id, n AS n_item_shingles, c AS n_shared, c / n AS containment FROM s JOIN n USING (item_id) WHERE 100 * c >= 80 * n
"""

# CRC-32 byte by byte from its generator polynomial: eight steps a byte.
_STEP = "CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
SHARDING = """
WITH RECURSIVE tab(k, n, c) AS (SELECT 0, i, i::BIGINT FROM range(256) r(i) UNION ALL SELECT k + 1, n, """ + _STEP + """ FROM tab WHERE k < 8),
tl AS (SELECT list(c ORDER BY n) AS t FROM tab WHERE k = 8),
x AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
d AS (SELECT doc_id, length(h) // 2 + 1 AS size, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
    lambda a, v: xor(a >> 8, t[1 + (xor(a, v) & 255)])), 4294967295) AS text_crc32 FROM x, tl),
p AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS LAST, text_crc32, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before, sum(size) OVER () AS total FROM d),
s AS (SELECT *, least(7, ((2 * before + size) * 8) // (2 * total))::INT AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS LAST, text_crc32, size) - 1 AS slot, NULL::INT AS grown_shard FROM s
"""

# CRC-32 is linear: each byte's share depends on the byte and on its distance from the end, and lengths have a share of their own.
_PLAIN = "trim(regexp_replace(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'))"


def _grams(table: str, key: str) -> str:
    runs = " UNION ALL ".join(f"SELECT {key}, n_words, array_to_string(w[i:i + {k - 1}], ' ') AS g FROM (SELECT {key}, n_words, w, unnest(range(1, n_words - {k - 2})) AS i FROM {table} WHERE n_words >= {k})" for k in (1, 2, 3))
    return f"SELECT {key}, g, count(*) AS n FROM ({runs}) GROUP BY ALL"


_SPLIT = f"SELECT *, CASE WHEN p = '' THEN [] ELSE string_split(p, ' ') END AS w, len(w) AS n_words FROM (SELECT {{0}} AS id, {_PLAIN.format('text')} AS p FROM {{1}})"
RESAMPLING = f"""
WITH RECURSIVE bytes(k, b, c) AS (SELECT 0, i, i::BIGINT FROM range(256) r(i) UNION ALL SELECT k + 1, b, {_STEP} FROM bytes WHERE k < 8),
d AS ({_SPLIT.format('doc_id', 'documents')}), t AS ({_SPLIT.format('item_id', 'benchmark')}),
df AS ({_grams('d', 'id')}), tf AS ({_grams('t', 'id')}),
g AS (SELECT g, row_number() OVER () AS r, strlen(g) AS len, hex(encode(g)) AS h FROM (SELECT g FROM df UNION SELECT g FROM tf)),
far(dist, b, c) AS (SELECT 0, b, c FROM bytes WHERE k = 8 UNION ALL SELECT dist + 1, f.b, xor(f.c >> 8, z.c) FROM far f JOIN (SELECT b, c FROM bytes WHERE k = 8) z ON z.b = f.c & 255 WHERE dist < (SELECT max(len) FROM g)),
head(len, c) AS (SELECT 0, 4294967295::BIGINT UNION ALL SELECT head.len + 1, xor(head.c >> 8, z.c) FROM head JOIN (SELECT b, c FROM bytes WHERE k = 8) z ON z.b = head.c & 255 WHERE head.len < (SELECT max(len) FROM g)),
x AS (SELECT r, bit_xor(far.c) AS c FROM (SELECT r, len, h, unnest(range(len)) AS i FROM g) u JOIN far ON far.dist = u.len - 1 - u.i AND far.b = ('0x' || substr(u.h, 2 * u.i + 1, 2))::INT GROUP BY r),
bk AS (SELECT g.g, xor(xor(x.c, head.c), 4294967295) % 10000 AS bucket FROM g JOIN x USING (r) JOIN head ON head.len = g.len),
s AS (SELECT bucket, sum(n)::BIGINT AS s FROM df JOIN bk USING (g) GROUP BY bucket), tt AS (SELECT bucket, sum(n)::BIGINT AS t FROM tf JOIN bk USING (g) GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE / ((s.s + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM tt) + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN tt USING (bucket)),
wt AS (SELECT id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM df JOIN bk USING (g) JOIN gains USING (bucket) GROUP BY id),
sc AS (SELECT d.id AS doc_id, n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || d.id), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN wt ON wt.id = d.id),
rk AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM sc WHERE n_words >= 20)
SELECT sc.doc_id, n_features, weight, score, CASE WHEN rk.rank <= 5 * n // 100 THEN rk.rank END AS rank, n_words FROM sc LEFT JOIN rk USING (doc_id)
"""


def _clustering(rounds: int) -> str:
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS (SELECT vec_id, k AS cluster, distance FROM (SELECT vec_id, k, distance, row_number() OVER (PARTITION BY vec_id ORDER BY distance, k) AS r FROM
    (SELECT v.vec_id, c.k, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS distance FROM e v JOIN c{r} c USING (i) GROUP BY v.vec_id, c.k)) WHERE r = 1)""")
        if r < rounds:
            steps.append(f"m{r} AS (SELECT cluster AS k, i, sum(x)::BIGINT AS s, count(*) AS n FROM e JOIN a{r} USING (vec_id) GROUP BY ALL)")
            steps.append(f"c{r + 1} AS (SELECT c.k, c.i, coalesce((s - ((s % n) + n) % n) // n, c.x) AS x FROM c{r} c LEFT JOIN m{r} m ON m.k = c.k AND m.i = c.i)")
    return f"""
WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM q),
c0 AS (SELECT k, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM (SELECT v, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS k FROM q) WHERE k < 16),
{", ".join(steps)},
s AS (SELECT k AS cluster, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY k)
SELECT vec_id, cluster::INT AS cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia, centroid_sha256 FROM a{rounds} JOIN s USING (cluster)
"""


CLUSTERING = _clustering(3)


def _licenses() -> str:
    compiled = [compile_template(t) for t in BASE + LICENSES]
    base = [(t.template.label, t.template.text.split()) for t in compiled if t.template.base]
    places = ", ".join(f"list_filter(range(1, len(w) + 1), lambda i: w[i:i + {len(p) - 1}] = [{', '.join(map(repr, p))}]) AS base{k}" for k, (_, p) in enumerate(base))
    starts = "list_concat(" + ", ".join(f"base{k}" for k in range(len(base))) + ")"
    base_labels = ", ".join(f"CASE WHEN len(base{k}) > 0 THEN '{label}' END" for k, (label, _) in enumerate(base))
    tests = [f"regexp_matches(' ' || p, '{t.pattern}( |$)')" for t in compiled]
    labels = ", ".join(f"CASE WHEN {x} THEN '{t.template.label}' END" for t, x in zip(compiled, tests, strict=True))
    most = ", ".join(f"CASE WHEN {x} THEN {t.n_mandatory} ELSE 0 END" for t, x in zip(compiled, tests, strict=True))
    joined = "array_to_string(list_sort(list_distinct(list_filter([{0}], lambda x: x IS NOT NULL))), ',')"
    return f"""
WITH d AS ({_SPLIT.format('doc_id', 'documents')}), b AS (SELECT *, {places} FROM d), c AS (SELECT *, {starts} AS starts, greatest({most}) AS most FROM b)
SELECT id AS doc_id, n_words, len(starts) AS n_base, list_min(starts) - 1 AS first_word, list_max(starts) - 1 AS last_word,
    {joined.format(base_labels)} AS base_labels, {joined.format(labels)} AS labels, most / (most + 10.0) AS score FROM c
"""


LICENSE_SCAN = _licenses()
