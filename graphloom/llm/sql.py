"""DuckDB SQL of the numbered queries that SQL can express in reasonable time."""

from __future__ import annotations

import string

from .decontaminate import WINDOW
from .importance import BUCKETS, MIN_WORDS, PERCENT
from .licences import _MAY, ALL_RULES, ALL_SENTENCES
from .phrases import INSIDE_PERCENT, MAX_WORDS, MIN_COUNT, PER_LANGUAGE, SCALE
from .pii import AFTER, BASE, BEFORE, MORE, SCORES

_LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_WORDS = "list_filter(regexp_split_to_array({0}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

_NEAR = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2 HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
r(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY 1)
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c ON doc_id = a"""

_QUALITY = f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, array_to_string(w[i:i + 4], ' ') AS s FROM t), d AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
p AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM d) GROUP BY 1),
f AS (SELECT t.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words, len(list_filter(w, lambda x: regexp_matches(x, '\\p{{L}}'))) AS n_lettered FROM t LEFT JOIN p USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR word_chars > 20 * n_words OR word_chars < 2 * n_words OR 100 * n_symbols > 25 * n_words OR 100 * n_dup_lines > 40 * n_lines OR 10 * n_lettered < 5 * n_words) AS kept FROM f"""

# The level at which capped targets use up the total: sources by the level at which each is full.
_MIX = f"""WITH d AS (SELECT doc_id, source, len({_WORDS.format("coalesce(text, '')")}) AS size, md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, ([3.0, 1.0, 2.0])[((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INTEGER]::DOUBLE AS w FROM d GROUP BY 1),
o AS (SELECT *, 2.0::DOUBLE * source_size / w AS full_at, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM s),
i AS (SELECT *, row_number() OVER (ORDER BY full_at, source) AS i FROM o),
v AS (SELECT *, (total - coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY i DESC ROWS UNBOUNDED PRECEDING) AS level FROM i),
h AS (SELECT arg_min(level, i) FILTER (level <= full_at) AS level FROM v),
t AS (SELECT source, source_size, least(level * w, 2.0::DOUBLE * source_size) AS target FROM o, h),
r AS (SELECT doc_id, size, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY k, size ROWS UNBOUNDED PRECEDING) - size AS before FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target, 4) AS target, (CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END * size + greatest(0, least(size, floor(target) - CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END * source_size - before)))::BIGINT AS taken FROM r"""

_TOKENS = "regexp_extract_all({0}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_LEAKS = f"""WITH b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_TOKENS.format(_LOWER)} AS w FROM benchmark), bw AS (SELECT item, least({WINDOW}, len(w)) AS m, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS i, w FROM b WHERE len(w) > 0),
g AS (SELECT DISTINCT item, m, array_to_string(w[i:i + m - 1], ' ') AS s FROM bw), d AS (SELECT doc_id, {_TOKENS.format(_LOWER)} AS w FROM documents),
ms AS (SELECT DISTINCT m FROM g), dw AS (SELECT doc_id, m, unnest(range(1, len(w) - m + 2)) AS i, array_to_string(w[i:i + m - 1], ' ') AS s FROM d, ms WHERE len(w) >= m),
hit AS (SELECT doc_id, i, dw.m, item FROM dw JOIN g ON dw.m = g.m AND dw.s = g.s), n AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS j FROM hit) GROUP BY 1),
it AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hit GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)"""

_KNOWN = ", ".join(f"('{s}', '{i}')" for s, i in ALL_SENTENCES.items())
_RULES = ", ".join(f"('{n}', '{i.replace(' ', '  ')}')" for n, i in ALL_RULES)
_ANY = "|".join(f" {i.replace(' ', '  ')} " for _, i in ALL_RULES)
_LICENCES = f"""WITH k AS (SELECT * FROM (VALUES {_KNOWN}) AS x(s, id)), n AS (SELECT * FROM (VALUES {_RULES}) AS x(name, ids)),
t AS (SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(text, '([.:;!?])\\x20+', '\\1' || chr(10), 'g'), '\\n+')) AS s, generate_subscripts(regexp_split_to_array(regexp_replace(text, '([.:;!?])\\x20+', '\\1' || chr(10), 'g'), '\\n+'), 1) AS i FROM documents WHERE regexp_matches(text, '{_MAY}')),
m AS (SELECT doc_id, i, id FROM t JOIN k ON k.s = trim(regexp_replace(lower(t.s), '[^a-z0-9]+', ' ', 'g'))), q AS (SELECT doc_id, list(id ORDER BY i) AS ids FROM m GROUP BY 1),
f AS (SELECT doc_id, ids, regexp_extract_all(' ' || array_to_string(ids, '  ') || ' ', '{_ANY}') AS found FROM q),
e AS (SELECT doc_id, string_agg(DISTINCT name, ',' ORDER BY name) AS licences, count(DISTINCT name) AS n FROM (SELECT doc_id, trim(unnest(found)) AS x FROM f) JOIN n ON x = ids GROUP BY 1)
SELECT d.doc_id, coalesce(array_to_string(ids, ' '), '') AS sentences, coalesce(licences, '') AS licences, coalesce(n, 0) AS n_licences, coalesce(list_sum(list_transform(found, lambda x: len(string_split(trim(x), '  ')))), 0) < coalesce(len(ids), 0) AS partly FROM documents d LEFT JOIN f USING (doc_id) LEFT JOIN e USING (doc_id)"""

# CRC-32 by its table of bytes, once for each different word.
_CRC = """tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
x AS (SELECT w, hex(encode(w)) AS h FROM {0}),
crc AS (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(h), 2), lambda i: (16 * (instr('0123456789ABCDEF', h[i]) - 1) + instr('0123456789ABCDEF', h[i + 1]) - 1)::BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS crc FROM x, tab)"""
_IMPORTANCE = f"""WITH d AS (SELECT row_number() OVER () AS i, doc_id, {_TOKENS.format(_LOWER)} AS ws FROM documents), b AS (SELECT {_TOKENS.format(_LOWER)} AS ws FROM benchmark),
dw AS (SELECT i, unnest(ws) AS w FROM d), bw AS (SELECT unnest(ws) AS w FROM b), v AS (SELECT w FROM dw UNION SELECT w FROM bw), {_CRC.format('v')},
s AS (SELECT crc % {BUCKETS} AS bucket, count(*) AS n FROM dw JOIN crc USING (w) GROUP BY 1), t AS (SELECT crc % {BUCKETS} AS bucket, count(*) AS n FROM bw JOIN crc USING (w) GROUP BY 1),
g AS (SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM s)::DOUBLE + {BUCKETS}) / ((s.n + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM t), 0)::DOUBLE + {BUCKETS}))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
wt AS (SELECT i, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM dw JOIN crc USING (w) JOIN g ON crc % {BUCKETS} = bucket GROUP BY 1),
h AS (SELECT i, doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, list_reduce(list_transform(range(1, 9), lambda k: (instr('0123456789abcdef', sha256('2024:' || coalesce(doc_id::VARCHAR, ''))[k]) - 1)::BIGINT), lambda a, c: a * 16 + c) AS h FROM d LEFT JOIN wt USING (i)),
z AS (SELECT i, doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM h),
r AS (SELECT i, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, n_features, weight) AS rank, count(*) OVER () AS n FROM z WHERE n_features >= {MIN_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {PERCENT} * n // 100 THEN rank END AS rank FROM z LEFT JOIN r USING (i)"""

_PHRASES = f"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS s FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (SELECT unnest(range(1, {MAX_WORDS} + 1)) AS m))),
c AS (SELECT lang, m, s, count(*) AS f FROM g GROUP BY ALL), n AS (SELECT lang, sum(f)::BIGINT AS n FROM c WHERE m = 1 GROUP BY 1), o AS (SELECT *, string_split(s, ' ') AS w FROM c WHERE m > 1 AND f >= {MIN_COUNT}),
x AS (SELECT lang, s, w, f AS a, unnest(range(1, m)) AS k FROM o), j AS (SELECT x.lang AS lang, x.s AS s, x.w AS w, a, k, l.f AS l, r.f AS r, ({SCALE}::HUGEINT * a // (l.f + r.f))::BIGINT AS score FROM x JOIN c l ON l.lang = x.lang AND l.s = array_to_string(x.w[1:k], ' ') JOIN c r ON r.lang = x.lang AND r.s = array_to_string(x.w[k + 1:], ' ')),
b AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY lang, s ORDER BY score, k) = 1),
i AS (SELECT lang, array_to_string(w[u:u + t - 1], ' ') AS s, max(f) AS longer FROM (SELECT *, unnest(range(1, m - t + 2)) AS u FROM (SELECT *, unnest(range(2, m)) AS t FROM o)) GROUP BY 1, 2),
q AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.s) AS rank FROM b LEFT JOIN i ON b.lang = i.lang AND b.s = i.s WHERE longer IS NULL OR 100::HUGEINT * longer < {INSIDE_PERCENT} * a::HUGEINT)
SELECT q.lang, rank, s AS phrase, a, l, r, n, score FROM q JOIN n ON q.lang = n.lang WHERE rank <= {PER_LANGUAGE}"""


def _simhash() -> str:
    """XXH64 in integers of 128 bits, once for each different shingle; then counts of bits, and all pairs of fingerprints."""
    p1, p2, p3, p4, p5 = (f"{p}::UHUGEINT" for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
    low = lambda x: f"(({x}) % 18446744073709551616::UHUGEINT)"
    turned = lambda x, n: low(f"(({x}) << {n}) | (({x}) >> {64 - n})")
    stirred = lambda acc, lane: low(f"{turned(low(f'{acc} + {low(f'{lane} * {p2}')}'), 31)} * {p1}")
    read = lambda at, n: f"list_reduce(list_reverse(b[{at} + 1:{at} + {n}]), lambda a, c: a * 256::UHUGEINT + c)"
    lanes = [f"list_reduce(list_prepend({(42 + start) % 2**64}::UHUGEINT, list_transform(range(0, n // 32), lambda i: {read(f'i * 32 + {8 * k}', 8)})), lambda a, c: {stirred('a', 'c')}) AS v{k}" for k, start in enumerate((11400714785074694791 + 14029467366897019727, 14029467366897019727, 0, 2**64 - 11400714785074694791))]
    merged = low(" + ".join(turned(f"v{k}", n) for k, n in enumerate((1, 7, 12, 18))))
    steps = [f"SELECT *, CASE WHEN n >= 32 THEN {merged} ELSE {low(f'42::UHUGEINT + {p5}')} END AS h FROM v"]
    steps += [f"SELECT * REPLACE (CASE WHEN n >= 32 THEN {low(f'xor(h, {stirred('0::UHUGEINT', f'v{k}')}) * {p1} + {p4}')} ELSE h END AS h) FROM {{0}}" for k in range(4)]
    steps += [f"SELECT * REPLACE ({low('h + n::UHUGEINT')} AS h) FROM {{0}}"]
    steps += [f"SELECT * REPLACE (list_reduce(list_prepend(h, list_transform(range(n - n % 32, n - n % 8, 8), lambda i: {read('i', 8)})), lambda a, c: {low(f'{turned(f'xor(a, {stirred('0::UHUGEINT', 'c')})', 27)} * {p1} + {p4}')}) AS h) FROM {{0}}"]
    steps += [f"SELECT * REPLACE (CASE WHEN n % 8 >= 4 THEN {low(f'{turned(f'xor(h, {low(f'{read('(n - n % 8)', 4)} * {p1}')})', 23)} * {p2} + {p3}')} ELSE h END AS h) FROM {{0}}"]
    steps += [f"SELECT * REPLACE (list_reduce(list_prepend(h, b[n - n % 4 + 1:n]), lambda a, c: {low(f'{turned(f'xor(a, {low(f'c * {p5}')})', 11)} * {p1}')}) AS h) FROM {{0}}"]
    steps += [f"SELECT * REPLACE ({low(f'xor(h, h >> 33) * {p2}')} AS h) FROM {{0}}", f"SELECT * REPLACE ({low(f'xor(h, h >> 29) * {p3}')} AS h) FROM {{0}}", "SELECT s, xor(h, h >> 32)::UBIGINT AS h FROM {0}"]
    hashed = ", ".join(f"h{i} AS ({step.format(f'h{i - 1}')})" for i, step in enumerate(steps))
    counts = ", ".join(f"sum((h >> {k}) & 1) AS c{k}" for k in range(64))
    bits = " + ".join(f"CASE WHEN 2 * c{k} > n THEN {1 << k}::UHUGEINT ELSE 0 END" for k in range(64))
    return f"""WITH RECURSIVE w AS (SELECT row_number() OVER () AS i, doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
s AS (SELECT i, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
t AS (SELECT s, strlen(s) AS n, list_transform(range(1, 2 * strlen(s), 2), lambda i: (16 * (instr('0123456789ABCDEF', hex(encode(s))[i]) - 1) + instr('0123456789ABCDEF', hex(encode(s))[i + 1]) - 1)::UHUGEINT) AS b FROM (SELECT DISTINCT s FROM s)),
v AS (SELECT *, {', '.join(lanes)} FROM t), {hashed},
c AS (SELECT i, count(*) AS n, {counts} FROM s JOIN h{len(steps) - 1} USING (s) GROUP BY 1), p AS (SELECT doc_id, coalesce({bits}, 0)::UBIGINT AS p FROM w LEFT JOIN c USING (i)),
f AS (SELECT DISTINCT p FROM p), l AS (SELECT a.p AS a, b.p AS b FROM f a JOIN f b ON bit_count(xor(a.p, b.p)::HUGEINT) <= 2),
r(a, b) AS (SELECT p, p FROM f UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a), e AS (SELECT r.a AS p, min(doc_id) AS component_id FROM r JOIN p ON p.p = r.b GROUP BY 1)
SELECT doc_id, lpad(lower(hex(p)), 16, '0') AS fingerprint, component_id FROM p JOIN e USING (p)"""


# The proposals without what must not stand around them, which is looked at afterwards.
_PROPOSED = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "national_phone": r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}",
}
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_CONTEXT = "regexp_matches(lower(right(before, {0})), '{2}') OR regexp_matches(lower(left(behind, {1})), '{2}')"
_VALID = {
    "email": "true",
    "ip": "len(list_filter(string_split(m, '.'), lambda x: coalesce(try_cast(x AS HUGEINT), 256) > 255)) = 0",
    "card": f"length({_DIGITS}) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN (length({_DIGITS}) - i) % 2 = 1 THEN CASE WHEN {_DIGITS}[i]::INTEGER > 4 THEN {_DIGITS}[i]::INTEGER * 2 - 9 ELSE {_DIGITS}[i]::INTEGER * 2 END ELSE {_DIGITS}[i]::INTEGER END)) % 10 = 0",
    "phone": f"length({_DIGITS}) BETWEEN 9 AND 15",
    "iban": "NOT regexp_matches(prev, '[A-Za-z0-9]') AND NOT regexp_matches(next, '[A-Za-z0-9]') AND list_reduce(list_transform(string_split(replace(m, ' ', '')[5:] || replace(m, ' ', '')[1:4], ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END::BIGINT), lambda a, c: (a * CASE WHEN c < 10 THEN 10 ELSE 100 END + c) % 97) = 1",
    "ssn": "NOT regexp_matches(prev, '[0-9-]') AND NOT regexp_matches(next, '[0-9-]') AND NOT regexp_matches(m, '^(?:000|666|9)') AND ({0})",
    "national_phone": "NOT regexp_matches(prev, '[0-9+(.-]') AND NOT regexp_matches(next, '[0-9.-]') AND ({0})",
}


def _personal() -> str:
    """Proposals with their places (what stands before them is summed), then tests; the last two kinds need a context word."""
    told = {k: _VALID[k].replace("{0}", _CONTEXT.format(BEFORE, AFTER, SCORES[k][2])) if k in ("ssn", "national_phone") else _VALID[k] for k in (*BASE, *MORE)}
    found = " UNION ALL ".join(f"SELECT doc_id, {i} AS o, '{k}' AS kind, regexp_extract_all(text, '{_PROPOSED[k]}') AS f, regexp_split_to_array(text, '{_PROPOSED[k]}') AS p FROM d" for i, k in enumerate(told))
    size = "coalesce(list_sum(list_transform({0}, lambda t: length(t))), 0)"
    counts = ", ".join(f"count_if(kind = '{k}') AS n_{k}" for k in BASE)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), r AS ({found}), x AS (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM r),
y AS (SELECT doc_id, o, kind, f[i] AS m, p[i] AS before, p[i + 1] AS behind, CASE WHEN p[i] <> '' THEN right(p[i], 1) WHEN i > 1 THEN right(f[i - 1], 1) ELSE '' END AS prev, CASE WHEN p[i + 1] <> '' THEN left(p[i + 1], 1) WHEN i < len(f) THEN left(f[i + 1], 1) ELSE '' END AS next, ({size.format('p[1:i]')} + {size.format('f[1:i - 1]')})::BIGINT AS a FROM x),
z AS (SELECT doc_id, o, kind, kind || ':' || a || ':' || (a + length(m)) AS s, a FROM y WHERE CASE kind {' '.join(f"WHEN '{k}' THEN {v}" for k, v in told.items())} END),
g AS (SELECT doc_id, {counts}, string_agg(s, ',' ORDER BY o, a) FILTER (o < {len(BASE)}) AS base, string_agg(s, ',' ORDER BY o, a) AS spans FROM z GROUP BY 1)
SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)"""


ORACLES: dict[str, str] = {"op1_near_duplicates": _NEAR, "op2_personal_data": _personal(), "op5_quality_rules": _QUALITY, "op6_mix_sources": _MIX, "op9_decontamination": _LEAKS, "op10_licences": _LICENCES, "op11_simhash": _simhash(), "op12_importance_resampling": _IMPORTANCE, "op13_collocations": _PHRASES}
