"""DuckDB SQL of the operators' queries, where SQL can express them: plain definitions, no method."""

from __future__ import annotations

from sievework.llm import quality, secrets, sharding

_ROWS = "SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents"
_WORD = r"[^\x20\x09-\x0D]+"
_BITS = " + ".join(f"CASE WHEN {fails} THEN {1 << bit} ELSE 0 END" for bit, (_, fails) in enumerate(quality.RULES))
_BASE, _KEPT = quality.mask(quality.POLICIES["base-1"]), quality.mask(quality.POLICIES["prose-1"])


def _count(pattern: str) -> str:
    """Characters of ``t`` that a negated class leaves."""
    return f"CAST(length(regexp_replace(t, '{pattern}', '', 'g')) AS BIGINT)"


OP1 = rf"""WITH d AS (SELECT *, regexp_extract_all(t, '{_WORD}') AS w FROM ({_ROWS})),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM d),
g AS (SELECT rid, k, array_to_string(w[k:k + {quality.WINDOW - 1}], ' ') AS win FROM (SELECT rid, w, unnest(range(1, len(w) - {quality.WINDOW - 2})) AS k FROM d)),
again AS (SELECT rid, k FROM g QUALIFY count(*) OVER (PARTITION BY rid, win) > 1),
cover AS (SELECT rid, CAST(count(DISTINCT p) AS BIGINT) AS n FROM (SELECT rid, unnest(range(k, k + {quality.WINDOW})) AS p FROM again) GROUP BY 1),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, {_count("[^#*$%&|<>]")} AS n_symbols,
 CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, {_count("[^A-Z]")} AS n_upper, {_count(chr(92) + "P{L}")} AS n_letters,
 {_count("[^!]")} AS n_exclaims, CAST(len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) AS BIGINT) AS n_same_next FROM l LEFT JOIN cover USING (rid)),
b AS (SELECT *, CAST({_BITS} AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & {_BASE} <> 0 AS base_failed, fail_bits & {_BASE} = 0 AND fail_bits & {_KEPT} = 0 AS kept, fail_bits, 'prose-1' AS policy FROM b"""


def _spans(rank: int, rule: secrets.Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    value = f"regexp_extract_all(t, '{pattern}', {rule.value_group})"
    keep = {"true": "true", "length(v) >= 6": "length(v[k]) >= 6", "length(m) >= 20": "length(m[k]) >= 20"}[rule.keep]
    return f"""SELECT rid, {rank} AS rank, '{rule.kind}' AS kind, a, a + length(m[k]) AS e FROM (
 SELECT rid, m, v, k, CAST(list_sum(list_transform(p[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) AS BIGINT) AS a
 FROM (SELECT rid, m, v, p, unnest(range(1, len(m) + 1)) AS k FROM (SELECT rid, regexp_extract_all(t, '{pattern}') AS m, {value} AS v, string_split_regex(t, '{pattern}') AS p FROM d))) WHERE {keep}"""


_ALL = " UNION ALL ".join(_spans(i, rule) for i, rule in enumerate(secrets.RULES))
OP4 = f"""WITH d AS ({_ROWS}), s AS ({_ALL}),
j AS (SELECT rid, {", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in secrets.BASE_RULES)},
 coalesce(string_agg(concat(kind, ':', a, ':', e), ',' ORDER BY a, rank) FILTER (WHERE rank < {len(secrets.BASE_RULES)}), '') AS base, string_agg(concat(kind, ':', a, ':', e), ',' ORDER BY a, rank) AS spans FROM s GROUP BY 1)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secrets.BASE_RULES)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN j USING (rid)"""

_DIGEST = """array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT) + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT)
 + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT) + CAST(substr(bits, 5 * i + 5, 1) AS INT), 1) FOR i IN range(32)], '')"""
OP7 = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top, array_to_string([format('{{:04b}}', strpos('0123456789abcdef', c) - 1) FOR c IN string_split(sha1(h), '')], '') AS bits FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, {_DIGEST} AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM q"""

OP8 = f"""WITH RECURSIVE d AS (SELECT rid, doc_id, regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM ({_ROWS})),
s AS (SELECT DISTINCT rid, array_to_string(w[k:k + 4], ' ') AS g FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1) + 1))) AS k FROM d)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.rid AS a, b.rid AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.rid < b.rid GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT rid AS a, rid AS b FROM d UNION SELECT r.a, x.b FROM r JOIN both_ways x ON x.a = r.b),
m AS (SELECT r.a AS rid, min(doc_id) AS least FROM r JOIN d ON d.rid = r.b GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(least, doc_id) AS component_id FROM d JOIN m USING (rid) LEFT JOIN n USING (rid)"""

OP10 = """WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT rid, o, substr(h, 2 * o + 1, 2398) AS h FROM (SELECT rid, h, unnest(range(0, CAST(length(h) // 2 - 199 AS BIGINT), 1000)) AS o FROM d)),
w AS (SELECT rid, o + q AS p, hash(substr(h, 2 * q + 1, 400)) AS name FROM (SELECT rid, o, h, unnest(range(CAST(length(h) // 2 - 199 AS BIGINT))) AS q FROM c)),
again AS (SELECT rid, p FROM w WHERE name IN (SELECT name FROM w GROUP BY 1 HAVING count(*) > 1)),
marked AS (SELECT rid, p, CASE WHEN p <= lag(p) OVER (PARTITION BY rid ORDER BY p) + 200 THEN 0 ELSE 1 END AS fresh FROM again),
runs AS (SELECT rid, min(p) AS lo, max(p) + 200 AS hi FROM (SELECT rid, p, sum(fresh) OVER (PARTITION BY rid ORDER BY p) AS run FROM marked) GROUP BY rid, run),
ends AS (SELECT rid, hi AS a, coalesce(lead(lo) OVER (PARTITION BY rid ORDER BY lo), 1000000000) AS b FROM runs UNION ALL SELECT rid, 0, min(lo) FROM runs GROUP BY 1),
rest AS (SELECT rid, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS kept FROM ends JOIN d USING (rid) GROUP BY 1),
sums AS (SELECT rid, CAST(sum(hi - lo) AS BIGINT) AS n_removed, count(*) AS n_spans FROM runs GROUP BY 1)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN rest USING (rid) LEFT JOIN sums USING (rid)"""

OP11 = """WITH v AS (SELECT DISTINCT CAST(vec_id AS BIGINT) AS id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c AS (SELECT row_number() OVER () AS n, * FROM v),
s AS (SELECT a.n, a.id AS anchor_id, x.id, a.label = x.label AS same, CAST(list_dot_product(a.v::DOUBLE[], x.v::DOUBLE[]) AS BIGINT) AS score FROM c a JOIN c x ON a.id <> x.id WHERE a.id % 50 = 0),
p AS (SELECT n, anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY n ORDER BY score DESC, id) AS place FROM s WHERE same QUALIFY place <= 5),
h AS (SELECT p.n, place, p.anchor_id, positive_id, positive_score, s.id AS negative_id, s.score AS negative_score FROM p JOIN s ON s.n = p.n AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY n, place ORDER BY negative_score DESC, negative_id) AS INT) AS rank, negative_id, positive_score, negative_score FROM h QUALIFY rank <= 3"""


def _mixed(x: str, keys: tuple[int, int, int]) -> str:
    first, second, third = keys
    once = f"({x} * {first} + {second}) % {sharding.PRIME}"
    twice = f"[(q * q + {third}) % {sharding.PRIME} FOR q IN [{once}]]"
    last = f"[(xor(q, q >> 15) * {second} + {first}) % {sharding.PRIME} FOR q IN {twice}]"
    return f"[(q * q + q * {third}) % {sharding.PRIME} FOR q IN {last}][1]"


def _network(source: str) -> str:
    """(row_number, x) of a relation after one application of the permutation's network."""
    query = f"SELECT *, x // b AS l, x % b AS r FROM ({source}) CROSS JOIN side"
    for i, keys in enumerate(sharding.round_keys(sharding.SEED)):
        sums = f"(l + {_mixed('r', keys)} % a) % a AS l, r" if i % 2 == 0 else f"l, (r + {_mixed('l', keys)} % b) % b AS r"
        query = f"SELECT * EXCLUDE (l, r), {sums} FROM ({query})"
    return f"SELECT * EXCLUDE (l, r, x, a, b, n), l * b + r AS x FROM ({query})"


#: CRC-32 in SQL: ``far`` has what a byte leaves in the register after so many zero bytes more; chunks of 256 bytes are summed by
#: it and folded. The bytes 62F52692 take a zero register to all ones, the checksum's start.
OP13 = f"""WITH RECURSIVE steps AS (SELECT i AS byte, i AS c, 0 AS k FROM range(256) t(i) UNION ALL SELECT byte, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY byte) AS crcs FROM steps WHERE k = 8),
far AS (SELECT byte, c AS v, 0 AS d FROM steps WHERE k = 8 UNION ALL SELECT byte, xor(v >> 8, crcs[1 + (v & 255)]), d + 1 FROM far, crc_table WHERE d < 255),
fold AS (SELECT list(v ORDER BY byte) FILTER (WHERE d = 255) AS f0, list(v ORDER BY byte) FILTER (WHERE d = 254) AS f1, list(v ORDER BY byte) FILTER (WHERE d = 253) AS f2, list(v ORDER BY byte) FILTER (WHERE d = 252) AS f3 FROM far),
named AS (SELECT format('{{:02X}}', byte) AS hx, 255 - d AS at, v FROM far),
d AS (SELECT doc_id, octet_length(encode(t)) AS bytes, '62F52692' || hex(encode(t)) AS h, row_number() OVER (ORDER BY doc_id NULLS FIRST, md5(t)) - 1 AS row_number FROM ({_ROWS})),
chunks AS (SELECT row_number, k, substr(h, 512 * k + 1, 512) AS h FROM (SELECT row_number, h, unnest(range(length(h) // 512)) AS k FROM (SELECT row_number, repeat('0', (512 - length(h) % 512) % 512) || h AS h FROM d))),
sums AS (SELECT row_number, k, bit_xor(v) AS v FROM (SELECT row_number, k, h, unnest(range(256)) AS at FROM chunks) c JOIN named ON named.at = c.at AND hx = substr(h, 2 * c.at + 1, 2) GROUP BY 1, 2),
z AS (SELECT row_number, list_reduce(vs, lambda c, v: xor(xor(xor(f0[1 + (c & 255)], f1[1 + ((c >> 8) & 255)]), xor(f2[1 + ((c >> 16) & 255)], f3[1 + (c >> 24)])), v)) AS c FROM (SELECT row_number, list(v ORDER BY k) AS vs FROM sums GROUP BY 1), fold),
total AS (SELECT count(*) AS n FROM d),
side AS (SELECT a, greatest(1, (n + a - 1) // a) AS b, n FROM (SELECT n, unnest(range(CAST(floor(sqrt(greatest(n - 1, 0))) AS BIGINT) + 1, CAST(floor(sqrt(greatest(n - 1, 0))) AS BIGINT) + {sharding.GRIDS + 1})) AS a FROM total) ORDER BY a * b, a LIMIT 1),
walk AS ({_network("SELECT row_number, row_number AS x FROM d")} UNION ALL {_network("SELECT walk.row_number, walk.x FROM walk WHERE x >= (SELECT n FROM total)")}),
p AS (SELECT row_number, x FROM walk WHERE x < (SELECT n FROM total))
SELECT doc_id, CAST(bytes + 8 AS BIGINT) AS size, CAST(xor(c, 4294967295) AS BIGINT) AS text_crc32, 'rows' AS law, CAST(x % 24 AS INT) AS shard, x // 24 AS slot, CAST(NULL AS INT) AS grown_shard, row_number FROM d JOIN p USING (row_number) JOIN z USING (row_number)"""

SQL = {"op1_quality_rules": OP1, "op4_secret_scans": OP4, "op7_warc": OP7, "op8_ngram_jaccard_join": OP8, "op10_suffix_dedup": OP10, "op11_hard_negatives": OP11, "op13_sharding": OP13}
