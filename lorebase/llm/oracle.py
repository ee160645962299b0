"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from .license_scan import COPYRIGHT_LINE, EQUIVALENT, KNOWN, PUNCTUATION, TITLE_LINE

_LOWER = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _canonical(x: str) -> str:
    out = _LOWER.format(x=f"coalesce({x}, {chr(39) * 2})")
    for pattern in (COPYRIGHT_LINE, TITLE_LINE):
        out = f"regexp_replace({out}, {_quoted(pattern)}, '', 'g')"
    out = f"' ' || regexp_replace({out}, {_quoted(PUNCTUATION)}, '  ', 'g') || ' '"
    for one, other in EQUIVALENT:
        out = f"replace({out}, ' {one.replace(' ', '  ')} ', ' {other.replace(' ', '  ')} ')"
    return f"trim(regexp_replace({out}, '  +', ' ', 'g'))"


_KNOWN = ", ".join(f"({_quoted(name)}, {_quoted(text)})" for name, texts in KNOWN.items() for text in texts)

OP1 = f"""WITH told AS (SELECT sha256({_canonical('text')}) AS digest, min(license) AS license FROM (VALUES {_KNOWN}) k(license, text) GROUP BY 1),
line AS (SELECT DISTINCT doc_id, l FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents)),
found AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS line_licenses FROM line JOIN told ON sha256({_canonical('l')}) = digest WHERE {_canonical('l')} <> '' GROUP BY 1)
SELECT doc_id, sha256({_canonical('text')}) AS digest, license, coalesce(line_licenses, '') AS line_licenses
FROM documents LEFT JOIN told ON sha256({_canonical('text')}) = told.digest LEFT JOIN found USING (doc_id)"""

_CRC = "list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, octet_length({b}) + 1), lambda i: ('0x' || hex({b}[i:i]))::UBIGINT)), lambda a, b: xor(a >> 8, t[CAST((xor(a, b) & 255) + 1 AS BIGINT)]))"


def _shard(n: int) -> str:
    scores = ", ".join(f"{{'score': -1.0::DOUBLE / ln((('0x' || md5(k || ':{s}')[1:12])::UBIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE), 'shard': {-s}}}" for s in range(n))
    return f"CAST(-list_max([{scores}]).shard AS INTEGER)"


OP4 = f"""WITH RECURSIVE bits(v, c, k) AS (SELECT i::UBIGINT, i::UBIGINT, 0 FROM range(256) r(i) UNION ALL SELECT v, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY v) AS t FROM bits WHERE k = 8),
d AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS k, encode(coalesce(text, '')) AS b FROM documents),
s AS (SELECT doc_id, k, CAST(octet_length(b) + 1 AS BIGINT) AS size, CAST(xor({_CRC.format(b='b')}, 4294967295::UBIGINT) AS BIGINT) AS text_crc32, {_shard(8)} AS shard, {_shard(9)} AS grown_shard FROM d, crc)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY md5(k), k, text_crc32, size) - 1 AS slot, grown_shard FROM s"""

_WORDS = "regexp_extract_all(" + _LOWER.format(x="coalesce(text, '')") + ", '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP6 = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS x FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM win),
runs AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS x FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
hits AS (SELECT doc_id, i, win.size, item_id FROM runs JOIN win USING (x, size)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT doc_id, i, size FROM hits)) GROUP BY 1),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hits GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""

OP9 = """WITH u AS (SELECT page_id, coalesce(url, '') AS url, CASE WHEN contains(url, '://') THEN regexp_extract(substring(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, url, translate(string_split(rest, '/')[1], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, CASE WHEN contains(rest, '/') THEN substring(rest, strpos(rest, '/')) ELSE '' END AS path FROM u),
r(rule, verdict, h, t) AS (VALUES ('net/', 'block', 'net', '/'), ('example.net/en/', 'allow', 'example.net', '/en/'), ('example.com/de/', 'block', 'example.com', '/de/'), ('org/fr/', 'allow', 'org', '/fr/')),
best AS (SELECT page_id, arg_max(rule, len(rule)) AS rule, arg_max(verdict, len(rule)) AS verdict FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, t) GROUP BY 1),
x(pattern, re) AS (VALUES ('.ads-track.', '\\.ads-track\\.'), ('/ads/', '/ads/'), ('^utm_medium=banner^', '(?:[^A-Za-z0-9_.%-]|$)utm_medium=banner(?:[^A-Za-z0-9_.%-]|$)'), ('/track/*/pixel.', '(?s)/track/.*/pixel\\.'), ('//doubleclick.', '//doubleclick\\.')),
pat AS (SELECT page_id, (list(pattern ORDER BY len(pattern) DESC, pattern))[1] AS pattern FROM p JOIN x ON regexp_matches(lower(url), re) GROUP BY 1)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, CASE WHEN rule IS NULL THEN pattern END AS pattern
FROM p LEFT JOIN best USING (page_id) LEFT JOIN pat USING (page_id)"""

OP10 = """WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(x) AS g, x FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [array_to_string(w, ' ')] END) AS x FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM n UNION SELECT reach.doc_id, b FROM reach JOIN both_ways ON a = r),
low AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component_id, w.doc_id) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN low USING (doc_id)"""

OP11 = """WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS key FROM documents),
s AS (SELECT source, sum(size) AS words, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM d GROUP BY source),
r AS (SELECT *, 3 * words AS most, sum(words) OVER () AS total, coalesce(sum(3 * words) OVER before, 0) AS full_before, sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS weight_left FROM s
  WINDOW before AS (ORDER BY CAST(3 * words AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, CAST(most AS DOUBLE) * weight_left <= CAST(weight AS DOUBLE) * CAST(total - full_before AS DOUBLE) AS filled FROM r),
t AS (SELECT source, words AS source_size, CASE WHEN filled THEN CAST(most AS DOUBLE) ELSE CAST(weight AS DOUBLE) * CAST(total - coalesce(sum(most) FILTER (filled) OVER (), 0) AS DOUBLE) / CAST(sum(weight) FILTER (NOT filled) OVER () AS DOUBLE) END AS target FROM f),
o AS (SELECT doc_id, size, source_size, target, CAST(floor(target + 0.5) AS BIGINT) AS budget, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target, CAST(CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size * size + greatest(0, least(size, budget % source_size - before)) END AS BIGINT) AS taken FROM o"""


def _op13(entries: int = 64, rounds: int = 2) -> str:
    def assigned(i: int) -> str:
        far = "list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        return f"a{i} AS (SELECT vec_id, m, any_value(p.x) AS x, arg_min(k, {far} * {entries} + k) AS k, min({far}) AS far FROM p JOIN c{i} c USING (m) GROUP BY vec_id, m)"

    def moved(i: int) -> str:
        means = f"SELECT m, k, list(CAST(floor(CAST(s AS DOUBLE) / n) AS BIGINT) ORDER BY pos) AS x FROM (SELECT m, k, pos, sum(x[pos]) AS s, count(*) AS n FROM (SELECT m, k, x, unnest(range(1, len(x) + 1)) AS pos FROM a{i}) GROUP BY m, k, pos) GROUP BY m, k"
        return f"u{i} AS ({means}), c{i + 1} AS (SELECT m, k, coalesce(u{i}.x, c{i}.x) AS x FROM c{i} LEFT JOIN u{i} USING (m, k))"

    steps = ", ".join(f"{assigned(i)}, {moved(i)}" for i in range(rounds))
    return f"""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS x FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT vec_id, m, x[m * (len(x) // 16) + 1 : (m + 1) * (len(x) // 16)] AS x FROM (SELECT vec_id, x, unnest(range(16)) AS m FROM v)),
c0 AS (SELECT m, k, x FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM v) USING (vec_id) WHERE k < {entries}),
{steps}, {assigned(rounds)},
told AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY m, k)) AS codebooks_sha256 FROM c{rounds}),
e AS (SELECT vec_id, string_agg(lower(lpad(to_hex(k), 2, '0')), '' ORDER BY m) AS code, CAST(sum(far) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM e JOIN v USING (vec_id), told"""


OP13 = _op13()

ORACLE_SQL = {
    "op1_license_scan": OP1,
    "op4_rendezvous_shards": OP4,
    "op6_benchmark_decontamination": OP6,
    "op9_url_rules": OP9,
    "op10_ngram_jaccard_join": OP10,
    "op11_mix_sources": OP11,
    "op13_vector_codes": OP13,
}
