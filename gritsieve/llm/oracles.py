"""DuckDB SQL for the registered queries that SQL can express, over the same tables."""

WORD = r"[^\x20\x09-\x0D]"

SUFFIX_DEDUP = """
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS i FROM d WHERE len(h) >= 100),
g AS MATERIALIZED (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 100)) AS k FROM p),
bad AS (SELECT doc_id, i FROM g JOIN (SELECT k, min(doc_id) AS least FROM g GROUP BY k) USING (k) WHERE least < doc_id),
steps AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM bad),
runs AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM steps),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM runs GROUP BY doc_id, run),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS c FROM spans),
cut AS (SELECT doc_id, string_agg(substr(h, 2 * c + 1, 2 * (a - c)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept, sum(b - a) AS n, count(*) AS m FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(m, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN cut USING (doc_id)"""

MINHASH_DEDUP = rf"""
WITH RECURSIVE t AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS g FROM t),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(id, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON r.seen = e.a),
o AS (SELECT id, min(seen) AS component_id FROM r GROUP BY id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM documents JOIN o ON o.id = doc_id LEFT JOIN n USING (doc_id)"""


def _fences(name: str, keys: str) -> str:
    by = f"{keys}, m" if keys else "m"
    width = "pow(2, greatest(length(bin(q3)) - 6, 0))::BIGINT"
    return f"""{name}_r AS (SELECT {by}, b, sum(sum(n)) OVER (PARTITION BY {by} ORDER BY b) AS upto, sum(sum(n)) OVER (PARTITION BY {by}) AS total FROM sk GROUP BY {by}, b),
{name}_q AS (SELECT {by}, min(b) FILTER (upto * 4 >= total) AS q1, min(b) FILTER (upto * 4 >= total * 3) AS q3, max(total) AS total FROM {name}_r GROUP BY {by}),
{name} AS (SELECT {by}, total, q3 + greatest(3 * (q3 - q1), {width}) AS fence FROM {name}_q)"""


QUALITY_RULES = rf"""
WITH t AS MATERIALIZED (SELECT doc_id, lang, source, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '{WORD}+') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda y: regexp_matches(y, '{WORD}')) AS l FROM documents),
k AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, w FROM t WHERE len(w) >= 8),
a AS (SELECT doc_id, i FROM (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM k) QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, sum(step)::BIGINT AS n FROM (SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS step FROM a) GROUP BY doc_id),
f AS MATERIALIZED (SELECT t.doc_id, lang, source, len(w)::BIGINT AS n_words, length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars, (length(x) - length(translate(x, '#*$%&|<>', '')))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines, (length(x) - length(regexp_replace(x, '\p{{Lu}}', '', 'g')))::BIGINT AS capitals FROM t LEFT JOIN rep USING (doc_id)),
z AS MATERIALIZED (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  coalesce(floor(greatest(0.0, n_symbols - 2 * sqrt(n_symbols)) * 1000 / nullif(n_words, 0)), 0)::BIGINT AS m_symbols,
  coalesce(floor(greatest(0.0, n_dup_lines - 2 * sqrt(n_dup_lines)) * 1000 / nullif(n_lines, 0)), 0)::BIGINT AS m_dup_lines,
  coalesce(floor(8 * greatest(0.0, n_repeat_words / 8 - 2 * sqrt(n_repeat_words / 8)) * 1000 / nullif(n_words, 0)), 0)::BIGINT AS m_repeats,
  coalesce(floor(capitals * 1000 / nullif(word_chars, 0)), 0)::BIGINT AS m_capitals,
  coalesce(floor(word_chars * 1000 / nullif(n_words, 0)), 0)::BIGINT AS m_word_chars FROM f),
v AS MATERIALIZED (UNPIVOT (SELECT doc_id, lang, source, base_failed, m_symbols, m_dup_lines, m_repeats, m_capitals, m_word_chars FROM z) ON m_symbols, m_dup_lines, m_repeats, m_capitals, m_word_chars INTO NAME m VALUE value),
sk AS MATERIALIZED (SELECT lang, source, m, value // pow(2, greatest(length(bin(value)) - 6, 0))::BIGINT * pow(2, greatest(length(bin(value)) - 6, 0))::BIGINT AS b, count(*) AS n FROM v WHERE NOT base_failed GROUP BY ALL),
{_fences("own", "lang, source")},
{_fences("wide", "lang")},
{_fences("every", "")},
lim AS (SELECT own.lang, own.source, own.m, CASE WHEN own.total >= 200 THEN own.fence WHEN wide.total >= 200 THEN wide.fence ELSE every.fence END AS fence FROM own JOIN wide ON own.lang IS NOT DISTINCT FROM wide.lang AND own.m = wide.m JOIN every ON every.m = own.m),
b AS (SELECT doc_id, bool_or(coalesce(value > fence, false)) AS beyond FROM v LEFT JOIN lim ON v.lang IS NOT DISTINCT FROM lim.lang AND v.source IS NOT DISTINCT FROM lim.source AND v.m = lim.m GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT beyond AS kept, m_symbols, m_dup_lines, m_repeats, m_capitals, m_word_chars FROM z JOIN b USING (doc_id)"""

LINE_DEDUP = rf"""
WITH RECURSIVE x AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
y AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, l FROM x),
q AS (SELECT doc_id, i, regexp_replace(regexp_replace(l[i], '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS line FROM y WHERE regexp_matches(l[i], '{WORD}')),
o AS MATERIALIZED (SELECT doc_id, min(i - 1) AS place, line FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i, line FROM q) GROUP BY doc_id, line),
u AS MATERIALIZED (SELECT line, strlen(line) AS n, min(doc_id) AS first, count(*) AS places FROM o GROUP BY line),
e AS MATERIALIZED (SELECT a.line AS a, b.line AS b FROM u a JOIN u b ON b.n BETWEEN a.n AND a.n + 2 AND a.line <> b.line AND (b.n > a.n OR a.line < b.line) AND a.n >= 20 AND b.n - a.n <= least(2, a.n // 20)
  WHERE levenshtein(a.line, b.line) <= least(2, a.n // 20)),
w AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(line, seen) AS (SELECT DISTINCT a, a FROM w UNION SELECT r.line, w.b FROM r JOIN w ON r.seen = w.a),
c AS (SELECT line, min(seen) AS class FROM r GROUP BY line),
v AS MATERIALIZED (SELECT u.line, coalesce(class, u.line) AS class, first, places, coalesce(k.n, 0) AS n_links FROM u LEFT JOIN c USING (line) LEFT JOIN (SELECT a AS line, count(*) AS n FROM w GROUP BY a) k ON k.line = u.line),
g AS (SELECT class, min(first) AS first_doc, sum(places)::BIGINT AS n_places FROM v GROUP BY class),
f AS (SELECT class, min(place) AS own FROM o JOIN v USING (line) JOIN g USING (class) WHERE doc_id = first_doc GROUP BY class)
SELECT doc_id, place AS line_no, n_links, n_places, first_doc, doc_id = first_doc AND place = own AS kept FROM o JOIN v USING (line) JOIN g USING (class) JOIN f USING (class)"""

#: CRC-32 of a text given as hex digits: its table of 256 values by rule, then a byte at a time.
_CRC_TABLE = "crc_table AS MATERIALIZED (SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, n) ORDER BY n) AS t FROM range(256) x(n))"


def _crc(hexed: str) -> str:
    return f"xor(list_reduce(list_transform(regexp_extract_all({hexed}, '..'), lambda x: ('0x' || x)::BIGINT), lambda c, b: xor(c // 256, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295)"


SHARDING = f"""
WITH {_CRC_TABLE},
r AS MATERIALIZED (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size, md5(coalesce(text, '')) AS h, {_crc("hex(encode(coalesce(text, '')))")} AS text_crc32 FROM documents, crc_table),
p AS MATERIALIZED (SELECT *, sum(size) OVER (ORDER BY h, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING)::BIGINT AS e, sum(size) OVER ()::BIGINT AS total, max(size) OVER () AS most,
  min(doc_id) OVER (PARTITION BY h) AS o FROM r),
g AS (SELECT *, min(e - size) OVER (PARTITION BY h) AS a, max(e) OVER (PARTITION BY h) AS b FROM p),
s AS (SELECT *, least(23, floor(CASE WHEN b - a <= most THEN (a + b) // 2 ELSE e - size // 2 END * 24 / total))::INTEGER AS shard FROM g)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY e) - 1)::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM s"""


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE octet_length(encode(({value})::VARCHAR)) || ':' || ({value})::VARCHAR END"


_LEAF = "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"


def _tree(name: str, leaves: str) -> str:
    """CTEs of all nodes (l: level, s: tree, i: number, n: nodes of the level, d: digest), and of what stands on either side of each."""
    return f"""{name}(l, s, i, n, d) AS (SELECT 0, s, row_number() OVER (PARTITION BY s ORDER BY k) - 1, count(*) OVER (PARTITION BY s), d FROM {leaves}
  UNION ALL SELECT l + 1, s, i // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY l, s, i // 3, n),
{name}_side AS MATERIALIZED (SELECT l, s, i, n, substr(run, 1, 64 * (i % 3)) AS a, substr(run, 64 * (i % 3) + 65) AS b FROM (SELECT *, string_agg(d, '' ORDER BY i) OVER (PARTITION BY l, s, i // 3 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS run FROM {name}) WHERE n > 1)"""


def _walk(name: str, starts: str, tree: str) -> str:
    """CTE of the leaves' way up: the digest folded so far, and the siblings passed."""
    return f"""{name}(doc_id, s, i, l, cur, proof) AS (SELECT doc_id, s, i, 0, cur, proof FROM {starts}
  UNION ALL SELECT doc_id, w.s, w.i // 3, w.l + 1, sha256(a || cur || b), proof || a || b FROM {name} w JOIN {tree}_side x ON x.s = w.s AND x.l = w.l AND x.i = w.i)"""


MERKLE = f"""
WITH RECURSIVE {_CRC_TABLE},
f AS MATERIALIZED (SELECT doc_id, coalesce('=' || source, '-') AS s, {_LEAF.format(text="text")} AS leaf, {_LEAF.format(text="replace(text, chr(10), '')")} AS other, {_crc("hex(encode(doc_id::VARCHAR))")} % 2 = 0 AS bad FROM documents, crc_table),
lv AS (SELECT s, doc_id AS k, leaf AS d FROM f),
{_tree("t", "lv")},
tops AS MATERIALIZED (SELECT s, d FROM t WHERE n = 1),
tl AS (SELECT '' AS s, s AS k, d FROM tops),
{_tree("u", "tl")},
start AS (SELECT doc_id, s, row_number() OVER (PARTITION BY s ORDER BY doc_id) - 1 AS i, CASE WHEN bad THEN other ELSE leaf END AS cur, '' AS proof FROM f),
{_walk("w", "start", "t")},
mid AS (SELECT doc_id, '' AS s, k.i AS i, cur, proof FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY l DESC) AS last FROM w) JOIN (SELECT s AS name, row_number() OVER (ORDER BY s) - 1 AS i FROM tops) k ON k.name = s WHERE last = 1),
{_walk("v", "mid", "u")},
ends AS (SELECT doc_id, cur, proof FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY l DESC) AS last FROM v) WHERE last = 1)
SELECT doc_id, leaf, tops.d AS subroot, r.d AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = r.d AS verified FROM f JOIN ends USING (doc_id) JOIN tops USING (s), (SELECT d FROM u WHERE n = 1) r"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS x FROM pages),
q AS (SELECT page_id, octet_length(encode(x)) AS n, sha1(x) AS d, max(page_id) OVER (PARTITION BY x) AS latest FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN n >= 1000 AND page_id < latest THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 1000 AND page_id < latest THEN latest END AS refers_to FROM q"""
