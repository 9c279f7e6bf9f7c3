"""SQL for DuckDB that gives the rows of the queries, where SQL can say it."""

from askwell.llm import url_filter

OP7 = r"""
WITH docs AS (SELECT doc_id, md5(text) AS version, text, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
line AS (SELECT DISTINCT doc_id, version, unnest(lines) AS line, unnest(range(len(lines))) AS i, len(lines) AS n FROM docs),
rolled AS (SELECT *, CASE WHEN i < n - 1 THEN md5(md5(line) || md5(lead(line) OVER w)) END AS r,
  length(line) > 100 AND length(line) - length(replace(line, ' ', '')) >= 50 AS long FROM line WINDOW w AS (PARTITION BY doc_id, version ORDER BY i)),
begun AS (SELECT *, CASE WHEN i = 0 OR long OR lag(long) OVER w OR (i >= 2 AND r < lag(r) OVER w AND coalesce(r <= lead(r) OVER w, true)) THEN 1 ELSE 0 END AS b
  FROM rolled WINDOW w AS (PARTITION BY doc_id, version ORDER BY i)),
numbered AS (SELECT *, sum(b) OVER (PARTITION BY doc_id, version ORDER BY i) - 1 AS no FROM begun),
chunk AS (SELECT doc_id, version, no, string_agg(line, chr(10) ORDER BY i) AS chunk, count(*) AS n_lines,
  bool_or(long) AS long FROM numbered GROUP BY doc_id, version, no),
counted AS (SELECT *, count(*) OVER (PARTITION BY chunk) AS n, row_number() OVER (PARTITION BY chunk ORDER BY doc_id, version, no) AS place,
  (n_lines > 1 OR long) AND length(chunk) >= 32 AND regexp_matches(chunk, '[^\x20\x09-\x0D]') AS fit FROM chunk),
done AS (SELECT doc_id, version, count(*) FILTER (fit AND place > 1) AS n_removed,
  coalesce(sum(n_lines) FILTER (fit AND place > 1), 0)::BIGINT AS n_removed_lines,
  coalesce(string_agg(chunk, chr(10) ORDER BY no) FILTER (NOT (fit AND place > 1)), '') AS text FROM counted GROUP BY ALL)
SELECT d.doc_id, coalesce(n_removed, 0) AS n_removed, coalesce(n_removed_lines, 0) AS n_removed_lines,
  CASE WHEN coalesce(n_removed, 0) > 0 THEN done.text ELSE d.text END AS text
FROM documents d LEFT JOIN done ON d.doc_id = done.doc_id AND md5(d.text) = done.version
"""

OP8 = r"""
WITH RECURSIVE split AS (SELECT doc_id, [x FOR x IN string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
shingle AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 1 THEN w ELSE [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] END) AS s
  FROM split WHERE len(w) > 0),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common c JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * c.n >= 80 * (x.n + y.n - c.n)),
way AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a, b FROM way UNION SELECT r.a, way.b FROM reach r JOIN way ON r.b = way.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(size.n, 0) AS n_shingles, least(d.doc_id, coalesce(l.b, d.doc_id)) AS component_id,
  d.doc_id = least(d.doc_id, coalesce(l.b, d.doc_id)) AS kept
FROM documents d LEFT JOIN size ON size.doc_id = d.doc_id LEFT JOIN least l ON l.a = d.doc_id
"""

OP1 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, [x FOR x IN string_split_regex(t, '[\x20\x09-\x0D]+') IF x <> ''] AS ws,
  [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls FROM d),
win AS (SELECT rid, i, [ws[i], ws[i + 1], ws[i + 2]] AS v FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, v) AS n FROM win),
covered AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep WHERE n > 1) GROUP BY rid),
base AS (SELECT w.rid, doc_id, lang, source, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines, (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::BIGINT AS n_capitals
  FROM w LEFT JOIN covered c ON c.rid = w.rid),
rated AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  CASE WHEN n_words > 0 THEN 1000 * n_symbols // n_words ELSE 0 END AS symbols, CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END AS dup_lines,
  CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words ELSE 0 END AS repeats, CASE WHEN word_chars > 0 THEN 1000 * n_capitals // word_chars ELSE 0 END AS capitals,
  CASE WHEN n_words > 0 THEN 1000 * word_chars // n_words ELSE 0 END AS word_length FROM base),
long AS (SELECT lang, source, unnest(['symbols', 'dup_lines', 'repeats', 'capitals', 'word_length']) AS metric,
  unnest([symbols, dup_lines, repeats, capitals, word_length]) AS v FROM rated),
bins AS (SELECT lang, source, metric, (v >> greatest(length(bin(v)) - 7, 0)) << greatest(length(bin(v)) - 7, 0) AS edge, count(*) AS n FROM long GROUP BY ALL),
levels AS (SELECT 0 AS g, lang AS l, source AS s, metric, edge, n FROM bins
  UNION ALL SELECT 1, lang, NULL, metric, edge, n FROM bins UNION ALL SELECT 2, NULL, NULL, metric, edge, n FROM bins),
merged AS (SELECT g, l, s, metric, edge, sum(n)::BIGINT AS n FROM levels GROUP BY ALL),
running AS (SELECT *, sum(n) OVER (PARTITION BY g, l, s, metric ORDER BY edge) AS seen, sum(n) OVER (PARTITION BY g, l, s, metric) AS total FROM merged),
cut AS (SELECT g, l, s, metric, min(edge) FILTER (2 * seen >= total) AS half, min(edge) FILTER (4 * seen >= 3 * total) AS most
  FROM running WHERE total >= 100 GROUP BY ALL),
limits AS (SELECT g, l, s, metric, greatest(CASE metric WHEN 'symbols' THEN 100 WHEN 'dup_lines' THEN 500 WHEN 'repeats' THEN 400 WHEN 'capitals' THEN 200 ELSE 9000 END,
  most + 6 * (most - half)) AS cutoff FROM cut),
chosen AS (SELECT rid, x.metric, x.v, x.place, coalesce(a.cutoff, b.cutoff, c.cutoff,
    CASE x.metric WHEN 'symbols' THEN 100 WHEN 'dup_lines' THEN 500 WHEN 'repeats' THEN 400 WHEN 'capitals' THEN 200 ELSE 9000 END) AS cutoff
  FROM (SELECT rid, lang, source, unnest(['symbols', 'dup_lines', 'repeats', 'capitals', 'word_length']) AS metric,
    unnest([symbols, dup_lines, repeats, capitals, word_length]) AS v, unnest([1, 2, 3, 4, 5]) AS place FROM rated) x
  LEFT JOIN limits a ON a.g = 0 AND a.metric = x.metric AND a.l IS NOT DISTINCT FROM x.lang AND a.s IS NOT DISTINCT FROM x.source
  LEFT JOIN limits b ON b.g = 1 AND b.metric = x.metric AND b.l IS NOT DISTINCT FROM x.lang
  LEFT JOIN limits c ON c.g = 2 AND c.metric = x.metric),
broken AS (SELECT rid, arg_min(metric, place) AS rule FROM chosen WHERE v > cutoff GROUP BY rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rule IS NULL AS kept, rule
FROM rated LEFT JOIN broken ON broken.rid = rated.rid
"""

_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]*)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"

OP10 = rf"""
WITH p AS (SELECT page_id, url, html, 1700000000 + (page_id * 7919) % 1000000 AS t, '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' AS tag FROM pages),
rec AS (
  SELECT page_id * 4 AS record_id, url, t AS ts, 200 AS status, CASE WHEN page_id % 5 <> 0 THEN tag END AS etag, 't' || page_id AS lm,
    [['content-length', length(html)::VARCHAR], ['content-type', 'text/html'], ['date', 't' || t],
     CASE WHEN page_id % 5 <> 0 THEN ['etag', tag] ELSE ['x-age', tag] END, ['last-modified', 't' || page_id]] AS h FROM p
  UNION ALL SELECT page_id * 4 + 1, regexp_replace(url, '^http', 'HTTP') || CASE WHEN contains(url, '#') THEN '' ELSE '#later' END, t + 1 + page_id % 50000, 304,
    CASE WHEN page_id % 7 = 0 THEN '"x' || tag ELSE tag END, 't' || page_id,
    [['content-length', '0'], ['date', 't' || (t + 9)], ['cache-control', 'max-age=60'], ['etag', CASE WHEN page_id % 7 = 0 THEN '"x' || tag ELSE 'W/' || tag END],
     ['last-modified', 't' || page_id]] FROM p
  UNION ALL SELECT page_id * 4 + 2, url, t - 500, 304, NULL, NULL, [['date', 't' || t], ['server', 's' || (page_id % 3)]] FROM p
  UNION ALL SELECT page_id * 4 + 3, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/', t, CASE WHEN page_id % 10 = 0 THEN 200 ELSE 304 END, NULL, NULL,
    [['date', 't' || t], ['server', 's' || (page_id % 3)]] FROM p),
cut AS (SELECT *, lower(regexp_extract(trim(url), '{_URL}', 1)) AS scheme, regexp_replace(lower(regexp_extract(trim(url), '{_URL}', 2)), '^www[0-9]*\.', '') AS host,
  regexp_extract(trim(url), '{_URL}', 3) AS port, regexp_replace(regexp_extract(trim(url), '{_URL}', 4), '/+$', '') AS path,
  list_aggregate(list_sort(string_split(regexp_extract(trim(url), '{_URL}', 5), '&')), 'string_agg', '&') AS q FROM rec),
keyed AS (SELECT *, host || CASE WHEN port = '' OR (scheme = 'http' AND port = '80') OR (scheme = 'https' AND port = '443') THEN '' ELSE ':' || port END
  || path || '/' || CASE WHEN q = '' THEN '' ELSE '?' || q END AS url_key FROM cut),
found AS (SELECT *, last_value(CASE WHEN status = 200 THEN record_id END IGNORE NULLS) OVER (PARTITION BY url_key
  ORDER BY ts, CASE WHEN status = 200 THEN 1 ELSE 0 END, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS refers_to FROM keyed),
judged AS (SELECT f.record_id, f.url_key, f.refers_to, f.h, o.h AS oh, CASE WHEN f.refers_to IS NULL THEN 'missing'
  WHEN f.etag IS NOT NULL AND o.etag IS NOT NULL THEN CASE WHEN f.etag = o.etag THEN 'resolved' ELSE 'mismatch' END
  WHEN f.lm IS NOT NULL AND o.lm IS NOT NULL THEN CASE WHEN f.lm = o.lm THEN 'resolved' ELSE 'mismatch' END ELSE 'unchecked' END AS outcome
  FROM found f LEFT JOIN rec o ON o.record_id = f.refers_to WHERE f.status = 304),
entries AS (SELECT record_id, e, 1 AS fresh FROM (SELECT record_id, unnest(h) AS e FROM judged) WHERE e[1] NOT IN ('content-length', 'content-type')
  UNION ALL SELECT record_id, e, 0 FROM (SELECT record_id, unnest(oh) AS e FROM judged)),
chosen AS (SELECT record_id, e[1] AS k, arg_max(e[2], fresh) AS v FROM entries GROUP BY ALL),
merged AS (SELECT record_id, string_agg(k || ': ' || v, chr(10) ORDER BY k) AS headers FROM chosen GROUP BY record_id)
SELECT j.record_id, url_key, refers_to, outcome, CASE WHEN outcome IN ('resolved', 'unchecked') THEN headers END AS headers
FROM judged j LEFT JOIN merged m ON m.record_id = j.record_id
"""

#: Bit by bit, the checksum that says how many turns a conversation takes over from the first of its family.
CRC32 = """xor(list_reduce([4294967295]::BIGINT[] || flatten(list_transform(string_split({0}, ''),
        lambda ch: list_transform(range(8), lambda i: (ascii(ch)::BIGINT >> i) & 1))),
        lambda a, b: xor(a >> 1, (xor(a, b) & 1) * 3988292384)), 4294967295)"""

OP11 = f"""
WITH turns AS (
    SELECT conv_id AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS t,
           sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest
    FROM conversations WHERE conv_id IS NOT NULL),
placed AS (
    SELECT c, digest, strlen(t) AS bytes, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, r, digest) - 1 AS p
    FROM turns),
convs AS (SELECT c, {CRC32.format("c::VARCHAR")} % 9 AS h FROM (SELECT DISTINCT c FROM placed)),
both_parts AS (
    SELECT v.c, 0 AS part, q.p, q.digest, q.bytes FROM convs v JOIN placed q ON q.c = v.c - v.c % 5 AND q.p < v.h
    UNION ALL
    SELECT v.c, 1, q.p, q.digest, q.bytes FROM convs v JOIN placed q ON q.c = v.c AND q.p >= v.h),
rebuilt AS (SELECT c, digest, bytes, row_number() OVER (PARTITION BY c ORDER BY part, p) AS d FROM both_parts),
below AS (
    SELECT c, d, bytes, sha256(list_aggregate(list(digest) OVER (PARTITION BY c ORDER BY d), 'string_agg', ',')) AS k FROM rebuilt
    UNION ALL SELECT c, 0, 0, 'root' FROM convs),
members AS (
    SELECT *, lag(k) OVER (PARTITION BY c ORDER BY d) AS pk, max(d) OVER (PARTITION BY c) AS len FROM below),
nodes AS (
    SELECT k, d, min(pk) AS pk, min(c) AS c, count(*) AS n, max(bytes) AS bytes, (max(len) = d)::INT AS leaf,
           sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len = d), '')) AS ends
    FROM members GROUP BY k, d),
totals AS (
    SELECT m.k, sum(w.leaf) AS leaves, sum((w.n - 1) * w.bytes) AS saved
    FROM members m JOIN nodes w ON w.c = m.c AND w.d >= m.d GROUP BY m.k),
kids AS (SELECT pk, count(*) AS n FROM nodes WHERE pk IS NOT NULL GROUP BY pk)
SELECT v.c AS conv_id, v.d AS depth, u.c AS parent_conv_id, v.n::BIGINT AS n_convs, coalesce(g.n, 0)::BIGINT AS n_children,
       t.leaves::BIGINT AS n_leaves, t.saved::BIGINT AS saved_tokens, v.ends AS ends_sha256
FROM nodes v JOIN totals t ON t.k = v.k LEFT JOIN nodes u ON u.k = v.pk LEFT JOIN kids g ON g.pk = v.k
"""

#: The strength of a prior from units with n pages, bad ones and a prior mean.
STRENGTH = """SELECT coalesce(1 / least(greatest(sum(pow(bad - n * prior, 2) - n * prior * (1 - prior))
    / nullif(sum((n - 1) * n * prior * (1 - prior)), 0), 1 / 1001.0::DOUBLE), 1 / 2.0::DOUBLE) - 1, 1000) AS k FROM {0}"""
NAME = r"regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*\z', '')"
SECOND_LEVEL = "('" + "', '".join(url_filter.SECOND_LEVEL) + "')"

OP13 = rf"""
WITH rest AS (
    SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS x FROM pages),
urls AS (
    SELECT page_id, translate(regexp_extract(x, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(x, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
told AS (
    SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels
    WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY doc_id),
seen AS (
    SELECT host, count(*) AS n, sum(bad) AS bad
    FROM urls JOIN told ON told.doc_id = TRY_CAST(regexp_extract(path, '/([0-9]{{1,18}})(?:\.html)?/?\z', 1) AS BIGINT) GROUP BY host),
named AS (SELECT DISTINCT host, {NAME} AS name FROM urls),
split AS (
    SELECT host, name, regexp_extract(name, '([^.]+)\.?\z', 1) AS one, regexp_extract(name, '([^.]+\.[^.]+)\.?\z', 1) AS two,
           regexp_extract(name, '([^.]+\.[^.]+\.[^.]+)\.?\z', 1) AS three, regexp_matches(name, '^[0-9.]+\z|^\[') AS address FROM named),
hosts AS (
    SELECT s.host, coalesce(n, 0) AS n, coalesce(bad, 0) AS bad,
           CASE WHEN address OR two = '' THEN name WHEN two IN {SECOND_LEVEL} AND three <> '' THEN three ELSE two END AS domain,
           CASE WHEN address OR one = '' THEN name WHEN two IN {SECOND_LEVEL} THEN two ELSE one END AS suffix
    FROM split s LEFT JOIN seen ON seen.host = s.host),
total AS (SELECT (sum(bad) + 1) / (sum(n) + 2)::DOUBLE AS prior FROM hosts),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(total.prior) AS prior FROM hosts, total GROUP BY suffix),
sk AS ({STRENGTH.format("s")}),
sp AS (SELECT suffix, (k * prior + bad) / (k + n) AS prior FROM s, sk),
d AS (SELECT domain, sum(n) AS n, sum(bad) AS bad, any_value(sp.prior) AS prior FROM hosts JOIN sp USING (suffix) GROUP BY domain),
dk AS ({STRENGTH.format("d")}),
dp AS (SELECT domain, (k * prior + bad) / (k + n) AS prior FROM d, dk),
h AS (SELECT host, n, bad, prior FROM hosts JOIN dp USING (domain)),
hk AS ({STRENGTH.format("h")}),
hp AS (SELECT host, n, k, (k * prior + bad) / (k + n) AS mean FROM h, hk),
known AS (SELECT host, n, mean - 1.645::DOUBLE * sqrt(mean * (1 - mean) / (k + n + 1)) AS bound FROM hp),
rules AS (SELECT * FROM (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) r (action, rh, rp)),
fits AS (
    SELECT host, path, arg_max(action, length(rh || rp)) AS action, arg_max(rh || rp, length(rh || rp)) AS rule
    FROM (SELECT DISTINCT host, path FROM urls) u JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
    GROUP BY host, path)
SELECT page_id, u.host, u.path, rule, coalesce(action, CASE WHEN bound > 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
       n::BIGINT AS n_labels, round(bound, 6) AS bad_bound
FROM urls u JOIN known ON known.host = u.host LEFT JOIN fits ON fits.host = u.host AND fits.path = u.path
"""
