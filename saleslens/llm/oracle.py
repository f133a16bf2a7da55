"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

# For pages that mark their content: the blocks of the article, references decoded
# (those that the tables hold, with or without a semicolon; the ampersand last).
OP1 = r"""
WITH parts AS (
    SELECT row_number() OVER () AS rid, page_id, url,
           string_split_regex(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '</?(?:p|h1)>') AS blocks
    FROM pages
), texts AS (
    SELECT rid, i, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
               regexp_replace(replace(blocks[i], '<br>', ' '), '<[^>]*>', '', 'g'),
               '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS t
    FROM (SELECT rid, blocks, unnest(range(1, len(blocks) + 1)) AS i FROM parts)
), joined AS (
    SELECT rid, string_agg(t, chr(10) || chr(10) ORDER BY i) AS body FROM texts WHERE t <> '' GROUP BY rid
)
SELECT page_id, url, coalesce(body, '') AS text, length(coalesce(body, '')) AS n_chars
FROM parts LEFT JOIN joined USING (rid)
"""

OP2 = """
WITH parts AS (
    SELECT page_id,
           CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS tail
    FROM pages
), seen AS (
    SELECT page_id,
           translate(regexp_extract(tail, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) AS path
    FROM parts
), listed(rule_host, rule_path, rule, verdict) AS (
    VALUES ('net', '/', 'net/', 'block'), ('example.net', '/en/', 'example.net/en/', 'allow'),
           ('example.com', '/de/', 'example.com/de/', 'block'), ('org', '/fr/', 'org/fr/', 'allow')
)
SELECT page_id, host, path,
       (SELECT arg_max(rule, length(rule)) FROM listed
        WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)) AS rule,
       coalesce((SELECT arg_max(verdict, length(rule)) FROM listed
        WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)), 'allow') AS verdict
FROM seen
"""

OP4 = r"""
WITH item_words AS (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
), windows AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS body
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item_words WHERE len(w) > 0)
), doc_words AS (
    SELECT row_number() OVER () AS rid, doc_id,
           coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
    FROM documents
), sizes AS (
    SELECT DISTINCT n FROM windows
), doc_windows AS (
    SELECT rid, n, i, array_to_string(w[i : i + n - 1], ' ') AS body
    FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc_words, sizes WHERE len(w) >= n)
), found AS (
    SELECT rid, n, i, item_id FROM doc_windows JOIN windows USING (n, body)
), hit AS (
    SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM found) GROUP BY rid
), named AS (
    SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
    FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hit USING (rid) LEFT JOIN named USING (rid)
"""

# Windows of 50 bytes are windows of 100 hex digits.
OP9 = """
WITH docs AS (
    SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS body,
           octet_length(encode(coalesce(text, ''))) AS n
    FROM documents
), starts AS (
    SELECT rid, doc_id, p, substr(body, 2 * p + 1, 100) AS piece
    FROM (SELECT rid, doc_id, body, unnest(range(0, n - 49)) AS p FROM docs WHERE n >= 50)
), owners AS (
    SELECT piece, min(doc_id) AS owner FROM starts GROUP BY piece
), late AS (
    SELECT rid, p FROM starts JOIN owners USING (piece) WHERE owner < doc_id
), marked AS (
    SELECT rid, p, CASE WHEN p <= lag(p) OVER (PARTITION BY rid ORDER BY p) + 50 THEN 0 ELSE 1 END AS opens FROM late
), numbered AS (
    SELECT rid, p, sum(opens) OVER (PARTITION BY rid ORDER BY p) AS run FROM marked
), spans AS (
    SELECT rid, run, min(p) AS a, max(p) + 50 AS b FROM numbered GROUP BY rid, run
), gaps AS (
    SELECT rid, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS a, a AS b FROM spans
    UNION ALL
    SELECT rid, max(b), any_value(n) FROM spans JOIN docs USING (rid) GROUP BY rid
), rest AS (
    SELECT rid, string_agg(substr(body, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS kept
    FROM gaps JOIN docs USING (rid) GROUP BY rid
), counts AS (
    SELECT rid, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY rid
)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, body))) AS kept_sha256
FROM docs LEFT JOIN counts USING (rid) LEFT JOIN rest USING (rid)
"""

# Base32 of a SHA-1: its 160 bits, five at a time. DuckDB has SHA-1 in hex only.
OP11 = """
WITH rows AS (
    SELECT page_id, coalesce(html, '') AS payload FROM pages
), digests AS (
    SELECT page_id, payload, octet_length(encode(payload)) AS payload_bytes, sha1(payload) AS x FROM rows
), named AS (
    SELECT *, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               CAST((CAST('0x' || substr(x, 5 * (k // 4) + 1, 5) AS BIGINT) >> (5 * (3 - k % 4))) & 31 AS INT) + 1, 1)
               FOR k IN range(32)], '') AS payload_digest,
           row_number() OVER (PARTITION BY payload ORDER BY page_id DESC NULLS LAST) AS place,
           first_value(page_id) OVER (PARTITION BY payload ORDER BY page_id DESC NULLS LAST) AS top
    FROM digests
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN place > 1 THEN top END AS refers_to
FROM named
"""

OP12 = r"""
WITH words AS (
    SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS w
    FROM (SELECT coalesce(lang, 'und') AS lang,
                 unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[.,;:!?\x0A-\x0D]')) AS piece
          FROM documents)
), runs AS (
    SELECT lang, s, array_to_string(w[i : i + s - 1], ' ') AS phrase, count(*) AS f
    FROM (SELECT lang, w, s, unnest(range(1, len(w) - s + 2)) AS i FROM words, range(1, 4) AS sizes(s) WHERE len(w) >= s)
    GROUP BY ALL
), candidates AS (
    SELECT lang, s, phrase, f AS a, string_split(phrase, ' ') AS w FROM runs WHERE s >= 2 AND f >= 10
), longer AS (
    SELECT lang, array_to_string(w[i : i + 1], ' ') AS phrase, max(a) AS most
    FROM (SELECT lang, w, a, unnest([1, 2]) AS i FROM candidates WHERE s = 3) GROUP BY ALL
), shown AS (
    SELECT c.* FROM candidates c LEFT JOIN longer o ON s = 2 AND o.lang = c.lang AND o.phrase = c.phrase
    WHERE most IS NULL OR 100 * most < 50 * a
), cuts AS (
    SELECT lang, phrase, a, k, array_to_string(w[1 : k], ' ') AS lp, array_to_string(w[k + 1 :], ' ') AS rp
    FROM (SELECT *, unnest(range(1, s)) AS k FROM shown)
), scored AS (
    SELECT c.lang, c.phrase, a, k, x.f AS l, y.f AS r,
           CAST((1000000 * CAST(a AS HUGEINT) * a) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
    FROM cuts c JOIN runs x ON x.lang = c.lang AND x.phrase = lp JOIN runs y ON y.lang = c.lang AND y.phrase = rp
), best AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best
)
SELECT lang, rank, phrase, a, l, r, n, score
FROM ranked JOIN (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM runs WHERE s = 1 GROUP BY lang) USING (lang) WHERE rank <= 2000
"""

# crc32 by its table of 256 remainders; near words by equal texts with a code point taken out.
OP13 = """
WITH RECURSIVE remainders AS (
    SELECT list(v ORDER BY b) AS t FROM (
        SELECT b, list_reduce([b] || [CAST(k AS BIGINT) FOR k IN range(8)],
                              lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
        FROM (SELECT unnest(range(256)) AS b)
    )
), runs AS (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
           unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[A-Za-zÀ-ÿ]+')) AS run
    FROM documents
), counted AS (
    SELECT run, hex(encode(id || ':' || run)) AS x, count(*) AS n FROM runs GROUP BY run, id
), hashed AS (
    SELECT run, n, xor(4294967295, list_reduce(
               [4294967295] || [CAST('0x' || substr(x, 2 * k + 1, 2) AS BIGINT) FOR k IN range(len(x) // 2)],
               lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h
    FROM counted, remainders
), damaged AS (
    SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n
    FROM hashed
), words AS (
    SELECT word, CAST(sum(n) AS BIGINT) AS n FROM damaged WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), cuts AS (
    SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b
    FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), shorter AS (
    SELECT DISTINCT c.word AS l, c.n AS ln, w.word AS s, w.n AS sn FROM cuts c JOIN words w ON w.word = c.a || c.b
), near AS (
    SELECT x.word, y.word AS other, y.n AS m FROM cuts x JOIN cuts y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
    UNION ALL SELECT l, s, sn FROM shorter
    UNION ALL SELECT s, l, ln FROM shorter
), best AS (
    SELECT word, count(*) AS n_near, max(m) AS m FROM near GROUP BY word
), forms AS (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * w.n THEN m END AS form_n,
           CASE WHEN m >= 2 * w.n THEN (SELECT min(other) FROM near WHERE near.word = w.word AND near.m = best.m) END AS form
    FROM words w LEFT JOIN best USING (word)
), steps AS (
    SELECT word, word AS root, form AS next FROM forms
    UNION ALL
    SELECT s.word, f.word, f.form FROM steps s JOIN forms f ON f.word = s.next
)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN (SELECT word, root FROM steps WHERE next IS NULL) USING (word)
"""


def oracle_queries() -> dict[str, str]:
    return {
        "op1_html_text": OP1,
        "op2_url_filter": OP2,
        "op4_decontamination": OP4,
        "op9_suffix_array": OP9,
        "op11_warc": OP11,
        "op12_phrases": OP12,
        "op13_spelling": OP13,
    }
