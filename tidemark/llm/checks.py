"""DuckDB statements for the rows of the queries that SQL can express."""

from __future__ import annotations

WHITE = r"[\x20\x09-\x0D]"

EXACT = rf"""
WITH n AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '{WHITE}', '', 'g') AS flat FROM documents
), o AS (
    SELECT doc_id, flat, count(*) OVER (PARTITION BY flat) AS group_size,
           first_value(doc_id) OVER (PARTITION BY flat ORDER BY length(text) DESC, doc_id) AS keep_id
    FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(flat) AS text_sha256 FROM o
"""

NEAR = rf"""
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                  '{WHITE}+'), lambda x: x <> '') AS words
    FROM documents
), s AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
        ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle
    FROM w
), n AS (
    SELECT w.doc_id, count(s.shingle) AS n_shingles FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id
), p AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
    FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), l AS (
    SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
    WHERE 100 * shared >= 75 * (x.n_shingles + y.n_shingles - shared)
), e AS (
    SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (
    SELECT doc_id AS node, doc_id AS reach FROM n
    UNION
    SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach WHERE e.b < r.node OR r.node IN (SELECT a FROM e)
), c AS (
    SELECT node, min(reach) AS component_id FROM r GROUP BY node
)
SELECT n.doc_id, n_shingles, component_id, n.doc_id = component_id AS kept FROM n JOIN c ON c.node = n.doc_id
"""

MIX = r"""
WITH d AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
    SELECT source, sum(size) AS total, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source
), w AS (
    SELECT source, total, CAST([3, 1, 2][place % 3 + 1] AS DOUBLE) AS weight FROM s
), r AS (
    SELECT *, 1.5 * sum(total) OVER () AS goal, 2.0 * total AS cap,
           coalesce(sum(2.0 * total) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
           sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
    FROM w WINDOW o AS (ORDER BY 2.0 * total / weight, source NULLS LAST)
), l AS (
    SELECT *, max(CASE WHEN (goal - before) / open <= cap / weight THEN (goal - before) / open END) OVER () AS level FROM r
), p AS (
    SELECT source, total, coalesce(least(cap, level * weight), cap) AS target FROM l
), q AS (
    SELECT d.doc_id, d.source, size, total, target, CASE WHEN total > 0 THEN floor(target / total) ELSE 0 END AS whole,
           size * (1 + ln(1 + size)) AS drawn, 1 + ln(1 + size) AS appeal,
           (CAST('0x' || substr(md5('7:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 AS u
    FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
), c AS (
    SELECT *, target - whole * total AS want,
           least(1 - 1e-9, greatest(1e-9, coalesce((target - whole * total) * appeal / nullif(sum(drawn) OVER (PARTITION BY source), 0), 1e-9))) AS chance
    FROM q
), k AS (
    SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY (u / (1 - u)) / (chance / (1 - chance)), doc_id
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM c
)
SELECT doc_id, size, CAST(total AS BIGINT) AS source_size, target,
       CAST(size * (whole + CASE WHEN want > 0 AND before + size / 2.0 <= want THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM k
"""


def _more(text: str, signs: str) -> str:
    """SQL for the characters that escaping adds to a text."""
    return " + ".join(f"length({text}) - length(replace({text}, {sign}, ''))" for sign in signs.split())


CHAT = f"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum(length(role) + length(text) + 8 + {_more('text', "'<' '[' chr(92)")} + {_more('role', "'<' '[' chr(92) chr(10)")}) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

#: Table of the CRC-32 (reversed polynomial EDB88320), entry 1 for byte 0.
CRC_TABLE = """(SELECT list_transform(range(256), lambda i: list_reduce(range(8),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS entry)"""


def crc32_sql(text: str) -> str:
    """SQL for the CRC-32 of a text's UTF-8 bytes; `entry` is a column with CRC_TABLE."""
    octets = f"list_transform(range(octet_length(encode({text}))), lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT))"
    return f"xor(4294967295, list_reduce({octets}, lambda c, b: xor(c >> 8, entry[(xor(c, b) & 255) + 1]), 4294967295))"


TRIE = f"""
WITH t AS (
    SELECT conv_id, text, id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) - 1 AS k
    FROM (SELECT conv_id, turn, coalesce(text, '') AS text, sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS id
          FROM conversations WHERE conv_id IS NOT NULL)
), c AS (
    SELECT conv_id, {crc32_sql('CAST(conv_id AS VARCHAR)')} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t), {CRC_TABLE}
), r AS (
    SELECT c.conv_id, k, id, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 5 WHERE k < h
    UNION ALL SELECT c.conv_id, k, id, text FROM c JOIN t ON t.conv_id = c.conv_id WHERE k >= h
), p AS (
    SELECT conv_id, row_number() OVER o AS depth, octet_length(encode(text)) AS bytes, string_agg(id, '') OVER o AS path
    FROM r WINDOW o AS (PARTITION BY conv_id ORDER BY k ROWS UNBOUNDED PRECEDING)
    UNION ALL SELECT conv_id, 0, 0, '' FROM c
), n AS (
    SELECT path, depth, max(bytes) AS bytes, min(conv_id) AS conv_id, count(*) AS n_convs FROM p GROUP BY path, depth
), e AS (
    SELECT path, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends_sha256
    FROM (SELECT conv_id, max_by(path, depth) AS path FROM p GROUP BY conv_id) GROUP BY path
), a AS (
    SELECT n.path AS below, n.depth AS d, n.n_convs, n.bytes, p.path AS above, p.depth FROM n JOIN p ON p.conv_id = n.conv_id AND p.depth <= n.depth
), k AS (
    SELECT above, count(*) AS n_children FROM a WHERE depth = d - 1 GROUP BY above
), s AS (
    SELECT above, sum((n_convs - 1) * bytes) AS saved_tokens, count(*) FILTER (WHERE below NOT IN (SELECT above FROM k)) AS n_leaves FROM a GROUP BY above
), u AS (
    SELECT a.below, n.conv_id AS parent_conv_id FROM a JOIN n ON n.path = a.above WHERE a.depth = a.d - 1
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM n JOIN s ON s.above = n.path LEFT JOIN k ON k.above = n.path LEFT JOIN u ON u.below = n.path LEFT JOIN e ON e.path = n.path
"""

def words_sql(text: str) -> str:
    lower = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


RESAMPLE = f"""
WITH d AS (
    SELECT doc_id, {words_sql('text')} AS words FROM documents
), f AS (
    SELECT doc_id, unnest(words) AS word FROM d
), g AS (
    SELECT unnest({words_sql('text')}) AS word FROM benchmark
), v AS (
    SELECT word, {crc32_sql('word')} % 10000 AS bucket FROM (SELECT word FROM f UNION SELECT word FROM g), {CRC_TABLE}
), s AS (
    SELECT bucket, count(*) AS s FROM f JOIN v USING (word) GROUP BY bucket
), t AS (
    SELECT bucket, count(*) AS t FROM g JOIN v USING (word) GROUP BY bucket
), n AS (
    SELECT (SELECT count(*) FROM f) AS all_s, (SELECT count(*) FROM g) AS all_t
), e AS (
    SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1e0) * (all_s + 10000) / ((coalesce(s, 0) + 1e0) * (all_t + 10000)))) AS BIGINT) AS gain
    FROM s FULL JOIN t USING (bucket), n
), w AS (
    SELECT doc_id, sum(gain) AS weight FROM f JOIN v USING (word) JOIN e USING (bucket) GROUP BY doc_id
), x AS (
    SELECT d.doc_id, len(words) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
           CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) AS h
    FROM d LEFT JOIN w USING (doc_id)
), y AS (
    SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5e0) / 4294967296e0))) AS BIGINT) AS score FROM x
), z AS (
    SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM y WHERE n_features >= 20
)
SELECT y.doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, rank FROM y LEFT JOIN z ON z.doc_id = y.doc_id AND rank <= 10 * n // 100
"""

CHECKS = {
    "op4_minhash_near_dedup": NEAR,
    "op7_source_mix": MIX,
    "op9_chat_format": CHAT,
    "op10_exact_dedup": EXACT,
    "op11_prefix_trie": TRIE,
    "op12_importance_resampling": RESAMPLE,
}
