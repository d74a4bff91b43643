"""DuckDB SQL for the queries that SQL can express.

The others have none: components of a similarity graph over all pairs (op1), splitters and random draws that hang on a hash
function (op4, op9), a trained labeller (op5), windows of characters (op6) and a trained tree (op7). Tests compare these
with brute force, round trips or held-out accuracy.
"""

from __future__ import annotations

from plumbline.llm.quality import CURRENT, POLICIES, RULES

SPACES = r"[\x20\x09-\x0D]+"


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({text}, ''), '{SPACES}'), lambda x: x <> '')"


def _lower(text: str) -> str:
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _shingles(table: str, key: str) -> str:
    return f"""SELECT DISTINCT {key}, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [w] ELSE [w[i:i + 4] FOR i IN range(1, len(w) - 3)] END) AS g
  FROM (SELECT {key}, {_words(_lower("text"))} AS w FROM {table})"""


DECONTAMINATE = f"""WITH d AS ({_shingles("documents", "doc_id")}), i AS ({_shingles("benchmark", "item_id")}),
n AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS n_shared, any_value(n_item) AS n_item FROM i JOIN d USING (g) JOIN n USING (item_id)
GROUP BY doc_id, item_id HAVING 100 * count(*) >= 75 * any_value(n_item)"""

CHAT = r"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
l AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before, role = 'assistant' AS loss FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN loss THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN loss THEN text ELSE '' END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(length(regexp_replace(text, '[\\<#]', '\0\\', 'g'))
    + CASE WHEN before = role THEN 7 ELSE 14 + length(regexp_replace(role, '[\\<#:]', '\0\\', 'g')) END) AS BIGINT) AS formatted_chars
FROM l GROUP BY conv_id"""

WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT page_id, h, octet_length(encode(h)) AS n, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, n AS payload_bytes, sha256(h) AS payload_digest,
  CASE WHEN n >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND first <> page_id THEN first END AS refers_to FROM f"""


def _quality() -> str:
    bits = " + ".join(f"CASE WHEN {condition} THEN {1 << bit} ELSE 0 END" for bit, condition in enumerate(RULES.values()))
    return f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS x, {_words("text")} AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda y: regexp_matches(y, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
g AS (SELECT doc_id, i, w[i:i + 4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM t WHERE len(w) >= 5)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM r) GROUP BY doc_id),
m AS (SELECT t.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
  length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) AS n_symbols, length(regexp_replace(x, '[^A-Z]', '', 'g')) AS n_upper,
  length(regexp_replace(x, '[^A-Za-z]', '', 'g')) AS n_letters, len(lines) AS n_lines,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM t LEFT JOIN c USING (doc_id)),
f AS (SELECT *, CAST({bits} AS BIGINT) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed, failed & {POLICIES[CURRENT].mask} = 0 AS kept, failed FROM f"""


HARD_NEGATIVES = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
    CAST(coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN (SELECT * FROM s WHERE NOT same) USING (anchor_id)
WHERE 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 3"""

# crc32 bit by bit: 3988292384 is the reversed polynomial.
TRIE = f"""WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS r FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS n, xor(4294967295::UBIGINT, list_reduce(
    list_prepend(4294967295::UBIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)::UBIGINT[]), lambda x, i: xor(x >> 1, (x & 1) * 3988292384::UBIGINT)))) % 4 AS h
  FROM t GROUP BY conv_id),
g AS (SELECT c.conv_id, c.h, c.n, c.conv_id - c.conv_id % 20 AS lender, least(c.h, coalesce(l.n, 0)) AS given
  FROM c LEFT JOIN c l ON l.conv_id = c.conv_id - c.conv_id % 20),
b AS (SELECT g.conv_id, r AS pos, role, text FROM g JOIN t ON t.conv_id = g.lender AND r <= g.h
  UNION ALL SELECT conv_id, r - h + given, role, text FROM g JOIN t USING (conv_id) WHERE r > h),
s AS (SELECT g.conv_id, coalesce(list(struct_pack(role := role, text := text) ORDER BY pos) FILTER (pos IS NOT NULL), []) AS path
  FROM g LEFT JOIN b USING (conv_id) GROUP BY g.conv_id),
m AS (SELECT conv_id, path[:d] AS p, d AS depth, len(path) = d AS last FROM (SELECT conv_id, path, unnest(range(0, len(path) + 1)) AS d FROM s)),
n AS (SELECT p, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256 FROM m GROUP BY p, depth),
v AS (SELECT *, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len({_words("p[depth].text")}) END AS tokens, p[:depth - 1] AS above FROM n),
k AS (SELECT above AS p, depth - 1 AS depth, count(*) AS n_children FROM v WHERE depth > 0 GROUP BY ALL),
w AS (SELECT v.*, coalesce(n_children, 0) AS n_children FROM v LEFT JOIN k USING (p, depth)),
u AS (SELECT p[:d] AS p, d AS depth, sum(tokens) AS saved, count(*) FILTER (n_children = 0) AS leaves
  FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM w) GROUP BY ALL)
SELECT w.conv_id, w.depth, o.conv_id AS parent_conv_id, w.n_convs, w.n_children, CAST(leaves AS BIGINT) AS n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, w.ends_sha256
FROM w JOIN u USING (p, depth) LEFT JOIN n o ON w.depth > 0 AND o.depth = w.depth - 1 AND o.p = w.above"""


ORACLES: dict[str, str] = {
    "op2_decontaminate": DECONTAMINATE,
    "op3_chat_format": CHAT,
    "op8_warc": WARC,
    "op10_quality_rules": _quality(),
    "op12_hard_negatives": HARD_NEGATIVES,
    "op13_prefix_trie": TRIE,
}
