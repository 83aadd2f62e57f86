"""DuckDB SQL for the rows of the queries that SQL can express."""

from __future__ import annotations

import string

from .licenses import TEMPLATES
from .quality import BULLETS, CUT_OFF, RULES, STOP_WORDS

_UPPER, _LOWER = string.ascii_uppercase, string.ascii_lowercase
_BLANK = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_SPACE = r"[\x20\x09-\x0D]+"


def _words(text: str, pattern: str = _SPACE) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{pattern}'), lambda x: x <> '')"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SUBSTRINGS = f"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, {_words("coalesce(text, '')")} AS ws FROM documents),
w AS (SELECT i, doc_id, k, array_to_string(ws[k:k + 12], ' ') AS run FROM (SELECT i, doc_id, ws, unnest(range(1, greatest(len(ws) - 11, 1))) AS k FROM d)),
least_ids AS (SELECT run, min(doc_id) AS least FROM w GROUP BY run),
gone AS (SELECT DISTINCT i, k + o AS k FROM (SELECT w.i, w.k FROM w JOIN least_ids USING (run) WHERE doc_id > least), range(13) t(o)),
word AS (SELECT i, k, ws[k] AS word FROM (SELECT i, ws, unnest(range(1, len(ws) + 1)) AS k FROM d)),
kept AS (SELECT i, string_agg(word, ' ' ORDER BY k) AS kept FROM word ANTI JOIN gone USING (i, k) GROUP BY i),
n AS (SELECT i, count(*) AS n FROM gone GROUP BY i)
SELECT doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (i) LEFT JOIN n USING (i)
"""

JACCARD = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS i, doc_id, {_words(f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} AS ws FROM documents),
s AS (SELECT DISTINCT i, array_to_string(ws[k:k + 4], ' ') AS g FROM (SELECT i, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS k FROM d WHERE len(ws) > 0)),
n AS (SELECT i, count(*) AS n FROM s GROUP BY i),
c AS (SELECT a.i AS a, b.i AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.i < b.i GROUP BY a.i, b.i),
e AS (SELECT a, b FROM c JOIN n x ON a = x.i JOIN n y ON b = y.i WHERE 100 * c >= 80 * (x.n + y.n - c)),
twice AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT i AS a, i AS b FROM d UNION SELECT r.a, t.b FROM reach r JOIN twice t ON r.b = t.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.least AS component_id
FROM d LEFT JOIN n USING (i) JOIN (SELECT a, min(o.doc_id) AS least FROM reach JOIN d o ON o.i = b GROUP BY a) m ON m.a = d.i
"""

TOPK = """
WITH v AS (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.i, a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.i <> b.i WHERE a.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""

_MEASURES = {
    "mean_word_chars": "word_chars / n_words",
    "symbols_per_word": "n_symbols / n_words",
    "stop_word_share": "stops / n_words",
    "dup_line_share": "n_dup_lines / n_lines",
    "marks_per_word": "n_marks / n_words",
    "bullet_line_share": "bullets / n_lines",
    "cut_line_share": "cuts / n_lines",
}
_PASSED = " AND ".join(
    f"{_MEASURES[r.measure]} {sign} {bound}" for r in RULES for sign, bound in ((">=", r.least), ("<=", r.most)) if bound is not None
)
QUALITY = f"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, {_words("t")} AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
g AS (SELECT i, k, count(*) OVER (PARTITION BY i, a, b, c) AS n FROM (SELECT i, k, ws[k] AS a, ws[k + 1] AS b, ws[k + 2] AS c FROM (SELECT i, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS k FROM w))),
r AS (SELECT i, count(DISTINCT k + o) AS n FROM g, range(3) t(o) WHERE n > 1 GROUP BY i),
m AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
    len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
    len(list_filter(ws, lambda x: lower(rtrim(x, '.,;:')) IN ({", ".join(map(_quote, sorted(set(STOP_WORDS))))}))) AS stops,
    length(t) - length(translate(t, '!?', '')) AS n_marks, len(list_filter(ls, lambda x: ltrim(x, {_BLANK})[1] IN ({', '.join(map(_quote, BULLETS))}))) AS bullets,
    len(list_filter(ls, lambda x: {' OR '.join(f'ends_with(rtrim(x, {_BLANK}), {_quote(c)})' for c in CUT_OFF)})) AS cuts FROM w LEFT JOIN r USING (i)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_PASSED} AS kept FROM f
"""

_TEMPLATE_ROWS = ", ".join(f"({_quote(t.label)}, {t.base}, {t.words}, {t.key_words}, {t.key_at})" for t in TEMPLATES)
LICENSES = f"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, {_words(f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")} AS ws FROM documents),
t(label, base, words, key, key_at) AS (VALUES {_TEMPLATE_ROWS}),
p AS (SELECT *, unnest(range(1, greatest(len(ws) - len(key) + 2, 1))) AS p FROM d, t WHERE list_has_all(ws, key)),
f AS (SELECT i, label, base, p - 1 AS start_word, len(list_filter(range(1, len(words) + 1), lambda j: p - key_at + j - 1 >= 1 AND ws[greatest(p - key_at + j - 1, 1)] = words[j])) / len(words) AS share
  FROM p WHERE ws[p:p + len(key) - 1] = key),
o AS (SELECT i, count(*) FILTER (base) AS n, min(start_word) FILTER (base) AS lo, max(start_word) FILTER (base) AS hi,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS bases, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM f GROUP BY i)
SELECT doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_base, lo AS first_word, hi AS last_word, coalesce(bases, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN o USING (i)
"""

INFILL = r"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
k AS (SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS toks, [CAST('0x' || substr(h, 8 * x + 1, 8) AS BIGINT) FOR x IN [0, 1, 2, 3]] AS hs FROM d),
c AS (SELECT *, len(toks) AS n, least(hs[1] % (len(toks) + 1), hs[2] % (len(toks) + 1)) AS a, greatest(hs[1] % (len(toks) + 1), hs[2] % (len(toks) + 1)) AS b,
    t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR hs[3] % 100 >= 90 AS plain FROM k),
p AS (SELECT doc_id, t, n, CASE WHEN plain THEN 'plain' WHEN hs[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(toks[1:a], '') AS pre, array_to_string(toks[a + 1:b], '') AS mid, array_to_string(toks[b + 1:n], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE t END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""

AUDIT = f"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT i, count(*) AS n, count(DISTINCT word) AS k FROM (SELECT i, unnest({_words("t")}) AS word FROM d) GROUP BY i),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, [coalesce(n, 0) < 200, 100 * coalesce(k, 0) < 50 * coalesce(n, 0), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t), regexp_matches(t, '[#$%&*|]'),
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM d LEFT JOIN w USING (i) LEFT JOIN l USING (doc_id)),
c(x) AS (VALUES (1), (2), (3), (4), (5)),
o AS (SELECT [a.x, b.x, c.x, e.x, g.x] AS o FROM c a, c b, c, c e, c g WHERE len(list_distinct([a.x, b.x, c.x, e.x, g.x])) = 5),
s AS (SELECT o, x AS step FROM o, c),
r AS (SELECT part, o, step, good, toxic, fails[o[step]] AS fails_it, len(list_filter(o[1:step - 1], lambda j: fails[j])) > 0 AS gone, len(list_filter(fails, lambda v: v)) = 1 AS alone FROM f, s),
t AS (SELECT part, o, step, count(*) FILTER (NOT gone AND NOT fails_it) AS kept, count(*) FILTER (NOT gone AND fails_it) AS removed, count(*) FILTER (gone AND fails_it) AS redundant, count(*) FILTER (fails_it AND alone) AS unique_fails,
    count(*) FILTER (NOT gone AND fails_it AND good) AS good_lost, count(*) FILTER (NOT gone AND fails_it AND toxic) AS toxic_lost FROM r GROUP BY part, o, step)
SELECT part, array_to_string([substr('ABCDE', j, 1) FOR j IN o], '') AS filter_order, CAST(step AS INT) AS step, substr('ABCDE', o[step], 1) AS filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, o[step]) AS BIGINT) AS shapley
FROM t
"""

_CRC_TABLE = "list_transform(range(256), lambda n: list_reduce(list_prepend(n, [1, 2, 3, 4, 5, 6, 7, 8]), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END))"
_DRAWN = "(CAST(k AS UHUGEINT) * 2862933555777941757 + 1) % 18446744073709551616"
SHARDS = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS i, doc_id, coalesce(text, '') AS t FROM documents),
b AS (SELECT i, [CAST('0x' || x AS BIGINT) FOR x IN regexp_extract_all(hex(encode(t)), '..')] AS bytes FROM d),
crc AS (SELECT i, len(bytes) AS n, xor(4294967295, list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c // 256, tab[xor(c % 256, x) + 1]))) AS crc FROM b, (SELECT {_CRC_TABLE} AS tab)),
j AS (SELECT i, CAST('0x' || substr(sha256(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16) AS UHUGEINT) AS k, 0::BIGINT AS last, 0::BIGINT AS here, 0::BIGINT AS next FROM d
  UNION ALL SELECT i, {_DRAWN}, CASE WHEN next < 16 THEN next ELSE last END, next, CAST(floor((next + 1) * (2147483648.0::DOUBLE / CAST({_DRAWN} // 8589934592 + 1 AS DOUBLE))) AS BIGINT) FROM j WHERE next <= 16),
s AS (SELECT i, max(last) AS shard, max(here) AS grown_shard FROM j GROUP BY i),
r AS (SELECT doc_id, n + 1 AS size, crc AS text_crc32, shard, grown_shard FROM d JOIN crc USING (i) JOIN s USING (i))
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INT) AS shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, CAST(grown_shard AS INT) AS grown_shard
FROM r
"""

ORACLE = {
    "op3_substring_dedup": SUBSTRINGS,
    "op4_ngram_jaccard": JACCARD,
    "op7_exact_topk": TOPK,
    "op9_quality_rules": QUALITY,
    "op10_license_scans": LICENSES,
    "op11_fill_in_middle": INFILL,
    "op12_filter_audit": AUDIT,
    "op13_sharding": SHARDS,
}
