"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

WS = r"[\x20\x09-\x0D]"
NWS = r"[^\x20\x09-\x0D]"

OP1 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '{NWS}+') AS w, string_split(t, chr(10)) AS l FROM d),
s AS (SELECT r, doc_id, t, w, l, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        list_filter(l, lambda x: regexp_matches(x, '{NWS}')) AS wl FROM w),
x AS (SELECT r, unnest(range(1, n_words - 3)) AS i, w FROM s WHERE n_words >= 5),
g AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS g FROM x),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g),
v AS (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nx FROM c WHERE n > 1),
p AS (SELECT r, sum(least(5, coalesce(nx - i, 5))) AS n_repeat_words FROM v GROUP BY r),
b AS (SELECT s.*, len(wl) - len(list_distinct(wl)) AS n_dup_lines, coalesce(p.n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM s LEFT JOIN p USING (r)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
        length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) AS upper_n,
        length(t) - length(regexp_replace(t, '\p{{Nd}}', '', 'g')) AS digit_n,
        length(t) - length(regexp_replace(t, '\p{{L}}', '', 'g')) AS letter_n,
        length(t) - length(replace(t, '!', '')) AS shout_n FROM b)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * n_symbols > n_words
       OR 2 * n_dup_lines > len(l) OR 2 * upper_n > word_chars OR 2 * digit_n > word_chars
       OR 2 * letter_n < word_chars OR 10 * shout_n > n_words) AS kept
FROM f
"""

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP7 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT r, doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM d),
k AS (SELECT *, {_LOWER.format(f"regexp_replace(line, '^{WS}+|{WS}+$', '', 'g')")} AS k FROM x),
c AS (SELECT k, max(doc_id) AS keeper FROM k WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT k.*, c.k IS NOT NULL AND k.doc_id IS DISTINCT FROM c.keeper AS gone FROM k LEFT JOIN c USING (k))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY r
"""

_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[\pL\pN_]+')"

# items of five words or more, as all items of the given tables are
OP4 = rf"""
WITH i AS (SELECT row_number() OVER () AS ir, item_id, {_WORDS} AS w FROM benchmark),
ig AS (SELECT DISTINCT ir, item_id, array_to_string(w[k:k + 4], ' ') AS g
       FROM (SELECT ir, item_id, w, unnest(range(1, len(w) - 3)) AS k FROM i)),
ic AS (SELECT ir, count(*) AS n FROM ig GROUP BY ir),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
dg AS (SELECT DISTINCT r, doc_id, array_to_string(w[k:k + 4], ' ') AS g
       FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 3)) AS k FROM d))
SELECT any_value(doc_id) AS doc_id, any_value(item_id) AS item_id, any_value(n) AS n_shingles, count(*) AS n_shared,
  count(*) / any_value(n) AS containment
FROM dg JOIN ig USING (g) JOIN ic USING (ir) GROUP BY r, ir HAVING 5 * count(*) >= 4 * any_value(n)
"""

OP12 = rf"""
WITH p AS (SELECT row_number() OVER () AS r, lang, piece FROM (SELECT coalesce(lang, 'und') AS lang,
        unnest(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
w AS (SELECT r, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
x AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM x, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE i + m - 1 <= len(w)),
f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
k AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS first_part, array_to_string(w[k + 1:], ' ') AS rest
      FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
s AS (SELECT k.lang, k.phrase, a, k, l.f AS l, r.f AS r, 2000000::HUGEINT * a // (l.f + r.f) AS score
      FROM k JOIN f l ON l.lang = k.lang AND l.phrase = first_part JOIN f r ON r.lang = k.lang AND r.phrase = rest),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS pick FROM s),
i AS (SELECT lang, a AS longer, array_to_string(w[j:j + z - 1], ' ') AS phrase FROM c, (SELECT unnest([1, 2, 3]) AS j), (SELECT unnest([2, 3]) AS z)
      WHERE z < m AND j + z - 1 <= m),
o AS (SELECT lang, phrase, max(longer) AS longer FROM i GROUP BY ALL),
t AS (SELECT b.lang, b.phrase, a, l, r, score, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
      FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase WHERE pick = 1 AND (longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a))
SELECT t.lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM t JOIN n ON n.lang = t.lang WHERE rank <= 2000
"""

OP13 = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.r, a.vec_id AS anchor_id, a.label AS anchor_label, b.r AS o, b.vec_id, b.label, list_inner_product(a.e, b.e)::BIGINT AS score
      FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
g AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS k FROM p WHERE label = anchor_label),
n AS (SELECT g.anchor_id, g.vec_id AS positive_id, g.score AS positive_score, p.vec_id AS negative_id, p.score AS negative_score,
        row_number() OVER (PARTITION BY g.r, g.k ORDER BY p.score DESC, p.vec_id) AS rank
      FROM g JOIN p ON p.r = g.r AND p.label <> p.anchor_label AND 80 * g.score <= 100 * p.score AND 100 * p.score <= 100 * g.score WHERE g.k <= 5)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

ORACLE = {"op1_quality_rules": OP1, "op4_benchmark_decontamination": OP4, "op7_line_dedup": OP7, "op12_phrase_collocations": OP12,
          "op13_hard_negatives": OP13}
