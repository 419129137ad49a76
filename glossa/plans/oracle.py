"""DuckDB oracle SQL for the registered queries (same names, same column names)."""

from __future__ import annotations

from glossa.functions import text as T
from glossa.plans import registered as R
from glossa.plans import sqltext as Q

ORACLE: dict[str, str] = {}


def _inject(t: str, doc: str = "doc_id", pos: str = "pos") -> str:
    slot = f"(({doc} + {pos}) % 9)"
    whens = [f"WHEN {slot} = {k} THEN {Q.q(v)} || {t}" for k, v in R.INJECT_PREFIX.items()]
    whens += [f"WHEN {slot} = {k} THEN {t} || {Q.q(v)}" for k, v in R.INJECT_SUFFIX.items()]
    return f"(CASE {' '.join(whens)} ELSE {t} END)"


def _clean_lang(doc: str = "doc_id", lang: str = "lang") -> str:
    whens = " ".join(f"WHEN {doc} % 4 = {k} THEN {Q.q(v)}" for k, v in R.CLEAN_LANGS.items())
    return f"(CASE {whens} ELSE {lang} END)"


PARAS = f"""paras AS (
  SELECT doc_id, lang, CAST(i AS INTEGER) AS pos, {Q.strip('parts[i + 1]')} AS text
  FROM (SELECT doc_id, lang, {Q.split_paragraphs('text')} AS parts FROM documents) d,
       unnest(range(len(parts))) AS u(i)
  WHERE length({Q.strip('parts[i + 1]')}) > 0)"""

CLEAN = f"""{PARAS},
clean AS (
  SELECT doc_id, lang, pos, text FROM {Q.clean_from('paras', 'text', 'lang')} c
  WHERE {Q.keep_text('text')})"""

LABELLED = f"""{CLEAN},
labelled AS (SELECT *, {Q.language_label('text', R.TARGET, 'lang')} AS label FROM clean)"""


def exact_first_k(src: str, strata: list[str], order: list[str], k: str, flag: str) -> str:
    """Plain window form of exact-k for the oracle: rank in order within each stratum."""
    part = ", ".join(strata) if strata else "NULL"
    return (f"SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY {', '.join(order)}) <= {k} AS {flag} "
            f"FROM {src}")


def random_split_cte(src: str, name: str, f: float = R.TEST_FRACTION, seed: int = R.SEED) -> str:
    h = Q.md5_key(seed, "doc_id", "pos")
    return f"""{name}_h AS (SELECT *, {h} AS _h FROM {src}),
{name}_n AS (SELECT floor(count(*) * (1.0::DOUBLE - {f}::DOUBLE)) AS k FROM {src}),
{name} AS (
  SELECT * EXCLUDE (_h, _train, k), CASE WHEN _train THEN 'train' ELSE 'test' END AS split FROM (
    SELECT *, row_number() OVER (ORDER BY _h, doc_id, pos) <= k AS _train FROM {name}_h, {name}_n))"""


def stratified_split_cte(src: str, name: str, label: str = "label", f: float = R.TEST_FRACTION,
                         seed: int = R.SEED) -> str:
    h = Q.md5_key(seed, label, "doc_id", "pos")
    return f"""{name}_h AS (SELECT *, {h} AS _h, count(*) OVER (PARTITION BY {label}) AS _n FROM {src}),
{name} AS (
  SELECT * EXCLUDE (_h, _n, _k), CASE WHEN row_number() OVER (PARTITION BY {label} ORDER BY _h, doc_id, pos) <= _k
                               THEN 'test' ELSE 'train' END AS split FROM (
    SELECT *, CASE WHEN _n <= 1 THEN 0 ELSE least(_n - 1, greatest(1, CAST(round_even(_n * {f}::DOUBLE, 0) AS BIGINT))) END AS _k
    FROM {name}_h))"""


def first_k_cte(src: str, name: str, k: int, strata: str = "lang", order: str = "doc_id, pos") -> str:
    return f"""{name} AS (SELECT * EXCLUDE (_r) FROM (
  SELECT *, row_number() OVER (PARTITION BY {strata} ORDER BY {order}) AS _r FROM {src}) WHERE _r <= {k})"""


ORACLE["paragraph_scan"] = f"WITH {PARAS} SELECT doc_id, lang, pos, text FROM paras"

ORACLE["field_fallback"] = f"""
WITH rec AS (
  SELECT doc_id,
         CASE WHEN doc_id % 3 = 0 THEN '   ' ELSE text END AS text,
         CASE WHEN doc_id % 3 = 0 THEN text WHEN doc_id % 3 = 1 THEN ' ' END AS content,
         'article ' || lang AS article
  FROM documents)
SELECT doc_id, coalesce(CASE WHEN length({Q.strip('text')}) > 0 THEN text END,
                        CASE WHEN length({Q.strip('content')}) > 0 THEN content END,
                        CASE WHEN length({Q.strip('article')}) > 0 THEN article END, '') AS picked
FROM rec"""

ORACLE["clean_paragraphs"] = f"""
WITH {PARAS},
inj AS (SELECT doc_id, lang, pos, {_inject('text')} AS text, {_clean_lang()} AS clang FROM paras),
c AS (SELECT doc_id, pos, lang, text FROM {Q.clean_from('inj', 'text', 'clang')} x)
SELECT doc_id, pos, lang, text FROM c WHERE {Q.keep_text('text')}"""

ORACLE["corpus_stats"] = f"""
WITH {CLEAN}
SELECT lang, count(*) AS n_texts, CAST(sum(length(text)) AS BIGINT) AS n_chars,
       CAST(sum({Q.word_count('text')}) AS BIGINT) AS n_words,
       round(sum(length(text))::DOUBLE / nullif(sum({Q.word_count('text')}), 0), 6) AS chars_per_word
FROM clean GROUP BY lang"""

ORACLE["force_decode"] = f"""
WITH {PARAS},
r AS (SELECT doc_id, pos, CASE WHEN (doc_id + pos) % 3 = 0 THEN 'b''' || text || {Q.q(" caf\\xc3\\xa9 50% a+b\\n'")}
                                WHEN (doc_id + pos) % 3 = 1 THEN 'b''' || text || {Q.q(" \\xzz'")}
                                ELSE text END AS raw FROM paras)
SELECT doc_id, pos, {Q.force_decode('raw')} AS text FROM r"""

ORACLE["repair_text"] = f"""
WITH {PARAS},
r AS (SELECT doc_id, pos, CASE WHEN (doc_id + pos) % 4 = 0 THEN {Q.q("cafÃ© â€œokâ€" + chr(0x9d) + " ")} || text
                                WHEN (doc_id + pos) % 4 = 1 THEN {Q.q("&lt;b&gt; &amp; ﬂow ＦＵＬＬ　‘x’ ")} || text || chr(13) || chr(10) || 'z' || chr(7)
                                WHEN (doc_id + pos) % 4 = 2 THEN '<p>&amp;</p> ' || text
                                ELSE text END AS raw FROM paras)
SELECT doc_id, pos, raw AS text FROM {Q.chain('r', 'raw', Q.REPAIR_STEPS)} x"""

ORACLE["script_tags"] = f"""
WITH {PARAS}
SELECT script, count(*) AS n_texts FROM (SELECT {Q.script_tag(_inject('text'))} AS script FROM paras) GROUP BY script"""

ORACLE["language_label"] = f"""
WITH {PARAS}, inj AS (SELECT lang, {_inject('text')} AS t FROM paras)
SELECT target_lang, label, count(*) AS n_texts FROM (
""" + "\nUNION ALL\n".join(
    f"SELECT {Q.q(tgt)} AS target_lang, {Q.language_label('t', tgt, 'lang')} AS label FROM inj"
    for tgt in ["de", "ru", "ja", "zh-cn", "ko"]) + ") GROUP BY target_lang, label"

ORACLE["language_groups"] = f"""
SELECT lang, "group", count(*) AS n_docs FROM (
  SELECT {_clean_lang()} AS lang, {Q.language_group(_clean_lang())} AS "group" FROM documents)
GROUP BY lang, "group" """

_RATIOS = list(T.RATIOS_UNDERREPRESENTED) + list(T.RATIOS_TOKENIZER_TRAINING)
_NAME = (f"CASE WHEN doc_id % 5 = 4 THEN 'corpus_' || source || '.txt' ELSE 'data/mixtures/mix_' || "
         f"{Q.language_group(_clean_lang())} || '_' || {_clean_lang()} || '_' || "
         f"[{', '.join(Q.q(r) for r in _RATIOS)}][doc_id % {len(_RATIOS)} + 1] || '.txt' END")
ORACLE["mixture_name_parse"] = f"""
WITH n AS (SELECT doc_id, regexp_extract({_NAME}, '([^/]*?)(\\.[^./]*)?\\z', 1) AS stem FROM documents),
p AS (SELECT doc_id, stem, string_split(stem, '_') AS parts FROM n),
r AS (SELECT doc_id, starts_with(stem, 'mix_') AND len(parts) >= 4 AS ok, parts FROM p),
o AS (SELECT doc_id,
        CASE WHEN ok THEN parts[2] ELSE 'unknown' END AS "group",
        CASE WHEN ok THEN parts[3] ELSE 'custom' END AS target_lang,
        CASE WHEN ok THEN array_to_string(parts[4:], '_') ELSE 'unknown' END AS ratio FROM r)
SELECT doc_id, "group", target_lang, ratio,
       CASE WHEN instr(ratio, '_') > 0 THEN TRY_CAST(string_split(ratio, '_')[-1] AS DOUBLE) END AS target_percent
FROM o"""

_presets = []
for _p, _tab in [("underrepresented", T.RATIOS_UNDERREPRESENTED), ("training", T.RATIOS_TOKENIZER_TRAINING),
                 ("both", {**T.RATIOS_UNDERREPRESENTED, **T.RATIOS_TOKENIZER_TRAINING})]:
    for _r, (_e, _t) in _tab.items():
        _presets.append((_p, _r, _e, _t))
_by_preset = {p: [r for (pp, r, _, _) in _presets if pp == p] for p in ["underrepresented", "training", "both"]}
ORACLE["ratio_presets"] = f"""
WITH presets(preset, ratio, english_percent, target_percent) AS (VALUES
  {', '.join(f"({Q.q(p)}, {Q.q(r)}, {e}::DOUBLE, {t}::DOUBLE)" for p, r, e, t in _presets)}),
assigned AS (""" + " UNION ALL ".join(
    f"SELECT {Q.q(p)} AS preset, [{', '.join(Q.q(x) for x in names)}][doc_id % {len(names)} + 1] AS ratio FROM documents"
    for p, names in _by_preset.items()) + """),
counts AS (SELECT preset, ratio, count(*) AS n_docs FROM assigned GROUP BY preset, ratio)
SELECT p.preset, p.ratio, p.english_percent, p.target_percent, coalesce(c.n_docs, 0) AS n_docs
FROM presets p LEFT JOIN counts c USING (preset, ratio)"""

ORACLE["random_split"] = f"WITH {CLEAN}, {random_split_cte('clean', 'rs')} SELECT doc_id, pos, split FROM rs"

ORACLE["stratified_split"] = (f"WITH {LABELLED}, {stratified_split_cte('labelled', 'ss')} "
                              "SELECT doc_id, pos, label, split FROM ss")

_lab = "CASE WHEN label = 'en' THEN 'en' WHEN label = 'unknown' THEN 'unknown' ELSE 'target' END"
ORACLE["split_stats"] = f"""WITH {LABELLED}, {stratified_split_cte('labelled', 'ss')},
n AS (SELECT {_lab} AS l, split FROM ss)
SELECT count(*) AS total_texts,
  count(*) FILTER (WHERE l = 'en') AS total_en_texts,
  count(*) FILTER (WHERE l = 'target') AS total_target_texts,
  count(*) FILTER (WHERE l = 'unknown') AS total_unknown_texts,
  count(*) FILTER (WHERE split = 'train') AS train_texts,
  count(*) FILTER (WHERE split = 'test') AS test_texts,
""" + ",\n".join(f"  count(*) FILTER (WHERE l = '{l}' AND split = '{s}') AS {s}_{l}_texts"
                 for l in ["en", "target", "unknown"] for s in ["train", "test"]) + "\nFROM n"

ORACLE["random_split_slices"] = f"""WITH {CLEAN}, {random_split_cte('clean', 'rs')}
SELECT split, label, count(*) AS n_texts FROM (
  SELECT split, {Q.language_label('text', R.TARGET, 'lang')} AS label FROM rs) GROUP BY split, label"""

ORACLE["language_sample_head"] = f"""WITH {CLEAN}, {first_k_cte('clean', 'head', 100)},
n AS (SELECT lang, count(*) >= 2 AS lang_ok FROM clean GROUP BY lang)
SELECT lang, doc_id, pos, lang_ok FROM head JOIN n USING (lang)"""

_QL = f"""docs AS (SELECT doc_id, lang, text FROM documents),
rec AS (SELECT lang, doc_id, coalesce(CASE WHEN length({Q.strip('text')}) > 0 THEN text END, '') AS raw FROM docs),
{first_k_cte('rec', 'scanned', 250, order='doc_id')},
cl AS (SELECT lang, doc_id, raw AS text FROM {Q.clean_from('scanned', 'raw', 'lang')} x
       WHERE {Q.keep_text('raw')}),
{first_k_cte('cl', 'loaded', 50, order='doc_id')}"""

ORACLE["quota_load"] = f"WITH {_QL} SELECT lang, doc_id, text FROM loaded"

ORACLE["load_manifest"] = f"""WITH {_QL},
req(language) AS (VALUES ('en'), ('de'), ('fr'), ('es'), ('ru'), ('ja')),
got AS (SELECT lang AS language, count(*) AS loaded_samples FROM loaded GROUP BY lang),
m AS (SELECT language, coalesce(loaded_samples, 0) AS loaded_samples FROM req LEFT JOIN got USING (language))
SELECT language, 'data/source_corpora' AS output_dir, 'train' AS split, 50 AS max_samples, true AS streaming,
       42 AS seed, 'documents' AS dataset, 'data/source_corpora/' || language || '.txt' AS output_path,
       CAST(loaded_samples AS INTEGER) AS loaded_samples,
       CASE WHEN loaded_samples > 0 THEN 'completed' ELSE 'failed' END AS status,
       CASE WHEN loaded_samples > 0 THEN '' ELSE 'RuntimeError(''no text fragments for language ' || language || ''')' END AS error, true AS timed
FROM m"""


def _mixture_ctes(sample_size: int | None = 300, langs=("de", "fr", "es", "ru"), seed: int = R.SEED, cells_of=None) -> str:
    ratios = {**T.RATIOS_UNDERREPRESENTED, **T.RATIOS_TOKENIZER_TRAINING}
    grid = ", ".join(f"({Q.q(l)}, 'en', {Q.q(r)}, {e}::DOUBLE, {t}::DOUBLE)" for l in langs for r, (e, t) in ratios.items()
                     if cells_of is None or (l, r) in cells_of)
    if sample_size is None:
        sample = "smp AS (SELECT * FROM clean)"
        most = "CAST(floor(least(n_en * 100.0::DOUBLE / english_percent, n_target * 100.0::DOUBLE / target_percent)) AS BIGINT)"
        total = f"m - greatest(m - CAST(floor(m::DOUBLE * target_percent / 100.0::DOUBLE) AS BIGINT) - n_en, 0) AS total FROM (SELECT *, {most} AS m FROM cells0)"
    else:
        sample, total = first_k_cte("clean", "smp", sample_size), f"least({sample_size}, n_en, n_target * 100) AS total FROM cells0"
    h = Q.md5_key(seed, "target_lang", "ratio", "side", "lang", "doc_id", "pos")
    return f"""{CLEAN}, {sample},
counts AS (SELECT lang, count(*) AS n FROM smp GROUP BY lang),
grid(target_lang, base_lang, ratio, english_percent, target_percent) AS (VALUES {grid}),
cells0 AS (
  SELECT g.*, coalesce(t.n, 0) AS n_target, coalesce(e.n, 0) AS n_en
  FROM grid g LEFT JOIN counts t ON t.lang = g.target_lang LEFT JOIN counts e ON e.lang = g.base_lang),
cells1 AS (SELECT *, {total}),
cells2 AS (SELECT *, CAST(floor(total::DOUBLE * target_percent / 100.0::DOUBLE) AS BIGINT) AS target_count FROM cells1),
cells AS (
  SELECT *, total - target_count AS english_count, {Q.language_group('target_lang')} AS "group",
    CASE WHEN n_target < 2 THEN 'RuntimeError(''too few fragments after cleaning'')'
         WHEN total <= 0 THEN 'ValueError(''total_size must be positive'')'
         WHEN total - target_count > n_en THEN 'RuntimeError(''not enough English fragments'')'
         WHEN target_count > n_target THEN 'RuntimeError(''not enough target fragments'')' END AS err
  FROM cells2),
both_sides AS (
  SELECT s.lang, s.doc_id, s.pos, c.target_lang, c.ratio, 'en' AS side, c.english_count AS k
  FROM smp s JOIN cells c ON s.lang = c.base_lang WHERE c.err IS NULL
  UNION ALL
  SELECT s.lang, s.doc_id, s.pos, c.target_lang, c.ratio, 'target' AS side, c.target_count AS k
  FROM smp s JOIN cells c ON s.lang = c.target_lang WHERE c.err IS NULL),
drawn AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY target_lang, ratio, side ORDER BY {h}, lang, doc_id, pos) AS _r
  FROM both_sides) WHERE _r <= k)"""


ORACLE["mixture_draw"] = f"""WITH {_mixture_ctes()}
SELECT target_lang, ratio, lang, doc_id, pos, {Q.md5_key(R.SEED, 'target_lang', 'ratio', 'lang', 'doc_id', 'pos')} AS order_key
FROM drawn"""

ORACLE["mixture_manifest"] = f"""WITH {_mixture_ctes()}
SELECT CASE WHEN err IS NULL THEN 'mix_' || "group" || '_' || target_lang || '_' || ratio || '.txt' ELSE '' END AS file,
       CASE WHEN err IS NULL THEN 'data/mixtures/mix_' || "group" || '_' || target_lang || '_' || ratio || '.txt' ELSE '' END AS path,
       "group", target_lang, ratio, english_percent, target_percent,
       CASE WHEN err IS NULL THEN total ELSE 0 END AS n_texts,
       CASE WHEN err IS NULL THEN 'created' ELSE 'failed' END AS status, coalesce(err, '') AS error
FROM cells"""

ORACLE["corpus_preview"] = f"""WITH {CLEAN}, {random_split_cte('clean', 'rs')},
first5 AS (SELECT doc_id, pos, text FROM clean ORDER BY doc_id, pos LIMIT 5),
raw AS (SELECT count(*) AS raw_texts FROM paras),
cnt AS (SELECT count(*) AS cleaned_texts, count(*) FILTER (WHERE split = 'train') AS train_texts,
               count(*) FILTER (WHERE split = 'test') AS test_texts FROM rs)
SELECT * FROM first5, raw, cnt"""

ORACLE["missing_sources"] = """WITH req(lang) AS (VALUES ('en'), ('de'), ('fr'), ('es'), ('ru'), ('ja'), ('zh-cn'))
SELECT lang FROM req WHERE lang NOT IN (SELECT lang FROM documents WHERE lang IS NOT NULL)"""


# ------------------------------------------------------- D/E: tokenizers, metrics
SPLIT = f"{LABELLED}, {stratified_split_cte('labelled', 'ss')}"
TYPES = f"""{SPLIT},
words AS (SELECT unnest({Q.pretokens('text')}) AS word, split, label FROM ss),
types AS (
  SELECT word, count(*) FILTER (WHERE split = 'train') AS train_freq,
         count(*) FILTER (WHERE split = 'test') AS test_all_freq,
         count(*) FILTER (WHERE split = 'test' AND label = 'en') AS test_en_freq,
         count(*) FILTER (WHERE split = 'test' AND label = {Q.q(R.TARGET)}) AS test_target_freq
  FROM words GROUP BY word)"""

ORACLE["pretoken_types"] = f"WITH {TYPES} SELECT * FROM types"


def text_stats_cte(src: str = "ss", target: str = R.TARGET, name: str = "stats") -> str:
    conds = {"all": "true", "en": "label = 'en'", "target": f"label = {Q.q(target)}"}
    cols = []
    for n, c in conds.items():
        nb = f"({c}) AND length(t) > 0"
        cols += [f"count(*) FILTER (WHERE {c}) AS texts_{n}",
                 f"CAST(coalesce(sum(CASE WHEN {nb} THEN length(t) ELSE 0 END), 0) AS BIGINT) AS chars_{n}",
                 f"CAST(coalesce(sum(CASE WHEN {nb} THEN {Q.word_count('t')} ELSE 0 END), 0) AS BIGINT) AS words_{n}"]
    return f"{name} AS (SELECT {', '.join(cols)} FROM (SELECT {Q.strip('text')} AS t, label FROM {src} WHERE split = 'test'))"


def result_select(sums: str = "sums", stats: str = "stats") -> str:
    sl = {"all": "", "en": "_en", "target": "_target"}
    out, tpc = [], {}
    for n, suf in sl.items():
        d = f"chars_{n} > 0"
        tpc[n] = f"(CASE WHEN {d} THEN tokens_test_{n}::DOUBLE / chars_{n} END)"
        tpw = f"(CASE WHEN {d} THEN tokens_test_{n}::DOUBLE / nullif(words_{n}, 0) END)"
        atl = f"(CASE WHEN {d} THEN token_chars_test_{n}::DOUBLE / nullif(tokens_test_{n}, 0) END)"
        out += [f"round({tpc[n]}, 6) AS tokens_per_char{suf}", f"round({tpw}, 6) AS tokens_per_word{suf}",
                f"round({atl}, 6) AS avg_token_len{suf}",
                f"CAST(CASE WHEN {d} THEN texts_{n} ELSE 0 END AS BIGINT) AS n_texts{suf}",
                f"CAST(CASE WHEN {d} THEN tokens_test_{n} ELSE 0 END AS BIGINT) AS n_tokens{suf}"]
    tpw_en = "(CASE WHEN chars_en > 0 THEN tokens_test_en::DOUBLE / nullif(words_en, 0) END)"
    tpw_tg = "(CASE WHEN chars_target > 0 THEN tokens_test_target::DOUBLE / nullif(words_target, 0) END)"
    inv = {k: f"(1.0::DOUBLE / nullif({v}, 0))" for k, v in tpc.items()}
    out += [f"round({tpc['target']} - {tpc['en']}, 6) AS compression_gap_tokens_per_char",
            f"round({tpw_tg} - {tpw_en}, 6) AS compression_gap_tokens_per_word",
            f"round({inv['all']}, 6) AS compression_factor_char", f"round({inv['en']}, 6) AS compression_factor_char_en",
            f"round({inv['target']}, 6) AS compression_factor_char_target",
            f"round({inv['en']} - {inv['target']}, 6) AS compression_penalty_char"]
    path = "'tokenizers/' || method || '/vocab_' || CAST(vocab_size AS VARCHAR) || '/tokenizer.json'"
    return (f"SELECT method, CAST(vocab_size AS INTEGER) AS vocab_size, {path} AS tokenizer_path, "
            f"{', '.join(out)} FROM {sums}, {stats}")


def lexical_sums_cte(method: str, sizes, name: str, types: str = "types", p: str = "") -> str:
    m = method + p
    if method == "word":
        units = f"SELECT word AS unit, * FROM {types}"
        inv = "SELECT unit, train_freq AS uf FROM units_{m} WHERE train_freq > 0"
    else:
        units = f"SELECT unnest(regexp_extract_all(word, '(?s).', 0)) AS unit, * FROM {types}"
        inv = "SELECT unit, sum(train_freq) AS uf FROM units_{m} WHERE train_freq > 0 GROUP BY unit"
    parts = []
    for v in sizes:
        tl = f"CASE WHEN rk IS NOT NULL AND rk <= {v - 5} THEN length(unit) ELSE 5 END"
        parts.append(
            f"SELECT '{method}' AS method, {v} AS vocab_size, "
            + ", ".join(f"CAST(sum({s}_freq) AS BIGINT) AS tokens_{s}, CAST(sum({s}_freq * {tl}) AS BIGINT) AS token_chars_{s}"
                        for s in ["test_all", "test_en", "test_target"])
            + f" FROM j_{m}")
    return f"""units_{m} AS ({units}),
inv_{m} AS ({inv.format(m=m)}),
rank_{m} AS (SELECT unit, row_number() OVER (ORDER BY uf DESC, unit) AS rk FROM inv_{m}),
per_{m} AS (SELECT unit, sum(test_all_freq) AS test_all_freq, sum(test_en_freq) AS test_en_freq,
            sum(test_target_freq) AS test_target_freq FROM units_{m} GROUP BY unit),
j_{m} AS (SELECT p.*, r.rk FROM per_{m} p LEFT JOIN rank_{m} r USING (unit)),
{name} AS ({' UNION ALL '.join(parts)})"""


ORACLE["compression_grid"] = f"""WITH {TYPES}, {text_stats_cte()},
{lexical_sums_cte('word', R.GRID_SIZES, 'sw')},
{lexical_sums_cte('char', R.GRID_SIZES, 'sc')},
sums AS (SELECT * FROM sw UNION ALL SELECT * FROM sc)
{result_select()}"""


ORACLE["saved_run"] = f"""WITH {TYPES}, {text_stats_cte()},
{lexical_sums_cte('word', R.GRID_SIZES, 'sw')},
{lexical_sums_cte('char', R.GRID_SIZES, 'sc')},
sums AS (SELECT * FROM sw UNION ALL SELECT * FROM sc),
res AS ({result_select()}),
kept AS (SELECT count(*) FILTER (WHERE split = 'train') AS n_lines FROM ss),
raw AS (SELECT count(*) AS n_fragments, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM paras)
SELECT 'run_de' AS run_id, res.* EXCLUDE (tokenizer_path), true AS saved, n_lines, n_fragments, n_chars FROM res, kept, raw"""


# One merge at a time, as a recursion over the type table; a vocabulary size is reached at the first step with that many
# distinct strings. The steps cover the largest registered size (the alphabet takes the rest), so none is missed.
_STEPS = max(R.BPE_SIZES) - 80
BPE = f"""{TYPES},
alpha AS (SELECT DISTINCT unnest(regexp_extract_all(word, '(?s).', 0)) AS c FROM types WHERE train_freq > 0),
al AS (SELECT list(c) AS a FROM alpha),
init AS (SELECT types.*, ' ' || array_to_string(list_transform(regexp_extract_all(word, '(?s).', 0),
           lambda c: CASE WHEN list_contains(a, c) THEN c ELSE '<unk>' END), '  ') || ' ' AS seg FROM types, al),
rec AS (
  SELECT 0 AS step, '' AS l, '' AS r, 0::HUGEINT AS n, * FROM init
  UNION ALL
  SELECT s.step + 1, b.l, b.r, b.n, s.word, s.train_freq, s.test_all_freq, s.test_en_freq, s.test_target_freq,
         replace(s.seg, ' ' || b.l || '  ' || b.r || ' ', ' ' || b.l || b.r || ' ')
  FROM rec s, (SELECT l, r, sum(train_freq) AS n FROM (
      SELECT train_freq, y[i] AS l, y[i + 1] AS r
      FROM (SELECT train_freq, string_split(trim(seg), '  ') AS y FROM rec WHERE train_freq > 0), unnest(range(1, len(y))) AS u(i))
    GROUP BY l, r HAVING sum(train_freq) >= 2 ORDER BY n DESC, l, r LIMIT 1) b
  WHERE s.step < {_STEPS}),
steps AS (SELECT step, any_value(l) AS l, any_value(r) AS r, any_value(n) AS n FROM rec WHERE step > 0 GROUP BY step),
firsts AS (SELECT l || r AS piece, min(step) AS step FROM steps GROUP BY l || r),
base AS (SELECT 5 + count(*) AS n FROM alpha),
grown AS (SELECT 0 AS step, n FROM base UNION ALL
          SELECT s.step, base.n + (SELECT count(*) FROM firsts f WHERE f.step <= s.step) FROM steps s, base),
cut AS (SELECT v, coalesce(min(step) FILTER (WHERE n >= v), max(step)) AS step FROM grown, (SELECT unnest({list(R.BPE_SIZES)}) AS v) GROUP BY v),
last AS (SELECT max(step) AS step FROM cut)"""

ORACLE["bpe_merges"] = f"""WITH RECURSIVE {BPE}
SELECT CAST(s.step AS INTEGER) AS rank, l AS "left", r AS "right", l || r AS merged, CAST(n AS BIGINT) AS count
FROM steps s JOIN last ON s.step <= last.step"""
ORACLE["bpe_vocab"] = f"""WITH RECURSIVE {BPE},
pieces AS (SELECT 0 AS part, i AS k, p AS piece FROM (SELECT unnest(['<unk>', '<pad>', '<s>', '</s>', '<mask>']) AS p, unnest(range(5)) AS i)
  UNION ALL SELECT 1, row_number() OVER (ORDER BY c), c FROM alpha
  UNION ALL SELECT 2, f.step, f.piece FROM firsts f JOIN last ON f.step <= last.step)
SELECT CAST(row_number() OVER (ORDER BY part, k) - 1 AS INTEGER) AS id, piece FROM pieces"""
ORACLE["bpe_encode"] = f"""WITH RECURSIVE {BPE}
SELECT word, len(string_split(trim(seg), '  ')) AS n_tokens, array_to_string(string_split(trim(seg), '  '), ' ') AS tokens
FROM rec JOIN last USING (step) WHERE test_all_freq > 0"""
# WordPiece by the same recursion: symbols after a word's first one carry the mark, which a merge drops on its right.
_MARK = Q.q("##")
WORDPIECE = f"""{TYPES},
init AS (SELECT word, train_freq, ' ' || array_to_string(list_transform(regexp_extract_all(word, '(?s).', 0),
           lambda c, i: CASE WHEN i > 1 THEN {_MARK} || c ELSE c END), '  ') || ' ' AS seg FROM types WHERE train_freq > 0),
symbols AS (SELECT DISTINCT unnest(string_split(trim(seg), '  ')) AS s FROM init),
rec AS (
  SELECT 0 AS step, '' AS m, * FROM init
  UNION ALL
  SELECT s.step + 1, b.m, s.word, s.train_freq, replace(s.seg, ' ' || b.l || '  ' || b.r || ' ', ' ' || b.m || ' ')
  FROM rec s, (SELECT l, r, l || CASE WHEN starts_with(r, {_MARK}) THEN substr(r, 3) ELSE r END AS m, sum(train_freq) AS n FROM (
      SELECT train_freq, y[i] AS l, y[i + 1] AS r
      FROM (SELECT train_freq, string_split(trim(seg), '  ') AS y FROM rec), unnest(range(1, len(y))) AS u(i))
    GROUP BY l, r HAVING sum(train_freq) >= 2 ORDER BY n DESC, l, r LIMIT 1) b
  WHERE s.step < {R.SUBWORD_SIZE - 80}),
firsts AS (SELECT m AS piece, min(step) AS step FROM rec WHERE step > 0 AND m NOT IN (SELECT s FROM symbols) GROUP BY m),
pieces AS (SELECT 0 AS part, i AS k, p AS piece FROM (SELECT unnest(['<unk>', '<pad>', '<s>', '</s>', '<mask>']) AS p, unnest(range(5)) AS i)
  UNION ALL SELECT 1, row_number() OVER (ORDER BY s), s FROM symbols
  UNION ALL SELECT 2, step, piece FROM firsts),
vocab AS MATERIALIZED (SELECT id, piece FROM (SELECT CAST(row_number() OVER (ORDER BY part, k) - 1 AS INTEGER) AS id, part, piece FROM pieces)
          WHERE id < {R.SUBWORD_SIZE} OR part < 2)"""

ORACLE["wordpiece_vocab"] = f"WITH RECURSIVE {WORDPIECE} SELECT id, piece FROM vocab"
# longest match first: from each place the longest piece of the vocabulary; a place without one makes the word unknown
ORACLE["wordpiece_encode"] = f"""WITH RECURSIVE {WORDPIECE},
tested AS (SELECT word FROM types WHERE test_all_freq > 0),
enc AS (
  SELECT word, 1::BIGINT AS place, []::VARCHAR[] AS tokens, []::INTEGER[] AS ids FROM tested WHERE length(word) <= 100
  UNION ALL
  SELECT word, place + arg_max(n, n), list_append(any_value(tokens), arg_max(piece, n)), list_append(any_value(ids), arg_max(id, n)) FROM (
    SELECT e.*, v.piece, v.id, n FROM enc e, unnest(range(1, length(e.word) - e.place + 2)) AS u(n)
    JOIN vocab v ON v.piece = CASE WHEN e.place > 1 THEN {_MARK} ELSE '' END || substr(e.word, e.place, n) WHERE e.place <= length(e.word))
  GROUP BY word, place),
done AS (SELECT word, tokens, ids FROM enc WHERE place = length(word) + 1),
out AS (SELECT word, coalesce(tokens, ['<unk>']) AS tokens, coalesce(ids, [0]) AS ids FROM tested LEFT JOIN done USING (word))
SELECT word, len(tokens) AS n_tokens, array_to_string(tokens, ' ') AS tokens, array_to_string(ids, ' ') AS ids FROM out"""
_SUMS = ", ".join(f"CAST(sum({s}_freq * ((length(seg) - length(replace(seg, ' ', ''))) // 2)) AS BIGINT) AS tokens_{s}, "
                  f"CAST(sum({s}_freq * length(replace(seg, ' ', ''))) AS BIGINT) AS token_chars_{s}"
                  for s in ["test_all", "test_en", "test_target"])
ORACLE["compression_by_language"] = f"""WITH RECURSIVE {BPE}, {text_stats_cte()},
sums AS (SELECT 'bpe' AS method, v AS vocab_size, {_SUMS} FROM rec JOIN cut USING (step) GROUP BY v)
{result_select()}"""


# ------------------------------------------------------------ F: n-gram LM
_B = R.LM_BLOCK
BLOCKS = f"""{SPLIT},
toks AS (SELECT doc_id, pos, split, label, {Q.pretokens('text')} AS ids FROM ss WHERE len({Q.pretokens('text')}) >= 2),
blk AS (
  SELECT doc_id, pos, split, label, CAST(s // {_B} AS INTEGER) AS block_no, ids[s + 1 : s + {_B}] AS block
  FROM toks, unnest(range(0, len(ids) - 1, {_B})) AS u(s)
  WHERE len(ids[s + 1 : s + {_B}]) >= 2)"""

ORACLE["lm_blocks"] = f"""WITH {BLOCKS}
SELECT doc_id, pos, split, block_no, len(block) AS n_ids, array_to_string(block, ' ') AS block_text FROM blk"""

def lm_ctes(src: str, target: str, name: str, p: str = "") -> str:
    """The Kneser-Ney LM of order 3 over blocks (doc_id, pos, split, label, block_no, block) of ``src``; one row ``name``."""
    def discount(table: str) -> str:
        return f"(SELECT CASE WHEN a > 0 AND b > 0 THEN a / (a + 2 * b) ELSE 0.75::DOUBLE END AS d FROM (SELECT count(*) FILTER (n = 1)::DOUBLE AS a, count(*) FILTER (n = 2)::DOUBLE AS b FROM {table}))"

    def step(n: str, d: str, total: str, kinds: str, lower: str) -> str:
        return f"CASE WHEN {total} > 0 THEN (greatest(coalesce({n}, 0) - {d}, 0.0::DOUBLE) + {d} * {kinds} * {lower}) / {total} ELSE {lower} END"

    return f"""grams{p} AS (SELECT doc_id, pos, split, label, block_no, block[i] AS w, block[i - 1] AS c1, CASE WHEN i > 2 THEN block[i - 2] END AS c2
          FROM {src}, unnest(range(2, len(block) + 1)) AS u(i)),
all3{p} AS (SELECT c2, c1, w, count(*) AS n FROM grams{p} WHERE split = 'train' GROUP BY ALL),
n3{p} AS (SELECT * FROM all3{p} WHERE c2 IS NOT NULL),
n2{p} AS (SELECT c1, w, count(*) AS n FROM all3{p} GROUP BY ALL),
n1{p} AS (SELECT w, count(*) AS n FROM n2{p} GROUP BY ALL),
x3{p} AS (SELECT c2, c1, sum(n) AS t3, count(*) AS k3 FROM n3{p} GROUP BY ALL),
x2{p} AS (SELECT c1, sum(n) AS t2, count(*) AS k2 FROM n2{p} GROUP BY ALL),
x1{p} AS (SELECT sum(n) AS t1, count(*) AS k1 FROM n1{p}),
dd{p} AS (SELECT a.d AS d1, b.d AS d2, c.d AS d3 FROM {discount(f'n1{p}')} a, {discount(f'n2{p}')} b, {discount(f'n3{p}')} c),
nl{p} AS (SELECT *, -ln({step('m3', 'd3', 't3', 'k3', 'p2')}) AS nll FROM (
  SELECT *, {step('m2', 'd2', 't2', 'k2', 'p1')} AS p2 FROM (
    SELECT *, {step('m1', 'd1', 't1', 'k1', '(1 / (k1 + 1.0::DOUBLE))')} AS p1 FROM (
      SELECT g.*, n1{p}.n AS m1, n2{p}.n AS m2, n3{p}.n AS m3, t1, k1, t2, k2, t3, k3, d1, d2, d3
      FROM grams{p} g LEFT JOIN n1{p} USING (w) LEFT JOIN n2{p} USING (c1, w) LEFT JOIN n3{p} USING (c2, c1, w)
        LEFT JOIN x2{p} USING (c1) LEFT JOIN x3{p} USING (c2, c1), x1{p}, dd{p})))),
{name} AS (SELECT round(exp(l_test), 6) AS ppl, round(l_test, 6) AS eval_loss, round(l_train, 6) AS train_loss,
       round(exp(l_en), 6) AS ppl_en, round(l_en, 6) AS loss_en, CAST(b_en AS INTEGER) AS test_en_blocks,
       round(exp(l_target), 6) AS ppl_target, round(l_target, 6) AS loss_target,
       CAST(b_target AS INTEGER) AS test_target_blocks, round(l_target - l_en, 6) AS gap_loss,
       CAST(b_train AS INTEGER) AS train_blocks, CAST(b_test AS INTEGER) AS test_blocks FROM (
  SELECT avg(nll) FILTER (WHERE split = 'test') AS l_test, avg(nll) FILTER (WHERE split = 'train') AS l_train,
         avg(nll) FILTER (WHERE split = 'test' AND label = 'en') AS l_en,
         avg(nll) FILTER (WHERE split = 'test' AND label = {Q.q(target)}) AS l_target,
         count(DISTINCT (doc_id, pos, block_no)) FILTER (WHERE split = 'train') AS b_train,
         count(DISTINCT (doc_id, pos, block_no)) FILTER (WHERE split = 'test') AS b_test,
         count(DISTINCT (doc_id, pos, block_no)) FILTER (WHERE split = 'test' AND label = 'en') AS b_en,
         count(DISTINCT (doc_id, pos, block_no)) FILTER (WHERE split = 'test' AND label = {Q.q(target)}) AS b_target
  FROM nl{p}))"""


ORACLE["ngram_lm_eval"] = f"WITH {BLOCKS}, {lm_ctes('blk', R.TARGET, 'lm')} SELECT * FROM lm"


# ------------------------------------------------------------ G: roll-ups, over experiments on mixtures
def run_results_ctes(run, p: str) -> str:
    """An experiment on one mixture: clean, label, split, word and char tokenizers at every size, LM per cell."""
    t = run.target
    parts = [f"""mx{p} AS (SELECT s.doc_id, s.lang, s.pos, s.text FROM drawn d JOIN smp s USING (lang, doc_id, pos)
          WHERE d.target_lang = {Q.q(t)} AND d.ratio = {Q.q(run.ratio)})""",
             f"cl{p} AS (SELECT doc_id, lang, pos, text FROM {Q.clean_from(f'mx{p}', 'text', Q.q(t))} c WHERE {Q.keep_text('text')})",
             f"lb{p} AS (SELECT *, {Q.language_label('text', t, 'lang')} AS label FROM cl{p})",
             stratified_split_cte(f"lb{p}", f"ss{p}"),
             f"words{p} AS (SELECT unnest({Q.pretokens('text')}) AS word, split, label FROM ss{p})",
             f"""types{p} AS (
  SELECT word, count(*) FILTER (WHERE split = 'train') AS train_freq,
         count(*) FILTER (WHERE split = 'test') AS test_all_freq,
         count(*) FILTER (WHERE split = 'test' AND label = 'en') AS test_en_freq,
         count(*) FILTER (WHERE split = 'test' AND label = {Q.q(t)}) AS test_target_freq
  FROM words{p} GROUP BY word)""",
             text_stats_cte(f"ss{p}", t, f"stats{p}")]
    cells = []
    for m in ("word", "char"):
        parts.append(lexical_sums_cte(m, run.sizes, f"s_{m}{p}", f"types{p}", p))
        for v in run.sizes:
            c = f"_{m}_{v}{p}"
            units = Q.pretokens("text")
            if m == "char":
                units = f"flatten(list_transform({units}, lambda x: regexp_extract_all(x, '(?s).', 0)))"
            parts += [
                      f"""tk{c} AS (SELECT doc_id, pos, split, label, list(coalesce(r.unit, '<unk>') ORDER BY i) AS ids FROM (
              SELECT doc_id, pos, split, label, unnest(us) AS u, unnest(range(len(us))) AS i FROM (SELECT *, {units} AS us FROM ss{p}))
              LEFT JOIN (SELECT unit FROM rank_{m}{p} WHERE rk <= {v - 5}) r ON r.unit = u GROUP BY ALL)""",
                      f"""bk{c} AS (SELECT doc_id, pos, split, label, CAST(s // {_B} AS INTEGER) AS block_no, ids[s + 1 : s + {_B}] AS block
  FROM tk{c}, unnest(range(0, len(ids) - 1, {_B})) AS u(s) WHERE len(ids) >= 2 AND len(ids[s + 1 : s + {_B}]) >= 2)""",
                      lm_ctes(f"bk{c}", t, f"lm{c}", c)]
            cells.append(f"SELECT * FROM ({result_select(f's_{m}{p}', f'stats{p}')}) r, lm{c} WHERE r.vocab_size = {v}")
    parts.append(f"results{p} AS (SELECT *, {Q.q(run.run_path)} AS run_path FROM ({' UNION ALL '.join(cells)}))")
    return ",\n".join(parts)


_DONE = [(r, f"_r{i}") for i, r in enumerate(R.BATCH) if r.target != "ru" and r.min_texts < 1000]
_FEW = next(r for r in R.BATCH if r.min_texts >= 1000)
_UNI, _UNI_P = next((r, p) for r, p in _DONE if "unigram" in r.methods)
_RUN_ROWS = [f"SELECT {Q.q(r.corpus_path)} AS corpus_path, {Q.q(r.run_path)} AS run_path, CAST(NULL AS VARCHAR) AS failure, '' AS error" for r, _ in _DONE]
_RUN_ROWS += [f"SELECT {Q.q(r.corpus_path)}, '', 'validation_failed', {Q.q(R.NO_CORPUS)}" for r in R.BATCH if r.target == "ru"]
_RUN_ROWS.append(f"""SELECT {Q.q(_FEW.corpus_path)}, '', 'failed',
  'RuntimeError(''not enough text fragments after cleaning: ' || (SELECT count(*) FROM few_clean) || '; minimum {_FEW.min_texts}'')'""")
# a failing cell: fewer vocabulary rows than the marker and the characters of the normalised train words
BATCH_CTES = (f"{_mixture_ctes(None, cells_of=[(r.target, r.ratio) for r in R.BATCH])},\n" + ",\n".join(run_results_ctes(r, p) for r, p in _DONE) + ",\n"
              + "res AS (" + " UNION ALL ".join(f"SELECT * FROM results{p}" for _, p in _DONE) + "),\n"
              + f"""few AS (SELECT s.doc_id, s.lang, s.pos, s.text FROM drawn d JOIN smp s USING (lang, doc_id, pos)
          WHERE d.target_lang = {Q.q(_FEW.target)} AND d.ratio = {Q.q(_FEW.ratio)}),
few_clean AS (SELECT text FROM {Q.clean_from('few', 'text', Q.q(_FEW.target))} c WHERE {Q.keep_text('text')}),
runs AS ({' UNION ALL '.join(_RUN_ROWS)}),
uni_chars AS (SELECT count(DISTINCT c) + 1 AS n FROM (SELECT unnest(regexp_extract_all(text, '(?s)[^{T.WS_CHARS}]', 0)) AS c FROM ss{_UNI_P} WHERE split = 'train')),
err AS (SELECT {Q.q(_UNI.run_path)} AS run_path, 'unigram/vocab_{_UNI.sizes[0]}' AS stage,
        'ValueError(''unigram vocabulary of {_UNI.sizes[0]} is too small for ' || n || ' characters'')' AS error FROM uni_chars)""")


def best_rows_sql(src: str = "res", keys: str = "run_path") -> str:
    from glossa.operators.rollup import BEST_CRITERIA
    parts = []
    for name, metric, mode in BEST_CRITERIA:
        key = f"abs({metric})" if mode == "min_abs" else (f"-{metric}" if mode == "max" else metric)
        parts.append(f"""SELECT {keys}, '{name}' AS criterion, method, vocab_size, value FROM (
  SELECT {keys}, method, vocab_size, {metric} AS value,
         row_number() OVER (PARTITION BY {keys} ORDER BY {metric} IS NULL, {key}, method, vocab_size) AS _r
  FROM {src}{'' if metric == 'tokens_per_char' else f' WHERE {metric} IS NOT NULL'}) WHERE _r = 1""")
    return "\nUNION ALL\n".join(parts)


ORACLE["best_rows"] = f"WITH {BATCH_CTES}\n{best_rows_sql()}"
ORACLE["error_table"] = f"WITH {BATCH_CTES} SELECT run_path, stage, error FROM err"

_COUNTS = """counts_ AS (SELECT r.run_path, coalesce(n.n, 0) AS n_rows, coalesce(e.n, 0) AS n_errors FROM runs r
  LEFT JOIN (SELECT run_path, count(*) AS n FROM res GROUP BY run_path) n USING (run_path)
  LEFT JOIN (SELECT run_path, count(*) AS n FROM err GROUP BY run_path) e USING (run_path) WHERE r.run_path <> ''),
run_st AS (SELECT *, CASE WHEN n_rows > 0 AND n_errors = 0 THEN 'completed' WHEN n_rows > 0 THEN 'partially_completed'
                  ELSE 'failed' END AS status FROM counts_)"""
ORACLE["run_status"] = f"WITH {BATCH_CTES}, {_COUNTS} SELECT run_path, n_rows, n_errors, status FROM run_st"

_STATS = " UNION ALL ".join(f"""SELECT {Q.q(r.run_path)} AS run_path, (SELECT count(*) FROM mx{p}) AS raw_texts, count(*) AS cleaned_texts,
  count(*) FILTER (WHERE split = 'train') AS train_texts, count(*) FILTER (WHERE split = 'test') AS test_texts,
  count(*) FILTER (WHERE split = 'test' AND label = 'en') AS test_en_texts,
  count(*) FILTER (WHERE split = 'test' AND label NOT IN ('en', 'unknown')) AS test_target_texts,
  count(*) FILTER (WHERE split = 'test' AND label = 'unknown') AS test_unknown_texts FROM ss{p}""" for r, p in _DONE)
_BEST = ", ".join(f"(SELECT {c} FROM best b WHERE b.criterion = '{n}' AND b.run_path = st.run_path) AS {n}{suffix}"
                  for n in ("best_tokens_per_char", "best_target_compression_factor", "best_compression_penalty_char", "best_target_tokens_per_char",
                            "best_compression_gap_tokens_per_char", "best_ppl", "best_gap_loss") for c, suffix in (("method", "_method"), ("vocab_size", "_vocab"), ("value", "")))
ORACLE["run_summary"] = f"""WITH {BATCH_CTES}, {_COUNTS}, st AS ({_STATS}), best AS ({best_rows_sql()})
SELECT st.*, 'stratified_by_language' AS split_strategy, c.n_rows AS completed_combinations, c.n_errors AS failed_combinations,
  {_BEST}
FROM st JOIN counts_ c USING (run_path)"""

BATCH_SUMMARY = f"""summary AS (
  SELECT r.corpus_path, p.grp AS "group", p.tl AS target_lang, p.ratio,
         coalesce(r.failure, CASE WHEN coalesce(e.n, 0) > 0 THEN 'partially_completed' ELSE 'completed' END) AS status,
         r.error, r.run_path, CAST(coalesce(c.n, 0) AS INTEGER) AS completed_combinations,
         CAST(coalesce(e.n, 0) AS INTEGER) AS failed_combinations,
         bt.method AS best_tokens_per_char_method, bt.vocab_size AS best_tokens_per_char_vocab,
         bt.value AS best_tokens_per_char, bp.method AS best_ppl_method, bp.vocab_size AS best_ppl_vocab, bp.value AS best_ppl
  FROM (SELECT *, string_split(regexp_extract(corpus_path, '([^/]*?)(\\.[^./]*)?\\z', 1), '_') AS parts FROM runs) r
  LEFT JOIN (SELECT run_path, count(*) AS n FROM res GROUP BY run_path) c USING (run_path)
  LEFT JOIN (SELECT run_path, count(*) AS n FROM err GROUP BY run_path) e USING (run_path)
  LEFT JOIN (SELECT * FROM best WHERE criterion = 'best_tokens_per_char') bt USING (run_path)
  LEFT JOIN (SELECT * FROM best WHERE criterion = 'best_ppl') bp USING (run_path)
  CROSS JOIN LATERAL (SELECT r.parts[2] AS grp, r.parts[3] AS tl, array_to_string(r.parts[4:], '_') AS ratio) p)"""

ORACLE["batch_summary"] = f"""WITH {BATCH_CTES}, best AS ({best_rows_sql()}), {BATCH_SUMMARY}
SELECT * FROM summary"""

ROLLUP = f"""{BATCH_CTES}, best AS ({best_rows_sql()}), {BATCH_SUMMARY},
rollup AS (
  SELECT 'results/batch_demo' AS batch_dir, s.run_path, s.corpus_path, s."group", s.target_lang, s.ratio,
         CASE WHEN instr(s.ratio, '_') > 0 THEN TRY_CAST(string_split(s.ratio, '_')[-1] AS DOUBLE) END AS target_percent,
         s.status AS batch_status, res.* EXCLUDE (run_path)
  FROM summary s JOIN res USING (run_path) WHERE length(coalesce(s.run_path, '')) > 0)"""

ORACLE["batch_rollup"] = f"WITH {ROLLUP} SELECT * FROM rollup"


def mean_by_sql(dims: list[str], coerce: bool = False) -> str:
    from glossa.operators.rollup import ROLLUP_METRICS
    parts = []
    for m in ROLLUP_METRICS:
        v = f"TRY_CAST({m} AS DOUBLE)" if coerce else f"CAST({m} AS DOUBLE)"
        dsel = ", ".join(f'CAST("{d}" AS VARCHAR) AS "{d}"' for d in dims)
        dn = " AND ".join(f'"{d}" IS NOT NULL' for d in dims)
        dl = ", ".join(f'"{d}"' for d in dims)
        parts.append(f"""SELECT {dl}, '{m}' AS metric, round(avg(_v), 8) AS mean, count(*) AS n FROM (
  SELECT {dsel}, {v} AS _v FROM rollup) WHERE _v IS NOT NULL AND NOT isnan(_v) AND {dn} GROUP BY {dl}""")
    return "\nUNION ALL\n".join(parts)


ORACLE["mean_by_method_vocab"] = f"WITH {ROLLUP}\n{mean_by_sql(['method', 'vocab_size'])}"
ORACLE["mean_by_method_percent"] = f"WITH {ROLLUP}\n{mean_by_sql(['method', 'target_percent'])}"
ORACLE["mean_by_lang_percent"] = f"WITH {ROLLUP}\n{mean_by_sql(['target_lang', 'target_percent'])}"
ORACLE["mean_by_line_vocab"] = f"WITH {ROLLUP}\n{mean_by_sql(['ratio', 'vocab_size'], coerce=True)}"
ORACLE["status_counts"] = f"WITH {BATCH_CTES}, best AS ({best_rows_sql()}), {BATCH_SUMMARY} SELECT status, count(*) AS n FROM summary GROUP BY status"
ORACLE["run_ledger"] = f"""WITH {BATCH_CTES}, {_COUNTS}
SELECT regexp_extract(run_path, '([^/]+)$', 1) AS run_id, status, n_rows || ' cells' AS message,
       regexp_extract(run_path, 'run_([^_]+)_', 1) AS language, true AS dated FROM run_st"""


# ------------------------------------------------------------ B12: language id
_NORM = f"(' ' || lower(regexp_replace({Q.strip('text')}, {Q.q(T.WS + '+')}, ' ', 'g')) || ' ')"
LANGID = f"""{CLEAN},
lh AS (SELECT *, {Q.md5_key(7, 'doc_id')} AS _h, {_NORM} AS nt FROM clean),
tr AS (SELECT * FROM lh WHERE _h >= '{R.HOLDOUT}'),
ho AS (SELECT * FROM lh WHERE _h < '{R.HOLDOUT}'),
tg AS (SELECT lang, substring(nt, i, n) AS gram FROM tr, unnest([1, 2, 3]) AS nn(n),
       unnest(range(1, greatest(length(nt) - n + 1, 1) + 1)) AS u(i) WHERE length(substring(nt, i, n)) > 0),
cnt AS (SELECT lang, gram, count(*) AS count FROM tg GROUP BY lang, gram),
tot AS (SELECT lang, sum(count) AS n, count(*) AS v FROM cnt GROUP BY lang),
docs AS (SELECT lang, count(*) AS d FROM tr GROUP BY lang),
lt AS (SELECT lang, ln(0.5 / (n + 0.5 * v)) AS unseen, ln(d / (SELECT sum(d) FROM docs)) AS prior, n, v
       FROM tot JOIN docs USING (lang)),
model AS (SELECT t.lang, gram, count, ln((count + 0.5) / (n + 0.5 * v)) - unseen AS gain, unseen, prior
          FROM cnt t JOIN lt USING (lang))"""

ORACLE["langid_nb"] = f"WITH {LANGID} SELECT lang, gram, count FROM model"

PREDICTED = f"""{LANGID},
hg AS (SELECT doc_id, pos, substring(nt, i, n) AS gram FROM ho, unnest([1, 2, 3]) AS nn(n),
       unnest(range(1, greatest(length(nt) - n + 1, 1) + 1)) AS u(i) WHERE length(substring(nt, i, n)) > 0),
ng AS (SELECT doc_id, pos, count(*) AS n_grams FROM hg GROUP BY doc_id, pos),
sc AS (SELECT doc_id, pos, m.lang, sum(gain) AS gain FROM hg JOIN model m USING (gram) GROUP BY doc_id, pos, m.lang),
allsc AS (
  SELECT ng.doc_id, ng.pos, lt.lang, coalesce(sc.gain, 0) + ng.n_grams * lt.unseen + lt.prior AS score
  FROM ng JOIN lt ON true LEFT JOIN sc ON sc.doc_id = ng.doc_id AND sc.pos = ng.pos AND sc.lang = lt.lang),
best AS (SELECT doc_id, pos, arg_max(lang, score) AS predicted FROM allsc GROUP BY doc_id, pos),
hp AS (SELECT h.*, b.predicted FROM ho h JOIN best b USING (doc_id, pos))"""

ORACLE["langid_accuracy"] = f"WITH {PREDICTED} SELECT lang, predicted, count(*) AS n_texts FROM hp GROUP BY lang, predicted"
ORACLE["label_by_classifier"] = f"""WITH {PREDICTED}
SELECT lang, {Q.language_label('text', R.TARGET, 'predicted')} AS label, count(*) AS n_texts FROM hp GROUP BY 1, 2"""


# ------------------------------------------------------------ S, A6-A15
ORACLE["stream_clean"] = f"""WITH {CLEAN}
SELECT doc_id, pos, lang, {Q.language_label('text', R.TARGET, 'lang')} AS label, text FROM clean"""

ORACLE["stream_quota"] = f"""WITH {CLEAN}, {first_k_cte('clean', 'head', 50)}
SELECT lang, doc_id, pos FROM head"""

ORACLE["corpus_roundtrip"] = f"""WITH {CLEAN}
SELECT lang, count(*) AS n_texts, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM clean GROUP BY lang"""

ORACLE["corpus_listing"] = f"""WITH {CLEAN}
SELECT lang, CAST(sum(strlen({Q.strip('text')}) + 2) AS BIGINT) AS n_bytes FROM clean GROUP BY lang"""

from glossa.operators.metrics import LM_COLUMNS as _LC  # noqa: E402
from glossa.operators.metrics import RESULT_COLUMNS as _RC  # noqa: E402
from glossa.operators.rollup import COMPACT_BATCH_COLUMNS as _CB  # noqa: E402
from glossa.operators.rollup import COMPACT_COLUMNS as _CC  # noqa: E402

ORACLE["result_table"] = f"WITH {BATCH_CTES} SELECT {', '.join(_RC + _LC)} FROM res"
ORACLE["compact_results"] = f"WITH {BATCH_CTES} SELECT {', '.join(_CC)} FROM res"
ORACLE["compact_batch"] = f"WITH {ROLLUP} SELECT {', '.join(Q.ident(c) for c in _CB)} FROM rollup"

ORACLE["ratio_percent"] = f"""
SELECT doc_id, r AS ratio,
       CASE WHEN instr(r, '_') > 0 THEN TRY_CAST(string_split(r, '_')[-1] AS DOUBLE) END AS target_percent
FROM (SELECT doc_id, [{', '.join(Q.q(x) for x in R.RATIO_NAMES)}][doc_id % {len(R.RATIO_NAMES)} + 1] AS r FROM documents)"""
