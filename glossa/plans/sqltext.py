"""DuckDB SQL mirrors of ``glossa.functions.text`` for the oracle queries.

Same regex constants; only the dialect differs (``'g'`` flag, ``\\1`` back-references,
standard string literals where a backslash is just a backslash).
"""

from __future__ import annotations

from glossa.functions import text as T


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def ident(s: str) -> str:
    """SQL identifier."""
    return f'"{s}"'


def strip(x: str) -> str:
    return f"trim({x}, {q(T.WS_LITERAL)})"


def word_count(x: str) -> str:
    return f"len(regexp_extract_all({x}, {q(f'[^{T.WS_CHARS}]+')}, 0))"


def pretokens(x: str) -> str:
    return f"regexp_extract_all({x}, {q(T.PRETOKEN)}, 0)"


def split_paragraphs(x: str) -> str:
    return (f"CASE WHEN instr({x}, chr(10) || chr(10)) > 0 THEN string_split({x}, chr(10) || chr(10)) "
            f"ELSE string_split_regex({x}, {q(T.LINE_BREAKS)}) END")


def force_decode(x: str) -> str:
    body = f"regexp_replace({x}, {q(r'(?s)\Ab' + chr(39) + r'(.*)' + chr(39) + r'\z')}, '\\1')"
    pct = f"regexp_replace(replace(replace({body}, '%', '%25'), '+', '%2B'), {q(r'\\x([0-9a-fA-F]{2})')}, '%\\1', 'g')"
    dec = f"url_decode({pct})"
    for esc, rep in [(r"\\n", "chr(10)"), (r"\\t", "chr(9)"), (r"\\r", "chr(13)"), (r"\\'", q("'"))]:
        dec = f"regexp_replace({dec}, {q(esc)}, {rep}, 'g')"
    dec = f"regexp_replace({dec}, {q(r'\\\\')}, {q(chr(92) * 2)}, 'g')"
    lit = (f"regexp_matches({x}, {q(r'(?s)\Ab' + chr(39) + r'.*' + chr(39) + r'\z')}) AND NOT "
           f"regexp_matches({x}, {q(r'\\x([^0-9a-fA-F]|[0-9a-fA-F][^0-9a-fA-F]|[0-9a-fA-F]?\z)')})")
    return f"(CASE WHEN {x} IS NOT NULL AND {lit} THEN {dec} ELSE {x} END)"


def repair_entities(x: str) -> str:
    ent = x
    for k, v in T.HTML_ENTITIES:
        ent = f"replace({ent}, {q(k)}, {q(v)})"
    return f"(CASE WHEN instr({x}, '<') = 0 THEN {ent} ELSE {x} END)"


def repair_mojibake(x: str) -> str:
    latin = f"translate({x}, {q(T.CP1252_HIGH)}, {q(T.CP1252_HIGH_BYTES)})"
    gate = f"(regexp_matches({x}, {q(T.MOJIBAKE_MARK)}) AND regexp_matches({latin}, {q(r'\A[\x{0}-\x{ff}]*\z')}))"
    hexed = (f"array_to_string(list_transform(string_split(CASE WHEN {gate} THEN {latin} ELSE '' END, ''), "
             f"lambda c: printf('%02x', ord(c))), '')")
    fixed = f"try(decode(unhex({hexed})))"
    return f"(CASE WHEN {gate} AND {fixed} IS NOT NULL THEN {fixed} ELSE {x} END)"


def repair_chars(x: str) -> str:
    t = x
    for k, v in T.LIGATURES:
        t = f"replace({t}, {q(k)}, {q(v)})"
    full = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "\u3000"
    half = "".join(chr(c) for c in range(0x21, 0x7F)) + " "
    t = f"translate({t}, {q(full)}, {q(half)})"
    t = f"translate({t}, {q(T.SINGLE_QUOTES + T.DOUBLE_QUOTES)}, {q(chr(39) * 4 + chr(34) * 4)})"
    t = f"regexp_replace({t}, {q(r'\r\n|[\r\x{85}\x{2028}\x{2029}]')}, chr(10), 'g')"
    return f"regexp_replace({t}, {q(T.CONTROL_CHARS)}, '', 'g')"


REPAIR_STEPS = [repair_entities, repair_mojibake, repair_chars]


def chain(src: str, col: str, steps) -> str:
    """Nested subqueries, one per step (mirror of ``with_steps``)."""
    out = src
    for i, st in enumerate(steps):
        out = f"(SELECT * REPLACE ({st(col)} AS {col}) FROM {out} _s{i})"
    return out


def remove_escapes(x: str) -> str:
    t = f"regexp_replace({x}, {q(T.ESCAPE_HEX)}, '', 'g')"
    t = f"regexp_replace({t}, {q(T.ESCAPE_ANY)}, '', 'g')"
    return f"replace({t}, {q(T.REPLACEMENT_CHAR)}, '')"


def remove_markers(x: str) -> str:
    for m in T.WIKI_MARKERS:
        x = f"replace({x}, {q(m)}, '')"
    return x


def cjk_filter(x: str, lang: str) -> str:
    parts = []
    for code in ["ko", "ja", "zh-cn"]:
        pat = f"[^{T.CJK_KEEP[code]}{T.WS_CHARS}{T.WORD_CHARS}]"
        parts.append(f"WHEN {lang} = {q(code)} THEN regexp_replace({x}, {q(pat)}, '', 'g')")
    return f"(CASE {' '.join(parts)} ELSE {x} END)"


def clean_steps(lang: str | None = None) -> list:
    steps = [force_decode, *REPAIR_STEPS, remove_escapes, remove_markers]
    if lang is not None:
        steps.append(lambda t: cjk_filter(t, lang))
    steps.append(strip)
    return steps


def clean_from(src: str, col: str = "text", lang: str | None = None) -> str:
    """Cleaned ``col`` over the rows of ``src`` (a table name or parenthesised query)."""
    return chain(src, col, clean_steps(lang))


def keep_text(x: str) -> str:
    s = strip(x)
    return f"({x} IS NOT NULL AND length({s}) >= {T.MIN_TEXT_CHARS} AND regexp_matches({x}, '\\p{{L}}'))"


def script_tag(x: str) -> str:
    whens = " ".join(f"WHEN regexp_matches({x}, {q(p)}) THEN {q(tag)}" for tag, p in T.SCRIPT_RULES)
    return f"(CASE {whens} ELSE 'other' END)"


def language_label(x: str, target: str, detected: str) -> str:
    t = strip(x)
    tag = script_tag(t)
    if target in T.CJK_TARGETS:
        lab = (f"CASE WHEN {tag} = {q(T.CJK_TARGETS[target])} THEN {q(target)} "
               f"WHEN {tag} = 'lat' AND {detected} = 'en' THEN 'en' ELSE 'unknown' END")
    elif target in T.CYRILLIC_TARGETS:
        lab = (f"CASE WHEN {tag} = 'cyr' THEN {q(target)} "
               f"WHEN {tag} = 'lat' AND {detected} = 'en' THEN 'en' ELSE 'unknown' END")
    else:
        lab = (f"CASE WHEN {tag} = 'lat' AND {detected} = 'en' THEN 'en' "
               f"WHEN {tag} = 'lat' AND {detected} = {q(target)} THEN {q(target)} ELSE 'unknown' END")
    return f"(CASE WHEN length({t}) = 0 THEN 'unknown' ELSE {lab} END)"


def language_group(x: str) -> str:
    whens = " ".join(f"WHEN {x} IN ({', '.join(q(l) for l in ls)}) THEN {q(g)}" for g, ls in T.LANGUAGE_GROUPS.items())
    return f"(CASE {whens} ELSE 'custom' END)"


def md5_key(seed: int, *cols: str) -> str:
    parts = [q(str(seed))]
    for c in cols:
        parts += ["':'", f"CAST({c} AS VARCHAR)"]
    return f"md5({' || '.join(parts)})"
