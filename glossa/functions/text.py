"""Scalar text functions as Catalyst column expressions.

Everything here is a ``Column`` built from JVM-side functions, so it stays inside
whole-stage codegen. Regex classes are written with ``\\x{...}`` escapes that Java
regex and RE2 (DuckDB, the oracle) read the same way.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's behaviour)
# ---------------------------------------------------------------------------
# Python str.isspace() set; Java's (?U)\s misses U+001C-U+001F, so spell it out.
WS_CHARS = (r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
            r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
WS = f"[{WS_CHARS}]"
# Python's Unicode \w, minus code points unassigned in Java's tables.
WORD_CHARS = r"\p{L}\p{N}_"
# str.splitlines() break points.
LINE_BREAKS = r"\r\n|[\n\x{b}\x{c}\r\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
# Pre-tokenizer of BPE and WordPiece: runs of word chars, or runs of other non-space chars. Its word class is the one of
# Unicode's regular expressions: letters, marks, decimal and letter numbers, connectors, join controls, circled letters.
PRETOKEN_WORD = (r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200c}\x{200d}\x{24b6}-\x{24e9}"
                 r"\x{1f130}-\x{1f149}\x{1f150}-\x{1f169}\x{1f170}-\x{1f189}")
PRETOKEN_SPACE = r"\x{9}-\x{d}\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
PRETOKEN = f"[{PRETOKEN_WORD}]+|[^{PRETOKEN_WORD}{PRETOKEN_SPACE}]+"
# Escape debris removed by the cleaner, in this order.
ESCAPE_HEX = r"\\x[0-9a-fA-F]{2,}"
ESCAPE_ANY = r"\\[a-zA-Z0-9]"
REPLACEMENT_CHAR = "�"
# Wiki40B structure markers, removed one after another in this order.
WIKI_MARKERS = ["_START_ARTICLE_", "_START_SECTION_", "_START_PARAGRAPH_", "_NEWLINE_"]
# Characters kept by the CJK filter (besides whitespace and word characters).
CJK_KEEP = {
    "ko": r"\x{ac00}-\x{d7af}\x{1100}-\x{11ff}\x{3130}-\x{318f}",
    "ja": r"\x{3040}-\x{309f}\x{30a0}-\x{30ff}\x{4e00}-\x{9faf}",
    "zh-cn": r"\x{4e00}-\x{9fff}",
}
# Script detection, first hit wins.
SCRIPT_RULES = [
    ("ko", r"[\x{ac00}-\x{d7af}]"),
    ("ja", r"[\x{3040}-\x{30ff}]"),
    ("zh", r"[\x{4e00}-\x{9fff}]"),
    ("cyr", r"[\x{400}-\x{4ff}]"),
    ("lat", r"[A-Za-z]"),
]
CJK_TARGETS = {"ja": "ja", "zh-cn": "zh", "ko": "ko"}
CYRILLIC_TARGETS = ["ru", "bg"]
# Languages offered by the loader and their mixture groups.
LANGUAGES = ["en", "ru", "bg", "cs", "de", "nl", "da", "ja", "zh-cn", "ko"]
LANGUAGE_GROUPS = {
    "slavic": ["ru", "bg", "cs"],
    "germanic": ["de", "nl", "da"],
    "isolated": ["ja", "zh-cn", "ko"],
}
# Mixture ratio presets: name -> (english percent, target percent).
RATIOS_UNDERREPRESENTED = {"99.9_0.1": (99.9, 0.1), "99_1": (99.0, 1.0), "98_2": (98.0, 2.0), "95_5": (95.0, 5.0)}
RATIOS_TOKENIZER_TRAINING = {"90_10": (90.0, 10.0), "75_25": (75.0, 25.0), "50_50": (50.0, 50.0)}
MIN_TEXT_CHARS = 10
# Text repair (B2) tables: HTML entities, Latin ligatures, curly quotes, control characters.
HTML_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
                 ("&nbsp;", " "), ("&amp;", "&")]
LIGATURES = [("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"),
             ("ﬅ", "st"), ("ﬆ", "st"), ("Ĳ", "IJ"), ("ĳ", "ij")]
SINGLE_QUOTES = "‘’‚‛"
DOUBLE_QUOTES = "“”„‟"
CONTROL_CHARS = r"[\x{0}-\x{8}\x{b}\x{e}-\x{1f}\x{7f}\x{feff}]"
# cp1252 bytes 0x80-0x9F that decode to characters above U+00FF, in byte order.
CP1252_HIGH = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
CP1252_HIGH_BYTES = "\x80\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8c\x8e\x91\x92\x93\x94\x95\x96\x97\x98\x99\x9a\x9b\x9c\x9e\x9f"
# Lead characters of UTF-8 read as Latin-1/cp1252 ("Ã©", "â€™", "Â ").
MOJIBAKE_MARK = r"[\x{c2}-\x{f4}][\x{80}-\x{bf}" + "".join(f"\\x{{{ord(c):x}}}" for c in CP1252_HIGH) + "]"
# ---------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# The same whitespace set as literal characters, for btrim / DuckDB trim(s, chars).
WS_LITERAL = ("".join(chr(c) for c in range(0x9, 0xE)) + "".join(chr(c) for c in range(0x1C, 0x21))
              + "\x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000")


def py_strip(text) -> Column:
    """Python ``str.strip()``: Unicode whitespace at both ends (Spark ``trim`` only strips
    spaces; ``btrim`` with the explicit set only looks at the ends)."""
    return F.btrim(_c(text), F.lit(WS_LITERAL))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body`` (a one-element lambda)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_count(text) -> Column:
    """Number of whitespace-separated pieces."""
    return F.size(F.regexp_extract_all(_c(text), F.lit(f"[^{WS_CHARS}]+"), 0))


def pretokens(text) -> Column:
    """D1 pre-tokens (array<string>)."""
    return F.regexp_extract_all(_c(text), F.lit(PRETOKEN), 0)


def force_decode(text) -> Column:
    """B1 for string columns: a ``b'...'`` literal is unwrapped and its escapes decoded as UTF-8.

    ``\\xNN`` runs become ``%NN`` and go through ``url_decode`` (bytes -> UTF-8, bad bytes ->
    U+FFFD, which the cleaner removes); the single-character escapes are mapped directly.
    Any other string is returned as it is.
    """
    t = _c(text)
    body = F.regexp_replace(t, r"(?s)\Ab'(.*)'\z", "$1")
    pct = F.regexp_replace(F.regexp_replace(body, "%", "%25"), r"\+", "%2B")
    pct = F.regexp_replace(pct, r"\\x([0-9a-fA-F]{2})", "%$1")
    decoded = F.url_decode(pct)
    for esc, rep in [(r"\\n", "\n"), (r"\\t", "\t"), (r"\\r", "\r"), (r"\\'", "'")]:
        decoded = F.regexp_replace(decoded, esc, rep)
    decoded = F.regexp_replace(decoded, r"\\\\", "\\\\")
    is_literal = t.startswith("b'") & t.endswith("'") & (F.length(t) >= 3) & ~t.rlike(r"\\x([^0-9a-fA-F]|[0-9a-fA-F][^0-9a-fA-F]|[0-9a-fA-F]?\z)")
    return F.when(t.isNotNull() & is_literal, decoded).otherwise(t)


def repair_entities(text) -> Column:
    """B2 step 1: HTML entities, only when the text has no tag opener."""
    t = _c(text)
    ent = t
    for k, v in HTML_ENTITIES:
        ent = F.replace(ent, F.lit(k), F.lit(v))
    return F.when((F.instr(t, "&") > 0) & (F.instr(t, "<") == 0), ent).otherwise(t)


def repair_mojibake(text) -> Column:
    """B2 step 2: UTF-8 that was read as Latin-1/cp1252 (``cafÃ©`` -> ``café``), gated by a
    marker pattern; kept as is when the re-decoded bytes are not valid UTF-8."""
    t = _c(text)
    latin = F.translate(t, CP1252_HIGH, CP1252_HIGH_BYTES)
    gate = t.rlike(MOJIBAKE_MARK) & latin.rlike(r"\A[\x{0}-\x{ff}]*\z")
    fixed = F.try_validate_utf8(F.encode(F.when(gate, latin).otherwise(F.lit("")), "ISO-8859-1").cast("string"))
    return F.when(gate & fixed.isNotNull(), fixed).otherwise(t)


def repair_forms(text) -> Column:
    """B2 steps 3-5: Latin ligatures, full-width forms and the ideographic space, curly quotes.
    One character-class scan decides; only texts that have such a character pay for the rest."""
    t = _c(text)
    out = t
    for k, v in LIGATURES:
        out = F.replace(out, F.lit(k), F.lit(v))
    full = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "\u3000"
    half = "".join(chr(c) for c in range(0x21, 0x7F)) + " "
    out = F.translate(out, full, half)
    q = SINGLE_QUOTES + DOUBLE_QUOTES
    out = F.translate(out, q, "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES))
    # the same characters as a few ranges; most characters fail the one that encloses them all
    gate = r"[\x{132}-\x{ff5e}&&[\x{132}\x{133}\x{2018}-\x{201f}\x{3000}\x{fb00}-\x{fb06}\x{ff01}-\x{ff5e}]]"
    return F.when(t.rlike(gate), out).otherwise(t)


def repair_breaks(text) -> Column:
    """B2 step 6: line breaks to LF, control characters removed (two scans of a simple class decide)."""
    t = _c(text)
    out = F.regexp_replace(F.regexp_replace(t, r"\r\n|[\r\x{85}\x{2028}\x{2029}]", "\n"), CONTROL_CHARS, "")
    return F.when(t.rlike(r"[\x{0}-\x{1f}&&[^\t\n]]") | t.rlike(r"[\x{7f}-\x{feff}&&[\x{7f}\x{85}\x{2028}\x{2029}\x{feff}]]"), out).otherwise(t)


REPAIR_STEPS = [repair_entities, repair_mojibake, repair_forms, repair_breaks]


def with_steps(df, col: str, steps) -> "DataFrame":  # noqa: F821
    """Apply column steps one at a time behind a one-element ``explode`` barrier.

    A step that reads its input more than once would otherwise be inlined by
    CollapseProject (and by filter pushdown) into a copy of the whole upstream chain per
    reference -- exponential in the number of steps. The Generate node keeps each step
    evaluated exactly once per row and stops later filters from being pushed below it.
    """
    others = [c for c in df.columns if c != col]
    for st in steps:
        df = df.select(*others, F.explode(F.array(st(F.col(col)))).alias(col))
    return df


def repair_text_frame(df, col: str = "text"):
    """B2 on a DataFrame column."""
    return with_steps(df, col, REPAIR_STEPS)


def remove_escapes(text) -> Column:
    """``\\x`` + hex run, then backslash + one ASCII alnum, then U+FFFD (gated by instr)."""
    t = _c(text)
    out = F.replace(F.regexp_replace(F.regexp_replace(t, ESCAPE_HEX, ""), ESCAPE_ANY, ""),
                    F.lit(REPLACEMENT_CHAR), F.lit(""))
    return F.when((F.instr(t, "\\") > 0) | (F.instr(t, REPLACEMENT_CHAR) > 0), out).otherwise(t)


def remove_markers(text) -> Column:
    """Wiki40B markers, one replace per marker, in the fixed order."""
    t = _c(text)
    out = t
    for m in WIKI_MARKERS:
        out = F.replace(out, F.lit(m), F.lit(""))
    return F.when(F.instr(t, "_") > 0, out).otherwise(t)


def cjk_filter(text, lang) -> Column:
    """For ko / ja / zh-cn drop everything but the script block, whitespace and word chars."""
    t, lang = _c(text), _c(lang) if not isinstance(lang, str) else F.lit(lang)
    out = t
    for code in ["ko", "ja", "zh-cn"]:
        pat = f"[^{CJK_KEEP[code]}{WS_CHARS}{WORD_CHARS}]"
        out = F.when(lang == code, F.regexp_replace(t, pat, "")).otherwise(out)
    return out


def clean_steps(lang=None) -> list:
    """B1..B6 in the reference order, as column steps."""
    steps = [force_decode, *REPAIR_STEPS, remove_escapes, remove_markers]
    if lang is not None:
        steps.append(lambda t: cjk_filter(t, lang))
    steps.append(py_strip)
    return steps


def clean_frame(df, col: str = "text", lang=None):
    """B1..B6 applied to ``col`` of ``df``."""
    return with_steps(df, col, clean_steps(lang))


def keep_text(text) -> Column:
    """NOT B7: a string of >= 10 code points after strip with at least one letter."""
    t = _c(text)
    s = py_strip(t)
    return t.isNotNull() & (F.length(s) >= MIN_TEXT_CHARS) & t.rlike(r"\p{L}")


def script_tag(text) -> Column:
    """One character decides; first rule that matches wins."""
    t = _c(text)

    def first_of(rules):
        expr = F.lit("other")
        for tag, pat in reversed(rules):
            expr = F.when(t.rlike(pat), F.lit(tag)).otherwise(expr)
        return expr

    # all rules but the last are about characters from U+0400 on: one scan spares texts without any the others
    return F.when(t.rlike(r"[\x{400}-\x{10ffff}]"), first_of(SCRIPT_RULES)).otherwise(first_of(SCRIPT_RULES[-1:]))


def language_label(text, target_lang: str, detected) -> Column:
    """B11: 'en', the target, or 'unknown'. ``detected`` is the classifier's top language
    (B12) for the text; it is only consulted for Latin-script text."""
    # a text without a character but white space has the tag "other", which no target has
    return let(script_tag(text), lambda tag: label_of_script(tag, target_lang, _c(detected)))


def label_of_script(tag: Column, target_lang: str, det: Column) -> Column:
    """B11 from a text's script tag."""
    tgt = F.lit(target_lang)
    if target_lang in CJK_TARGETS:
        return (F.when(tag == CJK_TARGETS[target_lang], tgt)
                 .when((tag == "lat") & (det == "en"), F.lit("en"))
                 .otherwise(F.lit("unknown")))
    if target_lang in CYRILLIC_TARGETS:
        return (F.when(tag == "cyr", tgt)
                 .when((tag == "lat") & (det == "en"), F.lit("en"))
                 .otherwise(F.lit("unknown")))
    return (F.when((tag == "lat") & (det == "en"), F.lit("en"))
             .when((tag == "lat") & (det == target_lang), tgt)
             .otherwise(F.lit("unknown")))


def language_group(lang) -> Column:
    """Language -> group, ``custom`` when not listed."""
    pairs = []
    for g, langs in LANGUAGE_GROUPS.items():
        for l in langs:
            pairs += [F.lit(l), F.lit(g)]
    return F.coalesce(F.element_at(F.create_map(*pairs), _c(lang)), F.lit("custom"))


def ratio_target_percent(ratio) -> Column:
    """Last ``_`` part of a ratio name as double; NULL when absent or not numeric."""
    r = _c(ratio)
    return F.when(F.instr(r, "_") > 0, F.element_at(F.split(r, "_"), -1).try_cast("double"))


def safe_inverse(x) -> Column:
    """1/x, NULL for NULL or 0."""
    return F.try_divide(F.lit(1.0), _c(x).cast("double"))


def parse_mixture_name(path) -> dict[str, Column]:
    """``mix_{group}_{lang}_{ratio}.txt`` -> group, target_lang, ratio (rest joined by ``_``)."""
    stem = F.regexp_extract(_c(path), r"([^/]*?)(\.[^./]*)?\z", 1)
    parts = F.split(stem, "_")
    ok = stem.startswith("mix_") & (F.size(parts) >= 4)
    rest = F.array_join(F.slice(parts, 4, F.greatest(F.size(parts) - 3, F.lit(0))), "_")
    return {
        "group": F.when(ok, F.element_at(parts, 2)).otherwise(F.lit("unknown")),
        "target_lang": F.when(ok, F.element_at(parts, 3)).otherwise(F.lit("custom")),
        "ratio": F.when(ok, rest).otherwise(F.lit("unknown")),
    }
