"""Compression metrics by language slice (E1-E5, B16, B17) and the result row (G1).

Text-side totals (texts, characters, words) are one conditional aggregation over the test
split; token-side totals come from a tokenizer's type-table snapshot. Undefined values are
NULL (``try_divide``), never NaN, so later averages skip them as pandas does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.functions import words

SLICE_SUFFIX = {"all": "", "en": "_en", "target": "_target"}
RESULT_COLUMNS = [
    "method", "vocab_size", "tokenizer_path",
    "tokens_per_char", "tokens_per_word", "avg_token_len", "n_texts", "n_tokens",
    "tokens_per_char_en", "tokens_per_word_en", "avg_token_len_en", "n_texts_en", "n_tokens_en",
    "tokens_per_char_target", "tokens_per_word_target", "avg_token_len_target", "n_texts_target", "n_tokens_target",
    "compression_gap_tokens_per_char", "compression_gap_tokens_per_word",
    "compression_factor_char", "compression_factor_char_en", "compression_factor_char_target",
    "compression_penalty_char",
]
LM_COLUMNS = ["ppl", "eval_loss", "train_loss", "ppl_en", "loss_en", "test_en_blocks", "ppl_target",
              "loss_target", "test_target_blocks", "gap_loss", "train_blocks", "test_blocks"]


def text_stats(split_corpus: DataFrame, target_lang: str, text_col: str = "text") -> DataFrame:
    """Per test slice: texts (blank ones included), characters and words of stripped texts."""
    s = T.py_strip(F.col(text_col))
    test = words.with_word_counts(split_corpus.filter(F.col("split") == "test").select(s.alias("t"), "label"), ["label"], "t")
    conds = {"all": F.lit(True), "en": F.col("label") == "en", "target": F.col("label") == target_lang}
    aggs = []
    for name, c in conds.items():
        nonblank = c & (F.col("n_chars") > 0)
        aggs += [F.count_if(c).alias(f"texts_{name}"),
                 F.sum(F.when(nonblank, F.col("n_chars")).otherwise(0)).cast("long").alias(f"chars_{name}"),
                 F.sum(F.when(nonblank, F.col("n_words")).otherwise(0)).cast("long").alias(f"words_{name}")]
    return test.agg(*aggs)


def compression_columns(tokens: dict[str, F.Column], token_chars: dict[str, F.Column]) -> list[F.Column]:
    """E1-E5 over columns texts_*, chars_*, words_* plus the given token totals per slice."""
    out = []
    tpc = {}
    for name, suf in SLICE_SUFFIX.items():
        chars, words = F.col(f"chars_{name}"), F.col(f"words_{name}")
        ntok, tch = tokens[name], token_chars[name]
        defined = chars > 0
        tpc[name] = F.when(defined, F.try_divide(ntok.cast("double"), chars))
        tpw = F.when(defined, F.try_divide(ntok.cast("double"), F.nullif(words, F.lit(0))))
        atl = F.when(defined, F.try_divide(tch.cast("double"), F.nullif(ntok, F.lit(0))))
        out += [(tpc[name]).alias(f"tokens_per_char{suf}"), (tpw).alias(f"tokens_per_word{suf}"),
                (atl).alias(f"avg_token_len{suf}"),
                F.when(defined, F.col(f"texts_{name}")).otherwise(0).cast("long").alias(f"n_texts{suf}"),
                F.when(defined, ntok).otherwise(0).cast("long").alias(f"n_tokens{suf}")]
    tpw_en = F.when(F.col("chars_en") > 0, F.try_divide(tokens["en"].cast("double"), F.nullif(F.col("words_en"), F.lit(0))))
    tpw_tg = F.when(F.col("chars_target") > 0,
                    F.try_divide(tokens["target"].cast("double"), F.nullif(F.col("words_target"), F.lit(0))))
    f_all, f_en, f_tg = (T.safe_inverse(tpc[k]) for k in ("all", "en", "target"))
    out += [(tpc["target"] - tpc["en"]).alias("compression_gap_tokens_per_char"),
            (tpw_tg - tpw_en).alias("compression_gap_tokens_per_word"),
            (f_all).alias("compression_factor_char"), (f_en).alias("compression_factor_char_en"),
            (f_tg).alias("compression_factor_char_target"), (f_en - f_tg).alias("compression_penalty_char")]
    return out


def result_rows(stats: DataFrame, token_sums: DataFrame, path_prefix: str = "tokenizers") -> DataFrame:
    """Join text stats (1 row) with token sums (method, vocab_size, tokens_*, token_chars_*)
    and project the fixed result columns."""
    tok = {"all": F.col("tokens_test_all"), "en": F.col("tokens_test_en"), "target": F.col("tokens_test_target")}
    tch = {"all": F.col("token_chars_test_all"), "en": F.col("token_chars_test_en"),
           "target": F.col("token_chars_test_target")}
    one = F.lit(1).alias("_one")
    j = token_sums.select("*", one).join(stats.select("*", one), "_one")
    path = F.concat(F.lit(path_prefix + "/"), F.col("method"), F.lit("/vocab_"), F.col("vocab_size").cast("string"),
                    F.lit("/tokenizer.json"))
    return j.select(F.col("method"), F.col("vocab_size").cast("int").alias("vocab_size"), path.alias("tokenizer_path"),
                    *compression_columns(tok, tch))


# ---------------------------------------------------------------------------
# Word-level and character-level tokenizers: vocabulary = specials + the most frequent
# train words (chars); anything else is <unk>. Fully relational, so SQL can check them.
# ---------------------------------------------------------------------------

def lexical_units(types: DataFrame, method: str) -> DataFrame:
    """The type table by unit: the word itself, or each of its characters."""
    if method == "word":
        return types.select(F.col("word").alias("unit"), "*")
    return types.select(F.explode(F.regexp_extract_all("word", F.lit(r"(?s)."), 0)).alias("unit"), "*")


def unit_table(types: DataFrame, method: str) -> DataFrame:
    """(unit, train_freq, test_all_freq, test_en_freq, test_target_freq): a row for each distinct unit. It is read several times, so
    the caller writes it once."""
    return lexical_units(types, method).groupBy("unit").agg(*[F.sum(f"{s}_freq").alias(f"{s}_freq") for s in
                                                              ["train", "test_all", "test_en", "test_target"]])


def ranked_units(units: DataFrame, size: int, n_special: int = 5) -> DataFrame:
    """(unit, rk): the ``size - n_special`` most frequent train units of a ``unit_table``, ties by string; bounded by ``size``."""
    from pyspark.sql import Window

    from glossa.operators.sampling import top_k
    inv = units.filter(F.col("train_freq") > 0).select("unit", F.col("train_freq").alias("uf"))
    top = top_k(inv, [], "uf", "unit", max(int(size) - n_special, 0))
    return top.select("unit", F.row_number().over(Window.orderBy(F.desc("uf"), "unit")).alias("rk"))


def lexical_token_sums(types: DataFrame, vocab_sizes, method: str, n_special: int = 5) -> DataFrame:
    """Slice token totals for ``word`` or ``char`` tokenizers at every vocab size, of a type table."""
    from glossa.session import cut_lineage
    units = cut_lineage(unit_table(types, method))
    return unit_sums(units, ranked_units(units, max(int(v) for v in vocab_sizes), n_special), vocab_sizes, method, n_special)


def unit_sums(units: DataFrame, ranked: DataFrame, vocab_sizes, method: str, n_special: int = 5) -> DataFrame:
    """Slice token totals at every vocab size, in one job over a ``unit_table``.
    The vocabulary is a top-k by train frequency (ties by string), so a rank column decides
    membership for all sizes at once."""
    j = units.join(F.broadcast(ranked.select("unit", "rk")), "unit", "left")
    # every vocabulary size in one aggregate pass, then one row per size
    sizes = sorted(set(int(x) for x in vocab_sizes))
    aggs = []
    for v in sizes:
        known = F.col("rk").isNotNull() & (F.col("rk") <= v - n_special)
        tl = F.when(known, F.length("unit")).otherwise(F.length(F.lit("<unk>")))
        for s_ in ["test_all", "test_en", "test_target"]:
            aggs.append(F.sum(F.col(f"{s_}_freq") * tl).cast("long").alias(f"token_chars_{s_}_{v}"))
    for s_ in ["test_all", "test_en", "test_target"]:
        aggs.append(F.sum(F.col(f"{s_}_freq")).cast("long").alias(f"tokens_{s_}"))
    one = j.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(v).alias("vocab_size"),
                              *[F.col(f"token_chars_{s_}_{v}").alias(f"token_chars_{s_}") for s_ in
                                ["test_all", "test_en", "test_target"]]) for v in sizes])
    return one.select(F.lit(method).alias("method"), F.explode(rows).alias("r"), "tokens_test_all", "tokens_test_en",
                      "tokens_test_target").select(
        "method", "r.vocab_size", "tokens_test_all", "r.token_chars_test_all", "tokens_test_en",
        "r.token_chars_test_en", "tokens_test_target", "r.token_chars_test_target")
