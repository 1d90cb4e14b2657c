"""Whole-text statistics with built-in functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, hidden, words_of

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def with_text_stats(df: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """df with the columns STATS (long), each under prefix + name; columns of df with such a name are replaced.

    n_words: words [^\\x20\\x09-\\x0D]+; word_chars: code points in words; n_symbols: characters of SYMBOLS; n_dup_lines:
    lines (split at \\n) with a word that equal an earlier line; n_repeat_words: words inside 3-word windows that the
    text holds twice or more. A null text has none of them. Windows are compared by 64-bit hash inside one text.
    """
    w, t, lines, tri, order, pos = hidden(df, "w", "t", "lines", "tri", "order", "pos")
    filled = F.coalesce(F.col(text), F.lit(""))
    n = F.size(w)
    df = df.withColumns({w: words_of(F.col(text)), t: filled, lines: F.filter(F.split(filled, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")})
    df = df.withColumn(tri, F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))))
    repeats = F.size(F.array_distinct(tri)) < F.size(tri)
    df = df.withColumn(order, F.when(repeats, F.sort_array(F.transform(tri, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    at = lambda i: F.get(order, i)["h"]
    same = lambda x, i: F.coalesce(x["h"] == at(i + 1), F.lit(False)) | F.coalesce(F.when(i > 0, x["h"] == at(i - 1)), F.lit(False))
    df = df.withColumn(pos, F.sort_array(F.transform(F.filter(order, same), lambda x: x["i"])))
    covered = F.aggregate(F.sequence(F.lit(0), F.size(pos) - 1), F.lit(0), lambda acc, i: acc + F.least(F.lit(3), F.when(i == 0, 3).otherwise(F.get(pos, i) - F.get(pos, i - 1))))
    values = (n, F.char_length(F.translate(t, WHITE, "")), F.char_length(t) - F.char_length(F.translate(t, SYMBOLS, "")), F.size(lines) - F.size(F.array_distinct(lines)), F.when(F.size(pos) > 0, covered).otherwise(0))
    return df.withColumns({prefix + k: v.cast("long") for k, v in zip(STATS, values, strict=True)}).drop(w, t, lines, tri, order, pos)
