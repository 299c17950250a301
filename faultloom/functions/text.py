"""Identifier-aware tokenising, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keywords dropped by language, stop words, and what the similarity ignores.
KEYWORDS = {
    "java": [
        "abstract", "assert", "boolean", "break", "byte", "case", "catch", "char", "class", "const", "continue", "default",
        "do", "double", "else", "enum", "extends", "final", "finally", "float", "for", "goto", "if", "implements", "import",
        "instanceof", "int", "interface", "long", "native", "new", "package", "private", "protected", "public", "return",
        "short", "static", "strictfp", "super", "switch", "synchronized", "this", "throw", "throws", "transient", "try", "void",
        "volatile", "while",
    ],
    "go": [
        "break", "default", "func", "interface", "select", "case", "defer", "go", "map", "struct", "chan", "else", "goto",
        "package", "switch", "const", "fallthrough", "if", "range", "type", "continue", "for", "import", "return", "var",
    ],
    "javascript": [
        "break", "case", "catch", "class", "const", "continue", "debugger", "default", "delete", "do", "else", "export",
        "extends", "finally", "for", "function", "if", "import", "in", "instanceof", "let", "new", "return", "super", "switch",
        "this", "throw", "try", "typeof", "var", "void", "while", "with", "yield",
    ],
}
#: English function words (our own pinned list; the oracle uses the same one).
STOP_WORDS = [
    "i", "me", "my", "we", "our", "ours", "you", "your", "yours", "he", "him", "his", "she", "her", "hers", "it", "its", "they",
    "them", "their", "theirs", "what", "which", "who", "whom", "this", "that", "these", "those", "am", "is", "are", "was",
    "were", "be", "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but",
    "if", "or", "because", "as", "until", "while", "of", "at", "by", "for", "with", "about", "against", "between", "into",
    "through", "during", "before", "after", "above", "below", "to", "from", "up", "down", "in", "out", "on", "off", "over",
    "under", "again", "further", "then", "once", "here", "there", "when", "where", "why", "how", "all", "any", "both", "each",
    "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very",
    "can", "will", "just", "should", "now",
]
SIMILARITY_STOP_WORDS = ["public", "class", "void", "new", "if", "else", "for", "while", "return"]
SEGMENT_SIZE = 800
CAMEL = r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])"


def keyword_pattern(language: str) -> str:
    """Whole words that are keywords in any case; lower-casing also folds the Kelvin sign."""
    listed = "|".join(w.replace("k", "[k\u212a]") for w in KEYWORDS[language])
    return rf"(?U)\b(?i-u:{listed})\b"


def tokens(text: Column, language: str = "java", distinct: bool = True) -> Column:
    """Words, less keywords, split at ``_`` and at case changes, lower, less stop words.

    A part of a word by ``CAMEL`` never spans words or ``_``, so parts are taken from the
    whole text at once.
    """
    text = F.coalesce(text, F.lit(""))
    if language in KEYWORDS:
        text = F.regexp_replace(text, keyword_pattern(language), " ")
    parts = F.regexp_extract_all(text, F.lit(CAMEL), F.lit(0))
    lower = F.split(F.lower(F.array_join(F.array_distinct(parts) if distinct else parts, " ")), " ")
    dropped = ["", *STOP_WORDS]  # no parts give one empty word
    return F.array_except(lower, F.array(*map(F.lit, dropped))) if distinct else F.filter(lower, lambda w: ~w.isin(dropped))


def similarity_tokens(token_array: Column) -> Column:
    """The tokens that count for similarity: two characters or more, not structural."""
    return F.filter(token_array, lambda w: (F.length(w) >= 2) & ~w.isin(SIMILARITY_STOP_WORDS))


def segments(df: DataFrame, tokens_col: str = "tokens", size: int = SEGMENT_SIZE) -> DataFrame:
    """One row per run of ``size`` tokens with ``segment_no``; no row for no tokens."""
    n = F.ceil(F.size(tokens_col) / F.lit(size)).cast("int")
    parts = F.when(F.size(tokens_col) > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(tokens_col, i * size + 1, F.lit(size))))
    return df.select("*", F.posexplode(parts).alias("segment_no", "__segment")).drop(tokens_col).withColumnRenamed("__segment", tokens_col)


def without_comments(code: Column) -> Column:
    """Java code less ``//`` and ``/* */`` comments."""
    return F.regexp_replace(F.regexp_replace(code, r"//[^\n]*", ""), r"(?s)/\*.*?\*/", "")


def report_text(summary: Column, description: Column) -> Column:
    return F.concat_ws(" ", F.coalesce(summary, F.lit("")), F.coalesce(description, F.lit("")))
