"""Column functions that find references in measure expressions.

All patterns are linear: word runs and bracketed names are consumed possessively and as a
whole, so a long text without references costs one pass and no regex recursion.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keywords that may stand directly before a reference.
KEYWORDS = (
    "VAR", "RETURN", "EVALUATE", "ORDER", "BY", "ASC", "DESC",
    "DEFINE", "MEASURE", "COLUMN", "TABLE",
    "TRUE", "FALSE", "BLANK",
    "IN", "NOT", "AND", "OR",
)

# A line starting with one of these ends the expression.
METADATA_LINES = ("lineagetag:", "changedproperty", "formatstring:")

_CUT = r"(?is)(?:^|\n)[ \t\r\f]*(?:" + "|".join(METADATA_LINES) + r").*$"
_QUOTED = r"'(?:[^'\n]|'')*+'"
_STRING = r'"(?:[^"]|"")*+"'
_COMMENT = r"/\*(?s:.*?)\*/|//[^\n]*"
_BRACKET = r"\[[^\]]++\]"
_WORDS = r"(?<!\w)[A-Za-z_]\w*+(?:\s++\w++)*+"

# One token of interest: string literal, quoted name, run of words or bare bracket.
_TOKEN = rf"(?U){_STRING}|'(?:[^']|'')++'(?:\s*+{_BRACKET})?|{_WORDS}(?:\s*+{_BRACKET})?|{_BRACKET}"
_KEYWORD_PREFIX = r"(?is)^(?:.*\s)?(?:" + "|".join(KEYWORDS) + r")(?:\s+|$)"


def cut_metadata(c: Column) -> Column:
    """Drop the metadata lines that follow some expressions, and everything after them."""
    return F.regexp_replace(c, _CUT, "")


def clean_expression(c: Column, dash_comments: bool = False) -> Column:
    """Expression text without trailing metadata lines and without comments.

    Comment marks inside string literals, quoted names and brackets are text, not comments.
    ``--`` starts a comment only with ``dash_comments``.
    """
    kept = rf"(\[[^\]]*+\]|{_QUOTED}|{_STRING})"
    comment = rf"{_COMMENT}|--[^\n]*" if dash_comments else _COMMENT
    return F.regexp_replace(cut_metadata(c), rf"{kept}|{comment}", "$1 ")


def reference_tokens(cleaned: Column) -> Column:
    """Array of the reference tokens of a cleaned expression, in text order."""
    tokens = F.regexp_extract_all(cleaned, F.lit(_TOKEN), F.lit(0))
    return F.filter(tokens, lambda t: t.endswith("]") & ~t.startswith('"'))


def token_table(token: Column) -> Column:
    """Text before the bracket: unquoted table name, or empty for a bare ``[X]``."""
    before = F.trim(F.regexp_replace(token, r"\s*\[[^\]]*\]$", ""))
    quoted = F.replace(F.regexp_extract(before, r"(?s)^'(.*)'$", 1), F.lit("''"), F.lit("'"))
    return F.trim(F.when(before.startswith("'"), quoted).otherwise(before))


def token_field(token: Column) -> Column:
    """Name inside the bracket."""
    return F.trim(F.regexp_extract(token, r"\[([^\]]*)\]$", 1))


def drop_keyword_prefix(table: Column) -> Column:
    """``RETURN Sales`` → ``Sales``; a run that ends in a keyword becomes empty."""
    return F.regexp_replace(table, _KEYWORD_PREFIX, "")


def without_references(cleaned: Column) -> Column:
    """Expression with string literals, quoted names and bracketed references blanked out."""
    qualified = rf"(?U){_STRING}|'(?:[^']|'')++'(?:\s*+{_BRACKET})?|{_WORDS}\s*+{_BRACKET}|{_BRACKET}"
    return F.regexp_replace(cleaned, qualified, " ")


def called_names(cleaned: Column) -> Column:
    """Upper-case names that are followed by an opening parenthesis."""
    before = F.split(cleaned, r"\(")
    # What stands before each parenthesis; the last piece is behind all of them.
    before = F.slice(before, 1, F.size(before) - 1)
    names = F.transform(before, lambda s: F.ltrim(F.regexp_extract(s, r"(?U)([\w.]++)\s*+$", 1), F.lit(".")))
    return F.array_distinct(F.transform(F.filter(names, lambda n: F.regexp_like(n, F.lit("^[A-Za-z_]"))), F.upper))


def declared_variables(cleaned: Column) -> Column:
    """Names declared with ``VAR``."""
    return F.array_distinct(
        F.regexp_extract_all(cleaned, F.lit(r"(?iU)(?<!\w)VAR\s+(\w+)"), F.lit(1))
    )


# Words, single marks and white space: joined again they give back the text.
_PIECE = r"(?U)\w+|\s+|[^\w\s]"


def pieces(c: Column) -> Column:
    """Text split into words, single marks and runs of white space, nothing lost."""
    return F.regexp_extract_all(c, F.lit(_PIECE), F.lit(0))


def piece_class(piece: Column) -> Column:
    """``s`` for white space, ``d`` for a word that starts with a digit, ``w`` word, ``m`` mark."""
    blank = F.trim(F.translate(piece, "\t\n\r", "   ")) == ""
    return (
        F.when(blank, "s")
        .when((piece >= "0") & (piece < ":"), "d")
        .when(F.regexp_like(piece, F.lit(r"(?U)^\w")), "w")
        .when(F.regexp_like(piece, F.lit(r"(?U)^\s")), "s")
        .otherwise("m")
    )


#: A name of ASCII words that does not begin with a digit.
_PLAIN_NAME = r"^(?!\d)[\w ]+$"


def light_references(c: Column) -> Column:
    """Array of ``{table, column}`` of the unquoted references with plain ASCII names only."""
    unquoted = F.filter(reference_tokens(c), lambda t: ~t.startswith("'"))
    named = F.transform(unquoted, lambda t: F.struct(token_table(t).alias("table"), token_field(t).alias("column")))
    return F.filter(named, lambda r: r["table"].rlike(_PLAIN_NAME) & r["column"].rlike(_PLAIN_NAME))
