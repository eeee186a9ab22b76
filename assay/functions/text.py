"""Text columns to term arrays."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a token is a run of two or more word characters.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"

TOKENS_SQL = f"regexp_extract_all(lower(coalesce(%s, '')), r'{TOKEN_PATTERN}', 0)"
BIGRAMS_SQL = (
    "zip_with(slice(%s, 1, greatest(size(%s) - 1, 0)), slice(%s, 2, greatest(size(%s) - 1, 0)), "
    "(a, b) -> concat(a, ' ', b))"
)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def tokens(text: str) -> Column:
    """Lower-cased tokens of a text column in text order; a null text has none."""
    return F.expr(TOKENS_SQL % quoted(text))


def bigrams(words: str) -> Column:
    """Neighbouring tokens of a token column, joined by a space."""
    return F.expr(BIGRAMS_SQL % ((quoted(words),) * 4))


def terms_statement(text: str, n_max: int, output: str) -> str:
    """SQL that adds the tokens of a text column, followed by its bigrams if `n_max` is 2."""
    if n_max not in (1, 2):
        raise ValueError(f"n_max must be 1 or 2, got {n_max}")
    words = TOKENS_SQL % quoted(text)
    if n_max == 1:
        return f"SELECT *, {words} AS {output} FROM __THIS__"
    pairs = BIGRAMS_SQL % (("_words",) * 4)
    return (
        f"SELECT * EXCEPT (_words), concat(_words, {pairs}) AS {output} "
        f"FROM (SELECT *, {words} AS _words FROM __THIS__)"
    )
