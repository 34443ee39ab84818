"""Message normalisation and tokens, as built-in column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Substitution patterns and their placeholders.
DIGITS = (r"(?U)\d+", "<NUM>")
PATHS = (r"(?U)/[\w/]+", "<PATH>")
PREFIXED_IDS = (r"(?U)(user_|session_|txn_|ord_|item_|cache_)\d+", "$1<ID>")
MILLISECONDS = (r"(?U)\d+ms", "<DURATION>ms")
SECONDS = (r"(?U)\d+s", "<DURATION>s")
IP_ADDRESS = (r"(?U)\d+\.\d+\.\d+\.\d+", "<IP>")
EDGE_SPACE = "".join(map(chr, [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))  # (?U)\s
WORD = r"(?U)\w\w+"  # a match takes the whole run, so it needs no word boundaries

# Default stop words: common English function words.  A parameter everywhere;
# pass the list of the vectorizer you want to agree with.
STOP_WORDS = tuple(
    """a about above after again all also am an and any are as at be because been before being below between both
    but by can cannot could did do does doing down during each few for from further had has have having he her here
    hers him his how i if in into is it its itself me more most my no nor not now of off on once only or other our
    ours out over own same she should so some such than that the their theirs them then there these they this those
    through to too under until up very was we were what when where which while who whom why will with would you your
    yours""".split()
)


def _substitute(col: Column, *rules: tuple[str, str]) -> Column:
    for pattern, replacement in rules:
        col = F.regexp_replace(col, pattern, replacement)
    return col


def normalize_message(col: Column | str) -> Column:
    """Message -> template.

    Digits go first, so of all documented substitutions only the digit and the
    path rule can ever match; the effective behaviour is these two.
    """
    col = F.col(col) if isinstance(col, str) else col
    return F.trim(_substitute(F.lower(col), DIGITS, PATHS), F.lit(EDGE_SPACE))


def normalize_message_v2(col: Column | str) -> Column:
    """Opt-in variant in which the specific patterns run before the digit rule."""
    col = F.col(col) if isinstance(col, str) else col
    return F.trim(_substitute(F.lower(col), PREFIXED_IDS, MILLISECONDS, SECONDS, IP_ADDRESS, PATHS, DIGITS), F.lit(EDGE_SPACE))


def words(col: Column | str, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """Lower-case tokens of two or more word characters, stop words removed."""
    col = F.col(col) if isinstance(col, str) else col
    tokens = F.regexp_extract_all(F.lower(col), F.lit(WORD), F.lit(0))
    if not stop_words:
        return tokens
    return F.filter(tokens, lambda t: ~t.isin(*stop_words))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def ngrams(uni: Column) -> Column:
    """Words followed by their bigrams; name the words by a column or ``bind``, they are read several times."""
    bi = F.zip_with(
        F.slice(uni, F.lit(1), F.greatest(F.size(uni) - 1, F.lit(0))),
        F.slice(uni, F.lit(2), F.greatest(F.size(uni) - 1, F.lit(0))),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
    return F.concat(uni, bi)


def tokenize_ngrams(col: Column | str, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """Unigrams followed by bigrams of the remaining tokens."""
    return bind(words(col, stop_words), ngrams)


def first_flags(tokens: Column) -> Column:
    """array of (term, first): the tokens in order, ``first`` at one occurrence of each."""
    def flagged(s):
        before = F.slice(F.concat(F.array(F.lit(None).cast("string")), s), F.lit(1), F.size(s))
        return F.zip_with(s, before, lambda t, p: F.struct(t.alias("term"), (~t.eqNullSafe(p)).alias("first")))

    return bind(F.sort_array(tokens), flagged)


def message_prefix(col: Column | str, n: int = 50) -> Column:
    return F.substring(col, 1, n)
