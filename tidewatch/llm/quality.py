"""Quality rules: counts of whole texts, and the distance of their histograms from those of their language."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import BLANK, NOT_BLANK, words
from tidewatch.session import settle

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED = 20  # per cent of the words

#: Frequent function words by language (fixed values).
COMMON_WORDS: dict[str, tuple[str, ...]] = {
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "with", "be", "by", "on", "are", "was", "this", "from", "or"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "sur", "pas", "au", "plus"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es", "al"),
}
#: Character classes, each counted in what the ones before it have left over.
CLASSES = (("lower", "[a-z]+"), ("blank", BLANK + "+"), ("upper", "[A-Z]+"), ("letter", r"\p{L}+"), ("digit", r"\p{N}+"), ("stop", r"[.,;:!?'\"()\-]+"))

#: A text is judged by its characters from so many characters on, by its common words from so many words on.
LEAST_CHARS, LEAST_COMMON = 200, 60
#: Largest Jensen-Shannon distances (0 to 1) from the language: of the characters, of the common words, and both added.
MOST_CHAR_DISTANCE, MOST_WORD_DISTANCE, MOST_SUM = 0.25, 0.45, 0.42


def _one_of(known: Sequence[str]):
    return lambda w: w.isin(*known)


def repeated_words(df: DataFrame, w: str, out: str) -> DataFrame:
    """Add ``out``: how many words of the array ``w`` lie in a window of five words that occurs twice or more in it.

    Hashes of all windows are compared first; a text in which all differ has
    no repeats.  Only the others sort their windows themselves.
    """
    at = lambda i, k: F.get(F.col(w), i + k)
    starts = F.sequence(F.lit(0), F.size(w) - WINDOW)
    hashed = F.when(F.size(w) > WINDOW, F.transform(starts, lambda i: F.xxhash64(*[at(i, k) for k in range(WINDOW)])))
    df = df.withColumn("_hashes", hashed).withColumn("_again", F.coalesce(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), F.lit(False))).drop("_hashes")
    grams = F.transform(starts, lambda i: F.struct(F.concat_ws(" ", *[at(i, k) for k in range(WINDOW)]).alias("g"), i.alias("i")))
    df = df.withColumn("_sorted", F.when(F.col("_again"), F.sort_array(grams)))
    gram = lambda j: F.get(F.col("_sorted"), j)["g"]
    twice = F.filter(F.sequence(F.lit(0), F.size("_sorted") - 1), lambda j: F.coalesce(gram(j) == gram(j - 1), F.lit(False)) | F.coalesce(gram(j) == gram(j + 1), F.lit(False)))
    df = df.withColumn("_twice", F.when(F.col("_again"), twice))
    df = df.withColumn("_starts", F.when(F.col("_again"), F.sort_array(F.transform("_twice", lambda j: F.get(F.col("_sorted"), j)["i"]))))
    here = lambda k: F.get(F.col("_starts"), k)
    covered = F.aggregate(
        F.sequence(F.lit(0), F.size("_starts") - 1), F.lit(0).cast("long"),
        lambda n, k: n + F.least(F.lit(WINDOW), F.coalesce(here(k + 1) - here(k), F.lit(WINDOW))).cast("long"))
    counted = F.when(F.col("_again") & (F.size("_starts") > 0), covered).otherwise(F.lit(0).cast("long"))
    return df.withColumn(out, counted).drop("_again", "_sorted", "_twice", "_starts")


def measure(docs: DataFrame, columns: Sequence[str], text: str = "text", lang: str = "lang", common: Mapping[str, Sequence[str]] = COMMON_WORDS) -> DataFrame:
    """The given columns as a struct ``row``, n_words and the base counts, and the histograms ``_chars`` and ``_common`` of each whole text."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), body.alias("_text"), F.col(f"`{lang}`").alias("_lang"))
    df = df.withColumn("_left0", F.col("_text"))
    for k, (name, pattern) in enumerate(CLASSES):
        df = df.withColumn(f"_left{k + 1}", F.regexp_replace(f"_left{k}", pattern, ""))
        df = df.withColumn(f"_n_{name}", F.length(f"_left{k}") - F.length(f"_left{k + 1}")).drop(f"_left{k}")
    last = f"_left{len(CLASSES)}"
    df = df.withColumn("n_symbols", (F.length(last) - F.length(F.regexp_replace(last, SYMBOLS, ""))).cast("long")).withColumn("_n_other", F.length(last)).drop(last)
    counts = [*[f"_n_{name}" for name, _ in CLASSES], "_n_other"]
    df = df.withColumn("word_chars", (F.length("_text") - F.col("_n_blank")).cast("long")).withColumn("_chars", F.array(*counts)).drop(*counts)
    lines = F.filter(F.split("_text", "\n", -1), lambda line: line.rlike(NOT_BLANK))
    df = df.withColumn("_lines", lines).withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).drop("_lines")
    df = df.withColumn("_words", words(F.col("_text"))).drop("_text").withColumn("n_words", F.size("_words").cast("long"))
    hits = histogram = None
    for code, known in common.items():
        is_lang, found = F.col("_lang") == code, F.filter("_words", _one_of(known))
        bins = F.array(*[F.size("_hits") - F.size(F.array_remove("_hits", w)) for w in known])
        hits = F.when(is_lang, found) if hits is None else hits.when(is_lang, found)
        histogram = F.when(is_lang, bins) if histogram is None else histogram.when(is_lang, bins)
    df = df.withColumn("_hits", hits).withColumn("_common", F.concat(histogram, F.array(F.size("_words") - F.size("_hits")))).drop("_hits")
    return repeated_words(df, "_words", "n_repeat_words").drop("_words")


def share(counts: str) -> Column:
    """Counts -> shares; null where there is nothing."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.transform(counts, lambda x: x / total))


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence with base 2: 0 for equal distributions, 1 for disjoint ones."""
    bits = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    terms = F.zip_with(p, q, lambda a, b: (bits(a, (a + b) / 2) + bits(b, (a + b) / 2)) / 2)
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x), F.lit(0.0)))


def language_references(measured: DataFrame, classes: int, bins: int) -> DataFrame:
    """(lang, chars, common): the mean shares over all texts of a language that pass the base rules and are long enough to count."""
    long_chars = F.col("word_chars") >= LEAST_CHARS
    long_words = F.col("n_words") >= LEAST_COMMON
    mean = lambda col, k, ok: F.avg(F.when(ok, F.get(F.col(col), F.lit(k))))
    return (
        measured.filter(~F.col("base_failed") & F.col("_lang").isNotNull()).groupBy("_lang")
        .agg(*[mean("_chars", k, long_chars).alias(f"c{k}") for k in range(classes)], *[mean("_common", k, long_words).alias(f"w{k}") for k in range(bins)])
        .select(F.col("_lang").alias("_ref"), F.array(*[f"c{k}" for k in range(classes)]).alias("_ref_chars"), F.array(*[f"w{k}" for k in range(bins)]).alias("_ref_common")))


def judge_quality(docs: DataFrame, columns: Sequence[str] | None = None, text: str = "text", lang: str = "lang",
                  common: Mapping[str, Sequence[str]] = COMMON_WORDS) -> DataFrame:
    """``columns`` of the documents (default: all), then n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, char_distance, word_distance and kept.

    The base rules fail a text with under 10 words, or with over 20 per cent
    of its words in windows of five words that it repeats.  The others are
    held against the references of their language, which are means over the
    whole corpus: a text falls where the Jensen-Shannon distance of its
    character classes is above 0.25, that of its common words above 0.45 or
    their sum above 0.42 (``MOST_...``).
    Short texts say little, so the characters count from 200 word characters
    on and the words from 60 words on.

    A null text counts as empty (and fails); a null or unknown language has no
    reference for what it lacks, so only the base rules (and, for an unknown
    one, its characters) speak; repeated rows get the same verdict; columns of
    the same names are replaced.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept"]
    columns = [c for c in (docs.columns if columns is None else columns) if c not in added]
    measured = measure(docs, columns, text, lang, common)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    measured = settle(
        measured.withColumn("base_failed", failed).withColumn("_chars", share("_chars")).withColumn("_common", share("_common")))
    bins = max(len(known) for known in common.values()) + 1
    references = settle(language_references(measured, len(CLASSES) + 1, bins))
    judged = measured.join(references, F.col("_lang") == F.col("_ref"), "left")
    far = lambda p, q, ok: F.when(ok & F.col(p).isNotNull() & F.get(F.col(q), F.lit(0)).isNotNull(), js_distance(F.col(p), F.col(q)))
    judged = judged.withColumn("char_distance", far("_chars", "_ref_chars", F.col("word_chars") >= LEAST_CHARS))
    judged = judged.withColumn("word_distance", far("_common", "_ref_common", F.col("n_words") >= LEAST_COMMON))
    char, word = F.coalesce("char_distance", F.lit(0.0)), F.coalesce("word_distance", F.lit(0.0))
    near = (char <= MOST_CHAR_DISTANCE) & (word <= MOST_WORD_DISTANCE) & (char + word <= MOST_SUM)
    judged = judged.withColumn("kept", ~F.col("base_failed") & near)
    return judged.select(*[F.col(f"row.`{c}`").alias(c) for c in columns], *added)
