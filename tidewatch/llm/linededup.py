"""Repeated passages, wherever they begin in a line: winnowed fingerprints find them, their places are joined, matches are extended both ways, and later ones go.

Joins of two sides that both grow with the corpus are merge joins at every
size, so that what is measured on a small corpus holds for a large one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import BLANK, NOT_BLANK, content_key
from tidewatch.session import fresh_path, scratch_scope, settle, short_lived_shuffles

MIN_WORDS = 50
RARE_BLANK = r"[\x09\x0B-\x0D]"
ONE_IN, ROUNDS = 4, 5  # of words, how many are candidates for a fingerprint; how often candidates are thinned out
PIECE = rf"{BLANK}*+{NOT_BLANK}++|{BLANK}++"


def _settle_alone(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """Settle what ``make`` returns; the tables that it settles on its way go."""
    path = fresh_path(spark, "settled")
    with scratch_scope(spark):
        made = make()
        made.write.parquet(path)
    return spark.read.schema(made.schema).parquet(path)


def window_shape(min_words: int) -> tuple[int, int]:
    """(span, gram): of ``span`` words in a row one is picked, and the ``gram`` words from it on are a fingerprint; together ``min_words``.

    A fingerprint is half of a run, so that it lies inside every run that picks
    it and short phrases do not share it.
    """
    gram = (min_words + 1) // 2
    return min_words - gram + 1, gram


def _words(text: Column) -> Column:
    """``common.words``; blanks become spaces first, as a split at one plain character needs no pattern."""
    lines = F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(" "))
    plain = F.when(F.rlike(text, F.lit(RARE_BLANK)), F.regexp_replace(lines, RARE_BLANK, " ")).otherwise(lines)
    return F.array_remove(F.split(plain, " "), "")


def winnow(texts: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(_id, _key, marks): each document's fingerprints, an array of (at, mark).

    One word in ``ONE_IN`` is a candidate, by its hash.  Of the first ``span``
    words of each run of ``min_words`` the candidate with the smallest hash (the
    first of equals) is picked, or the run's first word if none is a candidate;
    ``at`` is its place and ``mark`` the hash of the hashes of the ``gram`` words
    from it on.
    What a run picks depends on its words alone, so equal runs pick equal marks
    at equal places.

    A candidate between two smaller ones that no ``span`` words pass by is
    never picked and goes; what decides about the others stays, so a few rounds
    leave hardly more than the picked ones.  Only gaps that held no candidate
    before stay wider than ``span``.
    """
    span, gram = window_shape(min_words)
    at = lambda c: c.bitwiseAND(F.lit(2**32 - 1)).cast("int")  # noqa: E731  places count from 1 here
    code = F.transform("hs", lambda h, i: h.bitwiseAND(F.lit(-(2**32))).bitwiseOR((i + 1).cast("long")))
    coded = texts.select("_id", "_key", _words(F.col("_text")).alias("ws"))
    coded = coded.select("_id", "_key", F.transform("ws", lambda w: F.xxhash64(w)).alias("hs"))
    coded = coded.withColumn("room", F.when(F.size("hs") >= min_words, F.size("hs") - (gram - 1)).otherwise(0))
    low = F.filter(F.slice(code, F.lit(1), F.col("room")), lambda c: c < F.lit(-(2**63) + 2**64 // ONE_IN))
    coded = coded.withColumn("low", F.concat(F.array(F.lit(-(2**63))), low, F.array(F.lit(-(2**63)) + F.col("room") + 1)))

    def needed(c: Column, i: Column) -> Column:
        before, behind = F.get("low", i - 1), F.get("low", i + 1)
        return F.coalesce((before > c) | (behind > c) | (at(behind) - at(before) > span), F.lit(True))

    for _ in range(ROUNDS):
        coded = coded.withColumn("low", F.filter("low", needed))

    def places(c: Column, i: Column) -> Column:
        behind = at(F.get("low", i + 1))
        return F.when(behind - at(c) > span, F.sequence(at(c), behind - span)).otherwise(F.array(at(c)))

    picked = F.filter(F.flatten(F.transform("low", places)), lambda p: (p > 0) & (p <= F.col("room")))
    mark = lambda p: F.struct((p - 1).alias("at"), F.xxhash64(F.slice("hs", p, F.lit(gram))).alias("mark"))
    return coded.select("_id", "_key", F.transform(picked, mark).alias("marks"))


def _place(at: str = "pos") -> Column:
    return F.struct(F.col("_id").isNull().alias("last"), F.col("_id").alias("id"), F.col("_key").alias("key"), F.col(at).alias("at"))


def _by_text(keyed: DataFrame, min_words: int) -> tuple[DataFrame, DataFrame]:
    """(texts, copies): each text once, under its smallest id (null last), and (_id, _key, _n) of the other documents with that text.

    Texts are counted by two independent 64-bit hashes; only those found twice
    or more are taken apart.  A later copy of a text with enough words is one
    repeated run, so it needs no fingerprints.  Rows that agree in id and text
    are rare; only where there are some are texts read once more for them.
    """
    rows = keyed.groupBy(F.col("_key").alias("_k"), F.col("_key2").alias("_k2"), "_id").agg(F.count(F.lit(1)).alias("_rows"))
    again = settle(rows.groupBy("_k", "_k2").agg(F.min("_id").alias("_first"), F.sum("_rows").alias("_sum"), F.max("_rows").alias("_most")).filter("_sum >= 2").drop("_sum"))
    same = (F.col("_key") == F.col("_k")) & (F.col("_key2") == F.col("_k2"))
    repeated, first = keyed.join(again, same), F.col("_id").eqNullSafe(F.col("_first"))
    texts = keyed.join(again, same, "left").filter(F.col("_k").isNull() | (first & (F.col("_most") == 1))).select(*keyed.columns)
    if not again.filter("_most >= 2").isEmpty():
        texts = texts.unionByName(repeated.filter(first & (F.col("_most") >= 2)).dropDuplicates(["_key", "_key2"]).select(*keyed.columns))
    size = F.when(~first, F.size(_words(F.col("_text"))))  # names both sides, else the words of all texts are counted before the join
    return texts, repeated.select("_id", "_key", size.alias("_n")).filter(F.col("_n") >= min_words).distinct()


def _at_words(texts: DataFrame, spots: DataFrame, *cols: str) -> DataFrame:
    """(_id, _key, ws, spots): the words of the documents that have spots, and these as an array of ``cols``."""
    asked = spots.groupBy(F.col("_id").alias("_rid"), F.col("_key").alias("_rkey")).agg(F.collect_list(F.struct(*cols)).alias("spots"))  # at most one per word of the document
    return texts.join(asked.hint("merge"), (F.col("_key") == F.col("_rkey")) & F.col("_id").eqNullSafe(F.col("_rid"))).select("_id", "_key", "spots", _words(F.col("_text")).alias("ws"))


def _sharing(texts: DataFrame, min_words: int) -> tuple[DataFrame, DataFrame]:
    """(held, spots): the texts with marks that are found twice or more, and (_id, _key, at, mark) of these marks.

    All texts are moved once, to the list of documents; what follows moves held texts only.
    """
    spark = texts.sparkSession

    def shared() -> DataFrame:
        every = settle(winnow(texts, min_words)).select("_id", "_key", F.inline("marks"))
        return every.join(every.groupBy("mark").count().filter("count >= 2").select("mark").hint("merge"), "mark", "left_semi").select("_id", "_key", "at", "mark")

    spots = _settle_alone(spark, shared)
    asked = settle(spots.select(F.col("_id").alias("_rid"), F.col("_key").alias("_rkey")).distinct())
    return settle(texts.join(asked.hint("merge"), (F.col("_key") == F.col("_rkey")) & F.col("_id").eqNullSafe(F.col("_rid")), "left_semi").select("_id", "_key", "_text")), spots


def _occurrences(held: DataFrame, spots: DataFrame, min_words: int) -> DataFrame:
    """(_id, _key, at, mark, before, behind, c1, c2): where marks stand that are found twice or more, and the words around them.

    ``before`` and ``behind`` say how many words there are, up to those that a
    run of ``min_words`` around the mark can reach; c1 and c2 are 64-bit hashes
    of those on either side, so that with the mark they identify a context.
    """
    span, gram = window_shape(min_words)

    def around(s: Column) -> Column:
        at, before = s["at"], F.least(s["at"], F.lit(span - 1))
        behind = F.least(F.size("ws") - gram - at, F.lit(span - 1))
        left, right = F.slice("ws", at - before + 1, before), F.slice("ws", at + gram + 1, behind)
        return F.struct(at.alias("at"), s["mark"].alias("mark"), before.alias("before"), behind.alias("behind"), F.xxhash64(before, left).alias("c1"), F.xxhash64(behind, right).alias("c2"))

    return _at_words(held, spots, "at", "mark").select("_id", "_key", F.inline_outer(F.transform("spots", around)))


def _contexts(texts: DataFrame, leads: DataFrame, min_words: int) -> DataFrame:
    """(_id, _key, at, mark, main, many, check, left, right): the words around each mark that stands in two contexts or more.

    A context is given once, at its first place.  ``left`` (nearest word first)
    and ``right`` hold its words, ``check`` is a second hash of the mark's own,
    ``main`` says which context of the mark has most places (of equals the
    first), and ``many`` that there are more than two.
    """
    span, gram = window_shape(min_words)
    rank = F.struct((-F.col("places")).alias("less"), "lead")
    several = leads.groupBy("mark").agg(F.min(rank)["lead"].alias("_main"), F.count(F.lit(1)).alias("_n")).filter("_n >= 2")
    spots = leads.join(several.hint("merge"), "mark").select(
        F.col("lead.id").alias("_id"), F.col("lead.key").alias("_key"), F.col("lead.at").alias("at"), "mark", (F.col("lead") == F.col("_main")).alias("main"), (F.col("_n") > 2).alias("many"))

    def around(s: Column) -> Column:
        at, before = s["at"], F.least(s["at"], F.lit(span - 1))
        check, behind = F.xxhash64(F.lit(7), F.slice("ws", at + 1, F.lit(gram))), F.least(F.size("ws") - gram - at, F.lit(span - 1))
        left, right = F.array_join(F.reverse(F.slice("ws", at - before + 1, before)), " "), F.array_join(F.slice("ws", at + gram + 1, behind), " ")
        return F.struct(*[s[c].alias(c) for c in ("at", "mark", "main", "many")], check.alias("check"), left.alias("left"), right.alias("right"))

    return _at_words(texts, spots, "at", "mark", "main", "many").select("_id", "_key", F.inline_outer(F.transform("spots", around)))


def _list(text: str) -> Column:
    """Words of a joined string."""
    return F.when(F.col(text) == "", F.array().cast("array<string>")).otherwise(F.split(text, " "))


def _agreed(a: str, b: str) -> Column:
    """How many words two joined strings share from their beginnings on."""
    same = F.zip_with(F.split(a, " "), F.split(b, " "), lambda x, y: F.coalesce(x == y, F.lit(False)))
    upto = F.array_position(F.concat(same, F.array(F.lit(False))), False) - 1
    whole = F.length(a) - F.length(F.replace(F.col(a), F.lit(" "))) + 1
    return F.when((F.col(a) == "") | (F.col(b) == ""), 0).when(F.col(a) == F.col(b), whole).otherwise(upto).cast("int")


def _extended(contexts: DataFrame) -> DataFrame:
    """The contexts with ``l`` and ``r``: how far the words agree to the left and right with the mark's main context (-1: nowhere)."""
    main = contexts.filter("main").select(F.col("mark").alias("_mark"), F.col("check").alias("_check"), F.col("left").alias("_left"), F.col("right").alias("_right"))
    pairs = contexts.join(main.hint("merge"), F.col("mark") == F.col("_mark"))
    reach = lambda a, b: F.when(F.col("check") == F.col("_check"), _agreed(a, b)).otherwise(-1)
    side = lambda c: F.when(F.col("many") & ~F.col("main"), F.col(c)).alias(c)
    return pairs.select("_id", "_key", "at", "mark", "check", "main", "many", side("left"), side("right"), reach("left", "_left").alias("l"), reach("right", "_right").alias("r"))


def _agreeing(extended: DataFrame, min_words: int) -> DataFrame:
    """(_id, _key, pos, end): what repeats an earlier place among the runs that agree with their mark's main context.

    A run is named by its mark and the number d of words before it.  A context
    has those with d from span - 1 - r to l, so the first place of each d
    follows from the first place of each (l, r), of which a mark has at most
    span * span.  Runs around one mark overlap, so those that go are one stretch.
    Places of one mark are told apart by a 64-bit hash.
    """
    span, _ = window_shape(min_words)
    most = span - 1
    fits = extended.filter(F.col("l") + F.col("r") >= most).select("_id", "_key", "at", "mark", "l", "r")
    tops = fits.groupBy("mark", "l", "r").agg(F.min(_place("at")).alias("place"))
    listed = tops.groupBy("mark").agg(F.collect_list(F.struct("l", "r", "place")).alias("tops"))
    first = lambda d: F.array_min(F.transform(F.filter("tops", lambda x: (x["l"] >= d) & (x["r"] >= most - d)), lambda x: x["place"]))
    firsts = listed.select(F.col("mark").alias("_mark"), F.transform(F.sequence(F.lit(0), F.lit(most)), lambda d: F.xxhash64(first(d))).alias("firsts"))
    own = F.sequence(F.greatest(F.lit(most) - F.col("r"), F.lit(0)), F.least(F.col("l"), F.lit(most)))
    later = fits.join(firsts.hint("merge"), F.col("mark") == F.col("_mark")).withColumn("_place", F.xxhash64(_place("at")))
    later = later.withColumn("ds", F.filter(own, lambda d: F.get("firsts", d) != F.col("_place")))
    later = later.select("_id", "_key", "at", F.inline_outer(F.array(F.struct(F.array_max("ds").alias("high"), F.array_min("ds").alias("low"))))).filter(F.col("low").isNotNull())
    return later.select("_id", "_key", (F.col("at") - F.col("high")).alias("pos"), (F.col("at") - F.col("low") + (min_words - 1)).alias("end"))


def _others(extended: DataFrame, min_words: int) -> DataFrame:
    """(_id, _key, pos, g1, g2): runs of ``min_words`` around a mark that do not stand in its main context, and may in two others.

    Equal runs agree with the main context equally far, so they all are here or
    none is.  A run with d words before its mark goes on beyond what agrees to
    the left (d > l) or to the right, and has half of a span's words on one
    side at least.  In each of these four cases its runs share a stretch
    of words around the mark, the one beyond what agrees included; where no
    other place has that stretch, they are never made.  g1 and g2 identify a run.
    """
    span, _ = window_shape(min_words)
    half = span // 2
    rows = extended.filter("many AND NOT main").drop("many", "main")
    listed = lambda df: df.withColumn("lw", _list("left")).withColumn("rw", _list("right")).drop("left", "right")
    l, r, zero = F.col("l"), F.col("r"), F.lit(0)
    least, most = F.greatest(F.lit(span - 1) - F.size("rw"), zero), F.size("lw")  # what the text has room for

    def case(name: str, low: Column, high: Column, left: Column, right: Column) -> Column:
        code = F.xxhash64("mark", "check", F.lit(name), F.slice("lw", F.lit(1), left), F.slice("rw", F.lit(1), right))
        return F.when(low <= high, F.struct(low.alias("low"), high.alias("high"), code.alias("code")))

    cases = F.array(
        case("left, mostly before", F.greatest(l + 1, F.lit(half), least), most, F.greatest(l + 1, F.lit(half)), zero),
        case("left, mostly behind", F.greatest(l + 1, least), F.least(F.lit(half - 1), most), l + 1, F.lit(span - half)),
        case("right, mostly before", F.greatest(F.lit(half), least), F.least(l, F.lit(span - 2) - r), F.lit(half), r + 1),
        case("right, mostly behind", least, F.least(l, F.lit(half - 1), F.lit(span - 2) - r), zero, F.greatest(r + 1, F.lit(span - half))))
    sides = settle(listed(rows).select("_id", "_key", "at", F.explode_outer(cases).alias("s")).select("_id", "_key", "at", "s.*").filter(F.col("code").isNotNull()))
    twice = sides.groupBy("code").count().filter("count >= 2").select("code")
    live = sides.join(twice.hint("merge"), "code", "left_semi").select(F.col("_id").alias("_lid"), F.col("_key").alias("_lkey"), F.col("at").alias("_lat"), "low", "high")
    d = F.col("d")  # words of the run before its mark
    parts = ["mark", "check", d, F.slice("lw", F.lit(1), d), F.slice("rw", F.lit(1), F.lit(span - 1) - d)]
    here = (F.col("_key") == F.col("_lkey")) & (F.col("at") == F.col("_lat")) & F.col("_id").eqNullSafe(F.col("_lid"))
    runs = listed(rows.join(live.hint("merge"), here)).withColumn("d", F.explode(F.sequence("low", "high")))
    return runs.select("_id", "_key", (F.col("at") - d).alias("pos"), F.xxhash64(*parts).alias("g1"), F.xxhash64(F.lit(7), *parts).alias("g2"))


def _later(runs: DataFrame, min_words: int) -> DataFrame:
    """(_id, _key, pos, end) of the runs whose content also stands at an earlier place."""
    firsts = runs.groupBy("g1", "g2").agg(F.min(_place()).alias("first"), F.count(F.lit(1)).alias("n")).filter("n >= 2").drop("n")
    return runs.join(firsts.hint("merge"), ["g1", "g2"]).filter(_place() != F.col("first")).select("_id", "_key", "pos", (F.col("pos") + (min_words - 1)).alias("end"))


def _merged(later: DataFrame) -> DataFrame:
    """(_id, _key, runs): the words that the rows cover, as maximal runs [first, last] in order."""
    doc = Window.partitionBy("_id", "_key").orderBy("pos")
    reach = F.max("end").over(doc.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce((F.col("pos") > F.col("_reach") + 1).cast("int"), F.lit(1))
    joined = later.withColumn("_reach", reach).withColumn("_run", F.sum(fresh).over(doc))
    runs = joined.groupBy("_id", "_key", "_run").agg(F.min("pos").alias("first"), F.max("end").alias("last"))
    return runs.groupBy("_id", "_key").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"))  # at most one per word of the document


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(_id, _key, runs): for each document the words [first, last] of passages that repeat an earlier one of ``min_words`` words or more.

    Places are ordered by doc_id (null last), text key and word.  Places of a
    mark with equal words all around are one context and repeat the first of
    them.  Each context is compared, word by word both ways, with the mark's
    main one, that of most places; of what agrees, all but the first place is
    a repeat.  Runs that do not stand in the main context, but may in two
    others, are compared by their content.  So a repeat is found whichever two
    documents share it.
    """
    span, gram = window_shape(min_words)
    keyed = docs.select(F.col(f"`{doc_id}`").alias("_id"), content_key(F.col(f"`{text}`")).alias("_key"), F.xxhash64(F.lit(7), F.col(f"`{text}`")).alias("_key2"), F.col(f"`{text}`").alias("_text"))
    spark = docs.sparkSession
    with short_lived_shuffles(spark):
        texts, copies = _by_text(keyed, min_words)
        held, spots = _sharing(texts, min_words)
        found = settle(_occurrences(held, spots, min_words))
        leads = settle(found.groupBy("mark", "c1", "c2").agg(F.min(_place("at")).alias("lead"), F.count(F.lit(1)).alias("places")))
        equal = found.filter(F.col("before") + gram + F.col("behind") >= min_words).join(leads.filter("places >= 2").hint("merge"), ["mark", "c1", "c2"])
        equal = equal.filter(_place("at") != F.col("lead")).select("_id", "_key", (F.col("at") - F.col("before")).alias("pos"), (F.col("at") + (gram - 1) + F.col("behind")).alias("end"))
        extended = _settle_alone(spark, lambda: _extended(settle(_contexts(held, leads, min_words))))
        others = _settle_alone(spark, lambda: _others(extended, min_words))
        runs = _merged(equal.unionByName(_agreeing(extended, min_words)).unionByName(_later(others, min_words)))
        whole = copies.select("_id", "_key", F.array(F.struct(F.lit(0).alias("first"), (F.col("_n") - 1).alias("last"))).alias("runs"))
        return settle(runs.unionByName(whole))


def dedup_passages(docs: DataFrame, columns: Sequence[str] | None = None, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``columns`` of the documents (default: all) with the later occurrences of repeated passages cut out of ``text``, and ``removed_words``.

    A word is cut where it lies in a run of ``min_words`` words or more that
    also stands at an earlier place, wherever lines begin or end.  The white
    space before a word goes with it.  The first occurrence (by doc_id, null
    last) stays, so a later exact copy loses its words and keeps its row.  A
    null text stays null; a text without a repeat is returned unchanged; rows
    that agree in doc_id and text count as one document and get the same text;
    a column ``removed_words`` is replaced.
    """
    columns = [c for c in (docs.columns if columns is None else columns) if c != "removed_words"]
    runs = repeated_passages(docs, min_words, doc_id, text).select(F.col("_id").alias("_rid"), F.col("_key").alias("_rkey"), "runs")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(f"`{text}`").alias("_text"), F.col(f"`{doc_id}`").alias("_id"), content_key(F.col(f"`{text}`")).alias("_key"))
    joined = keyed.join(runs.hint("merge"), (F.col("_key") == F.col("_rkey")) & F.col("_id").eqNullSafe(F.col("_rid")), "left")
    # A piece is a word after its white space; white space at the end of the text is one more.
    cut = joined.withColumn("_pieces", F.when(F.col("runs").isNotNull(), F.regexp_extract_all("_text", F.lit(PIECE), F.lit(0))))
    begins = F.concat(F.array(F.lit(0)), F.transform("runs", lambda r: r["last"] + 1))
    ends = F.concat(F.transform("runs", lambda r: r["first"]), F.array(F.size("_pieces")))
    kept = F.flatten(F.zip_with(begins, ends, lambda a, b: F.slice("_pieces", a + 1, b - a)))
    cleaned = F.when(F.col("runs").isNull(), F.col("_text")).otherwise(F.array_join(kept, ""))
    size = F.aggregate("runs", F.lit(0), lambda n, r: n + r["last"] - r["first"] + 1)
    out = [cleaned.alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in columns]
    return cut.select(*out, F.coalesce(size, F.lit(0)).cast("long").alias("removed_words"))
