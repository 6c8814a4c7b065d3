"""Personal data found by pattern, and the terms that give it away.

A protected entity (an e-mail address, IP address, card or telephone number) is
found by pattern. A term that occurs with one entity far more often than chance
still points at it when the entity itself is masked. How much it discloses is
measured over the whole corpus: the share of the term's rows that hold the entity, at
its lower confidence bound, so few rows weigh less and none are left out. The measure does
not depend on how many other rows there are; where the entity is
about as frequent as that in all rows, the term says nothing. Such
terms are generalised or, above a second threshold, removed. Built-in functions
only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialised
from .located import SPAN, Kind, locate, outside, replaced

# Standard errors of the lower bound: one-sided, 95 %.
BOUND = 1.6449
# Reached by a term with the entity in three of three rows, or four of five, but not in one of one or two of two.
GENERALISE_AT = 0.43
# Seven of seven rows.
REMOVE_AT = 0.7
# A share of rows must be so many times the entity's share of all rows.
LIFT = 2.0
# Terms are words of letters and digits, with a letter first.
TERM = r"\p{L}[\p{L}\p{N}]*+"
# Frequent terms that disclose nothing and are kept out of the join with all documents.
USUAL = 20_000


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def value(i: Column) -> Column:
        digit = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        doubled = digit * 2
        return F.when(i % 2 == 1, digit).otherwise(F.when(doubled > 9, doubled - 9).otherwise(doubled))

    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + value(i))
    return total % 10 == 0


def _card(found: Column) -> Column:
    digits = _digits(found)
    return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)


_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

# The leftmost matches of the plain patterns, written so that no text takes more than linear time: a run is entered at
# its start (or where the last match ended) and never given back.
KINDS = [
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda m: F.lit(True)),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda m: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")),
    Kind("card", r"[0-9](?:[\x20-]?+[0-9])++", _card),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: F.length(_digits(m)).between(9, 15)),
]
_TERM = Kind("term", TERM, lambda m: F.lit(True))


def _entity(span: Column) -> Column:
    plain = F.when(span["kind"].isin("card", "phone"), _digits(span["found"])).otherwise(F.lower(span["found"]))
    return F.concat_ws(":", span["kind"], plain)


def _hashes(text: Column) -> Column:
    """Hash of each different term."""
    terms = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))
    return F.transform(terms, lambda t: F.xxhash64(t))


def _at_least(part: Column, whole: Column, z: float) -> Column:
    """Lower confidence bound of the share ``part / whole`` (Wilson)."""
    share = part / whole
    middle = share + z * z / (2 * whole)
    return (middle - z * F.sqrt(share * (1 - share) / whole + z * z / (4 * whole * whole))) / (1 + z * z / whole)


def term_rows(docs: DataFrame) -> DataFrame:
    """``hash, n_term``: rows of ``docs`` that hold each term; the shuffle carries partial counts."""
    return docs.select(F.explode(_hashes(F.col("text"))).alias("hash")).groupBy("hash").agg(F.count("*").alias("n_term"))


def disclosing_terms(holders: DataFrame, spread: DataFrame, rows: int, at: float = GENERALISE_AT,
                     bound: float = BOUND, everywhere: bool = False) -> DataFrame:
    """``k1, k2, hash, disclosure``: the terms of each text that give away an entity it holds, by hash.

    ``hash, disclosure`` if ``everywhere``: the terms that give away an entity of any text.
    ``holders(k1, k2, copies, text, spans)`` are the different texts with
    entities, ``spread`` the rows of each term out of ``rows``. Everything is
    counted in rows, so copies weigh.
    """
    held = holders.select("k1", "k2", "copies", F.explode(F.array_distinct(F.transform("spans", _entity))).alias("entity"))
    counted = held.groupBy("entity").agg(F.count("*").alias("texts"), F.sum("copies").alias("n_entity"))
    held = materialised(held.join(counted, "entity"), "held")
    # Entities of one text only are all met by its terms in the same rows, so one of them stands for all.
    held = held.withColumn("entity", F.when(F.col("texts") > 1, F.col("entity"))).dropDuplicates(["k1", "k2", "entity"])
    words = materialised(holders.select("k1", "k2", F.explode(_hashes(F.col("text"))).alias("hash")), "words")
    pairs = held.join(words, ["k1", "k2"])
    own = pairs.where("entity is null").select("k1", "k2", "hash", F.col("copies").alias("n_both"), "n_entity")
    several = materialised(pairs.where("entity is not null").select("k1", "k2", "entity", "hash", "copies", "n_entity"), "pairs")
    together = several.groupBy("entity", "hash", "n_entity").agg(F.sum("copies").alias("n_both"))
    least = _at_least(F.col("n_both"), F.col("n_term"), bound)
    share = F.when(least * rows > LIFT * F.col("n_entity"), least).otherwise(0.0).alias("disclosure")

    def telling(counts: DataFrame, *keys: str) -> DataFrame:
        return counts.join(spread, "hash").select(*keys, "hash", share).where(F.col("disclosure") >= at)

    # A term met by entities of single texts has few different counts, however many texts hold it.
    alone = telling(own.select("hash", "n_both", "n_entity").distinct(), "n_both", "n_entity")
    often = telling(together, "entity")
    if everywhere:
        found, keys = alone.select("hash", "disclosure").unionByName(often.select("hash", "disclosure")), ["hash"]
    else:
        keys = ["k1", "k2", "hash"]
        found = own.join(alone, ["hash", "n_both", "n_entity"]).select(*keys, "disclosure").unionByName(
            several.join(often, ["entity", "hash"]).select(*keys, "disclosure"))
    return found.groupBy(*keys).agg(F.max("disclosure").alias("disclosure"))


def _in_all(texts: DataFrame, telling: DataFrame, spread: DataFrame) -> DataFrame:
    """``k1, k2, hash, disclosure``: the terms ``telling(hash, disclosure)`` in every text that holds them."""
    telling = materialised(telling, "telling")
    usual = spread.join(telling, "hash", "left_anti").orderBy(F.desc("n_term"), "hash").limit(USUAL).select("hash")
    words = texts.select("k1", "k2", F.explode(_hashes(F.col("text"))).alias("hash"))
    words = words.join(F.broadcast(materialised(usual, "usual")), "hash", "left_anti")
    return words.join(telling, "hash").select("k1", "k2", "hash", "disclosure").distinct()


def private_spans(docs: DataFrame, generalise_at: float = GENERALISE_AT, remove_at: float = REMOVE_AT,
                  bound: float = BOUND, everywhere: bool = False) -> DataFrame:
    """``doc_id, base, terms`` of every row of ``docs(doc_id, text)``.

    ``base`` are the entities' spans (start, kind, end, found), by start and
    kind; ``terms`` the spans of disclosing terms outside of them, of kind
    ``term`` (generalised) or ``removed``: those that disclose an entity of the
    same text, or, if ``everywhere``, of any text, also where no entity stands.
    Null and empty texts have no spans; repeated rows and copies have equal
    ones; null ids stay. Other columns are not looked at. No rows: none.
    """
    texts = docs.select("doc_id", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"), "text")
    found = locate(texts, ["doc_id", "k1", "k2", "text"], "text", KINDS)
    found = materialised(found.select("doc_id", "k1", "k2", F.when(F.size("spans") > 0, F.col("text")).alias("text"), "spans"), "found")
    holders = materialised(found.where("text is not null").groupBy("k1", "k2").agg(
        F.count("*").alias("copies"), F.first("text").alias("text"), F.first("spans").alias("spans")), "holders")
    spread = materialised(term_rows(docs), "spread")
    telling = disclosing_terms(holders, spread, found.count(), generalise_at, bound, everywhere)
    named = holders
    if everywhere:
        telling = _in_all(texts, telling, spread)
        telling = materialised(telling, "in-all")
        wanted = telling.select("k1", "k2").distinct()
        named = texts.join(wanted, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.first("text").alias("text")).join(
            holders.select("k1", "k2", "spans"), ["k1", "k2"], "left").withColumn(
            "spans", F.coalesce("spans", F.lit([]).cast(SPAN)))
    flagged = telling.groupBy("k1", "k2").agg(
        F.collect_set("hash").alias("flagged"),
        F.collect_set(F.when(F.col("disclosure") >= remove_at, F.col("hash"))).alias("gone"))
    # Written, so that the rows of a text with very many copies are split in the join.
    placed = materialised(_term_spans(named.join(flagged, ["k1", "k2"])), "placed")
    return found.select("doc_id", "k1", "k2", F.col("spans").alias("base")).join(placed, ["k1", "k2"], "left").select(
        "doc_id", "base", F.coalesce("terms", F.lit([]).cast(SPAN)).alias("terms"))


def _term_spans(texts: DataFrame) -> DataFrame:
    """``k1, k2, terms`` out of ``k1, k2, text, spans, flagged, gone``."""
    rows = texts.select("k1", "k2", F.col("spans").alias("base"), "flagged", "gone", "text")
    found = locate(rows, ["k1", "k2", "base", "flagged", "gone"], "text", [_TERM],
                   lambda _, term: F.array_contains(F.col("flagged"), F.xxhash64(F.lower(term))))
    named = F.transform(outside(F.col("spans"), F.col("base")), lambda s: F.struct(
        s["start"].alias("start"), F.lit(len(KINDS)).alias("kind_no"),
        F.when(F.array_contains(F.col("gone"), F.xxhash64(F.lower(s["found"]))), F.lit("removed")).otherwise(F.lit("term")).alias("kind"),
        s["end"].alias("end"), s["found"].alias("found")))
    return found.select("k1", "k2", named.cast(SPAN).alias("terms"))


def sanitised(text: Column, spans: Column) -> Column:
    """The text with entities replaced by their kind, disclosing terms by ``[TERM]`` or, if removed, by nothing."""
    return replaced(text, spans, lambda s: F.when(s["kind"] == "removed", F.lit("")).otherwise(
        F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))
