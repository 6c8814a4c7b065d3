"""Secrets found by pattern, and random-looking strings by character Markov models.

Two first-order models are counted: one of random strings, from the values that
the patterns found in the corpus, and one of ordinary text, from the strings of
the same alphabet in all documents, weighed by their places. What stands in one place only is no
sample of the ordinary: there the random strings are. A string is a secret if the first model explains its characters, all together,
better than the second by a given log-likelihood ratio. Built-in functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import pinned
from .located import SPAN, Kind, locate, outside

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-"
SYMBOLS = len(ALPHABET) + 1
# Total log-likelihood ratio of a secret: it outweighs odds of one secret in a million strings.
RATIO_AT = math.log(1e6)

_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?+\x20*+[:=]\x20*+["']?+([A-Za-z0-9+/_.=-]++)"""

KINDS = [
    Kind("assign", _ASSIGN, lambda m: F.length(F.regexp_extract(m, _ASSIGN, 2)) >= 6),
    Kind("access", r"AKIA[A-Z0-9]{16,}+", lambda m: F.lit(True)),
    Kind("hex", r"[0-9a-f]{24,}+", lambda m: F.lit(True)),
]
_CHARS = "[A-Za-z0-9+/_.=-]"
# Strings that the models judge, and those that the ordinary model is counted on.
_STRING = Kind("random", rf"{_CHARS}{{12,}}+", lambda m: F.lit(True))
_PLAIN = rf"{_CHARS}{{2,}}+"


def _codes(token: Column) -> Column:
    """Number of each character in the alphabet, 0 for others."""
    return F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.position(c, F.lit(ALPHABET)))


def _steps(codes: Column) -> Column:
    """Number of each pair of neighbouring characters."""
    n = F.greatest(F.size(codes) - 1, F.lit(0))
    return F.zip_with(F.slice(codes, F.lit(1), n), F.slice(codes, F.lit(2), n), lambda a, b: a * SYMBOLS + b)


def step_counts(tokens: DataFrame, least: int = 1) -> dict[int, int]:
    """Counts of character pairs in ``tokens(token)``; at most the square of the alphabet.

    Equal tokens are counted first, so each different one is split once; those with fewer than ``least`` places are left out.
    """
    counted = tokens.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    coded = pinned(counted, "n", codes=_codes(F.col("token")))
    pairs = coded.select("n", F.explode(_steps(F.col("codes"))).alias("step")).groupBy("step").agg(F.sum("n").alias("n"))
    return {r["step"]: r["n"] for r in pairs.collect()}


def _log_chances(counts: dict[int, int], weight: int = 8) -> list[float]:
    """log P(b | a) for each pair; rare first characters fall back on how often b follows any."""
    into = [1 + sum(counts.get(a * SYMBOLS + b, 0) for a in range(SYMBOLS)) for b in range(SYMBOLS)]
    share = [n / sum(into) for n in into]
    out = [sum(counts.get(a * SYMBOLS + b, 0) for b in range(SYMBOLS)) for a in range(SYMBOLS)]
    return [math.log((counts.get(a * SYMBOLS + b, 0) + weight * share[b]) / (out[a] + weight))
            for a in range(SYMBOLS) for b in range(SYMBOLS)]


def log_ratios(random: dict[int, int], ordinary: dict[int, int]) -> list[float]:
    """log P(b | a; random) - log P(b | a; ordinary) for each pair."""
    return [x - y for x, y in zip(_log_chances(random), _log_chances(ordinary))]


def secret_spans(docs: DataFrame, ratio_at: float = RATIO_AT) -> DataFrame:
    """``doc_id, base, random`` of every row of ``docs(doc_id, text)``.

    ``base`` are the patterns' spans (start, kind, end, found), by start and
    kind; ``random`` the spans of random strings that touch none of them. Null
    and empty texts have no spans; repeated rows have equal ones; null ids stay.
    Without any pattern match, a random string is one of equally likely
    characters. Other columns are not looked at. No rows: none.

    Both models are counted over all documents. Strings of twelve or more characters are judged,
    whatever kinds of characters they hold; a string's length counts through the total alone.
    """
    texts = docs.select("doc_id", "text")
    body = F.coalesce(F.col("text"), F.lit(""))

    def secrets(kind: Kind) -> Column:
        found = F.filter(F.regexp_extract_all(body, F.lit(kind.pattern), F.lit(0)), lambda m: kind.holds(m))
        return F.transform(found, lambda m: F.regexp_extract(m, _ASSIGN, 2)) if kind.name == "assign" else found

    every = F.concat(*[secrets(k) for k in KINDS])
    values = texts.select(F.explode(every).alias("token"))
    # What the patterns found is no ordinary text.
    plain = body
    for kind in KINDS:
        plain = F.regexp_replace(plain, kind.pattern, " ")
    words = texts.select(F.explode(F.regexp_extract_all(plain, F.lit(_PLAIN), F.lit(0))).alias("token"))
    ratios = log_ratios(step_counts(values), step_counts(words, 2))
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")

    def ratio(token: Column) -> Column:
        return F.aggregate(F.transform(_steps(_codes(token)), lambda s: F.element_at(table, s + 1)), F.lit(0.0), lambda a, x: a + x)

    found = locate(texts, ["doc_id"], "text", [*KINDS, _STRING],
                   lambda kind, m: ratio(m) >= ratio_at if kind is _STRING else kind.holds(m))
    base = F.filter("spans", lambda s: s["kind"] != "random")
    strings = F.filter("spans", lambda s: s["kind"] == "random")
    split = pinned(found, "doc_id", base=base, strings=strings)
    return split.select("doc_id", "base", outside(F.col("strings"), F.col("base")).cast(SPAN).alias("random"))
