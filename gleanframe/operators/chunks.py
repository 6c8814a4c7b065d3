"""Splitting long texts into overlapping chunks.

Where a chunk ends depends on all chunks before it, so each text is folded
from left to right inside its own row, with Spark's ``aggregate`` and without
Python or a shuffle. The accumulator holds the finished chunks, the open chunk
and the tail carried over from the last finished one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import pinned
from ..functions.patterns import PARAGRAPH_BREAK, SENTENCE_BREAK
from ..functions.text import strip

# Defaults in characters.
CHUNK_SIZE = 6000
OVERLAP = 200
SUMMARY_CHUNK_SIZE = 8000


def _pieces(text: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(text, pattern), strip), lambda p: p != "")


def _tail(chunk: Column, overlap: int) -> Column:
    return F.right(chunk, F.lit(overlap))


def _closed(chunks: Column, chunk: Column) -> Column:
    chunk = strip(chunk)
    return F.when(chunk != "", F.concat(chunks, F.array(chunk))).otherwise(chunks)


def sentence_chunks(text: Column, max_size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> Column:
    """Array of chunks of whole sentences, each starting with the last one's tail.

    A sentence longer than ``max_size`` stays whole.
    """
    start = F.struct(F.array().cast("array<string>").alias("chunks"), F.lit("").alias("open"))

    def add(state: Column, sentence: Column) -> Column:
        full = (state["open"] != "") & (F.length(state["open"]) + F.length(sentence) + 1 > max_size)
        return F.struct(
            F.when(full, F.concat(state["chunks"], F.array(strip(state["open"])))).otherwise(state["chunks"]).alias("chunks"),
            F.when(full, F.concat(_tail(state["open"], overlap), F.lit(" "), sentence))
            .otherwise(strip(F.concat(state["open"], F.lit(" "), sentence))).alias("open"),
        )

    return F.aggregate(_pieces(text, SENTENCE_BREAK), start, add, lambda s: _closed(s["chunks"], s["open"]))


def paragraph_chunks(text: Column, max_size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> Column:
    """Array of chunks of whole paragraphs, each starting with the last one's tail.

    A paragraph longer than ``max_size`` is split by sentence.
    """
    # Sentence chunks of over-long paragraphs are made before the fold, once each.
    parts = F.transform(
        _pieces(text, PARAGRAPH_BREAK),
        lambda p: F.struct(
            p.alias("text"),
            F.when(F.length(p) > max_size, sentence_chunks(p, max_size, overlap)).alias("split"),
        ),
    )
    start = F.struct(
        F.array().cast("array<string>").alias("chunks"), F.lit("").alias("open"), F.lit("").alias("tail")
    )
    gap = F.lit("\n\n")

    def add(state: Column, part: Column) -> Column:
        para, is_open = part["text"], state["open"] != ""
        finished = F.concat(state["chunks"], F.array(strip(state["open"])))
        joined = F.when(is_open, F.concat(state["open"], gap, para)).otherwise(
            strip(F.concat(state["tail"], gap, gap, para))
        )
        full = is_open & (F.length(state["open"]) + 2 + F.length(para) > max_size)
        tail = _tail(state["open"], overlap)
        split = part["split"].isNotNull()
        return F.struct(
            F.when(split, F.concat(F.when(is_open, finished).otherwise(state["chunks"]), part["split"]))
            .when(full, finished)
            .otherwise(state["chunks"]).alias("chunks"),
            F.when(split, F.lit(""))
            .when(full, strip(F.concat(tail, gap, para)))
            .otherwise(joined).alias("open"),
            F.when(split, _tail(F.element_at(part["split"], -1), overlap))
            .when(full, tail)
            .otherwise(state["tail"]).alias("tail"),
        )

    return F.aggregate(parts, start, add, lambda s: _closed(s["chunks"], s["open"]))


def chunk(
    df: DataFrame, strategy: str = "paragraphs", max_size: int = CHUNK_SIZE, key: str = "doc_id",
    text: str = "text", overlap: int = OVERLAP,
) -> DataFrame:
    """``key, chunk_num, total_chunks, chunk``: empty texts give none, short texts one."""
    if strategy not in ("paragraphs", "sentences"):
        raise ValueError("strategy is 'paragraphs' or 'sentences'")
    if overlap < 1:
        raise ValueError("overlap is at least one character")
    split = sentence_chunks if strategy == "sentences" else paragraph_chunks
    body = F.col(text)
    parts = F.when(F.length(body) <= max_size, F.array(body)).otherwise(split(body, max_size, overlap))
    return (
        pinned(df.where(F.length(text) > 0), key, parts=parts)
        .select(key, F.size("parts").cast("long").alias("total_chunks"), F.posexplode("parts").alias("i", "chunk"))
        .select(key, (F.col("i") + 1).cast("long").alias("chunk_num"), "total_chunks", "chunk")
    )
