"""A prefix trie of conversations, built as double-array tries per prefix shard.

Equal paths are counted first. A path goes to the shard of its shortest prefix under
which few enough turns lie, so a prefix that many conversations share is dealt by what
follows. A shard packs its paths into a double array, walks them through it and
counts at the nodes. Nodes below a path's cut belong to one shard; nodes above it are
shared, and their counts are merged over all shards. Sums over subtrees of shared
nodes are added up by doubling steps to ancestors.

Conversations of more than ``SEGMENT`` turns are cut; each further segment hangs below
the node at which the one before ends.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialised
from . import kernels as K
from .double_array import DoubleArray, Paths, dense_ids
from .mixing import word_count
from .prefix import prefix_sums

SEGMENT = 4096
SHARD_TURNS = 100_000
_CHUNK = 4096
_NO_ID = np.iinfo(np.int64).max
_KEY = ["depth", "ka", "kb"]
_NODE = ("shared boolean, segment_root boolean, depth long, ka long, kb long, pa long, pb long, n long, low long, parent_low long, "
         "children long, leaves long, saved long, words long, up_depth long, up_a long, up_b long")


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos, a, b, words``: each conversation's turns from 0, told by two 64-bit hashes of role and text.

    Turns stand by ``turn``, null first; equal ones by a checksum of role and text,
    so that equal rows follow each other. Null role and text are empty. Rows without a conv_id
    belong to no conversation and are left out. A conversation's rows may lie in any number of tasks.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    keyed = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.xxhash64(role, text).alias("a"),
        F.xxhash64(F.lit(1), text, role).alias("b"), word_count(text).alias("words"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("tie"))
    placed = materialised(prefix_sums(keyed, [F.col("conv_id"), F.col("turn"), F.col("tie")], {}, "turns").drop("turn", "tie"), "turns")
    firsts = materialised(placed.groupBy("conv_id").agg(F.min("row_no").alias("first")), "firsts")
    return placed.join(firsts, "conv_id").select("conv_id", (F.col("row_no") - F.col("first")).alias("pos"), "a", "b", "words")


def _shard(segment: int) -> Callable[[pa.Table], pa.Table]:
    """Nodes of one shard's paths."""

    def run(table: pa.Table) -> pa.Table:
        def flat(name: str) -> np.ndarray:
            return table.column(name).to_numpy()

        def values(name: str) -> np.ndarray:
            return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table.column(name).chunks])

        level = int(flat("seg")[0])
        a, b, words = values("a"), values("b"), values("words")
        lengths = np.concatenate([np.diff(c.offsets.to_numpy()) for c in table.column("a").chunks]).astype(np.int64)
        ids, _ = dense_ids(a, b)
        sa, sb = flat("sa"), flat("sb")
        roots, root_rows = dense_ids(sa, sb)
        paths = Paths(roots, ids, np.append(0, np.cumsum(lengths)))
        trie = DoubleArray(paths)
        size, n_roots = len(trie.check), trie.n_roots
        n, words_at, kids, leaves, saved, ka, kb = (np.zeros(size, dtype=np.int64) for _ in range(7))
        low, depth = np.full(size, _NO_ID), np.full(size, level * segment)
        shared, up = np.zeros(size, dtype=bool), np.arange(size)
        shared[:n_roots] = True
        ka[:n_roots], kb[:n_roots] = sa[root_rows], sb[root_rows]
        copies, lowest, cut = flat("n"), flat("low"), flat("cut")
        np.add.at(n, roots, copies)
        np.minimum.at(low, roots, lowest)
        state = roots.copy()
        for number in range(paths.longest):
            own, places = paths.step(number)
            before = state[own]
            to = trie.walk(before, ids[places])
            state[own] = to
            np.add.at(n, to, copies[own])
            np.minimum.at(low, to, lowest[own])
            words_at[to], depth[to] = words[places], level * segment + number + 1
            ka[to], kb[to] = ka[before] ^ a[places], kb[before] ^ b[places]
            shared[to] = cut[own] > number + 1
            up[to] = np.where(shared[to], to, up[before])
        nodes = np.concatenate([*trie.levels, np.zeros(0, dtype=np.int64)])
        np.add.at(kids, trie.check[nodes], (~shared[nodes]).astype(np.int64))
        np.add.at(kids, state, flat("below_children"))
        np.add.at(leaves, state, flat("below_leaves"))
        np.add.at(saved, state, flat("below_saved"))
        for own in reversed(trie.levels):
            alone = own[~shared[own]]
            leaves[alone] += kids[alone] == 0
            saved[alone] += (n[alone] - 1) * words_at[alone]
            # A shared node takes what hangs directly below it; the rest is added up over all shards.
            np.add.at(leaves, trie.check[alone], leaves[alone])
            np.add.at(saved, trie.check[alone], saved[alone])
        nodes = np.append(np.arange(n_roots), nodes)
        parent = trie.check[nodes]
        rooted = parent < 0
        parent = np.where(rooted, 0, parent)
        edge = ~shared[nodes] & (depth[nodes] == (level + 1) * segment)
        above = up[nodes]

        def column(found: np.ndarray, missing: np.ndarray | None = None) -> pa.Array:
            return pa.array(found, pa.int64(), mask=missing)

        return pa.table({
            "shared": pa.array(shared[nodes]), "segment_root": pa.array(rooted & (level > 0)), "depth": column(depth[nodes]),
            "ka": column(ka[nodes]), "kb": column(kb[nodes]), "pa": column(ka[parent], rooted), "pb": column(kb[parent], rooted),
            "n": column(n[nodes]), "low": column(low[nodes]), "parent_low": column(low[parent], rooted | shared[parent]),
            "children": column(kids[nodes]), "leaves": column(leaves[nodes]), "saved": column(saved[nodes]),
            "words": column(words_at[nodes]), "up_depth": column(depth[above], ~edge), "up_a": column(ka[above], ~edge),
            "up_b": column(kb[above], ~edge)})

    return run


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of (node, conv_id) as pieces: a node, its first id and its ids as text."""
    for batch in batches:
        keys = [batch.column(i).to_numpy() for i in range(3)]
        ids = batch.column(3).to_numpy()
        new = np.zeros(len(ids), dtype=bool)
        new[::_CHUNK] = True
        for key in keys:
            new[1:] |= key[1:] != key[:-1]
        first = np.flatnonzero(new)
        texts = [",".join(map(str, ids[x:y].tolist())) for x, y in zip(first, np.append(first[1:], len(ids)))]
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(key[first]) for key in keys), pa.array(ids[first]), pa.array(texts, pa.string())], [*_KEY, "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces, which follow each other; one piece is held at a time."""
    held, digest = None, None
    for batch in batches:
        done = []
        for *key, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if key == held:
                digest.update(b"," + ids.encode())
                continue
            if held is not None:
                done.append((*held, digest.hexdigest()))
            held, digest = key, hashlib.sha256(ids.encode())
        if done:
            yield _digest_rows(done)
    if held is not None:
        yield _digest_rows([(*held, digest.hexdigest())])


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3])], [*_KEY, "ends_sha256"])


def _ends_digest(ends: DataFrame) -> DataFrame:
    """``ends_sha256`` of each node at which conversations end: their ids, rising, joined by commas."""
    order = [*_KEY, "conv_id"]
    pieces = (ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
              .mapInArrow(_joined_ids, "depth long, ka long, kb long, first long, ids string"))
    return (pieces.repartition(*_KEY).sortWithinPartitions(*_KEY, "first")
            .mapInArrow(_digests, "depth long, ka long, kb long, ends_sha256 string"))


def _folded(hashes: Column, size: Column) -> Column:
    return F.aggregate(F.slice(hashes, F.lit(1), size), F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y))


def _sharded(paths: DataFrame, segment: int, shard_turns: int) -> DataFrame:
    """``paths`` with ``cut`` and ``shard``: the shortest prefix of 1, 2, 4, ... turns under which few turns lie."""
    spark = paths.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    turns = paths.agg(F.sum("size")).first()[0] or 1
    most = max(1, min(shard_turns, math.ceil(turns / parts)))
    shards = max(parts, math.ceil(turns / most))
    path = ["seg", "ka", "kb", "size"]
    depths = F.filter(F.array(*[F.lit(1 << e) for e in range(segment.bit_length())]), lambda d: (d <= F.col("size")) & (d <= segment))
    heads = materialised(paths.select(*path, F.explode(F.transform(depths, lambda d: F.struct(
        d.alias("d"), _folded(F.col("a"), d).bitwiseXOR(F.col("sa")).alias("ha"),
        _folded(F.col("b"), d).bitwiseXOR(F.col("sb")).alias("hb")))).alias("h")).select(*path, "h.*"), "heads")
    head = ["seg", "d", "ha", "hb"]
    hot = materialised(heads.groupBy(*head).agg(F.sum("size").alias("turns"), F.count("*").alias("paths"))
                       .where((F.col("turns") > most) & (F.col("paths") > 1)).select(*head), "hot")
    deepest = heads.join(hot, head).groupBy(*path).agg(F.max("d").alias("hot"))
    found = paths.join(deepest, path, "left").withColumn("cut", F.coalesce(F.col("hot") * 2, F.lit(1)))
    found = found.withColumn("cut", F.least("cut", F.col("size") + 1))
    by = F.least("cut", "size").cast("int")
    return found.withColumn("shard", F.pmod(F.xxhash64(
        _folded(F.col("a"), by).bitwiseXOR(F.col("sa")), _folded(F.col("b"), by).bitwiseXOR(F.col("sb"))), F.lit(shards))).drop("hot")


def _nodes(paths: DataFrame, segment: int, below: DataFrame | None = None) -> DataFrame:
    """Nodes of all shards; ``below`` adds what lies under the ends of full segments."""
    names = ["below_children", "below_leaves", "below_saved"]
    if below is None:
        full = paths.withColumns({c: F.lit(0).cast("long") for c in names})
    else:
        full = paths.withColumn("depth", F.col("seg") * segment + F.col("size")).join(below, _KEY, "left").withColumns(
            {c: F.coalesce(c, F.lit(0)).cast("long") for c in names})
    return materialised(full.select("seg", "shard", "sa", "sb", "a", "b", "words", "n", "low", "cut", *names).groupBy("seg", "shard")
                        .applyInArrow(_shard(segment), _NODE), "nodes")


def _totals(tree: DataFrame) -> DataFrame:
    """``key, leaves, saved`` summed over subtrees of ``tree(key, anc, leaves, saved)``, by doubling the step to ``anc``."""
    tree = materialised(tree, "doubling")
    while tree.where("anc IS NOT NULL").limit(1).count():
        given = tree.where("anc IS NOT NULL").groupBy(F.col("anc").alias("key")).agg(
            F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        ancestors = tree.select(F.col("key").alias("anc"), F.col("anc").alias("next"))
        tree = materialised(tree.join(given, "key", "left").join(ancestors, "anc", "left").select(
            "key", F.col("next").alias("anc"), (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
            (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved")), "doubling")
    return tree.select("key", "leaves", "saved")


def prefix_nodes(turns: DataFrame, members: DataFrame, segment: int = SEGMENT, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row a distinct prefix: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``turns`` (conv_id, pos, a, b, words) numbers each conversation's turns from 0
    without gaps; ``members`` (conv_id, n_turns) has one row a conversation, also
    those without turns, which belong to the root alone. Equal prefixes are told by
    128 bits of hashes. ``conv_id`` is the smallest member. Without members there are
    no nodes. ``segment`` is a power of two. A conversation of any length and a prefix
    of any number of conversations are spread over tasks; only the chain of
    a conversation's segments (one row each) is put in order by one task.
    """
    if segment & (segment - 1):
        raise ValueError("segment must be a power of two")
    empty = members.where("n_turns = 0").agg(F.count("*").alias("n"), F.min("conv_id").alias("low"))
    n_members, longest = members.agg(F.count("*"), F.max("n_turns")).first()
    seg = F.floor(F.col("pos") / segment).cast("long")
    steps = F.sort_array(F.collect_list(F.struct("pos", "a", "b", "words")))
    segments = (turns.select("conv_id", seg.alias("seg"), "pos", F.xxhash64("pos", "a").alias("a"),
                             F.xxhash64("b", "pos").alias("b"), "words")
                .groupBy("conv_id", "seg").agg(steps.alias("steps"), F.bit_xor("a").alias("xa"), F.bit_xor("b").alias("xb"))
                .select("conv_id", "seg", F.size("steps").alias("size"), "xa", "xb", "steps.a", "steps.b", "steps.words"))
    if longest and longest > segment:
        segments = materialised(segments, "segments")
        long_ones = members.where(F.col("n_turns") > segment).select("conv_id")
        earlier = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
        starts = segments.select("conv_id", "seg", "xa", "xb").join(long_ones, "conv_id").select(
            "conv_id", "seg", F.bit_xor("xa").over(earlier).alias("sa"), F.bit_xor("xb").over(earlier).alias("sb"))
        segments = segments.join(starts.where("seg > 0"), ["conv_id", "seg"], "left")
    else:
        segments = segments.withColumns({"sa": F.lit(None).cast("long"), "sb": F.lit(None).cast("long")})
    zero = F.lit(0).cast("long")
    segments = segments.withColumns({"sa": F.coalesce("sa", zero), "sb": F.coalesce("sb", zero)}).withColumns(
        {"ka": F.col("sa").bitwiseXOR(F.col("xa")), "kb": F.col("sb").bitwiseXOR(F.col("xb"))})
    segments = materialised(segments, "segments")
    content = ["seg", "sa", "sb", "ka", "kb", "size", "a", "b", "words"]
    paths = materialised(segments.groupBy(*content).agg(F.count("*").alias("n"), F.min("conv_id").alias("low")), "paths")
    paths = materialised(_sharded(paths, segment, shard_turns), "paths")
    ends = segments.join(members, "conv_id").where(F.floor((F.col("n_turns") - 1) / segment) == F.col("seg")).select(
        "conv_id", F.col("n_turns").cast("long").alias("depth"), "ka", "kb").unionByName(
        members.where("n_turns = 0").select("conv_id", zero.alias("depth"), zero.alias("ka"), zero.alias("kb")))

    cut_ones = None
    if longest and longest > segment:  # where a conversation goes on is no leaf
        cut_ones = segments.where("seg > 0").select(
            (F.col("seg") * segment).alias("depth"), F.col("sa").alias("ka"), F.col("sb").alias("kb")).distinct().withColumns(
            {"below_children": F.lit(1), "below_leaves": F.lit(0), "below_saved": F.lit(0)})
    nodes = _nodes(paths, segment, cut_ones)
    key = F.struct(*_KEY)
    bare = empty.where(F.lit(n_members > 0)).select(
        F.struct(zero.alias("depth"), zero.alias("ka"), zero.alias("kb")).alias("key"), F.lit(False).alias("segment_root"),
        F.lit(None).cast("long").alias("pa"), F.lit(None).cast("long").alias("pb"), "n", "low",
        *[zero.alias(c) for c in ("children", "leaves", "saved", "words")])
    merged = nodes.where("shared").select(key.alias("key"), *bare.columns[1:]).unionByName(bare).groupBy("key").agg(
        F.max("segment_root").alias("segment_root"), F.max("pa").alias("pa"), F.max("pb").alias("pb"), F.sum("n").alias("n"),
        F.min("low").alias("low"), F.max("words").alias("words"), *[F.sum(c).alias(c) for c in ("children", "leaves", "saved")])
    parent = F.when(F.col("pa").isNotNull(), F.struct((F.col("key.depth") - 1).alias("depth"), F.col("pa").alias("ka"), F.col("pb").alias("kb")))
    merged = materialised(merged.withColumn("parent", parent), "shared")
    kids = merged.where("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("kids"))
    upper = materialised(merged.join(kids, "key", "left").withColumn("children", F.col("children") + F.coalesce("kids", zero)), "upper")
    edges = nodes.where("up_depth IS NOT NULL").select(key.alias("key"), F.struct(
        F.col("up_depth").alias("depth"), F.col("up_a").alias("ka"), F.col("up_b").alias("kb")).alias("hung"))
    own = upper.join(edges, "key", "left").select(
        "key", F.coalesce("parent", "hung").alias("anc"), (F.col("leaves") + (F.col("children") == 0).cast("long")).alias("leaves"),
        (F.col("saved") + (F.col("n") - 1) * F.col("words")).alias("saved"))
    totals = materialised(_totals(own), "totals")
    upper = upper.drop("leaves", "saved").join(totals, "key")
    if longest and longest > segment:
        below = upper.where("segment_root").select("key.*", F.col("children").alias("below_children"),
                                                   F.col("leaves").alias("below_leaves"), F.col("saved").alias("below_saved"))
        nodes = _nodes(paths, segment, below)
    # The root of a further segment stands for the node it hangs below, which has more members.
    above = merged.where(~F.col("segment_root")).select(F.col("key").alias("parent"), F.col("low").alias("above_low")).unionByName(
        nodes.where("up_depth IS NOT NULL").select(key.alias("parent"), F.col("low").alias("above_low")))
    parted = ["parent", "n", "low", "children", "leaves", "saved"]
    top = upper.where(~F.col("segment_root")).select("key", *parted).join(above, "parent", "left").withColumnRenamed("above_low", "parent_low")
    alone = nodes.where(~F.col("shared")).select(
        key.alias("key"), F.struct((F.col("depth") - 1).alias("depth"), F.col("pa").alias("ka"), F.col("pb").alias("kb")).alias("parent"),
        "n", "low", "children", "leaves", "saved", "parent_low")
    hung = alone.where("parent_low IS NULL").drop("parent_low").join(above, "parent", "left").withColumnRenamed("above_low", "parent_low")
    every = top.unionByName(alone.where("parent_low IS NOT NULL")).unionByName(hung)
    digests = _ends_digest(ends)
    found = every.select("key.*", *parted[1:], "parent_low").join(digests, _KEY, "left")
    return found.select(
        F.col("low").alias("conv_id"), "depth", F.col("parent_low").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
