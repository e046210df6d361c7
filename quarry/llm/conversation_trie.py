"""Prefix trie of conversations with a depth-band rollup.

A node is a distinct sequence of first turns.  Its key is its depth and the
exclusive or of one 128-bit digest per (position, turn), so the key of every
prefix is a running sum that can be cut anywhere, and a parent's key follows
from its child's without a look at other rows.

Totals over subtrees climb in bands of ``BAND`` levels.  A node explodes to its
ancestors within its band only; what a band root has gathered below it (its
band's nodes) makes a tree of band roots, which is rolled up in the same way,
with bands of bands.  Completed totals of band roots then go to the ancestors in
the band above.  A trie of depth D takes log(D) / log(BAND) levels of recursion
and at most ``BAND`` rows for each node and level.

Turns are numbered by range partitions, running digests by blocks of
``BLOCK`` positions, and the members that end at a node are joined in pieces of
``PIECE`` ids and hashed as a stream, so no task holds a long conversation or
a node that a third of all conversations share.

Results: turns go by ``turn`` (null first), equal ones by the digest of role
and text; a null role or text is empty; turns without a conversation id belong
to none and are left out; repeated rows are turns of their own; conversations
that are equal share all their nodes; very long texts are only hashed and
counted; other columns, whatever their names, are not read; an empty table has
no conversations, hence no nodes, not even the root.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm._common import prepare, shuffle_width
from quarry.session import cut_lineage

BAND = 8
BLOCK = 4096
PIECE = 4096
# Fixed values of the contract.
GROUP, HEADS = 20, 4
WORD = r"[^\x20\x09-\x0D]+"
_KEY = ["depth", "ka", "kb"]


def numbered_turns(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                   text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``conv, part, nth, ta, tb, words`` (a turn's place in its part of the
    conversation, its digest and number of words) and ``conv, part, start, n``
    (the turns before a part, those of the conversation)."""
    prepare(turns.sparkSession)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    sha = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    src = (turns.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), sha.alias("sha"),
                        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")).filter("conv is not null")
           .select("conv", "turn", *[F.conv(F.substring("sha", at, 15), 16, 10).cast("long").alias(c) for c, at in (("ta", 1), ("tb", 16))],
                   "words"))
    src = cut_lineage(src)                             # ranges are sampled first: texts are hashed once
    order = [F.asc("conv"), F.asc_nulls_first("turn"), F.asc("ta"), F.asc("tb")]
    ranged = cut_lineage(src.repartitionByRange(shuffle_width(turns), *order).sortWithinPartitions(*order)
                         .drop("turn").withColumn("seq", F.monotonically_increasing_id()))
    part = ranged.withColumn("part", F.shiftright("seq", 33))
    numbered = part.withColumn("nth", F.row_number().over(Window.partitionBy("conv", "part").orderBy("seq")).cast("long")).drop("seq")
    # a conversation has at most as many parts as there are partitions
    sizes = part.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("size"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("conv", "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"),
                          F.sum("size").over(Window.partitionBy("conv")).alias("n"))
    return numbered, cut_lineage(starts)


def plain_turns(numbered: DataFrame, starts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as they are: ``conv, depth, len, ta, tb, words`` and
    ``conv, len``."""
    rows = numbered.join(starts, ["conv", "part"]).select(
        "conv", (F.col("start") + F.col("nth")).alias("depth"), F.col("n").alias("len"), "ta", "tb", "words")
    return rows, starts.select("conv", F.col("n").alias("len")).distinct()


def regrouped_turns(numbered: DataFrame, starts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The contract's rebuilt conversations: the first h turns of the group's
    first conversation, then the own ones after the first h."""
    own = starts.select("conv", "n").distinct()
    heads = F.crc32(F.col("conv").cast("string")) % HEADS
    first = own.filter(F.col("conv") % GROUP == 0).select(F.col("conv").alias("lead"), F.col("n").alias("lead_n"))
    convs = (own.withColumns({"lead": F.col("conv") - F.col("conv") % GROUP, "h": heads}).join(first, "lead", "left")
             .withColumn("taken", F.least("h", F.coalesce("lead_n", F.lit(0))))
             .withColumn("len", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
             .select("conv", "lead", "h", "taken", "len"))
    convs = cut_lineage(convs)
    places = starts.drop("n").join(convs, "conv")
    rest = (numbered.join(places, ["conv", "part"]).withColumn("p", F.col("start") + F.col("nth")))
    kept = rest.filter("p > h").select("conv", (F.col("taken") + F.col("p") - F.col("h")).alias("depth"), "len", "ta", "tb", "words")
    lent = rest.filter((F.col("conv") == F.col("lead")) & (F.col("p") < HEADS)).select("lead", F.col("p").alias("depth"), "ta", "tb", "words")
    taken = convs.join(lent, "lead").filter("depth <= h").select("conv", "depth", "len", "ta", "tb", "words")
    return kept.unionByName(taken), convs.select("conv", "len")


def with_keys(turns: DataFrame) -> DataFrame:
    """Add the node's key ``ka, kb`` and its parent's ``pa, pb``: running
    exclusive ors within blocks of positions, on top of the blocks before."""
    block = F.expr(f"(depth - 1) div {BLOCK}")
    own = turns.withColumns({"xa": F.xxhash64(F.lit(1), "depth", "ta", "tb"), "xb": F.xxhash64("tb", "depth", "ta", F.lit(2)),
                             "block": block})
    sums = own.groupBy("conv", "block").agg(F.bit_xor("xa").alias("sa"), F.bit_xor("xb").alias("sb"))
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (sums.withColumns({"ca": F.bit_xor("sa").over(before), "cb": F.bit_xor("sb").over(before)})
               .filter("block > 0").select("conv", "block", "ca", "cb"))
    upto = Window.partitionBy("conv", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    keyed = own.withColumns({"ra": F.bit_xor("xa").over(upto), "rb": F.bit_xor("xb").over(upto)}).join(carried, ["conv", "block"], "left")
    zero = F.lit(0).cast("long")
    keyed = keyed.withColumns({"ka": F.col("ra").bitwiseXOR(F.coalesce("ca", zero)), "kb": F.col("rb").bitwiseXOR(F.coalesce("cb", zero))})
    return keyed.select("conv", "depth", "len", "ka", "kb", F.col("ka").bitwiseXOR(F.col("xa")).alias("pa"),
                        F.col("kb").bitwiseXOR(F.col("xb")).alias("pb"), "words")


def _root(name: str = "root") -> Column:
    return F.struct(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("ka"), F.lit(0).cast("long").alias("kb")).alias(name)


def _paths(rows: DataFrame) -> DataFrame:
    """``conv, band, path``: per conversation and band the keys from the band's
    root down, ``BAND`` + 1 at most."""
    key = F.struct(*_KEY).alias("key")
    inside = rows.select("conv", F.expr(f"(depth - 1) div {BAND}").alias("band"), key)
    tops = rows.filter(F.col("depth") % BAND == 0).select("conv", F.expr(f"depth div {BAND}").alias("band"), key)
    keys = F.sort_array(F.collect_list("key"))
    return inside.unionByName(tops).groupBy("conv", "band").agg(keys.alias("keys")).select(
        "conv", "band", F.when(F.col("band") == 0, F.concat(F.array(_root()), "keys")).otherwise(F.col("keys")).alias("path"))


def rollup(nodes: DataFrame, rows: DataFrame, values: list[str], deepest: int) -> DataFrame:
    """``depth, ka, kb`` and the sums of ``values`` over each node's subtree.

    ``nodes``: a row per node with its key, ``conv`` (a member) and values;
    the root has depth 0 and key 0.  ``rows``: a row per conversation and node
    below the root that it passes."""
    at_band = F.expr(f"(depth - 1) div {BAND}")
    below = nodes.filter("depth > 0").withColumn("band", at_band).join(_paths(rows), ["conv", "band"])
    below = cut_lineage(below.withColumn("path", F.filter("path", lambda x: x["depth"] < F.col("depth"))))
    sums = [F.sum(v).alias(v) for v in values]

    def climb(part: DataFrame, path: Column) -> DataFrame:
        return part.select(F.explode(path).alias("up"), *values).select("up.*", *values)

    if deepest <= BAND:
        return climb(below, F.col("path")).unionByName(nodes.select(*_KEY, *values)).groupBy(*_KEY).agg(*sums)
    is_top = F.col("depth") % BAND == 0
    # band roots with what their band holds, bottom level left out
    tops = nodes.filter(is_top)
    gathered = (climb(below.filter(~is_top), F.slice("path", 1, 1)).unionByName(tops.select(*_KEY, *values))
                .groupBy(*_KEY).agg(*sums))
    up = F.expr(f"depth div {BAND}")
    contracted = cut_lineage(gathered.join(tops.select(*_KEY, "conv"), _KEY).withColumn("depth", up))
    done = rollup(contracted, rows.filter(is_top).withColumn("depth", up), values, deepest // BAND)
    done = cut_lineage(done.withColumn("depth", F.col("depth") * BAND))
    bottoms = below.filter(is_top).select(*_KEY, "path").join(done, _KEY)
    inner = (climb(below.filter(~is_top).unionByName(bottoms, allowMissingColumns=True), F.slice("path", F.lit(2), F.lit(BAND)))
             .unionByName(nodes.filter(~is_top).select(*_KEY, *values)).groupBy(*_KEY).agg(*sums))
    return inner.unionByName(done)


def ends_digests(ends: DataFrame) -> DataFrame:
    """``depth, ka, kb, ends_sha256`` of nodes at which conversations ``conv``
    end: SHA-256 of their ids in decimal, ascending, joined by commas."""
    width = shuffle_width(ends)
    order = [*_KEY, "conv"]
    key_type = "depth long, ka long, kb long"

    def pieces(batches):
        key, ids = None, []
        out: list[tuple] = []

        def close():
            if ids:
                out.append((*key, ids[0], ",".join(map(str, ids))))
                ids.clear()

        for b in batches:
            for *k, conv in zip(*[b.column(c).to_pylist() for c in order], strict=True):
                if k != key or len(ids) >= PIECE:
                    close()
                    key = k
                ids.append(conv)
            if len(out) >= 2000 or sum(len(r[4]) for r in out) > 4 << 20:
                yield _batch(out)
                out.clear()
        close()
        if out:
            yield _batch(out)

    def _batch(rows):
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:4]], pa.array(cols[4], pa.string())],
                                          names=[*_KEY, "first", "ids"])

    def hashes(batches):
        key, state = None, None

        def row():
            return pa.RecordBatch.from_arrays([*[pa.array([v], pa.int64()) for v in key], pa.array([state.hexdigest()])],
                                              names=[*_KEY, "ends_sha256"])

        for b in batches:
            done = []
            for *k, ids in zip(*[b.column(c).to_pylist() for c in (*_KEY, "ids")], strict=True):
                if k == key:
                    state.update(b"," + ids.encode())
                else:
                    if key is not None:
                        done.append(row())
                    key, state = k, hashlib.sha256(ids.encode())
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        if key is not None:
            yield row()

    parts = (ends.select(*order).repartitionByRange(width, *order).sortWithinPartitions(*order)
             .mapInArrow(pieces, f"{key_type}, first long, ids string"))
    return (parts.repartition(width, *_KEY).sortWithinPartitions(*_KEY, "first")
            .mapInArrow(hashes, f"{key_type}, ends_sha256 string"))


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256``.

    ``turns``: ``conv, depth, len, ta, tb, words``, a row per turn, depths
    from 1 without gaps; ``convs``: ``conv, len`` of every conversation, the
    turnless ones too (see ``plain_turns``, ``regrouped_turns``)."""
    keyed = cut_lineage(with_keys(turns))
    deepest = keyed.agg(F.max("depth")).first()[0] or 0
    below = keyed.groupBy(*_KEY).agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.min("words").alias("words"),
                                     F.min("pa").alias("pa"), F.min("pb").alias("pb"))
    zero = F.lit(0).cast("long")
    root = (convs.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
            .select(zero.alias("depth"), zero.alias("ka"), zero.alias("kb"), "conv", "n_convs", zero.alias("words"),
                    F.lit(None).cast("long").alias("pa"), F.lit(None).cast("long").alias("pb")))
    nodes = below.unionByName(root)
    children = below.groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("ka"), F.col("pb").alias("kb")).agg(
        F.count(F.lit(1)).alias("n_children"))
    nodes = cut_lineage(nodes.join(children, _KEY, "left").withColumns({
        "n_children": F.coalesce("n_children", zero), "leaves": F.col("n_children").isNull().cast("long"),
        "saved": (F.col("n_convs") - 1) * F.col("words")}))
    totals = rollup(nodes.select(*_KEY, "conv", "leaves", "saved"), keyed.select("conv", *_KEY), ["leaves", "saved"], deepest)
    ends = keyed.filter("depth = len").select(*_KEY, "conv").unionByName(
        convs.filter("len = 0").select(zero.alias("depth"), zero.alias("ka"), zero.alias("kb"), "conv"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("ka").alias("pa"), F.col("kb").alias("pb"),
                           F.col("conv").alias("parent_conv_id"))
    out = (nodes.drop("leaves", "saved").join(totals, _KEY).join(ends_digests(ends), _KEY, "left")
           .join(parents, ["depth", "pa", "pb"], "left"))
    return out.select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children",
                      F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
                      F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def conversation_trie(turns: DataFrame, *, regroup: bool = False, **columns) -> DataFrame:
    """``prefix_trie`` of a table of turns, as they are or regrouped."""
    numbered, starts = numbered_turns(turns, **columns)
    return prefix_trie(*(regrouped_turns if regroup else plain_turns)(numbered, starts))
