"""SimHash near-duplicates by the generalised pigeonhole principle.

A text's fingerprint has a bit set where more than half of the hashes of its
word shingles have it set.  Texts link when their fingerprints differ in at
most ``max_bits`` bits.

Equal fingerprints are one class, so a group of copies is one row.  For the
distinct fingerprints the 64 bits are dealt into partitions of correlated
bits; each partition gets a threshold of its own, with sum ``max_bits -
partitions + 1``: two fingerprints that link must lie within the threshold in
some partition (a threshold of -1 leaves a partition out).  The number of
partitions and the thresholds are the cheapest by dynamic programming on
candidate counts, which come from the value counts of each partition and the
bit counts over all fingerprints.

Candidates share a *signature*: the partition's bits, for threshold 1 with one
bit masked out.  Signatures of few fingerprints are verified member against
member; those of many are split again by exact one-bit neighbours (two
fingerprints within two bits always have one in common, and no more than 65
share it), so no group's work grows with its square and nothing is dropped.

Results: null and empty texts and texts of white space have fingerprint 0; null
ids get a component but are never its smallest id unless it has no other;
repeated rows fall into one class; an empty table gives an empty result.  A
very long text is hashed in portions of 2^20 shingles; ``keep_one`` hands all
columns on, its own begin with ``_quarry``, so names cannot clash.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._common import prepare, text_or_empty, tidy_task
from quarry.llm.components import components
from quarry.session import cut_lineage

BITS = 64
SEED = 42
#: Signatures of more fingerprints than this are split by one-bit neighbours,
#: which costs about as many rows per fingerprint.
CROWD = 64
#: Partition numbers that are weighed against each other.
PARTITIONS = (2, 3, 4)


def fingerprint(text: bytes, words: int = 3, at_once: int = 1 << 20) -> int:
    """SimHash of a text in UTF-8; letters A-Z count as a-z."""
    from xxhash import xxh64_intdigest

    parts = text.lower().split()
    if not parts:
        return 0
    line = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words, len(parts))
    first, last = starts[: len(parts) - k + 1].tolist(), ends[k - 1 :].tolist()
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(first), at_once):
        hashes = np.array([xxh64_intdigest(line[a:b], SEED) for a, b in
                           zip(first[at : at + at_once], last[at : at + at_once], strict=True)], "<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(first), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, text_col: str = "text", words: int = 3) -> DataFrame:
    """``docs`` without its text, with ``fp`` (the fingerprint as a signed
    long).  One pass, no shuffle."""
    prepare(docs.sparkSession)
    kept = [c for c in docs.columns if c != text_col]
    src = docs.select(*kept, text_or_empty(text_col).cast("binary").alias("_text"))
    schema = ", ".join([f"`{c}` {src.schema[c].dataType.simpleString()}" for c in kept] + ["fp long"])

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, words) for t in b.column("_text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(fp)], names=[*kept, "fp"])

    return src.mapInArrow(tidy_task(run), schema)


def bit_counts(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and for every two bits how many have both: one
    row of 64 x 64 counters per task."""
    def run(batches):
        total, n = np.zeros((BITS, BITS), np.int64), 0
        for b in batches:
            raw = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(raw, axis=1, bitorder="little").astype(np.float32)
            total += np.rint(bits.T @ bits).astype(np.int64)
            n += len(bits)
        yield pa.RecordBatch.from_arrays([pa.array([[n, *total.ravel().tolist()]], pa.list_(pa.int64()))], names=["c"])

    rows = (distinct.select("fp").mapInArrow(tidy_task(run), "c array<long>").select(F.posexplode("c").alias("k", "v"))
            .groupBy("k").agg(F.sum("v").alias("v")).collect())              # 64 x 64 + 1 rows
    flat = np.zeros(BITS * BITS + 1, np.int64)
    for r in rows:
        flat[r["k"]] = r["v"]
    return int(flat[0]), flat[1:].reshape(BITS, BITS)


def correlated_partitions(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits dealt into ``parts`` groups of nearly equal size, each grown from
    the bit most correlated with the free ones by adding the bit most
    correlated with the group."""
    p = np.diag(both) / max(1, n)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(1, n) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    free, out = list(range(BITS)), []
    for k in range(parts):
        size = BITS // parts + (k < BITS % parts)
        group = [max(free, key=lambda b: corr[b, free].sum())]
        free.remove(group[0])
        while len(group) < size:
            b = max(free, key=lambda x: corr[x, group].sum())
            group.append(b)
            free.remove(b)
        out.append(sorted(group))
    return out


def mask_of(bits: list[int]) -> int:
    """A set of bits as a signed long."""
    m = functools.reduce(lambda a, b: a | 1 << b, bits, 0)
    return m - (1 << 64) if m >= 1 << 63 else m


def equal_pairs(distinct: DataFrame, masks: list[int]) -> list[float]:
    """For each mask, the pairs of fingerprints that agree under it."""
    values = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("v"))
                                 for k, m in enumerate(masks)]))
    rows = (distinct.select(values.alias("s")).groupBy("s.k", "s.v").agg(F.count(F.lit(1)).cast("double").alias("c"))
            .groupBy("k").agg(F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("pairs")).collect())
    found = {r["k"]: r["pairs"] for r in rows}
    return [found.get(k, 0.0) for k in range(len(masks))]


def allocate(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """Thresholds, one per partition, with the given sum and the least cost:
    dynamic programming over the partitions."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for s, (c, chosen) in best.items():
            for t, more in cost.items():
                if s + t not in nxt or c + more < nxt[s + t][0]:
                    nxt[s + t] = (c + more, [*chosen, t])
        best = nxt
    return best.get(total, (float("inf"), []))


def choose_partitions(distinct: DataFrame, max_bits: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of every partition that is probed."""
    n, both = bit_counts(distinct)
    layouts = [correlated_partitions(n, both, m) for m in PARTITIONS]
    pairs = iter(equal_pairs(distinct, [mask_of(b) for layout in layouts for b in layout]))
    p = np.diag(both) / max(1, n)
    differ = 2 * p * (1 - p)
    odds = differ / np.maximum(1 - differ, 1e-9)      # that a bit differs to that it does not
    best: tuple[float, list[tuple[list[int], int]]] = (float("inf"), [])
    for layout in layouts:
        costs = []
        for bits in layout:
            equal = next(pairs)
            # what a crowd costs is bounded by its split into neighbours
            def cost(rows, candidates):
                return rows + min(candidates, rows * CROWD)
            costs.append({-1: 0.0, 0: cost(n, equal), 1: cost(n * len(bits), equal * (len(bits) + odds[bits].sum()))})
        c, thresholds = allocate(costs, max_bits - len(layout) + 1)
        if thresholds and c < best[0]:
            best = (c, [(b, t) for b, t in zip(layout, thresholds, strict=True) if t >= 0])
    if not best[1]:
        raise ValueError(f"max_bits must be 0 to {max(PARTITIONS)}")
    return best[1]


def links(distinct: DataFrame, max_bits: int) -> DataFrame:
    """``a, b``: links between distinct fingerprints ``fp``.  All links within
    a signature of few fingerprints, and a star that joins the same ones
    within a neighbourhood of many, so components are whole."""
    signatures = []
    for k, (bits, threshold) in enumerate(choose_partitions(distinct, max_bits)):
        masks = [mask_of(bits)] if threshold == 0 else [mask_of([x for x in bits if x != b]) for b in bits]
        signatures += [F.struct(F.lit(k * BITS + j).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("v"))
                       for j, m in enumerate(masks)]
    rows = distinct.select("fp", F.explode(F.array(*signatures)).alias("s")).select("fp", "s.k", "s.v")
    counts = rows.groupBy("k", "v").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    shared = cut_lineage(rows.join(counts, ["k", "v"]))

    def distance(x, y):
        return F.bit_count(x.bitwiseXOR(y))

    few = shared.filter(F.col("c") <= CROWD).groupBy("k", "v").agg(F.collect_list("fp").alias("all"))
    near = few.select("all", F.explode("all").alias("a")).select(
        "a", F.explode(F.filter("all", lambda y: (y > F.col("a")) & (distance(F.col("a"), y) <= max_bits))).alias("b"))
    if max_bits == 0:                                     # different fingerprints never link
        return near.distinct()
    # one-bit neighbours: two with a neighbour in common are 2 bits apart at most
    flips = F.concat(F.array(F.lit(0).cast("long")), F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)),
                                                                 lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), b)))
    around = (shared.filter(F.col("c") > CROWD).select("fp").distinct()
              .select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("w"))
              .groupBy("w").agg(F.collect_set("fp").alias("all")).filter(F.size("all") > 1))
    if max_bits == 1:                                     # only the neighbour itself is 1 bit apart from all
        around = around.filter(F.array_contains("all", F.col("w")))
    hub = F.col("w") if max_bits == 1 else F.array_min("all")
    crowd = around.select(hub.alias("a"), F.explode("all").alias("b")).filter("a != b")
    return near.unionByName(crowd).distinct()


def fingerprint_components(prints: DataFrame, max_bits: int = 2) -> DataFrame:
    """``fp, root``: the component of every distinct fingerprint of
    ``prints`` that has a link."""
    if not 0 <= max_bits <= 2:
        raise ValueError("max_bits must be 0, 1 or 2")
    distinct = cut_lineage(prints.select("fp").distinct())
    return components(links(distinct, max_bits)).withColumnsRenamed({"node": "fp"})


def simhash_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3,
                   max_bits: int = 2) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fingerprint`` (16 hex digits) and
    ``component_id`` (the smallest id of the linked texts, its own included)."""
    prepare(docs.sparkSession)
    prints = cut_lineage(fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), words=words))
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    # written in between, so the joins can split a large component and a large group of copies
    rooted = cut_lineage(classes.join(fingerprint_components(prints, max_bits), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")))
    ids = cut_lineage(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    by_print = cut_lineage(rooted.join(ids, "root").select("fp", "component_id"))
    return prints.join(by_print, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = 2) -> DataFrame:
    """The rows of ``docs``, all columns as they are, without near-duplicates:
    of each component the row with the smallest id stays (of equal ids, one)."""
    prepare(docs.sparkSession)
    numbered = cut_lineage(docs.withColumn("_quarry_uid", F.monotonically_increasing_id()))
    prints = cut_lineage(fingerprints(
        numbered.select("_quarry_uid", F.col(id_col).alias("_id"), F.col(text_col).alias("text")), words=words))
    # null ids come last
    first = F.min(F.struct(F.col("_id").isNull().alias("z"), F.col("_id"), F.col("_quarry_uid"))).alias("first")
    classes = prints.groupBy("fp").agg(first)
    kept = (classes.join(fingerprint_components(prints, max_bits), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
            .groupBy("root").agg(F.min("first").alias("first")).select(F.col("first._quarry_uid").alias("_quarry_uid")))
    # the rows that go are fewer than those that stay; written, their size is
    # known, and the texts need no shuffle while Spark can broadcast them
    gone = cut_lineage(prints.select("_quarry_uid").join(kept, "_quarry_uid", "left_anti"))
    return numbered.join(gone, "_quarry_uid", "left_anti").select(*docs.columns)
