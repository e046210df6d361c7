"""Removing repeated passages: every byte covered by a ``min_len``-byte string
that also starts in a document with a smaller id.

The repeats themselves come from a Burrows-Wheeler transform by threshold-
bounded interval expansion: starting from the empty string, the intervals of
equal prefixes are extended backwards by one character at a time, breadth
first, so common prefix lengths appear by increasing value; the expansion
stops at ``min_len``, where every interval that is still whole is a set of
equal ``min_len``-byte strings (``equal_windows``).

No machine holds the corpus.  Texts are packed once into compressed blocks in
the shared checkpoint folder, and the work on them is dealt out by content:

1. Every window of ``min_len`` bytes has a key, the least hash of the
   ``GRAM``-byte strings inside, so equal windows have equal keys.  Runs of
   windows with one key form a *segment*.  A block sends its distinct keys to
   buckets, which answer which ones more than one document has.
2. A block sends the contents of its segments with shared keys, each distinct
   content once with its smallest id, to buckets by key.  A bucket runs the
   transform over its contents and answers with the smallest id of every
   window.  The segments of a key with more than ``CROWD`` bytes of them (all
   occurrences counted, also those inside one document) go window by window
   instead, each dealt by its own content.
3. Blocks read the answers and cut their texts.

Copies of a whole text are found first by hash: all but the one with the
smallest id are covered from end to end, so none of their windows travel.
A block sends a key or content once, so what a bucket gets of a passage that a
third of all documents share grows with the number of blocks, not documents.

Results: null texts count as empty; texts shorter than ``min_len`` are kept;
rows with equal ids don't remove anything from each other; rows with a null id
neither lose nor remove anything; an empty table gives an empty result.  A text
longer than a block is a block of its own, its segments are cut every
``LONGEST_RUN`` windows; ``cut_repeats`` hands all columns on, packed with
their row, so names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._common import prepare, shuffle_width, tidy_task
from quarry.session import cut_lineage

#: Bytes of the strings whose least hash is a window's key.
GRAM = 20
#: Text bytes of a block, and of a bucket's contents.
BLOCK_BYTES = 4 << 20
BUCKET_BYTES = 1 << 20
#: Keys that a bucket of the first step gets.
BUCKET_KEYS = 1 << 20
#: A key whose segments have more bytes than this is dealt window by window
#: (which costs a copied segment about ten times its size, once per block).
CROWD = 8 << 20
#: A run of windows is cut here, so that repetitive texts have segments of bounded size.
LONGEST_RUN = 256

_U = np.uint64
_MUL = _U(0x9E3779B97F4A7C15)
_MIX = _U(0xD6E8FEB86659FD93)
_LOW = _U((1 << 40) - 1)


# ---- windows, keys and segments of one text -------------------------------

def _gram_hashes(raw: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k``-byte string of ``raw``, built by doubling."""
    cur, length, power = raw.astype(np.uint64) + _U(1), 1, _MUL
    out, done = None, 0
    with np.errstate(over="ignore"):
        while k:
            if k & 1:
                if out is None:
                    out, done = cur, length
                else:
                    n = min(len(out), len(cur) - done)
                    out = out[:n] * power + cur[done : done + n]
                    done += length
            k >>= 1
            if k:
                n = len(cur) - length
                cur = cur[:n] * power + cur[length : length + n]
                length, power = 2 * length, power * power
        out = (out ^ (out >> _U(32))) * _MIX
    return out ^ (out >> _U(29))


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def window_keys(raw: np.ndarray, min_len: int) -> np.ndarray:
    """Key of every window of ``min_len`` bytes."""
    if len(raw) < min_len:
        return np.empty(0, np.uint64)
    gram = min(GRAM, min_len)
    return _sliding_min(_gram_hashes(raw, gram), min_len - gram + 1)


def _cut_runs(start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of windows in pieces of ``LONGEST_RUN`` at most."""
    if not len(n) or n.max() <= LONGEST_RUN:
        return start, n
    parts = -(-n // LONGEST_RUN)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    return np.repeat(start, parts) + nth * LONGEST_RUN, np.minimum(np.repeat(n, parts) - nth * LONGEST_RUN, LONGEST_RUN)


# ---- the transform ---------------------------------------------------------

def _sorted_places(key: np.ndarray, key_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the order of their keys, and the ordered keys.  Key and
    position are sorted as one number where they fit one."""
    n = len(key)
    place_bits = n.bit_length()
    if key_bits + place_bits <= 63:
        both = np.sort(key << place_bits | np.arange(n))
        return both & ((1 << place_bits) - 1), both >> place_bits
    order = np.argsort(key)
    return order, key[order]


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``text`` (small whole numbers) in the order of the strings
    that start there, compared over their first ``depth`` characters at least,
    by prefix doubling from strings that fit one number."""
    n = len(text)
    lowest = int(text.min(initial=0))
    used = np.bincount(text - lowest) > 0
    codes = np.cumsum(used)[text - lowest]           # from 1; past the end: 0
    bits, rank_bits = int(codes.max(initial=1)).bit_length(), (n + 1).bit_length()
    width = max(1, (63 - n.bit_length()) // bits)
    rank = np.zeros(n, np.int64)
    for k in range(width):
        rank <<= bits
        rank[: max(0, n - k)] |= codes[k:]
    key_bits = bits * width
    while True:
        order, ordered = _sorted_places(rank, key_bits)
        if width >= depth:
            return order
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate([[1], ordered[1:] != ordered[:-1]]))
        rank = new << rank_bits
        rank[: max(0, n - width)] |= new[width:]
        key_bits = 2 * rank_bits
        width *= 2


def equal_windows(contents: list[bytes], min_len: int) -> tuple[np.ndarray, np.ndarray]:
    """For every position of the contents, laid out one after another with a
    separator behind each, the number of its class of equal ``min_len``-byte
    strings (-1 where no such string starts).  Second, where each content
    starts.

    ``border`` marks the rows of the transform's matrix whose common prefix
    with the row above is shorter than the value reached so far.  Extending an
    interval backwards by a character maps its rows to neighbouring rows, so a
    row splits from the one above in the round after the rows they came from
    were split.  Where these are neighbours too (a run of the transform), a new
    border hands itself on; the other rows compare the number of borders above
    the two."""
    sizes = np.array([len(c) for c in contents], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    n = int((sizes + 1).sum())
    text = np.empty(n, np.int16)
    text[:] = np.frombuffer(b"\0".join(contents) + b"\0", np.uint8)
    text[starts + sizes] = -1
    order = suffix_order(text, min_len)
    place = np.empty(n, np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    follow = place[np.minimum(order + 1, n - 1)]     # the row without its first character
    extend = place[np.maximum(order - 1, 0)]         # the row with the transform's character in front
    first = text[order]
    same = np.zeros(n, bool)
    same[1:] = first[1:] == first[:-1]
    border = ~same
    handed = same.copy()
    handed[1:] &= follow[1:] == follow[:-1] + 1
    waiting = np.nonzero(same & ~handed)[0]
    upper, lower = follow[waiting - 1], follow[waiting]
    new = np.nonzero(border)[0]
    for _ in range(1, min_len):                      # the value of the common prefix
        if not len(new):
            break
        seen = np.cumsum(border, dtype=np.int32)
        split = seen[lower] != seen[upper]
        at = extend[new]
        at = at[handed[at] & (follow[at] == new) & ~border[at]]
        new = np.concatenate([at, waiting[split]])
        border[new] = True
        waiting, upper, lower = waiting[~split], upper[~split], lower[~split]
    out = np.empty(n, np.int64)
    out[order] = np.cumsum(border) - 1
    end = np.repeat(starts + sizes, sizes + 1)
    out[np.arange(n) + min_len > end] = -1
    return out, starts


def smallest_ids(contents: list[bytes], ids: np.ndarray, min_len: int) -> list[np.ndarray]:
    """For every window of every content, the smallest id of a content that
    holds an equal window."""
    if not contents:
        return []
    classes, starts = equal_windows(contents, min_len)
    sizes = np.array([len(c) for c in contents], np.int64)
    at = np.nonzero(classes >= 0)[0]
    least = np.full(int(classes.max(initial=-1)) + 1, np.iinfo(np.int64).max)
    owner = np.repeat(np.arange(len(contents)), sizes + 1)
    np.minimum.at(least, classes[at], ids[owner[at]])
    return [least[classes[s : s + size - min_len + 1]] for s, size in zip(starts.tolist(), sizes.tolist(), strict=True)]


# ---- blocks ----------------------------------------------------------------

def _write_batch(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _read_batch(raw: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(raw).read_next_batch()


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("_quarry_raw").to_pylist()]


def pack_blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``block, ids, hashes, sizes, data``: rows packed with all their columns,
    written to the shared checkpoint folder (their numbers are final then)."""
    src = docs.withColumns({"_quarry_raw": F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"),
                            "_quarry_id": F.col(id_col).cast("long")}).drop(text_col)
    schema = "block long, ids array<long>, hashes array<binary>, sizes array<long>, data binary"

    def run(batches):
        base, nth = TaskContext.get().partitionId() << 33, 0
        for b in batches:
            sizes = np.array([len(t) for t in _texts(b)], np.int64)
            ends = np.cumsum(sizes)
            at = 0
            while at < len(sizes):
                done = ends[at - 1] if at else 0
                stop = max(at + 1, int(np.searchsorted(ends, done + BLOCK_BYTES, side="right")))
                part = b.slice(at, stop - at)
                texts = _texts(part)
                row = [[base + nth], [part.column("_quarry_id").to_pylist()],
                       [[hashlib.sha256(t).digest() for t in texts]], [[len(t) for t in texts]], [_write_batch(part)]]
                types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)],
                                                 names=["block", "ids", "hashes", "sizes", "data"])
                nth += 1
                at = stop

    return cut_lineage(src.mapInArrow(tidy_task(run), schema))


def copies(blocks: DataFrame, min_len: int) -> DataFrame:
    """``block, nth``: rows whose whole text a row with a smaller id has."""
    rows = blocks.select("block", F.posexplode(F.arrays_zip("ids", "hashes", "sizes")).alias("nth", "d")).select(
        "block", "nth", "d.*").filter(F.col("ids").isNotNull() & (F.col("sizes") >= min_len))
    least = rows.groupBy("hashes").agg(F.min("ids").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    # written first, so the join sees both sides' sizes and can split a large group of copies
    return rows.join(cut_lineage(least), "hashes").filter("ids > least").select("block", "nth")


#: Bytes of texts whose keys are computed together (small enough for a cache).
_TOGETHER = 1 << 18


def text_segments(texts: list[bytes], rows: list[int], min_len: int):
    """Key, row, start and number of windows of the segments of ``texts`` at
    ``rows``."""
    out, part, size = [], [], 0

    def flush():
        raw = np.frombuffer(b"".join([texts[k] for k in part]), np.uint8)
        sizes = np.array([len(texts[k]) for k in part], np.int64)
        first = np.cumsum(sizes) - sizes
        keys = window_keys(raw, min_len)
        # windows over the border of two texts are none
        inside = np.ones(len(keys), bool)
        for end in (first[1:]).tolist():
            inside[max(0, end - min_len + 1) : end] = False
        fresh = np.ones(len(keys), bool)
        fresh[1:] = (keys[1:] != keys[:-1]) | ~inside[:-1]
        start = np.nonzero(fresh & inside)[0]
        # a segment ends where the next run, or what is none, begins
        stop = np.nonzero(np.append(inside[:-1] & (fresh[1:] | ~inside[1:]), inside[-1:]))[0] + 1
        start, n = _cut_runs(start, stop - start)
        row = np.searchsorted(first, start, side="right") - 1
        out.append((keys[start], np.array(part, np.int64)[row], start - first[row], n))

    for k in rows:
        if len(texts[k]) < min_len:
            continue
        part.append(k)
        size += len(texts[k])
        if size >= _TOGETHER:
            flush()
            part, size = [], 0
    if part:
        flush()
    if not out:
        return np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3))
    return tuple(np.concatenate([o[k] for o in out]) for k in range(4))


class _Block:
    """A block's texts with their segments."""

    def __init__(self, ids: list, data: bytes, min_len: int):
        self.min_len, self.ids = min_len, ids
        self.batch = _read_batch(data)
        self.texts = _texts(self.batch)
        self.key, self.row, self.start, self.n = text_segments(
            self.texts, [k for k, i in enumerate(ids) if i is not None], min_len)

    def distinct_keys(self, buckets: int):
        """Distinct keys by bucket, then low bits; for each the number of
        documents and the bytes of its segments."""
        bucket = ((self.key >> _U(40)) % _U(buckets)).astype(np.int64)
        order = np.lexsort((self.key & _LOW, bucket)) if buckets >= 1 << 22 else np.argsort(
            bucket << 40 | (self.key & _LOW).astype(np.int64))
        bucket, low, row = bucket[order], (self.key[order] & _LOW).astype(np.int64), self.row[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (low[1:] != low[:-1]) | (bucket[1:] != bucket[:-1])
        number = np.cumsum(fresh) - 1
        inverse = np.empty(len(order), np.int64)
        inverse[order] = number
        # documents per key: its distinct rows
        pair = np.sort(number * (len(self.texts) + 1) + row)
        pair = pair[np.concatenate([[True], pair[1:] != pair[:-1]])[: len(pair)]]
        docs = np.bincount(pair // (len(self.texts) + 1), minlength=int(fresh.sum()))
        load = np.bincount(inverse, self.n + self.min_len - 1, minlength=int(fresh.sum()))
        return bucket[fresh], low[fresh], docs, load, inverse

    def contents(self, status: np.ndarray, inverse: np.ndarray, buckets: int):
        """Distinct contents by bucket, as (bucket, content, smallest id), and
        per segment that was sent (row, first window, windows, number of its
        content).  A crowded key's segment has ``~k`` for its number, and its
        windows' contents are the k-th list of the last result."""
        of_segment = status[inverse] if len(status) else np.empty(0, np.int64)
        chosen = np.nonzero(of_segment)[0]
        found: dict[bytes, int] = {}
        bucket_of, least, places = [], [], []
        more = self.min_len - 1
        # a crowded key's segment -> its number; its windows' contents, its smallest id
        crowded: dict[bytes, int] = {}
        windows: list[list[int]] = []
        smallest: list[int] = []

        def number(content: bytes, doc: int, bucket: int) -> int:
            at = found.setdefault(content, len(least))
            if at == len(least):
                least.append(doc)
                bucket_of.append(bucket)
            elif doc < least[at]:
                least[at] = doc
            return at

        # a key's bucket; crowded ones are dealt by the window itself
        with np.errstate(over="ignore"):
            dealt = ((self.key[chosen] * _MIX) >> _U(20)) % _U(buckets)
        for status_k, row, start, n, bucket in zip(of_segment[chosen].tolist(), self.row[chosen].tolist(), self.start[chosen].tolist(),
                                                   self.n[chosen].tolist(), dealt.astype(np.int64).tolist(), strict=True):
            content, doc = self.texts[row][start : start + n + more], self.ids[row]
            if status_k == 1:
                places.append((row, start, n, number(content, doc, bucket)))
                continue
            at = crowded.setdefault(content, len(windows))
            if at == len(windows):
                parts = [content[w : w + self.min_len] for w in range(n)]
                windows.append([number(p, doc, int.from_bytes(hashlib.blake2b(p, digest_size=8).digest(), "little") % buckets) for p in parts])
                smallest.append(doc)
            elif doc < smallest[at]:
                smallest[at] = doc
            places.append((row, start, n, ~at))
        for numbers, doc in zip(windows, smallest, strict=True):
            for at in numbers:
                if doc < least[at]:
                    least[at] = doc
        return bucket_of, list(found), least, places, windows


def _by_bucket(bucket: np.ndarray):
    """(bucket, slice of positions) over a sorted array."""
    if not len(bucket):
        return
    edges = np.concatenate([[0], np.nonzero(bucket[1:] != bucket[:-1])[0] + 1, [len(bucket)]])
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield int(bucket[a]), slice(a, b)


_ASKED = "bucket long, block long, keys binary, docs binary, loads binary"
_SENT = "bucket long, block long, sizes binary, contents binary, ids binary"
_ANSWER = "block long, step int, bucket long, answer binary"


def _five_bytes(values: np.ndarray) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _from_five(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel().astype(np.int64)


def ask_keys(blocks: DataFrame, min_len: int, buckets: int) -> DataFrame:
    def run(batches):
        for b in batches:
            for block, ids, data in zip(*(b.column(c).to_pylist() for c in ("block", "ids", "data")), strict=True):
                bucket, low, docs, load, _ = _Block(ids, data, min_len).distinct_keys(buckets)
                out = [[], [], [], [], []]
                for k, part in _by_bucket(bucket):
                    for col, v in zip(out, (k, block, _five_bytes(low[part]),
                                            np.minimum(docs[part], 255).astype(np.uint8).tobytes(),
                                            np.minimum(load[part], 0xFFFFFFFF).astype("<u4").tobytes()), strict=True):
                        col.append(v)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)],
                    names=["bucket", "block", "keys", "docs", "loads"])

    return blocks.select("block", "ids", "data").mapInArrow(tidy_task(run), _ASKED)


def answer_keys(asked: DataFrame, crowd: int) -> DataFrame:
    """Per block and bucket a byte for each key: 0 one document has it, 1
    several, 2 several with more than ``crowd`` bytes of segments."""
    def run(table: pa.Table) -> pa.Table:
        block, keys, docs, loads = (table.column(c).to_pylist() for c in ("block", "keys", "docs", "loads"))
        parts = [_from_five(k) for k in keys]
        key = np.concatenate(parts)
        order = np.argsort(key)
        fresh = np.concatenate([[True], key[order[1:]] != key[order[:-1]]])
        inverse = np.empty(len(key), np.int64)
        inverse[order] = np.cumsum(fresh) - 1
        # counts per block stop at 255, enough to tell one document from several
        total = np.bincount(inverse, weights=np.concatenate([np.frombuffer(d, np.uint8) for d in docs]))
        load = np.bincount(inverse, weights=np.concatenate([np.frombuffer(x, "<u4") for x in loads]))
        status = ((total > 1).astype(np.uint8) * (1 + (load > crowd)))[inverse].astype(np.uint8)
        ends = np.cumsum([len(p) for p in parts])
        answer = [np.packbits(np.stack([s & 1 | s >> 1, s >> 1])).tobytes() if s.any() else b""
                  for s in np.split(status, ends[:-1])]
        bucket = table.column("bucket").to_pylist()
        return pa.table([pa.array(block, pa.int64()), pa.array([1] * len(block), pa.int32()), pa.array(bucket, pa.int64()),
                         pa.array(answer, pa.binary())], names=["block", "step", "bucket", "answer"])

    return asked.groupBy("bucket").applyInArrow(run, _ANSWER)


def _read_status(answers: dict[int, bytes], bucket: np.ndarray) -> np.ndarray:
    status = np.zeros(len(bucket), np.int64)
    for k, part in _by_bucket(bucket):
        raw = answers.get(k, b"")
        if raw:
            n = part.stop - part.start
            bits = np.unpackbits(np.frombuffer(raw, np.uint8))[: 2 * n]
            status[part] = bits[:n].astype(np.int64) + bits[n:]
    return status


def send_contents(joined: DataFrame, min_len: int, key_buckets: int, buckets: int) -> DataFrame:
    def run(batches):
        for b in batches:
            for row in (b.slice(k, 1).to_pylist()[0] for k in range(b.num_rows)):
                _, bucket_of, contents, least, _, _ = _judge_block(row, min_len, key_buckets, buckets)
                order = np.argsort(np.array(bucket_of, np.int64), kind="stable")
                sorted_bucket = np.array(bucket_of, np.int64)[order]
                out = [[], [], [], [], []]
                for k, part in _by_bucket(sorted_bucket):
                    chosen = order[part].tolist()
                    for col, v in zip(out, (
                            k, row["block"], np.array([len(contents[c]) for c in chosen], "<i4").tobytes(),
                            b"".join([contents[c] for c in chosen]),
                            np.array([least[c] for c in chosen], "<i8").tobytes()), strict=True):
                        col.append(v)
                types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=True)],
                                                 names=["bucket", "block", "sizes", "contents", "ids"])

    return joined.mapInArrow(tidy_task(run), _SENT)


def _judge_block(row: dict, min_len: int, key_buckets: int, buckets: int):
    """A block's segments that go to step 2."""
    answers = {a["bucket"]: a["answer"] for a in row["answers"] or [] if a["step"] == 1}
    skip = frozenset(row["copies"] or ())
    # keys are asked for over all texts of the block, segments are sent without copies
    asked = _Block(row["ids"], row["data"], min_len)
    bucket, _, _, _, inverse = asked.distinct_keys(key_buckets)
    status = _read_status(answers, bucket)
    if skip:
        keep = ~np.isin(asked.row, list(skip))
        asked.key, asked.start, asked.n, asked.row = (x[keep] for x in (asked.key, asked.start, asked.n, asked.row))
        inverse = inverse[keep]
    return asked, *asked.contents(status, inverse, buckets)


def answer_contents(sent: DataFrame, min_len: int) -> DataFrame:
    """Per block and bucket the smallest id of every window, in the order the
    contents were sent: run lengths and ids."""
    def run(table: pa.Table) -> pa.Table:
        block, bucket, sizes, contents, ids = (table.column(c).to_pylist() for c in ("block", "bucket", "sizes", "contents", "ids"))
        distinct: dict[bytes, int] = {}
        least: list[int] = []
        refs = []
        for s, raw, i in zip(sizes, contents, ids, strict=True):
            ends = np.cumsum(np.frombuffer(s, "<i4")).tolist()
            ref, at = [], 0
            for end, doc in zip(ends, np.frombuffer(i, "<i8").tolist(), strict=True):
                c = raw[at:end]
                at = end
                k = distinct.setdefault(c, len(distinct))
                if k == len(least):
                    least.append(doc)
                elif doc < least[k]:
                    least[k] = doc
                ref.append(k)
            refs.append(ref)
        found = smallest_ids(list(distinct), np.array(least, np.int64), min_len)
        answer = []
        for ref in refs:
            flat = np.concatenate([found[k] for k in ref])
            edge = np.concatenate([[0], np.nonzero(flat[1:] != flat[:-1])[0] + 1])
            runs = np.diff(np.append(edge, len(flat)))
            answer.append(np.array([len(edge)], "<i8").tobytes() + runs.astype("<i4").tobytes() + flat[edge].astype("<i8").tobytes())
        return pa.table([pa.array(block, pa.int64()), pa.array([2] * len(block), pa.int32()), pa.array(bucket, pa.int64()),
                         pa.array(answer, pa.binary())], names=["block", "step", "bucket", "answer"])

    return sent.groupBy("bucket").applyInArrow(run, _ANSWER)


def _read_ids(raw: bytes) -> np.ndarray:
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    return np.repeat(np.frombuffer(raw, "<i8", n, 8 + 4 * n), np.frombuffer(raw, "<i4", n, 8))


def _removed(row: dict, min_len: int, key_buckets: int, buckets: int):
    """The block, and for each of its texts the mask of bytes to remove (None:
    nothing)."""
    block, bucket_of, contents, _, places, windows = _judge_block(row, min_len, key_buckets, buckets)
    per_content: dict[int, np.ndarray] = {}
    answers = {a["bucket"]: a["answer"] for a in row["answers"] or [] if a["step"] == 2}
    order = np.argsort(np.array(bucket_of, np.int64), kind="stable")
    for k, part in _by_bucket(np.array(bucket_of, np.int64)[order]):
        ids, at = _read_ids(answers[k]), 0
        for c in order[part].tolist():
            n = len(contents[c]) - min_len + 1
            per_content[c] = ids[at : at + n]
            at += n
    starts: dict[int, list[np.ndarray]] = defaultdict(list)
    by_window = [np.concatenate([per_content[c] for c in numbers]) for numbers in windows]
    for text, s, _, c in places:
        hit = np.nonzero((per_content[c] if c >= 0 else by_window[~c]) < block.ids[text])[0]
        if len(hit):
            starts[text].append(hit + s)
    masks: list[np.ndarray | None] = [None] * len(block.texts)
    for text, parts in starts.items():
        at = np.concatenate(parts)
        change = np.zeros(len(block.texts[text]) + 1, np.int32)
        np.add.at(change, at, 1)
        np.add.at(change, at + min_len, -1)
        masks[text] = np.cumsum(change[:-1]) > 0
    for k in row["copies"] or ():
        masks[k] = np.ones(len(block.texts[k]), bool)
    return block, masks


def _blocks_with_masks(docs: DataFrame, id_col: str, text_col: str, min_len: int, crowd: int):
    """The joined blocks and the function that a task applies to each."""
    spark = docs.sparkSession
    prepare(spark)
    blocks = pack_blocks(docs, id_col, text_col)
    size = blocks.select(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    width = shuffle_width(docs)
    # a window's key changes about twice per min_len - GRAM + 2 bytes
    key_buckets = max(width, -(-2 * size // max(1, min_len - GRAM + 2) // BUCKET_KEYS))
    asked = ask_keys(blocks, min_len, key_buckets).repartition(width, "bucket")
    known = cut_lineage(answer_keys(asked, crowd).filter("length(answer) > 0"))
    gone = copies(blocks, min_len).groupBy("block").agg(F.collect_list("nth").alias("copies"))
    gone = cut_lineage(gone)

    def with_answers(answers: DataFrame) -> DataFrame:
        per_block = answers.groupBy("block").agg(F.collect_list(F.struct("step", "bucket", "answer")).alias("answers"))
        return (blocks.select("block", "ids", "data").join(per_block, "block", "left").join(gone, "block", "left"))

    shared = known.select(F.sum(F.bit_length("answer"))).first()[0] or 0
    buckets = max(width, -(-shared * 4 * min_len // 3 // 8 // BUCKET_BYTES))
    sent = send_contents(with_answers(known), min_len, key_buckets, buckets)
    told = cut_lineage(answer_contents(sent, min_len))
    return with_answers(known.unionByName(told)), lambda row: _removed(row, min_len, key_buckets, buckets)


def removal_digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_len: int = 50,
                    crowd: int = CROWD) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans,
    kept_sha256``."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    joined, removed = _blocks_with_masks(slim, "doc_id", "text", min_len, crowd)
    id_type = slim.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            for row in (b.slice(k, 1).to_pylist()[0] for k in range(b.num_rows)):
                block, masks = removed(row)
                out = []
                for t, m in zip(block.texts, masks, strict=True):
                    if m is None:
                        out.append((len(t), 0, 0, hashlib.sha256(t).hexdigest()))
                    else:
                        raw = np.frombuffer(t, np.uint8)
                        spans = int(m[:1].sum()) + int((m[1:] & ~m[:-1]).sum())
                        out.append((len(t), int(m.sum()), spans, hashlib.sha256(raw[~m].tobytes()).hexdigest()))
                cols = [pa.array([o[k] for o in out], pa.int64()) for k in range(3)]
                yield pa.RecordBatch.from_arrays([block.batch.column("doc_id"), *cols, pa.array([o[3] for o in out], pa.string())],
                                                 names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.mapInArrow(tidy_task(run), f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_len: int = 50,
                crowd: int = CROWD) -> DataFrame:
    """``docs``, all columns, with repeated passages cut from the text.  A
    character of several bytes that is cut in two goes as a whole.  Null
    texts come back empty."""
    joined, removed = _blocks_with_masks(docs, id_col, text_col, min_len, crowd)
    schema = docs.schema

    def run(batches):
        for b in batches:
            for row in (b.slice(k, 1).to_pylist()[0] for k in range(b.num_rows)):
                block, masks = removed(row)
                kept = [t if m is None else np.frombuffer(t, np.uint8)[~m].tobytes()
                        for t, m in zip(block.texts, masks, strict=True)]
                texts = pa.array([t.decode("utf-8", errors="ignore") for t in kept], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [texts if f.name == text_col else block.batch.column(f.name) for f in schema.fields],
                    names=[f.name for f in schema.fields])

    return joined.mapInArrow(tidy_task(run), schema)
