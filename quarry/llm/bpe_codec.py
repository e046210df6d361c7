"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

Each leaf holds the rank of the pair that starts at that symbol, each inner
node the least of its children, the leftmost among equal ranks.  The root
therefore names the next merge.  A merge changes at most three leaves, each
updated in O(log n), until the root holds no rank.  Words of similar length
are merged together: one row of a numpy matrix is one word's tree, and every
round applies one merge to every word that still has one.

Results: a null text is encoded like an empty one (no ids, empty decoded text);
special strings inside texts become their special ids; repeated rows and null
ids are kept as they are; an empty table gives an empty result.  A very long
text is encoded whole, in a batch of its own if need be (memory of a few times
its length); columns other than the id and the text are not read, whatever
their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._common import prepare, text_or_empty
from quarry.llm._tokens import (ChunkTable, PairTable, Vocabulary, byte_alphabet, load_vocabulary,
                                pre_token_plan)

_NONE = np.int64(1 << 62)


def merge_in_trees(sym: np.ndarray, table: PairTable) -> np.ndarray:
    """``sym``: one word's ids per row, -1 behind its end.  Returns the rows
    after all merges, -1 where a symbol went into its left neighbour."""
    n_words, width = sym.shape
    size = 1 << max(0, (width - 1).bit_length())
    # one more column takes what is written for "no neighbour"
    sym = np.hstack([sym, np.full((n_words, 1), -1, np.int64)])
    nxt = np.tile(np.arange(1, width + 2), (n_words, 1))
    nxt[:, width] = width
    prv = np.tile(np.arange(-1, width), (n_words, 1))
    prv[:, 0] = width
    lengths = (sym >= 0).sum(axis=1)
    nxt[np.arange(n_words)[lengths > 0], lengths[lengths > 0] - 1] = width
    tree = np.full((n_words, 2 * size), _NONE)

    def leaf(rank, at):
        return np.where(rank < table.none, rank * (size + 1) + at, _NONE)

    tree[:, size : size + width] = leaf(table.ranks(sym[:, :width], sym[:, 1:]), np.arange(width))
    step = size
    while step > 1:                                   # children of one level -> parents
        tree[:, step // 2 : step] = np.minimum(tree[:, step : 2 * step : 2], tree[:, step + 1 : 2 * step : 2])
        step //= 2
    root = 1 if size > 1 else size
    row = np.nonzero(tree[:, root] < _NONE)[0]
    while len(row):
        top = tree[row, root]
        i, rank = top % (size + 1), top // (size + 1)
        j = nxt[row, i]
        after, before = nxt[row, j], prv[row, i]
        merged = table.merged[rank]
        sym[row, i], sym[row, j] = merged, -1
        nxt[row, i] = after
        prv[row, after] = i
        for at, value in (
                (j, _NONE),
                (i, leaf(table.ranks(merged, sym[row, after]), i)),
                (before, leaf(table.ranks(sym[row, before], merged), before))):
            here = at < width
            r, k = row[here], at[here] + size
            tree[r, k] = value[here] if isinstance(value, np.ndarray) else value
            while size > 1 and (k := k >> 1)[:1].any():
                tree[r, k] = np.minimum(tree[r, 2 * k], tree[r, 2 * k + 1])
        row = row[tree[row, root] < _NONE]
    return sym[:, :width]


#: Cells of the matrices that are merged at once (a bound on memory).
_CELLS = 1 << 19


def encode_flat(words: list[bytes], table: PairTable):
    """Numbers of words, their ids one after another, and where each word's
    end, for groups of words that are merged together; empty words are left
    out."""
    size = np.array([len(w) for w in words], np.int64)
    order = np.argsort(size, kind="stable")
    at = int((size == 0).sum())
    while at < len(order):
        # words up to the next power of two, within the bound on cells
        width = 1 << (int(size[order[at]]) - 1).bit_length()
        end = min(int(np.searchsorted(size[order], width, side="right")), at + max(1, _CELLS // width))
        part = order[at:end]
        at = end
        sizes = size[part]
        width = int(sizes.max())
        raw = np.frombuffer(b"".join([words[k] for k in part]), np.uint8)
        inside = np.arange(width) < sizes[:, None]
        sym = np.full((len(part), width), -1, np.int64)
        sym[inside] = table.inner[raw]
        sym[np.arange(len(part)), sizes - 1] = table.last[raw[np.cumsum(sizes) - 1]]
        sym = merge_in_trees(sym, table)
        kept = sym >= 0
        yield part, sym[kept], np.cumsum(kept.sum(axis=1))


def encode_words(words: list[bytes], table: PairTable) -> list[list[int]]:
    """Ids of each pre-token."""
    out: list[list[int]] = [[]] * len(words)
    for part, ids, ends in encode_flat(words, table):
        flat, start = ids.tolist(), 0
        for k, stop in zip(part.tolist(), ends.tolist(), strict=True):
            out[k] = flat[start:stop]
            start = stop
    return out


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.table = vocab, PairTable(vocab)
        alphabet, end = byte_alphabet(), vocab.end_of_word
        self.bytes = {}
        for s, i in vocab.ids.items():
            body = s.removesuffix(end) if end else s
            self.bytes[i] = bytes(map(alphabet.__getitem__, body)) + (b" " if body != s else b"")
        self.bytes |= {i: s.encode() for s, i in vocab.added.items()}

    def encode_chunks(self, chunks: list[str]) -> list[list[int]]:
        plan, words = pre_token_plan(self.vocab, chunks, lambda pre: None)
        ids = encode_words(words, self.table)
        return [[i for p in parts for i in (p if isinstance(p, list) else ids[p])] for parts in plan]

    def encode(self, text: str) -> list[int]:
        return [i for ids in self.encode_chunks(self.vocab.chunks(text)) for i in ids]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", errors="replace")


#: Per worker: (vocabulary, use) -> codec and its table of chunks.
_WORKER: dict = {}


def worker_table(vocab: Vocabulary, use: str, value) -> ChunkTable:
    """The worker's chunk table whose values are ``value(codec, ids)``."""
    key = (hash(vocab.source), use)
    if key not in _WORKER:
        codec = Codec(vocab)
        _WORKER[key] = ChunkTable(vocab, lambda chunks: [value(codec, ids) for ids in codec.encode_chunks(chunks)])
    return _WORKER[key]


def map_texts(docs: DataFrame, vocab_path: str, use: str, value, per_text, fields: list[tuple[str, str, pa.DataType]],
              *, id_col: str, text_col: str) -> DataFrame:
    """Run ``per_text(values of the text's chunks)`` over every text; the
    results are the columns ``fields`` after ``doc_id``."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(load_vocabulary(vocab_path))

    def run(batches):
        table = worker_table(shared.value, use, value)
        for b in batches:
            rows = [per_text(v) for v in table.rows(b.column("_text").to_pylist())]
            cols = [pa.array([r[k] for r in rows], t) for k, (_, _, t) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([b.column("_id"), *cols], names=["_id", *[f[0] for f in fields]])

    src = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    id_type = src.schema["_id"].dataType.simpleString()
    out = src.mapInArrow(run, f"_id {id_type}, " + ", ".join(f"{n} {t}" for n, t, _ in fields))
    return out.withColumnRenamed("_id", "doc_id")


def encode(docs: DataFrame, vocab_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids array<int>`` of every whole text."""
    return map_texts(docs, vocab_path, "ids", lambda codec, ids: ids,
                     lambda values: ([i for ids in values for i in ids],),
                     [("ids", "array<int>", pa.list_(pa.int32()))], id_col=id_col, text_col=text_col)


def decode(coded: DataFrame, vocab_path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` from arrays of ids (null: empty text)."""
    spark = coded.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(load_vocabulary(vocab_path))

    def run(batches):
        codec = Codec(shared.value)
        for b in batches:
            texts = [codec.decode(ids or []) for ids in b.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(texts, pa.string())], names=["_id", "text"])

    src = coded.select(F.col(id_col).alias("_id"), F.col(ids_col).alias("_ids"))
    return src.mapInArrow(run, f"_id {src.schema['_id'].dataType.simpleString()}, text string").withColumnRenamed("_id", "doc_id")


def _coded(codec: Codec, ids: list[int]) -> tuple[bytes, int, bytes]:
    """(ids in decimal, their number, the bytes they stand for)."""
    return ",".join(map(str, ids)).encode(), len(ids), b"".join(map(codec.bytes.__getitem__, ids))


def _digests(values: list[tuple[bytes, int, bytes]]) -> tuple[int, str, str]:
    decoded = b"".join([v[2] for v in values]).decode("utf-8", errors="replace").encode()
    return (sum([v[1] for v in values]), hashlib.sha256(b",".join([v[0] for v in values])).hexdigest(),
            hashlib.sha256(decoded).hexdigest())


def round_trip_digests(docs: DataFrame, vocab_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, then decode from the ids: ``doc_id, n_tokens, ids_sha256,
    decoded_sha256``.  One pass, no shuffle."""
    return map_texts(docs, vocab_path, "digests", _coded, _digests,
                     [("n_tokens", "long", pa.int64()), ("ids_sha256", "string", pa.string()),
                      ("decoded_sha256", "string", pa.string())], id_col=id_col, text_col=text_col)
