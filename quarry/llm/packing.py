"""Packing documents into sequences of at most ``max_len`` tokens.

Pattern packing by non-negative least squares: piece lengths are grouped into
classes, every pattern of two or three classes that can fill a sequence is
enumerated, and the patterns' repeat counts are fitted to the class histogram
by non-negative least squares and rounded down.  The patterns are then filled
with real lengths, and what is left goes to the fullest sequence it fits
(best fit, longest first).

The plan is made from the histogram of lengths alone (at most ``max_len``
numbers whatever the data), on the driver; it says, per length, which run of
its pieces goes to which run of sequences at which offset.  Pieces get their
numbers within a length and their places on Spark.

Results: a null text is packed as an empty one (its end token alone); repeated
rows are packed separately; null ids are kept; an empty table gives an empty
result.  Texts over two million characters are split into tokens piece by
piece, at white space; columns other than the id and the text are not read,
whatever their names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections import defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm._common import prepare, text_or_empty, tidy_task
from quarry.llm._tokens import ChunkTable, PairTable, Vocabulary, is_plain_text, load_vocabulary, pre_token_plan
from quarry.llm.bpe_codec import encode_flat
from quarry.session import cut_lineage

#: Length classes of the fit: a class is ``max_len / CLASSES`` tokens wide.
CLASSES = 64
#: Lengths under so many class widths are left to fill gaps.
GAP_CLASSES = 2


#: Characters that are split together; longer texts are cut at white space.
_TOGETHER = 2_000_000

# Fixed value: the split pattern whose words ``Splitter`` finds.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)


class Splitter:
    """Pre-tokens of ``WORD_PATTERN`` in UTF-8 text, all of a text at a time.

    A word starts where the kind of character changes and at every number; an
    apostrophe that starts a word takes the letters of a contraction with it.
    Kinds are those of ``regex``."""

    def __init__(self):
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
        self.kinds = np.full(1 << 16, _OTHER, np.uint8)
        for kind, name in ((_SPACE, r"\s"), (_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}")):
            self.kinds[[ord(c) for c in regex.findall(name, every)]] = kind
        self.by_byte = self.kinds[:256].tobytes()

    def starts(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Per byte of a text that ends in a line break and has no character
        past U+FFFF: whether a word starts there, and whether it is in one."""
        raw = np.frombuffer(text, np.uint8)
        kind = np.frombuffer(bytearray(text.translate(self.by_byte)), np.uint8)
        wide = np.nonzero(raw >= 0xC0)[0]
        if len(wide):
            lead, second = raw[wide].astype(np.int64), (raw[wide + 1] & 0x3F).astype(np.int64)
            three = lead >= 0xE0
            kind[wide] = kind[wide + 1] = self.kinds[(lead & 0x1F) << 6 | second]
            at = wide[three]
            kind[at] = kind[at + 1] = kind[at + 2] = self.kinds[(lead[three] & 0x0F) << 12 | second[three] << 6 | raw[at + 2] & 0x3F]
        inside = kind != _SPACE
        start = kind == _NUMBER
        start[:1] = True
        start[1:] |= kind[1:] != kind[:-1]
        start &= inside
        if len(wide):
            start &= (raw & 0xC0) != 0x80              # not within a character
        quote = np.nonzero(raw == ord("'"))[0]
        quote = quote[start[quote]]
        a, b = raw[quote + 1], raw[np.minimum(quote + 2, len(raw) - 1)]
        one = (a == ord("s")) | (a == ord("t")) | (a == ord("m")) | (a == ord("d"))
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        start[quote[one | two] + 1] = False
        for end in (quote[one] + 2, quote[two] + 3):
            start[end] |= inside[end]
        return start, inside


class RawIds:
    """Ids of texts as little-endian bytes.

    Plain texts (no special strings or rare characters) under
    ``WORD_PATTERN``, where a vocabulary drops white space, are split into
    pre-tokens many at a time, one text to a line; their distinct pre-tokens
    are looked up in one table, and only new ones are merged, all of a batch
    together.  Other texts go by chunks."""

    def __init__(self, vocab: Vocabulary, entries: int = 500_000):
        self.vocab, self.pairs, self.entries = vocab, PairTable(vocab), entries
        # pre-tokens looked up lately, and those of the time before
        self.words: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.chunks = ChunkTable(vocab, self.encode_chunks, entries=entries // 16)
        self.splitter = Splitter() if vocab.end_of_word and vocab.pattern == WORD_PATTERN else None

    def rows(self, texts: list[str]):
        """The ids of each text."""
        part: list[str] = []
        size = 0
        for t in texts:
            if len(t) > _TOGETHER:
                yield from self._batch(part)
                part, size = [], 0
                yield b"".join(x for piece in _slices(t) for x in self._batch([piece]))
                continue
            part.append(t)
            size += len(t)
            if size >= _TOGETHER:
                yield from self._batch(part)
                part, size = [], 0
        yield from self._batch(part)

    def _batch(self, texts: list[str]) -> list[bytes]:
        out = [b""] * len(texts)
        plain = [self.splitter is not None and self.vocab.added_start not in t and is_plain_text(t) for t in texts]
        if own := [k for k, p in enumerate(plain) if p]:
            for k, raw in zip(own, self._lines([texts[k] for k in own]), strict=True):
                out[k] = raw
        other = [k for k, p in enumerate(plain) if not p]
        for k, values in zip(other, self.chunks.rows([texts[k] for k in other]), strict=True):
            out[k] = b"".join(values)
        return out

    def _lines(self, texts: list[str]):
        """The ids of each of some plain texts."""
        lines = [t.replace("\n", " ") for t in texts]
        text = "\n".join([t.lower() for t in lines] if self.vocab.lower else lines).encode() + b"\n"
        start, inside = self.splitter.starts(text)
        raw = np.frombuffer(text, np.uint8)
        # words one behind the other, without the white space between them
        data, first = raw[inside], np.nonzero(start[inside])[0]
        borders = np.append(first, len(data)).astype(np.int32)
        found = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(borders), pa.py_buffer(data)]).dictionary_encode()
        coded = self.known(found.dictionary.to_pylist())
        sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        flat, code = np.frombuffer(b"".join(coded), "<u4"), found.indices.to_numpy()
        n = sizes[code]
        ends = np.append(0, np.cumsum(n))
        ids = flat[np.arange(ends[-1]) + np.repeat((np.cumsum(sizes) - sizes)[code] - ends[:-1], n)].tobytes()
        at = 0
        for stop in (4 * ends[np.searchsorted(np.nonzero(start)[0], np.nonzero(raw == ord("\n"))[0])]).tolist():
            yield ids[at:stop]
            at = stop

    def known(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct pre-tokens.  They are kept until half of
        ``entries`` others have come since the last look at them."""
        if len(self.words) > self.entries // 2:
            self.words, self.older = {}, self.words
        out = list(map(self.words.get, words))
        new = []
        for k in [k for k, raw in enumerate(out) if raw is None]:
            out[k] = self.older.get(words[k])
            if out[k] is None:
                new.append(k)
            else:
                self.words[words[k]] = out[k]
        for k, raw in zip(new, encode_raw([words[k] for k in new], self.pairs), strict=True):
            out[k] = raw
            if len(words[k]) <= self.chunks.longest:
                self.words[words[k]] = raw
        return out

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        plan, new = pre_token_plan(self.vocab, chunks, lambda pre: None)
        raws = encode_raw(new, self.pairs)
        return [b"".join([np.array(p, "<u4").tobytes() if isinstance(p, list) else raws[p] for p in parts]) for parts in plan]


def _slices(text: str):
    """A long text in pieces, cut at white space where there is some."""
    at = 0
    while at < len(text):
        end = at + _TOGETHER
        if end < len(text):
            cut = max(text.rfind(" ", at, end), text.rfind("\n", at, end))
            if cut > at:
                end = cut
            else:                                      # one word over the limit: up to its end
                later = [x for x in (text.find(" ", end), text.find("\n", end)) if x > 0]
                end = min(later, default=len(text))
        yield text[at:end]
        at = end


def encode_raw(words: list[bytes], pairs: PairTable) -> list[bytes]:
    """Ids of each pre-token, as little-endian bytes."""
    out = [b""] * len(words)
    for part, flat, ends in encode_flat(words, pairs):
        raw, start = flat.astype("<u4").tobytes(), 0
        for k, stop in zip(part.tolist(), (4 * ends).tolist(), strict=True):
            out[k] = raw[start:stop]
            start = stop
    return out


_WORKER: dict[int, RawIds] = {}


def worker_ids(vocab: Vocabulary) -> RawIds:
    """The worker's tables of this vocabulary."""
    key = hash(vocab.source)
    if key not in _WORKER:
        _WORKER[key] = RawIds(vocab)
    return _WORKER[key]


def pieces(docs: DataFrame, vocab_path: str, *, max_len: int = 4096, end_id: int = 1, id_col: str = "doc_id",
           text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Tokenise whole texts, add ``end_id``, and cut what is longer than
    ``max_len``: ``doc_id, piece, start, length, ids_crc32`` (and ``ids``)."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(load_vocabulary(vocab_path))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        table = worker_ids(shared.value)
        for b in batches:
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for k, raw in enumerate(table.rows(b.column("_text").to_pylist())):
                raw += end
                for p, at in enumerate(range(0, len(raw), 4 * max_len)):
                    part = raw[at : at + 4 * max_len]
                    row.append(k)
                    piece.append(p)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            cols = [b.column("_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols, names = [*cols, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    src = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    schema = (f"_id {src.schema['_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
              + (", ids array<int>" if with_ids else ""))
    return src.mapInArrow(tidy_task(run, "packing"), schema).withColumnRenamed("_id", "doc_id")


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by the active-set method: columns
    enter by the largest gradient and leave when their value turns negative."""
    n = a.shape[1]
    x, used = np.zeros(n), np.zeros(n, bool)
    scale = max(1.0, float(np.abs(b).max(initial=0.0)))
    while True:
        slope = a.T @ (b - a @ x)
        slope[used] = -np.inf
        k = int(np.argmax(slope)) if n else -1
        if k < 0 or slope[k] <= 1e-9 * scale or used.sum() >= a.shape[0]:
            return x
        used[k] = True
        while True:
            s = np.zeros(n)
            s[used] = np.linalg.lstsq(a[:, used], b, rcond=None)[0]
            if s[used].min(initial=0.0) >= 0:
                if np.linalg.norm(a @ s - b) >= np.linalg.norm(a @ x - b) * (1 - 1e-12):
                    return x
                x = s
                break
            low = used & (s <= 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                step = np.where(low, x / (x - s), np.inf)
            if not np.isfinite(step).any():
                return x
            x = np.clip(x + np.nanmin(step) * (s - x), 0, None)
            used &= x > 1e-12 * scale


def patterns(classes: int, smallest: int) -> list[tuple[int, ...]]:
    """Two or three classes, at least ``smallest``, longest first, whose
    lengths can fill a sequence: class c holds lengths from c widths up to
    under c + 1, so the classes of k lengths add up to ``classes - k + 1``
    (or one less, never more than ``classes``)."""
    out = []
    for total in (classes, classes - 1, classes - 2):
        for a in range(classes - 1, smallest - 1, -1):
            for b in range(min(a, total - a), smallest - 1, -1):
                if a + b == total and total >= classes - 1:
                    out.append((a, b))
                c = total - a - b
                if smallest <= c <= b and total < classes:
                    out.append((a, b, c))
    return out


class _Plan:
    """Runs of pieces placed on runs of sequences.  ``rows``: (length, first
    piece, pieces, first sequence, offset), piece k of a run going to the
    k-th sequence of it."""

    def __init__(self, counts: dict[int, int], max_len: int):
        self.left, self.next, self.max_len = dict(counts), defaultdict(int), max_len
        self.rows: list[tuple[int, int, int, int, int]] = []
        self.sequences = 0
        self.open: dict[int, list[tuple[int, int]]] = defaultdict(list)   # room -> runs of sequences

    def place(self, length: int, n: int, sequence: int, offset: int) -> None:
        self.rows.append((length, self.next[length], n, sequence, offset))
        self.next[length] += n
        self.left[length] -= n

    def new_run(self, lengths: list[int], n: int) -> None:
        """``n`` new sequences, each with these lengths."""
        at = 0
        for length in lengths:
            self.place(length, n, self.sequences, at)
            at += length
        if at < self.max_len:
            self.open[self.max_len - at].append((self.sequences, n))
        self.sequences += n

    def fill_patterns(self, repeats: list[tuple[tuple[int, ...], int]], width: int) -> None:
        """Fill class patterns with real lengths: the longest of each class
        but the last, for which the longest that still fits is taken, from
        its class or the next ones.  Every step uses up a length or a
        pattern."""
        lengths = sorted(k for k, n in self.left.items() if n)

        def longest(most: int, least: int, chosen: dict[int, int]) -> int | None:
            k = bisect_right(lengths, most) - 1
            while k >= 0 and lengths[k] >= least:
                x = lengths[k]
                if not self.left[x]:
                    lengths.pop(k)
                elif self.left[x] > chosen.get(x, 0):
                    return x
                k -= 1
            return None

        for pattern, times in repeats:
            while times:
                chosen: dict[int, int] = {}
                room = self.max_len
                for k, c in enumerate(pattern):
                    last = k == len(pattern) - 1
                    x = longest(room if last else min(room, c * width + width - 1), max(1, (c - last) * width), chosen)
                    if x is None:
                        break
                    chosen[x] = chosen.get(x, 0) + 1
                    room -= x
                if sum(chosen.values()) < len(pattern):
                    break
                n = min(times, min(self.left[x] // k for x, k in chosen.items()))
                self.new_run([x for x, k in sorted(chosen.items(), reverse=True) for _ in range(k)], n)
                times -= n

    def best_fit(self) -> None:
        """What is left, longest first, each into the sequence with the least
        room that holds it; new sequences where none does."""
        rooms = sorted(self.open)
        for length in sorted(self.left, reverse=True):
            while self.left[length]:
                k = bisect_left(rooms, length)
                if k == len(rooms):
                    self._open_new(length, rooms)
                    continue
                room = rooms[k]
                first, n = self.open[room].pop()
                if not self.open[room]:
                    del self.open[room]
                    rooms.pop(k)
                each = min(room // length, max(1, self.left[length] // n))
                n_used = min(n, self.left[length])
                for m in range(each):
                    self.place(length, n_used, first, self.max_len - room + m * length)
                self._add(room - each * length, first, n_used, rooms)
                self._add(room, first + n_used, n - n_used, rooms)

    def _open_new(self, length: int, rooms: list[int]) -> None:
        each = self.max_len // length
        n = max(1, self.left[length] // each)
        each = min(each, self.left[length])
        first = self.sequences
        self.sequences += n
        for m in range(each):
            self.place(length, n, first, m * length)
        self._add(self.max_len - each * length, first, n, rooms)

    def _add(self, room: int, first: int, n: int, rooms: list[int]) -> None:
        if room <= 0 or n <= 0:
            return
        if room not in self.open:
            rooms.insert(bisect_left(rooms, room), room)
        self.open[room].append((first, n))


def plan_from_histogram(counts: dict[int, int], max_len: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Placement rows and the number of sequences for pieces of these lengths
    (length -> number of pieces)."""
    plan = _Plan({k: n for k, n in counts.items() if n > 0}, max_len)
    if full := plan.left.get(max_len, 0):
        plan.new_run([max_len], full)
    width = -(-max_len // CLASSES)
    classes = -(-max_len // width)
    found = patterns(classes, GAP_CLASSES)
    if found:
        a = np.zeros((classes + 1, len(found)))
        for k, p in enumerate(found):
            for c in p:
                a[c, k] += 1
        b = np.zeros(classes + 1)
        for length, n in plan.left.items():
            b[length // width] += n
        b[:GAP_CLASSES] = 0
        times = np.floor(nnls(a, b) + 1e-9).astype(int)
        plan.fill_patterns([(p, int(n)) for p, n in zip(found, times, strict=True) if n > 0], width)
    plan.best_fit()
    return plan.rows, plan.sequences


def pack(cut: DataFrame, *, max_len: int = 4096) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to
    ``max_len``.  The rows must be stable (a written table).  Pieces are
    numbered per (length, partition), so a length that a third of all pieces
    have is not one task's work."""
    spark = cut.sparkSession
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows, _ = plan_from_histogram(counts, max_len)
    runs: dict[int, list] = defaultdict(list)
    for length, first, n, sequence, offset in rows:
        runs[length].append((first, n, sequence, offset))
    # at most max_len lengths; their runs depend on the histogram's shape only
    table = spark.createDataFrame(sorted(runs.items()) or [], "length long, _runs array<struct<first:long,n:long,sequence:long,offset:long>>")

    part = F.shiftright(F.col("_uid"), 33)
    per_part = cut.groupBy("length", part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    starts = per_part.withColumn("_start", F.sum("_n").over(
        Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).drop("_n")
    numbered = cut.withColumn("_part", part).withColumn("_k", F.row_number().over(
        Window.partitionBy("length", "_part").orderBy("_uid")))
    placed = (numbered.join(starts, ["length", "_part"])
              .withColumn("_k", F.col("_k") - 1 + F.coalesce(F.col("_start"), F.lit(0)))
              .join(F.broadcast(table), "length")
              .withColumn("_run", F.filter("_runs", lambda r: (F.col("_k") >= r["first"]) & (F.col("_k") < r["first"] + r["n"]))[0]))
    return placed.select(*[c for c in cut.columns if c != "_uid"],
                         (F.col("_run.sequence") + F.col("_k") - F.col("_run.first")).alias("sequence_id"),
                         F.col("_run.offset").alias("offset"))


def pack_documents(docs: DataFrame, vocab_path: str, *, max_len: int = 4096, end_id: int = 1, id_col: str = "doc_id",
                   text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and
    ``ids``), one row per piece.  Texts are read once: the pieces are written
    to the shared checkpoint folder without the texts."""
    cut = pieces(docs, vocab_path, max_len=max_len, end_id=end_id, id_col=id_col, text_col=text_col, with_ids=with_ids)
    # the number is written with its row, so it stays the same for every later read
    return pack(cut_lineage(cut.withColumn("_uid", F.monotonically_increasing_id())), max_len=max_len)
