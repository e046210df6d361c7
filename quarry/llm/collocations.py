"""Phrase collocation mining with HAT-trie counting.

Every task counts, in a trie over word ids, each word and the longest phrase of
up to ``max_words`` words that starts there; what a shorter phrase counts is the
sum of its subtree.  The trie's leaves are hash containers that each hold a
range of it; one that grows past ``BURST`` phrases bursts at the shallowest word
border that parts its phrases, so a container first shares many first words,
then belongs to one, then to a two-word prefix.  Past ``MEMORY`` phrases the
largest subtrees are spilled whole, as sorted runs, until half are left, and go
on empty.  A run is cut into prefix partitions by the first two words, and the
runs of a partition are merged by one task.

A prefix that alone makes up more of a run than a partition's share is *hot*:
the run deals its phrases by all their words and leaves a marker at the
prefix's own partition.  Sums of a prefix that any run found hot are partial
and are added up once more by their ids.  So no partition gets much more than
its share, whatever follows a frequent pair.

Phrases travel as 64-bit word ids, a hash of language and word.  That no two
words share an id is proved while the runs are merged (equal ids bring their
words along); should two ever do, all is counted again with another seed.

A phrase of ``min_words`` or more words that occurs ``least`` times is a
candidate.  Its score is ``scale * a * a / (l * r)`` of the weakest cut,
rounded down, in exact decimals.  A candidate goes when a longer one that
contains it occurs at least half as often.

Results: a null text is empty, a null language is ``und`` (one with texts
marked ``und``); repeated rows count as often as they occur; null ids do not
matter; equal scores are ordered by frequency, then phrase (UTF-8 bytes); very
long texts are read in slices, phrases over a border included; other columns,
whatever their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm._common import prepare, shuffle_width, text_or_empty, tidy_task
from quarry.session import cut_lineage, cuts_of, drop_cuts

#: Phrases of a container before it bursts; phrases and words of a task's trie
#: before subtrees are spilled.
BURST, MEMORY, WORDS = 1 << 16, 1_500_000, 1 << 20
#: Phrases of a run that share their first two words, at least, for these to be hot.
HOT = 64
#: Bytes of text that are split into words at a time.
SLICE = 4 << 20
#: Prefix partitions for each shuffle partition.
PARTS = 4
_BORDER = b"\xff"                                  # never part of UTF-8
# Fixed values of the contract: what ends a piece, what ends a word.
_TO_BORDER = bytes(0xFF if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256))


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads its input."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    return x * np.uint64(0xBF58476D1CE4E5B9)


class HashContainer:
    """Open addressing in two numpy arrays; takes sorted distinct keys at once."""

    def __init__(self, lo: int, hi: int):
        self.lo, self.hi, self.size = lo, hi, 0
        self.keys, self.counts = np.full(64, -1, np.int64), np.zeros(64, np.int64)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        if 2 * (self.size + len(keys)) > len(self.keys):
            old_keys, old_counts = self.entries()
            slots = 1 << int(4 * (self.size + len(keys)) - 1).bit_length() - 1
            self.keys, self.counts, self.size = np.full(slots, -1, np.int64), np.zeros(slots, np.int64), 0
            self._put(old_keys, old_counts)
        self._put(keys, counts)

    def _put(self, keys: np.ndarray, counts: np.ndarray) -> None:
        mask = len(self.keys) - 1
        at = (_mix(keys.view(np.uint64)) >> np.uint64(16)).astype(np.int64) & mask
        while len(keys):
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[free]           # of several, one gets the slot
            own = self.keys[at] == keys
            self.size += int((free & own).sum())
            self.counts[at[own]] += counts[own]        # keys are distinct: no slot twice
            keys, counts, at = keys[~own], counts[~own], (at[~own] + 1) & mask

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        used = self.keys >= 0
        return self.keys[used], self.counts[used]

    def run(self) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = self.entries()
        order = np.argsort(keys)
        return keys[order], counts[order]


class HatTrie:
    """Containers in key order.  A key is the path of a phrase: its word ids
    (from 1), ``bits`` each, the first on top, 0 behind the last."""

    def __init__(self, max_words: int):
        self.max_words, self.bits = max_words, 63 // max_words
        self.boxes = [HashContainer(0, 1 << (self.bits * max_words))]
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Sorted distinct keys and their counts."""
        ends = np.searchsorted(keys, [b.hi for b in self.boxes])
        boxes, start = [], 0
        for box, end in zip(self.boxes, ends.tolist(), strict=True):
            if end > start:
                before = box.size
                box.add(keys[start:end], counts[start:end])
                self.size += box.size - before
            boxes += self.burst(box) if box.size > BURST else [box]
            start = end
        self.boxes = boxes

    def burst(self, box: HashContainer) -> list[HashContainer]:
        """Parts of a container, each of ``BURST`` phrases at most."""
        keys, counts = box.run()
        out, todo = [], [(box.lo, box.hi, 0, len(keys))]
        while todo:
            lo, hi, a, b = todo.pop()
            border = self.border(keys, lo, a, b) if b - a > BURST else None
            if border is None:
                part = HashContainer(lo, hi)
                part.add(keys[a:b], counts[a:b])
                out.append(part)
            else:
                m = a + int(np.searchsorted(keys[a:b], border))
                todo += [(border, hi, m, b), (lo, border, a, m)]
        return out

    def border(self, keys: np.ndarray, lo: int, a: int, b: int) -> int | None:
        """Where the shallowest word changes, next to the middle."""
        middle = int(keys[(a + b) // 2])
        for depth in range(1, self.max_words + 1):
            low = self.bits * (self.max_words - depth)
            for at in ((middle >> low) << low, ((middle >> low) + 1) << low):
                if int(keys[a]) < at <= int(keys[b - 1]) and at > lo:
                    return at
        return None

    def spill(self, keep: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Sorted runs of the largest subtrees, whole, until at most ``keep``
        phrases are left."""
        runs = []
        for k in sorted(range(len(self.boxes)), key=lambda k: -self.boxes[k].size):
            if self.size <= keep:
                break
            box = self.boxes[k]
            if box.size:
                runs.append((box.lo, *box.run()))
                self.size -= box.size
                self.boxes[k] = HashContainer(box.lo, box.hi)
        return [r[1:] for r in sorted(runs, key=lambda r: r[0])]


class _Ids(dict):
    """word -> id, for one language; ``words`` is shared by all."""

    def __init__(self, lang: bytes, words: list):
        self.lang, self.words = lang, words

    def __missing__(self, word: bytes) -> int:
        self.words.append((self.lang, word))
        n = self[word] = len(self.words)
        return n


class Counter:
    """Counts the phrases of a task; ``rows`` of spilled runs are ``part, ids,
    counts, words, hot``: for each section (words, longest phrases by length,
    the same of hot prefixes) the word ids, one column after the other, and the
    counts; the words; the prefixes that are hot."""

    def __init__(self, max_words: int, parts: int, seed: int):
        self.trie, self.parts, self.seed = HatTrie(max_words), parts, seed
        self.reset()

    def reset(self) -> None:
        self.words: list[tuple[bytes, bytes]] = []
        self.ids: dict[bytes, _Ids] = {}

    def add(self, lang: bytes, texts: list[bytes]):
        """Count texts of one language; yields rows of what is spilled."""
        raw = _BORDER.join(texts).lower().translate(_TO_BORDER).replace(_BORDER, b" \xff ")
        tail = np.zeros(0, np.int64)
        at, more = 0, self.trie.max_words - 1
        limit = min(WORDS, (1 << self.trie.bits) - 1)
        while at < len(raw):
            end = raw.find(b" ", at + SLICE)
            end = len(raw) if end < 0 else end
            words = raw[at:end].split()
            at = end
            for k in range(0, len(words), limit // 2):
                part = words[k : k + limit // 2]
                if len(self.words) + len(part) > limit and len(self.words) + len(set(part)) > limit:
                    # ids run out: everything is spilled, ids start anew
                    behind = [self.words[i - 1][1] if i else _BORDER for i in tail.tolist()]
                    yield from self.rows(0)
                    self.reset()
                    tail = np.array([self.id_of(lang, w) for w in behind], np.int64)
                ids = self.ids.setdefault(lang, _Ids(lang, self.words))
                ids.setdefault(_BORDER, 0)
                new = np.fromiter(map(ids.__getitem__, part), np.int64, len(part))
                self.count_words(new)
                tail = self.count_phrases(np.concatenate([tail, new]))
                if self.trie.size > MEMORY:
                    yield from self.rows(MEMORY // 2)
        self.count_phrases(np.concatenate([tail, np.zeros(more, np.int64)]))

    def id_of(self, lang: bytes, word: bytes) -> int:
        return 0 if word == _BORDER else self.ids.setdefault(lang, _Ids(lang, self.words))[word]

    def count_words(self, ids: np.ndarray) -> None:
        keys, counts = np.unique(ids[ids > 0], return_counts=True)
        if len(keys):
            self.trie.add(keys << np.int64(self.trie.bits * (self.trie.max_words - 1)), counts)

    def count_phrases(self, ids: np.ndarray) -> np.ndarray:
        """The longest phrase, two words at least, from every place that has
        all words it may need behind it; returns the ids of the other places."""
        bits, width = self.trie.bits, self.trie.max_words
        n = len(ids) - width + 1
        if n <= 0 or width < 2:
            return ids if width > 1 else ids[:0]
        path, whole = np.zeros(n, np.int64), np.ones(n, bool)
        for d in range(width):
            word = ids[d : d + n]
            whole &= word > 0
            path |= np.where(whole, word, 0) << np.int64(bits * (width - 1 - d))
        long = (path & ((1 << (bits * (width - 1))) - 1)) > 0
        keys, counts = np.unique(path[long], return_counts=True)
        if len(keys):
            self.trie.add(keys, counts)
        return ids[n:]

    def rows(self, keep: int):
        """Spill until ``keep`` phrases are left; a row for each partition."""
        runs = self.trie.spill(keep)
        if not runs:
            return
        keys, counts = (np.concatenate(c) for c in zip(*runs, strict=True))
        bits, width = self.trie.bits, self.trie.max_words
        steps = [keys >> (bits * (width - d)) & ((1 << bits) - 1) for d in range(1, width + 1)]
        # only words of the runs are hashed
        codes, used = np.zeros(len(self.words) + 1, np.uint64), np.zeros(len(self.words) + 1, bool)
        for step in steps:
            used[step] = True
        seeds = {lang: xxhash.xxh64_intdigest(lang, self.seed) for lang in self.ids}
        for i in (np.nonzero(used[1:])[0] + 1).tolist():
            lang, word = self.words[i - 1]
            codes[i] = xxhash.xxh64_intdigest(word, seeds[lang])
        columns = [codes[step] for step in steps]
        length = sum((step > 0).astype(np.int64) for step in steps)
        home = self.part_of(columns[:2])
        part, section = home, length - 1
        markers = np.zeros(0, np.int64)
        if width > 2:
            prefix = keys >> (bits * (width - 2))
            start = np.nonzero(np.append(True, prefix[1:] != prefix[:-1]))[0]
            n = np.diff(np.append(start, len(keys)))
            hot = n > max(HOT, len(keys) // self.parts)
            markers = start[hot]
            spread = np.repeat(hot, n) & (length > 2)
            part = np.where(spread, self.part_of(columns), home)
            section = np.where(spread, width + length - 3, section)
        order = np.lexsort((section, part))            # stable: runs stay sorted
        part, section = part[order], section[order]
        marks = markers[np.argsort(home[markers], kind="stable")]
        n_sections = max(1, 2 * width - 2)             # words, longest phrases by length, those of hot prefixes
        for p in np.union1d(part, home[marks]).tolist():
            a, b = np.searchsorted(part, [p, p + 1]).tolist()
            cuts = (a + np.searchsorted(section[a:b], np.arange(n_sections + 1))).tolist()
            ids_out, counts_out, words_out = [], [], b""
            for k in range(n_sections):
                own = order[cuts[k] : cuts[k + 1]]
                d = k + 1 if k < width else k - width + 3
                ids_out.append(b"".join(columns[c][own].tobytes() for c in range(d)))
                counts_out.append(counts[own].tobytes())
                if k == 0:
                    words_out = b"\xfe".join(b"\xff".join(self.words[i - 1]) for i in steps[0][own].tolist())
            own = marks[slice(*np.searchsorted(home[marks], [p, p + 1]).tolist())]
            yield p, ids_out, counts_out, words_out, b"".join(c[own].tobytes() for c in columns[:2])

    def part_of(self, columns: list[np.ndarray]) -> np.ndarray:
        return ((digest(columns) >> np.uint64(32)) % np.uint64(self.parts)).astype(np.int64)


def digest(columns: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        out = _mix(out ^ _mix(c))
    return out


_RUNS = pa.schema([("part", pa.int64()), ("ids", pa.list_(pa.binary())), ("counts", pa.list_(pa.binary())), ("words", pa.binary()),
                   ("hot", pa.binary())])


def count_runs(docs: DataFrame, max_words: int, parts: int, seed: int, *, lang_col: str, text_col: str) -> DataFrame:
    """Sorted runs of all tasks, a row per run and prefix partition."""
    src = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text_or_empty(text_col).alias("text"))

    def run(batches):
        counter = Counter(max_words, parts, seed)

        def out(rows):
            for row in rows:
                yield pa.RecordBatch.from_pylist([dict(zip(_RUNS.names, row, strict=True))], schema=_RUNS)

        for b in batches:
            langs, texts = b.column("lang"), b.column("text").cast(pa.binary())
            for lang in pc.unique(langs).to_pylist():
                own = texts.filter(pc.equal(langs, lang)).to_pylist()
                yield from out(counter.add(lang.encode(), own))
        yield from out(counter.rows(0))

    return src.mapInArrow(tidy_task(run), "part long, ids array<binary>, counts array<binary>, words binary, hot binary")


def _sums(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct columns of ``ids`` and their sums: an order of the columns,
    where each group starts in it, and its sum."""
    mixed = digest(list(ids))
    order = np.argsort(mixed, kind="stable")
    changed = (ids[:, order[1:]] != ids[:, order[:-1]]).any(axis=0)
    if (changed & (mixed[order[1:]] == mixed[order[:-1]])).any():        # equal digests of different phrases
        order = np.lexsort(ids[::-1])
        changed = (ids[:, order[1:]] != ids[:, order[:-1]]).any(axis=0)
    starts = np.concatenate([[0], np.nonzero(changed)[0] + 1])
    return order, starts, np.add.reduceat(counts[order], starts)


def merge_words(table: pa.Table):
    """Ids, words with their languages, and counts of the single words of one
    partition; the number of words that share an id with another one."""
    ids = np.concatenate([np.frombuffer(r[0], np.uint64) for r in table.column("ids").to_pylist()])
    counts = np.concatenate([np.frombuffer(r[0], np.int64) for r in table.column("counts").to_pylist()])
    words = [w for raw in table.column("words").to_pylist() if raw for w in raw.split(b"\xfe")]
    if not len(ids):
        return ids, [], counts, 0
    order, starts, sums = _sums(ids[None], counts)
    first = [words[i] for i in order[starts].tolist()]
    group = np.repeat(np.arange(len(starts)), np.diff([*starts, len(order)]))
    clashes = sum(words[i] != first[g] for i, g in zip(order.tolist(), group.tolist(), strict=True))
    return ids[order[starts]], [w.split(b"\xff", 1) for w in first], sums, clashes


def merge_phrases(table: pa.Table, max_words: int):
    """Of one partition, per phrase length from 2: ids, counts, and whether the
    count is partial (its first two words are a hot prefix)."""
    blocks, sizes, spread = [], [], []
    counts_rows = table.column("counts").to_pylist()
    for r, c in zip(table.column("ids").to_pylist(), counts_rows, strict=True):
        for k in range(1, len(r)):
            d = k + 1 if k < max_words else k - max_words + 3
            if r[k]:
                block = np.zeros((max_words, len(c[k]) // 8), np.uint64)
                block[:d] = np.frombuffer(r[k], np.uint64).reshape(d, -1)
                blocks.append(block)
                sizes.append(np.full(block.shape[1], d))
                spread.append(np.full(block.shape[1], k >= max_words))
    if not blocks:
        return []
    ids, size, hot = np.concatenate(blocks, axis=1), np.concatenate(sizes), np.concatenate(spread)
    counts = np.concatenate([np.frombuffer(c[k], np.int64) for c in counts_rows for k in range(1, len(c)) if c[k]])
    del blocks, sizes, spread
    marked = [np.frombuffer(raw, np.uint64).reshape(2, -1) for raw in table.column("hot").to_pylist() if raw]
    if marked:
        pairs = set(zip(*np.concatenate(marked, axis=1).tolist(), strict=True))
        some = np.nonzero(np.isin(ids[0], np.array([p[0] for p in pairs], np.uint64)))[0]
        hot[some] |= np.array([p in pairs for p in zip(ids[0, some].tolist(), ids[1, some].tolist(), strict=True)], bool)
    out = []
    for d in range(2, max_words + 1):
        if d > 2:
            own = size >= d
            ids, size, hot, counts = ids[:, own], size[own], hot[own], counts[own]
        if not len(counts):
            break
        order, starts, sums = _sums(ids[:d], counts)
        out.append((ids[:d, order[starts]], sums, hot[order[starts]]))
    return out


def phrase_counts(docs: DataFrame, *, max_words: int = 3, least: int = 10, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``size, ids array<long>, f, lang, word``: phrases of 1 to ``max_words``
    words that occur ``least`` times or more, as word ids; ``lang`` and
    ``word`` for single words.  Rows of size 0 hold a language's number of
    words in ``f``.  Written to the shared checkpoint folder."""
    spark = docs.sparkSession
    prepare(spark)
    parts = PARTS * shuffle_width(docs)

    def merge(table: pa.Table) -> pa.Table:
        out: list[tuple[int, list, list, list, list, bool]] = []     # size, ids, counts, languages, words, partial
        ids, words, counts, clashes = merge_words(table)
        totals: dict[bytes, int] = {}
        for (lang, _), n in zip(words, counts.tolist(), strict=True):
            totals[lang] = totals.get(lang, 0) + n
        keep = np.nonzero(counts >= least)[0]
        out.append((1, ids[keep].view(np.int64)[:, None].tolist(), counts[keep].tolist(),
                    *([words[k][at].decode() for k in keep.tolist()] for at in (0, 1)), False))
        out.append((0, [[]] * len(totals), list(totals.values()), [k.decode() for k in totals], [None] * len(totals), False))
        if clashes:
            out.append((-1, [[]], [clashes], [None], [None], False))
        del words
        for d, (ids, counts, hot) in enumerate(merge_phrases(table, max_words), 2):
            for partial in (False, True):
                keep = (hot == partial) & (partial | (counts >= least))
                n = int(keep.sum())
                out.append((d, ids[:, keep].T.astype(np.uint64).view(np.int64).tolist() if n else [], counts[keep].tolist(),
                            [None] * n, [None] * n, partial))
        return pa.table({"size": pa.array([o[0] for o in out for _ in o[1]], pa.int32()),
                         "ids": pa.array([x for o in out for x in o[1]], pa.list_(pa.int64())),
                         "f": pa.array([x for o in out for x in o[2]], pa.int64()),
                         "lang": pa.array([x for o in out for x in o[3]], pa.string()),
                         "word": pa.array([x for o in out for x in o[4]], pa.string()),
                         "partial": pa.array([o[5] for o in out for _ in o[1]], pa.bool_())})

    for seed in range(1 << 30):
        runs = count_runs(docs, max_words, parts, seed, lang_col=lang_col, text_col=text_col)
        merged = cut_lineage(runs.groupBy("part").applyInArrow(
            merge, "size int, ids array<long>, f long, lang string, word string, partial boolean"))
        if merged.filter("size = -1").isEmpty():
            summed = merged.filter("partial").groupBy("size", "ids").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)
            return merged.filter("not partial").drop("partial").unionByName(summed, allowMissingColumns=True)
        drop_cuts(spark, cuts_of(spark)[-1:])
    raise RuntimeError("no seed gave every word its own id")


def with_scores(found: DataFrame, *, min_words: int = 2, max_words: int = 3, scale: int = 1_000_000) -> DataFrame:
    """Candidates with their weakest cut: ``size, ids, lang, phrase, a, l, r,
    score``."""
    key = found.filter("size > 0").select(F.col("ids").alias("part_ids"), F.col("f").alias("part_f"))
    word = found.filter("size = 1").select(F.col("ids").alias("part_ids"), F.col("lang").alias("part_lang"), F.col("word").alias("part_word"))

    def exact(c: Column, digits: int = 18) -> Column:
        return c.cast(f"decimal({digits},0)")

    sizes = []
    for size in range(min_words, max_words + 1):
        c = found.filter(F.col("size") == size).select("size", "ids", F.col("f").alias("a"))
        for k in range(1, size):
            for side, part in ((f"l{k}", F.slice("ids", 1, k)), (f"r{k}", F.slice("ids", k + 1, size - k))):
                c = c.withColumn("part_ids", part).join(key, "part_ids").withColumnRenamed("part_f", side).drop("part_ids")
        for k in range(size):
            c = (c.withColumn("part_ids", F.slice("ids", k + 1, 1)).join(word, "part_ids")
                 .withColumnsRenamed({"part_word": f"w{k}", "part_lang": f"lang{k}"}).drop("part_ids"))
        cuts = F.array(*[F.struct(F.expr(f"({scale}BD * cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div "
                                         f"(cast(l{k} as decimal(15,0)) * cast(r{k} as decimal(15,0)))").alias("score"),
                                  F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in range(1, size)])
        sizes.append(c.withColumn("cut", F.array_min(cuts)).select(
            "size", "ids", F.col("lang0").alias("lang"), F.concat_ws(" ", *[f"w{k}" for k in range(size)]).alias("phrase"),
            "a", "cut.l", "cut.r", "cut.score"))
    out = sizes[0]
    for s in sizes[1:]:
        out = out.unionByName(s)
    return out


def without_covered(scored: DataFrame, *, min_words: int = 2, max_words: int = 3, percent: int = 50) -> DataFrame:
    """Leave out candidates inside a longer candidate (left out itself or not)
    that occurs at least ``percent`` % as often."""
    inner = [F.struct(F.slice("ids", F.lit(i + 1), F.lit(s)).alias("ids")) for s in range(min_words, max_words) for i in range(max_words - s + 1)]
    if not inner:
        return scored
    parts = F.filter(F.array(*inner), lambda x: F.size(x["ids"]) >= min_words)
    covers = (scored.filter(F.col("size") > min_words).select("size", F.explode(parts).alias("part"), "a")
              .filter(F.size("part.ids") < F.col("size")).groupBy(F.col("part.ids").alias("cover_ids")).agg(F.max("a").alias("cover")))
    joined = scored.join(covers, scored["ids"] == covers["cover_ids"], "left")
    return joined.filter(F.col("cover").isNull() | (100 * F.col("cover") < percent * F.col("a"))).drop("cover", "cover_ids")


def collocations(docs: DataFrame, *, min_words: int = 2, max_words: int = 3, least: int = 10, top: int = 2000,
                 lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top``
    phrases."""
    found = cut_lineage(phrase_counts(docs, max_words=max_words, least=least, lang_col=lang_col, text_col=text_col))
    scored = cut_lineage(with_scores(found, min_words=min_words, max_words=max_words))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = (without_covered(scored, min_words=min_words, max_words=max_words)
              .withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top))
    totals = found.filter("size = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")
