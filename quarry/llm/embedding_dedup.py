"""Embedding near-duplicates through an inverted multi-index.

Vectors are cut in halves and each half is assigned to the nearest word of its
own codebook; a pair of words is a cell of the product grid.  A vector visits
cells in the order of its summed distance to their two words (the
multi-sequence order) until the distance passes that of its nearest cell by
more than ``slack``, and is compared, in double precision, with every vector
of the cells it visits.

The codebooks are fitted on a sample of about ``SAMPLE`` vectors, chosen by
hash; every vector is indexed.  ``slack`` is set on the same sample: sampled
vectors are moved to exactly the threshold, the farthest a link can be, in a
random direction and towards near and farther neighbours in the sample, and
``slack`` is the largest ``target_recall`` quantile of how much later the moved
vector's cell comes than the nearest, or that of the links inside the sample.

Equal vectors are one class, so a group of copies is indexed once.  A cell
with many members or visitors is dealt out in square blocks of at most
``BLOCK`` each, so no task gets a cell whole.  Tasks return sums and a few
links that keep what they found connected, never all pairs.

Results: a vector that is null, empty, zero, or holds null or non-finite
components links with nothing; vectors of different lengths never link, those
of each length have an index of their own; a null id is counted
as a vector but never names a component unless it has no other id; repeated
rows are vectors of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._common import prepare
from quarry.llm.components import components
from quarry.session import cut_lineage

#: Vectors that the codebooks and the slack are fitted on.
SAMPLE = 20_000
#: Vectors per cell that the size of the codebooks aims at, and its bound.
PER_CELL = 32
MOST_WORDS = 1_000
#: Sampled vectors that are moved towards others, and the ranks of those others.
PROBES = 4_000
RANKS = (1, 2, 4, 8, 16, 32, 64, 128)
#: Members and visitors of a cell in one task.
BLOCK = 2048


def fit_codebook(x: np.ndarray, words: int, rounds: int = 10) -> np.ndarray:
    """k-means (Lloyd) from evenly spaced rows."""
    book = x[np.linspace(0, len(x) - 1, words).astype(int)].copy()
    for _ in range(rounds):
        near = np.argmin(_distances(x, book), axis=1)
        n = np.bincount(near, minlength=words)
        total = np.zeros_like(book)
        np.add.at(total, near, x)
        book = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], book)
    return book


def _distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of rows to words."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ book.T + (book * book).sum(1), 0)


def _moved(unit: np.ndarray, towards: np.ndarray, threshold: float) -> np.ndarray:
    """Vectors turned towards others until their cosine is the threshold."""
    side = towards - (towards * unit).sum(1)[:, None] * unit
    norm = np.linalg.norm(side, axis=1)
    side[norm > 1e-6] /= norm[norm > 1e-6, None]
    side[norm <= 1e-6] = 0                                # the same direction but for rounding
    return threshold * unit + np.sqrt(max(0.0, 1 - threshold**2)) * side


class MultiIndex:
    """Two codebooks over the halves of unit vectors."""

    def __init__(self, books: tuple[np.ndarray, np.ndarray], slack: float):
        self.books, self.slack, self.half = books, slack, books[0].shape[1]

    @classmethod
    def fit(cls, unit: np.ndarray, n: int, threshold: float, target_recall: float) -> MultiIndex:
        words = int(min(MOST_WORDS, max(1, len(unit) // 8), max(1, np.ceil(np.sqrt(n / PER_CELL)))))
        half = unit.shape[1] // 2
        index = cls((fit_codebook(unit[:, :half], words), fit_codebook(unit[:, half:], words)), 0.0)
        late = index.lateness(unit, index.home(_moved(unit, np.random.default_rng(0).standard_normal(unit.shape), threshold)))
        index.slack = max(float(np.quantile(late, target_recall)), index._near_slack(unit, threshold, target_recall)) + 1e-9
        return index

    def _near_slack(self, unit: np.ndarray, threshold: float, target_recall: float) -> float:
        """The slack that finds moves towards neighbours of each rank, and the
        links inside the sample, whichever is larger: links may lie along few
        directions."""
        probes = np.linspace(0, len(unit) - 1, min(PROBES, len(unit))).astype(int)
        ranks = [r for r in RANKS if r < len(unit)]
        if not ranks:
            return 0.0
        home = self.home(unit)
        i, j = np.divmod(home, len(self.books[1]))
        left, right = unit[:, : self.half], unit[:, self.half :]
        at_home = ((left - self.books[0][i]) ** 2).sum(1) + ((right - self.books[1][j]) ** 2).sum(1)
        moves: list[list[np.ndarray]] = [[] for _ in ranks]
        edges = np.linspace(0, 8, (1 << 16) + 1)          # a lateness is under 8
        linked = np.zeros(len(edges) - 1, np.int64)
        # a link is found where either end visits the other's home
        for k in range(0, len(probes), 200):
            at = probes[k : k + 200]
            x = unit[at]
            cosine = x @ unit.T
            cosine[np.arange(len(at)), at] = -np.inf
            a, b = self.parts(x)
            late = a[:, i] + b[:, j] - at_home[at][:, None]
            late = np.minimum(late, (_distances(left, self.books[0][i[at]]) + _distances(right, self.books[1][j[at]])
                                     - at_home[:, None]).T)
            linked += np.histogram(np.clip(late[cosine >= threshold], 0, 8), edges)[0]
            order = np.argpartition(-cosine, [rank - 1 for rank in ranks], axis=1)
            for found, rank in zip(moves, ranks, strict=True):
                moved = _moved(x, unit[order[:, rank - 1]], threshold)
                found.append(np.minimum(self.lateness(x, self.home(moved)), self.lateness(moved, home[at])))
        slack = max(float(np.quantile(np.concatenate(found), target_recall)) for found in moves)
        if linked.any():
            slack = max(slack, float(edges[1:][np.searchsorted(np.cumsum(linked), target_recall * linked.sum())]))
        return slack

    def parts(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _distances(unit[:, : self.half], self.books[0]), _distances(unit[:, self.half :], self.books[1])

    def home(self, unit: np.ndarray) -> np.ndarray:
        a, b = self.parts(unit)
        return np.argmin(a, axis=1) * len(self.books[1]) + np.argmin(b, axis=1)

    def lateness(self, unit: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """How much farther than its nearest cell a vector's given cell is."""
        a, b = self.parts(unit)
        i, j = np.divmod(cell, len(self.books[1]))
        at = np.arange(len(unit))
        return a[at, i] + b[at, j] - a.min(1) - b.min(1)

    def visits(self, unit: np.ndarray):
        """Per vector its cells in multi-sequence order up to the slack: words
        of each half are sorted, and pairs are taken by their sum while it is
        within the slack."""
        a, b = self.parts(unit)
        for da, db in zip(a - a.min(1)[:, None], b - b.min(1)[:, None], strict=True):
            i, j = np.nonzero(da <= self.slack)[0], np.nonzero(db <= self.slack)[0]
            total = da[i][:, None] + db[j][None, :]
            r, c = np.nonzero(total <= self.slack)
            order = np.argsort(total[r, c], kind="stable")
            yield (i[r] * len(self.books[1]) + j[c])[order]


def _unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)
    return x / np.linalg.norm(x, axis=1)[:, None]


def vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, key, v``: the vector in doubles and a hash of it, null where
    it can't link."""
    def run(batches):
        for b in batches:
            raw, key = [], []
            for v in b.column("_v").to_pylist():
                x = np.array([np.nan if c is None else c for c in v or ()], "<f8") + 0.0
                norm = np.linalg.norm(x) if len(x) else 0.0
                # a norm beyond doubles is brought into range first; cosine doesn't change
                if len(x) and np.isfinite(x).all() and not (np.isfinite(norm) and norm > 1e-150) and np.abs(x).max() > 0:
                    x = x / np.abs(x).max()
                    norm = np.linalg.norm(x)
                ok = len(x) > 0 and np.isfinite(x).all() and norm > 0
                raw.append(x.tobytes() if ok else None)
                key.append(hashlib.sha256(x.tobytes()).digest()[:16] if ok else None)
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(key, pa.binary()), pa.array(raw, pa.binary())],
                                             names=["vec_id", "key", "v"])

    src = rows.select(F.col(id_col).alias("_id"), F.col(vector_col).cast("array<double>").alias("_v"))
    return src.mapInArrow(run, f"vec_id {src.schema['_id'].dataType.simpleString()}, key binary, v binary")


_PLACED = "cell long, member boolean, key binary, home long, w long, v binary"


def place(classes: DataFrame, index) -> DataFrame:
    """A row for every class in its cell, and one for every cell it visits."""
    def run(batches):
        idx = index.value
        for b in batches:
            raw = b.column("v").to_pylist()
            if not raw:
                continue
            unit = _unit(raw)
            home = idx.home(unit)
            cells = list(idx.visits(unit))
            n = np.array([len(c) for c in cells])
            which = np.concatenate([np.arange(len(raw)), np.repeat(np.arange(len(raw)), n)])
            take = pa.array(which)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([home, *cells]).astype(np.int64)),
                 pa.array(np.arange(len(which)) < len(raw)), b.column("key").take(take),
                 pa.array(home[which].astype(np.int64)), b.column("w").take(take), b.column("v").take(take)],
                names=["cell", "member", "key", "home", "w", "v"])

    return classes.select("key", "w", "v").mapInArrow(run, _PLACED)


def _compare(members, visitors, idx: MultiIndex, threshold: float):
    """Linked weight of the visitors, and of members that did not visit the
    visitor's cell themselves; and links that keep the block connected."""
    (mk, mh, mw, mv), (vk, vh, vw, vv) = members, visitors
    m, v = _unit(mv), _unit(vv)
    near = v @ m.T >= threshold
    position = {k: i for i, k in enumerate(mk)}
    own = np.array([position.get(k, -1) for k in vk])
    near[np.nonzero(own >= 0)[0], own[own >= 0]] = False
    to_visitor = near @ mw
    # a member that visits the visitor's home counts the link there
    r, c = np.nonzero(near)
    to_member = np.zeros(len(mk), np.int64)
    if len(r):
        missed = idx.lateness(m[c], vh[r]) > idx.slack if len(r) <= 1 << 16 else np.concatenate(
            [idx.lateness(m[c[k : k + (1 << 16)]], vh[r[k : k + (1 << 16)]]) > idx.slack for k in range(0, len(r), 1 << 16)])
        np.add.at(to_member, c[missed], vw[r[missed]])
    # least label through the block until nothing changes
    top = len(mk) + len(vk)
    lm, lv = np.arange(len(mk)), np.arange(len(mk), top)
    while len(r):
        nv = np.minimum(lv, np.where(near, lm[None, :], top).min(1))
        nm = np.minimum(lm, np.where(near, nv[:, None], top).min(0))
        if (nv == lv).all() and (nm == lm).all():
            break
        lm, lv = nm, nv
    names = [*mk, *vk]
    links = [(names[i], names[x]) for i, x in enumerate([*lm.tolist(), *lv.tolist()]) if names[i] != names[x]]
    return to_visitor, to_member, links


def find_links(classes: DataFrame, index, threshold: float) -> DataFrame:
    """``a, b, n``: rows with a ``b`` are links that join components, rows
    with an ``n`` say how many vectors a class links with (to be summed)."""
    placed = cut_lineage(place(classes, index))
    size = placed.groupBy("cell").agg(F.sum(F.col("member").cast("long")).alias("m"), F.count(F.lit(1)).alias("n"))
    size = size.select("cell", F.ceil(F.col("m") / BLOCK).cast("int").alias("ms"),
                       F.ceil((F.col("n") - F.col("m")) / BLOCK).cast("int").alias("vs")).filter("ms > 0 and vs > 0")
    h = F.xxhash64("key")
    spread = placed.join(size, "cell").withColumn("s", F.explode(F.when(
        F.col("member"), F.transform(F.sequence(F.lit(0), F.col("vs") - 1), lambda x: F.struct(F.pmod(h, F.col("ms")).cast("int").alias("ms"), x.alias("vs"))))
        .otherwise(F.transform(F.sequence(F.lit(0), F.col("ms") - 1), lambda x: F.struct(x.alias("ms"), F.pmod(h, F.col("vs")).cast("int").alias("vs"))))))
    spread = spread.select("cell", F.col("s.ms").alias("ms"), F.col("s.vs").alias("vs"), "member", "key", "home", "w", "v")

    def run(table: pa.Table) -> pa.Table:
        idx = index.value
        member = table.column("member").to_numpy()
        cols = [table.column(c).to_pylist() for c in ("key", "home", "w", "v")]

        def chosen(which):
            at = np.nonzero(which)[0]
            k, h, w, v = ([c[i] for i in at] for c in cols)
            return k, np.array(h, np.int64), np.array(w, np.int64), v

        ms, vs = chosen(member), chosen(~member)
        a, b, n = [], [], []
        if len(ms[0]) and len(vs[0]):
            to_visitor, to_member, links = _compare(ms, vs, idx, threshold)
            for keys, counts in ((vs[0], to_visitor), (ms[0], to_member)):
                for k in np.nonzero(counts)[0]:
                    a.append(keys[k])
                    b.append(None)
                    n.append(int(counts[k]))
            for x, y in links:
                a.append(x)
                b.append(y)
                n.append(None)
        return pa.table([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(n, pa.int64())], names=["a", "b", "n"])

    return cut_lineage(spread.groupBy("cell", "ms", "vs").applyInArrow(run, "a binary, b binary, n long"))


def fit_index(classes: DataFrame, threshold: float, target_recall: float) -> MultiIndex | None:
    """The index over a sample chosen by hash (about ``SAMPLE`` classes)."""
    n = classes.count()
    if not n:
        return None
    share = min(1.0, SAMPLE / n)
    sample = classes.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    raw = [bytes(r["v"]) for r in sample.orderBy("key").select("v").collect()]   # about SAMPLE rows
    return MultiIndex.fit(_unit(raw), n, threshold, target_recall) if raw else None


def near_duplicates(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95,
                    target_recall: float = 0.995) -> DataFrame:
    """One row per row of ``rows``: ``vec_id, n_links, component_id, kept``."""
    spark = rows.sparkSession
    prepare(spark)
    every = cut_lineage(vectors(rows, id_col, vector_col))
    classes = cut_lineage(every.filter("key is not null").groupBy("key").agg(
        F.count(F.lit(1)).alias("w"), F.min("vec_id").alias("least"), F.first("v").alias("v")))
    # vectors of different lengths are never compared: an index for each length
    found = None
    for size in sorted(r["size"] for r in classes.groupBy(F.length("v").alias("size")).agg(F.count(F.lit(1)).alias("n")).collect()):
        own = classes.filter(F.length("v") == size)
        index = fit_index(own, threshold, target_recall)
        if index is not None:
            links = find_links(own, spark.sparkContext.broadcast(index), threshold)
            found = links if found is None else found.unionByName(links)
    if found is None:
        alone = every.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    else:
        counts = found.filter("n is not null").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("n"))
        roots = components(found.filter("b is not null").select("a", "b")).withColumnRenamed("node", "key")
        known = (classes.select("key", "w", "least").join(counts, "key", "left").join(roots, "key", "left")
                 .withColumn("root", F.coalesce("root", "key")))
        # written in between, so the joins can split a large component and a large group of copies
        known = cut_lineage(known)
        names = cut_lineage(known.groupBy("root").agg(F.min("least").alias("c")))
        known = cut_lineage(known.join(names, "root").select("key", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n"), "c"))
        alone = every.select("vec_id", "key").join(known, "key", "left").select(
            "vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"))
    return alone.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
