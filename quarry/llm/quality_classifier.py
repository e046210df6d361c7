"""Quality classifier: histogram gradient-boosted trees over document statistics.

Every whole text gives a fixed vector of statistics (``FEATURES``): shares of
kinds of characters, word lengths, repetition of words, word pairs and lines.
They are computed in one pass and written without the texts.  Trees are grown
level by level on histograms: a feature's values are replaced by at most
``BINS`` bins cut at quantiles, and a level needs only the sums of gradients
and curvatures per (node, feature, bin).  A fitted forest is four flat arrays
(feature, threshold, leaf values, prior); a batch of documents walks all trees
together, one numpy gather per level.

The fit reads at most ``SAMPLE`` labelled documents, those with the smallest
hash of id and statistics (a documented bound; at most 20 MB on the driver).
Statistics and scores cover every document.

Results: a null text is empty; an empty text has all statistics 0 and is scored
like any other.  Very long texts are read in slices of ``SLICE`` bytes: shares
are exact, comparisons between words (repetition, distinct words) are made
within a slice and added up.  A null id counts as held out.  A document with
several labels is trained on once with the mean of them (ties at one half
count as 1), labels of ids that no document has are ignored, repeated rows of
documents each get a row.  Without any usable label every score is 0.5; with
labels of one kind only it is that kind's smoothed share.  Other columns,
whatever their names, are not read.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm._common import prepare, text_or_empty
from quarry.session import cut_lineage

#: Labelled documents that the forest is fitted on, at most.
SAMPLE = 100_000
BINS = 64
TREES, DEPTH, RATE, RIDGE, LEAST_CURVATURE = 60, 4, 0.2, 1.0, 2.0
#: Bytes of a text that are looked at together.
SLICE = 1 << 20

FEATURES = ("log_words", "mean_word", "longest_word", "lower", "upper", "digit", "stop", "bang", "symbol", "other_ascii",
            "non_ascii", "line_breaks", "distinct_words", "top_word", "same_as_previous", "distinct_pairs", "repeated_lines",
            "words_a_line")

_KINDS = np.full(256, 7, np.int64)                 # other printable ASCII
_KINDS[0x80:] = 8
_KINDS[0x80:0xC0] = 9                              # later bytes of a character
for _kind, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:", b"!?",
                                b"#*$%&|<>", b" \t\n\x0b\x0c\r")):
    _KINDS[list(_bytes)] = _kind


def statistics(raw: bytes) -> list[float]:
    """The ``FEATURES`` of one UTF-8 text."""
    kinds = np.zeros(10)
    breaks = words = letters = longest = distinct = top = same = pairs = distinct_pairs = lines = old_lines = 0
    for at in range(0, len(raw), SLICE):
        part = raw[at : at + SLICE]
        counts = np.bincount(np.frombuffer(part, np.uint8), minlength=256)
        kinds += np.bincount(_KINDS, counts, minlength=10)
        breaks += int(counts[10])
        w = part.split()
        n = len(w)
        if not n:
            continue
        numbers: dict[bytes, int] = {}
        ids = np.fromiter((numbers.setdefault(x, len(numbers)) for x in w), np.int64, n)
        words, distinct = words + n, distinct + len(numbers)
        letters += sum(map(len, w))
        longest = max(longest, max(map(len, numbers)))
        top += int(np.bincount(ids).max())
        same += int((ids[1:] == ids[:-1]).sum())
        pairs += n - 1
        distinct_pairs += len(np.unique(ids[1:] * len(numbers) + ids[:-1]))
        own = [x for x in part.split(b"\n") if x.strip()]
        lines, old_lines = lines + len(own), old_lines + len(own) - len(set(own))
    shown = max(1.0, kinds.sum() - kinds[9] - kinds[6])          # characters but white space
    n = max(1, words)
    return [math.log1p(words), letters / n, math.log1p(longest), *(kinds[[0, 1, 2, 3, 4, 5, 7, 8]] / shown).tolist(),
            breaks / n, distinct / n, top / n, same / n, distinct_pairs / max(1, pairs), old_lines / max(1, lines),
            words / max(1, lines)]


def with_statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, stats array<double>`` of every row.  One pass, no shuffle."""
    prepare(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))

    def run(batches):
        for b in batches:
            rows = [statistics(t) for t in b.column("_text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(rows, pa.list_(pa.float64()))], names=["_id", "stats"])

    return src.mapInArrow(run, f"_id {src.schema['_id'].dataType.simpleString()}, stats array<double>").withColumnRenamed("_id", "doc_id")


@dataclass(frozen=True)
class Forest:
    """Complete binary trees in arrays: the children of node k are 2k + 1 and
    2k + 2; a value over the threshold goes right."""

    feature: np.ndarray          # (trees, 2 ** depth - 1)
    threshold: np.ndarray        # the same; infinite where a node does not split
    leaf: np.ndarray             # (trees, 2 ** depth)
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for rows of statistics."""
        total = np.full(len(x), self.prior)
        if len(self.leaf):
            inner = self.feature.shape[1]
            base = np.arange(len(self.leaf)) * inner
            feature, threshold, rows = self.feature.ravel(), self.threshold.ravel(), np.arange(len(x))[:, None]
            node = np.zeros((len(x), len(self.leaf)), np.int64)
            for _ in range((inner + 1).bit_length() - 1):
                at = base + node
                node = 2 * node + 1 + (x[rows, feature[at]] > threshold[at])
            total = total + self.leaf[np.arange(len(self.leaf)), node - inner].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Forest:
    """Boosted trees for the logistic loss, grown on histograms."""
    n, width = x.shape if x.ndim == 2 else (0, len(FEATURES))
    share = (y.sum() + 0.5) / (n + 1) if n else 0.5
    prior = math.log(share / (1 - share))
    inner = 2 ** depth - 1
    if not n or y.min() == y.max():
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), prior)
    cuts = [np.unique(np.quantile(x[:, f], np.arange(1, BINS) / BINS, method="lower")) for f in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    edges = np.full((width, BINS), np.inf)             # value <= edges[f, b] is bin <= b
    for f, c in enumerate(cuts):
        edges[f, : len(c)] = c
    columns = np.arange(width) * BINS
    margin = np.full(n, prior)
    feature, threshold, leaf = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, curvature = y - p, np.maximum(p * (1 - p), 1e-12)
        node = np.zeros(n, np.int64)
        feats, limits = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, count = 2 ** level - 1, 2 ** level
            cell = (((node - first) * (width * BINS))[:, None] + columns + binned).ravel()
            g, h = (np.bincount(cell, np.repeat(v, width), minlength=count * width * BINS).reshape(count, width, BINS).cumsum(axis=2)
                    for v in (gradient, curvature))
            all_g, all_h = g[:, :, -1:], h[:, :, -1:]
            gain = g * g / (h + RIDGE) + (all_g - g) ** 2 / (all_h - h + RIDGE) - all_g ** 2 / (all_h + RIDGE)
            gain[(h < LEAST_CURVATURE) | (all_h - h < LEAST_CURVATURE)] = -np.inf
            best = gain.reshape(count, -1).argmax(axis=1)
            split = gain.reshape(count, -1)[np.arange(count), best] > 1e-9
            f, b = best // BINS, best % BINS
            feats[first : first + count] = np.where(split, f, 0)
            limits[first : first + count] = np.where(split, edges[f, b], np.inf)
            node = 2 * node + 1 + (x[np.arange(n), feats[node]] > limits[node])
        g, h = (np.bincount(node - inner, v, minlength=inner + 1) for v in (gradient, curvature))
        values = rate * g / (h + RIDGE)
        margin = margin + values[node - inner]
        feature.append(feats)
        threshold.append(limits)
        leaf.append(values)
    return Forest(np.array(feature), np.array(threshold), np.array(leaf), prior)


def held_out(doc_id: Column, *, folds: int = 5) -> Column:
    """True for rows whose labels must not be learnt (a null id is one)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == 0


def fit_on_labels(stats: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "quality",
                  sample: int = SAMPLE) -> Forest:
    """Forest from labelled rows that are not held out, ``sample`` at most."""
    marks = (labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("y"))
             .filter("doc_id is not null and y is not null").filter(~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("double").alias("y")))
    rows = (stats.join(marks, "doc_id").select("stats", "y", F.xxhash64("doc_id", "stats").alias("order"))
            .orderBy("order", "y").limit(sample).toArrow())
    x = rows.column("stats").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
    return fit(x, rows.column("y").to_numpy())


def score(stats: DataFrame, forest: Forest, *, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``stats``."""
    shared = stats.sparkSession.sparkContext.broadcast(forest)

    def run(batches):
        for b in batches:
            x = b.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(shared.value.scores(x), pa.float64())],
                                             names=["doc_id", "score"])

    kind = stats.schema["doc_id"].dataType.simpleString()
    out = stats.select("doc_id", "stats").mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "quality", threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """Statistics, fit and scores: ``doc_id, held_out, score, predicted``, one
    row per row of ``docs``."""
    stats = cut_lineage(with_statistics(docs, id_col=id_col, text_col=text_col))
    return score(stats, fit_on_labels(stats, labels, id_col=id_col, label_col=label_col, sample=sample), threshold=threshold)
