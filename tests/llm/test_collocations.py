"""Phrase collocations against a plain count, and the trie on its own."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import collocations

from .fixtures import empty, messy, messy_rows

SCHEMA = "doc_id long, text string, lang string"


def pieces(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [re.findall("[^ \t]+", p) for p in re.split("[.,;:!?\n-\r]", low)]


def counts_of(texts, max_words):
    f = Counter()
    for t in texts:
        for w in pieces(t):
            f.update(tuple(w[i : i + k]) for k in range(1, max_words + 1) for i in range(len(w) - k + 1))
    return f


def brute(rows, least=10, top=2000, min_words=2, max_words=3):
    by, out = defaultdict(list), []
    for lang, text in rows:
        by["und" if lang is None else lang].append(text)
    for lang, texts in by.items():
        f = counts_of(texts, max_words)
        n = sum(v for p, v in f.items() if len(p) == 1)
        c = {p: (a, *min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))))
             for p, a in f.items() if len(p) >= min_words and a >= least}
        bad = {p[i:j] for p in c for i in range(len(p)) for j in range(i + min_words, len(p) + 1)
               if j - i < len(p) and p[i:j] in c and 2 * c[p][0] >= c[p[i:j]][0]}
        best = sorted((-v[1], -v[0], " ".join(p).encode(), v) for p, v in c.items() if p not in bad)[:top]
        out += [(lang, k + 1, p.decode(), v[0], v[3], v[4], n, v[1]) for k, (_, _, p, v) in enumerate(best)]
    return sorted(out)


def merged(rows, parts, max_words):
    """Counts of all phrases out of the rows of a ``Counter``."""
    got, names = Counter(), {}
    for part in range(parts):
        own = [x for x in rows if x[0] == part]
        table = pa.table({k: [x[i] for x in own] for k, i in (("ids", 1), ("counts", 2), ("words", 3), ("hot", 4))})
        ids, words, counts, clashes = collocations.merge_words(table)
        assert clashes == 0
        names |= {i: w[1].decode() for i, w in zip(ids.tolist(), words, strict=True)}
        got.update(dict(zip(((i,) for i in ids.tolist()), counts.tolist(), strict=True)))
        final = Counter()
        for ids, counts, hot in collocations.merge_phrases(table, max_words):
            for key, n, partial in zip(map(tuple, ids.T.tolist()), counts.tolist(), hot.tolist(), strict=True):
                assert partial or key not in got                       # only partial sums come from several partitions
                final[key] += n
        got.update(final)
    return Counter({tuple(names[i] for i in k): n for k, n in got.items()})


def run(df, **options):
    return sorted(map(tuple, collocations.collocations(df, **options).collect()))


def test_messy_texts(spark):
    rows = [(r[2], r[1]) for r in messy_rows()]
    assert run(messy(spark), least=3) == brute(rows, least=3)


def test_top_ties_and_other_lengths(spark):
    rows = [(i, "A b c d. a B c d\ta b; x y! x y? z\n" * 5, lang) for i, lang in enumerate(["en", None, "und", "en"])]
    df = spark.createDataFrame(rows, SCHEMA)
    plain = [(r[2], r[1]) for r in rows]
    for options in ({}, {"top": 2}, {"max_words": 4}, {"max_words": 2, "least": 2}, {"least": 10_000}):
        assert run(df, **options) == brute(plain, **options), options


def test_spills_bursts_and_new_ids(spark, monkeypatch):
    """Tiny limits: many bursts, spills, and word ids that run out."""
    r = random.Random(5)
    words = [f"w{int(r.paretovariate(.7)) % 900}" for _ in range(12_000)]
    texts = [" ".join(words[i : i + 400]) + r.choice([".", "", " ; a b"]) for i in range(0, 12_000, 400)]
    want = counts_of(texts, 3)
    monkeypatch.setattr(collocations, "BURST", 50)
    monkeypatch.setattr(collocations, "MEMORY", 2_000)
    monkeypatch.setattr(collocations, "SLICE", 300)
    monkeypatch.setattr(collocations, "HOT", 2)
    texts += [f"hot pair w{i}" for i in range(3_000)] + ["hot pair", "hot pair. hot pair", "hot"]
    want = counts_of(texts, 3)
    for limit in (1 << 20, 700):
        monkeypatch.setattr(collocations, "WORDS", limit)
        counter = collocations.Counter(3, 4, 9)
        rows = [x for t in texts for x in counter.add(b"en", [t.encode()])]
        assert len(counter.trie.boxes) > 20 and all(b.size <= 50 for b in counter.trie.boxes)
        rows += list(counter.rows(0))
        assert len(rows) > 8 and counter.trie.size == 0
        assert any(x[4] for x in rows)                                 # hot prefixes
        assert merged(rows, 4, 3) == want


def test_runs_are_sorted_and_parted_by_prefix():
    trie = collocations.HatTrie(3)
    keys = np.unique(np.random.default_rng(1).integers(1, 1 << 60, 200_000))
    trie.add(keys, np.ones(len(keys), np.int64))
    assert len(trie.boxes) > 2 and all(b.size <= collocations.BURST for b in trie.boxes)
    assert all(a.hi == b.lo for a, b in zip(trie.boxes, trie.boxes[1:], strict=False))
    runs = trie.spill(100_000)
    assert 0 < trie.size <= 100_000
    assert all((np.diff(k) > 0).all() for k, _ in runs)
    assert sum(len(k) for k, _ in runs) + trie.size == len(keys)


def test_words_that_share_an_id_are_found():
    table = {"ids": [[np.array([7, 7], np.uint64).tobytes()]], "counts": [[np.array([3, 4]).tobytes()]], "words": [b"en\xffone\xfeen\xfftwo"]}
    assert collocations.merge_words(pa.table(table))[3] == 1
    table["words"] = [b"en\xffone\xfeen\xffone"]
    assert collocations.merge_words(pa.table(table))[3] == 0


def test_equal_digests_of_different_phrases(monkeypatch):
    monkeypatch.setattr(collocations, "digest", lambda columns: columns[0] * np.uint64(0))
    ids = np.array([[1, 2, 1, 1], [5, 5, 5, 6]], np.uint64)
    order, starts, sums = collocations._sums(ids, np.array([1, 2, 3, 4]))
    assert dict(zip(map(tuple, ids[:, order[starts]].T.tolist()), sums.tolist(), strict=True)) == {(1, 5): 4, (2, 5): 2, (1, 6): 4}


def test_large_counts_are_exact(spark):
    """Products beyond 64 bits."""
    a, l, r = 3_000_000_007, 4_000_000_009, 9_000_000_011
    found = spark.createDataFrame(
        [(1, [1], l, "en", "x"), (1, [2], r, "en", "y"), (2, [1, 2], a, None, None)], "size int, ids array<long>, f long, lang string, word string")
    row = collocations.with_scores(found, max_words=2).first()
    assert (row["phrase"], row["score"]) == ("x y", 10**6 * a * a // (l * r))


@pytest.mark.parametrize("text", [None, "", " \t\n", ".,;"])
def test_nothing_to_count(spark, text):
    assert run(empty(spark)) == []
    assert run(spark.createDataFrame([(1, text, "en")], SCHEMA), least=1) == []


def test_long_text_over_slices(spark, monkeypatch):
    text = "one two three four " * 5_000
    rows = [(1, text, "en"), (2, "x" * 3_000_000 + " one two", "en")]
    monkeypatch.setattr(collocations, "SLICE", 1_000)
    counter = collocations.Counter(3, 1, 0)
    rows_out = [x for _, t, _ in rows for x in counter.add(b"en", [t.encode()])] + list(counter.rows(0))
    assert merged(rows_out, 1, 3) == counts_of([t for _, t, _ in rows], 3)
