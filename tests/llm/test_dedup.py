"""Passage, SimHash and embedding near-dedup against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from quarry.llm import embedding_dedup, simhash_dedup, suffix_dedup
from quarry.llm.components import components

from .fixtures import empty, messy, messy_rows


def find_roots(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    return [find(x) for x in range(n)]


def test_components(spark):
    r = random.Random(1)
    pairs = [(r.randint(0, 400), r.randint(0, 400)) for _ in range(250)] + [(k, k + 1) for k in range(500, 600)] + [(7, 7), (8, None)]
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    whole = [p for p in pairs if None not in p]
    roots = find_roots(700, whole)
    least = {}
    for x in range(700):
        least.setdefault(roots[x], x)
    for x in {v for p in whole for v in p if p[0] != p[1]}:
        assert got[x] == least[roots[x]]
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


# ---- passages ----------------------------------------------------------------

def removal(rows, length=50):
    first = {}
    for i, t in sorted(((r[0], r[1]) for r in rows if r[0] is not None), key=lambda r: r[0]):
        raw = (t or "").encode()
        for k in range(len(raw) - length + 1):
            first.setdefault(raw[k : k + length], i)
    out = []
    for i, t, *_ in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        if i is not None:
            for k in range(len(raw) - length + 1):
                if first[raw[k : k + length]] < i:
                    gone[k : k + length] = True
        spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out.append((i, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def test_equal_windows():
    r = random.Random(4)
    for _ in range(60):
        length, letters = r.choice([3, 5, 8]), r.choice([b"ab", b"abc", b"\x00\x01a"])
        contents = list({bytes(r.choice(letters) for _ in range(r.randint(length, 30))) for _ in range(r.randint(1, 12))})
        ids = np.array([r.randint(0, 9) for _ in contents])
        least = {}
        for c, i in zip(contents, ids, strict=True):
            for k in range(len(c) - length + 1):
                least[c[k : k + length]] = min(least.get(c[k : k + length], 99), i)
        for c, found in zip(contents, suffix_dedup.smallest_ids(contents, ids, length), strict=True):
            assert found.tolist() == [least[c[k : k + length]] for k in range(len(c) - length + 1)]


def test_equal_windows_have_equal_keys():
    r = random.Random(6)
    raw = bytes(r.choice(b"ab") for _ in range(3000))
    keys = suffix_dedup.window_keys(np.frombuffer(raw, np.uint8), 50)
    by = {}
    for k, key in enumerate(keys.tolist()):
        assert by.setdefault(raw[k : k + 50], key) == key
    texts = [b"a" * 5000, b"ab" * 20, bytes(r.choice(b"abc") for _ in range(700)), b"", b"b" * 50]
    key, row, start, n = suffix_dedup.text_segments(texts, [0, 1, 2, 3, 4], 50)
    assert n.max() <= suffix_dedup.LONGEST_RUN
    whole = [(k, s + w, x) for k, s, c, x in zip(row.tolist(), start.tolist(), n.tolist(), key.tolist(), strict=True) for w in range(c)]
    assert whole == [(k, w, x) for k, t in enumerate(texts)
                     for w, x in enumerate(suffix_dedup.window_keys(np.frombuffer(t, np.uint8), 50).tolist())]


@pytest.mark.parametrize("crowd", [50_000, 3])
def test_removal_messy(spark, crowd):
    rows = [r for r in messy_rows() if r[0] != 107]
    df = messy(spark).filter("doc_id is null or doc_id != 107")
    got = Counter(tuple(r) for r in suffix_dedup.removal_digests(df, crowd=crowd).collect())
    assert got == removal(rows)


def test_removal_repetitive(spark):
    r = random.Random(5)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 9))) for _ in range(40)]
    passages = [" ".join(r.choice(words) for _ in range(20)) for _ in range(6)]
    rows = []
    for _ in range(150):
        text = " ".join(r.choice(passages) if r.random() < .3 else " ".join(r.choice(words) for _ in range(r.randint(1, 15)))
                        for _ in range(r.randint(0, 6)))
        rows.append((r.randint(0, 120) if r.random() < .95 else None, None if r.random() < .03 else text))
    rows += [*rows[:9], (7, "a" * 3000), (8, "a" * 200), (9, "ab" * 400)] + [(500 + i, rows[0][1]) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for crowd in (50_000, 3):
        assert Counter(tuple(x) for x in suffix_dedup.removal_digests(df, crowd=crowd).collect()) == removal(rows)


def test_cut_repeats(spark):
    df = spark.createDataFrame([(1, "é" * 100, "en", 1.5), (2, "x" + "é" * 100, "de", 2.5), (None, None, None, None)],
                               "doc_id int, text string, ids string, block double")
    assert {tuple(r) for r in suffix_dedup.cut_repeats(df).collect()} == {
        (1, "é" * 100, "en", 1.5), (2, "x", "de", 2.5), (None, "", None, None)}
    assert suffix_dedup.removal_digests(empty(spark)).collect() == []
    assert suffix_dedup.cut_repeats(empty(spark)).collect() == []


# ---- SimHash -----------------------------------------------------------------

def simhash(text, words=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + words]).encode(), 42) for i in range(max(1, len(w) - words + 1))]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def groups(ids, prints, bits=2):
    f = np.array(prints, np.uint64)
    pairs = [(i, i + 1 + int(j)) for i in range(len(f)) for j in np.nonzero(np.bitwise_count(f[i] ^ f[i + 1 :]) <= bits)[0]]
    roots = find_roots(len(f), pairs)
    least = {}
    for i, root in zip(ids, roots, strict=True):
        if i is not None:
            least[root] = min(least.get(root, i), i)
    return [least.get(root) for root in roots]


def test_simhash_messy(spark):
    rows = messy_rows()
    prints = [simhash(r[1]) for r in rows]
    want = Counter((r[0], f"{p:016x}", c) for r, p, c in zip(rows, prints, groups([r[0] for r in rows], prints), strict=True))
    assert Counter(tuple(r) for r in simhash_dedup.simhash_groups(messy(spark)).collect()) == want
    assert simhash_dedup.simhash_groups(empty(spark)).collect() == []


def test_keep_one(spark):
    df = messy(spark)
    kept = simhash_dedup.keep_one(df)
    assert kept.columns == df.columns
    rows = messy_rows()
    prints = [simhash(r[1]) for r in rows]
    # components by position: rows of one id with different texts may be in different ones
    names = groups(list(range(len(rows))), prints)
    least = groups([r[0] for r in rows], prints)
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(dict(zip(names, least, strict=True)).values())


@pytest.mark.parametrize("bits", [0, 1, 2])
def test_crowded_fingerprints(spark, bits):
    """Crowds beyond the limit of a signature, and all distances."""
    r = random.Random(1)
    base, found = [r.getrandbits(64) for _ in range(3)], set()
    while len(found) < 900:
        x = r.choice(base)
        for _ in range(r.randint(0, 6)):
            x ^= 1 << r.randrange(20 if r.random() < .7 else 64)
        found.add(x)
    prints = sorted(found)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {x["fp"]: x["root"] for x in simhash_dedup.fingerprint_components(df, bits).collect()}
    assert [got.get(x, x) for x in signed] == groups(signed, prints, bits)


@pytest.mark.parametrize("bits", [0, 1, 2])
def test_every_signature_is_a_crowd(spark, monkeypatch, bits):
    """The path of crowded signatures links within the distance only."""
    monkeypatch.setattr(simhash_dedup, "CROWD", 1)
    r = random.Random(2)
    base, found = r.getrandbits(62), set()
    while len(found) < 200:
        x = base
        for _ in range(r.randint(0, 4)):
            x ^= 1 << r.randrange(62)
        found.add(x)
    prints = sorted(found)
    df = spark.createDataFrame([(x,) for x in prints], "fp long")
    got = {x["fp"]: x["root"] for x in simhash_dedup.fingerprint_components(df, bits).collect()}
    assert [got.get(x, x) for x in prints] == groups(prints, prints, bits)


def test_allocation_is_the_cheapest():
    costs = [{-1: 0.0, 0: 5.0, 1: 50.0}, {-1: 0.0, 0: 1.0, 1: 9.0}, {-1: 0.0, 0: 2.0, 1: 30.0}]
    cost, chosen = simhash_dedup.allocate(costs, 0)
    assert sum(chosen) == 0 and cost == 8.0
    assert simhash_dedup.allocate(costs, 1) == (16.0, [0, 1, 0])


# ---- embeddings ----------------------------------------------------------------

def embedding_rows():
    r = np.random.default_rng(3)
    centres = r.standard_normal((25, 16))
    rows = []
    for i in range(500):
        v = centres[i % 25] + r.standard_normal(16) * r.choice([0.02, 0.15, 0.6])
        rows.append((i, [float(x) for x in v]))
    rows += [(600, rows[0][1]), (601, rows[0][1]), (601, rows[0][1]), (602, [0.0] * 16), (603, None), (604, [float("nan")] * 16),
             (605, [None] + [1.0] * 15), (606, [float("inf")] + [0.0] * 15), (607, []), (608, [1.0, 2.0]), (None, rows[1][1]),
             (None, [float(x) for x in r.standard_normal(16)]), (609, [x * 1e-200 for x in rows[2][1]]),
             (5, [float(x) for x in r.standard_normal(16)])]
    return rows


def embedding_truth(rows, threshold=0.95):
    ok = [k for k, (_, v) in enumerate(rows) if v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    x = np.array([np.array(rows[k][1]) / np.abs(rows[k][1]).max() for k in ok])
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    roots = find_roots(len(ok), zip(*np.nonzero(near), strict=True))
    least = {}
    for k, root in zip(ok, roots, strict=True):
        if rows[k][0] is not None:
            least[root] = min(least.get(root, 1 << 60), rows[k][0])
    links, comp = {k: 0 for k in range(len(rows))}, {k: rows[k][0] for k in range(len(rows))}
    for n, k in enumerate(ok):
        links[k], comp[k] = int(near[n].sum()), least.get(roots[n], rows[k][0])
    return [(rows[k][0], links[k], comp[k], rows[k][0] == comp[k]) for k in range(len(rows))]


@pytest.mark.parametrize("block", [2048, 7])
def test_embeddings_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rows = embedding_rows()
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, key string, w int").repartition(4)
    got = embedding_dedup.near_duplicates(df).collect()
    want = embedding_truth(rows)
    found, true = sum(r["n_links"] for r in got), sum(t[1] for t in want)
    assert 0.9 * true <= found <= true             # recall, and no link below the threshold
    assert Counter(tuple(r) for r in got) == Counter(want)


def test_embeddings_empty(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    only = embedding_dedup.near_duplicates(spark.createDataFrame([(1, None, 1), (2, [0.0], 1)], schema)).collect()
    assert {tuple(r) for r in only} == {(1, 0, 1, True), (2, 0, 2, True)}


def test_recall_on_planted_vectors(spark, tmp_path):
    """End to end on a written table: vectors of two lengths, each with copies
    turned by up to the threshold, against all pairs."""
    r = np.random.default_rng(7)
    rows, true = [], 0
    for dims, n in ((48, 3_000), (10, 700)):
        x = r.standard_normal((n, dims))
        x /= np.linalg.norm(x, axis=1)[:, None]
        near = x[r.integers(0, n, n // 2)] + r.uniform(0, 0.33, (n // 2, 1)) * (lambda d: d / np.linalg.norm(d, axis=1)[:, None])(
            r.standard_normal((n // 2, dims)))
        x = np.vstack([x, near, x[: n // 20]]) * r.uniform(0.1, 9, (n + n // 2 + n // 20, 1))
        unit = x / np.linalg.norm(x, axis=1)[:, None]
        true += int((unit @ unit.T >= 0.95).sum()) - len(x)
        rows += [(len(rows) + k, v) for k, v in enumerate(x.tolist())]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/e")
    got = embedding_dedup.near_duplicates(spark.read.parquet(f"{tmp_path}/e")).collect()
    found = sum(v["n_links"] for v in got)
    assert len(got) == len(rows) and true > 2_000
    assert 0.99 * true <= found <= true


def test_multi_sequence_order():
    r = np.random.default_rng(0)
    unit = r.standard_normal((200, 8))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    index = embedding_dedup.MultiIndex.fit(unit, 200, 0.95, 0.99)
    for x, cells, home in zip(unit, index.visits(unit), index.home(unit), strict=True):
        assert cells[0] == home
        late = index.lateness(np.repeat(x[None], len(cells), 0), cells)
        assert (np.diff(late) >= -1e-12).all() and late.max() <= index.slack + 1e-12


@pytest.mark.parametrize("dims", [4, 6])
def test_recall_near_a_subspace(dims):
    """Links along few directions, at the codebook size of 3e7 rows, on
    vectors that the index was not fitted on."""
    r = np.random.default_rng(dims)
    x = r.standard_normal((12_000, dims)) @ r.standard_normal((dims, 64)) + 0.01 * r.standard_normal((12_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    index = embedding_dedup.MultiIndex.fit(x[:8000], 30_000_000, 0.95, 0.995)
    assert len(index.books[0]) > 900
    x = x[8000:]
    a, b = np.nonzero(np.triu(x @ x.T >= 0.95, 1))
    home, found = index.home(x), []
    for k in range(0, min(len(a), 60_000), 4000):
        u, v = a[k : k + 4000], b[k : k + 4000]
        found.append(np.minimum(index.lateness(x[u], home[v]), index.lateness(x[v], home[u])) <= index.slack)
    assert np.concatenate(found).mean() >= 0.98
