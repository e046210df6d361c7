"""Quality rules and secret scan against brute force."""

import hashlib
import re
from collections import Counter

from pyspark.sql import functions as F

from quarry.llm import quality_rules, secret_scan

from .fixtures import empty, messy, messy_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_counts(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = list(zip(w, w[1:], w[2:], strict=False))
    n = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed)


def test_base_counts(spark):
    texts = ["a b c a b c", "a b c d a b c", "x " * 200, "a\nb\na\n\n \na", "#|<> $$ é&\U0001F600%", "a a a a", "a b", "", None,
             "q w e r t q w e x y q w e", "\x1c a \x85 b c \x1c a"]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = {r[0]: tuple(r[1:7]) for r in quality_rules.quality_rules(df).collect()}
    assert got == {i: base_counts(t) for i, t in enumerate(texts)}


def test_rules_messy(spark):
    rows = quality_rules.quality_rules(messy(spark)).collect()
    assert Counter(tuple(r)[:7] for r in rows) == Counter((row[0], *base_counts(row[1])) for row in messy_rows())
    assert not any(r["kept"] and r["base_failed"] for r in rows)
    assert quality_rules.quality_rules(empty(spark)).collect() == []
    kept = quality_rules.keep_good(messy(spark))
    assert kept.columns == messy(spark).columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in rows if r["kept"])


def words(k, n=80):
    return " ".join(f"w{(k * 7919 + i * 104729) % 100003}" for i in range(n))


def test_thresholds_follow_the_group(spark):
    """A rate that is usual in one source and junk in another."""
    rows = [(i, words(i), "en", "plain") for i in range(150)]
    rows += [(1000 + i, words(i).replace(" ", " | "), "en", "tables") for i in range(150)]
    rows += [(2000, words(9).replace(" ", " | "), "en", "plain"), (2001, words(9).replace(" ", " | "), "xx", "small"),
             (2002, words(8), "xx", "small")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"] for r in quality_rules.quality_rules(df).collect() if r["kept"]}
    assert {r[0] for r in rows[:300]} <= kept        # every clean document stays
    assert 2000 not in kept and 2002 in kept


def test_no_verdict_jumps_with_the_size_of_a_group(spark):
    """The fence of a group moves by a few per mille a document, from its
    parents' towards its own, whatever its size."""
    def fence(n):
        rows = [("=en", "=big", "symbol_rate", 0, 400), ("=en", "=big", "symbol_rate", 300, 400), ("=en", "=small", "symbol_rate", 40, n)]
        both = [(level, a if level < 2 else "", b if level == 0 else "", k, v, c) for level in (0, 1, 2) for a, b, k, v, c in rows]
        sketch = spark.createDataFrame(both, "level int, lang string, source string, rate string, value long, n long").groupBy(
            "level", "lang", "source", "rate", "value").agg(F.sum("n").alias("n"))
        return next(r["fence"]["symbol_rate"] for r in quality_rules.fences(sketch).collect() if r["source"] == "=small")

    own, upper = 40 + quality_rules.SLACK["symbol_rate"], 300 + 3 * 300
    seen = [fence(n) for n in (1, 5, 98, 99, 100, 101, 102)]
    assert all(own < b < a < upper for a, b in zip(seen, seen[1:], strict=False))
    assert all(abs(a - b) < 3 for a, b in zip(seen[2:], seen[3:], strict=False))


def test_long_words_are_usual_in_their_group(spark):
    """A group whose words have 12 characters stays; words far beyond go."""
    def text(k, size):
        return " ".join(f"{(k * 7919 + i * 104729) % 100003:0{size}d}" for i in range(80))

    rows = [(i, text(i, 5), "en", "plain") for i in range(150)] + [(1000 + i, text(i, 12), "de", "long") for i in range(150)]
    rows += [(2000, text(7, 40), "de", "long"), (2001, text(7, 12), "en", "plain")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"] for r in quality_rules.quality_rules(df).collect() if r["kept"]}
    assert kept == {r[0] for r in rows[:300]}


def test_sketches_merge(spark):
    df = quality_rules.with_counts(messy(spark).select("doc_id", "text", "lang", "source"))
    s = quality_rules.sketches(df)
    n = s.groupBy("level", "rate").agg(F.sum("n").alias("n")).collect()
    assert len({r["n"] for r in n}) == 1              # every level counts every document once


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    t = text or ""
    spans = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))


def secret_rows():
    import random

    r = random.Random(2)
    parts = ["password", "PassWD=", "secret: ", "token = \"", "api_key='", "apikey:", "abc", "=abcdefgh", "AKIA", "ABCDEFGH1234",
             "0123456789abcdef", "fedcba98", " ", "\n", "é", "\U0001F600", "x" * 20, "Zz9" * 12, ":"]
    return [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 30))), "en", f"s{i % 7}") for i in range(600)]


def check_spans(rows, df):
    out = secret_scan.scan_digests(df).collect()
    want = Counter()
    for row in rows:
        b = base_spans(row[1])
        kinds = Counter(s.split(":")[0] for s in b.split(",") if s)
        want[row[0], kinds["assign"], kinds["access"], kinds["hex"], hashlib.sha256(b.encode()).hexdigest(), b] += 1
    got = Counter((*tuple(r)[:5], ",".join(s for s in r["spans"].split(",") if not s.startswith("owned"))) for r in out)
    assert got == want
    return out


def test_base_spans(spark):
    rows = secret_rows()
    check_spans(rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3))
    check_spans(messy_rows(), messy(spark))
    assert secret_scan.scan_digests(empty(spark)).collect() == []


def test_ownership(spark):
    copied, own = "Zq8xYw7vUt6sRp5oNm4lKj3iHg2fEd1cBa", "Zq8xYw7vUt6sRp5oNm4lKj3iHg2fEd1cQQ"
    rows = [(i, f"key {copied} zz", "en", f"s{i % 5}") for i in range(10)]
    rows += [(10, f"é {own} zz", "en", "s1"), (11, f"{own}", "de", "s1"), (12, "a" * 40, "en", "s9")]
    rows += [(20 + i, f"token={'0123456789abcdef' * 2}", "en", f"s{i}") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = {r["doc_id"]: r for r in secret_scan.scan_digests(df).collect()}
    assert all(out[i]["n_owned"] == 0 for i in range(10)) and out[12]["n_owned"] == 0
    assert out[10]["spans"] == "owned:2:36" and out[11]["spans"] == "owned:0:34"
    # base spans stay whatever the counts say
    assert all(out[20 + i]["spans"] == "assign:0:38,hex:6:38" and out[20 + i]["n_copied"] == 2 for i in range(4))


def test_redact(spark):
    rows = secret_rows()
    df = spark.createDataFrame([(*r, 1.5) for r in rows], "doc_id long, text string, lang string, source string, hash double")
    spans = {r["doc_id"]: r["spans"] for r in secret_scan.scan_digests(df).collect()}
    clean = secret_scan.redact(df)
    assert clean.columns == df.columns
    got = {r["doc_id"]: r["text"] for r in clean.collect()}
    for i, t, *_ in rows:
        runs = []
        for a, b in sorted(tuple(map(int, s.split(":")[1:])) for s in spans[i].split(",") if s):
            if runs and a <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], b)
            else:
                runs.append([a, b])
        out, at = "", 0
        for a, b in runs:
            out, at = out + t[at:a] + "[SECRET]", b
        assert got[i] == out + t[at:]
