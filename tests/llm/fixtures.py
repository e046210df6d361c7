"""Small messy inputs shared by the tests."""

import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, n_tokens string, kept string, "
          "component_id string, spans string, block double, fp string, _uid string, hashes int")


def messy_rows(n=60, seed=1):
    """Nulls in every column, empty and blank texts, repeated rows, ties, a
    long text, copies and shared passages, secrets, special strings."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 9))) for _ in range(300)]
    passage = " ".join(r.choice(words) for _ in range(25))
    rows = []
    for i in range(n):
        text = " ".join(r.choice(words) for _ in range(r.randint(60, 160)))
        if i % 5 == 0:
            text = text[:200] + "\n" + passage + "\n" + text[200:]
        if i % 7 == 0:
            text += f" token = \"{r.getrandbits(160):040x}\" end"
        rows.append((i, text, r.choice(["en", "de", None]), r.choice(["s0", "s0", "s1", None]), len(text)))
    rows += [(100, None, "en", "s0", None), (101, "", None, None, 0), (102, " \t\n\x0b\x0c\r ", "en", "s1", 7),
             (103, "one", "en", "s0", 3), (104, "<|endoftext|> a<|startoftext|>b  <|endoftext|>\n\nx", "en", "s0", 40),
             (None, rows[3][1], "en", "s0", 1), (None, None, None, None, None),
             (105, rows[4][1], "en", "s1", 5), (106, rows[4][1] + " tail", "en", "s1", 5),
             (107, " ".join(r.choice(words) for _ in range(30_000)), "en", "s0", 9), (108, "x" * 20_000, "en", "s0", 9),
             (109, "İı Σς ﬁ 中文 \U0001F600 é́ \x1c\x1f\x85\xa0", "en", "s0", 9)]
    rows += [rows[5], rows[5], rows[10]]
    rows += [(5, "another text with the id of a repeated row " * 3, "en", "s0", 9)]
    return [(*row, "n", "k", "c", "s", 1.5, "f", "q", 3) for row in rows]


def messy(spark, **options):
    return spark.createDataFrame(messy_rows(**options), SCHEMA).repartition(4)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
