"""Quality rules with thresholds that follow each language and source.

DataFrame functions only.  Every text gives counts (words, symbols, repeated
lines and word windows, capitals); rates per mille of these counts are
summarised per language and source in quantile sketches, and a document is
rejected when it fails the fixed base rules or lies beyond its group's fence.

A sketch is a histogram of one rate, a counter per whole per mille and no
upper end, so quantiles are exact.  Shares have 1,001 counters at most; V
different mean word lengths take texts of V * V / 40 characters together.
Sketches merge by adding counters, so the result does not depend on the order
or number of partitions.

A sketch's fence lies ``spread`` interquartile ranges above the upper quartile,
and at least ``slack`` above the median: a group without junk loses nothing,
however alike its documents are.  A group of n documents is judged by its own
fence with weight n / (n + ``PRIOR``) and its language's with the rest, a
language likewise by its own and that of all, so no verdict jumps at a count.

Results: a null text has no words and fails the base rules; null languages and
sources form groups of their own; repeated rows count as often as they occur;
an empty table gives an empty result.  A very long text is one array of words
in the engine, its windows of words are sorted there as whole numbers.
``keep_good`` hands all columns on; its own begin with ``_quarry``, so names
cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm._common import prepare
from quarry.session import cut_lineage

# Fixed values of the contract.
WORD_BREAK = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[^#*$%&|<>]+"
MIN_WORDS = 50
REPEAT_PERCENT = 50

#: Rate -> least distance in per mille between the median and the fence.
SLACK = {"symbol_rate": 60, "dup_line_rate": 500, "repeat_rate": 400, "capital_rate": 300, "bang_rate": 60,
         "word_length": 4000}
#: Documents that a group's parent counts for beside the group's own.
PRIOR = 20


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row."""
    return F.transform(F.array(value), use)[0]


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(text, WORD_BREAK), "")


def repeated_words(words: Column) -> Column:
    """Number of words inside 3-word windows that occur twice or more.

    Windows are sorted by a hash packed with their position (primitive longs);
    neighbours with equal hashes are then compared as text, so the count is
    exact."""
    def window(i):
        return F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))

    def packed(i):
        return F.shiftleft(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)), 32).bitwiseOR(i.cast("long"))

    def near(s, key):
        return F.filter(s, lambda x, j: F.coalesce(key(x) == key(F.get(s, j - 1)), F.lit(False))
                        | F.coalesce(key(x) == key(F.get(s, j + 1)), F.lit(False)))

    def exact(s):
        position = near(s, lambda x: F.shiftright(x, 32))
        texts = F.transform(position, lambda x: (lambda i: F.struct(window(i).alias("w"), i.alias("i")))(
            x.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")))
        return _let(F.sort_array(texts), lambda t: covered(F.sort_array(F.transform(near(t, lambda x: x["w"]), lambda x: x["i"]))))

    def covered(starts):
        done = F.aggregate(starts, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
                           lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n")))
        return done["n"].cast("long")

    some = F.transform(F.sequence(F.lit(0), F.size(words) - 3), packed)
    return F.when(F.size(words) >= 4, _let(F.sort_array(some), exact)).otherwise(F.lit(0).cast("long"))


def with_counts(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """Add the base counts, as one struct column ``_quarry_q``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))

    def counts(words):
        def of_lines(lines):
            return F.struct(F.size(lines).cast("long").alias("n"),
                            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("dup"))

        lines = _let(F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")), of_lines)
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(text, SYMBOLS, "")).cast("long").alias("n_symbols"),
            lines.alias("lines"),
            repeated_words(words).alias("n_repeat_words"),
            F.length(F.regexp_replace(text, "[^\\p{Lu}]+", "")).cast("long").alias("n_capitals"),
            F.length(F.regexp_replace(text, "[^!?]+", "")).cast("long").alias("n_bangs"))

    return docs.withColumn("_quarry_q", _let(word_array(text), counts))


def rates() -> dict[str, Column]:
    """Rates per mille, whole numbers."""
    def per_mille(part: str, whole: str) -> Column:
        return F.floor(1000 * F.col(part) / F.greatest(F.col(whole), F.lit(1)))

    return {"symbol_rate": per_mille("_quarry_q.n_symbols", "_quarry_q.word_chars"),
            "dup_line_rate": per_mille("_quarry_q.lines.dup", "_quarry_q.lines.n"),
            "repeat_rate": per_mille("_quarry_q.n_repeat_words", "_quarry_q.n_words"),
            "capital_rate": per_mille("_quarry_q.n_capitals", "_quarry_q.word_chars"),
            "bang_rate": per_mille("_quarry_q.n_bangs", "_quarry_q.word_chars"),
            "word_length": per_mille("_quarry_q.word_chars", "_quarry_q.n_words")}


def base_failed() -> Column:
    return (F.col("_quarry_q.n_words") < MIN_WORDS) | (100 * F.col("_quarry_q.n_repeat_words") > REPEAT_PERCENT * F.col("_quarry_q.n_words"))


def _key(col: str) -> Column:
    """A group key that null cannot clash with."""
    return F.coalesce(F.concat(F.lit("="), F.col(col).cast("string")), F.lit("-"))


def sketches(counted: DataFrame, *, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``level, lang, source, rate, value, n``: the counters of every sketch.
    Level 0 is language and source, 1 the language, 2 all; the upper levels
    are merged from level 0.  Documents that fail the base rules don't count."""
    values = F.explode(F.array(*[F.struct(F.lit(k).alias("rate"), v.cast("long").alias("value"))
                                 for k, v in rates().items()]))
    fine = (counted.filter(~base_failed())
            .select(_key(lang_col).alias("lang"), _key(source_col).alias("source"), values.alias("v"))
            .groupBy("lang", "source", "v.rate", "v.value").agg(F.count(F.lit(1)).alias("n")))
    level = F.explode(F.array(
        F.struct(F.lit(0).alias("level"), F.col("lang").alias("l"), F.col("source").alias("s")),
        F.struct(F.lit(1).alias("level"), F.col("lang").alias("l"), F.lit("").alias("s")),
        F.struct(F.lit(2).alias("level"), F.lit("").alias("l"), F.lit("").alias("s"))))
    return (fine.select(level.alias("g"), "rate", "value", "n")
            .groupBy("g.level", F.col("g.l").alias("lang"), F.col("g.s").alias("source"), "rate", "value")
            .agg(F.sum("n").alias("n")))


def fences(sketch: DataFrame, *, spread: float = 3.0) -> DataFrame:
    """``lang, source, symbol_rate, ...``: one row per language and source."""
    group = ["level", "lang", "source", "rate"]
    upto = Window.partitionBy(*group).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    cum = sketch.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(Window.partitionBy(*group)))

    def quantile(q: float) -> Column:
        return F.min(F.when(F.col("upto") >= q * F.col("total"), F.col("value")))

    slack = F.create_map(*[F.lit(x) for kv in SLACK.items() for x in kv])
    q = cum.groupBy(*group).agg(quantile(.25).alias("q1"), quantile(.5).alias("q2"), quantile(.75).alias("q3"),
                                F.max("total").alias("total"))
    fence = F.greatest(F.col("q3") + spread * (F.col("q3") - F.col("q1")), F.col("q2") + slack[F.col("rate")])
    q = q.select(*group, fence.alias("fence"), "total")
    wide = q.groupBy("level", "lang", "source").agg(
        F.max("total").alias("total"), *[F.max(F.when(F.col("rate") == k, F.col("fence"))).alias(k) for k in SLACK])

    def at(n: int) -> DataFrame:
        return wide.filter(F.col("level") == n).drop("level")

    def struct_of(name: str) -> Column:
        return F.struct("total", *SLACK).alias(name)

    # the upper levels: a row per language, and one row, read as a scalar subquery
    by_lang = at(1).select("lang", struct_of("by_lang"))
    joined = (at(0).select("lang", "source", struct_of("own")).join(by_lang, "lang")
              .withColumn("whole", at(2).select(struct_of("whole")).scalar()))

    def blended(k: str) -> Column:
        """A group's own fence and its parent's, by their numbers of documents;
        the parent's is blended in the same way."""
        def weight(c: str) -> Column:
            return F.col(f"{c}.total") / (F.col(f"{c}.total") + float(PRIOR))

        upper = weight("by_lang") * F.col(f"by_lang.{k}") + (1 - weight("by_lang")) * F.col(f"whole.{k}")
        return weight("own") * F.col(f"own.{k}") + (1 - weight("own")) * upper

    return joined.select("lang", "source", F.struct(*[blended(k).alias(k) for k in SLACK]).alias("fence"))


#: Up to so many fence rows (about 100 bytes each) are broadcast; more are
#: joined by a shuffle of the documents.
BROADCAST_GROUPS = 50_000


def _judge(counted: DataFrame, lang_col: str, source_col: str, spread: float) -> DataFrame:
    """Counted rows (written already) with ``_quarry_base_failed`` and ``_quarry_kept``."""
    fence = cut_lineage(fences(sketches(counted, lang_col=lang_col, source_col=source_col), spread=spread))
    fence = fence.withColumnsRenamed({"lang": "_quarry_lang", "source": "_quarry_source", "fence": "_quarry_fence"})
    if fence.count() <= BROADCAST_GROUPS:
        fence = F.broadcast(fence)
    joined = counted.withColumns({"_quarry_lang": _key(lang_col), "_quarry_source": _key(source_col)}).join(
        fence, ["_quarry_lang", "_quarry_source"], "left")
    within = F.lit(True)
    for name, rate in rates().items():
        within = within & F.coalesce(rate <= F.col(f"_quarry_fence.{name}"), F.lit(True))
    return (joined.withColumn("_quarry_base_failed", base_failed())
            .withColumn("_quarry_kept", ~F.col("_quarry_base_failed") & within).drop("_quarry_lang", "_quarry_source", "_quarry_fence"))


def quality_rules(docs: DataFrame, *, id_col: str = "doc_id", lang_col: str = "lang", source_col: str = "source",
                  text_col: str = "text", spread: float = 3.0) -> DataFrame:
    """One row per row of ``docs``: its id, the base counts, ``base_failed``
    and ``kept``.  Texts are read once; the counts, without texts, go to the
    shared checkpoint folder."""
    prepare(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"),
                       F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    out = _judge(cut_lineage(with_counts(slim).drop("text")), "lang", "source", spread)
    return out.select("doc_id", "_quarry_q.n_words", "_quarry_q.word_chars", "_quarry_q.n_symbols", F.col("_quarry_q.lines.dup").alias("n_dup_lines"),
                      "_quarry_q.n_repeat_words", F.col("_quarry_base_failed").alias("base_failed"), F.col("_quarry_kept").alias("kept"))


def keep_good(docs: DataFrame, *, lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
              spread: float = 3.0) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that ``quality_rules``
    keeps.  The counted rows are written with their texts, so these are
    neither counted twice nor shuffled."""
    prepare(docs.sparkSession)
    counted = cut_lineage(with_counts(docs, text_col=text_col))
    return _judge(counted, lang_col, source_col, spread).filter("_quarry_kept").select(*docs.columns)
