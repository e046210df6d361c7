"""Secret scan with corpus-wide ownership frequency.

DataFrame functions only.  Base patterns give spans as they stand.  A wider
pattern for opaque tokens gives candidates, and every candidate value, hashed,
is counted over the corpus by distinct repositories and owners.  A value that
many owners have is a copied example; one that only few owners have and that
looks live (letters and digits, many different characters) is a credential,
and is added as a span of kind ``owned`` unless a base span covers part of it.
Base spans keep their place whatever the counts say; the counts tell how many
of them are copied examples.

Positions come without Python: splitting a text at a pattern gives the gaps
between its matches, and running sums of gaps and matches give the starts.

Results: a null text has no spans; repeated rows are scanned one by one and
count as one repository; null owners are an owner of their own; an empty table
gives an empty result.  A very long text is split at its matches in the engine,
whole; ``redact`` hands all columns on, others are not read, whatever their
names.  Starts and ends are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm._common import prepare, text_or_empty
from quarry.session import cut_lineage

# Fixed values of the contract: kind -> (pattern, group of the value).
BASE = {
    "assign": ("((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2),
    "access": ("AKIA[A-Z0-9]{16,}", 0),       # 20 characters or more: a shorter run fails at every start
    "hex": ("[0-9a-f]{24,}", 0),              # likewise
}
SHORTEST_ASSIGNED = 6
#: The wider pattern, a candidate for ``owned``.
OPAQUE = ("[A-Za-z0-9_+/-]{32,}", 0)
#: Values that more owners than this have are copied examples.
MOST_OWNERS = 2
#: Different characters a live-looking value has at least.
LIVE_CHARACTERS = 10
KINDS = [*BASE, "owned"]


def _matches(text: Column, kind: str, pattern: str, group: int) -> Column:
    """Array of (kind, gap before, length, value), in order; null without a
    match, found by one scan."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    zipped = F.arrays_zip(found.alias("m"), values.alias("v"), F.split(text, pattern, -1).alias("g"))
    rows = F.transform(F.slice(zipped, F.lit(1), F.size(found)), lambda x, i: F.struct(
        F.lit(kind).alias("kind"), i.cast("int").alias("nth"), F.length(x["g"]).alias("gap"),
        F.length(x["m"]).alias("length"), x["v"].alias("value")))
    return F.when(text.rlike(pattern), rows)


def candidates(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``_quarry_found``, the matches of every pattern, and ``_quarry_uid``.
    To be written before further use: the written number is what later steps
    join on."""
    text = text_or_empty(text_col)
    kinds = [_matches(text, k, *p) for k, p in (*BASE.items(), ("owned", OPAQUE))]
    none = F.array().cast("array<struct<kind:string,nth:int,gap:int,length:int,value:string>>")
    return docs.withColumns({"_quarry_found": F.concat(*[F.coalesce(k, none) for k in kinds]),
                             "_quarry_uid": F.monotonically_increasing_id()})


def ownership(spans: DataFrame) -> DataFrame:
    """``hash, owners, repositories`` over distinct candidate values.  Counts
    are combined before each shuffle, so a value that a third of all documents
    hold is one row per task."""
    return (spans.select("hash", "owner", "repository").distinct()
            .groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("r"))
            .groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("r").alias("repositories")))


def spans_of(found: DataFrame, *, owner_col: str, repository_cols: tuple[str, ...], most_owners: int = MOST_OWNERS) -> DataFrame:
    """``_quarry_uid, kind, start, end, owners, repositories, copied``: base spans and
    the owned ones that are kept.  ``found``: written ``candidates``."""
    def name(c):
        return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))

    flat = found.select("_quarry_uid", name(owner_col).alias("owner"),
                        F.sha2(F.concat_ws("\n", *[name(c) for c in repository_cols]), 256).alias("repository"),
                        F.explode("_quarry_found").alias("m")).select("_quarry_uid", "owner", "repository", "m.*")
    upto = Window.partitionBy("_quarry_uid", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    placed = flat.withColumn("end", F.sum(F.col("gap") + F.col("length")).over(upto)).withColumn(
        "start", F.col("end") - F.col("length"))
    placed = placed.filter((F.col("kind") != "assign") | (F.length("value") >= SHORTEST_ASSIGNED))
    base = F.col("kind") != "owned"
    ordered = Window.partitionBy("_quarry_uid").orderBy("start", "end")
    before, after = ordered.rowsBetween(Window.unboundedPreceding, -1), ordered.rowsBetween(1, Window.unboundedFollowing)
    covered = ((F.coalesce(F.max(F.when(base, F.col("end"))).over(before), F.lit(-1)) > F.col("start"))
               | (F.coalesce(F.min(F.when(base, F.col("start"))).over(after), F.lit(1 << 62)) < F.col("end")))
    live = ((F.size(F.array_distinct(F.split("value", ""))) >= LIVE_CHARACTERS)
            & F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]"))
    placed = placed.withColumn("_covered", covered).filter(base | (~F.col("_covered") & live))
    placed = cut_lineage(placed.select("_quarry_uid", "kind", F.col("start").cast("long").alias("start"),
                                       F.col("end").cast("long").alias("end"),
                                       F.sha2("value", 256).alias("hash"), "owner", "repository"))
    known = placed.join(ownership(placed), "hash")
    known = known.withColumn("copied", F.col("owners") > most_owners)
    return known.filter(base | ~F.col("copied")).select("_quarry_uid", "kind", "start", "end", "owners", "repositories", "copied")


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
         repository_cols: tuple[str, ...] = ("source", "lang"), most_owners: int = MOST_OWNERS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``spans`` as an array of
    (start, kind number, end, kind, copied) in order of start, then kind.  One
    pass over the texts, which are not shuffled."""
    prepare(docs.sparkSession)
    wanted = dict.fromkeys([owner_col, *repository_cols])
    slim = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"),
                       *[F.col(c).alias(f"_k_{c}") for c in wanted])
    found = cut_lineage(candidates(slim, text_col="_text").drop("_text"))
    spans = spans_of(found, owner_col=f"_k_{owner_col}", repository_cols=tuple(f"_k_{c}" for c in repository_cols),
                     most_owners=most_owners)
    number = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    per_row = spans.groupBy("_quarry_uid").agg(F.sort_array(F.collect_list(
        F.struct("start", number.alias("number"), "end", "kind", "copied"))).alias("spans"))
    empty = F.array().cast(per_row.schema["spans"].dataType)
    return (found.select("_quarry_uid", F.col("_id").alias("doc_id")).join(per_row, "_quarry_uid", "left")
            .select("doc_id", F.coalesce("spans", empty).alias("spans")))


def scan_digests(docs: DataFrame, **options) -> DataFrame:
    """``scan`` as counts and texts: ``doc_id, n_assign, n_access, n_hex,
    base_sha256, spans, n_owned, n_copied``."""
    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(test):
        return F.size(F.filter("spans", test)).cast("long")

    def of_kind(kind):
        return number(lambda s: s["kind"] == kind)

    return scan(docs, **options).select(
        "doc_id", *[of_kind(k).alias(f"n_{k}") for k in BASE],
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "owned")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"), of_kind("owned").alias("n_owned"),
        number(lambda s: s["copied"]).alias("n_copied"))


def redact(docs: DataFrame, *, text_col: str = "text", owner_col: str = "source",
           repository_cols: tuple[str, ...] = ("source", "lang"), most_owners: int = MOST_OWNERS,
           mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span, overlapping ones joined, replaced by ``mark``.
    Rows without candidates are not shuffled."""
    prepare(docs.sparkSession)
    found = cut_lineage(candidates(docs, text_col=text_col))
    spans = spans_of(found, owner_col=owner_col, repository_cols=repository_cols, most_owners=most_owners)
    ordered = Window.partitionBy("_quarry_uid").orderBy("start", F.desc("end"))
    earlier = F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    runs = (spans.withColumn("_new", F.coalesce(F.col("start") > earlier, F.lit(True)).cast("int"))
            .withColumn("_run", F.sum("_new").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
            .groupBy("_quarry_uid", "_run").agg(F.min("start").cast("int").alias("s"), F.max("end").cast("int").alias("e"))
            .groupBy("_quarry_uid").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("_quarry_runs")))
    text = F.col(text_col)

    def clean(runs):
        parts = F.transform(runs, lambda r, i: F.concat(text.substr(F.when(i == 0, 1).otherwise(F.get(runs, i - 1)["e"] + 1), r["s"] - F.when(
            i == 0, 0).otherwise(F.get(runs, i - 1)["e"])), F.lit(mark)))
        return F.concat(F.array_join(parts, ""), text.substr(F.element_at(runs, -1)["e"] + 1, F.length(text)))

    hit = found.filter(F.size("_quarry_found") > 0).join(runs, "_quarry_uid", "left").withColumn(
        text_col, F.when(F.col("_quarry_runs").isNull(), text).otherwise(clean(F.col("_quarry_runs"))))
    return found.filter(F.size("_quarry_found") == 0).select(*docs.columns).unionByName(hit.select(*docs.columns))
