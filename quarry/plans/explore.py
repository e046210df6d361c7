"""Registered queries: select, text filter, rendering, sort, shape, column
list, preview, column statistics, cross-tabulation, ranks
(P1, P2, P10, O1, S6-S8, A1, A8, A9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.columns import render_text
from quarry.operators import explore, rank
from quarry.plans.registry import (EVENTS_WITH_NULLS_SQL, as_money, column_listing_sql, events_with_nulls, exact_mean_sql,
                                    register, rounded, table)

_CUSTOMER_COLS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


@register("select_columns", sql="SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def select_columns(spark, sf):
    return explore.select_columns(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber", "l_quantity"])


_ANY = " OR ".join(f"coalesce(contains(lower(CAST({c} AS VARCHAR)), '99'), false)" for c in _CUSTOMER_COLS)


@register("filter_any_text", sql=f"SELECT * FROM customer WHERE {_ANY}")
def filter_any_text(spark, sf):
    return explore.filter_any_text(table(spark, sf, "customer"), "99")


@register("filter_any_text_words", sql="SELECT * FROM customer WHERE "
          + " OR ".join(f"coalesce(contains(lower(CAST({c} AS VARCHAR)), 'furn'), false)" for c in _CUSTOMER_COLS))
def filter_any_text_words(spark, sf):
    return explore.filter_any_text(table(spark, sf, "customer"), "Furn")


@register("text_rendering", sql="SELECT " + ", ".join(
    f"lower(CAST({c} AS VARCHAR)) AS {c}" for c in _CUSTOMER_COLS) + " FROM customer")
def text_rendering(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(*[F.lower(render_text(c, n)).alias(n) for n in c.columns])


@register("sort_by", sql="""
SELECT p_partkey, p_retailprice, row_number() OVER (ORDER BY p_retailprice DESC NULLS LAST, p_partkey)::BIGINT AS pos
FROM part""")
def sort_by(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_retailprice")
    return explore.sorted_positions(p, "p_retailprice", ascending=False, then=["p_partkey"])


@register("sort_by_text", sql="""
SELECT p_partkey, p_brand, row_number() OVER (ORDER BY p_brand DESC NULLS LAST, p_partkey)::BIGINT AS pos FROM part""")
def sort_by_text(spark, sf):
    return explore.sorted_positions(table(spark, sf, "part").select("p_partkey", "p_brand"), "p_brand", ascending=False,
                                    then=["p_partkey"])


@register("sort_by_time", sql="""
SELECT event_id, ts, row_number() OVER (ORDER BY ts ASC NULLS LAST, event_id)::BIGINT AS pos FROM events""")
def sort_by_time(spark, sf):
    return explore.sorted_positions(table(spark, sf, "events").select("event_id", "ts"), "ts", then=["event_id"])


@register("sort_by_missing", sql=f"""
SELECT event_id, value, row_number() OVER (ORDER BY value DESC NULLS LAST, event_id)::BIGINT AS pos
FROM ({EVENTS_WITH_NULLS_SQL}) e""")
def sort_by_missing(spark, sf):
    return explore.sorted_positions(events_with_nulls(spark, sf).select("event_id", "value"), "value", ascending=False,
                                    then=["event_id"])


@register("sort_position", sql="""
SELECT p_partkey, p_name, rank() OVER (ORDER BY p_name DESC NULLS LAST)::BIGINT AS pos FROM part""")
def sort_position(spark, sf):
    """Shared places of equal keys, descending over text."""
    return explore.sort_position(table(spark, sf, "part").select("p_partkey", "p_name"), "p_name", ascending=False)


@register("crosstab_absent", sql="""
SELECT a.p_brand, s.p_size, count(p.p_partkey)::BIGINT AS n
FROM (SELECT DISTINCT p_brand FROM part) a CROSS JOIN (SELECT DISTINCT p_size FROM part) s
LEFT JOIN part p ON p.p_brand = a.p_brand AND p.p_size = s.p_size GROUP BY 1, 2""")
def crosstab_absent(spark, sf):
    """A9 with its zero cells: many pairs of brand and size do not occur."""
    return explore.crosstab(table(spark, sf, "part"), "p_brand", "p_size", dense=True)


@register("profile_shape", sql="SELECT count(*)::BIGINT AS n_rows, 11::BIGINT AS n_cols FROM lineitem")
def profile_shape(spark, sf):
    return explore.profile_shape(table(spark, sf, "lineitem"))


_LINEITEM_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                  "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@register("list_columns", sql=column_listing_sql("lineitem", _LINEITEM_COLS))
def list_columns(spark, sf):
    return explore.list_columns(table(spark, sf, "lineitem"), with_counts=True)


_PART_COLS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]


@register("preview", sql="SELECT " + ", ".join(
    f"coalesce(CAST({c} AS VARCHAR), 'NaN') AS {c}" for c in _PART_COLS)
    + " FROM (SELECT * FROM part ORDER BY p_partkey LIMIT 20) p")
def preview(spark, sf):
    return explore.preview(table(spark, sf, "part"), 20, ["p_partkey"])


# lineitem's amounts have two decimals: read as DECIMAL(18,2), their means are
# exact in both engines (a double mean can sit on a rounding tie)
_STAT_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_STATS_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c})::BIGINT AS count, round({exact_mean_sql(c)}, 6) + 0.0 AS mean,
       round(stddev_samp({c}), 6) + 0.0 AS std, round(min({c}), 6) + 0.0 AS min,
       round(max({c}), 6) + 0.0 AS max FROM lineitem""" for c in _STAT_COLS)


@register("column_stats", sql=_STATS_SQL)
def column_stats(spark, sf):
    li = as_money(table(spark, sf, "lineitem"), _STAT_COLS)
    return rounded(explore.column_stats(li, _STAT_COLS))


@register("column_stats_by_group", sql=" UNION ALL ".join(
    f"""SELECT l_returnflag, '{c}' AS "column", count({c})::BIGINT AS count,
       round({exact_mean_sql(c)}, 6) + 0.0 AS mean, round(stddev_samp({c}), 6) + 0.0 AS std,
       round(min({c}), 6) + 0.0 AS min, round(max({c}), 6) + 0.0 AS max
       FROM lineitem GROUP BY l_returnflag""" for c in _STAT_COLS))
def column_stats_by_group(spark, sf):
    li = as_money(table(spark, sf, "lineitem"), _STAT_COLS)
    return rounded(explore.column_stats(li, _STAT_COLS, by=["l_returnflag"]))


@register("crosstab", sql="""
SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2""")
def crosstab(spark, sf):
    return explore.crosstab(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")


@register("crosstab_labels", sql="SELECT quality, toxic, count(*)::BIGINT AS n FROM labels GROUP BY 1, 2")
def crosstab_labels(spark, sf):
    return explore.crosstab(table(spark, sf, "labels"), "quality", "toxic")


_RANK_SQL = """
SELECT l_orderkey, l_linenumber,
       rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS rank
FROM lineitem"""


@register("average_rank", sql=_RANK_SQL.format(c="l_extendedprice"))
def average_rank(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return rank.average_rank(li, "l_extendedprice").drop("l_extendedprice")


@register("average_rank_ties", sql=_RANK_SQL.format(c="l_discount"))
def average_rank_ties(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_discount")
    return rank.average_rank(li, "l_discount").drop("l_discount")


@register("average_rank_by_group", sql="""
SELECT l_orderkey, l_linenumber, l_returnflag,
       rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity)
       + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS rank
FROM lineitem""")
def average_rank_by_group(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    return rank.average_rank(li, "l_quantity", by=["l_returnflag"]).drop("l_quantity")
