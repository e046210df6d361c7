"""Registered queries of the operators, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import (bpe_codec, chat_format, collocations, conversation_trie, embedding_dedup, packing, quality_classifier,
                        quality_rules, secret_scan, simhash_dedup, suffix_dedup, token_counts, warc_fixity)
from quarry.llm._common import prepare

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _register(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@_register
def op1_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@_register
def op2_quality_rules(spark, sf_dir):
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


_SLACK = ", ".join(f"('{k}', {v})" for k, v in quality_rules.SLACK.items())
_RATES = ", ".join(f"{{'k': '{k}', 'v': {k}}}" for k in quality_rules.SLACK)
ORACLES["op2_quality_rules"] = rf"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[ \t-\r]+'), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS lines FROM t),
g AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
d AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM d CROSS JOIN (VALUES (0), (1), (2)) o(k) GROUP BY 1),
b AS (SELECT doc_id, lang, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
             length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g')) AS caps, length(regexp_replace(text, '[^!?]+', '', 'g')) AS bangs
      FROM w LEFT JOIN c USING (doc_id)),
r AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             1000 * n_symbols // greatest(word_chars, 1) AS symbol_rate, 1000 * n_dup_lines // greatest(n_lines, 1) AS dup_line_rate,
             1000 * n_repeat_words // greatest(n_words, 1) AS repeat_rate, 1000 * caps // greatest(word_chars, 1) AS capital_rate,
             1000 * bangs // greatest(word_chars, 1) AS bang_rate, 1000 * word_chars // greatest(n_words, 1) AS word_length FROM b),
u AS (SELECT doc_id, lang, source, base_failed, unnest([{_RATES}], recursive := true) FROM r),
l AS (SELECT 0 AS lev, lang AS a, source AS b, k, v FROM u WHERE NOT base_failed
      UNION ALL SELECT 1, lang, '', k, v FROM u WHERE NOT base_failed
      UNION ALL SELECT 2, '', '', k, v FROM u WHERE NOT base_failed),
o AS (SELECT *, row_number() OVER (PARTITION BY lev, a, b, k ORDER BY v) AS rn, count(*) OVER (PARTITION BY lev, a, b, k) AS n FROM l),
q AS (SELECT lev, a, b, k, max(n) AS n, min(v) FILTER (rn >= 0.25 * n) AS q1, min(v) FILTER (rn >= 0.5 * n) AS q2,
             min(v) FILTER (rn >= 0.75 * n) AS q3 FROM o GROUP BY 1, 2, 3, 4),
f AS (SELECT q.*, greatest(q3 + 3 * (q3 - q1), q2 + s.slack) AS fence FROM q JOIN (VALUES {_SLACK}) s(k, slack) USING (k)),
x AS (SELECT u.doc_id, bool_and(u.v <= f0.n / (f0.n + {quality_rules.PRIOR}.0::DOUBLE) * f0.fence + (1 - f0.n / (f0.n + {quality_rules.PRIOR}.0::DOUBLE))
                                * (f1.n / (f1.n + {quality_rules.PRIOR}.0::DOUBLE) * f1.fence + (1 - f1.n / (f1.n + {quality_rules.PRIOR}.0::DOUBLE)) * f2.fence)) AS within
      FROM u JOIN f f0 ON f0.lev = 0 AND f0.a = u.lang AND f0.b = u.source AND f0.k = u.k
      JOIN f f1 ON f1.lev = 1 AND f1.a = u.lang AND f1.k = u.k JOIN f f2 ON f2.lev = 2 AND f2.k = u.k GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(within, true) AS kept FROM r LEFT JOIN x USING (doc_id)"""


@_register
def op3_chat_format(spark, sf_dir):
    return chat_format.format_chats(table(spark, sf_dir, "conversations"))


@_register
def op4_bpe_codec(spark, sf_dir):
    return bpe_codec.round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@_register
def op5_suffix_dedup(spark, sf_dir):
    return suffix_dedup.removal_digests(table(spark, sf_dir, "documents"))


@_register
def op6_warc_fixity(spark, sf_dir):
    """The pages as WARC records, against a replica in which the first byte of
    some records is changed and others are lost (a rule on the page id, the
    same in the SQL)."""
    records = warc_fixity.warc_records(table(spark, sf_dir, "pages"))
    damaged = F.concat(F.lit("X").cast("binary"), F.expr("substring(record, 2)"))
    replica = records.filter("page_id is null or page_id % 41 != 7").withColumn(
        "record", F.when(F.col("page_id") % 37 == 5, damaged).otherwise(F.col("record")))
    return warc_fixity.fixity_report(records, replica).select("page_id", "length", "record_sha256", "status")


ORACLES["op6_warc_fixity"] = r"""
WITH r AS (
  SELECT page_id, md5(coalesce(CAST(page_id AS VARCHAR), '') || ' ' || coalesce(url, '')) AS n, coalesce(url, '') AS url,
         coalesce(html, '') AS body FROM pages),
w AS (
  SELECT page_id, 'WARC/1.1' || e'\r\n' || 'WARC-Type: resource' || e'\r\n' || 'WARC-Record-ID: <urn:uuid:'
    || n[1:8] || '-' || n[9:12] || '-' || n[13:16] || '-' || n[17:20] || '-' || n[21:32] || '>' || e'\r\n'
    || 'WARC-Target-URI: ' || regexp_replace(url, '[\r\n]', ' ', 'g') || e'\r\n' || 'WARC-Date: 1970-01-01T00:00:00Z' || e'\r\n'
    || 'Content-Type: text/html' || e'\r\n' || 'Content-Length: ' || CAST(strlen(body) AS VARCHAR) || e'\r\n\r\n'
    || body || e'\r\n\r\n' AS rec FROM r)
SELECT page_id, CAST(strlen(rec) AS BIGINT) AS length, sha256(rec) AS record_sha256,
       CASE WHEN page_id % 41 = 7 THEN 'missing' WHEN page_id % 37 = 5 THEN 'corrupt' ELSE 'intact' END AS status
FROM w"""


@_register
def op7_simhash_dedup(spark, sf_dir):
    return simhash_dedup.simhash_groups(table(spark, sf_dir, "documents"))


@_register
def op8_pattern_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@_register
def op9_secret_scan(spark, sf_dir):
    return secret_scan.scan_digests(table(spark, sf_dir, "documents"))


@_register
def op10_embedding_dedup(spark, sf_dir):
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@_register
def op11_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


ORACLES["op11_collocations"] = r"""
WITH t AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, list_filter(regexp_split_to_array(unnest(regexp_split_to_array(text, '[.,;:!?\n-\r]')), '[ \t]+'),
                               lambda x: x <> '') AS w FROM t),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase
      FROM p CROSS JOIN (VALUES (1), (2), (3)) s(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 10),
u AS (SELECT *, unnest(range(1, k)) AS cut FROM c),
s AS (SELECT u.lang, u.k, u.phrase, u.a, l.a AS l, r.a AS r, cut,
             ((1000000::HUGEINT * u.a * u.a) // (l.a::HUGEINT * r.a))::BIGINT AS score
      FROM u JOIN f l ON l.lang = u.lang AND l.k = cut AND l.phrase = array_to_string(u.w[1 : cut], ' ')
      JOIN f r ON r.lang = u.lang AND r.k = u.k - cut AND r.phrase = array_to_string(u.w[cut + 1 : u.k], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
x AS (SELECT lang, phrase, max(a) AS longest FROM (
        SELECT lang, a, unnest([array_to_string(w[1 : 2], ' '), array_to_string(w[2 : 3], ' ')]) AS phrase FROM c WHERE k = 3) GROUP BY ALL),
o AS (SELECT b.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
      FROM b LEFT JOIN x USING (lang, phrase) WHERE longest IS NULL OR 100 * longest < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang) WHERE rank <= 2000"""


@_register
def op12_quality_classifier(spark, sf_dir):
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_register
def op13_conversation_trie(spark, sf_dir):
    return conversation_trie.conversation_trie(table(spark, sf_dir, "conversations"), regroup=True)


# DuckDB has no CRC-32: a table of eight steps per byte, then a fold over the digits.
ORACLES["op13_conversation_trie"] = r"""
WITH crc AS (
  SELECT list_transform(range(0, 256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
           lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT *, sha256(length(role)::VARCHAR || ':' || role || text) AS sha, len(regexp_extract_all(text, '[^ \t-\r]+'))::BIGINT AS words FROM t),
c AS (SELECT conv_id, sha, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, left(sha, 30)) AS p,
             count(*) OVER (PARTITION BY conv_id) AS n FROM s),
o AS (SELECT DISTINCT conv_id, n FROM c),
h AS (SELECT conv_id, n, conv_id - conv_id % 20 AS lead,
             xor(list_reduce(list_concat([4294967295], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
                             lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % 4 AS h FROM o, crc),
v AS (SELECT h.conv_id, h.lead, h.h, least(h.h, coalesce(o.n, 0)) AS k, h.n FROM h LEFT JOIN o ON o.conv_id = h.lead),
r AS (SELECT v.conv_id, c.p AS d, sha, words FROM v JOIN c ON c.conv_id = v.lead AND c.p <= v.h
      UNION ALL SELECT c.conv_id, v.k + c.p - v.h, sha, words FROM c JOIN v USING (conv_id) WHERE c.p > v.h),
m AS (SELECT conv_id, k + greatest(n - h, 0) AS len FROM v),
w AS (SELECT conv_id, d, words, string_agg(sha, '') OVER (PARTITION BY conv_id ORDER BY d) AS path FROM r
      UNION ALL SELECT conv_id, 0, 0, '' FROM m),
nodes AS (SELECT d, path, min(conv_id) AS conv_id, count(*) AS n_convs, min(words) AS words FROM w GROUP BY ALL),
kids AS (SELECT left(path, 64 * (d - 1)) AS path, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
val AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children, (n_convs - 1) * words AS saved FROM nodes LEFT JOIN kids USING (path)),
up AS (SELECT left(path, 64 * i) AS path, sum((n_children = 0)::INT)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens
       FROM (SELECT *, unnest(range(0, d + 1)) AS i FROM val) GROUP BY 1),
ends AS (SELECT path, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256
         FROM w JOIN m USING (conv_id) WHERE d = len GROUP BY 1)
SELECT val.conv_id, val.d::BIGINT AS depth, parent.conv_id AS parent_conv_id, val.n_convs, val.n_children, n_leaves, saved_tokens,
       coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM val JOIN up USING (path) LEFT JOIN ends USING (path) LEFT JOIN nodes parent ON val.d > 0 AND parent.path = left(val.path, 64 * (val.d - 1))"""
