"""The corpus pipeline against its stages in plain Python."""

import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from quarry.llm import quality_rules, secret_scan  # noqa: E402

from .fixtures import SCHEMA, messy, messy_rows  # noqa: E402
from .test_dedup import groups, simhash  # noqa: E402


def cut(rows, length=50):
    """``rows`` (id, text) without passages of earlier documents."""
    first = {}
    for i, t in sorted(((i, t) for i, t in rows if i is not None), key=lambda r: r[0]):
        raw = t.encode()
        for k in range(len(raw) - length + 1):
            first.setdefault(raw[k : k + length], i)
    out = []
    for i, t in rows:
        raw = np.frombuffer(t.encode(), np.uint8)
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - length + 1 if i is not None else 0):
            if first[raw[k : k + length].tobytes()] < i:
                gone[k : k + length] = True
        out.append((i, raw[~gone].tobytes().decode("utf-8", errors="ignore")))
    return out


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "suffix_array_dedup", "secret_scan",
                                                      "pattern_packing"]


def test_pipeline(spark, tmp_path):
    rows = [r for r in messy_rows() if r[0] not in (107, 108)]
    docs = messy(spark).filter("doc_id is null or doc_id not in (107, 108)")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    verdict = quality_rules.quality_rules(docs).collect()
    good = {r["doc_id"] for r in verdict if r["kept"]}
    kept = [(r[0], r[1]) for r in rows if r[0] in good and len((r[1] or "").split()) >= 50]
    prints = [simhash(t) for _, t in kept]
    groups_of = groups([i for i, _ in kept], prints)
    chosen = {}
    for (i, t), g in zip(kept, groups_of, strict=True):
        if i == g:
            chosen[g] = (i, t)
    texts = cut(sorted(chosen.values(), key=lambda r: (r[0] is None, r[0])))
    df = spark.createDataFrame([(i, t, *next(r[2:] for r in rows if r[0] == i)) for i, t in texts], SCHEMA)
    spans = {r["doc_id"]: r["spans"] for r in secret_scan.scan_digests(df).collect()}
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, t in texts:
        runs = []
        for a, b in sorted(tuple(map(int, s.split(":")[1:])) for s in spans[i].split(",") if s):
            if runs and a <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], b)
            else:
                runs.append([a, b])
        clean, at = "", 0
        for a, b in runs:
            clean, at = clean + t[at:a] + "[SECRET]", b
        ids = [*tok.encode(clean + t[at:], add_special_tokens=False).ids, 1]
        for p, k in enumerate(range(0, len(ids), 4096)):
            want[i, p, k, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want


def test_stages_keep_columns(spark):
    docs = messy(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").schema.simpleString() == docs.schema.simpleString()
        assert stage(spark, docs.limit(0), "").collect() == []


def test_texts_in_small_batches_and_pages(spark, tmp_path):
    for key in ("spark.sql.parquet.columnarReaderBatchSize", "parquet.page.size"):
        spark.conf.unset(key)
    words = F.concat_ws(" ", *[F.hex(F.xxhash64("id", F.lit(k))) for k in range(50)])
    docs = spark.range(0, 8000, 1, 2).select(F.col("id").alias("doc_id"), words.alias("text"))
    size = docs.agg(F.sum(F.length("text"))).first()[0]
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= 128
    kept.coalesce(1).write.parquet(f"{tmp_path}/out")
    path, = (tmp_path / "out").glob("*.parquet")
    hadoop, parquet = spark._jvm.org.apache.hadoop, spark._jvm.org.apache.parquet.hadoop
    reader = parquet.ParquetFileReader.open(parquet.util.HadoopInputFile.fromPath(hadoop.fs.Path(str(path)), hadoop.conf.Configuration()))
    try:
        columns = [c for b in reader.getFooter().getBlocks() for c in b.getColumns() if c.getPath().toDotString() == "text"]
        pages = sum(reader.readOffsetIndex(c).getPageCount() for c in columns)
    finally:
        reader.close()
    assert size / pages < 512 << 10
    assert spark.read.parquet(f"{tmp_path}/out").count() == 8000
