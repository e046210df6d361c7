"""Token counts with a whole-token shortcut.

Before any text is read, every vocabulary string is run through the merges
once; those that end as exactly one token, their own, form the *whole-token*
table.  A pre-token in that table counts 1 without any merge.  Only the other
pre-tokens are merged, the distinct ones of a batch together.

Results: a null text counts like an empty one (0 bytes, 0 tokens); repeated
rows each get their own result; a null ``doc_id`` is kept as null; an empty
table gives an empty result.  A very long text is counted whole, in a batch of
its own if need be (memory of a few times its length); columns other than the
id and the text are not read, whatever their names.
"""

from __future__ import annotations

import functools

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._common import prepare, text_or_empty
from quarry.llm._tokens import ChunkTable, PairTable, Vocabulary, byte_alphabet, load_vocabulary, pre_token_plan
from quarry.llm.bpe_codec import encode_words


@functools.lru_cache(maxsize=4)
def whole_tokens(vocab: Vocabulary) -> frozenset[bytes]:
    """The pre-tokens proved to encode as one token: vocabulary strings whose
    merges give back that single id."""
    end, alphabet = vocab.end_of_word, byte_alphabet()
    words = {bytes(map(alphabet.__getitem__, s.removesuffix(end))): i for s, i in vocab.ids.items()
             if s.endswith(end) and s != end}
    coded = encode_words(list(words), PairTable(vocab))
    return frozenset(w for (w, i), ids in zip(words.items(), coded, strict=True) if ids == [i])


class TokenCounter:
    """Counts tokens of texts; one per worker and vocabulary."""

    def __init__(self, vocab: Vocabulary, whole: frozenset[bytes]):
        self.vocab, self.whole, self.table = vocab, whole, PairTable(vocab)
        self.chunks = ChunkTable(vocab, self.count_chunks, entries=800_000)

    def count_chunks(self, chunks: list[str]) -> list[int]:
        one = [1]                                     # stands for any whole token
        plan, rest = pre_token_plan(self.vocab, chunks, lambda pre: one if pre in self.whole else None)
        merged = [len(ids) for ids in encode_words(rest, self.table)]
        return [sum(1 if isinstance(p, list) else merged[p] for p in parts) for parts in plan]

    def count(self, texts: list[str]) -> list[int]:
        return [sum(values) for values in self.chunks.rows(texts)]


_WORKER: dict = {}


def token_counts(docs: DataFrame, vocab_path: str, *, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 2048) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, n_tokens, over_limit``.
    One pass, no shuffle."""
    spark = docs.sparkSession
    prepare(spark)
    vocab = load_vocabulary(vocab_path)
    shared = spark.sparkContext.broadcast((vocab, whole_tokens(vocab)))

    def run(batches):
        vocab, whole = shared.value
        counter = _WORKER.setdefault(hash(vocab.source), None) or TokenCounter(vocab, whole)
        _WORKER[hash(vocab.source)] = counter
        for b in batches:
            text = b.column("_text")
            n = pa.array(counter.count(text.to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("_id"), pc.cast(pc.binary_length(text), pa.int64()), n], names=["_id", "n_bytes", "n_tokens"])

    src = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    id_type = src.schema["_id"].dataType.simpleString()
    out = src.mapInArrow(run, f"_id {id_type}, n_bytes long, n_tokens long")
    return out.select(F.col("_id").alias("doc_id"), "n_bytes", "n_tokens",
                      (F.col("n_tokens") > limit).alias("over_limit"))
