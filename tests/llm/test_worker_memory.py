"""A Python worker keeps little between its tasks."""

from __future__ import annotations

import re
from pathlib import Path

import public_tokenizers
import pyarrow as pa

from crawlscope.llm import packing

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def held_mb() -> int:
    return int(re.search(r"RssAnon:\s+(\d+)", Path("/proc/self/status").read_text()).group(1)) // 1024


def test_tokenizer_is_loaded_once():
    assert packing.Ids(WORD_BPE, 2).tokenizer is packing.Ids(WORD_BPE, 2).tokenizer


def test_packing_gives_memory_back(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: f)
    run = packing.pack_texts(docs, WORD_BPE, memo=10_000)
    monkeypatch.undo()
    some = docs.toArrow()
    pool = pa.default_memory_pool()

    def batches():
        # As Spark's reader does: each batch is read anew, and nothing else holds it.
        for _ in range(3):
            sink = pa.BufferOutputStream()
            whole = pa.concat_tables([some] * 10).combine_chunks().to_batches()[0]
            with pa.ipc.new_stream(sink, whole.schema) as w:
                w.write_batch(whole)
            data = sink.getvalue()
            del sink, whole
            yield pa.ipc.open_stream(data).read_next_batch()

    pool.release_unused()
    n = sum(b.num_rows for b in run(batches()))
    assert n >= 30 * some.num_rows
    after = held_mb()
    pool.release_unused()
    assert after - held_mb() < 20
