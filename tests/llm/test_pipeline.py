"""The pipeline against its stages done by hand."""

from __future__ import annotations

import hashlib
import importlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import tiktoken
from tests.llm.conftest import ODD, documents
from tests.llm.test_near_dedup import groups

from fernweave.llm import mixing, queries, secret_scan, toxicity


def test_stages_by_hand(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = queries.toxicity_model(docs, spark.read.parquet(f"{small}/labels.parquet"))
    clean = {k: r for k, r in rows.items() if model.score(r.text)[0] < 0.5}
    least = groups([(k, r.text) for k, r in clean.items()], words=5)
    single = [r for k, r in clean.items() if least[k] == k]
    kept = spark.createDataFrame(single, docs.schema)
    net = secret_scan.fit(kept)
    masked = []
    for r, spans in zip(single, secret_scan.find([r.text for r in single], net)):
        text, done, out = r.text or "", 0, ""
        for _, s, e, _ in spans:
            if s > done or not out:
                out += text[done:s] + "[SECRET]"
            done = max(done, e)
        masked.append((r.doc_id, out + text[done:], r.lang, r.source, len(out + text[done:])))
    copies = {r.doc_id: r.taken // r.size for r in mixing.mix(spark.createDataFrame(masked, docs.schema)).where("size > 0").collect()}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=queries.codec().ranks, special_tokens={})
    want = []
    for key, text, *_ in masked:
        ids = encoding.encode_ordinary(text)
        want += [(key, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())] * copies.get(key, 1)
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, small).collect())
    assert got == sorted(want)


def test_every_stage_takes_rows_of_any_kind(spark, small, odd, empty):
    for docs, n in ((odd, len(ODD)), (empty, 0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, small)
            assert out.columns == docs.columns, name
            assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
            out.count()
        assert corpus_pipeline.encode_texts(spark, docs, small).count() == n


def test_clean_documents_stay(spark, small):
    rows = [(i, f"A text of its own, number {i}, that says {' '.join(f'thing{i}x{k}' for k in range(30))}.", "en", "a", 1) for i in range(20)]
    docs = documents(spark, rows)
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, small)
        assert sorted(r.doc_id for r in docs.collect()) == list(range(20)), name


def test_entry_point_lists_all(spark):
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert {f"op{n}_" for n in range(1, 11)} <= {x.split("_")[0] + "_" for x in names} and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
    assert toxicity.FIT_TOXIC and set(queries.ORACLES) == {"op3_mixing", "op8_near_dedup", "op9_sharding", "op10_quality", "op11_hard_negatives", "op13_divergence"}
