"""Each stage of the pipeline against brute force over its own input."""

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from lithomesh.llm import jaccard_join, quality, secrets
from lithomesh.plans.storage import materialise

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(materialise(stage(spark, seen[-1], SF), "test-stage"))
    first, good, distinct, unlike, clean, packed = (x.toPandas() for x in seen)
    for frame in (good, distinct, unlike, clean):
        assert list(frame.columns) == docs.columns
    scores = quality.score(docs, quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))).toPandas()
    assert set(good["doc_id"]) == set(scores[scores["score"] >= quality.CUT]["doc_id"])
    lowered = good["text"].fillna("").map(lambda t: t.encode().lower())
    assert set(distinct["doc_id"]) == set(good.groupby(lowered)["doc_id"].max())
    groups = jaccard_join.jaccard_components(seen[2]).toPandas()
    assert set(unlike["doc_id"]) == set(groups["component_id"])
    assert set(clean["doc_id"]) == set(unlike["doc_id"])
    spans = secrets.scan(seen[3]).toPandas().set_index("doc_id")
    texts = unlike.set_index("doc_id")["text"]
    for row in clean.itertuples():
        marked = sorted((s["start"], s["end"]) for k in ("assign", "access", "hex", "random") for s in spans.loc[row.doc_id, k])
        out, at, text = [], 0, texts[row.doc_id]
        for start, end in marked:
            if start >= at:
                out += [text[at:start], "[SECRET]"]
            at = max(at, end)
        assert row.text == "".join([*out, text[at:]])
        assert row.n_chars == len(row.text) or not marked
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for row in clean.itertuples():
        own = packed[packed["doc_id"] == row.doc_id].sort_values("start")
        assert np.concatenate([np.frombuffer(x, "<u4") for x in own["ids"]]).tolist() == plain.encode(row.text, add_special_tokens=False).ids + [2]
    assert packed.groupby("sequence_id")["length"].sum().max() <= 4096
    assert corpus_pipeline.run(spark, SF).count() == len(packed)


def test_no_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF), "test-stage")
        assert docs.count() == 0
