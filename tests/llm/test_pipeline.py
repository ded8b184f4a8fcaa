"""The corpus pipeline: its stages one by one against brute force on the smallest tables."""

import collections

import numpy as np

import corpus_pipeline
from millrace.llm import near_duplicates, packing, toxicity
from millrace.llm.shared import documents, table

from ..conftest import SF


def test_stages_keep_columns_and_take_effect(spark):
    docs = documents(spark, SF)
    columns = docs.columns
    model = toxicity.train(docs, table(spark, SF, "labels"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        after = docs.collect()
        assert docs.columns == columns
        if name == "toxicity":
            score = toxicity.scorer(model)
            assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before if score([r.text or ""])[0] < toxicity.THRESHOLD)
        elif name == "near_duplicates":
            sets = near_duplicates.window_sets([r.text or "" for r in after])
            for i, x in enumerate(sets):
                assert all(len(np.intersect1d(x, y)) < 0.8 * len(np.union1d(x, y)) for y in sets[:i] if len(x) and len(y))
            assert {r.text for r in after} <= {r.text for r in before} and len(after) < len(before)
        elif name == "repeated_spans":
            assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before)
            count = collections.Counter(t[i : i + 200] for t in ((r.text or "").encode() for r in before) for i in range(len(t) - 199))
            cut = {r.doc_id: (r.text or "").encode() for r in after}
            for r in before:
                data = (r.text or "").encode()
                gone = {j for i in range(len(data) - 199) if count[data[i : i + 200]] > 1 for j in range(i, i + 200)}
                kept = bytes(c for j, c in enumerate(data) if j not in gone)
                assert cut[r.doc_id] == kept.decode("utf-8", "ignore").encode()
        else:
            assert all(n <= 2 for n in collections.Counter(r.doc_id for r in after).values())
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    tokenizer = packing._tokenizer(None)[0]
    whole = sum(len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect())
    assert sum(r.length for r in pieces) == whole


def test_run_equals_its_stages_and_itself(spark):
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    rows = lambda df: sorted(map(tuple, df.select(*columns).collect()))
    docs = documents(spark, SF)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
    by_hand = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    # Rows of equal documents may be cut at other places; the documents and the number of tokens are the same.
    whole = lambda df: (sorted((r.doc_id, r.doc_tokens) for r in df.collect() if r.start == 0), sum(r.length for r in df.collect()))
    first, second = corpus_pipeline.run(spark, SF), corpus_pipeline.run(spark, SF)
    assert whole(first) == whole(second) == whole(by_hand)
    assert rows(first)
