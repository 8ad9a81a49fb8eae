"""The stages move whole texts in small Arrow batches."""

import corpus_pipeline


def test_stages_use_small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "other words")], "doc_id long, text string")
        kept = corpus_pipeline.near_duplicate_stage(spark, docs, "")
        assert spark.conf.get(key) == "1000"
        assert sorted(r.doc_id for r in kept.collect()) == [1, 3]
    finally:
        spark.conf.set(key, before)


def test_a_block_of_text_takes_little_memory():
    import tracemalloc

    import pyarrow as pa

    from wardline.llm import arrays, suffix_arrays

    text = pa.record_batch([pa.array([" ".join(str(i * j % 9973) for j in range(2000)) for i in range(600)])], ["text"])
    assert text.nbytes > 4 << 20
    for b in arrays.blocks([text], "text"):
        suffix_arrays._contexts(b.column("text"))  # tables of powers are made once
    tracemalloc.start()
    try:
        for b in arrays.blocks([text], "text"):
            suffix_arrays._contexts(b.column("text"))
        assert tracemalloc.get_traced_memory()[1] < 64 << 20
    finally:
        tracemalloc.stop()
