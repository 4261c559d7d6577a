"""What the driver holds while a model learns."""

import tracemalloc

import numpy as np

from terrafold.llm import lang_id


def test_the_driver_holds_the_sample_in_bytes(spark, monkeypatch):
    """2,400 rows of 4,096 features are 10 MB in bytes; decoded whole they were 39 MB, and as much again for their squares."""
    rows = [(k, f"{lang} {k} " * 3, lang) for k in range(600) for lang in ("en", "de", "fr", "es")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sizes = []
    monkeypatch.setattr(lang_id, "train_svm", lambda x, y: (sizes.append(len(x)), (np.zeros(x.shape[1], np.float32), 0.0))[1])
    lang_id.train(df.limit(8))
    sizes.clear()
    tracemalloc.start()
    lang_id.train(df)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sizes == [2400, 2400, 1200, 1200] and peak < 36 << 20


def test_rows_are_decoded_as_a_whole_matrix_is():
    codes = np.random.default_rng(1).integers(0, 256, (50, 4096), dtype=np.uint8)
    codes[7] = 0
    whole = codes.astype(np.float32)
    whole /= np.maximum(np.sqrt((whole * whole).sum(1, keepdims=True)), 1e-9)
    rows, odd = lang_id.Rows(codes), np.arange(50) % 2 == 1
    assert all((rows[k] == whole[k]).all() for k in range(50)) and len(rows.where(odd)) == 25
    assert all((rows.where(odd)[k] == whole[odd][k]).all() for k in range(25))
