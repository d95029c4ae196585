"""Registered queries cover whole texts and sequences."""

import datetime
import random

import numpy as np

from quillspark.functions import kernels as K
from quillspark.operators import alignment, context
from quillspark.plans import kernel_queries, measure_queries


def test_keys_of_whole_texts(spark, tmp_path):
    head = "ｱ b, " * 60
    texts = {1: head + "ｶﾞ end.", 2: head + "other", 3: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.nfkc, r.lenient, r.surface) for r in kernel_queries.nfkc_keys(spark, str(tmp_path)).collect()}
    assert got == {i: (K.nfkc(t or ""), K.lenient_key(t or ""), K.surface_key(t or "")) for i, t in texts.items()}
    assert all(a != b for a, b in zip(got[1], got[2], strict=True))


def test_warping_of_whole_sequences(spark, tmp_path):
    rng = random.Random(4)
    values = {u: [rng.random() * 100 for _ in range(n)] for u, n in {1: 1, 2: 20, 3: 90}.items()}
    rows = [(u, datetime.datetime(2026, 1, 1) + datetime.timedelta(seconds=i), i, v) for u, vs in values.items() for i, v in enumerate(vs)]
    spark.createDataFrame(rows, "user_id long, ts timestamp, event_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.user_id: (r.cost, r.steps) for r in kernel_queries.dtw(spark, str(tmp_path)).collect()}
    seen = {u: np.array([int(v % 10) for v in vs]) for u, vs in values.items()}
    assert got == {u: alignment.warp(abs(np.subtract.outer(np.sort(x), x)).astype(float)) for u, x in seen.items()}


def test_large_catalogue_in_blocks(spark, sf, monkeypatch):
    want = sorted(map(tuple, measure_queries.catalog_dice_topk(spark, sf).collect()))
    monkeypatch.setattr(context, "MAX_ENTRIES", 30)
    monkeypatch.setattr(context, "TILE_QUERIES", 1)
    assert want and sorted(map(tuple, measure_queries.catalog_dice_topk(spark, sf).collect())) == want
