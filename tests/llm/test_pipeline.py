import hashlib

import numpy as np
import public_tokenizers as P
import tiktoken

import corpus_pipeline
from quillspark.llm import byte_bpe


def test_stages_against_plain_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    ranks = byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    before = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        assert docs.columns == columns, name
        now = {r.doc_id for r in docs.collect()}
        assert now <= before and now
        before = now
    final = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    want = sorted((r.doc_id, hashlib.sha256(np.array(enc.encode_ordinary(r.text), "<u4").tobytes()).hexdigest()) for r in docs.collect())
    assert sorted((r.doc_id, r.ids_sha256) for r in final) == want
    again = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r.doc_id, r.ids_sha256) for r in again) == want


def test_extra_columns_and_nulls(spark, edges, sf):
    docs = edges
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == docs.count()


def test_near_keeps_one_row_of_each_class(spark, documents, sf):
    one, other = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    docs = documents([(4, one, "s"), (4, one, "s"), (4, one, "s"), (5, other, "s"), (5, one + " end", "s"), (6, other, "s"), (7, "alone", "s"), (7, "alone", "s")])
    got = corpus_pipeline.near(spark, docs, sf).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(4, one), (5, other), (7, "alone")]


def test_mix_emits_rows_not_ids(spark, documents, sf):
    a, b, c = ("x " * 16, "y " * 16, "z " * 16)
    rows = [(1, a, "s"), (1, a, "s"), (1, a, "s"), (1, a, "s"), (1, b, "s"), (2, c, "s")]
    got = corpus_pipeline.mixed(spark, documents(rows), sf).collect()
    assert sorted((r.doc_id, r.text, r.source) for r in got) == rows


def test_stages_against_brute_force(spark, documents, write):
    """Every stage of a small corpus, held against plain Python or the operator that decides."""
    import random

    from test_line_dedup import LONG, expected
    from test_near_dedup import components, edited

    from quillspark.llm.mixing import mix
    from quillspark.llm.quality_classifier import score_documents

    rng, rows, labels = random.Random(5), [], []
    for i in range(60):
        good = i % 2 == 0
        w = [f"{'word' if good else '#%'}{rng.randrange(300)}" for _ in range(60 if good else 12)]
        rows.append((i, " ".join(w) + "." + (f"\n{LONG}" if i % 3 == 0 else ""), "ab"[i % 2]))
        labels.append((i, int(good), 0))
    rows += [(100 + i, edited(rows[2 * i][1].split(" "), rng, 1), "b") for i in range(6)] + [rows[4], (200, None, "a"), (201, "", None), (None, rows[0][1], "a")]
    y = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    sf, docs = write(labels=y), documents(rows)
    kept = corpus_pipeline.quality(spark, docs, sf)
    predicted = {r.doc_id for r in score_documents(docs, y).where("predicted = 1").collect()}
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == sorted((i, t or "") for i, t, _ in rows if i is not None and i in predicted)
    assert kept.count() > 30 and {i for i in range(1, 60, 2)}.isdisjoint(predicted)

    given = [(r.doc_id, r.text, r.source) for r in kept.collect()]
    cleaned = spark.createDataFrame(corpus_pipeline.lines(spark, kept, sf).collect(), kept.schema)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted(((r.doc_id, digest(r.text), r.source) for r in cleaned.collect()), key=str) == sorted(((i, h, s) for (i, _, _, h), s in zip(expected(given), [x[2] for x in sorted(given, key=lambda g: str((g[0], len((g[1] or "").split(chr(10))))))], strict=True)), key=str)

    texts = {r.doc_id: r.text for r in cleaned.collect()}
    want = {i for i, c in components(texts).items() if i == c}
    single = spark.createDataFrame(corpus_pipeline.near(spark, cleaned, sf).collect(), kept.schema)
    assert sorted(r.doc_id for r in single.collect()) == sorted(want)

    mixed = corpus_pipeline.mixed(spark, single, sf).collect()
    taken = {r.doc_id: round(r.taken / r["size"] + 1e-9) for r in mix(single).collect() if r["size"]}
    assert sorted(r.doc_id for r in mixed) == sorted(i for i, n in taken.items() for _ in range(n))


def test_empty_tables(spark, documents, write):
    none = documents([]).where("false").drop("size")
    sf = write(documents=none, labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_repeated_ids_keep_their_own_columns(spark, documents, sf):
    got = corpus_pipeline.lines(spark, documents([(1, "x", "a"), (1, "y", "b"), (1, "x", "c")]), sf).collect()
    assert sorted((r.text, r.source) for r in got) == [("x", "a"), ("x", "c"), ("y", "b")]
