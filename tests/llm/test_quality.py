import random
import zlib

import numpy as np
import pyarrow as pa

from quillspark.llm import quality_classifier as Q
from quillspark.llm.quality_rules import clean_lines, judge


def sample(n=600, seed=1):
    rng, rows, labels = random.Random(seed), [], []
    for i in range(n):
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(30, 120))]
        good = rng.random() < 0.7
        text = " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words) if i % 2 else " ".join(w + "***" for w in words)
        rows.append((i, text, f"src{i % 3}"))
        labels.append((i, int(good), 0))
    return rows, labels


def test_held_out_accuracy_and_isolation(spark, documents, write):
    rows, labels = sample()
    y = "doc_id long, quality int, toxic int"
    path = write(documents=documents(rows), labels=spark.createDataFrame(labels, y))
    got = {r.doc_id: r for r in Q.op3_query(spark, path).collect()}
    out = [r for r in got.values() if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert np.mean([r.predicted == labels[r.doc_id][1] for r in out]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    # Labels of held-out rows change nothing.
    flipped = [(i, 1 - q if got[i].held_out else q, t) for i, q, t in labels]
    again = {r.doc_id: r.score for r in Q.score_documents(documents(rows), spark.createDataFrame(flipped, y)).collect()}
    assert all(abs(again[i] - got[i].score) < 1e-9 for i in again)


def test_classifier_edges(spark, edges, documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = Q.score_documents(edges, none).collect()
    assert len(got) == 10 and {r.score for r in got} == {0.5} and not any(r.held_out for r in got if r.doc_id is None)
    some = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (7, 1, 0), (6, 0, 0), (8, None, 1), (None, 1, 1), (2, 7, 0)], "doc_id long, quality int, toxic int")
    assert len(Q.score_documents(edges, some).collect()) == 10
    assert Q.score_documents(documents([]).where("false"), none).count() == 0


def test_statistics_ignore_batching():
    texts = ["One two, three.", "", None, "SHOUT!! SHOUT!!", "a b a b a b", "été 日本"]
    whole = Q.statistics(pa.array(texts))
    assert np.isfinite(whole).all()
    for i, t in enumerate(texts):
        assert np.allclose(Q.statistics(pa.array([t], pa.string()))[0], whole[i])


def test_discriminant_matches_the_density():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (300, 3)), rng.normal(1, 2, (300, 3))])
    y = np.repeat([0, 1], 300)
    n = np.array([300.0, 300.0])
    m = Q.Discriminant.fit(n, np.stack([x[y == k].sum(0) for k in (0, 1)]), np.stack([x[y == k].T @ x[y == k] for k in (0, 1)]), shrink=0.0, ridge=0.0, temperature=1.0)
    logs = []
    for k in (0, 1):
        c, mu = np.cov(x[y == k].T, bias=True), x[y == k].mean(0)
        logs.append(-0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", x - mu, np.linalg.inv(c), x - mu))
    assert np.allclose(m.score(x), 1 / (1 + np.exp(logs[0] - logs[1])))


def naive(t):
    import re

    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    again = len({i + j for i, x in enumerate(tri) if tri.count(x) > 1 for j in range(3)})
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, again


def test_rules_against_plain_python(spark, documents):
    rng = random.Random(7)
    rows = [(i, "\n".join(" ".join(rng.choice(["a", "b", "menu", "x|y", "é", "日本", "#t"]) for _ in range(rng.randrange(0, 9))) for _ in range(rng.randrange(0, 12))), "s") for i in range(120)] + [(500, None, "s"), (501, "", None), (None, "one two", "s")]
    for r in judge(documents(rows)).collect():
        t = next(t for i, t, _ in rows if i == r.doc_id)
        want = naive(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        kept, chars, _ = clean_lines(t or "")
        assert r.kept == (not r.base_failed and chars >= 0.5 * want[1]) and r.kept_text == kept


def test_line_rules():
    assert clean_lines("Plain words end here.\nHome\nA | B | C\nRead our Privacy Policy now.\nBUY!! NOW!! HERE!!\n***\nMore text.")[0] == "Plain words end here.\nMore text."


def test_rules_edges(edges, documents):
    assert judge(edges).count() == 10
    assert judge(documents([]).where("false")).count() == 0
