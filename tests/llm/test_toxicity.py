import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import toxicity as X


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y))
    return row[-1]


TERMS = ["idiot", "scum", "worthless", "abab", "ababa", "disgusting"]


@given(st.one_of(st.text("abdiotscumwrhleg", max_size=11), st.sampled_from(TERMS).flatmap(lambda t: st.builds(lambda i, c: t[:i] + c + t[i + 1 :], st.integers(0, len(t)), st.text("abx", max_size=2)))))
@settings(max_examples=300, deadline=None)
def test_automaton_against_edit_distance(word):
    lexicon = test_automaton_against_edit_distance.__dict__.setdefault("lexicon", X.Lexicon(dict.fromkeys(TERMS, 1.0), {"stemm": 1.0}))
    near = [(distance(word, t), t) for t in TERMS if distance(word, t) <= X.edits_allowed(len(t))]
    got = lexicon.match(word)
    assert (got is None) == (not near)
    if near:
        assert distance(word, got[0]) == min(near)[0] and (got[1] == X.EXACT) == (min(near)[0] == 0)


def test_stems_and_restart(monkeypatch):
    lexicon = X.Lexicon({"idiot": 1.0}, {"lowei": 1.0})
    assert lexicon.match("loweischaft") == ("lowei", X.STEM) and lexicon.match("lowe") is None
    lexicon._restart()
    assert lexicon.match("idot") == ("idiot", X.NEAR)


def test_quotation_scores_lower():
    s = X.Scorer({"idiot": 0.9}, {})
    plain, quoted, reported = s.score("you are an idiot, go away"), s.score('there is a slogan "an idiot" on it'), s.score("he wrote that an idiot lived there")
    assert plain > 0.8 and quoted < 0.5 and reported < 0.5 and s.score("nothing here") < 0.3
    assert s.score("what an 1diot") > 0.3


def test_common_harmless_words_near_a_term(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(6))
    rows = [(0, " ".join([word() for _ in range(20)] + ["oron"])) for _ in range(50)] + [(1, " ".join([word() for _ in range(20)] + ["moron"])) for _ in range(20)]
    s = X.learn(spark.createDataFrame(rows, "label int, body string"))
    assert s.harmless == {"oron"} and s.score("an oron it is") < 0.3 and s.score("you m0ron") >= 0.3 and s.score("a stuped thing") >= 0.3


def test_held_out_accuracy_and_isolation(spark, documents, write):
    rng, rows, labels = random.Random(4), [], []
    for i in range(600):
        words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 9))) for _ in range(60)]
        bad = rng.random() < 0.2
        if bad:
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice(["idiot", "moron", "worthles", "zzxqu" + words[0]])
        rows.append((i, " ".join(words), "s"))
        labels.append((i, 1, int(bad)))
    y = "doc_id long, quality int, toxic int"
    got = {r.doc_id: r for r in X.op5_query(spark, write(documents=documents(rows), labels=spark.createDataFrame(labels, y))).collect()}
    out = [r for r in got.values() if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3) for i, r in got.items())
    assert np.mean([r.predicted == labels[r.doc_id][2] for r in out]) > 0.95
    flipped = [(i, q, 1 - t if got[i].held_out else t) for i, q, t in labels]
    again = {r.doc_id: r.score for r in X.score_documents(documents(rows), spark.createDataFrame(flipped, y)).collect()}
    assert all(again[i] == got[i].score for i in again)


def test_edges(spark, edges, documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = X.score_documents(edges, none).collect()
    assert len(got) == 10 and not any(r.predicted for r in got)
    assert X.score_documents(documents([]).where("false"), none).count() == 0


def test_near_copies_count_once_and_short_terms_are_learnt(spark, documents):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(6))
    rows = [(i, " ".join([word() for _ in range(30)] + (["zqx"] if i % 4 == 0 else [])), "s") for i in range(400)]
    rows += [(1000 + i, rows[1][1] + " copied", "s") for i in range(30)]
    y = spark.createDataFrame([(i, 1, int(i % 4 == 0 or i >= 1000)) for i, _, _ in rows], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in X.score_documents(documents(rows), y).collect()}
    assert np.mean([got[i].predicted == (i % 4 == 0) for i in range(400)]) > 0.98
    again = {r.doc_id: r.score for r in X.score_documents(documents(rows).repartition(9), y).collect()}
    assert all(again[i] == got[i].score for i in got)
