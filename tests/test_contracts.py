import math

import pytest
from pyspark.sql import functions as F

from quillspark.operators import contracts, spans


def test_only_scores_of_one_domain_are_added_up(spark):
    kind = "g int, semantics string, domain string, normalization string, value double"
    fine = spark.createDataFrame([(1, "p", "d", "n", 0.1), (1, "p", "d", "n", 0.2), (2, "p", "e", None, 0.3)], kind)
    assert contracts.require_same_domain(fine, "g").count() == 3
    for odd, why in (((1, "q", "d", "n", 0.0), "semantics"), ((1, "p", "e", "n", 0.0), "domains"), ((1, "p", None, "n", 0.0), "without a domain"), ((1, "p", "d", None, 0.0), "normalization")):
        rows = fine.union(spark.createDataFrame([odd], kind))
        assert why in {r.g: r.problem for r in contracts.score_domains(rows, "g").collect()}[1]
        with pytest.raises(Exception, match=why):
            contracts.require_same_domain(rows, "g").collect()
    assert contracts.score_domains(fine.where("false"), "g").count() == 0


def test_preferences_and_logits(spark):
    rows = spark.createDataFrame([(1, -1.0), (1, -3.0), (2, -5000.0), (2, 0.0), (3, 7.0)], "g int, v double")
    got = {(r.g, r.v): r.preference for r in contracts.preferences(rows, "g", "v", temperature=2.0).collect()}
    assert got[1, -1.0] == pytest.approx(1 / (1 + math.exp(-1))) and got[2, -5000.0] == pytest.approx(math.exp(-80)) and got[3, 7.0] == 1.0
    with pytest.raises(ValueError):
        contracts.preferences(rows, "g", "v", temperature=0.0)
    one = spark.createDataFrame([([[0.0, 0.0], [1.0, 3.0]], [0, 1]), ([[1.0]], [-100])], "x array<array<double>>, y array<int>")
    parts = one.select(*[c.alias(k) for k, c in contracts.sequence_log_probability(F.col("x"), F.col("y")).items()]).collect()
    want = -math.log(2) + 3 - math.log(math.exp(1) + math.exp(3))
    assert parts[0].sum_logprob == pytest.approx(want) and parts[0].token_count == 2 and parts[1].sum_logprob is None
    with pytest.raises(Exception, match="vocabulary"):
        spark.createDataFrame([([[0.0]], [1])], one.schema).select(contracts.sequence_log_probability(F.col("x"), F.col("y"))["sum_logprob"]).collect()


def test_risk_gate(spark):
    rows = spark.createDataFrame([(0.1, 0.9, 50, 0.95), (0.1, 0.9, 5, 0.95), (0.3, 0.9, 50, 0.95)], "empirical_risk double, empirical_coverage double, sample_count int, cumulative_posterior double")
    gate = lambda r, **k: [x.ok for x in r.select(contracts.risk_permits(r, **({"maximum_risk": 0.2, "minimum_coverage": 0.8, "minimum_samples": 20, "verified": True} | k)).alias("ok")).collect()]
    assert gate(rows) == [True, False, False] and gate(rows, verified=False) == [False] * 3
    with pytest.raises(Exception, match="between"):
        gate(rows.withColumn("empirical_risk", F.lit(1.5)))


def test_kinds_without_any(spark):
    row = spark.createDataFrame([("", [])], "p string, a array<string>").select(spans.kinds(F.col("p"), F.col("a")).alias("k")).select("k", spans.criticality(F.col("k")).alias("c")).first()
    assert row.k == ["phonetic-or-punctuation"] and row.c == 0.45
