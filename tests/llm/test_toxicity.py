"""The non-negative risk and its training against a plain version, one example at a time."""

import math
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from atlas.llm import toxicity


def plain_risk(w, bias, rows, positive, mass, prior):
    """prior * E_P[log(1 + exp(-g))] + max(0, E_U[log(1 + exp(g))] - prior * E_P[log(1 + exp(g))]), whether the bracket is negative, and the bracket's and the first term's slopes."""
    first = bracket = 0.0
    d_first, d_bracket = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for row, is_positive, share in zip(rows, positive, mass):
        g = bias + sum(w[i] for i in row)
        p = 1 / (1 + math.exp(-g))
        at = [*row, len(w)]
        if is_positive:
            first += prior * share * math.log1p(math.exp(-g))
            bracket -= prior * share * math.log1p(math.exp(g))
            for i in at:
                d_first[i] += prior * share * (p - 1)
                d_bracket[i] -= prior * share * p
        else:
            bracket += share * math.log1p(math.exp(g))
            for i in at:
                d_bracket[i] += share * p
    return first + max(0.0, bracket), bracket, d_first, d_bracket


@pytest.mark.parametrize("prior", [0.2, 0.45])
def test_training_follows_the_risk(monkeypatch, prior):
    """Each step goes down the risk's slope, or back up the bracket's where that is negative (the correction), as the plain version does."""
    monkeypatch.setattr(toxicity, "STEPS", 40)
    monkeypatch.setattr(toxicity, "MEMBERS", 2)
    r = np.random.default_rng(1)
    positive = np.arange(60) < 15
    rows = [np.flatnonzero(r.random(6) < (0.6 if k < 15 else 0.25) * np.array([1, 1, 1, 0.5, 0.5, 0.5])) for k in range(60)]
    model = toxicity.fit(rows, positive, prior, np.arange(6))
    random, corrected = np.random.default_rng(7), 0
    for member in range(2):
        mass = random.poisson(1.0, 60).astype(float)
        mass[positive] /= mass[positive].sum()
        mass[~positive] /= mass[~positive].sum()
        x, m, v = np.append(np.zeros(6), math.log(prior / (1 - prior))), np.zeros(7), np.zeros(7)
        for step in range(1, 41):
            _, bracket, d_first, d_bracket = plain_risk(x[:6], x[6], rows, positive, mass, prior)
            slope = d_first + d_bracket if bracket >= 0 else -d_bracket
            corrected += bracket < 0
            slope = slope + toxicity.PENALTY * np.append(x[:6], 0)
            m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
            x = x - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-10)
        assert np.allclose(model.weights[member], x[:6], atol=1e-6) and abs(model.bias[member] - x[6]) < 1e-6
    assert corrected or prior == 0.2


def test_scores_are_the_mean_of_the_members():
    model = toxicity.Model(np.array([3, 8]), np.array([[1.0, -2.0], [0.5, 4.0]]), np.array([0.1, -0.3]))
    row, feature = np.array([0, 0, 1, 2]), np.array([3, 8, 5, 8])
    sigmoid = lambda g: 1 / (1 + math.exp(-g))
    want = [(sigmoid(0.1 - 1.0) + sigmoid(-0.3 + 4.5)) / 2, (sigmoid(0.1) + sigmoid(-0.3)) / 2, (sigmoid(0.1 - 2.0) + sigmoid(-0.3 + 4.0)) / 2]
    assert np.allclose(model.scores(row, feature, 3), want)


def test_nothing_to_learn_from(spark, odd, empty):
    labels = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    for some in (labels, labels.where("false")):
        got = toxicity.report(odd, some).collect()
        assert len(got) == odd.count() and {r.predicted for r in got} == {0} and len({r.score for r in got}) == 1
    assert toxicity.report(empty, labels).count() == 0
    assert toxicity.keep_clean(odd, labels).columns == odd.columns and toxicity.keep_clean(odd, labels).count() == odd.count()


def test_counting_takes_no_second_table():
    """One table of counts stands in a task; a batch adds to it in place, and what it yields is what each text has."""
    table, tracked = 2 * 4 << toxicity.BITS, []
    lists = [[3, 8], [8], [], [8, (1 << toxicity.BITS) - 1]]
    batch = pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.int32())), pa.array([1, 0, 0, 1], pa.int32())], names=["features", "toxic"])
    tracemalloc.start()
    found = toxicity._counts(iter([batch, batch]))
    first = next(found)
    tracked.append(tracemalloc.get_traced_memory()[1])
    tracemalloc.stop()
    assert first.to_pydict() == {"feature": [3, 8, (1 << toxicity.BITS) - 1], "pos": [2, 4, 2], "un": [0, 2, 0]}
    assert tracked[0] < 1.5 * table  # 2.5 with a table of 64-bit counts a batch
