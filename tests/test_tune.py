"""Successive halving against the full search."""

import random

from tessera.operators import model as M


def rows(spark):
    """A label that only deep trees can tell: the parity of three bits."""
    rnd, out = random.Random(3), []
    for i in range(400):
        bits = [rnd.randrange(2) for _ in range(3)]
        out.append((i, 1.0 + i % 2, sum(bits) % 2, *[b + rnd.random() * 0.5 for b in bits]))
    return spark.createDataFrame(out, "point_id long, weight double, label int, a double, b double, c double")


def test_winner_equals_the_full_search_and_losers_leave(spark):
    df, features = rows(spark), ["a", "b", "c"]
    given = dict(settings=4, folds=2, seed=5, keep=2, trees=(4, 9), depth=(1, 7))
    model, scores = M.tune(df, features, rungs=2, **given)
    full_model, full = M.tune(df, features, rungs=1, **given)
    by = lambda t: [tuple(r) for r in t.collect()]
    halved, whole = by(scores), by(full)
    assert [sum(r[0] == k for r in halved) for k in (0, 1)] == [4, 2]
    assert [sum(r[0] == k and r[5] for r in halved) for k in (0, 1)] == [2, 1]
    went_on = {r[1] for r in halved if r[0] == 0 and r[5]}
    assert went_on == {r[1] for r in halved if r[0] == 1}
    # the last rung scores as the full search does, trees and all
    assert all(r[2:5] in [w[2:5] for w in whole if w[1] == r[1]] for r in halved if r[0] == 1)
    winner = lambda t: next(r[1] for r in t if r[5] and r[0] == max(x[0] for x in t))
    assert winner(halved) == winner(whole)
    assert model.bestModel.getNumTrees == full_model.bestModel.getNumTrees
