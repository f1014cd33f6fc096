"""Splits by shares, pools, role assembly, significance and resampling against plain versions."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scrivena.operators import assembly as ab
from scrivena.operators import evaluation as ev
from scrivena.operators import splits as sp
from scrivena.operators.ranking import numbered

# splits


def peeled(chars, shares):
    """Roles of one author's speeches by taking them from the end, one by one."""
    roles = [r for r in shares if shares[r] > 0]
    left, out = list(range(len(chars))), {}
    for earlier in range(len(roles) - 1, 0, -1):
        taken = 0
        while len(left) > earlier and (not any(out.get(i) == roles[earlier] for i in out) or taken < shares[roles[earlier]] * sum(chars)):
            i = left.pop()
            out[i] = roles[earlier]
            taken += chars[i]
    return [out.get(i, roles[0]) for i in range(len(chars))]


@pytest.mark.parametrize("shares", [{"train": 0.7, "val": 0.1, "test": 0.2}, {"train": 0.5, "a": 0.0, "val": 0.2, "dev": 0.2, "test": 0.1}, {"train": 1.0}, {"train": 0.1, "val": 0.4, "test": 0.5}])
def test_shares_of_several_roles(spark, shares):
    rng = random.Random(len(shares))
    authors = {a: [rng.choice([1, 10, 70, 100]) for _ in range(n)] for a, n in enumerate([1, 2, 3, 4, 5, 9, 30, 30])}
    rows = [(100 * a + i, a, 2001, "p", f"2001-01-{i + 1:02d}", "10:00", c) for a, chars in authors.items() for i, c in enumerate(chars)]
    rng.shuffle(rows)
    found = sp.char_shares(spark.createDataFrame(rows, "id_speech long, id_person long, election int, party string, date string, time string, char_count long"), shares)
    got = {r.id_speech: r.outer_role for r in found.collect()}
    assert got == {100 * a + i: role for a, chars in authors.items() for i, role in enumerate(peeled(chars, shares))}


def test_test_rows_reach_their_share(spark):
    rows = [(i, 101, 2001, "A", f"2001-01-{i:02d}", "10:00", c) for i, c in enumerate([100, 100, 100, 100, 70, 70], 1)]
    found = sp.char_shares(spark.createDataFrame(rows, "id_speech long, id_person long, election int, party string, date string, time string, char_count long"), {"train": 0.8, "test": 0.2})
    assert sorted(r.id_speech for r in found.collect() if r.outer_role == "test") == [5, 6]
    with pytest.raises(ValueError, match="no role"):
        sp.char_shares(found, {"train": 0})


# pools


def test_pool_is_taken_to_a_fixed_point(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice("ABCDEFGH"), rng.choice(["x", "y", "z", None])) for i in range(34)]
    least = {"party": 4, "language": 7}
    kept = list(rows)
    rounds = 0
    while True:
        some = [r for r in kept if all(sum(q[k] == r[k] for q in kept) >= n for k, n in ((1, 4), (2, 7)))]
        rounds += 1
        if some == kept:
            break
        kept = some
    pool = spark.createDataFrame(rows, "id_person long, party string, language string")
    assert rounds > 2 and sorted(r.id_person for r in sp.filtered_pool(pool, least).collect()) == [r[0] for r in kept]
    assert sp.filtered_pool(pool, {}).count() == 34 and sp.filtered_pool(pool, {"party": 99}).count() == 0
    assert {r.party for r in sp.filtered_pool(pool, {}, {"party": ["A", "B"]}).collect()} == {"A", "B"}
    out = spark.createDataFrame([("1.0",), (" 2 ",), (None,)], "id_person string")
    assert {r.id_person for r in sp.without_authors(pool, out).collect()} == set(range(34)) - {1, 2}


def test_units(spark):
    outer = spark.createDataFrame([(1, 7, "train"), (2, 7, "test"), (3, 7, "out")], "id_speech long, id_person long, outer_role string")
    folds = spark.createDataFrame([(1, 7, 0, "train"), (1, 7, 1, "val")], "id_speech long, id_person long, fold_id int, fold_role string")
    assert sorted(map(tuple, sp.units(outer, folds, "final").collect())) == [("final", "test", 1, 7, "train"), ("final", "test", 2, 7, "test")]
    assert sorted(map(tuple, sp.units(outer, folds, "all").collect())) == [("0", "val", 1, 7, "train"), ("1", "val", 1, 7, "val")]
    with pytest.raises(ValueError, match="all or final"):
        sp.units(outer, folds, "some")


def test_numbers_within_groups(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(20), i) for i in range(300)]
    found = numbered(spark.createDataFrame(rows, "g string, x int, i int").repartition(7), ["g"], [F.desc("x"), F.col("i")])
    own = {}
    for r in found.collect():
        own.setdefault(r.g, []).append((r.number, r.x, r.i))
    for g, got in own.items():
        expected = sorted(((x, i) for h, x, i in rows if h == g), key=lambda r: (-r[0], r[1]))
        assert sorted(got) == [(k, *r) for k, r in enumerate(expected)]


# role assembly


def test_assembly_checks_every_source(spark):
    members = spark.createDataFrame([(1, "f0", "train"), (1, "f1", "val"), (2, "f0", "val")], "id_speech long, unit string, role string")
    texts = spark.createDataFrame([(1, "one"), (2, None), (3, "none")], "id_speech long, text string")
    labels = spark.createDataFrame([(1, "A"), (2, "B")], "id_speech long, author string")
    found = ab.assembled(members, {"texts": texts, "labels": labels})
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, [(1, "f0", "train", "one", "A"), (1, "f1", "val", "one", "A"), (2, "f0", "val", None, "B")]))
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    for bad, why in ((labels.filter("id_speech = 1"), "labels: not one row for 2"), (labels.unionByName(labels.filter("id_speech = 1")), "labels: not one row for 1")):
        with pytest.raises(Exception, match=why):
            ab.assembled(members, {"texts": texts, "labels": bad}).collect()
    with pytest.raises(ValueError, match="several sources"):
        ab.assembled(members, {"texts": texts, "more": texts})
    with pytest.raises(ValueError, match="age"):
        ab.targets(labels, ["age"], author=False)
    assert ab.complete(ab.targets(texts, ["text"], author=False), ["text"]).count() == 2
    outer = spark.createDataFrame([(1, "train")], "id_speech long, outer_role string")
    assert ab.row_data(texts, outer, "s", ["text", "gone"]).collect() == [(1, "s", "train", "one")]


# significance


def test_tail_probabilities(spark):
    values = [0.0, 1e-9, 0.5, 1.0, 3.841458820694124, 6.634896601021213, 10.827566170662733, 17.9, 18.1, 40.0, 300.0]
    found = [r.p for r in spark.createDataFrame([(v,) for v in values], "x double").select(ev.chi2_tail(F.col("x")).alias("p")).collect()]
    for x, p in zip(values, found):
        assert abs(p - math.erfc(math.sqrt(x / 2))) < 1e-12 and p == pytest.approx(math.erfc(math.sqrt(x / 2)), rel=1e-7)
    assert found[0] == 1 and [round(p, 10) for p in found[4:7]] == [0.05, 0.01, 0.001]


def predictions(spark, extra=()):
    rng = random.Random(2)
    rows = [(s, i, rng.randrange(4)) for s in ("a", "b") for i in range(200)]
    return spark.createDataFrame([(s, i, i % 4, i % 4 if g else 0) for s, i, g in rows] + list(extra), "system string, id_speech long, y_true int, y_pred int")


def test_pairs_of_systems(spark):
    rows = predictions(spark)
    frame = {s: g.set_index("id_speech") for s, g in rows.toPandas().groupby("system")}
    right = {s: (g.y_true == g.y_pred) for s, g in frame.items()}
    b, c = int((right["a"] & ~right["b"]).sum()), int((~right["a"] & right["b"]).sum())
    found = {(r.source, r.target): r for r in ev.compared(rows, [("a", "b"), ("a", "a")]).collect()}
    r = found["a", "b"]
    assert (r.n, r.only_a, r.only_b) == (200, b, c) and r.chi2 == pytest.approx((b - c) ** 2 / (b + c)) and r.p == pytest.approx(math.erfc(math.sqrt(r.chi2 / 2)), abs=1e-12)
    same = found["a", "a"]
    assert (same.chi2, same.p, same.chi2_corrected, same.p_corrected) == (0, 1, 0, 1) and same.macro_f1_gain == 0
    for extra, why in (([("a", 900, 1, 1)], "each key once"), ([("a", 5, 1, 1)], "key twice"), ([("a", 901, 1, 1), ("b", 901, 2, 1)], "labels differ")):
        with pytest.raises(Exception, match=why):
            ev.compared(predictions(spark, extra), [("a", "b")]).collect()


def test_resampled_cells_are_a_bootstrap(spark):
    rows = predictions(spark).filter("system = 'a'")
    draws = ev.bootstrap_draws(rows, 3000, 1).toPandas()
    assert (draws.n == 200).all() and len(draws) == 3000 and draws.f1.nunique() > 500
    frame = rows.toPandas()
    rng = np.random.default_rng(9)

    def f1(own):
        t, p = own.y_true.to_numpy(), own.y_pred.to_numpy()
        return np.mean([2 * ((t == k) & (p == k)).sum() / ((t == k).sum() + (p == k).sum()) for k in set(t) | set(p)])

    plain = np.array([f1(frame.iloc[rng.integers(0, 200, 200)]) for _ in range(1500)])
    assert draws.f1.mean() == pytest.approx(plain.mean(), abs=0.005) and draws.f1.std() == pytest.approx(plain.std(), rel=0.1)
    interval = ev.bootstrap_interval(rows, 3000, 1).first()
    assert interval.low == pytest.approx(np.quantile(plain, 0.025), abs=0.012) and interval.high == pytest.approx(np.quantile(plain, 0.975), abs=0.012)
    assert sorted(ev.bootstrap_draws(rows.repartition(5), 50, 1).collect()) == sorted(ev.bootstrap_draws(rows, 50, 1).collect())
    assert ev.bootstrap_draws(rows.filter("false"), 5, 1).count() == 0
