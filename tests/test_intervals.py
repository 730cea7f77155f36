"""Quantiles of weighted residuals, the residual log, and how often intervals hold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import ranks, sequential, windows


def plain_order(rows, rank):
    total = 0
    for v, w in sorted(rows):
        total += max(w, 0)
        if w > 0 and total >= rank:
            return v
    return None


def test_weighted_order(spark):
    rng = np.random.default_rng(1)
    rows = [(int(rng.integers(3)) or None, float(rng.integers(40)) / 4, int(rng.integers(-1, 6))) for _ in range(900)]
    rows += [(1, None, 5), (9, 1.0, 0)]
    df = spark.createDataFrame(rows, "g int, v double, w long")
    wanted = [(g, f"r{k}", k) for g in (None, 1, 2, 9) for k in (1, 2, 3, 50, 400, 10**6)]
    asked = spark.createDataFrame(wanted, "g int, name string, rank long")
    for buckets in (1, 16):
        got = {(r.g, r.name): r.v for r in ranks.weighted_order(df, "v", "w", asked, ["g"], buckets).collect()}
        want = {(g, name): plain_order([(v, w) for h, v, w in rows if h == g and v is not None], k) for g, name, k in wanted}
        assert got == {k: v for k, v in want.items() if v is not None} and len(got) > 10


def plain_interval(rows, alpha, own):
    total = sum(w for _, w in rows)
    ends = []
    for j in range(101):
        beta = j * (alpha / 100)
        low = min(total, max(1, int(np.floor(round(beta * (total + own), 6)))))
        high = min(total, max(1, int(np.ceil(round((1 - alpha + beta) * (total + own), 6)))))
        a, b = plain_order(rows, low), plain_order(rows, high)
        ends.append((b - a, j, a, b))
    return min(ends)[2:]


@pytest.mark.parametrize("own", [0, 40])
def test_weighted_interval(spark, own):
    rng = np.random.default_rng(3)
    rows = [(int(g), float(np.round(rng.gamma(2, 3), 2)), int(rng.integers(1, 50))) for g in (1, 2) for _ in range(150)]
    df = spark.createDataFrame(rows, "g int, v double, w long")
    got = {r.g: (r.lo, r.hi) for r in sequential.weighted_interval(df, "v", "w", ["g"], 2, 0.1, own).collect()}
    assert got == {g: plain_interval([r[1:] for r in rows if r[0] == g], 0.1, own) for g in (1, 2)}
    one = sequential.weighted_interval(df.where("g = 1"), "v", "w", ["g"], 1, 0.2, own).first()
    mine = [r[1:] for r in rows if r[0] == 1]
    total = sum(w for _, w in mine)
    assert one.lo == 0 and one.hi == plain_order(mine, min(total, np.ceil(round(0.8 * (total + own), 6))))


def test_window_moments(spark):
    v = np.random.default_rng(5).normal(size=47).tolist()
    df = spark.createDataFrame(list(enumerate(v)), "idx long, r double").repartition(3)
    for block in (6, 100):
        rows = {r.idx: r for r in windows.window_moments(df, "r", 6, block=block).collect()}
        assert len(rows) == 47 and rows[0].before_mean is None
        for i in range(1, 47):
            past = v[max(0, i - 6) : i]
            assert rows[i].before_mean == pytest.approx(np.mean(past))
            assert rows[i].before_sd == pytest.approx(np.std(past), abs=1e-9)


def sequence(spark, seed, n=150, steps=9, loud=None):
    """Rows whose target is a feature and noise, louder from step ``loud`` on."""
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(steps):
        scale = 1.0 if loud is None or s < loud else 3.0
        rows += [(f"e{i}", s, [float(x)], float(2 * x + scale * rng.normal())) for i, x in enumerate(rng.random(n))]
    return spark.createDataFrame(rows, "entity string, step_idx int, lags array<double>, target double").cache()


def fitted(df, sides, steps, **sizes):
    est = sequential.StepInterval(sides, 0.1, w=100, trees=4, depth=3, **sizes)
    return sequential.fit_sequence(
        est, lambda t: df.where(F.col("step_idx") < t), lambda t: df.where(F.col("step_idx") == t), steps,
        lambda fn, items: {i: fn(i) for i in items})


def test_log_is_that_of_a_plain_loop(spark):
    df = sequence(spark, 8, 40, 5)
    models, done = fitted(df, 2, [2, 3, 4])
    est = sequential.StepInterval(2, 0.1, trees=4, depth=3)
    start = est.residuals(sequential.with_vector(df.where("step_idx < 2")))
    parts = []
    for t in (2, 3, 4):
        point = est.fit_point(sequential.with_vector(df.where(F.col("step_idx") < t)))
        parts += [(r.entity, t, r.target - r.forecast) for r in point.transform(sequential.with_vector(df.where(F.col("step_idx") == t))).collect()]
    want = {(e, t): r for e, t, r in parts} | {(r.entity, r.step_idx): r.residual for r in start.collect()}
    assert len(want) == 200
    scored = done.select("entity", F.col("at").alias("step_idx"), "target", ((F.col("lo") + F.col("hi")) / 2).alias("mid"), "at")
    middle = {t: sum(models[t].offsets) / 2 for t in models}
    log = {(r.entity, r.step_idx): r.target - (r.mid - middle[r["at"]]) for r in scored.collect()}
    assert {k: pytest.approx(v) for k, v in want.items() if k[1] > 1} == log
    order = [(r.step_idx, r.idx) for r in windows.sequence_index(sequential.residual_log(
        df.where("step_idx > 1").select("entity", "step_idx", "target", F.lit(0.0).alias("forecast")), start), "entity").orderBy("idx").collect()]
    assert [s for s, _ in order] == sorted(s for s, _ in order) and [i for _, i in order] == list(range(200))


@pytest.mark.parametrize("sides", [1, 2])
def test_intervals_hold_as_often_as_they_say(spark, sides):
    """Mean over several seeds, on steps no forest has seen."""
    share = []
    for seed in range(4):
        _, done = fitted(sequence(spark, seed, 250, 7), sides, [3, 4, 6])
        hit = F.col("target") <= F.col("hi") if sides == 1 else F.col("target").between(F.col("lo"), F.col("hi"))
        share.append(done.where("at > 3").agg(F.avg(hit.cast("int"))).first()[0])
    assert abs(np.mean(share) - 0.9) <= 0.03, share


def test_louder_residuals_widen_the_interval(spark):
    models, done = fitted(sequence(spark, 2, 200, 9, loud=5), 2, [4, 5, 6, 7, 8])
    width = {t: m.offsets[1] - m.offsets[0] for t, m in models.items()}
    assert width[8] > 2 * width[4] and width[7] > 1.6 * width[4]
    late = done.where("at >= 7").agg(F.avg(F.col("target").between(F.col("lo"), F.col("hi")).cast("int"))).first()[0]
    assert abs(late - 0.9) < 0.05


def test_too_few_residuals(spark):
    df = sequence(spark, 1, 1, 2)
    with pytest.raises(ValueError, match="no residuals"):
        fitted(df, 2, [1], in_sample=True)
    with pytest.raises(ValueError, match="no rows"):
        sequential.StepInterval(2, 0.1, trees=2, depth=2, in_sample=True).fit(df.where("step_idx < 0").unionByName(df.where("step_idx = 9")))
