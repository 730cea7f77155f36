"""Queries that fit models on the given tables, with the sizes of a full run and over all
steps. A fit for step n sees the steps before n only, of all entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.operators import clusters, frames, horizon, projection, sequential, spectral, split
from cohortlens.plans import evaluation, loading, production, scoring
from cohortlens.plans.registry import query
from cohortlens.plans.testbed import (
    ALPHA, POOL, SQL_CELLS, SQL_DENSE, SQL_NAMED, TESTS, axis, cells, dense, named_traces, table,
)
from cohortlens.session import durable

#: A full run.
FULL = production.Settings()

_COHORTS: dict[tuple, production.Cohort] = {}


def cohort_of(spark, sf_dir, parts=None) -> production.Cohort:
    """The cohort of the tables. Its own tables are written, so the queries of one application
    share it."""
    key = (spark.sparkContext.applicationId, sf_dir, tuple(parts or ()))
    if key not in _COHORTS:
        origin, n_steps = axis(spark, sf_dir)
        rows = cells(spark, sf_dir, origin)
        named = frames.normalise_marks(named_traces(spark, sf_dir))
        pool = loading.pool_vectors(named, POOL, F.col("entity"))
        _COHORTS[key] = production.prepare(
            production.normalise(rows), n_steps, ["k_sum"], TESTS, FULL, parts, durable(pool)
        )
    return _COHORTS[key]


def success_of(spark, sf_dir):
    return durable(loading.success_vectors(named_traces(spark, sf_dir), POOL, F.col("entity")))


def horizons(cohort: production.Cohort) -> list[int]:
    return list(range(1, cohort.n_steps + 1))


@query()
def kmeans_min_size(spark, sf_dir):
    """Clusters with a minimum size."""
    point = F.transform("embedding", lambda x: x.cast("double"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", point.alias("point"))
    out, _ = clusters.cluster_with_min_size(rows, "point", k=8, min_size=60)
    return out.select("vec_id", "cluster")


_PAIRS = [(i, j) for i in range(len(TESTS)) for j in range(i + 1)]


@query(
    f"WITH {SQL_DENSE} SELECT CAST(step_idx AS BIGINT) AS step_idx, count(*) AS n, "
    + ", ".join(f"CAST(sum({t}) AS DOUBLE) AS s{i}" for i, t in enumerate(TESTS))
    + ", "
    + ", ".join(f"CAST(sum({TESTS[i]} * {TESTS[j]}) AS DOUBLE) AS p{i}_{j}" for i, j in _PAIRS)
    + " FROM dense GROUP BY step_idx"
)
def step_moments(spark, sf_dir):
    """What the coordinates of every step are computed from, in one pass."""
    rows, _ = dense(spark, sf_dir, tuple(TESTS))
    marked = rows.select("step_idx", F.array(*TESTS).alias("tests"))
    out = projection.step_moments(marked, "tests", len(TESTS))
    sums = [F.get("s", F.lit(i)).alias(f"s{i}") for i in range(len(TESTS))]
    products = [F.get("p", F.lit(k)).alias(f"p{i}_{j}") for k, (i, j) in enumerate(_PAIRS)]
    return out.select("step_idx", "n", *sums, *products)


@query(
    """WITH n AS (SELECT CAST(sum(quality) AS DOUBLE) AS n1, CAST(sum(1 - quality) AS DOUBLE) AS n0 FROM labels),
    t AS (SELECT doc_id, CASE WHEN quality = 1 THEN (n1 + 1) / (n1 + 2) ELSE 1 / (n0 + 2) END AS t FROM labels, n)
    SELECT doc_id, CAST(1 AS BIGINT) AS side, round(t, 6) AS side_weight FROM t
    UNION ALL SELECT doc_id, CAST(0 AS BIGINT), round(1 - t, 6) FROM t"""
)
def calibration_targets(spark, sf_dir):
    """Smoothed targets of a sigmoid calibration as weighted rows."""
    rows = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("y"))
    return horizon.smoothed_targets(rows).drop("y")


_CELLS = ["cents", "k_sum", *TESTS]


@query(
    f"""WITH {SQL_DENSE}, c AS (SELECT entity, step_idx, unnest([{', '.join(f"CAST({c} AS DOUBLE)" for c in _CELLS)}]) AS value,
      unnest(range(0, {len(_CELLS)})) AS cell FROM dense)
    SELECT entity, n.i AS n, CAST(step_idx * {len(_CELLS)} + cell AS BIGINT) AS position, value
    FROM c JOIN (SELECT unnest(range(1, (SELECT n + 1 FROM n_steps))) AS i) n ON n.i > step_idx WHERE value <> 0"""
)
def feature_matrix(spark, sf_dir):
    """What the classifier of each horizon sees of an entity: place and value of its cells."""
    rows, n_steps = dense(spark, sf_dir, tuple(_CELLS))
    numbers = rows.select("entity", "step_idx", *[F.col(c).cast("double").alias(c) for c in _CELLS])
    people = durable(horizon.profiles(numbers, ["entity"], _CELLS))
    return horizon.feature_matrix(people, "entity", list(range(1, n_steps + 1)), len(_CELLS))


_ASSEMBLED = f"""WITH {SQL_NAMED}, sel AS (SELECT *, unit || '_' || step || '_' || metric AS name FROM named),
    kept AS (SELECT entity || '|' || grp AS entity, unit, step, metric, step_idx, {{value}} AS value FROM sel WHERE {{cond}}),
    cols AS (SELECT unit, step, metric, row_number() OVER (ORDER BY min(step_idx), unit, step, metric) - 1 AS position
      FROM kept GROUP BY unit, step, metric)
    SELECT e.entity, c.position, coalesce(k.value, 0e0) AS value FROM (SELECT DISTINCT entity FROM kept) e
    CROSS JOIN cols c LEFT JOIN kept k ON k.entity = e.entity AND k.unit = c.unit AND k.step = c.step AND k.metric = c.metric"""


@query(_ASSEMBLED.format(
    value="value", cond=rf"name LIKE '{POOL}%' AND NOT regexp_matches(name, '^{POOL}_cpoolday\d+_\d{{2}} - task\d+_passed')"
))
def pool_features(spark, sf_dir):
    """What entities are clustered by, place by place."""
    out = loading.pool_vectors(named_traces(spark, sf_dir), POOL)
    return out.select("entity", F.posexplode("pool").alias("position", "value"))


@query(_ASSEMBLED.format(
    value="CASE WHEN coalesce(value, 0) <> 0 THEN 1e0 ELSE 0e0 END",
    cond=rf"regexp_matches(name, '^{POOL}_cpoolday\d+_\d+\s+-\s+Success of task\d+_passed$', 'i')",
))
def success_features(spark, sf_dir):
    """What the map of the entities is drawn from, place by place."""
    out = loading.success_vectors(named_traces(spark, sf_dir), POOL)
    return out.select("entity", F.posexplode("bits").alias("position", "value"))


@query()
def pca_step_embedding(spark, sf_dir):
    """Three coordinates of the test results at each step."""
    rows, _ = dense(spark, sf_dir, tuple(TESTS))
    marked = durable(rows.select("entity", "step_idx", F.array(*TESTS).alias("tests")))
    return projection.step_embedding(marked, "tests", len(TESTS)).drop("tests")


_NEAR = 6
_SQL_PATTERN = " || ".join(f"CASE WHEN {t} > 0 THEN '1' ELSE '0' END" for t in TESTS)


def marked_steps(spark, sf_dir):
    """Test results of every entity and step as bits."""
    rows, _ = dense(spark, sf_dir, tuple(TESTS))
    bits = F.array(*[frames.to_bit(F.col(t).cast("double")) for t in TESTS])
    return durable(rows.select("entity", "step_idx", bits.alias("bits")))


@query(
    f"""WITH {SQL_DENSE}, p AS (SELECT DISTINCT step_idx, {_SQL_PATTERN} AS node FROM dense),
    r AS (SELECT a.step_idx, a.node AS one, o.node AS two,
      row_number() OVER (PARTITION BY a.step_idx, a.node ORDER BY hamming(a.node, o.node), o.node) AS rank
      FROM p a JOIN p o ON o.step_idx = a.step_idx AND o.node <> a.node),
    b AS (SELECT step_idx, one AS src, two AS dst FROM r WHERE rank <= {_NEAR}
      UNION ALL SELECT step_idx, two, one FROM r WHERE rank <= {_NEAR})
    SELECT CAST(step_idx AS BIGINT) AS step_idx, src, dst, count(*) / 2e0 AS weight FROM b GROUP BY 1, 2, 3"""
)
def neighbour_links(spark, sf_dir):
    """Links of the patterns of test results of each step, which its layout is made from."""
    links = spectral.neighbour_graph(marked_steps(spark, sf_dir), "bits", len(TESTS), _NEAR, "step_idx")
    return links.withColumnRenamed("group", "step_idx")


@query()
def spectral_steps(spark, sf_dir):
    """Three coordinates of the test results at each step, by the graph of its patterns."""
    marked = marked_steps(spark, sf_dir)
    return spectral.spectral_layout(marked, "bits", len(TESTS), 3, _NEAR, "step_idx").drop("bits")


@query()
def spectral_map(spark, sf_dir):
    """Two coordinates and the cluster of each entity by its success results."""
    return spectral.lay_out_and_cluster(success_of(spark, sf_dir), "bits").drop("bits")


@query()
def horizon_classifier(spark, sf_dir):
    """Boosted classifiers after the first n steps, every n: conformal coverage and width."""
    cohort = cohort_of(spark, sf_dir)
    fits = production.fit_conformal(cohort.people, horizons(cohort), cohort.width, FULL)
    return production.evaluate_conformal(cohort.people, fits, cohort.width, FULL.cp_alpha)


@query()
def platt_calibrated(spark, sf_dir):
    """Calibrated probability of each labelled document."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    size = F.length("text").cast("double")
    rows = docs.join(labels, "doc_id").select(
        "doc_id",
        F.col("quality").cast("int").alias("y"),
        F.array(
            F.log1p(size),
            F.regexp_count("text", F.lit(r"\s")) / (size + 1),
            F.regexp_count("text", F.lit(r"[.,;:!?]")) / (size + 1),
            F.regexp_count("text", F.lit(r"[0-9]")) / (size + 1),
        ).alias("profile"),
    )
    dealt = durable(split.stratified_split(rows, "doc_id", "y"))
    feats = horizon.first_steps(dealt, 1, 4)
    base = horizon.boosted()
    model = horizon.fit_calibrated(
        base,
        feats.where(F.col("split") == "train").select("features", "y"),
        feats.where(F.col("split") == "cal").select("features", "y"),
    )
    return horizon.probabilities(model, feats).select("doc_id", "y", "split", "p1")


@query(
    f"""WITH {SQL_CELLS},
    v AS (SELECT step_idx, CAST(cents AS DOUBLE) AS v, sum(k_sum) AS w FROM cells WHERE k_sum > 0 GROUP BY 1, 2),
    c AS (SELECT step_idx, v, sum(w) OVER (PARTITION BY step_idx ORDER BY v) AS upto,
      sum(w) OVER (PARTITION BY step_idx) AS total FROM v),
    r AS (SELECT step_idx, j,
        least(total, greatest(1, floor(round(j * 0.001e0 * total, 6)))) AS low,
        least(total, greatest(1, ceil(round((0.9e0 + j * 0.001e0) * total, 6)))) AS high
      FROM (SELECT DISTINCT step_idx, total FROM c), (SELECT unnest(range(0, 101)) AS j)),
    p AS (SELECT r.step_idx, r.j, min(v) FILTER (WHERE upto >= low) AS lo, min(v) FILTER (WHERE upto >= high) AS hi
      FROM r JOIN c ON c.step_idx = r.step_idx GROUP BY 1, 2)
    SELECT CAST(step_idx AS BIGINT) AS step_idx, lo, hi FROM p
    QUALIFY row_number() OVER (PARTITION BY step_idx ORDER BY hi - lo, j) = 1"""
)
def weighted_residual_quantile(spark, sf_dir):
    """Narrowest range of the marks of each step, weighted by another of its cells."""
    origin, _ = axis(spark, sf_dir)
    rows = cells(spark, sf_dir, origin).select("step_idx", F.col("cents").cast("double").alias("v"), "k_sum")
    return sequential.weighted_interval(durable(rows), "v", "k_sum", ["step_idx"], 2, ALPHA)


@query()
def sequential_interval_one(spark, sf_dir):
    """Upper bound of the next mark at each step."""
    cohort = cohort_of(spark, sf_dir)
    return production.next_mark_bounds(cohort, FULL)


@query()
def sequential_interval_two(spark, sf_dir):
    """Interval of the last mark after the first steps."""
    cohort = cohort_of(spark, sf_dir)
    rows = production.last_mark_rows(cohort, FULL)
    models = production.fit_last_mark(cohort, rows, FULL)
    parts = [
        m.transform(rows.where(F.col("step_idx") == n)).select(
            "entity", F.lit(n).alias("n"), "lo", "hi"
        )
        for n, m in models.items()
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


@query()
def gate_train(spark, sf_dir):
    """Set metrics of conformal, interval, united and gated sets per horizon."""
    cohort = cohort_of(spark, sf_dir)
    rows = production.last_mark_rows(cohort, FULL)
    intervals = production.fit_last_mark(cohort, rows, FULL)
    fits = production.fit_conformal(cohort.people, horizons(cohort), cohort.width, FULL)
    gates = production.fit_gates(cohort, rows, fits, intervals, FULL)
    return production.replay(cohort, rows, fits, intervals, gates, FULL.cp_alpha)


@query()
def next_mark_classifier(spark, sf_dir):
    """Conformal coverage and width with the bound for the next mark as a feature."""
    cohort = cohort_of(spark, sf_dir)
    extended = production.with_next_marks(cohort, production.next_mark_bounds(cohort, FULL))
    fits = production.fit_conformal(extended.people, horizons(extended), extended.width, FULL)
    return production.evaluate_conformal(extended.people, fits, extended.width, FULL.cp_alpha)


@query()
def score_and_project(spark, sf_dir):
    """Predictions per horizon, coordinates and clusters of every entity."""
    cohort = cohort_of(spark, sf_dir)
    fits = production.fit_conformal(cohort.people, horizons(cohort), cohort.width, FULL)
    out = scoring.score_and_project(cohort, fits, cohort.n_steps, 0.1, success=success_of(spark, sf_dir))
    return out.drop("source")


@query()
def evaluator(spark, sf_dir):
    """Base models side by side: coverage and width of four kinds of sets."""
    cohort = cohort_of(spark, sf_dir, split.FOUR_WAY)
    rows = production.last_mark_rows(cohort, FULL)
    intervals = production.fit_last_mark(cohort, rows, FULL)
    return evaluation.evaluate(cohort, rows, intervals, horizon.default_models(), FULL, alpha=0.1)
