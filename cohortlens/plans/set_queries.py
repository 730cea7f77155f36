"""Queries over steps, labels, splits and prediction sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortlens.functions import sets
from cohortlens.operators import (
    clusters,
    conformal,
    frames,
    gate,
    metrics,
    neighbours,
    ranks,
    sequential,
    split,
    threshold,
    windows,
)
from cohortlens.plans.registry import query
from cohortlens.plans.testbed import (
    ALPHA,
    DOC_THRESHOLD,
    SQL_CELLS,
    SQL_DENSE,
    SQL_DOCS,
    TESTS,
    axis,
    cells,
    dense,
    scored_documents,
    table,
)
from cohortlens.session import durable

# ---- steps ---------------------------------------------------------------------------

SQL_LAST = f"""{SQL_CELLS}, last AS (SELECT entity, grp,
   coalesce(max_by(mark, step_idx) FILTER (WHERE mark > 0), 0e0) AS last_mark FROM cells GROUP BY entity, grp)"""


def last_marks(spark, sf_dir):
    origin, _ = axis(spark, sf_dir)
    return windows.last_positive(cells(spark, sf_dir, origin), ["entity", "grp"])


def kept_last_marks(spark, sf_dir):
    """The same, written once: a threshold reads the last marks several times."""
    return durable(last_marks(spark, sf_dir))


@query(f"WITH {SQL_LAST} SELECT entity, grp, round(last_mark, 6) AS last_mark FROM last")
def last_positive_mark(spark, sf_dir):
    """Latest positive mark."""
    return last_marks(spark, sf_dir)


@query(
    f"""WITH {SQL_CELLS}, r AS (SELECT entity, mark, row_number() OVER (PARTITION BY entity ORDER BY step_idx DESC) AS i
      FROM cells WHERE mark > 0)
    SELECT u.entity, round(max(mark) FILTER (WHERE i = 1), 6) AS m1, round(max(mark) FILTER (WHERE i = 2), 6) AS m2,
      round(max(mark) FILTER (WHERE i = 3), 6) AS m3
    FROM (SELECT DISTINCT entity FROM cells) u LEFT JOIN r ON r.entity = u.entity GROUP BY u.entity"""
)
def last_n_positive(spark, sf_dir):
    """The three latest positive marks."""
    origin, _ = axis(spark, sf_dir)
    out = windows.last_n_positive(cells(spark, sf_dir, origin), ["entity"], 3)
    return out.select("entity", *[F.get("last_marks", F.lit(i)).alias(f"m{i + 1}") for i in range(3)])


_CELL_SUM = " + ".join(f"{t} * {i + 1}" for i, t in enumerate(TESTS))


@query(
    f"""WITH {SQL_DENSE}, f AS (SELECT entity, step_idx, CAST(cents AS BIGINT) AS a, CAST({_CELL_SUM} AS BIGINT) AS b FROM dense),
    l AS (SELECT entity, step_idx, """
    + ", ".join(
        f"lag({c}, {j}) OVER w AS l{2 * j - 2 + i}" for j in range(1, 5) for i, c in enumerate("ab")
    )
    + """ FROM f WINDOW w AS (PARTITION BY entity ORDER BY step_idx))
    SELECT entity, CAST(step_idx AS BIGINT) AS step_idx, """
    + ", ".join(f"l{i}" for i in range(8))
    + " FROM l WHERE step_idx >= 4"
)
def step_lag_windows(spark, sf_dir):
    """Features of the four steps before each step, newest first."""
    rows, _ = dense(spark, sf_dir, ("cents", *TESTS))
    tests = sum((F.col(t) * (i + 1) for i, t in enumerate(TESTS)), F.lit(0))
    feats = rows.select("entity", "step_idx", F.array("cents", tests.cast("long")).alias("f"))
    out = windows.lag_windows(feats, "f", 4, ["entity"])
    return out.select(
        "entity", "step_idx", *[F.get("lags", F.lit(i)).alias(f"l{i}") for i in range(8)]
    )


@query(
    f"""WITH {SQL_DENSE} SELECT entity, CAST(step_idx AS BIGINT) AS step_idx,
      round(coalesce(lead(mark, 3) OVER w, last_value(mark) OVER (PARTITION BY entity ORDER BY step_idx
        ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), 6) AS target
    FROM dense WINDOW w AS (PARTITION BY entity ORDER BY step_idx)"""
)
def horizon_target(spark, sf_dir):
    """Mark three steps on, or the last one."""
    rows, _ = dense(spark, sf_dir)
    return windows.horizon_target(rows.select("entity", "step_idx", "mark"), "mark", 3, ["entity"]).drop("mark")


@query(
    f"""WITH {SQL_DENSE}, f AS (SELECT entity, step_idx, lag(mark) OVER (PARTITION BY entity ORDER BY step_idx) AS forecast FROM dense),
    g AS (SELECT entity, step_idx - 1 AS step_idx, 'next_grade' AS metric, forecast AS value FROM f WHERE step_idx > 0)
    SELECT entity, CAST(step_idx AS BIGINT) AS step_idx, metric, round(value, 6) AS value FROM g
    UNION ALL SELECT entity, CAST(step_idx AS BIGINT), 'mark', round(mark, 6) FROM dense"""
)
def next_step_feature(spark, sf_dir):
    """A forecast for the next step as a feature of this one."""
    rows, _ = dense(spark, sf_dir)
    by_step = frames.entity_window()
    forecast = rows.select("entity", "step_idx", F.lag("mark").over(by_step).alias("forecast"))
    marks = rows.select("entity", "step_idx", F.lit("mark").alias("metric"), F.col("mark").alias("value"))
    return marks.unionByName(windows.shift_forecast(forecast, "forecast"))


@query(
    f"""WITH {SQL_DENSE}, ns AS (SELECT unnest(range(1, (SELECT n + 1 FROM n_steps))) AS n)
    SELECT entity, n, CAST(sum(cents) AS BIGINT) AS cents, CAST(sum({_CELL_SUM}) AS BIGINT) AS tests
    FROM dense JOIN ns ON step_idx < n GROUP BY entity, n"""
)
def cumulative_features(spark, sf_dir):
    """What is known after the first n steps, for every n."""
    rows, _ = dense(spark, sf_dir, ("cents", *TESTS))
    upto = frames.entity_window().rowsBetween(Window.unboundedPreceding, 0)
    tests = sum((F.col(t) * (i + 1) for i, t in enumerate(TESTS)), F.lit(0))
    return rows.select(
        "entity",
        (F.col("step_idx") + 1).alias("n"),
        F.sum("cents").over(upto).alias("cents"),
        F.sum(tests).over(upto).alias("tests"),
    )


@query(
    f"""WITH {SQL_DENSE}, p AS (SELECT step_idx, count(*) AS n, CAST(sum(cents) AS BIGINT) AS s FROM dense GROUP BY step_idx)
    SELECT CAST(step_idx AS BIGINT) AS step_idx, coalesce(CAST(sum(n) OVER w AS BIGINT), 0) AS n_before,
      round(CAST(sum(s) OVER w AS DOUBLE) / CAST(sum(n) OVER w AS BIGINT), 6) AS mean_before FROM p
    WINDOW w AS (ORDER BY step_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
)
def expanding_prefix_stats(spark, sf_dir):
    """Size and mean of everything before each step."""
    rows, _ = dense(spark, sf_dir)
    return windows.expanding_stats(rows, "cents")


_W = 50
_SEQ = f"""{SQL_DENSE}, seq AS (SELECT entity, step_idx, cents,
   row_number() OVER (ORDER BY step_idx, md5('42:' || entity), entity) - 1 AS idx FROM dense)"""


def _sequence(spark, sf_dir):
    rows, _ = dense(spark, sf_dir)
    kept = durable(rows.select("entity", "step_idx", "cents"))
    return windows.sequence_index(kept, "entity")


@query(
    f"""WITH {_SEQ} SELECT entity, CAST(step_idx AS BIGINT) AS step_idx, idx, cents,
      CAST(sum(cents) OVER w AS BIGINT) AS window_sum, lag(cents, 1) OVER (ORDER BY idx) AS newest,
      lag(cents, {_W}) OVER (ORDER BY idx) AS oldest FROM seq
    WINDOW w AS (ORDER BY idx ROWS BETWEEN {_W} PRECEDING AND 1 PRECEDING) QUALIFY idx >= {_W}"""
)
def residual_halo_window(spark, sf_dir):
    """Sliding windows over the whole step-major sequence."""
    out = windows.sliding_windows(_sequence(spark, sf_dir), "cents", _W)
    total = F.aggregate("window", F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select(
        "entity", "step_idx", "idx", "cents", total.alias("window_sum"),
        F.get("window", F.lit(_W - 1)).alias("newest"), F.get("window", F.lit(0)).alias("oldest"),
    )


@query(
    f"""WITH {_SEQ}, lastw AS (SELECT CAST(cents AS DOUBLE) / 100 AS r FROM seq ORDER BY idx DESC LIMIT 300)
    SELECT count(*) AS n, round(quantile_cont(r, 0.9), 6) AS offset_q FROM lastw"""
)
def trailing_residual_offset(spark, sf_dir):
    """Quantile of the newest values of the sequence."""
    scaled = _sequence(spark, sf_dir).select("idx", (F.col("cents") / 100.0).alias("r"))
    newest = windows.trailing_window(scaled, "r", 300)
    ordered = F.sort_array("window")
    return newest.select(
        F.size("window").alias("n"),
        sequential.sorted_quantile(ordered, F.lit(1.0 - ALPHA)).alias("offset_q"),
    )


@query(
    f"""WITH {SQL_DENSE}, arr AS (SELECT entity, list_sort(list(mark)) AS m FROM dense GROUP BY entity),
    b AS (SELECT unnest(range(0, 101)) AS j),
    q AS (SELECT entity, m, j, j * (0.1e0 / 100) AS lo_q, 0.9e0 + j * (0.1e0 / 100) AS hi_q, len(m) - 1 AS k FROM arr, b),
    v AS (SELECT entity, j,
      round(m[CAST(floor(lo_q * k) AS INTEGER) + 1] + (m[CAST(ceil(lo_q * k) AS INTEGER) + 1] - m[CAST(floor(lo_q * k) AS INTEGER) + 1]) * (lo_q * k - floor(lo_q * k)), 9) AS lo,
      round(m[CAST(floor(hi_q * k) AS INTEGER) + 1] + (m[CAST(ceil(hi_q * k) AS INTEGER) + 1] - m[CAST(floor(hi_q * k) AS INTEGER) + 1]) * (hi_q * k - floor(hi_q * k)), 9) AS hi
      FROM q),
    best AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY round(hi - lo, 9), j) AS r FROM v)
    SELECT entity, round(hi - lo, 6) AS width, round(lo, 6) AS lo, round(hi, 6) AS hi FROM best WHERE r = 1"""
)
def min_width_beta(spark, sf_dir):
    """Narrowest range that leaves a tenth of an entity's marks outside."""
    rows, _ = dense(spark, sf_dir)
    packed = rows.groupBy("entity").agg(F.sort_array(F.collect_list("mark")).alias("m"))
    best = sequential.narrowest_range(F.col("m"), ALPHA)
    out = packed.select("entity", best.alias("b"))
    return out.select("entity", "b.width", "b.lo", "b.hi")


# ---- threshold and labels ------------------------------------------------------------

_TWO_MEANS = f"""{SQL_LAST}, h AS (SELECT last_mark AS v, count(*) AS n FROM last GROUP BY 1),
run AS (SELECT v, CAST(sum(n) OVER w AS DOUBLE) AS nc, sum(n * v) OVER w AS sc,
   CAST(sum(n) OVER () AS DOUBLE) AS na, sum(n * v) OVER () AS sa FROM h WINDOW w AS (ORDER BY v)),
best AS (SELECT v AS cut, sc / nc AS low_center, (sa - sc) / nullif(na - nc, 0) AS high_center FROM run
  ORDER BY coalesce(sc * sc / nc + (sa - sc) * (sa - sc) / nullif(na - nc, 0), -1) DESC, v LIMIT 1),
grid AS (SELECT i AS j, 0.5e0 + i * (0.5e0 / 99) AS prop FROM (SELECT unnest(range(0, 100)) AS i)),
counts AS (SELECT j, prop, low_center * prop AS candidate,
   (SELECT coalesce(sum(n), 0) FROM h WHERE v < low_center * prop) AS n_below,
   (SELECT sum(n) FROM h) AS n_rows FROM grid, best),
jumps AS (SELECT *, n_below - lag(n_below) OVER (ORDER BY j) AS jump, lag(candidate) OVER (ORDER BY j) AS pc,
   lag(n_below) OVER (ORDER BY j) AS pb FROM counts),
top AS (SELECT * FROM jumps WHERE j > 0 ORDER BY jump DESC, j LIMIT 1),
pick AS (SELECT CASE WHEN pb / n_rows * 100e0 < 20 THEN candidate ELSE pc END AS threshold,
   CASE WHEN pb / n_rows * 100e0 < 20 THEN n_below ELSE pb END / n_rows * 100e0 AS percent FROM top)"""


@query(f"WITH {_TWO_MEANS} SELECT round(low_center, 6) AS low_center, round(high_center, 6) AS high_center, round(cut, 6) AS cut FROM best")
def two_means_threshold(spark, sf_dir):
    """Exact split of the last marks into two groups."""
    hist = ranks.value_histogram(last_marks(spark, sf_dir), "last_mark")
    return threshold.two_means(hist, "last_mark")


@query(
    f"""WITH {_TWO_MEANS} SELECT CAST(j AS BIGINT) AS j, round(prop, 6) AS prop, round(candidate, 6) AS candidate,
      CAST(n_below AS BIGINT) AS n_below, CAST(n_rows AS BIGINT) AS n_rows, CAST(jump AS BIGINT) AS jump FROM jumps"""
)
def threshold_grid(spark, sf_dir):
    """Rows below each proportion of the low centre."""
    hist = ranks.value_histogram(last_marks(spark, sf_dir), "last_mark")
    return threshold.threshold_grid(hist, threshold.two_means(hist, "last_mark"), "last_mark")


@query(f"WITH {_TWO_MEANS} SELECT round(threshold, 6) AS threshold, round(percent, 6) AS percent FROM pick")
def risk_threshold(spark, sf_dir):
    """The threshold before the largest jump."""
    return threshold.risk_threshold(last_marks(spark, sf_dir))


@query(
    f"""WITH {_TWO_MEANS} SELECT grp, count(*) AS n, round(avg(CASE WHEN last_mark < threshold THEN 1e0 ELSE 0e0 END) * 100, 6)
      AS positive_percent FROM last, pick GROUP BY grp"""
)
def risk_label_rate(spark, sf_dir):
    """Share of entities at risk per group."""
    last = kept_last_marks(spark, sf_dir)
    labelled = threshold.risk_label(last, threshold.risk_threshold(last))
    return threshold.positive_rate(labelled, ["grp"])


@query(
    f"""WITH {SQL_LAST}, t AS (SELECT quantile_cont(last_mark, 0.15) AS q FROM last)
    SELECT entity, round(last_mark, 6) AS last_mark, CASE WHEN last_mark < q THEN 1 ELSE 0 END::BIGINT AS y FROM last, t"""
)
def quantile_label(spark, sf_dir):
    """Label by a quantile of the last marks."""
    last = kept_last_marks(spark, sf_dir)
    return threshold.risk_label(last, threshold.quantile_threshold(last)).drop("grp")


@query(
    "SELECT l_returnflag, l_linestatus, round(quantile_cont(l_extendedprice, 0.9), 6) AS q_value, count(*) AS n FROM lineitem GROUP BY ALL"
)
def exact_group_quantile(spark, sf_dir):
    """Exact quantile of large groups without gathering them."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_extendedprice")
    return ranks.exact_quantile(rows, "l_extendedprice", 0.9, ["l_returnflag", "l_linestatus"])


# ---- splits --------------------------------------------------------------------------


def _split_sql(parts):
    done, cases = 0, []
    for name, pct in parts[:-1]:
        done += pct
        cases.append(f"WHEN r * 100 <= m * {done} THEN '{name}'")
    return f"""WITH f AS (SELECT o_orderkey, o_orderstatus AS y,
      row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('42:' || o_orderkey), o_orderkey) AS r,
      count(*) OVER (PARTITION BY o_orderstatus) AS m FROM orders)
    SELECT o_orderkey, y, CASE {' '.join(cases)} ELSE '{parts[-1][0]}' END AS split FROM f"""


def _split(spark, sf_dir, parts):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("y"))
    return split.stratified_split(rows, "o_orderkey", "y", parts)


@query(_split_sql(split.THREE_WAY))
def stratified_split(spark, sf_dir):
    """Train, calibration and test rows with equal class shares."""
    return _split(spark, sf_dir, split.THREE_WAY)


@query(_split_sql(split.FOUR_WAY))
def stratified_split_gate(spark, sf_dir):
    """The same with two calibration parts."""
    return _split(spark, sf_dir, split.FOUR_WAY)


@query(
    """SELECT CAST(quality AS BIGINT) AS quality, count(*) AS n,
      round((SELECT count(*) FROM labels) / (CAST((SELECT count(DISTINCT quality) FROM labels) AS DOUBLE) * count(*)), 6) AS weight
    FROM labels GROUP BY quality"""
)
def class_weights(spark, sf_dir):
    """Balanced class weights."""
    return split.class_weights(table(spark, sf_dir, "labels"), "quality")


# ---- prediction sets -----------------------------------------------------------------


def split_documents(spark, sf_dir):
    # Calibration and test rows are both read from it, several times over.
    return durable(split.stratified_split(scored_documents(spark, sf_dir), "doc_id", "y"))


def _cal_test(spark, sf_dir):
    rows = split_documents(spark, sf_dir)
    return rows.where(F.col("split") == "cal"), rows.where(F.col("split") == "test")


@query(f"WITH {SQL_DOCS} SELECT round(q, 6) AS q, n_cal FROM qall")
def lac_quantile(spark, sf_dir):
    """Conformal quantile of the calibration scores."""
    cal, _ = _cal_test(spark, sf_dir)
    return conformal.lac_quantile(cal, ALPHA)


@query(f"WITH {SQL_DOCS} SELECT doc_id, CAST(y AS BIGINT) AS y, has0, has1 FROM van")
def lac_sets(spark, sf_dir):
    """Prediction sets with one limit."""
    cal, test = _cal_test(spark, sf_dir)
    return conformal.lac_sets(test, cal, ALPHA).select("doc_id", "y", "has0", "has1")


@query(f"WITH {SQL_DOCS} SELECT lang, round(q, 6) AS q, n_cal, CAST(y0 AS BIGINT) AS only_class, k >= 2 AS both_classes FROM qlang")
def mondrian_quantile(spark, sf_dir):
    """Conformal quantile per partition."""
    cal, _ = _cal_test(spark, sf_dir)
    return conformal.partition_limits(cal, ALPHA, "lang")


@query(f"WITH {SQL_DOCS} SELECT doc_id, lang, CAST(y AS BIGINT) AS y, has0, has1 FROM mond")
def mondrian_sets_fallback(spark, sf_dir):
    """Prediction sets per partition, with the global limit where one lacks rows."""
    cal, test = _cal_test(spark, sf_dir)
    out = conformal.mondrian_sets(test, cal, ALPHA, "lang")
    return out.select("doc_id", "lang", "y", "has0", "has1")


@query(
    f"""WITH {SQL_DOCS}, cal2 AS (SELECT * FROM cal WHERE lang <> 'fr' OR y = 1),
    qall2 AS (SELECT min(score) FILTER (WHERE rn >= ceil(round((n + 1) * 0.9e0, 9))) AS q
      FROM (SELECT score, row_number() OVER (ORDER BY score) AS rn, count(*) OVER () AS n FROM cal2)),
    ql2 AS (SELECT lang, min(score) FILTER (WHERE rn >= ceil(round((n + 1) * 0.9e0, 9))) AS q, min(y) AS y0, count(DISTINCT y) AS k
      FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score) AS rn, count(*) OVER (PARTITION BY lang) AS n FROM cal2) GROUP BY lang),
    m2 AS (SELECT t.*, coalesce(CASE WHEN g.k >= 2 THEN g.q END, a.q) AS q, g.k, g.y0 FROM test t LEFT JOIN ql2 g ON g.lang = t.lang, qall2 a)
    SELECT doc_id, lang, CASE WHEN k = 1 THEN y0 = 0 ELSE q IS NULL OR s0 <= q END AS has0,
      CASE WHEN k = 1 THEN y0 = 1 ELSE q IS NULL OR s1 <= q END AS has1 FROM m2"""
)
def mondrian_only_class(spark, sf_dir):
    """A partition of one class gets just that class."""
    cal, test = _cal_test(spark, sf_dir)
    kept = cal.where((F.col("lang") != "fr") | (F.col("y") == 1))
    out = conformal.mondrian_sets(test, kept, ALPHA, "lang", fallback="only_class")
    return out.select("doc_id", "lang", "has0", "has1")


@query(
    """SELECT event_id, NOT (60e0 > hi) OR 60e0 < lo AS has0, NOT (60e0 < lo) OR 60e0 > hi AS has1
    FROM (SELECT event_id, value * 0.8e0 AS lo, value * 1.2e0 + 5e0 AS hi FROM events)"""
)
def interval_to_set(spark, sf_dir):
    """An interval against a threshold as a set."""
    e = table(spark, sf_dir, "events").select("event_id", "value")
    has0, has1 = sets.from_interval(F.col("value") * 0.8, F.col("value") * 1.2 + 5.0, F.lit(60.0))
    return e.select("event_id", has0.alias("has0"), has1.alias("has1"))


def document_sets(spark, sf_dir):
    """Conformal and interval sets of the test documents."""
    cal, test = _cal_test(spark, sf_dir)
    mond = conformal.mondrian_sets(test, cal, ALPHA, "lang")
    named = mond.withColumnsRenamed({"has0": "cp0", "has1": "cp1"})
    return gate.interval_sets(named, DOC_THRESHOLD)


@query(f"WITH {SQL_DOCS} SELECT doc_id, cp0 OR iv0 AS un0, cp1 OR iv1 AS un1 FROM both_")
def set_union(spark, sf_dir):
    """Union of two prediction sets."""
    return gate.union_sets(document_sets(spark, sf_dir)).select("doc_id", "un0", "un1")


_CODE = "CASE WHEN {0}0 AND {0}1 THEN 2 WHEN {0}1 THEN 1 WHEN {0}0 THEN 0 ELSE -1 END"
_TEXT = "CASE WHEN {0}0 AND {0}1 THEN '{{0,1}}' WHEN {0}0 THEN '{{0}}' WHEN {0}1 THEN '{{1}}' ELSE '∅' END"


@query(f"WITH {SQL_DOCS} SELECT doc_id, CAST({_CODE.format('cp')} AS BIGINT) AS code, {_TEXT.format('cp')} AS shown FROM both_")
def set_code(spark, sf_dir):
    """Sets as codes and as text."""
    both = document_sets(spark, sf_dir)
    a, b = F.col("cp0"), F.col("cp1")
    return both.select("doc_id", sets.code(a, b).alias("code"), sets.text(a, b).alias("shown"))


_W_CP, _W_IV = "CAST(cp0 AS INTEGER) + CAST(cp1 AS INTEGER)", "CAST(iv0 AS INTEGER) + CAST(iv1 AS INTEGER)"
_OK = "CASE WHEN y = 1 THEN {0}1 ELSE {0}0 END"
_GATE_Y = f"""CASE WHEN {_OK.format('cp')} AND NOT {_OK.format('iv')} THEN 0
  WHEN {_OK.format('iv')} AND NOT {_OK.format('cp')} THEN 1
  WHEN {_OK.format('cp')} AND {_OK.format('iv')} THEN CASE WHEN {_W_CP} < {_W_IV} THEN 0 ELSE 1 END ELSE 2 END"""


@query(f"WITH {SQL_DOCS} SELECT doc_id, CAST({_W_CP} AS BIGINT) AS w_cls, CAST({_W_IV} AS BIGINT) AS w_spc, CAST({_W_CP} - ({_W_IV}) AS BIGINT) AS diff, CAST({_GATE_Y} AS BIGINT) AS gate_y FROM both_")
def gate_label(spark, sf_dir):
    """Which of two sets was right and narrow."""
    both = gate.with_gate_label(gate.with_widths(document_sets(spark, sf_dir)))
    return both.select("doc_id", "w_cls", "w_spc", "diff", "gate_y")


_GATED = "CASE doc_id % 3 WHEN 0 THEN cp{0} WHEN 1 THEN iv{0} ELSE cp{0} OR iv{0} END"
_SQL_GATED = f"{SQL_DOCS}, gated AS (SELECT *, {_GATED.format(0)} AS gate0, {_GATED.format(1)} AS gate1 FROM both_)"


def _gated(spark, sf_dir):
    both = document_sets(spark, sf_dir).withColumn("choice", F.pmod("doc_id", F.lit(3)).cast("int"))
    return gate.choose_sets(both)


@query(
    f"""WITH {_SQL_GATED} SELECT doc_id, gate0, gate1, CAST(CASE WHEN gate0 = gate1 THEN -1 WHEN gate1 THEN 1 ELSE 0 END AS BIGINT)
      AS y_hat, CASE doc_id % 3 WHEN 0 THEN 'MCP' WHEN 1 THEN 'SPCI' ELSE 'UNION' END AS gate_dec FROM gated"""
)
def gate_apply(spark, sf_dir):
    """The set a gate decision names."""
    out = _gated(spark, sf_dir)
    return out.select("doc_id", "gate0", "gate1", "y_hat", sets.gate_name(F.col("choice")).alias("gate_dec"))


_HIT = "CAST(CASE WHEN y = 1 THEN has1 ELSE has0 END AS INTEGER)"
_WID = "CAST(has0 AS INTEGER) + CAST(has1 AS INTEGER)"
_METRICS = f"""count(*) AS n, round(avg({_HIT}), 6) AS coverage, round(avg({_WID}), 6) AS mean_width,
  round(avg(CAST({_WID} = 2 AS INTEGER)), 6) AS ambiguous_rate, round(avg(CAST({_WID} = 1 AS INTEGER)), 6) AS singleton_rate,
  round(avg({_HIT}) FILTER (WHERE {_WID} = 1), 6) AS cond_acc_if_singleton"""


@query(f"WITH {SQL_DOCS} SELECT lang, round(avg({_HIT}), 6) AS coverage, round(avg({_WID}), 6) AS width FROM mond GROUP BY lang")
def coverage_width(spark, sf_dir):
    """Coverage and mean width per partition."""
    cal, test = _cal_test(spark, sf_dir)
    return metrics.coverage_width(conformal.mondrian_sets(test, cal, ALPHA, "lang"), ["lang"])


@query(f"WITH {SQL_DOCS} SELECT {_METRICS} FROM mond")
def extended_metrics(spark, sf_dir):
    """All set metrics."""
    cal, test = _cal_test(spark, sf_dir)
    return metrics.set_metrics(conformal.mondrian_sets(test, cal, ALPHA, "lang"))


@query(
    f"""WITH {_SQL_GATED}, l AS (SELECT 'MCP' AS method, y, cp0 AS has0, cp1 AS has1 FROM gated
      UNION ALL SELECT 'SPCI', y, iv0, iv1 FROM gated UNION ALL SELECT 'GATE', y, gate0, gate1 FROM gated)
    SELECT method, {_METRICS} FROM l GROUP BY method"""
)
def three_way_summary(spark, sf_dir):
    """Metrics of conformal, interval and gated sets."""
    pairs = {"MCP": gate.CP, "SPCI": gate.INTERVAL, "GATE": gate.GATE}
    return metrics.three_way(_gated(spark, sf_dir), pairs)


@query(f"WITH {_SQL_GATED} SELECT doc_id, CAST(y AS BIGINT) AS y, {_TEXT.format('cp')} AS \"MCP\", {_TEXT.format('iv')} AS \"SPCI\", {_TEXT.format('gate')} AS \"GATE\", CASE doc_id % 3 WHEN 0 THEN 'MCP' WHEN 1 THEN 'SPCI' ELSE 'UNION' END AS gate_dec FROM gated ORDER BY doc_id LIMIT 10")
def sample_predictions(spark, sf_dir):
    """The first rows in readable form."""
    pairs = {"MCP": gate.CP, "SPCI": gate.INTERVAL, "GATE": gate.GATE}
    return metrics.sample_lines(_gated(spark, sf_dir), pairs, "doc_id")


# Horizons: the probability after n steps is a fixed function of the summed marks.
_SQL_HORIZON = f"""{SQL_DENSE}, ent AS (SELECT *, CASE WHEN last_mark < 60 THEN 1 ELSE 0 END AS y FROM (
    SELECT entity, max(CAST(entity AS BIGINT)) % 4 AS part, coalesce(max_by(mark, step_idx) FILTER (WHERE mark > 0), 0e0) AS last_mark
    FROM dense GROUP BY entity)),
rk AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5('42:' || entity), entity) AS r, count(*) OVER (PARTITION BY y) AS m FROM ent),
sp AS (SELECT entity, part, y, CASE WHEN CAST(entity AS BIGINT) % 10 = 0 THEN 'synthetic' ELSE 'real' END AS source,
   CASE WHEN r * 100 <= m * 60 THEN 'train' WHEN r * 100 <= m * 80 THEN 'cal' ELSE 'test' END AS split FROM rk),
cum AS (SELECT entity, step_idx + 1 AS n, CAST(sum(cents) OVER (PARTITION BY entity ORDER BY step_idx) AS DOUBLE) AS c FROM dense),
p AS (SELECT sp.*, n AS n_projects, round(n * 5000e0 / (n * 5000e0 + c), 6) AS p1 FROM sp JOIN cum USING (entity)),
cal AS (SELECT *, CASE WHEN y = 1 THEN 1e0 - p1 ELSE p1 END AS score FROM p WHERE split = 'cal'),
qa AS (SELECT n_projects, min(score) FILTER (WHERE rn >= ceil(round((k + 1) * 0.9e0, 9))) AS q FROM (SELECT *,
  row_number() OVER (PARTITION BY n_projects ORDER BY score) AS rn, count(*) OVER (PARTITION BY n_projects) AS k FROM cal) GROUP BY 1),
qp AS (SELECT n_projects, part, min(score) FILTER (WHERE rn >= ceil(round((k + 1) * 0.9e0, 9))) AS q, count(DISTINCT y) AS ky FROM (SELECT *,
  row_number() OVER (PARTITION BY n_projects, part ORDER BY score) AS rn, count(*) OVER (PARTITION BY n_projects, part) AS k FROM cal) GROUP BY 1, 2),
t AS (SELECT p.*, qa.q AS qv, coalesce(CASE WHEN ky >= 2 THEN qp.q END, qa.q) AS qm FROM p JOIN qa USING (n_projects)
  LEFT JOIN qp ON qp.n_projects = p.n_projects AND qp.part = p.part WHERE split = 'test'),
s AS (SELECT 'vanilla' AS method, n_projects, part, source, y, qv IS NULL OR p1 <= qv AS has0, qv IS NULL OR 1e0 - p1 <= qv AS has1 FROM t
  UNION ALL SELECT 'mondrian', n_projects, part, source, y, qm IS NULL OR p1 <= qm, qm IS NULL OR 1e0 - p1 <= qm FROM t),
detail AS (SELECT method, 'GB' AS model, n_projects, CASE WHEN grouping(part) = 1 THEN -1 ELSE part END AS cluster,
   avg({_HIT}) AS coverage, avg({_WID}) AS width FROM s WHERE source = 'real'
   GROUP BY GROUPING SETS ((method, n_projects, part), (method, n_projects)))"""


def _horizon_sets(spark, sf_dir):
    rows, _ = dense(spark, sf_dir)
    last = windows.last_positive(rows, ["entity"])
    user = F.col("entity").cast("long")
    entities = last.select(
        "entity",
        F.pmod(user, F.lit(4)).alias("cluster"),
        (F.col("last_mark") < 60).cast("int").alias("y"),
        F.when(user % 10 == 0, F.lit("synthetic")).otherwise(F.lit("real")).alias("source"),
    )
    dealt = split.stratified_split(entities, "entity", "y")
    upto = frames.entity_window().rowsBetween(Window.unboundedPreceding, 0)
    n = F.col("step_idx") + 1
    cum = rows.select("entity", n.alias("n_projects"), F.sum("cents").over(upto).cast("double").alias("c"))
    base = F.col("n_projects") * 5000.0
    scored = durable(
        cum.join(dealt, "entity")
        .withColumn("p1", F.round(base / (base + F.col("c")), 6))
        .withColumn("model", F.lit("GB"))
        .drop("c")
    )
    cal, test = scored.where(F.col("split") == "cal"), scored.where(F.col("split") == "test")
    by_n = ["n_projects"]
    vanilla = conformal.lac_sets(test, cal, ALPHA, by_n).withColumn("method", F.lit("vanilla"))
    mond = conformal.mondrian_sets(test, cal, ALPHA, "cluster", groups=by_n)
    return vanilla.unionByName(mond.withColumn("method", F.lit("mondrian")))


@query(f"WITH {_SQL_HORIZON} SELECT method, model, n_projects::BIGINT AS n_projects, cluster::BIGINT AS cluster, round(coverage, 6) AS coverage, round(width, 6) AS width FROM detail")
def metrics_detail(spark, sf_dir):
    """Coverage and width per horizon and partition, and over all."""
    return metrics.horizon_detail(_horizon_sets(spark, sf_dir))


@query(
    f"""WITH {_SQL_HORIZON} SELECT method, model, CASE WHEN grouping(cluster) = 1 THEN 'ALL' ELSE CAST(cluster AS VARCHAR) END AS cluster,
      round(avg(coverage), 6) AS mean_coverage, round(avg(width), 6) AS mean_width FROM detail
    GROUP BY GROUPING SETS ((method, model, cluster), (method, model))"""
)
def metrics_grouping_sets(spark, sf_dir):
    """Means of the detail rows per partition and tagged ALL."""
    return metrics.horizon_summary(metrics.horizon_detail(_horizon_sets(spark, sf_dir)))


@query(f"WITH {_SQL_HORIZON} SELECT method, round(avg(width), 6) AS width FROM detail WHERE cluster = -1 GROUP BY method")
def mean_width_over_horizons(spark, sf_dir):
    """Width averaged over the horizons."""
    detail = metrics.horizon_detail(_horizon_sets(spark, sf_dir))
    return detail.where(F.col("cluster") == -1).groupBy("method").agg(F.avg("width").alias("width"))


# ---- clusters and neighbours ---------------------------------------------------------

_SMALL = 52
_D = 64
_EMB = f"""e AS (SELECT vec_id, label, unnest(embedding) AS x, unnest(range(0, {_D})) AS i FROM embeddings),
c AS (SELECT label AS k, i, avg(CAST(x AS DOUBLE)) AS m FROM e GROUP BY 1, 2),
sz AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1),
lim AS (SELECT quantile_disc(n, 0.3) + 1 AS lim FROM sz),
small AS (SELECT label FROM sz, lim WHERE n < lim),
d AS (SELECT e.vec_id, c.k, sum((CAST(x AS DOUBLE) - m) * (CAST(x AS DOUBLE) - m)) AS d FROM e JOIN c USING (i)
  WHERE label IN (SELECT label FROM small) AND {{only}} GROUP BY 1, 2),
near AS (SELECT vec_id, arg_min(k, d) AS k FROM d GROUP BY 1)"""


def _centers(rows):
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    means = rows.withColumn("v", array_to_vector("point")).groupBy("cluster").agg(
        Summarizer.mean(F.col("v")).alias("m")
    )
    return {r.cluster: [float(x) for x in r.m] for r in means.collect()}


@query(
    f"""WITH {_EMB.format(only='c.k NOT IN (SELECT label FROM small)')}
    SELECT v.vec_id, CAST(coalesce(near.k, v.label) AS BIGINT) AS cluster FROM embeddings v LEFT JOIN near USING (vec_id)"""
)
def nearest_centroid_reassign(spark, sf_dir):
    """Members of small clusters moved to the nearest large one."""
    point = F.transform("embedding", lambda x: x.cast("double"))
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("label").cast("int").alias("cluster"), point.alias("point")
    )
    sizes = sorted(r.n for r in clusters.cluster_sizes(rows).collect())
    limit = sizes[max(0, -(-3 * len(sizes) // 10) - 1)] + 1
    return clusters.reassign_small(rows, "point", _centers(rows), limit).drop("point")


_BITS = " + ".join(f"(CASE WHEN {t} > 0 THEN {1 << i} ELSE 0 END)" for i, t in enumerate(TESTS))
_K = 8


@query(
    f"""WITH {SQL_DENSE}, b AS (SELECT entity, step_idx, CAST({_BITS} AS BIGINT) AS bits FROM dense),
    r AS (SELECT a.step_idx, a.entity, o.entity AS neighbour, bit_count(xor(a.bits, o.bits)) AS dist,
      row_number() OVER (PARTITION BY a.step_idx, a.entity ORDER BY bit_count(xor(a.bits, o.bits)), o.entity) AS rank
      FROM b a JOIN b o ON o.step_idx = a.step_idx AND o.entity <> a.entity)
    SELECT CAST(step_idx AS BIGINT) AS step_idx, entity, rank, neighbour, CAST(dist AS BIGINT) AS dist FROM r WHERE rank <= {_K}"""
)
def hamming_knn(spark, sf_dir):
    """Nearest neighbours by test results, within each step."""
    rows, _ = dense(spark, sf_dir, tuple(TESTS))
    bits = F.array(*[frames.to_bit(F.col(t).cast("double")) for t in TESTS])
    marked = durable(rows.select("entity", "step_idx", bits.alias("bits")))
    return neighbours.hamming_neighbours(marked, "entity", "bits", len(TESTS), _K, "step_idx")


# Letters whose pairs are looked for in a text, a bit for each of the 72 pairs.
_PAIRS = [a + b for a in "aeinorst" for b in "aeinorstl"]
_SQL_PAIRS = " || ".join(f"CASE WHEN contains(t, '{p}') THEN '1' ELSE '0' END" for p in _PAIRS)


@query(
    f"""WITH d AS (SELECT doc_id, lang, lower(coalesce(text, '')) AS t FROM documents),
    b AS (SELECT doc_id, lang, {_SQL_PAIRS} AS bits FROM d),
    r AS (SELECT a.lang, a.doc_id, o.doc_id AS neighbour, hamming(a.bits, o.bits) AS dist,
      row_number() OVER (PARTITION BY a.doc_id ORDER BY hamming(a.bits, o.bits), o.doc_id) AS rank
      FROM b a JOIN b o ON o.lang = a.lang AND o.doc_id <> a.doc_id)
    SELECT lang, doc_id, rank, neighbour, CAST(dist AS BIGINT) AS dist FROM r WHERE rank <= {_K}"""
)
def hamming_knn_wide(spark, sf_dir):
    """Nearest documents of a language by the pairs of letters they contain; more bits than a
    number holds."""
    text = F.lower(F.coalesce("text", F.lit("")))
    bits = F.array(*[F.contains(text, F.lit(p)).cast("int") for p in _PAIRS])
    rows = durable(table(spark, sf_dir, "documents").select("doc_id", "lang", bits.alias("bits")))
    return neighbours.hamming_neighbours(rows, "doc_id", "bits", len(_PAIRS), _K, "lang")
