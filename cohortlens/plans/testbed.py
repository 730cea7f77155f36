"""The given tables read as learning traces.

``events``: a user is an entity, a day a step, the summed value the mark, the event types
the tests. ``documents`` with ``labels``: rows to classify, the language as partition.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.operators.frames import densify
from cohortlens.session import durable

# The event types, which play the part of the tests of a step.
TESTS = ["click", "error", "purchase", "signup", "view"]
N_GROUPS = 4
POOL = "B-CPE-100"
POOL_DAYS = 13
POOL_NAMES = {
    f"{t}_passed": f"{i:02d} - {'task' if i < 2 else 'Success of task'}{i:02d}_passed" for i, t in enumerate(TESTS)
}
STEPS_PER_UNIT = 7
ALPHA = 0.1
#: Interval threshold of the document rows.
DOC_THRESHOLD = 2.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def axis(spark: SparkSession, sf_dir: str) -> tuple[datetime.date, int]:
    """First day and number of days."""
    day = F.to_date("ts")
    row = table(spark, sf_dir, "events").agg(F.min(day).alias("a"), F.max(day).alias("b")).first()
    return row.a, (row.b - row.a).days + 1


def cells(spark: SparkSession, sf_dir: str, origin: datetime.date) -> DataFrame:
    """One row per user and day. Values have two decimals and are summed as integers."""
    events = table(spark, sf_dir, "events")
    step = F.datediff(F.to_date("ts"), F.lit(origin)).cast("int")
    cents = F.round(F.col("value") * 100).cast("long")
    k = F.get_json_object("props", "$.k").try_cast("long")
    counts = [F.count_if(F.col("event_type") == t).alias(t) for t in TESTS]
    return (
        events.groupBy("user_id", step.alias("step_idx"))
        .agg(F.sum(cents).alias("cents"), F.sum(k).alias("k_sum"), *counts)
        .withColumn("entity", F.col("user_id").cast("string"))
        .withColumn("grp", F.concat(F.lit("G"), F.pmod("user_id", F.lit(N_GROUPS))))
        .withColumn("mark", F.col("cents") / 100.0)
    )


def dense(
    spark: SparkSession, sf_dir: str, values: tuple[str, ...] = ("cents",)
) -> tuple[DataFrame, int]:
    """Every user at every day with the wanted ``values``, and ``mark`` if ``cents`` is
    among them. Name only what is used: the rest is then not even read."""
    origin, n_steps = axis(spark, sf_dir)
    out = densify(cells(spark, sf_dir, origin), ["entity"], n_steps, list(values))
    if "cents" in values:
        out = out.withColumn("mark", F.col("cents") / 100.0)
    return out, n_steps


def long_table(spark: SparkSession, sf_dir: str, reused: bool = False) -> DataFrame:
    """The canonical long table of the events. A query that reads it several times has the
    cells, which are much fewer than the events, written first."""
    origin, _ = axis(spark, sf_dir)
    summed = cells(spark, sf_dir, origin)
    rows = (durable(summed) if reused else summed).select(
        "entity",
        "grp",
        F.concat(F.lit("U"), F.floor(F.col("step_idx") / STEPS_PER_UNIT)).alias("unit"),
        F.concat(F.lit("day"), F.lpad((F.col("step_idx") + 1).cast("string"), 2, "0")).alias("step"),
        "step_idx",
        "mark",
        *[F.col(t).cast("double").alias(f"{t}_passed") for t in TESTS],
        F.col("k_sum").cast("double").alias("styleInfo"),
    )
    ids = ["entity", "grp", "unit", "step", "step_idx"]
    metrics = ["mark", *[f"{t}_passed" for t in TESTS], "styleInfo"]
    return rows.unpivot(ids, metrics, "metric", "value")


def named_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long table under the names of result files: the first days are the pool's, the first
    tests its raw task results, the others their ``Success of`` results."""
    days = F.col("step_idx") < POOL_DAYS
    day = F.lpad((F.col("step_idx") + 1).cast("string"), 2, "0")
    metric = F.col("metric")
    for plain, name in POOL_NAMES.items():
        metric = F.when(F.col("metric") == plain, F.lit(name)).otherwise(metric)
    return long_table(spark, sf_dir, reused=True).withColumns({
        "unit": F.when(days, F.lit(POOL)).otherwise(F.col("unit")),
        "step": F.when(days, F.concat(F.lit("cpoolday"), day)).otherwise(F.col("step")),
        "metric": metric,
    })


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a probability and an interval that any engine can compute."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y"))
    size = F.col("n_chars").cast("double")
    lo = size / 1000.0 - F.pmod("doc_id", F.lit(5)) * 0.2
    hi = size / 1000.0 + F.pmod("doc_id", F.lit(4)) * 0.3
    return docs.join(labels, "doc_id").select(
        "doc_id",
        "lang",
        F.col("y").cast("int").alias("y"),
        F.round(size * 0.96 / (size + 600.0) + 0.02, 6).alias("p1"),
        F.round(lo, 6).alias("lo"),
        F.round(hi, 6).alias("hi"),
    )


def tidy(df: DataFrame) -> DataFrame:
    """Doubles to six digits and whole numbers to one type, for comparison."""
    cols = []
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType.simpleString()
        if kind in ("double", "float"):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif kind in ("int", "bigint", "smallint", "tinyint"):
            c = c.cast("bigint")
        cols.append(c.alias(f.name))
    return df.select(*cols)


# The same in SQL, for the side-by-side check.

SQL_CELLS = """ev AS (
  SELECT user_id, event_type,
         CAST(date_diff('day', (SELECT min(CAST(ts AS DATE)) FROM events), CAST(ts AS DATE)) AS INTEGER)
           AS step_idx,
         CAST(round(value * 100) AS BIGINT) AS c,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events),
cells AS (
  SELECT user_id, CAST(user_id AS VARCHAR) AS entity, 'G' || (user_id % 4) AS grp, step_idx,
         CAST(sum(c) AS BIGINT) AS cents, CAST(sum(c) AS DOUBLE) / 100 AS mark,
         CAST(sum(k) AS BIGINT) AS k_sum, """ + ", ".join(
    f"count(*) FILTER (WHERE event_type = '{t}') AS {t}" for t in TESTS
) + """
  FROM ev GROUP BY user_id, step_idx),
n_steps AS (SELECT max(step_idx) + 1 AS n FROM cells)"""

SQL_DENSE = SQL_CELLS + """,
grid AS (SELECT u.entity, CAST(s.i AS INTEGER) AS step_idx
         FROM (SELECT DISTINCT entity FROM cells) u,
              (SELECT unnest(range(0, (SELECT n FROM n_steps))) AS i) s),
dense AS (SELECT g.entity, g.step_idx, coalesce(c.cents, 0) AS cents,
                 coalesce(c.mark, 0e0) AS mark, coalesce(c.k_sum, 0) AS k_sum, """ + ", ".join(
    f"coalesce(c.{t}, 0) AS {t}" for t in TESTS
) + """
          FROM grid g LEFT JOIN cells c ON c.entity = g.entity AND c.step_idx = g.step_idx)"""

_ids = """entity, grp, 'U' || CAST(floor(step_idx / 7e0) AS BIGINT) AS unit,
        'day' || lpad(CAST(step_idx + 1 AS VARCHAR), 2, '0') AS step, step_idx"""
SQL_LONG = SQL_CELLS + ",\nlong AS (" + "\n  UNION ALL ".join(
    f"SELECT {_ids}, '{m}' AS metric, CAST({c} AS DOUBLE) AS value FROM cells"
    for m, c in [("mark", "mark"), *[(f"{t}_passed", t) for t in TESTS], ("styleInfo", "k_sum")]
) + ")"

_renamed = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in POOL_NAMES.items())
SQL_NAMED = SQL_LONG + f""",
named AS (SELECT entity, grp, step_idx, value,
    CASE WHEN step_idx < {POOL_DAYS} THEN '{POOL}' ELSE unit END AS unit,
    CASE WHEN step_idx < {POOL_DAYS} THEN 'cpoolday' || lpad(CAST(step_idx + 1 AS VARCHAR), 2, '0') ELSE step END AS step,
    CASE metric {_renamed} ELSE metric END AS metric FROM long)"""

SQL_DOCS = """docs AS (
  SELECT d.doc_id, d.lang, CAST(l.quality AS INTEGER) AS y,
    round(CAST(n_chars AS DOUBLE) * 0.96e0 / (CAST(n_chars AS DOUBLE) + 600e0) + 0.02e0, 6) AS p1,
    round(CAST(n_chars AS DOUBLE) / 1000e0 - (d.doc_id % 5) * 0.2e0, 6) AS lo,
    round(CAST(n_chars AS DOUBLE) / 1000e0 + (d.doc_id % 4) * 0.3e0, 6) AS hi
  FROM documents d JOIN labels l USING (doc_id)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5('42:' || doc_id), doc_id) AS r,
         count(*) OVER (PARTITION BY y) AS m FROM docs),
split AS (
  SELECT * EXCLUDE (r, m), CASE WHEN r * 100 <= m * 60 THEN 'train'
         WHEN r * 100 <= m * 80 THEN 'cal' ELSE 'test' END AS split,
         1e0 - p1 AS s1, p1 AS s0 FROM ranked),
cal AS (SELECT *, CASE WHEN y = 1 THEN s1 ELSE s0 END AS score FROM split WHERE split = 'cal'),
test AS (SELECT * FROM split WHERE split = 'test'),
qall AS (SELECT min(score) FILTER (WHERE rn >= ceil(round((n + 1) * 0.9e0, 9))) AS q, max(n) AS n_cal
  FROM (SELECT score, row_number() OVER (ORDER BY score) AS rn, count(*) OVER () AS n FROM cal)),
qlang AS (SELECT lang, min(score) FILTER (WHERE rn >= ceil(round((n + 1) * 0.9e0, 9))) AS q,
    max(n) AS n_cal, min(y) AS y0, count(DISTINCT y) AS k
  FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score) AS rn,
               count(*) OVER (PARTITION BY lang) AS n FROM cal) GROUP BY lang),
van AS (SELECT t.*, q IS NULL OR s0 <= q AS has0, q IS NULL OR s1 <= q AS has1 FROM test t, qall),
mon AS (SELECT t.*, coalesce(CASE WHEN g.k >= 2 THEN g.q END, a.q) AS q, g.k, g.y0
  FROM test t LEFT JOIN qlang g ON g.lang = t.lang, qall a),
mond AS (SELECT * EXCLUDE (q), q IS NULL OR s0 <= q AS has0, q IS NULL OR s1 <= q AS has1 FROM mon),
both_ AS (SELECT v.doc_id, v.lang, v.y, v.lo, v.hi, v.has0 AS cp0, v.has1 AS cp1,
    NOT (2e0 > v.hi) AS iv0, NOT (2e0 < v.lo) OR 2e0 > v.hi AS iv1 FROM mond v)"""
