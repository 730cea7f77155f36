"""Queries over long and wide trace tables: scans, names, merges, null counts, scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.functions import names, text
from cohortlens.operators import clusters, frames
from cohortlens.plans.registry import query
from cohortlens.plans.testbed import (
    SQL_CELLS,
    SQL_LONG,
    TESTS,
    axis,
    cells,
    long_table,
    table,
)
from cohortlens.session import durable

_PATH = "'U' || (event_id % 3) || '_step' || (event_id % 5) || '_' || upper(event_type[1:2]) || '-' || (event_id % 4) || '-1'"


@query(f"WITH {SQL_LONG} SELECT entity, grp, unit, step, CAST(step_idx AS BIGINT) AS step_idx, metric, round(value, 6) AS value FROM long")
def traces_long(spark, sf_dir):
    """Events as the canonical long table."""
    return long_table(spark, sf_dir)


#: Columns of the SQL twin; the query takes its own from the data, and fails to match if they differ.
_PIVOT_STEPS = range(30)


@query(
    f"WITH {SQL_CELLS} SELECT entity, grp, "
    + ", ".join(f"round(max(mark) FILTER (WHERE step_idx = {i}), 6) AS d{i}" for i in _PIVOT_STEPS)
    + " FROM cells GROUP BY entity, grp"
)
def traces_pivot(spark, sf_dir):
    """Wide marks: the N-way outer merge as one aggregation."""
    origin, n_steps = axis(spark, sf_dir)
    rows = cells(spark, sf_dir, origin).withColumn("d", F.concat(F.lit("d"), "step_idx"))
    steps = [f"d{i}" for i in range(n_steps)]
    return rows.groupBy("entity", "grp").pivot("d", steps).agg(F.max("mark"))


@query(
    f"""WITH {SQL_LONG}, named AS (SELECT entity, unit || '_' || step || '_' || metric AS name FROM long)
    SELECT split_part(name, '_', 1) AS unit, split_part(name, '_', 2) AS step,
      regexp_extract(name, '^[^_]*_[^_]*_(.*)$', 1) AS metric, count(*) AS n
    FROM named GROUP BY 1, 2, 3"""
)
def names_parsed(spark, sf_dir):
    """Column names taken apart into unit, step and metric."""
    long = long_table(spark, sf_dir).select(
        names.wide_name(F.col("unit"), F.col("step"), F.col("metric")).alias("name")
    )
    counted = long.groupBy("name").agg(F.count("*").alias("n"))
    return frames.parse_names(counted).select("unit", "step", "metric", "n")


@query(
    """WITH a AS (SELECT c_nationkey AS nation, c_mktsegment AS segment, count(*) AS n0 FROM customer GROUP BY 1, 2),
    b AS (SELECT s_nationkey AS nation, CAST(NULL AS VARCHAR) AS segment, count(*) AS n1 FROM supplier GROUP BY 1),
    c AS (SELECT c_nationkey AS nation, CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS segment, count(*) AS n2
      FROM customer GROUP BY 1, 2),
    ab AS (SELECT coalesce(a.nation, b.nation) AS nation, coalesce(a.segment, b.segment) AS segment, n0, n1
      FROM a FULL JOIN b ON a.nation IS NOT DISTINCT FROM b.nation AND a.segment IS NOT DISTINCT FROM b.segment)
    SELECT CAST(coalesce(ab.nation, c.nation) AS BIGINT) AS nation, coalesce(ab.segment, c.segment) AS segment, n0, n1, n2
    FROM ab FULL JOIN c ON ab.nation IS NOT DISTINCT FROM c.nation AND ab.segment IS NOT DISTINCT FROM c.segment"""
)
def outer_merge_nullsafe(spark, sf_dir):
    """Full outer merge of three tables on keys that may be NULL."""
    customer = table(spark, sf_dir, "customer")
    nation, segment = F.col("c_nationkey").alias("nation"), F.col("c_mktsegment")
    in_credit = F.when(F.col("c_acctbal") >= 0, segment).alias("segment")
    suppliers = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation"))
    return frames.outer_merge(
        [
            customer.groupBy(nation, segment.alias("segment")).agg(F.count("*").alias("n0")),
            suppliers.agg(F.count("*").alias("n1")).withColumn(
                "segment", F.lit(None).cast("string")
            ),
            customer.groupBy(nation, in_credit).agg(F.count("*").alias("n2")),
        ],
        ["nation", "segment"],
    )


@query(
    """SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS passed
       FROM events"""
)
def json_props_first_default(spark, sf_dir):
    """First entry's value of a nested list, 0 where it is missing."""
    events = table(spark, sf_dir, "events").select("event_id", "props")
    entry = F.from_json("props", "struct<k:bigint>")
    listed = events.withColumn("entries", F.array(entry))
    first = F.try_element_at("entries", F.lit(1))["k"]
    return listed.select("event_id", F.coalesce(first, F.lit(0)).alias("passed"))


@query(
    """WITH docs AS (SELECT CAST(ts AS DATE) AS day, user_id, event_type AS task, value FROM events),
    vocab AS (SELECT DISTINCT day, task FROM docs), members AS (SELECT DISTINCT day, user_id FROM docs),
    got AS (SELECT day, user_id, task, count(*) AS n FROM docs GROUP BY ALL)
    SELECT CAST(m.day AS VARCHAR) AS day, m.user_id, v.task, coalesce(g.n, 0) AS passed
    FROM members m JOIN vocab v USING (day) LEFT JOIN got g
      ON g.day = m.day AND g.user_id = m.user_id AND g.task = v.task"""
)
def task_vocab_zero_fill(spark, sf_dir):
    """A task another member of the file has counts 0 for a member without it."""
    docs = table(spark, sf_dir, "events").select(
        F.to_date("ts").cast("string").alias("day"), "user_id", F.col("event_type").alias("task")
    )
    from cohortlens.sources.documents import zero_fill

    got = durable(docs.groupBy("day", "user_id", "task").agg(F.count("*").alias("passed")))
    return zero_fill(got, "day", ["user_id"], "task", "passed")


_PRESENT = " UNION ALL ".join(
    f"SELECT *, '{t}_passed' AS metric, CAST({t} AS DOUBLE) AS value FROM c WHERE {t} > 0" for t in TESTS
)
_FIXED = " UNION ALL ".join(
    f"SELECT *, '{m}', CAST({v} AS DOUBLE) FROM c"
    for m, v in [
        ("mark", "mark"), ("virtualMark", "NULL"), ("prerequisitesMark", "NULL"),
        ("stylePenalty", "NULL"), ("styleFatal", "NULL"), ("styleMajor", "NULL"),
        ("styleMinor", "NULL"), ("styleInfo", "k_sum"),
    ]
)


@query(
    f"""WITH {SQL_CELLS}, c AS (SELECT entity, grp, 'U' || CAST(floor(step_idx / 7e0) AS BIGINT) AS unit,
      'day' || lpad(CAST(step_idx + 1 AS VARCHAR), 2, '0') AS step, mark, k_sum, {", ".join(TESTS)} FROM cells)
    SELECT entity, grp, unit, step, metric, round(value, 6) AS value FROM ({_PRESENT} UNION ALL {_FIXED})"""
)
def documents_flattened(spark, sf_dir):
    """Nested result documents, one per user and day, taken apart into long rows."""
    from cohortlens.sources.documents import RESULT_SCHEMA, document_records, project_table

    origin, _ = axis(spark, sf_dir)
    rows = cells(spark, sf_dir, origin)
    tasks = F.filter(
        F.array(*[
            F.struct(F.lit(t).alias("k"), F.array(F.struct(F.col(t).alias("passed"))).alias("v"))
            for t in TESTS
        ]),
        lambda e: e["v"][0]["passed"] > 0,
    )
    no_value = F.lit(None).cast("double")
    info = F.struct(*[no_value.alias(c) for c in ("fatal", "major", "minor")],
                    F.col("k_sum").alias("info"))
    penalty = F.struct(F.struct(no_value.alias("value")).alias("Penalty"))
    summary = F.struct(info.alias("value"), penalty.alias("penalty"))
    result = F.struct(
        F.col("mark").alias("mark"),
        no_value.alias("virtualMark"),
        no_value.alias("prerequisitesMark"),
        F.struct(F.struct(F.array("entity").alias("members")).alias("group")).alias("properties"),
        F.map_from_entries(tasks).alias("skillBreakdowns"),
        F.struct(F.struct(summary.alias("summary")).alias("CodingStyleSummary")).alias("style"),
    )
    day = F.lpad((F.col("step_idx") + 1).cast("string"), 2, "0")
    path = F.concat(F.lit("/landing/U"), F.floor(F.col("step_idx") / 7), F.lit("_day"), day,
                    F.lit("_"), "grp", F.lit("-"), "user_id", F.lit(".json"))
    kind = RESULT_SCHEMA.split(None, 1)[1]
    docs = rows.select(path.alias("path"), F.array(result).cast(kind).alias("results"))
    return project_table(document_records(docs))


@query(
    """SELECT user_id, day, event_id, event_type, value FROM (
      SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_id, event_type, round(value, 6) AS value,
        row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS r FROM events)
      WHERE r = 1"""
)
def dedup_first_defined(spark, sf_dir):
    """First row per key in a defined order."""
    events = table(spark, sf_dir, "events").select(
        "user_id", F.to_date("ts").cast("string").alias("day"), "ts", "event_id", "event_type", "value"
    )
    return frames.first_by(events, ["user_id", "day"], ["ts", "event_id"]).drop("ts")


@query(
    """SELECT c_custkey AS id, c_nationkey AS nation, c_acctbal AS balance, NULL AS segment, 'supplier' AS kind
       FROM (SELECT s_suppkey AS c_custkey, CAST(s_nationkey AS BIGINT) AS c_nationkey, round(s_acctbal, 6) AS c_acctbal FROM supplier)
       UNION ALL SELECT c_custkey, CAST(c_nationkey AS BIGINT), round(c_acctbal, 6), c_mktsegment, 'customer' FROM customer"""
)
def union_missing_columns(spark, sf_dir):
    """Vertical concat with the union of the schemas."""
    c = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_nationkey").alias("nation"),
        F.col("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("segment"),
        F.lit("customer").alias("kind"),
    )
    s = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"),
        F.col("s_nationkey").alias("nation"),
        F.col("s_acctbal").alias("balance"),
        F.lit("supplier").alias("kind"),
    )
    return frames.stack_tables([c, s])


@query(
    f"""WITH {SQL_LONG}, a AS (SELECT * FROM long WHERE grp <> 'G0' OR metric <> 'view_passed'),
    y AS (SELECT *, CASE WHEN grp = 'G0' THEN 0 ELSE 1 END AS part FROM a),
    shared AS (SELECT unit, step, metric FROM y GROUP BY ALL HAVING count(DISTINCT part) = 2)
    SELECT metric, count(*) AS n, round(sum(value), 2) AS total FROM y JOIN shared USING (unit, step, metric) GROUP BY metric"""
)
def union_common_columns(spark, sf_dir):
    """Two tables stacked on the columns both have."""
    long = long_table(spark, sf_dir, reused=True)
    first = long.where((F.col("grp") == "G0") & (F.col("metric") != "view_passed"))
    second = long.where(F.col("grp") != "G0")
    both = frames.common_metrics([first, second])
    return both.groupBy("metric").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")
    )


@query(
    f"""WITH {SQL_LONG}, first AS (SELECT DISTINCT unit, step, metric FROM long WHERE grp = 'G0' AND metric <> 'view_passed'),
    second AS (SELECT DISTINCT unit, step, metric FROM long WHERE grp <> 'G0' AND unit <> 'U4')
    SELECT *, 'first' AS side FROM (SELECT * FROM first EXCEPT SELECT * FROM second)
    UNION ALL SELECT *, 'second' FROM (SELECT * FROM second EXCEPT SELECT * FROM first)
    UNION ALL SELECT *, 'both' FROM (SELECT * FROM first INTERSECT SELECT * FROM second)"""
)
def schema_diff(spark, sf_dir):
    """Columns two tables share and columns only one has."""
    long = long_table(spark, sf_dir)
    cols = ["unit", "step", "metric"]
    in_first = (F.col("grp") == "G0") & (F.col("metric") != "view_passed")
    in_second = (F.col("grp") != "G0") & (F.col("unit") != "U4")
    seen = long.groupBy(*cols).agg(F.max(in_first).alias("a"), F.max(in_second).alias("b"))
    side = (
        F.when(F.col("a") & F.col("b"), F.lit("both"))
        .when(F.col("a"), F.lit("first"))
        .when(F.col("b"), F.lit("second"))
    )
    return seen.select(*cols, side.alias("side")).where(F.col("side").isNotNull())


@query(
    f"""WITH p AS (SELECT event_id, {_PATH} AS stem FROM events)
    SELECT event_id, regexp_replace(stem, '_[^_]*$', '') AS prefix,
      upper(trim(split_part(split_part(stem, '_', 3), '-', 1))) AS city,
      split_part(stem, '-', 2) AS place FROM p"""
)
def prefix_city_tokens(spark, sf_dir):
    """Project prefix and site token of a file name."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    n = F.col("event_id")
    stem = F.concat(
        F.lit("U"), n % 3, F.lit("_step"), n % 5, F.lit("_"),
        F.upper(F.substring("event_type", 1, 2)), F.lit("-"), n % 4, F.lit("-1"),
    )
    return e.withColumn("stem", stem).select(
        "event_id",
        text.project_prefix(F.col("stem")).alias("prefix"),
        text.city_token(F.col("stem")).alias("city"),
        F.split_part("stem", F.lit("-"), F.lit(2)).alias("place"),
    )


@query(
    """SELECT page_id, coalesce(nullif(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), ''), 'unknown') AS safe,
      regexp_replace(html, '[^A-Za-z0-9._-]+', '_', 'g') || '_' || page_id AS target FROM pages"""
)
def sanitize_names(spark, sf_dir):
    """Safe file names from arbitrary text."""
    p = table(spark, sf_dir, "pages")
    target = F.concat_ws("_", text.sanitize(F.col("html")), F.col("page_id"))
    return p.select("page_id", text.sanitize(F.col("url")).alias("safe"), target.alias("target"))


@query(
    """WITH links AS (SELECT page_id, CASE page_id % 3
        WHEN 0 THEN 'https://drive.example.org/file/d/' || split_part(url, '/', 5) || '/view'
        WHEN 1 THEN 'https://drive.example.org/uc?export=x&id=' || split_part(url, '/', 5) || '&confirm=t'
        ELSE url END AS link FROM pages)
    SELECT page_id, CASE WHEN contains(link, '/file/d/') THEN split_part(split_part(link, '/file/d/', 2), '/', 1)
       WHEN contains(link, 'id=') THEN split_part(split_part(link, 'id=', 2), '&', 1) END AS id FROM links"""
)
def url_id_extract(spark, sf_dir):
    """File id of a sharing link."""
    part = F.split_part("url", F.lit("/"), F.lit(5))
    link = (
        F.when(F.col("page_id") % 3 == 0,
               F.concat(F.lit("https://drive.example.org/file/d/"), part, F.lit("/view")))
        .when(F.col("page_id") % 3 == 1,
              F.concat(F.lit("https://drive.example.org/uc?export=x&id="), part, F.lit("&confirm=t")))
        .otherwise(F.col("url"))
    )
    pages = table(spark, sf_dir, "pages").select("page_id", link.alias("link"))
    return pages.select("page_id", text.share_id(F.col("link")).alias("id"))


@query(
    """SELECT c_custkey, split_part(split_part(addr, '.', 2), '@', 1) AS token FROM (
        SELECT c_custkey, 'c.' || lower(c_mktsegment) || (c_custkey % 9) || '@mail.example.org' AS addr FROM customer)
       WHERE split_part(split_part(addr, '.', 2), '@', 1) IN
         (SELECT lower(c_mktsegment) || c_nationkey FROM customer WHERE c_acctbal > 5000)"""
)
def token_semi_join(spark, sf_dir):
    """Rows whose name token is in a list held as a table."""
    customers = table(spark, sf_dir, "customer")
    address = F.concat(
        F.lit("c."), F.lower("c_mktsegment"), F.col("c_custkey") % 9, F.lit("@mail.example.org")
    )
    listed = customers.where(F.col("c_acctbal") > 5000).select(
        F.concat(F.lower("c_mktsegment"), F.col("c_nationkey")).alias("token")
    )
    people = customers.select("c_custkey", text.name_token(address).alias("token"))
    return people.join(listed.distinct(), "token", "left_semi")


_RAW = """CASE event_id % 8 WHEN 0 THEN CAST(value AS VARCHAR) WHEN 1 THEN '  ' || CAST(event_id AS VARCHAR) || ' '
   WHEN 2 THEN event_type WHEN 3 THEN CAST(event_id AS VARCHAR) || 'd' WHEN 4 THEN '' WHEN 5 THEN '1e3'
   WHEN 6 THEN '-.5' ELSE '3.' END"""


@query(
    f"""SELECT event_id, round(CASE WHEN regexp_matches(trim(raw), '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$')
        THEN TRY_CAST(trim(raw) AS DOUBLE) END, 6) AS num FROM (SELECT event_id, {_RAW} AS raw FROM events)"""
)
def coerce_numeric(spark, sf_dir):
    """Text to number, NULL where it is not one."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    m = F.col("event_id") % 8
    raw = (
        F.when(m == 0, F.col("value").cast("string"))
        .when(m == 1, F.concat(F.lit("  "), F.col("event_id"), F.lit(" ")))
        .when(m == 2, F.col("event_type"))
        .when(m == 3, F.concat(F.col("event_id"), F.lit("d")))
        .when(m == 4, F.lit(""))
        .when(m == 5, F.lit("1e3"))
        .when(m == 6, F.lit("-.5"))
        .otherwise(F.lit("3."))
    )
    return e.select("event_id", text.to_number(raw).alias("num"))


_SEL = "WITH {long}, named AS (SELECT *, unit || '_' || step || '_' || metric AS name FROM long) SELECT name, count(*) AS n, round(sum(value), 2) AS total FROM named WHERE {cond} GROUP BY name"


def _by_name(long, cond):
    name = names.wide_name(F.col("unit"), F.col("step"), F.col("metric"))
    return (
        long.withColumn("name", name)
        .where(cond(F.col("name")))
        .groupBy("name")
        .agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    )


@query(_SEL.format(long=SQL_LONG, cond="name LIKE 'U0%' OR name LIKE 'U2%'"))
def select_by_prefix(spark, sf_dir):
    """Columns that start with one of several prefixes."""
    prefixes = ["U0", "U2"]
    return _by_name(long_table(spark, sf_dir), lambda n: names.starts_with_any(n, prefixes))


@query(_SEL.format(long=SQL_LONG, cond="regexp_matches(name, '^u1_day[0-9]+_(click|view)_passed$', 'i')"))
def select_by_regex(spark, sf_dir):
    """Columns whose whole name matches, in any case."""
    return _by_name(
        long_table(spark, sf_dir), lambda n: n.rlike(r"(?i)^u1_day\d+_(click|view)_passed$")
    )


@query(_SEL.format(long=SQL_LONG, cond="name LIKE 'U3%' OR name IN ('U0_day01_mark', 'U1_day08_mark')"))
def union_of_prefix_and_kept(spark, sf_dir):
    """Columns by prefix, and a list of others that are kept."""
    keep = text.option_list(F.lit("U0_day01_mark, U1_day08_mark,,"))
    return _by_name(
        long_table(spark, sf_dir),
        lambda n: names.starts_with_any(n, ["U3"]) | F.array_contains(keep, n),
    )


@query(
    """SELECT lang || '_' || split_part(source, 'c', 2) AS project, count(DISTINCT lang || source) AS files, count(*) AS n
       FROM documents GROUP BY 1"""
)
def file_group_stats(spark, sf_dir):
    """Files and rows per project."""
    d = table(spark, sf_dir, "documents").select("lang", "source")
    stem = F.concat_ws("_", F.col("lang"), F.regexp_replace("source", "^src", ""), F.col("source"))
    per_file = d.groupBy(stem.alias("stem")).agg(F.count("*").alias("rows"))
    return per_file.groupBy(text.project_prefix(F.col("stem")).alias("project")).agg(
        F.count("*").alias("files"), F.sum("rows").alias("n")
    )


@query(
    """SELECT o_orderkey AS id, o_custkey AS code, o_orderpriority AS slug, o_orderstatus AS instance
       FROM orders WHERE year(o_orderdate) = 1998 AND o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')"""
)
def listing_flatten_filter(spark, sf_dir):
    """Listing pages to one row per activity, filtered by year, source and unit."""
    from cohortlens.sources.documents import filter_listing, flatten_listing

    orders = table(spark, sf_dir, "orders")
    entry = F.struct(
        F.col("o_orderkey").alias("id"),
        F.struct(F.col("o_custkey").alias("code")).alias("unitTemplate"),
        F.struct(F.col("o_orderpriority").alias("slug")).alias("projectTemplate"),
        F.struct(F.col("o_orderstatus").alias("instanceCode")).alias("instance"),
    )
    pages = orders.select(
        F.year("o_orderdate").alias("year"), F.array(entry).alias("activities")
    )
    listed = flatten_listing(pages, keep=["year"])
    return filter_listing(
        listed, year=1998, source="F", units=["1-URGENT", "2-HIGH"],
        columns={"year": "year", "source": "instance", "unit": "slug"},
    ).drop("year")


@query(
    f"WITH {SQL_CELLS} SELECT CAST(step_idx AS BIGINT) AS step_idx, count(*) AS n FROM cells WHERE step_idx < least(12, (SELECT n FROM n_steps)) GROUP BY step_idx"
)
def horizon_cap(spark, sf_dir):
    """Steps up to a horizon."""
    from cohortlens.operators.horizon import check_horizon

    origin, n_steps = axis(spark, sf_dir)
    upto = check_horizon(12, n_steps)
    rows = cells(spark, sf_dir, origin).where(F.col("step_idx") < upto)
    return rows.groupBy("step_idx").agg(F.count("*").alias("n"))


_NULLS = f"""WITH {SQL_LONG}, width AS (SELECT count(*) AS w FROM (SELECT DISTINCT unit, step, metric FROM long)),
  nulls AS (SELECT entity, grp, (SELECT w FROM width) - count(value) AS n_null FROM long GROUP BY entity, grp)"""


@query(f"{_NULLS} SELECT entity, grp, metric, count(*) AS n, round(sum(value), 2) AS total FROM long JOIN nulls USING (entity, grp) WHERE n_null < 20 GROUP BY ALL")
def null_count_filter(spark, sf_dir):
    """Entities with few missing values."""
    kept = frames.keep_filled(long_table(spark, sf_dir, reused=True), 20)
    return kept.groupBy("entity", "grp", "metric").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")
    )


@query(f"{_NULLS} SELECT entity, grp, n_null FROM nulls ORDER BY n_null DESC, entity LIMIT 20")
def null_count_topk(spark, sf_dir):
    """The entities with most missing values."""
    counts = frames.null_counts(long_table(spark, sf_dir, reused=True))
    return counts.orderBy(F.desc("n_null"), "entity").limit(20)


@query(
    f"""WITH {SQL_LONG}, m AS (SELECT unit, step, metric, avg(value) AS mean FROM long WHERE metric LIKE '%mark' GROUP BY ALL)
    SELECT l.entity, l.grp, l.unit, l.step, CAST(l.step_idx AS BIGINT) AS step_idx, l.metric,
      round(CASE WHEN l.metric LIKE '%mark' THEN CASE WHEN mean = 0 THEN NULL ELSE value / mean END ELSE value END, 6) AS value
    FROM long l LEFT JOIN m USING (unit, step, metric)"""
)
def mark_normalise(spark, sf_dir):
    """Marks divided by the mean of their column."""
    return frames.normalise_marks(long_table(spark, sf_dir, reused=True))


_STATS = f"""WITH {SQL_LONG}, st AS (SELECT step, metric, min(value) AS lo, max(value) AS hi, avg(value) AS mean,
   stddev_pop(value) AS sd FROM long GROUP BY ALL) SELECT entity, step, metric, {{e}} AS value FROM long JOIN st USING (step, metric)"""


@query(_STATS.format(e="round(CASE WHEN hi = lo THEN 0e0 ELSE (value - lo) / (hi - lo) END, 6)"))
def minmax_by_step(spark, sf_dir):
    """Columns scaled to [0, 1]."""
    long = long_table(spark, sf_dir, reused=True).select("entity", "step", "metric", "value")
    return clusters.min_max(long, ["step", "metric"])


@query(_STATS.format(e="round((value - mean) / CASE WHEN sd = 0 THEN 1e0 ELSE sd END, 6) + 0e0"))
def standardise(spark, sf_dir):
    """Columns with zero mean and unit deviation."""
    long = long_table(spark, sf_dir, reused=True).select("entity", "step", "metric", "value")
    return clusters.standardise(long, ["step", "metric"])


@query(f"WITH {SQL_LONG} SELECT entity, step, metric, CASE WHEN value <> 0 THEN 1 ELSE 0 END::BIGINT AS bit FROM long WHERE metric LIKE '%passed'")
def bool_int(spark, sf_dir):
    """Test results as 0 or 1."""
    tests = long_table(spark, sf_dir).where(names.is_test(F.col("metric")))
    return tests.select("entity", "step", "metric", frames.to_bit(F.col("value")).alias("bit"))


@query(
    """WITH raw AS (SELECT o_custkey, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents FROM orders GROUP BY 1)
    SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS nation, round(CAST(cents AS DOUBLE) / 100, 6) AS total_mark
    FROM customer LEFT JOIN raw ON o_custkey = c_custkey"""
)
def left_restore(spark, sf_dir):
    """Mark columns of a scored table replaced by the raw ones."""
    scored = table(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("total_mark")
    )
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    raw = (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg((F.sum(cents) / 100.0).alias("total_mark"))
    )
    return frames.restore_marks(scored, raw, ["c_custkey"])


@query(
    """SELECT o_orderkey, c_mktsegment AS prediction FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal > 0"""
)
def inner_predictions(spark, sf_dir):
    """Rows joined to their predictions."""
    preds = table(spark, sf_dir, "customer").where(F.col("c_acctbal") > 0).select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("prediction")
    )
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return rows.join(preds, "o_custkey").select("o_orderkey", "prediction")


@query("SELECT CAST(label AS BIGINT) AS label, count(*) AS n FROM embeddings GROUP BY label")
def cluster_sizes(spark, sf_dir):
    """Members of each cluster."""
    return clusters.cluster_sizes(table(spark, sf_dir, "embeddings"), "label")


@query("SELECT event_type, hour(ts) AS hour, count(*) AS n FROM events GROUP BY ALL")
def distinct_hist(spark, sf_dir):
    """Distinct values with their counts."""
    e = table(spark, sf_dir, "events").select("event_type", F.hour("ts").alias("hour"))
    return e.groupBy("event_type", "hour").agg(F.count("*").alias("n"))


@query(f"WITH {SQL_CELLS} SELECT entity, round(CAST(sum(cents) AS DOUBLE) / count(*) / 100, 6) AS mark FROM cells GROUP BY entity")
def row_mean_marks(spark, sf_dir):
    """Mean of an entity's marks, missing ones left out."""
    origin, _ = axis(spark, sf_dir)
    rows = cells(spark, sf_dir, origin)
    return rows.groupBy("entity").agg(
        (F.sum("cents").cast("double") / F.count("cents") / 100).alias("mark")
    )


_EXPECT = [(f"U{i // 7}", f"day{i + 1:02d}") for i in range(32) if i % 5]


@query(
    f"WITH {SQL_CELLS}, want AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{u}', '{s}', {i})" for i, (u, s) in enumerate(_EXPECT))
    + """) v(unit, step, step_idx)), have AS (SELECT 'U' || CAST(floor(step_idx / 7e0) AS BIGINT) AS unit,
       'day' || lpad(CAST(step_idx + 1 AS VARCHAR), 2, '0') AS step, count(*) AS n FROM cells GROUP BY 1, 2)
    SELECT unit, step, CAST(step_idx AS BIGINT) AS step_idx, coalesce(n, 0) AS n, n IS NULL AS missing
    FROM want LEFT JOIN have USING (unit, step)"""
)
def expected_steps(spark, sf_dir):
    """Tables found and missing out of an ordered list of expected ones."""
    steps = spark.createDataFrame(frames.step_axis(_EXPECT), "unit string, step string, step_idx int")
    long = long_table(spark, sf_dir).where(F.col("metric") == "mark")
    found, missing = frames.merge_expected(long, steps)
    keys = ["unit", "step", "step_idx"]
    have = found.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("missing", F.lit(False))
    return have.unionByName(missing.select(*keys, F.lit(0).alias("n"), F.lit(True).alias("missing")))
