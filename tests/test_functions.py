from pyspark.sql import functions as F

from cohortlens.functions import names, sets, text


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first().asDict()


def column(spark, values, kind, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


def test_file_tokens(spark):
    stems = ["B-CPE-110_secured_TSE-3-2", "plain", "U_p_ ncy-1"]
    assert column(spark, stems, "string", text.project_prefix) == ["B-CPE-110_secured", "plain", "U_p"]
    assert column(spark, stems, "string", text.city_token) == ["TSE", "", "NCY"]
    assert column(spark, ["/a/b/U_p_X-1.json", "x.csv"], "string", text.file_stem) == ["U_p_X-1", "x"]
    assert column(spark, ["x_12", "x_y", "7"], "string", text.suffix_int) == [12, None, 7]


def test_sanitize(spark):
    assert column(spark, ["a b/é-c", "", None, "ok.v_1"], "string", text.sanitize) == [
        "a_b_-c", "unknown", "None", "ok.v_1",
    ]


def test_share_id(spark):
    links = [
        "https://d.example.org/file/d/AB_1/view", "https://d.example.org/uc?id=XY&a=1",
        "https://d.example.org/none", "x/file/d/P/view?id=Q",
    ]
    assert column(spark, links, "string", text.share_id) == ["AB_1", "XY", None, "P"]


def test_options_and_tokens(spark):
    assert column(spark, [" a, b,,c ", None], "string", text.option_list) == [["a", "b", "c"], []]
    assert column(spark, ["s.one@example.org", "two"], "string", text.name_token) == ["one", None]


def test_numbers(spark):
    values = ["1e3", " 1 ", "1d", "abc", "", "-.5", "3.", "0x10", "nan", "inf", None]
    got = column(spark, values, "string", text.to_number)
    assert got == [1000, 1, None, None, None, -0.5, 3, None, None, float("inf"), None]


def test_names(spark):
    name = "B-CPE-100_cpoolday01_09 - Success of task01_passed"
    parts = one(
        spark,
        u=names.name_unit(F.lit(name)), s=names.name_step(F.lit(name)), m=names.name_metric(F.lit(name)),
    )
    assert parts == {"u": "B-CPE-100", "s": "cpoolday01", "m": "09 - Success of task01_passed"}
    raw = "B-CPE-100_cpoolday01_01 - task01_passed"
    both = [name, raw, name.upper()]
    assert column(spark, both, "string", lambda c: c.rlike(names.success_pattern("B-CPE-100"))) == [
        True, False, True,
    ]
    assert column(spark, both, "string", lambda c: c.rlike(names.raw_task_pattern("B-CPE-100"))) == [
        False, True, False,
    ]
    marks = ["x_mark", "x_virtualMark"]
    assert column(spark, marks, "string", names.is_mark) == [True, False]
    assert [names.pool_code(y) for y in (2024, 2025)] == ["B-CPE-100", "G-CPE-100"]
    assert column(spark, [2024, 2025], "int", names.pool_code) == ["B-CPE-100", "G-CPE-100"]
    assert names.short_year(2025) == 25


def sets_frame(spark):
    rows = [(0, True, False), (1, False, True), (2, True, True), (3, False, False)]
    return spark.createDataFrame(rows, "i int, a boolean, b boolean")


def test_set_codes(spark):
    df = sets_frame(spark)
    a, b = F.col("a"), F.col("b")
    out = df.select(
        "i", sets.code(a, b).alias("c"), sets.text(a, b).alias("t"), sets.point(a, b).alias("p"),
        sets.width(a, b).alias("w"),
    ).orderBy("i").collect()
    assert [r.c for r in out] == [0, 1, 2, -1]
    assert [r.t for r in out] == ["{0}", "{1}", "{0,1}", "∅"]
    assert [r.p for r in out] == [0, 1, -1, -1]
    assert [r.w for r in out] == [1, 1, 2, 0]


def test_interval_to_set(spark):
    rows = [(0, 0.0, 0.5), (1, 2.0, 3.0), (2, 0.5, 1.5), (3, 0.0, 1.0), (4, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "i int, lo double, hi double")
    has0, has1 = sets.from_interval(F.col("lo"), F.col("hi"), F.lit(1.0))
    got = [(r.a, r.b) for r in df.select("i", has0.alias("a"), has1.alias("b")).orderBy("i").collect()]
    assert got == [(False, True), (True, False), (True, True), (True, True), (True, True)]


def test_gate_label(spark):
    cases = [
        (0, True, False, 1, 1), (1, False, True, 1, 1), (2, True, True, 1, 2), (3, True, True, 2, 1),
        (4, True, True, 1, 1), (5, False, False, 1, 1),
    ]
    df = spark.createDataFrame(cases, "i int, cp boolean, iv boolean, wc int, wi int")
    label = sets.gate_label(F.col("cp"), F.col("iv"), F.col("wc"), F.col("wi"))
    assert [r.g for r in df.select("i", label.alias("g")).orderBy("i").collect()] == [0, 1, 0, 1, 1, 2]


def test_gated_and_names(spark):
    df = spark.createDataFrame([(0, True, False), (1, True, False), (2, True, False)], "g int, a boolean, b boolean")
    out = df.select("g", sets.gated(F.col("g"), F.col("a"), F.col("b")).alias("x"),
                    sets.gate_name(F.col("g")).alias("n")).orderBy("g").collect()
    assert [(r.x, r.n) for r in out] == [(True, "MCP"), (False, "SPCI"), (True, "UNION")]
    labels = spark.createDataFrame([([0],), ([0, 1],), ([],)], "l array<int>")
    h0, h1 = sets.from_labels(F.col("l"))
    assert sorted((r.a, r.b) for r in labels.select(h0.alias("a"), h1.alias("b")).collect()) == [
        (False, False), (True, False), (True, True),
    ]
