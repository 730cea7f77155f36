import json

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import frames
from cohortlens.plans import loading
from cohortlens.sinks import tables as sinks
from cohortlens.sources import documents, tables
from cohortlens.streaming import landing


def result(members, tasks, mark=1.0, style=None):
    doc = {
        "mark": mark, "virtualMark": 2.0, "prerequisitesMark": 0.5,
        "properties": {"group": {"members": members}},
        "skillBreakdowns": {t: [{"passed": p}] if p is not None else [] for t, p in tasks.items()},
    }
    if style:
        doc["style"] = {"CodingStyleSummary": {"summary": {
            "value": {"fatal": 0, "major": style, "minor": 1, "info": 2},
            "penalty": {"Penalty": {"value": -1.5}}}}}
    return doc


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "docs"
    (root / "U1").mkdir(parents=True)
    files = {
        "U1/U1_alpha_TSE-1-1.json": [
            result(["s1@x", "s2@x"], {"01 - task01": 1, "02 - task02": 0}, 3.0, style=4),
            result([], {"03 - ghost": 1}),
            {"mark": 9, "skillBreakdowns": {"01 - task01": [{"passed": 1}]}},
            result(["s3@x"], {"01 - task01": None}, None),
            result(["s1@x"], {"01 - task01": 5}, 8.0),
        ],
        "U1/U1_alpha_NCY-1-1.json": [result(["s1@x"], {"01 - task01": 1}, 4.0)],
        "U1/U1_beta_TSE-1-1.json": [result(["s1@x"], {"07 - Success of task01": 2}, 2.5)],
        "U1/U1_empty_TSE-1-1.json": [result(["s1@x"], {}, 1.0)],
    }
    for name, results in files.items():
        (root / name).write_text(json.dumps({"results": results}, indent=1))
    (root / "U1_broken_TSE-1-1.json").write_text("{not json")
    return str(root)


STEPS = [("U1", "alpha"), ("U1", "gamma"), ("U1", "beta")]


def load(spark, folder):
    return loading.load_documents(spark, folder, loading.step_table(spark, STEPS))


def test_documents_to_long(spark, folder):
    loaded = load(spark, folder)
    assert [r.path.endswith("U1_broken_TSE-1-1.json") for r in loaded.unreadable.collect()] == [True]
    assert [(r.unit, r.step) for r in loaded.missing_steps.collect()] == [("U1", "gamma")]
    got = {(r.entity, r.grp, r.step, r.metric): r.value for r in loaded.long.collect()}
    # The first record of a student and site counts, with the whole document's tasks.
    assert got[("s1@x", "TSE", "alpha", "mark")] == 3.0
    assert got[("s1@x", "TSE", "alpha", "03 - ghost_passed")] == 0.0
    assert got[("s3@x", "TSE", "alpha", "01 - task01_passed")] == 0.0
    assert got[("s3@x", "TSE", "alpha", "mark")] is None
    assert got[("s1@x", "TSE", "alpha", "styleMajor")] == 4.0
    assert got[("s1@x", "TSE", "alpha", "stylePenalty")] == -1.5
    assert got[("s1@x", "NCY", "alpha", "styleMajor")] is None
    assert ("s1@x", "NCY", "alpha", "02 - task02_passed") not in got
    assert ("s1@x", "TSE", "empty", "mark") not in got
    assert {k[2] for k in got} == {"alpha", "beta"}


def test_master_round_trip(spark, folder, tmp_path):
    loaded = load(spark, folder)
    wide = loading.master_table(loaded.long)
    row = wide.where("email = 's1@x' AND city = 'TSE'").first()
    assert row["U1_alpha_mark"] == 3.0 and row["U1_beta_mark"] == 2.5
    assert wide.count() == 4
    path = str(tmp_path / "master.csv")
    sinks.write_csv(wide, path)
    back = loading.read_master(spark, path)
    keys = ["entity", "grp", "unit", "step", "metric", "value"]
    want = loaded.long.where("value IS NOT NULL").select(*keys)
    assert sorted(map(tuple, back.where("value IS NOT NULL").select(*keys).collect())) == sorted(
        map(tuple, want.collect())
    )
    assert {(r.step, r.step_idx) for r in back.select("step", "step_idx").distinct().collect()} == {
        ("alpha", 0), ("beta", 1),
    }


def test_store(spark, folder, tmp_path):
    with pytest.warns(UserWarning, match="U1_gamma"):
        out = loading.store_long(load(spark, folder), str(tmp_path / "long"))
    assert out.columns == frames.LONG and out.where("step = 'beta'").count() > 0
    none = loading.load_documents(spark, folder, loading.step_table(spark, [("U9", "x")]))
    with pytest.warns(UserWarning), pytest.raises(ValueError):
        loading.store_long(none, str(tmp_path / "none"))


def test_cells(spark, folder):
    cells, attrs, tests = loading.step_cells(load(spark, folder).long)
    assert tests == ["t0", "t1", "t2"]
    row = cells.where("entity = 's1@x|TSE' AND step_idx = 2").first()
    assert (row.mark, row.t0, row.t1, row.virtualMark) == (2.5, 2.0, 0.0, 2.0)


def test_project_lists(spark):
    assert [len(loading.PROJECTS[y]) for y in (2024, 2025)] == [24, 13]
    assert loading.step_table(spark, loading.PROJECTS[2024]).where("step = '42sh'").first().step_idx == 23


def test_glob_filter(spark, folder):
    docs, _ = documents.read_documents(spark, folder, "U1_alpha_*")
    assert docs.count() == 2


def test_listing(spark, tmp_path):
    pages = [
        {"activities": [
            {"id": 1, "unitTemplate": {"code": "U1"}, "projectTemplate": {"slug": "été à"}, "instance": {"instanceCode": "T-1"}},
            {"id": 2, "unitTemplate": {"code": "U2"}, "projectTemplate": {"slug": ""}, "instance": {}},
        ], "hasNextPage": True},
        {"activities": [], "hasNextPage": False},
    ]
    for i, page in enumerate(pages):
        (tmp_path / f"p{i}.json").write_text(json.dumps(page))
    rows = documents.with_target(documents.flatten_listing(documents.read_listing(spark, str(tmp_path))))
    assert [(r.id, r.target) for r in rows.orderBy("id").collect()] == [
        (1, "U1__t__T-1"), (2, "U2_unknown_None"),
    ]


def test_csv_sites(spark, tmp_path):
    a, b = tmp_path / "U_p_AAA-1.csv", tmp_path / "U_p_BBB-1.csv"
    a.write_text("email,x\ns1,1\ns2,2\n")
    b.write_text("email,city,y\ns1,,3\ns3,ZZZ,4\n")
    out = tables.read_sites(spark, [str(a), str(b)])
    assert out.columns == ["email", "city", "x", "y"]
    assert sorted((r.email, r.city, r.x, r.y) for r in out.collect() if r.x) == [
        ("s1", "AAA", 1, None), ("s2", "AAA", 2, None),
    ]
    assert {(r.email, r.city) for r in out.where("y IS NOT NULL").collect()} == {("s1", "BBB"), ("s3", "ZZZ")}
    names, n, head = tables.probe(spark, str(a))
    assert (names, n, head.count()) == (["email", "x"], 2, 2)


def test_csv_sites_by_header(spark, tmp_path):
    """50 files with three headers are three scans, and one job that looks at the headers."""
    heads = ["email,x", 'email,"a, b",x', "email,city,y"]
    rows = ["s{0},{0}", "s{0},True,{0}", "s{0},,nan"]
    paths = []
    for i in range(50):
        path = tmp_path / f"U_p q+é_C{i}-1.csv"
        path.write_text("".join(f"{line}\n" for line in [heads[i % 3], rows[i % 3].format(i), rows[i % 3].format(i)]))
        paths.append(str(path))
    (tmp_path / "U_p_EMPTY-1.csv").write_text("")
    assert [(c, len(f)) for c, f in tables.headers(spark, paths)] == [
        (["email", "x"], 17), (["email", "a, b", "x"], 17), (["email", "city", "y"], 16),
    ]
    out = tables.read_sites(spark, [*paths, str(tmp_path / "U_p_EMPTY-1.csv")])
    assert out.columns == ["email", "city", "x", "a, b", "y"]
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan csv") == 3
    got = sorted(tuple(r) for r in out.fillna(-1.0).collect())
    assert got == sorted(
        (f"s{i}", f"C{i}", -1.0 if i % 3 == 2 else float(i), 1.0 if i % 3 == 1 else -1.0, -1.0) for i in range(50) for _ in "ab"
    )
    bad = tmp_path / "U_p_BAD-1.csv"
    bad.write_text("email,x\ns,many\n")
    with pytest.raises(Exception, match="no number in column x: many"):
        tables.read_sites(spark, [str(bad)]).collect()
    with pytest.raises(ValueError):
        tables.read_sites(spark, [str(tmp_path / "U_p_EMPTY-1.csv")])


def test_artefacts(spark):
    want = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int")
    have = spark.createDataFrame([("a", 1)], "k string, n int")
    with pytest.raises(FileNotFoundError, match="b"):
        tables.require_artefacts(want, have, ["k", "n"])
    tables.require_artefacts(have, want, ["k", "n"])


def test_table_sink(spark, tmp_path):
    df = spark.createDataFrame([("s2", "X", "1e1", "n"), ("s1", "Y", "b", "m")], "email string, city string, A_1 string, B_1 string")
    path = str(tmp_path / "t")
    sinks.publish(df, ["A"], ["email", "absent"], path=path, keys=["email", "absent"])
    out = spark.read.parquet(path)
    assert out.columns == ["email", "A_1"]
    assert [tuple(r) for r in out.orderBy("email").collect()] == [("s1", None), ("s2", 10.0)]
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.write_table(df, path=path)
    sinks.write_table(df, path=path, if_exists="replace")
    sinks.write_table(df, path=path, if_exists="append")
    assert spark.read.parquet(path).count() == 4
    sinks.write_table(df, name="traces_b", if_exists="replace", keys=["email"], buckets=4)
    assert spark.table("traces_b").count() == 2


def test_step_and_document_sinks(spark, tmp_path):
    df = spark.range(6).select(F.col("id"), (F.col("id") % 3).cast("int").alias("step_idx"))
    sinks.write_steps(df, str(tmp_path / "s"))
    assert tables.read_steps(spark, str(tmp_path / "s"), [1]).count() == 2
    docs = spark.createDataFrame([("c", "s", "i", 1)], "code string, slug string, instance string, mark int")
    sinks.write_documents(docs, str(tmp_path / "d"))
    assert (tmp_path / "d" / "code=c" / "slug=s" / "instance=i").is_dir()


def test_stream(spark, folder, tmp_path):
    log, mark = str(tmp_path / "log"), str(tmp_path / "cp")

    def drain():
        q = landing.land(landing.document_stream(spark, folder), log, mark)
        q.awaitTermination()

    drain()
    first = landing.current(spark, log)
    n = first.where("metric = 'mark'").count()
    assert n == 5
    # A later document of the same project wins; everything else stays.
    later = {"results": [result(["s1@x"], {"07 - Success of task01": 0}, 7.5)]}
    with open(f"{folder}/U1_beta_TSE-9-9.json", "w") as f:
        json.dump(later, f)
    drain()
    now = landing.current(spark, log).where("metric = 'mark'")
    assert now.count() == n
    assert now.where("entity = 's1@x' AND step = 'beta'").first().value == 7.5
    rows = sorted(map(tuple, landing.current(spark, log).collect()), key=str)
    table = str(tmp_path / "table")
    landing.compact(spark, log, table)
    assert sorted(map(tuple, landing.merged(spark, table).collect()), key=str) == rows


def records(target):
    return {str(p.relative_to(target)) for p in (target / "records").rglob("*.parquet")}


def test_compact_rewrites_what_changed(spark, tmp_path):
    log, table = str(tmp_path / "log"), tmp_path / "table"

    def batch(number, rows):
        schema = """entity string, grp string, unit string, step string, landed long, path string, result_pos int,
            member_pos int, cells array<struct<metric: string, value: double>>"""
        made = [(e, g, u, s, at, "p", 0, 0, [("mark", v)]) for e, g, u, s, at, v in rows]
        spark.createDataFrame(made, schema).write.mode("overwrite").parquet(f"{log}/batch={number}")

    def seen():
        return {(r.entity, r.grp, r.unit, r.step): r.value for r in landing.merged(spark, str(table)).collect()}

    with pytest.raises(FileNotFoundError):
        landing.merged(spark, str(table))
    assert landing.compact(spark, log, str(table)) == []
    batch(0, [("a", "g", "U", "1", 1, 1.0), ("b", None, "U", "2", 1, 2.0), ("c", "g", None, "42", 1, 3.0)])
    assert len(landing.compact(spark, log, str(table))) == 3
    first = records(table)
    state = {("a", "g", "U", "1"): 1.0, ("b", None, "U", "2"): 2.0, ("c", "g", None, "42"): 3.0}
    assert seen() == state and landing.compact(spark, log, str(table)) == [] and records(table) == first
    # one partition changes: its rows of old are kept, an older record loses, nothing else is written
    batch(1, [("a", "g", "U", "1", 0, 9.0), ("d", "g", "U", "1", 2, 4.0)])
    assert landing.compact(spark, log, str(table)) == [("U", "1")]
    state |= {("d", "g", "U", "1"): 4.0}
    assert seen() == state
    added = records(table) - first
    assert added and all("unit=U/step=1/" in p for p in added) and first <= records(table)
    assert not (tmp_path / "log" / "batch=0").exists() and not (tmp_path / "log" / "batch=1").exists()
    # a batch without its mark waits; a generation without a manifest counts for nothing
    batch(2, [("b", None, "U", "2", 3, 8.0)])
    (tmp_path / "log" / "batch=2" / "_SUCCESS").unlink()
    assert landing.compact(spark, log, str(table)) == [] and seen() == state
    (tmp_path / "log" / "batch=2" / "_SUCCESS").touch()
    (table / "records" / "gen=3" / "unit=U" / "step=2").mkdir(parents=True)
    landing.compact(spark, log, str(table))
    assert seen() == state | {("b", None, "U", "2"): 8.0}
    assert {r.entity for r in landing.merged(spark, str(table), ["U"]).collect()} == {"a", "b", "d"}
    # a batch that runs again after it was merged changes nothing
    batch(1, [("a", "g", "U", "1", 0, 9.0), ("d", "g", "U", "1", 2, 4.0)])
    assert landing.compact(spark, log, str(table)) == [] and not (tmp_path / "log" / "batch=1").exists()


def test_zero_fill(spark):
    rows = [("f1", "a", "t1", 2), ("f1", "b", "t2", 3), ("f2", "a", "t3", 1)]
    df = spark.createDataFrame(rows, "file string, who string, task string, n int")
    out = documents.zero_fill(df, "file", ["who"], "task", "n")
    assert sorted(map(tuple, out.collect())) == [
        ("f1", "a", "t1", 2), ("f1", "a", "t2", 0), ("f1", "b", "t1", 0), ("f1", "b", "t2", 3), ("f2", "a", "t3", 1),
    ]


def test_fill_group(spark):
    df = spark.createDataFrame([("a", None), ("b", "Z")], "email string, city string")
    assert sorted(map(tuple, frames.fill_group(df, F.lit("Q")).collect())) == [("a", "Q"), ("b", "Z")]
    assert frames.fill_group(df.drop("city"), F.lit("Q")).columns == ["email", "city"]
