"""Intake of checkouts, the control plane, and the layout of text runs."""

import sys

from pyspark.sql import functions as F

from verifold.operators import intake, layout
from verifold.sources import control


def files(spark, rows):
    return spark.createDataFrame([(c, p, bytearray(t.encode())) for c, p, t in rows], "checkout string, relpath string, content binary")


def test_entry_points(spark):
    d = files(spark, [("a", "main.py", ""), ("b", "pyproject.toml", "[project.scripts]\nx='a'\ny='b'"), ("c", "pyproject.toml", "not toml ["), ("d", "n.ipynb", ""), ("e", "sub/main.py", ""), ("f", "README", "")])
    explicit = spark.createDataFrame([("f", ["make"]), ("e", [])], "checkout string, argv array<string>")
    got = {r["checkout"]: (r["source"], r["cause"]) for r in intake.entry_points(d, explicit).collect()}
    assert got == {"a": ("main.py", None), "b": (None, "ENTRYPOINT_AMBIGUOUS"), "c": (None, "ENTRYPOINT_MISSING"), "d": ("notebook", None), "e": (None, "ENTRYPOINT_MISSING"), "f": ("explicit", None)}


def test_environment(spark):
    d = files(spark, [("a", ".python-version", " 3.12 \n"), ("a", "pyproject.toml", "requires-python = '>=3.9'"), ("b", "pyproject.toml", 'requires-python="3.10"'), ("b", "uv.lock", ""), ("c", "requirements.txt", "x")])
    got = {r["checkout"]: tuple(r)[1:] for r in intake.environments(d).collect()}
    assert got == {"a": ("3.12", ".python-version", "best-effort"), "b": ("3.10", "pyproject.toml", "lockfile"), "c": ("3.11", "default", "declared")}


def test_kinds_and_scrubbing(spark):
    kinds = spark.createDataFrame([("x.tar.gz",), ("https://h/r",), ("git@h:r.git",), ("/a/b",)], "l string").select(intake.repo_kind(F.col("l")).alias("k"))
    assert [r["k"] for r in kinds.collect()] == ["archive", "git", "git", "local"]
    env = spark.range(1).select(intake.scrubbed(F.create_map(F.lit("MY_TOKEN"), F.lit("1"), F.lit("PATH"), F.lit("2"))).alias("e")).first()["e"]
    assert env == {"PATH": "2"} and control.scrub({"AUTHOR": "x", "HOME": "y"}) == {"HOME": "y"}


def test_run_process(tmp_path):
    ok = control.run_process([sys.executable, "-c", "print(1)"], str(tmp_path))
    assert (ok["stdout"], ok["failure"]) == (b"1\n", None)
    assert control.run_process([sys.executable, "-c", "raise SystemExit(3)"], str(tmp_path))["failure"] == "WONT_RUN"
    assert control.run_process([sys.executable, "-c", "import time; time.sleep(60)"], str(tmp_path), 0.5)["failure"] == "TIMEOUT"
    assert control.run_process(["/no/such"], str(tmp_path))["failure"] == "WONT_RUN"


def test_git(tmp_path):
    import subprocess

    src = tmp_path / "src"
    src.mkdir()
    git = lambda *a: subprocess.run(["git", "-C", str(src), "-c", "user.name=a", "-c", "user.email=a@b.example", *a], check=True, capture_output=True, text=True).stdout.strip()
    git("init", "-q")
    (src / "f").write_text("1")
    git("add", "f")
    git("commit", "-qm", "one")
    head = git("rev-parse", "HEAD")
    assert control.checkout_git(str(src), None, str(tmp_path / "out")) == head
    assert control.checkout_git(str(src), head[:10], str(tmp_path / "two")) == head


def runs(spark, rows):
    return spark.createDataFrame(rows, "doc int, page int, y double, x double, size double, width double, text string")


def test_lines_and_overlays(spark):
    d = runs(spark, [(1, 1, 700.0, 50.0, 10.0, 5.0, "a"), (1, 1, 697.0, 90.0, 10.0, 5.0, "b"), (1, 1, 680.0, 50.0, 10.0, 5.0, "c"), (1, 1, 0.0, 0.0, 10.0, 5.0, "overlay"), (1, 1, 650.0, 5.0, 9.0, 5.0, "  ")])
    assert [r["text"] for r in layout.lines(d).orderBy("line").collect()] == ["a b", "c"]
    assert layout.line_advance(layout.lines(d)).first()["advance"] == 20.0


def test_mode_takes_the_least_of_ties(spark):
    d = spark.createDataFrame([(1, 9), (1, 9), (1, 8), (1, 8), (1, 7)], "doc int, size int")
    assert layout.mode_of(d, ["doc"], "size").first()["size"] == 8


def test_furniture(spark):
    d = runs(spark, [(1, p, 790.0, 10.0, 8.0, 5.0, f"Journal {p}") for p in (1, 2, 3)] + [(1, p, 400.0, 10.0, 8.0, 5.0, "body") for p in (1, 2, 3)] + [(1, 1, 20.0, 10.0, 8.0, 5.0, "once")])
    pages = spark.createDataFrame([(1, p, 800.0) for p in (1, 2, 3)], "doc int, page int, height double")
    assert {r["text"] for r in layout.furniture(layout.lines(d), pages).collect()} == {"Journal 1", "Journal 2", "Journal 3"}


def test_columns_and_gutter(spark):
    rows = [(1, 1, 700.0 - 12 * i, 50.0 + (i % 2), 10.0, 200.0, "left") for i in range(10)] + [(1, 1, 700.0 - 12 * i, 320.0, 10.0, 200.0, "right") for i in range(10)]
    d = runs(spark, rows)
    columns = layout.x_clusters(d)
    assert [(round(r["center"], 1), r["members"]) for r in columns.orderBy("cluster").collect()] == [(50.5, 10), (320.0, 10)]
    near = layout.nearest_column(runs(spark, [(1, 1, 1.0, 55.0, 1.0, 1.0, "x"), (1, 1, 1.0, 200.0, 1.0, 1.0, "y")]), columns)
    assert {r["text"]: r["cluster"] for r in near.collect()} == {"x": 0, "y": None}
    g = layout.gutter(d, spark.createDataFrame([(1, 1, 570.0)], "doc int, page int, width double")).first()["gutter"]
    assert g == (251.0 + 320.0) / 2


def test_columns_query_rounds_as_its_sql(spark, tmp_path):
    """Pages of 640 runs whose centers are halves of a millionth."""
    import duckdb

    from verifold.plans.intake_queries import QUERIES, SQL

    def page(k, starts):
        return [(k, i, i, (x - k) * pow(13, -1, 3000) % 3000, 1.0) for i, x in enumerate(starts)]

    rows = [r for j in range(1, 640, 2) for r in page(j, [193 + i + (i >= 640 - j) for i in range(640)])]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {tuple(r) for r in QUERIES["layout_columns"](spark, str(tmp_path)).collect()}
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
        assert got == set(c.execute(SQL["layout_columns"]).fetchall())


def test_columns_of_equal_starts(spark):
    """Runs that share a start are in one cluster, however the sort left them."""
    rows = [(1, 1, 700.0, x, 10.0, 1.0, f"{x}-{i}") for i in range(30) for x in (0.0, 5.0, 40.0, 41.0)]
    got = layout.x_clusters(runs(spark, rows).repartition(7)).orderBy("cluster").collect()
    assert [(r["cluster"], r["center"], r["members"]) for r in got] == [(0, 2.5, 60), (1, 40.5, 60)]


def test_headings_and_tables(spark):
    d = runs(spark, [(1, 1, 700.0 - 20 * i, 50.0, 10.0, 5.0, "b") for i in range(20)] + [(1, 2, 700.0 - 20 * i, 50.0, 16.0, 5.0, "h") for i in range(4)] + [(1, 3, 700.0 - 20 * i, 50.0, 12.0, 5.0, "h") for i in range(4)])
    found = layout.lines(d)
    levels = layout.heading_levels(found, layout.mode_of(found, ["doc"], "size"))
    assert {(r["size"], r["level"]) for r in levels.collect()} == {(16.0, 1), (12.0, 2)}
    table = [(1, 1, 700.0 - 20 * i, 50.0 * k, 10.0, 5.0, f"r{i}" if k == 1 else "1") for i in range(4) for k in range(1, 6)] + [(1, 1, 500.0, 50.0, 10.0, 5.0, "prose")]
    region = layout.table_regions(layout.lines(runs(spark, table))).first()
    assert (region["first"], region["last"], region["rows"]) == (0, 3, 4)
    assert spark.range(1).select(layout.render_row(F.array(F.lit("a|b"), F.lit("c"))).alias("r")).first()["r"] == "| a\\|b | c |"


def test_split_capitals(spark):
    d = spark.createDataFrame([(1, i, w) for i, w in enumerate("AN OVA shows ANOVA and NO WAY".split())], "doc int, pos int, word string")
    assert [r["word"] for r in layout.heal_split_capitals(d).orderBy("pos").collect()] == "ANOVA shows ANOVA and NO WAY".split()


def test_pack_is_the_same_each_time(tmp_path):
    import os
    import tarfile

    import pytest

    src = tmp_path / "src"
    (src / "d").mkdir(parents=True)
    (src / "d" / "b").write_text("2")
    (src / "a").write_text("1")
    control.pack(str(src), str(tmp_path / "one.tar.gz"))
    os.utime(src / "a", (1, 1))
    control.pack(str(src), str(tmp_path / "two.tar.gz"))
    assert (tmp_path / "one.tar.gz").read_bytes() == (tmp_path / "two.tar.gz").read_bytes()
    control.unpack(str(tmp_path / "one.tar.gz"), str(tmp_path / "out"))
    assert (tmp_path / "out" / "d" / "b").read_text() == "2"
    with tarfile.open(tmp_path / "bad.tar", "w") as t:
        t.addfile(tarfile.TarInfo("../x"))
    with pytest.raises(ValueError):
        control.unpack(str(tmp_path / "bad.tar"), str(tmp_path / "out2"))


def test_proposer(tmp_path):
    import pytest

    echo = [sys.executable, "-c", "import json, sys; print(json.dumps({'bindings': [{'claim_id': c} for c in json.load(sys.stdin)['claims']]}))"]
    assert control.propose(echo, {"claims": ["a"]}) == [{"claim_id": "a"}]
    with pytest.raises(RuntimeError):
        control.propose([sys.executable, "-c", "raise SystemExit(1)"], {})
