"""Location, capture, consistency, joins, store, sources, streams, records and the command line."""

import gzip
import hashlib
import io
import json
import tarfile
import zipfile
from math import isclose

import pytest
from pyspark.sql import functions as F

from verifold.functions import locators as L
from verifold.functions.distribution import p_value
from verifold.operators import capture, claims, consistency, joins, locate, store
from verifold.sources import archive_members, canonical_json, documents_of, papers, render_table, tree_hash, write_cases, write_objects


@pytest.mark.parametrize(
    ("data", "pointer", "expected"),
    [
        (b'{"a":{"b~/c":[1, 0.870]}}', "/a/b~0~1c/1", ("0.870", None)), (b'{"a":1e400}', "/a", ("1e400", None)), (b'{"a":1,"a":2}', "/a", (None, L.AMBIGUOUS)),
        (b'{"a":NaN}', "/a", (None, L.UNPARSEABLE)), (b'{"a":[1]}', "/a/01", (None, L.NO_BINDING)), (b'{"a":{}}', "/a", (None, L.UNPARSEABLE)), (b"{", "/a", (None, L.UNPARSEABLE)), (b'{"a":" 5 "}', "/a", ("5", None)),
    ],
)
def test_json_pointer(data, pointer, expected):
    assert L.json_pointer(data, pointer) == expected


def test_csv_stdout_html():
    table = "﻿k, v ,v2\n a ,1.50,x\n\"b, c\",2\nd,3\nd,4\n".encode()
    assert L.csv_cell(table, "v", "k", "a") == ("1.50", None)
    assert L.csv_cell(table, "v", "k", "b, c") == ("2", None)
    assert L.csv_cell(table, "v", "k", "d") == (None, L.AMBIGUOUS)
    assert L.csv_cell(table, "v", "k", "z") == (None, L.NO_BINDING) and L.csv_cell(table, "zz", "k", "a") == (None, L.NO_BINDING)
    assert L.csv_cell(b"a,a\n1,2\n", "a", "a", "1") == (None, L.AMBIGUOUS)
    assert L.stdout_regex(b"x=1\nx=2\n", r"x=(\d)") == (None, L.AMBIGUOUS) and L.stdout_regex(b"x=1", r"x=(\d)") == ("1", None)
    assert L.stdout_regex(b"x", "(") == (None, L.INVALID) and L.stdout_regex(b"x", "y") == (None, L.NO_BINDING)
    page = "<table><tr><th>h</th></tr><tr><td>a</td><td> <b>1&amp;2</b></td></tr></table>"
    assert L.html_cell(page, 0, 1) == ("1&2", None) and L.html_cell(page, 1, 0) == (None, L.NO_BINDING)
    cell = json.dumps([{"data": {"text/html": [page]}, "text": ["0.5", "0"]}]).encode()
    assert L.notebook_cell(cell, "/0/data/text/html", 0, 0) == ("a", None) and L.notebook_cell(cell, "/0/text", None, None) == ("0.50", None)


def test_locate_causes_in_order(spark):
    fields = ", ".join(f"{f} {'int' if f.startswith('table') else 'string'}" for f in locate.FIELDS)
    def bind(i, a, invalid):
        return (i, a, "json_pointer", "/k", None, None, None, None, None, None, invalid)
    bindings = spark.createDataFrame([bind(1, "a.json", True), bind(2, "a.json", False), bind(3, "gone.json", False), bind(4, "a.json", False), bind(5, "a.json", False)], f"run_id long, artifact string, kind string, {fields}, invalid boolean")
    content = {1: b'{"k": 1}', 2: b'{"k": 2}', 3: b"{}", 4: b'{"k": "x"}', 5: b'{"k": 5.0}'}
    rows = [(i, "a.json", hashlib.sha256(b).hexdigest(), bytearray(b), False) for i, b in content.items()]
    artifacts = spark.createDataFrame(rows, "run_id long, relpath string, sha256 string, content binary, diagnostic_only boolean")
    stale = spark.createDataFrame([(1, "a.json"), (2, "a.json")], "run_id long, relpath string")
    got = {r["run_id"]: (r["text"], r["locate_cause"]) for r in locate.locate(bindings, artifacts, stale).collect()}
    assert got == {1: (None, L.INVALID), 2: (None, "STALE_ARTIFACT"), 3: (None, L.NO_BINDING), 4: (None, L.UNPARSEABLE), 5: ("5.0", None)}


def test_caps_skip_and_go_on(spark):
    d = spark.createDataFrame([(1, i, s) for i, s in enumerate([30, 100, 50, 30, 20])] + [(2, 0, 81)], "run_id long, ord long, size long")
    got = [r["cause"] for r in capture.apply_caps(d, 80, 100).where("run_id = 1").orderBy("ord").collect()]
    assert got == [None, "ARTIFACT_TOO_LARGE", None, "CAPTURE_LIMIT_EXCEEDED", None]
    assert capture.apply_caps(d.limit(0)).count() == 0


def test_freshness_is_strict(spark):
    outputs = spark.createDataFrame([(1, "a", 99), (1, "b", 100), (1, "c", 101)], "run_id long, relpath string, mtime_ns long")
    got = [r["stale"] for r in capture.freshness(outputs, spark.createDataFrame([(1, 100)], "run_id long, started_at_ns long")).orderBy("relpath").collect()]
    assert got == [True, False, False]


def test_notebook_cells(spark):
    good = json.dumps({"cells": [{"outputs": []}, {"outputs": [{"b": 1, "a": "é"}]}, {"source": ""}]}).encode()
    bad = b'{"cells": [{"outputs": [NaN]}]}'
    d = spark.createDataFrame([(1, "n.ipynb", bytearray(good)), (2, "n.ipynb", bytearray(bad)), (3, "n.ipynb", bytearray(b"x"))], "run_id long, relpath string, content binary")
    got = capture.notebook_cells(d).collect()
    assert [(r["run_id"], r["relpath"], bytes(r["content"]).decode()) for r in got] == [(1, "n.ipynb#cell-1", '[{"a":"é","b":1}]\n')]


def test_p_values():
    for args, p in [(("t", 10, None, 2.228138852), 0.05), (("F", 2, 10, 4.102821015), 0.05), (("chi2", 3, None, 7.814727903), 0.05), (("z", None, None, 1.959963985), 0.05), (("chi2", 2, None, 1.0), 0.6065306597)]:
        assert isclose(p_value(*args), p, rel_tol=1e-6)
    assert p_value("r", 5, None, 1.0) is None


def test_consistency(spark):
    texts = ["We saw t(28) = 2.20, p = .036 and F(2, 30) = 1.0, p < .01.", "é😀 ok. The mean was 3.48 with n = 25. M = 3.47 (N = 25).", None, "χ²(1) = 3.84, p = .05; z = 1.70, p = .045; t = 2, p = .1; r(5) = 1.2, p < .05"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = consistency.check(d)
    got = [(r["doc_id"], r["kind"], texts[r["doc_id"]][r["start"] : r["end"]], r["label"]) for r in found.orderBy("doc_id", "start").collect()]
    assert got == [
        (0, "statcheck", "t(28) = 2.20, p = .036", "CONSISTENT"), (0, "statcheck", "F(2, 30) = 1.0, p < .01", "INTERNAL_INCONSISTENCY"), (1, "grim", "mean was 3.48 with n = 25", "CONSISTENT"),
        (1, "grim", "M = 3.47 (N = 25", "INTERNAL_INCONSISTENCY"), (3, "statcheck", "χ²(1) = 3.84, p = .05", "CONSISTENT"), (3, "statcheck", "z = 1.70, p = .045", "CONSISTENT"),
        (3, "statcheck", "t = 2, p = .1", "NOT_APPLICABLE"), (3, "statcheck", "r(5) = 1.2, p < .05", "NOT_APPLICABLE"),
    ]
    assert {r["doc_id"]: (r["CONSISTENT"], r["NOT_APPLICABLE"]) for r in consistency.counts(found).collect()} == {0: (1, 0), 1: (1, 0), 3: (2, 2)}
    impossible = spark.createDataFrame([("3.47", 25), ("3.48", 25), ("3.5", 3), ("3.3", 3)], "mean string, n long")
    assert [r["possible"] for r in consistency.grim(impossible).collect()] == [False, True, False, True]


def test_asof_and_containment(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("b", 3)], "k string, at int")
    right = spark.createDataFrame([("a", 5, "x"), ("a", 2, "y"), ("b", 4, "z")], "k string, pos int, v string")
    got = {(r["k"], r["at"]): r["v"] for r in joins.asof_backward(left, right, ["k"], "at", "pos", ["v"]).collect()}
    assert got == {("a", 1): None, ("a", 5): "x", ("b", 3): None}
    spans = spark.createDataFrame([("a", 0, 1000, "long"), ("a", 5, 5, "none"), ("a", 5, 6, "one")], "k string, lo int, hi int, v string")
    got = sorted((r["k"], r["at"], str(r["v"])) for r in joins.contained_in(left, spans, ["k"], "at", "lo", "hi").collect())
    assert got == [("a", 1, "long"), ("a", 5, "long"), ("a", 5, "one"), ("b", 3, "None")]


def test_merge_is_null_safe(spark):
    rows = [(1, "0.87", "acc", None, 1, 2, "h"), (1, "0.87", "acc", None, 1, 2, None), (1, "0.870", "acc", None, 3, 4, None)]
    rows += [(2, "0.87", "acc", None, 1, 2, "g"), (None, "0.87", "acc", None, 5, 6, "n"), (None, "0.87", "acc", None, 5, 6, "n")]
    d = spark.createDataFrame(rows, "doc_id long, text string, metric string, units string, start int, end int, hint string")
    got = {(r["doc_id"], r["text"]): (r["mentions"], len(r["locations"]), r["hints"]) for r in claims.merge_mentions(d).collect()}
    assert got == {(1, "0.87"): (2, 1, ["h"]), (1, "0.870"): (1, 1, []), (2, "0.87"): (1, 1, ["g"]), (None, "0.87"): (2, 1, ["n"])}


def test_claim_id_frames_its_fields(spark):
    d = spark.createDataFrame([("a", "bc", None), ("ab", "c", None), ("a", "bc", "")], "t string, m string, u string")
    ids = [r["i"] for r in d.select(claims.claim_id(F.col("t"), F.col("m"), F.col("u")).alias("i")).collect()]
    assert len(set(ids)) == 3
    assert ids[0] == hashlib.sha256(b"verifold.claim.v1\x01:1:a\x01:2:bc\x00:").hexdigest()


def test_bank_within_a_batch(spark):
    batch = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x"), (3, "x"), (3, "x")], "case_id long, digest string")
    stored = spark.createDataFrame([(2, "x")], "case_id long, digest string")
    new, bad = store.bank(stored, batch)
    assert [r["case_id"] for r in new.collect()] == [3] and [r["case_id"] for r in bad.collect()] == [1]


def test_write_once(spark, tmp_path):
    path = str(tmp_path / "cases")
    one = spark.createDataFrame([(1, "x"), (2, "y")], "case_id long, digest string")
    assert write_cases(one, path).count() == 0 and write_cases(one, path).count() == 0
    assert spark.read.parquet(path).count() == 2
    assert write_cases(spark.createDataFrame([(2, "z"), (3, "w")], one.schema), path).first()["cause"] == "CASE_CONFLICT"
    assert {(r["case_id"], r["digest"]) for r in spark.read.parquet(path).collect()} == {(1, "x"), (2, "y"), (3, "w")}


def test_verify_members(spark):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    manifest = spark.createDataFrame([(1, "a", sha(b"1")), (1, "b", sha(b"2")), (1, "c", sha(b"3"))], "case_id long, path string, sha256 string")
    files = spark.createDataFrame([(1, "a", bytearray(b"1")), (1, "b", bytearray(b"x")), (1, "d", bytearray(b"4"))], "case_id long, path string, content binary")
    assert {(r["path"], r["cause"]) for r in store.verify_members(manifest, files).collect()} == {("b", "MEMBER_TAMPERED"), ("c", "MEMBER_MISSING"), ("d", "MEMBER_UNLISTED")}


def test_papers_and_archives(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.md").write_text("é 1")
    (tmp_path / "p" / "b.md").write_bytes(b"\xff\xfe")
    (tmp_path / "p" / "c.txt").write_text("x")
    got = sorted((r["text"] or "", r["cause"]) for r in papers(spark, str(tmp_path / "p")).collect())
    assert got == [("", "PAPER_UNREADABLE"), ("é 1", None)]
    (tmp_path / "z").mkdir()
    with zipfile.ZipFile(tmp_path / "z" / "a.zip", "w") as z:
        z.writestr("x/y.txt", "1")
        z.writestr("../out.txt", "2")
    with tarfile.open(tmp_path / "z" / "b.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("m.txt")
        info.size = 1
        t.addfile(info, io.BytesIO(b"3"))
    (tmp_path / "z" / "c.tgz").write_bytes(gzip.compress(b"junk"))
    got = sorted((r["relpath"].rsplit("/", 1)[-1], r["cause"]) for r in archive_members(spark, str(tmp_path / "z")).collect())
    assert got == [("c.tgz", "UNSUPPORTED_ARCHIVE"), ("m.txt", None), ("out.txt", "UNSAFE_MEMBER"), ("y.txt", None)]


def test_tree_hash_ignores_order_and_git(spark):
    rows = [(1, "b", bytearray(b"2")), (1, "a", bytearray(b"1")), (1, ".git/x", bytearray(b"3"))]
    one = tree_hash(spark.createDataFrame(rows, "src long, relpath string, content binary"), "src").first()
    two = tree_hash(spark.createDataFrame(rows[1::-1], "src long, relpath string, content binary"), "src").first()
    assert one["tree_hash"] == two["tree_hash"] and one["files"] == 2


def test_sinks(spark):
    d = spark.createDataFrame([("é\nlong text here", None)], "b string, a int")
    assert d.select(canonical_json(F.struct("b", "a")).alias("j")).first()["j"] == '{"a":null,"b":"é\\nlong text here"}\n'
    assert render_table(d, {"b": 8, "a": 3}).first()["line"] == "é␤long …  -"


def test_documents_and_objects(spark, tmp_path):
    d = spark.createDataFrame([(1, "b", 2), (1, "a", None), (2, "c", 3)], "run int, claim_id string, n int")
    got = {r["run"]: r["document"] for r in documents_of(d, ["run"], ["claim_id"], "verdicts").collect()}
    assert got == {1: '{"verdicts":[{"claim_id":"a","n":null},{"claim_id":"b","n":2}]}\n', 2: '{"verdicts":[{"claim_id":"c","n":3}]}\n'}
    rows = spark.createDataFrame([("ab1", bytearray(b"x")), ("ab1", bytearray(b"x")), ("cd2", bytearray(b"y"))], "sha256 string, content binary")
    write_objects(rows, str(tmp_path / "o"))
    assert spark.read.parquet(str(tmp_path / "o")).where("shelf = 'ab'").count() == 1


def write_record(path, value, located):
    (path / "objects").mkdir(parents=True)
    data = json.dumps({"metrics": {"acc": 1}}).replace("1", located).encode()
    sha = hashlib.sha256(data).hexdigest()
    (path / "objects" / sha).write_bytes(data)
    cid = hashlib.sha256(b"verifold.claim.v1\x01:" + f"{len(value)}:{value}".encode() + b"\x01:3:acc\x00:").hexdigest()
    (path / "claims.json").write_text(json.dumps({"claims": [{"text": value, "metric": "acc", "context": "", "start": 0, "end": 1}, {"text": "7", "metric": "x", "context": "", "start": 0, "end": 1}]}))
    (path / "bindings.json").write_text(json.dumps({"bindings": [{"claim_id": cid, "artifact": "r.json", "locator": {"kind": "json_pointer", "pointer": "/metrics/acc"}}]}))
    (path / "trace.json").write_text(json.dumps({"run_id": "r", "failure": None, "causes": [], "stale": [], "artifacts": [{"kind": "json", "relpath": "r.json", "sha256": sha, "size": 1, "diagnostic_only": False}]}))


def test_replay_and_command_line(spark, tmp_path, capsys):
    from verifold.__main__ import main
    from verifold.plans.records import replay
    from verifold.sources import record

    write_record(tmp_path / "in" / "one", "0.87", "0.8712")
    write_record(tmp_path / "in" / "two", "0.87", "0.9071")
    got = {(r["run_id"], r["text"]): r["cause"] or r["verdict"] for r in replay(record(spark, str(tmp_path / "in"))).collect()}
    assert got == {("one", "0.87"): "REPRODUCED", ("two", "0.87"): "DIVERGED", ("one", "7"): "NO_BINDING", ("two", "7"): "NO_BINDING"}
    assert main(["verify", str(tmp_path / "in"), "--json", "--bank", str(tmp_path / "bank")]) == 1
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert sorted(x["verdict"] for x in lines) == ["DIVERGED", "REPRODUCED", "UNVERIFIED", "UNVERIFIED"]
    assert spark.read.parquet(str(tmp_path / "bank")).count() == 2


def test_streams(spark, tmp_path):
    from verifold.streaming import bank_stream, pooled_counts, run_budget, windowed_counts

    events = "ts timestamp, event_type string, value double"
    (tmp_path / "e").mkdir()
    spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'a' AS event_type, 1D AS value UNION ALL SELECT timestamp'2024-01-01 01:10:00', 'a', 2D").write.mode("append").parquet(str(tmp_path / "e"))
    q = windowed_counts(spark.readStream.schema(events).parquet(str(tmp_path / "e"))).writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["n"] for r in spark.sql("SELECT n FROM w").collect()) == [1, 1]
    spark.createDataFrame([(1, i, s) for i, s in enumerate([30, 100, 50, 30, 20])], "run_id long, ord long, size long").coalesce(1).write.parquet(str(tmp_path / "o"))
    q = run_budget(spark.readStream.schema("run_id long, ord long, size long").parquet(str(tmp_path / "o")), 80, 100).writeStream.format("memory").queryName("b").start()
    q.processAllAvailable()
    q.stop()
    assert [r["cause"] for r in spark.sql("SELECT * FROM b ORDER BY ord").collect()] == [None, "ARTIFACT_TOO_LARGE", None, "CAPTURE_LIMIT_EXCEEDED", None]
    spark.createDataFrame([(1, "x"), (2, "y")], "case_id long, digest string").write.parquet(str(tmp_path / "c"))
    for _ in range(2):
        bank_stream(spark.readStream.schema("case_id long, digest string").parquet(str(tmp_path / "c")), str(tmp_path / "s"), str(tmp_path / "k")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2
    assert pooled_counts(spark.createDataFrame([("A",), ("A",)], "verdict string")).first()["claims"] == 2


def test_registered_queries_have_sql_or_tests():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "verdict_point" in e.queries()
