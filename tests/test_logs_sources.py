import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.sources import files as S
from docketry.sources.catalogue import CatalogueSource, get_json
from docketry.streaming import logs as L

SCHEMA = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.StringType()), T.StructField("seq", T.LongType())])


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_last_first_and_work(spark):
    log = spark.createDataFrame([("a", "x", 1), ("a", None, 2), ("b", None, 1), ("b", "y", 2), ("c", "z", 1)], SCHEMA)
    assert rows(L.last_per_key(log, ["k"], ["seq"])) == [("a", None, 2), ("b", "y", 2), ("c", "z", 1)]
    assert rows(L.first_per_key(log, ["k"], ["seq"]).select("k", "v")) == [("a", "x"), ("b", None), ("c", "z")]
    items = spark.createDataFrame([("a",), ("b",), ("d",)], "k string")
    assert rows(L.work_left(items, log, ["k"], ["seq"], F.col("v").isNotNull())) == [("a",), ("d",)]


def test_majority(spark):
    v = spark.createDataFrame([("a", "same"), ("a", "same"), ("b", "same"), ("b", None), ("c", "same"), ("c", "different"), ("d", "odd"), ("e", "unclear"), ("e", "unclear")], "k string, v string")
    assert rows(L.majority(v, ["k"], "v", ["same", "different", "unclear"])) == [("a", 2, "same"), ("b", 1, "unclear"), ("c", 2, "unclear"), ("d", 0, "unclear"), ("e", 2, "unclear")]


def test_torn_log_and_stream(spark, tmp_path):
    src = tmp_path / "log"
    src.mkdir()
    (src / "1.json").write_text('{"k":"a","v":"x","seq":1}\n\n{"k":"b","v":null,"seq":2}\n{"k":"a","v":"y","se')
    (src / "2.json").write_text('{"k":"b","v":"z","seq":5}\n{"k":"a","v":null,"seq":6}\n{"k":"b","v":"old","seq":3}\n')
    assert rows(L.read_log(spark, str(src), SCHEMA).select("k", "seq")) == [("a", 1), ("a", 6), ("b", 2), ("b", 3), ("b", 5)]
    q = L.append_batches(L.stream_log(spark, str(src), SCHEMA, files=1), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5 and spark.read.parquet(str(tmp_path / "out")).select("batch").distinct().count() == 2
    q = L.append_batches(L.stream_log(spark, str(src), SCHEMA), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5  # nothing is taken twice


def test_stateful_last_wins(spark, tmp_path):
    src = tmp_path / "s"
    src.mkdir()
    (src / "1.json").write_text('{"k":"a","v":"x","seq":1}\n{"k":"b","v":null,"seq":2}\n{"k":"a","v":"y","seq":4}\n{"k":"a","v":"w","seq":3}\n')
    q = L.stream_latest(L.stream_log(spark, str(src), SCHEMA), "k", "seq", "v").writeStream.format("memory").queryName("latest").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    assert rows(spark.sql("select * from latest")) == [("a", "y", 4)]


def test_files(spark, tmp_path):
    p = str(tmp_path / "x.jsonl")
    open(p, "w").write('{"k":"a","v":"ü","seq":1}\n\n{"k":"b"}\n')
    d = S.read_jsonl(spark, p, SCHEMA)
    assert d.count() == 2 and S.read_jsonl(spark, str(tmp_path / "none"), SCHEMA, strict=False).count() == 0
    with pytest.raises(Exception):
        S.read_jsonl(spark, str(tmp_path / "none"), SCHEMA).count()
    for kind, n in (("jsonl", 2), ("csv", 2), ("parquet", 2)):
        S.write(d, str(tmp_path / kind), kind, ["k", "v"], ["k"])
        assert spark.read.format({"jsonl": "json"}.get(kind, kind)).option("header", True).load(str(tmp_path / kind)).count() == n
    S.write(d, str(tmp_path / "json"), "json")
    assert len(json.loads("".join(r[0] for r in spark.read.text(str(tmp_path / "json")).collect()))) == 2
    assert S.markdown(d.select("k")).splitlines()[0] == "| k |"
    with pytest.raises(ValueError):
        S.write(d, p, "xls")


def test_positions_bodies_and_missing(spark, tmp_path):
    d = spark.createDataFrame([(f"r{i:03d}",) for i in range(50)], "r string").repartition(5)
    out = [r["mandate_id"] for r in S.with_positions(d, ["r"]).orderBy("r").collect()]
    assert out == [f"M{i:05d}" for i in range(50)]
    (tmp_path / "usc05A.xml").write_text("<x/>")
    (tmp_path / "usc42.xml").write_text("<y/>")
    assert rows(S.read_bodies(spark, str(tmp_path)).select("title", "appendix", "body")) == [("42", False, "<y/>"), ("5", True, "<x/>")]
    f = spark.createDataFrame([("p", "html", "h"), ("p", "xml", "x"), ("q", "html", "h"), ("r", "pdf", "z")], "k string, kind string, body string")
    assert rows(S.prefer_format(f, "k", "kind", ["xml", "html"]).select("k", "kind")) == [("p", "xml"), ("q", "html")]
    a, b = spark.createDataFrame([("1",), ("2",), ("2",)], "k string"), spark.createDataFrame([("1",)], "k string")
    assert rows(S.missing(a, b, "k")) == [("2",)] and rows(S.missing(a, b, "k", b)) == [("1",), ("2",)]
    made = S.build_if_missing(spark, str(tmp_path / "made"), lambda: a)
    assert made.count() == 3 and S.build_if_missing(spark, str(tmp_path / "made"), lambda: 1 / 0).count() == 3


def test_catalogue_source(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from urllib.parse import parse_qs, urlparse

    calls = {"n": 0}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            calls["n"] += 1
            if calls["n"] == 2:
                self.send_response(429)
                self.send_header("Retry-After", "0")
                self.end_headers()
                return
            if self.path.startswith("/gone"):
                self.send_response(404)
                self.end_headers()
                return
            q = parse_qs(urlparse(self.path).query)
            o, n = int(q["offset"][0]), int(q["pageSize"][0])
            body = json.dumps({"count": 7, "packages": [{"packageId": f"P{i}"} for i in range(o, min(7, o + n))]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    spark.dataSource.register(CatalogueSource)
    d = spark.read.format("catalogue").option("url", f"{url}/list").option("pageSize", 3).load()
    assert rows(d.select("package_id")) == [(f"P{i}",) for i in range(7)]
    assert get_json(f"{url}/gone") is None
    server.shutdown()


def test_object_documents_and_pairs(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"/us/usc/t5/s1": "Pub. L. 1-2", "b": 3}')
    (tmp_path / "n.json").write_text("nothing")
    assert rows(S.read_map(spark, str(tmp_path / "*.json"))) == [("/us/usc/t5/s1", "Pub. L. 1-2"), ("b", "3")]
    d = spark.createDataFrame([("b", "ü", 1), ("a", None, 2)], "k string, v string, n int")
    S.write_pair(d, str(tmp_path / "out"), ["k", "v"], ["k"])
    assert [r[0] for r in spark.read.text(str(tmp_path / "out" / "jsonl")).collect()] == ['{"k":"a"}', '{"k":"b","v":"ü"}'] and spark.read.option("header", True).csv(str(tmp_path / "out" / "csv")).columns == ["k", "v"]
    S.write(d.repartition(3), str(tmp_path / "arr"), "json")
    assert sum(len(json.loads(p.read_text())) for p in (tmp_path / "arr").glob("*.txt") if p.stat().st_size) == 2
