import base64
import json
import zlib

from pyspark.sql import functions as F

from wrenfield.sources import readers, sinks
from wrenfield.streaming.lifecycle import first_sightings, lifecycle, run_into


def test_logs_config_and_csv(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"event": "applied", "id": "a"}\nnot json\n{"event": "x"}\n')
    assert [r.id for r in readers.read_jsonl(spark, str(tmp_path / "log.jsonl"), "event string, id string", ["event", "id"]).collect()] == ["a"]
    (tmp_path / "c.json").write_text('{\n"//": "note",\n"a.example": "1",\n"//x": "2"}')
    assert [tuple(r) for r in readers.read_commented_json(spark, str(tmp_path / "c.json")).collect()] == [("a.example", "1")]
    (tmp_path / "t.csv").write_text('a,b\n"x, ""y""","l1\nl2"\n')
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "t.csv")).collect()] == [('x, "y"', "l1\nl2")]


def test_pages(spark):
    ld = json.dumps({"@graph": [{"@type": "School", "name": "Alba"}, {"@type": "Thing"}]})
    html = f'<script type="application/ld+json">{ld}</script><script type="application/ld+json">broken</script><script id="__NEXT_DATA__" type="application/json">{{"a": 1}}</script><a href="/x"><b>One</b> two</a><a href="/y">Y'
    pages = spark.createDataFrame([(1, html), (2, None), (3, "")], "page int, html string")
    assert [(r.page, r.node.name) for r in readers.ld_nodes(pages, "html", "School", "name string").collect()] == [(1, "Alba")]
    assert [r.x for r in pages.select(readers.next_data(F.col("html")).alias("x")).collect()] == ['{"a": 1}', None, None]
    assert [[tuple(a) for a in r.x] for r in pages.where("page = 1").select(readers.anchors(F.col("html")).alias("x")).collect()] == [[("/x", "One two"), ("/y", "Y")]]
    flight = "".join(f"self.push([1,{json.dumps(p)}])" for p in ('z{"id": 1, "t": "a}', '{"}, {"id": 2}'))
    found = readers.embedded_objects(spark.createDataFrame([("p", flight)], "k string, html string"), "k", "html", '{"id":').collect()
    assert [json.loads(r.object) for r in found] == [{"id": 1, "t": "a}{"}, {"id": 2}]


def test_mail_and_pdf(spark):
    body = base64.b64encode("Prüfung\nHead of PE".encode()).decode()
    mail = f'From: a@b.example\r\nSubject: =?utf-8?q?Neue_St=C3=A4lle?=\r\n folded\r\nDate: Sat, 06 Dec 2025 18:04:00 +0100\r\nMIME-Version: 1.0\r\nContent-Type: multipart/alternative; boundary=x\r\n\r\n--x\r\nContent-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: base64\r\n\r\n{body}\r\n--x\r\nContent-Type: text/html\r\n\r\n<p>no</p>\r\n--x--\r\n'
    files = spark.createDataFrame([("m", bytearray(mail.encode())), ("n", bytearray(b"Subject: x\r\n\r\nhi"))], "path string, content binary")
    got = {r.path: r for r in readers.mail_messages(files).collect()}
    assert got["m"].subject == "Neue Ställe folded" and got["m"].body.strip() == "Prüfung\nHead of PE" and got["m"].sent_at.hour == 17
    assert got["n"].sent_at is None and readers.within_days(readers.mail_messages(files), F.expr("timestamp '2026-06-01'")).count() == 1
    stream = zlib.compress(b"BT (Job \\(PE\\)) Tj T* <FEFF00E9> Tj ET")
    pdf = b"%PDF-1.4\n<< /Filter /FlateDecode >> stream\n" + stream + b"\nendstream\n<< /Subtype /Image >> stream\n(BT no)\nendstream"
    out = {r.path: r.text for r in readers.pdf_texts(spark.createDataFrame([("a", bytearray(pdf)), ("b", bytearray(b"x"))], "path string, content binary")).collect()}
    assert out == {"a": "Job (PE)\né", "b": ""}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("=1", "a\tb"), (None, 'say "x"')], "a string, b string")
    sinks.write_csv(df.coalesce(1), str(tmp_path / "csv"))
    assert {tuple(r) for r in readers.read_csv(spark, str(tmp_path / "csv")).na.fill("").collect()} == {("'=1", "a\tb"), ("", 'say "x"')}
    sinks.append_jsonl(df, str(tmp_path / "log"))
    known = spark.read.schema("a string, b string").json(str(tmp_path / "log"))
    sinks.append_jsonl(spark.createDataFrame([("=1", "a\tb"), ("n", "n")], "a string, b string"), str(tmp_path / "log"), known, ["a", "b"])
    assert spark.read.schema("a string, b string").json(str(tmp_path / "log")).count() == 3


def test_streams(spark, tmp_path):
    for run, rows in enumerate([[("a", True), ("b", True)], [("a", True), ("b", False)], [("a", False), ("b", False)]]):
        spark.createDataFrame([(k, run, s) for k, s in rows], "key string, run bigint, seen boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out: dict = {}

    def apply(df, _):
        for r in df.collect():
            out[r.key] = (r.status, r.misses)

    source = spark.readStream.schema("key string, run bigint, seen boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = lifecycle(source, "key", "run").writeStream.outputMode("update").foreachBatch(apply).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert out == {"a": ("stale", 1), "b": ("closed", 2)}
    once: list = []
    stamped = spark.readStream.schema("key string, run bigint, seen boolean").parquet(str(tmp_path / "in")).withColumn("at", F.expr("timestamp '2026-01-01'"))
    run_into(first_sightings(stamped, "key", "at"), lambda df, _: once.extend(r.key for r in df.collect()), str(tmp_path / "c2"))
    assert sorted(once) == ["a", "b"]


def test_keys_that_stop_coming_expire(spark, tmp_path):
    days = [["a", "b"], ["a"], ["a"], ["a"], ["a"]]
    out: dict = {}

    def apply(df, _):
        for r in df.collect():
            out.setdefault(r.key, []).append(r.status)

    (tmp_path / "in").mkdir()
    source = spark.readStream.schema("key string, run bigint, seen boolean, at timestamp").parquet(str(tmp_path / "in"))
    # A run of its own for each delivery, as a scheduler would start it.
    for run, keys in enumerate(days):
        spark.createDataFrame([(k, run, True) for k in keys], "key string, run bigint, seen boolean").withColumn("at", F.expr(f"timestamp '2026-01-01' + make_dt_interval({7 * run})")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run_into(lifecycle(source, "key", "run", at="at", every="7 days"), apply, str(tmp_path / "c"), mode="update")
    assert set(out["a"]) == {"open"} and out["b"] == ["open", "stale", "closed"]


def test_stream_at_intervals_ends(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "in"))
    got: list = []
    query = run_into(spark.readStream.schema("id bigint").parquet(str(tmp_path / "in")), lambda df, _: got.extend(r.id for r in df.collect()), str(tmp_path / "c"), every="1 second", stop_after=1)
    assert sorted(got) == [0, 1, 2] and not query.isActive


def test_labelled_fields_and_senders(spark):
    html = "<dl><dt>Country:</dt><dd>Spain &amp; more</dd> <DT>Start</DT>\n<dd><b>Aug</b></dd><dt>Country</dt><dd>x</dd></dl><table><tr><th>Pay</th><td>1</td></tr></table>"
    rows = spark.createDataFrame([(html,), ("",), (None,)], "h string").select(readers.labelled_fields(F.col("h")).alias("m")).collect()
    assert [r.m for r in rows] == [{"country": "Spain & more", "start": "Aug", "pay": "1"}, {}, None]
    mails = spark.createDataFrame([("x@mail.tes.com", "Jobs"), ("n@boards.example", ""), ("nobody", None)], "a string, b string")
    assert [r.s for r in mails.select(readers.sender_label(F.col("a"), F.col("b")).alias("s")).collect()] == ["TES", "Email alert (boards.example)", "Email alert"]


def test_tsv_and_json_sinks(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", "a\tb\nc"), (None, "-x")], "a string, b string")
    sinks.write_tsv(df.coalesce(1), str(tmp_path / "tsv"))
    text = "".join(p.read_text() for p in (tmp_path / "tsv").glob("*.csv"))
    assert text.splitlines() == ["a\tb", "'=1+1\ta b c", "\t'-x"]
    sinks.write_json(df, str(tmp_path / "json"), "2026-01-15")
    about = spark.read.json(str(tmp_path / "json" / "about")).first()
    assert about.generatedAt == "2026-01-15" and about.headers == ["a", "b"] and spark.read.json(str(tmp_path / "json" / "rows")).count() == 2
