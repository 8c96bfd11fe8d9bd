from pyspark.sql import functions as F

from wrenfield.functions.web import resolved_location, robots_allow, social_network, unprotected_email
from wrenfield.operators.registry import Field, empty_cells, first_filled, project, resolve


def test_robots(spark):
    rules = spark.createDataFrame([("h", "/a", False), ("h", "/a/b", True), ("h", "/c*.pdf$", False), ("h", "/d", False), ("h", "/d", True), ("h", "", False), ("h", "/e?x", False)], "host string, pattern string, allow boolean")
    paths = ["/", "/a/x", "/a/b/c", "/c/x.pdf", "/c/x.pdf?y", "/d", "/e?xy", "/ex"]
    got = {r.path: r.allowed for r in robots_allow(spark.createDataFrame([("h", p) for p in paths] + [("other", "/a")], "host string, path string"), rules).where("host = 'h'").collect()}
    assert got == {"/": True, "/a/x": False, "/a/b/c": True, "/c/x.pdf": False, "/c/x.pdf?y": True, "/d": True, "/e?xy": False, "/ex": True}


def test_protected_and_social(spark):
    code = "42" + "".join(f"{b ^ 0x42:02x}" for b in b"a@b.example")
    df = spark.createDataFrame([(code,), ("zz",), ("4242",), (None,)], "c string")
    assert [r.x for r in df.select(unprotected_email(F.col("c")).alias("x")).collect()] == ["a@b.example", None, None, None]
    df = spark.createDataFrame([("www.facebook.com", "/alba"), ("facebook.com", "/sharer.php"), ("x.com", "/alba"), ("alba.example", "/"), (None, "/")], "h string, p string")
    assert [r.x for r in df.select(social_network(F.col("h"), F.col("p")).alias("x")).collect()] == ["facebook", None, "x", None, None]


def test_locations(spark):
    countries, cities = {"spain": "Spain", "united-arab-emirates": "United Arab Emirates"}, {"penalta": "Spain"}
    df = spark.createDataFrame([("Peñalta, Spain",), ("Peñalta",), ("Somewhere; united arab emirates",), ("Nowhere",), ("",), (None,)], "t string")
    got = [tuple(r.x) for r in df.select(resolved_location(F.col("t"), countries, cities).alias("x")).collect()]
    assert got[:4] == [("Spain", "Peñalta"), ("Spain", "Peñalta"), ("United Arab Emirates", "Somewhere"), ("Nowhere", None)] and got[4:] == [(None, None)] * 2


def test_registry(spark):
    fields = [Field("a", "A", "g", "both", first_filled("x", "y")), Field("b", "B", "g", "job", F.col("n")), Field("c", "C", "g", "school", F.col("n"))]
    df = spark.createDataFrame([("", "y", 1), (None, None, None)], "x string, y string, n int")
    assert [f.key for f in resolve(fields, ["b", "zz", "a", "b", "c"], "job")] == ["b", "a"] and [f.key for f in resolve(fields, [], "school")] == ["a", "c"]
    assert [tuple(r) for r in project(df, fields[:2]).collect()] == [("y", "1"), ("", "")]
    assert {tuple(r) for r in empty_cells(df, fields[:2]).collect()} == {("A", 1, 2), ("B", 1, 2)}
