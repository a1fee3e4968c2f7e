"""The SQL facade, access control, orchestration and streaming."""

import pytest
from conftest import SF
from pyspark.sql import functions as F

from skeinwork import orchestration as O
from skeinwork.access import AccessController, RoleContext, is_safe_path, require_role, validate_safe_code
from skeinwork.engine import Engine, VectorClient, category
from skeinwork.sources.snapshots import SnapshotTable
from skeinwork.streaming import events as E


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, f"file://{tmp_path_factory.mktemp('engine')}")
    e.sql("CREATE TABLE papers (id VARCHAR(32), title TEXT, category TEXT, vector VECTOR(4))")
    e.sql("INSERT INTO papers (id, title, category, vector) VALUES ('p1', 'Quantum keys', 'c', array(1.0, 0.0, 0.0, 0.0)), ('p2', 'Ring', 'c', array(0.0, 1.0, 0.0, 0.0))")
    return e


def test_crud(engine):
    assert engine.sql("SELECT id FROM papers WHERE title LIKE '%Quantum%'").rows == [{"id": "p1"}]
    assert engine.sql("UPDATE papers SET category = 'x' WHERE id = 'p1'").count == 1
    near = engine.sql("SELECT id, score FROM papers WHERE KNN(vector, [1, 0, 0, 0], 2)")
    assert near.rows[0] == {"id": "p1", "score": pytest.approx(1.0)} and near.count == 2
    assert engine.cursor().execute("SELECT title FROM papers WHERE id = ?", ["p2"]).fetchall() == [("Ring",)]
    assert engine.sql("EXPLAIN SELECT id FROM papers").count > 0


def test_transactions(engine):
    engine.sql("BEGIN")
    with pytest.raises(RuntimeError):
        engine.sql("BEGIN")
    engine.sql("INSERT INTO papers (id, title) VALUES ('p3', 'x')")
    engine.sql("SAVEPOINT a")
    engine.sql("DELETE FROM papers WHERE id = 'p1'")
    assert engine.sql("SELECT * FROM papers").count == 2
    engine.sql("ROLLBACK TO a")
    assert engine.sql("SELECT * FROM papers").count == 3
    engine.sql("ROLLBACK")
    assert engine.sql("SELECT * FROM papers").count == 2
    with pytest.raises(RuntimeError):
        engine.sql("COMMIT")
    engine.sql("BEGIN")
    engine.sql("DELETE FROM papers WHERE id = 'p2'")
    engine.sql("COMMIT")
    assert engine.sql("SELECT id FROM papers").rows == [{"id": "p1"}]


def test_roles(engine):
    with pytest.raises(PermissionError, match="guest may not DELETE on papers"):
        engine.sql("DELETE FROM papers", role="guest")
    engine.sql("GRANT DELETE ON papers TO guest")
    assert engine.sql("DELETE FROM papers WHERE id = 'none'", role="guest").count == 0
    engine.sql("REVOKE DELETE ON papers FROM guest")
    c = AccessController()
    assert c.check_permission("admin", "any", "DROP") and c.check_permission("analyst", "t", "INSERT") and not c.check_permission("analyst", "t", "DELETE")
    c.revoke("admin", "*", "SELECT")
    assert not c.check_permission("admin", "any", "DROP")
    assert c.check_permission(RoleContext("guest", {"t": frozenset({"INSERT"})}), "t", "INSERT")

    @require_role("analyst")
    def secret(context):
        return "data"

    assert secret(context=RoleContext("admin")) == "data"
    with pytest.raises(PermissionError):
        secret(context=RoleContext("guest"))
    assert [category(s) for s in ("select 1", "DROP TABLE x", "grant a", "begin", "explain x")] == ["DQL", "DDL", "DCL", "TCL", "SQL"]


@pytest.mark.parametrize("statement", [
    "ALTER VIEW papers AS SELECT 'hacked' AS id", "CREATE OR REPLACE TEMP VIEW papers AS SELECT 1", "SELECT * FROM parquet.`/root/testdata/sf0.001/region.parquet`", "SELECT * FROM `parquet`.`/x`", "STORE x", "END", "QUERY x", "SET a = b", "ADD JAR x",
    "EXPLAIN SELECT * FROM parquet.`/x`", "EXPLAIN ALTER VIEW papers AS SELECT 1", "EXPLAIN SELECT * FROM hidden", "SELECT (SELECT max(id) FROM hidden)", "SELECT 1 WHERE EXISTS (SELECT 1 FROM hidden)", "SELECT 1 WHERE 'a' IN (SELECT id FROM hidden)",
    "WITH hidden AS (SELECT 1 AS id), a AS (SELECT * FROM hidden) SELECT * FROM a", "SELECT 'CTE [hidden]', id FROM hidden", "SELECT reflect('java.lang.System', 'exit', 0)", "SELECT * FROM spark_catalog.default.papers", "SELECT * FROM other_view", "SELECT * FROM HIDDEN", "SHOW DATABASES", "CACHE TABLE papers", "",
])
def test_what_a_guest_cannot_do(engine, statement):
    if "hidden" not in engine.tables:
        engine.attach("hidden", engine.spark.createDataFrame([("h",)], "id string"))
        engine.access.grant("reader", "papers", "SELECT")
    engine.spark.range(1).createOrReplaceTempView("other_view")
    with pytest.raises(PermissionError):
        engine.sql(statement, role="reader")


def test_what_a_reader_still_can(engine):
    engine.access.grant("reader", "papers", "SELECT")
    assert engine.sql("WITH a AS (SELECT id FROM papers) SELECT count(*) AS n FROM a", role="reader").rows[0]["n"] >= 1
    assert [r["name"] for r in engine.sql("SHOW TABLES", role="reader").rows] == ["papers"]
    assert engine.sql("EXPLAIN SELECT id FROM papers", role="reader").count > 0
    with pytest.raises(PermissionError):
        engine.sql("INSERT INTO papers (id) VALUES ('x')", role="reader")
    engine.access.grant("reader", "papers", "INSERT")
    with pytest.raises(PermissionError):
        engine.sql("INSERT INTO papers (id) SELECT id FROM hidden", role="reader")


def test_indexes(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}")
    e.attach("docs", spark.createDataFrame([(1, "ring attack", [1.0, 0.0]), (2, "lattice ring", [0.0, 1.0]), (3, "heat", [0.7, 0.7])], "id int, body string, vector array<float>"))
    for kind, column in (("INVERTED", "body"), ("HNSW", "vector"), ("BTREE", "id")):
        assert e.sql(f"CREATE INDEX {kind.lower()}_i ON docs USING {kind} ({column})").status == "ok"
    with pytest.raises(ValueError):
        e.sql("CREATE INDEX btree_i ON docs (id)")
    assert e.sql("CREATE INDEX IF NOT EXISTS btree_i ON docs (id)").status == "ok"
    assert {r["id"] for r in e.index("inverted_i").search({"ring": 1.0}).collect()} == {1, 2}
    assert e.index("hnsw_i").search([1.0, 0.1], 1).first()["id"] == 1
    assert [r["id"] for r in e.index("btree_i").filter("id > 1").collect()] == [2, 3]
    e.sql("DELETE FROM docs WHERE id = 1")
    assert {r["id"] for r in e.index("inverted_i").search({"ring": 1.0}).collect()} == {2}
    e.sql("DROP INDEX hnsw_i")
    with pytest.raises(KeyError):
        e.sql("DROP INDEX hnsw_i")
    assert e.sql("SELECT cosine_sim(array(1D, 0D), array(0.5D, 0.5D)) AS a, knn_score(array(1D), array(-1D)) AS b, size(embed('ring')) AS n").rows == [{"a": 0.5, "b": 0.0, "n": 128}]


def test_guards(tmp_path):
    assert is_safe_path("a/b", str(tmp_path)) and not is_safe_path("../x", str(tmp_path)) and not is_safe_path("a\0", str(tmp_path))
    for bad in ("import subprocess", "from pickle import loads", "__import__('os')", "x.__class__", "open('f', 'w')", "eval('1')"):
        assert "Security Exception" in validate_safe_code(bad)
    assert validate_safe_code("import math\nopen('f')") is None


def test_vector_client(engine):
    c = VectorClient(engine)
    assert c.ping() and c.bulk_write([("a", [1.0, 0.0], {"x": "y"}), ("b", [0.0, 1.0], {})]) == 2
    assert c.info()["rows"] == 2 and c.get_by_id("a")["metadata"] == {"x": "y"} and c.get_by_id("z") is None
    assert c.search_knn([1.0, 0.0], 1).first()["id"] == "a"
    assert c.insert("a", [0.0, 2.0]) == 1 and c.info()["rows"] == 2 and c.get_by_id("a")["vector"] == [0.0, 2.0]


def test_snapshots(spark, tmp_path):
    t = SnapshotTable(spark, f"file://{tmp_path}/t")
    assert t.current() is None
    t.write(spark.range(3))
    first = t.history()[0]
    t.transact(lambda df: df.filter("id > 0"))
    assert t.current().count() == 2 and len(t.history()) == 2
    with pytest.raises(ValueError):
        t.delete_snapshot(t.history()[-1])
    t.delete_snapshot(first)


def test_orchestration():
    assert O.topological_order({"c": ["b"], "b": ["a"]}) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        O.topological_order({"a": ["b"], "b": ["a"]})
    saga = O.Saga().step("one", lambda x: x + [1], lambda x: x.clear()).step("two", lambda x: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        saga.run([])
    assert saga.log == ["one", "undo one"]
    p = O.TopicPlanner({"topic_a": 0.5, "topic_b": 0.5})
    w = p.feedback({"topic_b": 10}, {"topic_b": 2.0, "topic_a": 0.1}, {})
    assert w["topic_b"] > w["topic_a"] and sum(w.values()) == pytest.approx(1)
    assert p.directive("cycle_001").quotas["topic_a"] >= 5
    assert O.normalized({"a": -1, "b": 0}) == {"a": 0.5, "b": 0.5}
    frames, errors = O.harvest({"bad": lambda t, q: 1 / 0}, ["x"])
    assert not frames and errors[0]["source"] == "bad"
    c = O.LruCache(1)
    c.put("a", 1)
    c.put("b", 2)
    assert c.get("a") is None and c.get("b") == 2 and c.hit_ratio == 0.5
    now = [0.0]
    s = O.SemanticCache(ttl=10, clock=lambda: now[0])
    s.put("A b", 1)
    assert s.get(" b a ") == 1
    now[0] = 11
    assert s.get("a b") is None
    r = O.ThemeRegistry()
    assert r.add({"name": "t"}).root == "outputs/t" and len(r.themes) == 4
    assert O.profile(lambda: None)["iterations"] == 5


def test_streams(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).orderBy("ts")
    for i, part in enumerate(events.randomSplit([1.0, 1.0], 3)):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    target = SnapshotTable(spark, f"file://{tmp_path}/latest")
    q = E.keep_latest(E.read_events(spark, f"{tmp_path}/in"), target, f"{tmp_path}/ck")
    q.awaitTermination(120)
    want = {r["user_id"]: r["e"] for r in events.groupBy("user_id").agg(F.max("event_id").alias("e")).collect()}
    assert {r["user_id"]: r["event_id"] for r in target.current().collect()} == want
    for name, df in {"w": E.tumbling(E.read_events(spark, f"{tmp_path}/in", 9), late="400 days"), "t": E.throttle(E.read_events(spark, f"{tmp_path}/in", 9))}.items():
        q = df.writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert spark.table("w").agg(F.sum("n")).first()[0] == events.count()
    assert spark.table("t").select("user_id").distinct().count() == len(want)
    assert E.first_seen(E.read_events(spark, f"{tmp_path}/in")).isStreaming and E.sessions(E.read_events(spark, f"{tmp_path}/in")).isStreaming and E.sliding(E.read_events(spark, f"{tmp_path}/in")).isStreaming
