import json
import threading
import urllib.error

import pytest

import quarry.cli as cli
from quarry import advisor, diagnostics
from quarry.catalog import Catalog
from quarry.diagnostics import Diagnostics, Join, Operator
from quarry.engine import Engine
from quarry.errors import EngineError, ErrorCode
from quarry.http_api import server
from quarry.service import QueryService


@pytest.fixture(scope="module")
def service(spark):
    c = Catalog()
    c.create_namespace("default")
    e = Engine(spark, c).register_folder("/root/testdata/sf0.001", ["orders", "customer", "nation"])
    s = QueryService(e)
    yield s
    s.close()


def test_life_of_a_query(service, caplog):
    caplog.set_level("INFO", "quarry.query")
    q = service.submit("SELECT o.o_orderpriority, COUNT(*) AS n FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY o.o_orderpriority ORDER BY n DESC")
    assert q["state"] == "queued"
    q = service.wait(q["query_id"], 120)
    assert q["state"] == "succeeded" and [x["state"] for x in q["timeline"]] == ["queued", "planning", "running", "succeeded"]
    page = service.results(q["query_id"], 1, 2)
    assert len(page["rows"]) == 2 and page["total"] == 5 and page["columns"][1] == {"name": "n", "data_type": "int64", "nullable": False}
    assert service.plan(q["query_id"])["logical"]["node_type"] == "ORDER"
    m = service.metrics(q["query_id"])
    assert m["shuffle_bytes"] > 0 and m["joins"] and any(o["metrics"].get("numOutputRows") for o in m["operators"])
    assert m["stages"] and all(s["completed"] == s["tasks"] and s["failed_tasks"] == 0 for s in m["stages"] if s["completed"])
    assert service.plan(q["query_id"])["joins"][0]["strategy"] in ("broadcast", "repartition")
    assert [json.loads(r.message)["state"] for r in caplog.records] == ["queued", "planning", "running", "succeeded"]
    assert "HashAggregate" in service.explain_analyze(q["query_id"])
    assert service.advice(q["query_id"])["status"] in ("recommendations", "no_recommendations")
    for bad in ((-1, 10), (0, 0), (0, 1001)):
        with pytest.raises(EngineError) as e:
            service.results(q["query_id"], *bad)
        assert e.value.status == 422
    assert service.nodes() and any(x["query_id"] == q["query_id"] for x in service.list())


def test_failures(service):
    q = service.wait(service.submit("SELECT nope FROM orders")["query_id"], 60)
    assert q["state"] == "failed" and q["error"]["code"] == "BINDING_ERROR" and q["error"]["context"]["column"] == 8
    q = service.wait(service.submit("SELECT o_orderkey / 0 AS x FROM orders")["query_id"], 60)
    assert q["error"]["code"] == "TASK_FAILED"
    with pytest.raises(EngineError) as e:
        service.results(q["query_id"])
    assert e.value.code is ErrorCode.CONFLICT
    with pytest.raises(EngineError) as e:
        service.get("nothing")
    assert e.value.status == 404


def test_cancel(service):
    service.engine.register("big", service.engine.spark.range(0, 10**13, numPartitions=4))
    sql = "SELECT COUNT(*) AS n FROM big WHERE id % 7 = 3"
    q = service.submit(sql)
    threading.Event().wait(3)
    assert service.cancel(q["query_id"])["state"] == "canceled"
    threading.Event().wait(1)
    assert service.get(q["query_id"])["state"] == "canceled"
    assert not [s for s in service.engine.spark.sparkContext.statusTracker().getActiveJobsIds()]
    done = service.wait(service.submit("SELECT n_name FROM nation")["query_id"], 60)
    assert service.cancel(done["query_id"])["state"] == "succeeded"


def test_result_bound(spark, service):
    small = QueryService(service.engine, most_rows=10)
    q = small.wait(small.submit("SELECT o_orderkey FROM orders")["query_id"], 60)
    assert q["state"] == "failed" and q["error"]["code"] == "RESOURCE_EXHAUSTED"
    assert small.wait(small.submit("SELECT o_orderkey FROM orders LIMIT 10")["query_id"], 60)["state"] == "succeeded"


def test_advisor():
    j = Join("j1", "repartition", 5 << 20, True)
    d = Diagnostics([Operator("ShuffleExchange", "", {"shuffleBytesWritten": 65 << 20}), Operator("Sort", "", {"spillSize": 1})], [j, Join("j2", "broadcast", 11 << 20, False)], [[100, 2 << 20, 100]])
    out = advisor.advise(d)
    assert [f["code"] for f in out["findings"]] == ["HIGH_SHUFFLE", "JOIN_BROADCAST_SIZE:j2", "MISSING_STATISTICS:j2", "OPERATOR_SPILL", "SHUFFLE_SKEW", "JOIN_BROADCAST_CANDIDATE:j1"]
    worst = advisor.advise(Diagnostics([Operator("Sort", "", {"spillSize": 65 << 20})]))["findings"][0]
    assert worst["severity"] == "critical"
    assert advisor.advise(Diagnostics()) == {"status": "no_recommendations", "findings": []}


def test_http_and_cli(service, tmp_path, capsys):
    with server(service) as s:
        threading.Thread(target=s.serve_forever, daemon=True).start()
        url = f"http://127.0.0.1:{s.server_address[1]}"
        run = lambda *a: (cli.main(["--url", url, *a]), capsys.readouterr())
        code, out = run("query", "SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey", "--page-size", "10")
        got = json.loads(out.out)
        assert code == 0 and len(got["rows"]) == 25 and got["columns"] == ["n_nationkey", "n_name"]
        assert run("query", "SELECT broken FROM nation")[0] == 1
        assert json.loads(run("explain", "SELECT n_name FROM nation LIMIT 1")[1].out)["logical"]["node_type"] == "LIMIT"
        q = json.loads(run("query", "--no-wait", "SELECT n_name FROM nation")[1].out)["query_id"]
        service.wait(q, 60)
        assert json.loads(run("status", q)[1].out)["state"] == "succeeded" and json.loads(run("cancel", q)[1].out)["state"] == "succeeded"
        (tmp_path / "in.csv").write_text("id,v\n1,a\n2,\n")
        assert run("catalog", "create-namespace", "lab")[0] == 0
        schema = '{"fields": [{"name": "id", "data_type": "int64"}, {"name": "v", "data_type": "string"}]}'
        assert run("catalog", "create-table", "lab", "t", "--format", "parquet", "--location", f"{tmp_path}/t", "--schema", schema)[0] == 0
        code, out = run("import", "lab", "t", f"{tmp_path}/in.csv", "--source-format", "csv", "--partitions", "2", "--key", "id")
        assert code == 0 and json.loads(out.out)["table"]["statistics"]["row_count"] == 2
        assert json.loads(run("query", "SELECT COUNT(v) AS n FROM lab.t")[1].out)["rows"] == [[1]]
        assert run("catalog", "delete-namespace", "lab")[0] == 1
        assert [t["name"] for t in json.loads(run("catalog", "tables", "lab")[1].out)["tables"]] == ["t"] and "lab" in run("catalog", "namespaces")[1].out
        assert run("catalog", "delete-table", "lab", "t")[0] == 0 and run("catalog", "delete-namespace", "lab")[0] == 0
        client = cli.Client(url)
        assert client.call("GET", "/nodes")["nodes"] and client.call("GET", f"/queries/{q}/advisor")["status"]
        for method, path, body, status in (("GET", "/queries/none", None, 404), ("POST", "/queries", {}, 422), ("GET", "/nothing", None, 404), ("GET", f"/queries/{q}/results?limit=0", None, 422)):
            with pytest.raises(urllib.error.HTTPError) as e:
                client.call(method, path, body)
            assert e.value.code == status and "code" in json.loads(e.value.read())["error"]
        s.shutdown()


def test_settings_come_from_the_environment():
    from quarry.settings import Settings

    assert Settings.of({}) == Settings()
    got = Settings.of({"QUARRY_WORKERS": "9", "QUARRY_URL": "http://x", "QUARRY_KEEP_SECONDS": "1.5", "OTHER": "1"})
    assert (got.workers, got.url, got.keep_seconds, got.most_rows) == (9, "http://x", 1.5, 1_000_000)
    for bad in ({"QUARRY_WORKERS": "many"}, {"QUARRY_MOST_ROWS": "0"}):
        with pytest.raises(EngineError):
            Settings.of(bad)


def test_results_expire(spark):
    service = QueryService(Engine(spark).register("t", spark.range(30)), held_rows=50)
    ids = [service.submit("SELECT id FROM t")["query_id"] for _ in range(1)]
    service.wait(ids[0], 60)
    assert service.results(ids[0])["total"] == 30
    ids.append(service.submit("SELECT id FROM t")["query_id"])
    service.wait(ids[1], 60)
    assert service.results(ids[1])["total"] == 30
    with pytest.raises(EngineError, match="expired") as e:
        service.results(ids[0])
    assert e.value.code is ErrorCode.NOT_FOUND and service.get(ids[0])["state"] == "succeeded"
    service.keep_seconds = 0
    with pytest.raises(EngineError, match="expired"):
        service.results(ids[1])
    service.close()


def test_task_facts_and_evidence(spark):
    service = QueryService(Engine(spark).register("t", spark.range(1000).selectExpr("id", "id % 7 AS k")))
    q = service.submit("SELECT k, COUNT(*) AS n FROM t GROUP BY k")["query_id"]
    assert service.wait(q, 60)["state"] == "succeeded"
    stages = service.metrics(q)["stages"]
    assert sum(s["shuffle_rows_written"] for s in stages) >= 7 and sum(s["shuffle_rows_written"] for s in stages) == sum(s["shuffle_rows_read"] for s in stages)
    assert all(s["retries"] == 0 and {t["status"] for t in s["task_attempts"]} <= {"SUCCESS"} for s in stages) and any(s["task_attempts"] for s in stages)
    found = advisor.advise(diagnostics.Diagnostics(shuffle_partitions=[[1 << 20, 10 << 20, 1 << 20]]))["findings"][0]
    assert found["code"] == "SHUFFLE_SKEW" and found["evidence"]["threshold"] == 3.0 and found["cause"] and found["effect"]
    service.close()


def test_estimates_alternatives_and_runtime_filters(spark):
    folder = "/root/testdata/sf0.01"
    engine = Engine(spark).register_folder(folder, ["lineitem", "orders", "nation", "region"])
    plan = engine.explain("SELECT n.n_name FROM nation n LEFT JOIN region r ON n.n_regionkey = r.r_regionkey")
    assert plan["estimates"][0]["size_bytes"] > 0 and {"Join", "Project"} <= {e["node"] for e in plan["estimates"]}
    left, right, whole = plan["alternatives"][0]["alternatives"]
    assert "keep the rows" in left["rejected"] and right["rejected"] is None and whole["rejected"] and plan["joins"][0]["build"] == "right"
    changed = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0"}
    before = {k: spark.conf.get(k) for k in changed}
    sql = "SELECT l.l_orderkey, o.o_totalprice FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE o.o_totalprice > 400000"
    want = sorted(map(tuple, engine.sql(sql).collect()))
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        plan = engine.explain(sql)
        assert plan["runtime_filters"]["bloom"] > 0 and {a["rejected"] for a in plan["alternatives"][0]["alternatives"]} == {"broadcasts are off", None}
        df = engine.sql(sql)
        assert sorted(map(tuple, df.collect())) == want and len(want) > 0
        ran = diagnostics.collect(df)
        read, joined = (sum(o.metrics.get("numOutputRows", 0) for o in ran.operators if o.name == name) for name in ("FileSourceScan", "Filter"))
        assert 0 < joined < read  # the filter kept rows of lineitem from the join
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
