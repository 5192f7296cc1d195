import json
import re
import struct

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.catalog import Catalog
from quarry.engine import Engine
from quarry.errors import EngineError, ErrorCode
from quarry.importer import statistics
from quarry.sources import avro, files, iceberg
from quarry.sources.predicates import Combined, Compare
from quarry.streaming import queries as streams

ROWS = [(1, "north", 10.5), (2, "south", 20.0), (3, None, 30.5), (4, "west", 40.0)]
SCHEMA = "order_id long, region string, amount double"
FIELDS = [{"name": "order_id", "data_type": "int64", "nullable": False}, {"name": "region", "data_type": "string"}, {"name": "amount", "data_type": "float64"}]
AVRO = {"type": "record", "name": "o", "fields": [{"name": "order_id", "type": "long"}, {"name": "region", "type": ["null", "string"]}, {"name": "amount", "type": "double"}]}


@pytest.fixture(scope="module")
def places(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("formats")
    df = spark.createDataFrame(ROWS, SCHEMA).coalesce(1)
    (d / "csv").mkdir()
    (d / "csv" / "a.csv").write_text("order_id,region,amount\n1,north,10.5\n2,south,20.0\n3,,30.5\n4,west,40.0\n")
    df.write.parquet(str(d / "parquet"))
    df.write.orc(str(d / "orc"))
    (d / "avro").mkdir()
    for codec in ("null", "deflate"):
        rows = [dict(zip(("order_id", "region", "amount"), r)) for r in (ROWS[:2] if codec == "null" else ROWS[2:])]
        (d / "avro" / f"{codec}.avro").write_bytes(avro.write_file(rows, AVRO, codec))
    _iceberg(spark, d / "iceberg", df)
    return {f: str(d / f) for f in ("csv", "parquet", "orc", "avro", "iceberg")}


def _iceberg(spark, root, df, deleted=()):
    (root / "metadata").mkdir(parents=True)
    df.write.parquet(str(root / "data"))
    entry = lambda p, content: {"status": 1, "data_file": {"content": content, "file_path": f"file://{p}", "file_format": "PARQUET"}}
    entries = [entry(p, 0) for p in (root / "data").glob("*.parquet")]
    if deleted:
        where = str(next((root / "data").glob("*.parquet")))
        spark.createDataFrame([(f"file://{where}", p) for p in deleted], "file_path string, pos long").coalesce(1).write.parquet(str(root / "deletes"))
        entries += [entry(p, 1) for p in (root / "deletes").glob("*.parquet")]
    file = {"type": "record", "name": "f", "fields": [{"name": "content", "type": "int"}, {"name": "file_path", "type": "string"}, {"name": "file_format", "type": "string"}]}
    manifest = {"type": "record", "name": "m", "fields": [{"name": "status", "type": "int"}, {"name": "data_file", "type": file}]}
    (root / "metadata" / "m.avro").write_bytes(avro.write_file(entries, manifest))
    (root / "metadata" / "l.avro").write_bytes(avro.write_file([{"manifest_path": f"file://{root}/metadata/m.avro"}], {"type": "record", "name": "l", "fields": [{"name": "manifest_path", "type": "string"}]}))
    fields = [{"id": i, "name": n, "required": False, "type": k} for i, (n, k) in enumerate((("order_id", "long"), ("region", "string"), ("amount", "double")))]
    meta = {"current-snapshot-id": 7, "current-schema-id": 0, "schemas": [{"schema-id": 0, "type": "struct", "fields": fields}], "snapshots": [{"snapshot-id": 7, "manifest-list": f"file://{root}/metadata/l.avro"}]}
    for name in ("v1", "v2"):
        (root / "metadata" / f"{name}.metadata.json").write_text(json.dumps(meta if name == "v2" else meta | {"current-snapshot-id": -1}))


@pytest.mark.parametrize("fmt", ["csv", "parquet", "orc", "avro", "iceberg"])
def test_formats(spark, places, fmt):
    request = files.ScanRequest(["order_id", "region"], Compare("amount", "ge", 20.0))
    assert sorted(tuple(r) for r in files.scan(spark, fmt, places[fmt], request=request).collect()) == [(2, "south"), (3, None), (4, "west")]
    with pytest.raises(EngineError, match="Unknown columns"):
        files.scan(spark, fmt, places[fmt], request=files.ScanRequest(["nope"]))
    c = Catalog()
    c.create_namespace("default")
    c.create_table("default", "orders", FIELDS, fmt, places[fmt])
    assert {tuple(r) for r in Engine(spark, c).sql("SELECT region, amount + 1 AS a FROM orders WHERE order_id > 2").collect()} == {("west", 41.0), (None, 31.5)}
    assert Engine(spark, c).sql("SELECT COUNT(*) AS n, SUM(order_id) AS s FROM orders").first() == (4, 10)


def test_predicates(spark, places):
    got = lambda p: sorted(r[0] for r in files.scan(spark, "parquet", places["parquet"], request=files.ScanRequest(["order_id"], p)).collect())
    assert got(Compare("region", "is_null")) == [3] and got(Compare("region", "is_not_null")) == [1, 2, 4] and got(Compare("order_id", "in", (1, 9))) == [1]
    assert got(Combined("or", (Compare("order_id", "eq", 1), Combined("and", (Compare("amount", "gt", 30.0), Combined("not", (Compare("order_id", "not_in", (3,)),))))))) == [1, 3]
    assert got(Compare("order_id", "ne", 1)) == [2, 3, 4] and got(Compare("order_id", "lt", 2)) == [1] and got(Compare("order_id", "le", 2)) == [1, 2]
    plan = files.scan(spark, "parquet", places["parquet"], request=files.ScanRequest(["order_id"], Compare("amount", "ge", 20.0)))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(amount,20.0)" in plan and "region" not in plan.split("ReadSchema")[1]


def test_missing_and_broken_sources(spark, tmp_path):
    with pytest.raises(EngineError) as e:
        files.read(spark, "parquet", str(tmp_path / "nowhere"))
    assert e.value.code is ErrorCode.NOT_FOUND and e.value.status == 404
    with pytest.raises(EngineError, match="Unknown format"):
        files.read(spark, "xml", "x")
    with pytest.raises(ValueError, match="Malformed"):
        list(avro.records(b"nonsense"))


def test_object_store_settings(spark):
    from quarry.sources import store

    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.unset("fs.s3a.endpoint")
    with pytest.raises(EngineError, match="No object store"):
        files.read(spark, "parquet", "s3://bucket/x")
    store.configure_s3(spark, "http://localhost:9000", "key", "secret")
    assert store.resolved(spark, "s3://bucket/x") == "s3a://bucket/x" and conf.get("fs.s3a.path.style.access") == "true" and store.resolved(spark, "/a") == "/a"
    conf.unset("fs.s3a.endpoint")


def test_avro_missing_field_is_null_and_nested(spark, places, tmp_path):
    from pyspark.sql import types as T

    wide = T.StructType([T.StructField("region", T.StringType()), T.StructField("extra", T.LongType())])
    assert {tuple(r) for r in avro.read(spark, places["avro"], wide).collect()} == {("north", None), ("south", None), (None, None), ("west", None)}
    inner = {"type": "record", "name": "p", "fields": [{"name": "q", "type": "double"}]}
    nested = {"type": "record", "name": "r", "fields": [{"name": "a", "type": {"type": "array", "items": "long"}}, {"name": "s", "type": inner}, {"name": "d", "type": {"type": "int", "logicalType": "date"}}, {"name": "m", "type": {"type": "map", "values": "string"}}]}
    (tmp_path / "n.avro").write_bytes(avro.write_file([{"a": [1, -300], "s": {"q": 0.5}, "d": 1, "m": {"k": "v"}}], nested))
    r = avro.read(spark, str(tmp_path / "n.avro")).first()
    assert (r["a"], r["s"]["q"], str(r["d"]), r["m"]) == ([1, -300], 0.5, "1970-01-02", {"k": "v"})


def test_iceberg_position_deletes(spark, tmp_path):
    _iceberg(spark, tmp_path / "t", spark.createDataFrame(ROWS, SCHEMA).coalesce(1), deleted=(0, 2))
    assert sorted(r["order_id"] for r in files.read(spark, "iceberg", str(tmp_path / "t")).collect()) == [2, 4]


NUMBER = {"type": "array", "items": {"type": "record", "name": "kn", "fields": [{"name": "key", "type": "int"}, {"name": "value", "type": "long"}]}}
BOUND = {"type": "array", "items": {"type": "record", "name": "kb", "fields": [{"name": "key", "type": "int"}, {"name": "value", "type": "bytes"}]}}


def _table(spark, root, data, fields, deletes=(), older=()):
    """An Iceberg table as a writer makes it. data: (sequence, schema with field ids, rows, bounds by id); deletes: (sequence, equality id, schema, rows)."""
    (root / "metadata").mkdir(parents=True)
    types = {"long": "long", "string": "string", "double": "double"}

    def write(name, names, rows):
        schema = T.StructType([T.StructField(n, T._parse_datatype_string(types[k]), True, {"parquet.field.id": i} if i else {}) for i, n, k in names])
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(root / name))
        return "file://" + str(next((root / name).glob("*.parquet")))

    def packed(v):
        return v.encode() if isinstance(v, str) else struct.pack("<d", v) if isinstance(v, float) else v.to_bytes(8, "little", signed=True)

    file = {"type": "record", "name": "f", "fields": [
        {"name": "content", "type": "int"}, {"name": "file_path", "type": "string"}, {"name": "file_format", "type": "string"}, {"name": "record_count", "type": "long"}, {"name": "file_size_in_bytes", "type": "long"},
        {"name": "null_value_counts", "type": NUMBER}, {"name": "lower_bounds", "type": BOUND}, {"name": "upper_bounds", "type": BOUND | {"items": BOUND["items"] | {"name": "kb2"}}}, {"name": "equality_ids", "type": {"type": "array", "items": "int"}},
    ]}
    manifest = {"type": "record", "name": "m", "fields": [{"name": "status", "type": "int"}, {"name": "sequence_number", "type": ["null", "long"]}, {"name": "data_file", "type": file}]}
    listed = []
    for k, (sequence, names, rows, bounds) in enumerate(data):
        path = write(f"data{k}", names, rows)
        part = lambda j, b=bounds: [{"key": i, "value": packed(v[j])} for i, v in b.items()]
        nulls = [{"key": i, "value": sum(r[c] is None for r in rows)} for c, (i, _, _) in enumerate(names) if i]
        listed.append((sequence, {"content": 0, "file_path": path, "record_count": len(rows), "null_value_counts": nulls, "lower_bounds": part(0), "upper_bounds": part(1), "equality_ids": []}))
    for k, (sequence, ids, names, rows) in enumerate(deletes):
        listed.append((sequence, {"content": 2, "file_path": write(f"gone{k}", names, rows), "record_count": len(rows), "null_value_counts": [], "lower_bounds": [], "upper_bounds": [], "equality_ids": ids}))
    heads = []
    for k, (sequence, f) in enumerate(listed):
        where = root / "metadata" / f"m{k}.avro"
        where.write_bytes(avro.write_file([{"status": 1, "sequence_number": None, "data_file": f | {"file_format": "parquet", "file_size_in_bytes": 1000}}], manifest))
        heads.append({"manifest_path": f"file://{where}", "sequence_number": sequence})
    (root / "metadata" / "l.avro").write_bytes(avro.write_file(heads, {"type": "record", "name": "l", "fields": [{"name": "manifest_path", "type": "string"}, {"name": "sequence_number", "type": "long"}]}))
    made = [{"schema-id": v, "type": "struct", "fields": [{"id": i, "name": n, "required": False, "type": k} for i, n, k in each]} for v, each in ((1, older), (2, fields))]
    meta = {"current-snapshot-id": 7, "current-schema-id": 2, "schemas": made}
    (root / "metadata" / "v3.metadata.json").write_text(json.dumps(meta | {"snapshots": [{"snapshot-id": 7, "manifest-list": f"file://{root}/metadata/l.avro"}]}))
    return str(root)


def test_iceberg_columns_go_by_field_id(spark, tmp_path):
    """b was renamed to c, then another b was added: old files have no value for it."""
    old, new = [(1, "a", "long"), (2, "b", "string")], [(1, "a", "long"), (2, "c", "string"), (3, "b", "double")]
    where = _table(spark, tmp_path / "t", [(1, old, [(1, "x"), (2, None)], {}), (2, new, [(3, "y", 0.5)], {})], new, older=old)
    got = files.read(spark, "iceberg", where)
    assert got.columns == ["a", "c", "b"] and sorted(map(tuple, got.collect())) == [(1, "x", None), (2, None, None), (3, "y", 0.5)]
    nameless = [(None, n, k) for _, n, k in new]
    plain = files.read(spark, "iceberg", _table(spark, tmp_path / "u", [(1, nameless, [(4, "z", 1.5)], {})], new))
    assert [tuple(r) for r in plain.collect()] == [(4, "z", 1.5)]
    same = files.read(spark, "iceberg", _table(spark, tmp_path / "v", [(1, old, [(1, "x")], {})], old)).where("a = 1")
    assert "EqualTo(a,1)" in same._jdf.queryExecution().executedPlan().toString() and [tuple(r) for r in same.collect()] == [(1, "x")]


def test_iceberg_equality_deletes(spark, tmp_path):
    """Deletes reach files that are older than they are; nulls are equal."""
    cols = [(1, "a", "long"), (2, "b", "string")]
    rows = [(1, "x"), (2, None), (3, "y"), (None, "z")]
    deletes = [(2, [2], cols[1:], [("x",), (None,)]), (2, [1], cols[:1], [(None,)])]
    where = _table(spark, tmp_path / "t", [(1, cols, rows, {}), (2, cols, [(5, "x"), (6, None)], {})], cols, deletes)
    assert sorted(map(tuple, files.read(spark, "iceberg", where).collect()), key=str) == [(3, "y"), (5, "x"), (6, None)]
    found = {len(t.delete_files): t.row_count for t in files.tasks(spark, "iceberg", where)}
    assert found == {2: 4, 0: 2}


@pytest.mark.parametrize(
    ("predicate", "left"),
    [
        (Compare("a", "gt", 10), [1, 2]), (Compare("a", "eq", 5), [0]), (Compare("a", "in", (1, 25)), [0, 2]), (Compare("b", "lt", "n"), [0]), (Compare("b", "ge", "zz"), []), (Compare("a", "is_null"), [1]), (Compare("a", "ne", 5), [0, 1, 2]),
        (Combined("and", (Compare("a", "gt", 10), Compare("b", "eq", "q"))), [1]), (Combined("or", (Compare("a", "lt", 3), Compare("a", "gt", 22))), [0, 2]), (Combined("not", (Compare("a", "gt", 10),)), [0, 1, 2]),
    ],
)
def test_iceberg_pruning(spark, tmp_path, predicate, left):
    cols = [(1, "a", "long"), (2, "b", "string")]
    parts = [[(1, "a"), (9, "m")], [(11, "p"), (None, "q"), (19, "r")], [(21, "s"), (29, "t")]]
    bounds = [{1: (p[0][0], p[-1][0]), 2: (p[0][1], p[-1][1])} for p in parts]
    where = _table(spark, tmp_path / "t", [(1, cols, p, b) for p, b in zip(parts, bounds)], cols)
    planned = iceberg.plan(spark, where, None, predicate)
    assert planned.files == 3 and sorted(int(re.search(r"data(\d)", f.path)[1]) for f in planned.data) == left
    every = spark.createDataFrame([r for p in parts for r in p], "a long, b string").where(predicate.col())
    got = files.scan(spark, "iceberg", where, request=files.ScanRequest(predicate=predicate))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, every.collect()), key=str)


def test_scan_tasks(spark, places):
    found = files.tasks(spark, "parquet", places["parquet"], max_bytes=500)
    assert found[0].start == 0 and [t.start for t in found] == [500 * i for i in range(len(found))] and all(0 < t.length <= 500 for t in found)
    assert {t.format for t in files.tasks(spark, "avro", places["avro"])} == {"avro"} and len(files.tasks(spark, "avro", places["avro"])) == 2


def test_avro_unions(spark, tmp_path):
    union = lambda *k: {"type": "record", "name": "u", "fields": [{"name": "x", "type": ["null", *k]}]}
    assert avro.schema_in(avro.write_file([], union("int", "double", "long"))).fields[0].dataType == T.DoubleType()
    with pytest.raises(ValueError, match="union"):
        avro.schema_in(avro.write_file([], union("string", "long")))
    (tmp_path / "u.avro").write_bytes(avro.write_file([{"x": 3}, {"x": None}], union("long", "double")))
    assert [r["x"] for r in avro.read(spark, str(tmp_path / "u.avro")).collect()] == [3.0, None]


def test_catalog(tmp_path):
    c = Catalog(str(tmp_path / "c.sqlite"))
    c.create_namespace("sales", {"owner": "x"})
    with pytest.raises(EngineError) as e:
        c.create_namespace("sales")
    assert e.value.code is ErrorCode.CONFLICT
    with pytest.raises(EngineError):
        c.create_namespace("bad name")
    c.create_table("sales", "orders", FIELDS, "parquet", "/x", "hash", ["region"])
    with pytest.raises(EngineError, match="not in the schema"):
        c.create_table("sales", "other", FIELDS, "parquet", "/x", keys=["nope"])
    with pytest.raises(EngineError, match="has tables"):
        c.delete_namespace("sales")
    c.close()
    c = Catalog(str(tmp_path / "c.sqlite"))
    assert c.table("sales", "ORDERS")["partition_keys"] == ["region"] and c.namespaces()[0]["properties"] == {"owner": "x"}
    assert c.update_table("sales", "orders", location="/y")["location"] == "/y" and c.update_namespace("sales", {})["properties"] == {}
    c.delete_table("sales", "orders")
    c.delete_namespace("sales")
    with pytest.raises(EngineError) as e:
        c.namespace("sales")
    assert e.value.status == 404


@pytest.mark.parametrize(("fmt", "key", "n"), [("parquet", "region", 3), ("orc", None, 2), ("csv", None, 1)])
def test_import(spark, places, tmp_path, fmt, key, n):
    c = Catalog()
    c.create_namespace("default")
    c.create_table("default", "t", FIELDS, fmt, f"{tmp_path}/t")
    e = Engine(spark, c)
    for _ in range(2):
        out = e.importer().import_table("default", "t", places["csv"], "csv", n, key)
    doc = out["table"]
    assert len(doc["partitions"]) == n and sum(p["row_count"] for p in doc["partitions"]) == 4 and doc["partition_strategy"] == ("hash" if key else "round_robin" if n > 1 else "single")
    assert doc["statistics"]["columns"]["region"] | {"average_size_bytes": 0} == {"null_count": 1, "distinct_count": 3, "min_value": "north", "max_value": "west", "average_size_bytes": 0}
    manifest = json.loads((tmp_path / "t" / "_manifest.json").read_text())
    assert manifest["version"] == 1 and manifest["statistics"]["row_count"] == 4
    assert e.sql("SELECT COUNT(*) AS n, COUNT(region) AS r, SUM(order_id) AS s FROM t").first() == (4, 3, 10)
    before = (tmp_path / "t" / "_manifest.json").read_text()
    spark.createDataFrame([(1,)], "x int").write.mode("overwrite").parquet(f"{tmp_path}/odd")
    with pytest.raises(EngineError, match="columns differ"):
        e.importer().import_table("default", "t", f"{tmp_path}/odd", "parquet")
    with pytest.raises(EngineError, match="cannot be imported"):
        e.importer().import_table("default", "t", places["avro"], "avro")
    assert (tmp_path / "t" / "_manifest.json").read_text() == before


def test_statistics_sketched(spark):
    s = statistics(spark.range(1000).select((F.col("id") % 10).alias("k"), F.array("id").alias("a"), "id"), exact=["k"])
    assert s["row_count"] == 1000 and s["columns"]["k"]["distinct_count"] == 10 and 900 < s["columns"]["id"]["distinct_count"] < 1100 and s["columns"]["a"]["null_count"] == 0


def test_streaming_select(spark, places, tmp_path):
    schema = spark.createDataFrame([], SCHEMA).schema
    e = Engine(spark).register("orders", streams.source(spark, "parquet", places["parquet"], schema))
    df = e.sql("SELECT region, COUNT(*) AS n FROM orders WHERE amount > 15 GROUP BY region")
    assert df.isStreaming
    streams.start(df, "by_region", "complete", str(tmp_path / "ck")).awaitTermination(60)
    assert {tuple(r) for r in spark.table("by_region").collect()} == {("south", 1), (None, 1), ("west", 1)}


def test_stored_by_key_joins_without_shuffle(spark):
    from quarry.sources import buckets

    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    customer = spark.read.parquet("/root/testdata/sf0.001/customer.parquet")
    e = Engine(spark)
    e.register("orders", buckets.store(orders, "stored_orders", "o_custkey", 4)).register("customer", buckets.store(customer, "stored_customer", "c_custkey", 4))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = e.explain("SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey")
        assert "Exchange" not in plan["physical"] and plan["joins"][0]["strategy"] == "repartition" and plan["estimate"]["rows"]
        assert "Exchange" not in e.explain("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey")["physical"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        buckets.drop(spark, "stored_orders")
        buckets.drop(spark, "stored_customer")
    with pytest.raises(EngineError):
        buckets.store(orders, "x", "nope", 4)
