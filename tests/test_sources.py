"""CSV layouts, stores and exports."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threatlake import schemas
from threatlake.operators import iforest
from threatlake.sources import flow_csv, ingest, model_store, sinks


def write(path, text):
    path.write_text(text)
    return str(path)


def test_layout_a(spark, tmp_path):
    f = write(tmp_path / "a.csv", " Source IP, Destination IP, Source Port, Destination Port, Protocol, Flow Duration, Total Fwd Packets, Total Backward Packets, Flow Packets/s, Label\n"
              "1.1.1.1,2.2.2.2,1000,80,6,5,3,4,Infinity, Benign \n1.1.1.1,2.2.2.2,abc,443,6,7,3,4,2.5,DDoS\n1.1.1.1,2.2.2.2,1,443,6,inf,3,4,2.5,DDoS\n")
    rows = flow_csv.unify_a(flow_csv.read_csv(spark, f)).orderBy("duration").collect()
    assert [(r.duration, r.src_port, r.rate, r.label) for r in rows] == [(5.0, 1000, 0.0, 0), (7.0, 0, 2.5, 1)]


def test_layout_b_and_merge(spark, tmp_path):
    head = "srcip,sport,dstip,dsport,proto,state,dur,sbytes,dbytes,service,spkts,attack_cat,label\n"
    f = write(tmp_path / "b.csv", head + "1.1.1.1,1,2.2.2.2,80,udp,CON,0,10,20,dns,4,,0\n1.1.1.1,1,2.2.2.2,80,tcp,FIN,2,10,20,http,4,DoS,1\n")
    b = flow_csv.unify_b(flow_csv.read_csv(spark, f))
    got = {r.label: (r.protocol, r.rate) for r in b.collect()}
    assert got == {0: (1.0, 4000.0), 1: (0.0, 2.0)}
    merged = flow_csv.merge(b, b)
    assert merged.columns == flow_csv.UNIFIED and merged.count() == 4
    bare = write(tmp_path / "c.csv", "1.1.1.1,5\n")
    named = flow_csv.read_csv(spark, bare, T.StructType([T.StructField("srcip", T.StringType()), T.StructField("sport", T.IntegerType())]))
    assert named.first()[:] == ("1.1.1.1", "5")


def test_folder_of_differing_headers(spark, tmp_path):
    """Three header lines, two of one layout in another order, files split into several blocks, and one that is unknown."""
    folder = tmp_path / "in"
    folder.mkdir()
    many = "".join(f"{k}.5,6,3,4,80,BENIGN\n" for k in range(3000))
    write(folder / "a1.csv", " Flow Duration, Protocol, Total Fwd Packets, Total Backward Packets, Destination Port, Label\n" + many)
    write(folder / "a2.csv", "Label,Flow Duration,Destination Port\nDDoS,5,443\nDDoS,7,443\n")
    write(folder / "a3.csv", "Label,Flow Duration,Destination Port\nDDoS,9,22\n")
    write(folder / "b.csv", "srcip,proto,dur,sbytes,spkts,dsport,label\n1.1.1.1,udp,2,10,4,53,1\n1.1.1.1,tcp,2,10,4,53,0\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        found = {len(r.files): r.header for r in flow_csv.header_lines(spark, str(folder)).collect()}
        assert sorted(found) == [1, 2] and found[2].startswith("Label,")
        rows = flow_csv.register(spark, str(folder))
        assert rows.columns == flow_csv.UNIFIED and rows.count() == 3005
        assert {(r.label, r.dst_port): r["count"] for r in rows.groupBy("label", "dst_port").count().collect()} == {(0, 80): 3000, (1, 443): 2, (1, 22): 1, (1, 53): 1, (0, 53): 1}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    write(folder / "c.csv", "x,y\n1,2\n")
    with pytest.raises(ValueError, match="no known layout"):
        flow_csv.register(spark, str(folder))


def test_records(spark):
    df = spark.createDataFrame([(1, "9.9.9.9", "x"), (2, None, "443")], "id int, source_ip string, dest_port string")
    a, b = ingest.to_records(df, "id", 5).orderBy("id").collect()
    assert (a.source_ip, a.dest_port) == ("9.9.9.9", 80) and (b.source_ip, b.dest_port, b.protocol) == ("192.168.1.1", 443, "TCP")


def test_exports(spark, tmp_path):
    actions = spark.range(2).select(F.current_timestamp().alias("executed_at"), F.lit("1.1.1.1").alias("target_ip"), F.lit("BLOCK").alias("action_type"),
                                    F.lit(True).alias("success"), F.lit(5).alias("execution_time_ms"), F.lit(None).cast("string").alias("error_message"))
    sinks.export_actions_csv(actions, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["Time", "IP", "Action", "Success", "Execution Time (ms)", "Error"]
    sinks.store_scenarios(spark.range(3).select(F.concat(F.lit("sc_"), "id").alias("scenario_id"), F.current_timestamp().alias("created_at")), str(tmp_path / "sc"))
    assert {r[0] for r in sinks.list_scenarios(spark, str(tmp_path / "sc")).collect()} == {"sc_0", "sc_1", "sc_2"}


def test_model_store(spark, tmp_path):
    df = spark.range(300).select("id", (F.col("id") % 17).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("y"))
    model = iforest.fit(df, ["x", "y"], "id", trees=10, subsample=32)
    root = str(tmp_path / "models")
    assert model_store.load(spark, root, "f") is None
    model_store.save(spark, model, root, "f", 1)
    model_store.save(spark, model, root, "f", 2)
    again = model_store.load(spark, root, "f")
    assert model_store.current_version(spark, root, "f") == 2
    a, b = df.select(iforest.raw_score(model).alias("s")).collect(), df.select(iforest.raw_score(again).alias("s")).collect()
    assert a == b
    with pytest.raises(ValueError):
        model_store.require_features(again, ["y", "x"])


def test_allowed_values(spark):
    df = spark.createDataFrame([("BLOCK",), ("NUKE",)], "action_taken string")
    assert [r[0] for r in schemas.violations(df).collect()] == ["NUKE"]
    for name in dir(schemas):
        value = getattr(schemas, name)
        if name.isupper() and isinstance(value, str):
            T.StructType.fromDDL(value)
