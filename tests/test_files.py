"""Files written and read again, broken input, and a stream with late rows and a restart."""

import gzip
import json

from pyspark.sql import functions as F

from platewise import streaming
from platewise.operators import tables as T
from platewise.sources import files

SCHEMA = "id long, name string, v double"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b', 1.5), (2, "line\nfeed", None), (3, "é;x", -2.0)], SCHEMA)
    files.write_csv(df, f"{tmp_path}/a.csv", one_file=True)
    assert rows(files.read_csv(spark, f"{tmp_path}/a.csv", SCHEMA)) == rows(df)
    assert rows(files.read_any(spark, f"{tmp_path}/a.csv", ["name"], SCHEMA)) == rows(df.select("name"))
    (tmp_path / "b.csv").write_bytes("id;name\n1;caf\xe9\nx;y\n".encode("latin-1"))
    assert rows(files.read_csv(spark, f"{tmp_path}/b.csv", "id long, name string", encoding="ISO-8859-1")) == [(1, "café"), (None, "y")]
    with gzip.open(tmp_path / "c.tsv.gz", "wt") as f:
        f.write("id\tname\n7\tseven\n")
    assert rows(files.read_any(spark, f"{tmp_path}/c.tsv.gz")) == [(7, "seven")]
    try:
        files.read_any(spark, f"{tmp_path}/a.csv", ["none"], SCHEMA)
        raise AssertionError
    except KeyError:
        pass
    plan = files.read_csv(spark, f"{tmp_path}/a.csv", SCHEMA).select("id")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint>" in plan


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "name": "a"}\n{"id": 2, "na\n\n{"id": 3, "name": null}\nnot json\n')
    good, bad = files.read_jsonl(spark, f"{tmp_path}/a.jsonl", "id long, name string")
    assert rows(good) == [(1, "a"), (3, None)] and sorted(r["line"] for r in bad.collect()) == ['not json', '{"id": 2, "na']
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken/x.jsonl").write_text('{"id": 1,\n "name": "old"}\n{"id": 2, "name": "br{ace\\"} in"}{"id": 1,\n\n"name": "new"}\n{"id": 9, "name"')
    assert rows(files.read_broken_jsonl(spark, f"{tmp_path}/broken", "id long, name string", "id")) == [(1, "new"), (2, 'br{ace"} in')]
    df = spark.createDataFrame([(1, None, 0.5), (2, "é", None)], SCHEMA)
    files.write_jsonl(df, f"{tmp_path}/out")
    assert files.finished(spark, f"{tmp_path}/out") and rows(files.read_jsonl(spark, f"{tmp_path}/out", SCHEMA)[0]) == rows(df)
    lines = [json.loads(r[0]) for r in spark.read.text(f"{tmp_path}/out").collect()]
    assert sorted(lines, key=lambda x: x["id"])[0] == {"id": 1, "name": None, "v": 0.5}


def test_graphml(spark, tmp_path):
    nodes = spark.createDataFrame([("u:1", "user", 'A & "B"'), ("r:1", "recipe", None)], "id string, node_type string, name string")
    edges = spark.createDataFrame([("u:1", "r:1", 5.0)], "source string, target string, weight double")
    files.write_graphml(nodes, edges, f"{tmp_path}/g")
    n, e = files.read_graphml(spark, f"{tmp_path}/g")
    assert {r["id"]: r["data"] for r in n.collect()} == {"u:1": {"node_type": "user", "name": 'A & "B"'}, "r:1": {"node_type": "recipe"}}
    assert [(r["source"], r["target"], r["data"]) for r in e.collect()] == [("u:1", "r:1", {"weight": "5.0"})]


def test_other_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], SCHEMA)
    files.write_parquet(df, f"{tmp_path}/p", ["name"])
    files.replaced(spark.read.parquet(f"{tmp_path}/p").where("id = 1"), f"{tmp_path}/p")
    assert spark.read.parquet(f"{tmp_path}/p").count() == 1 and spark.read.parquet(f"{tmp_path}/p.bak").count() == 2
    assert files.first_of(spark, [f"{tmp_path}/none", f"{tmp_path}/p"]) == f"{tmp_path}/p"
    assert "\\textbf{2.0000}" in files.latex(df.orderBy("id"), ["v"])
    arrays = spark.createDataFrame([(1, ["x", "y"]), (2, [])], "id long, xs array<string>")
    assert rows(files.first_items(arrays)) == [(1, "x"), (2, None)]


def test_columns(spark):
    df = spark.createDataFrame([("12.0", " A", float("nan"))], "` ID` string, Name string, v double")
    assert T.lower_names(df).columns == ["id", "name", "v"]
    named = T.canonical(T.lower_names(df), {"recipe_id": ["RecipeId", "ID"], "title": ["x"]})
    assert named.columns == ["recipe_id", "name", "v"] and T.subset(named, ["v", "none", "recipe_id"], {"recipe_id": "int"}).columns == ["v", "recipe_id"]
    got = named.select(T.int_or_kept(F.col("recipe_id")), T.int_or_kept(F.col("name")), T.finite(F.col("v"))).first()
    assert tuple(got) == ("12", " A", None)


def test_stream(spark, tmp_path):
    """Windows are written once over two runs from one checkpoint; a row later than the watermark is left out."""
    schema = "ts timestamp, event_type string, value double"

    def arrive(name, times):
        frame = spark.createDataFrame([(t, "view", 1.0) for t in times], "t string, event_type string, value double")
        frame.select(F.to_timestamp("t").alias("ts"), "event_type", "value").coalesce(1).write.parquet(f"{tmp_path}/{name}")
        (tmp_path / "in").mkdir(exist_ok=True)
        next((tmp_path / name).glob("part-*")).rename(tmp_path / f"in/{name}.parquet")

    def run():
        counts = streaming.windowed_counts(streaming.arriving(spark, f"{tmp_path}/in", schema, 1))
        streaming.caught_up(counts, f"{tmp_path}/out", f"{tmp_path}/state")
        return {r["start"].strftime("%H:%M"): r["n"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}

    arrive("a", ["2024-01-01 00:05:00", "2024-01-01 00:50:00", "2024-01-01 01:05:00"])
    arrive("b", ["2024-01-01 01:20:00", "2024-01-01 02:30:00"])
    first = run()
    assert first["00:00"] == 2
    arrive("c", ["2024-01-01 00:10:00", "2024-01-01 05:00:00"])
    arrive("d", ["2024-01-01 09:00:00"])
    second = run()
    assert second["00:00"] == 2 and second["01:00"] == 2 and second["02:00"] == 1
    table = spark.createDataFrame([("2024-01-01 00:00:00", "a", 1.0), ("2024-01-01 00:20:00", "a", 1.0), ("2024-01-01 02:00:00", "a", 1.0)], "ts string, event_type string, value double")
    assert sorted(r["n"] for r in streaming.session_counts(table).collect()) == [1, 2]
    assert sum(r["n"] for r in streaming.windowed_counts(table, "1 hour", "10 minutes", "30 minutes").collect()) == 6
