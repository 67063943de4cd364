"""Readers and writers of files: delimited text, JSON lines (also broken ones), GraphML, reports.

Schemas are declared where they are known, so that nothing is read twice and columns are pruned in the scan. Writers go
through Spark's commit, so a reader sees a whole folder or none.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from platewise.operators.tables import required


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return bool(fs.exists(at))


def finished(spark: SparkSession, folder: str) -> bool:
    """Whether a step's folder was committed."""
    return exists(spark, f"{folder}/_SUCCESS")


def first_of(spark: SparkSession, paths: Sequence[str]) -> str:
    """The first path that is there."""
    for p in paths:
        if exists(spark, p):
            return p
    raise FileNotFoundError(f"none of {list(paths)}")


def delimiter(spark: SparkSession, path: str, known: str = ",;\t") -> str:
    """The delimiter that the header has most of."""
    head = spark.read.text(path).limit(1).collect()
    line = head[0][0] if head else ""
    return max(known, key=lambda d: (line.count(d), -known.index(d)))


def read_csv(spark: SparkSession, path: str, schema: str | None = None, columns: Sequence[str] | None = None, sep: str | None = None, encoding: str = "UTF-8") -> DataFrame:
    """Delimited text with a header, gzip or not. A declared schema is coerced: what does not fit is null; without one it is inferred."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", encoding).option("sep", sep or delimiter(spark, path))
    df = reader.option("enforceSchema", False).schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return required(df, columns).select(*columns) if columns else df


def read_any(spark: SparkSession, path: str, columns: Sequence[str] | None = None, schema: str | None = None) -> DataFrame:
    """By extension: csv, tsv, txt (also .gz), json or jsonl, parquet."""
    name = path.rstrip("/").lower().removesuffix(".gz")
    kind = name.rsplit(".", 1)[-1]
    if kind in ("csv", "tsv", "txt"):
        return read_csv(spark, path, schema, columns, "\t" if kind == "tsv" else None)
    if kind in ("json", "jsonl"):
        df = spark.read.schema(schema).json(path) if schema else spark.read.json(path)
    elif kind == "parquet":
        df = spark.read.parquet(path)
    else:
        raise ValueError(f"no reader for .{kind}")
    return required(df, columns).select(*columns) if columns else df


def first_items(df: DataFrame) -> DataFrame:
    """Array columns replaced by their first element."""
    return df.select(*[F.get(f.name, F.lit(0)).alias(f.name) if isinstance(f.dataType, ArrayType) else F.col(f.name) for f in df.schema.fields])


def read_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(records, bad lines with their file): one JSON object a line; what cannot be read is kept, not raised."""
    lines = spark.read.text(path).select(F.col("value"), F.col("_metadata.file_path").alias("file")).where(F.trim("value") != "")
    parsed = lines.select("*", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return parsed.where("r._bad IS NULL").select("r.*").drop("_bad"), parsed.where("r._bad IS NOT NULL").select("file", F.col("value").alias("line"))


def objects(text: str) -> Iterator[str]:
    """The top-level {...} of a text, whatever stands between or inside strings."""
    depth, start, quoted, skip = 0, 0, False, False
    for i, c in enumerate(text):
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = depth > 0
        elif c == "{":
            start, depth = (i, 1) if depth == 0 else (start, depth + 1)
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                yield text[start : i + 1]


def read_broken_jsonl(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """Objects that run over several lines, put together again; of a key's objects the last in its file wins (ties: the last file).

    A file is one record here, as its objects cannot be told apart before: files must be of a size that a task can hold."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for file, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                good = []
                for i, o in enumerate(objects(text or "")):
                    try:
                        json.loads(o)
                    except ValueError:
                        continue
                    good.append((file, i, o))
                if good:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*good, strict=True)], ["file", "place", "object"])

    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    rows = whole.mapInArrow(run, "file string, place long, object string").select("file", "place", F.from_json("object", schema).alias("r"))
    return rows.groupBy(f"r.{key}").agg(F.max_by("r", F.struct("file", "place")).alias("r")).select("r.*")


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes: id, data), (edges: source, target, data); data is a map of key to text."""
    data = "array<struct<_key:string,_VALUE:string>>"
    as_map = F.map_from_entries(F.transform(F.coalesce("data", F.array().cast(data)), lambda d: F.struct(d["_key"], d["_VALUE"]))).alias("data")
    nodes = spark.read.format("xml").option("rowTag", "node").schema(f"_id string, data {data}").load(path).select(F.col("_id").alias("id"), as_map)
    edges = spark.read.format("xml").option("rowTag", "edge").schema(f"_source string, _target string, data {data}").load(path)
    return nodes, edges.select(F.col("_source").alias("source"), F.col("_target").alias("target"), as_map)


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """nodes (id, properties ...) and edges (source, target, properties ...) as one GraphML file: for graphs that one file can hold."""

    def clean(c):
        return F.replace(F.replace(F.replace(F.replace(c.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))

    def data(df: DataFrame, skip: tuple[str, ...]):
        return F.concat(*[F.when(F.col(c).isNotNull(), F.concat(F.lit(f'<data key="{escape(c)}">'), clean(F.col(c)), F.lit("</data>"))).otherwise("") for c in df.columns if c not in skip], F.lit(""))

    head = nodes.sparkSession.createDataFrame([(0, '<?xml version="1.0" encoding="UTF-8"?><graphml><graph edgedefault="directed">'), (3, "</graph></graphml>")], "part int, value string")
    n = nodes.select(F.lit(1).alias("part"), F.concat(F.lit('<node id="'), clean(F.col("id")), F.lit('">'), data(nodes, ("id",)), F.lit("</node>")).alias("value"))
    e = edges.select(F.lit(2).alias("part"), F.concat(F.lit('<edge source="'), clean(F.col("source")), F.lit('" target="'), clean(F.col("target")), F.lit('">'), data(edges, ("source", "target")), F.lit("</edge>")).alias("value"))
    head.unionByName(n).unionByName(e).repartition(1).sortWithinPartitions("part").select("value").write.text(path)


def write_parquet(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """zstd parquet; an existing folder is an error."""
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    (df.coalesce(1) if one_file else df).write.option("header", True).option("escape", '"').csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object a line, columns in order, nulls kept; the folder appears when all is written."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def replaced(df: DataFrame, path: str) -> None:
    """Write df to path; what was there goes to path.bak. df may read path: it is written aside first."""
    fs, at = _fs(df.sparkSession, path)
    hadoop = df.sparkSession._jvm.org.apache.hadoop.fs.Path
    df.write.mode("overwrite").parquet(f"{path}.new")
    if fs.exists(at):
        fs.delete(hadoop(f"{path}.bak"), True)
        fs.rename(at, hadoop(f"{path}.bak"))
    fs.rename(hadoop(f"{path}.new"), at)


def nested(df: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """A row for each a with a map of b to value: what a nested JSON file holds."""
    return df.groupBy(a).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(b, value)))).alias("values"))


def report(df: DataFrame, *metrics) -> DataFrame:
    """One row of metrics, to be written as JSON or text."""
    return df.agg(*metrics)


def latex(df: DataFrame, best: Sequence[str] = (), digits: int = 4, most: int = 1000) -> str:
    """A small result as a LaTeX table, the best value of some columns in bold; an error beyond `most` rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many rows for a printed table")
    top = {c: max((r[c] for r in rows if r[c] is not None), default=None) for c in best}

    def cell(c: str, v) -> str:
        text = f"{v:.{digits}f}" if isinstance(v, float) else "" if v is None else str(v).replace("_", r"\_").replace("&", r"\&").replace("%", r"\%")
        return rf"\textbf{{{text}}}" if c in top and v is not None and v == top[c] else text

    lines = [" & ".join(cell("", c) for c in df.columns), *(" & ".join(cell(c, r[c]) for c in df.columns) for r in rows)]
    return "\\begin{tabular}{" + "l" * len(df.columns) + "}\n\\hline\n" + lines[0] + " \\\\\n\\hline\n" + "".join(x + " \\\\\n" for x in lines[1:]) + "\\hline\n\\end{tabular}\n"


def histogram(df: DataFrame, column: str, low: float, high: float, buckets: int) -> DataFrame:
    """What a plot of a column shows: bucket, n; values outside go to the first or last bucket."""
    at = F.least(F.greatest(F.floor((F.col(column) - low) / ((high - low) / buckets)), F.lit(0)), F.lit(buckets - 1))
    return df.where(F.col(column).isNotNull()).groupBy(at.alias("bucket")).agg(F.count("*").alias("n"))
