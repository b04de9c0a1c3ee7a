"""Shared plumbing: durable intermediate tables, whole rows, connected components."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from loomtext.sources.arrow import by_bytes as by_bytes
from loomtext.sources.files import scratch


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all machines see, removed when the application ends."""
    return scratch(spark, f"loomtext-{name}")


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete tables that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def column(name: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(df: DataFrame) -> Column:
    """All columns of df in one struct: beside it, any name can be used for a column of one's own."""
    return F.struct(*map(column, df.columns))


def of_row(name: str):
    """A function from an Arrow batch with a struct column `row` to that struct's column `name`."""
    return lambda b: b.column("row").field(name)


def map_rows(df: DataFrame, run, *added: str) -> DataFrame:
    """df.mapInArrow for columns of any name: run gets batches of one struct column `row` and yields batches of it, and of the columns `added`
    ("name type"). An added column takes the place of one of that name."""
    df = df.drop(*(x.split()[0] for x in added))
    rows = df.select(whole_row(df).alias("row"))
    schema = StructType(list(rows.schema.fields) + [StructField(x.split()[0], _parse_datatype_string(x.split(maxsplit=1)[1])) for x in added])
    return rows.mapInArrow(run, schema).select("row.*", *(x.split()[0] for x in added))


def has_map(kind) -> bool:
    """Whether values of this type hold maps, which can't be ordered."""
    return kind.typeName() == "map" or any(has_map(f.dataType) for f in getattr(kind, "fields", ())) or (kind.typeName() == "array" and has_map(kind.elementType))


def smallest(df: DataFrame, row: str = "row") -> Column:
    """Of rows in a struct column the least, by their JSON form where a map forbids comparing them."""
    return F.min_by(row, F.to_json(row)) if has_map(df.schema[row].dataType) else F.min(row)


def integer_ids(df: DataFrame, name: str) -> None:
    """Raise TypeError at the call, not inside a task, if ids aren't whole numbers."""
    if dict(df.dtypes)[name] not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{name} must be a column of whole numbers, not {dict(df.dtypes)[name]}")


def materialize(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df as Parquet in the shared folder and read it back: lineage is cut, and the rows
    survive the loss of any executor."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


#: Rows of an edge list in a task, when it is written; so short lists aren't dealt out over many small files.
_EDGES = 10_000


def _fingerprint(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) for every node of an undirected edge list; component: the smallest node.

    Alternating large-star and small-star rounds. Each round is two hash aggregations and
    two joins, so no node's neighbours are gathered in one task: a hub's minimum is
    pre-aggregated map-side, and the minima are a table of their own, so a join with them is a broadcast where
    that table is small and else a sort-merge join of two plain exchanges, whose hot partitions adaptive execution splits.
    Self-loops, null ends and repeated edges are ignored; no edges give an empty table.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where(
        F.col(u).isNotNull() & F.col(v).isNotNull() & (F.col(u) != F.col(v))
    ).distinct()
    e, path = materialize(e, "cc")
    seen = _fingerprint(e)
    while seen[0]:
        tasks = max(8, seen[0] // _EDGES)  # no list of a round is longer than the one it began with
        both = e.union(e.select(F.col("v"), F.col("u")).toDF("u", "v"))
        low, p0 = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(tasks), "cc")
        big = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        big, p1 = materialize(big.coalesce(tasks), "cc")
        low, p2 = materialize(big.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks), "cc")
        small = big.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(low.select("u", F.col("m").alias("v"))).distinct()
        e, p3 = materialize(small.coalesce(tasks), "cc")
        remove(spark, path, p0, p1, p2)
        path, now = p3, _fingerprint(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
