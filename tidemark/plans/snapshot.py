"""What a source gave, told from its plan and files: enough to see that nothing has changed without reading it."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession

#: Plan nodes whose result follows from their files alone.
_NODES = {"Project", "Filter", "SubqueryAlias", "View", "LogicalRelation", "Union", "Aggregate", "Join", "Distinct"}


def _all(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _fine(expression) -> bool:
    name = expression.getClass().getSimpleName()
    if not expression.deterministic() or "Python" in name or "Udf" in name or "UDF" in name or "Subquery" in name or name.startswith(("Current", "Now", "Local", "Invoke", "StaticInvoke")):
        return False
    return all(_fine(c) for c in _all(expression.children()))


def _files(leaf) -> list[tuple[str, int, int]] | None:
    relation = leaf.relation()
    if relation.getClass().getSimpleName() != "HadoopFsRelation":
        return None
    return sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in _all(relation.location().allFiles()))


def plan_fact(df: DataFrame) -> tuple[str | None, dict | None]:
    """(digest, snapshot): a digest of plan and files, None unless the rows follow from them alone; and, for a table
    read as it is, what reads it again."""
    spark = df.sparkSession
    plan = df._jdf.queryExecution().analyzed()
    found, files, todo = [], [], [plan]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name not in _NODES or not all(_fine(e) for e in _all(node.expressions())):
            return None, None
        if name == "LogicalRelation":
            own = _files(node)
            if own is None:
                return None, None
            files.append(own)
        todo += _all(node.children())
        found.append(name)
    had = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", str(1 << 30))
    try:
        text = plan.canonicalized().toString()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", had)
    fact = "files:" + hashlib.sha256(repr((text, df.schema.json(), files)).encode()).hexdigest()
    plain = found == ["LogicalRelation"] and plan.relation().fileFormat().toString() == "Parquet" and not plan.relation().partitionSchema().size()
    return fact, {"files": files[0], "schema": df.schema.json()} if plain else None


def read_again(spark: SparkSession, snapshot: dict) -> DataFrame | None:
    """The rows of a snapshot, or None if one of its files has changed or gone."""
    from pyspark.sql.types import StructType

    path_of = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    for name, size, at in snapshot["files"]:
        path = path_of(name)
        fs = path.getFileSystem(conf)
        if not fs.exists(path):
            return None
        now = fs.getFileStatus(path)
        if (now.getLen(), now.getModificationTime()) != (size, at):
            return None
    schema = StructType.fromJson(json.loads(snapshot["schema"]))
    return spark.read.schema(schema).parquet(*(f[0] for f in snapshot["files"])) if snapshot["files"] else spark.createDataFrame([], schema)
