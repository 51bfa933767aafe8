"""JSON specifications: operations, their allowlist and SDK methods. Each takes a frame with the JSON in one column."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekit.functions import text as X

# Methods of a path item that are operations.
METHODS = ("get", "post", "put", "patch", "delete")


def text_frame(spark: SparkSession, path: str) -> DataFrame:
    """One row with the text of a file of any name, read on the driver; specifications are single small files."""
    with open(path, encoding="utf-8") as f:
        return spark.createDataFrame([(os.path.basename(path), f.read())], "name string, json string")


def operations(df: DataFrame, json: str = "json") -> DataFrame:
    """(method, path, operation_id, summary, op_key) of an API specification; a path item that is no object is passed over."""
    paths = df.select(F.explode(F.from_json(json, "struct<paths:map<string,string>>")["paths"]).alias("path", "item"))
    op = "struct<operationId:string,summary:string>"
    items = paths.where(F.col("item").startswith("{")).select("path", F.from_json("item", f"struct<{','.join(f'{m}:{op}' for m in METHODS)}>").alias("item"))
    each = F.array(*[F.struct(F.lit(m.upper()).alias("method"), F.col("item")[m].alias("op")) for m in METHODS])
    rows = items.select("path", F.explode(F.filter(each, lambda x: x["op"].isNotNull())).alias("x")).select("x.method", "path", F.col("x.op.operationId").alias("operation_id"), F.col("x.op.summary").alias("summary"))
    return rows.withColumn("op_key", X.operation_key(F.col("method"), F.col("path")))


def allowlist(df: DataFrame, json: str = "json") -> DataFrame:
    """(op_key) of the operations that are public."""
    return df.select(F.explode(F.from_json(json, "array<string>")).alias("op_key")).distinct()


def public_operations(ops: DataFrame, allowed: DataFrame) -> DataFrame:
    return ops.join(allowed, "op_key", "left_semi")


def sdk_methods(df: DataFrame, prefix: str = "sdk", json: str = "json") -> DataFrame:
    """(service, method, qualified) of an SDK manifest."""
    services = df.select(F.explode(F.from_json(json, "struct<sdk:map<string,array<string>>>")["sdk"]).alias("service", "methods"))
    rows = services.select("service", F.explode("methods").alias("method"))
    return rows.withColumn("qualified", F.concat_ws(".", F.lit(prefix), "service", "method"))


def operation_map(ops: DataFrame) -> DataFrame:
    """Last operation of each key, in the order of paths and methods."""
    return ops.groupBy("op_key").agg(F.max_by(F.struct("method", "path", "operation_id", "summary"), F.struct("path", "method")).alias("operation"))
