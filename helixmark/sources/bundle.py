"""Bundles: folders of Parquet tables and JSON with SHA-256 sums; and stage checkpoints that know their inputs."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def content_hash(df: DataFrame) -> str:
    """Of a table's rows and schema, whatever their order: a sum over the rows' digests."""
    text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"})
    part = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    n, total = df.select(part.alias("h")).agg(F.count("*"), F.coalesce(F.sum("h"), F.lit(0))).first()
    return hashlib.sha256(f"{sorted(df.dtypes)}|{n}|{total}".encode()).hexdigest()


def save(spark: SparkSession, path: str, tables: dict[str, DataFrame], settings: dict) -> dict:
    """Writes all tables, then the manifest: a bundle without one is not complete."""
    sums = {}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/tables/{name}")
        sums[name] = content_hash(spark.read.parquet(f"{path}/tables/{name}"))
    manifest = {"format": 1, "tables": sums, "settings": settings, "settings_sha256": hashlib.sha256(json.dumps(settings, sort_keys=True).encode()).hexdigest()}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest


def load(spark: SparkSession, path: str, verify: bool = True) -> tuple[dict[str, DataFrame], dict]:
    """(tables, settings) of a bundle; ValueError if a sum doesn't match."""
    manifest = json.loads(spark.read.text(f"{path}/manifest", wholetext=True).first()[0])
    tables = {n: spark.read.parquet(f"{path}/tables/{n}") for n in manifest["tables"]}
    if verify:
        wrong = [n for n, df in tables.items() if content_hash(df) != manifest["tables"][n]]
        if hashlib.sha256(json.dumps(manifest["settings"], sort_keys=True).encode()).hexdigest() != manifest["settings_sha256"]:
            wrong.append("settings")
        if wrong:
            raise ValueError(f"the bundle's sums don't match: {', '.join(wrong)}")
    return tables, manifest["settings"]


def flattened(registry: dict) -> list[tuple[str, str, str, str | None, list[str]]]:
    """(node, label_column, status, constant, features) of a nested registry {label_column, status, constant, features, children}."""
    out = []

    def walk(node: dict, path: str) -> None:
        out.append((path, node.get("label_column", ""), node.get("status", "success"), node.get("constant"), list(node.get("features", []))))
        for label, child in sorted(node.get("children", {}).items()):
            walk(child, f"{path}|{label}" if path else label)

    walk(registry, "")
    return out


def staged(spark: SparkSession, path: str, name: str, key: dict, build) -> DataFrame:
    """A stage's table from its checkpoint if that was made from the same key (inputs and settings), else built and written."""
    want = hashlib.sha256(json.dumps(key, sort_keys=True, default=str).encode()).hexdigest()
    place = f"{path}/{name}-{want[:32]}"
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{place}/_SUCCESS")
    if not fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs):
        build().write.mode("overwrite").parquet(place)
    return spark.read.parquet(place)
