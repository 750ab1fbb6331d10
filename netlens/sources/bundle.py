"""Versioned model bundles (S16, M7): immutable version folders, one pointer.

A bundle folder holds ``versions/<id>/`` with everything one deployment needs - the
gate, fitted pipelines, feature list, metrics - and ``pointer/``, whose entries are
numbered files that name a version.  A version is written whole under a new name and
only then pointed to by the next free entry, which is published at once and never
overwritten.  So a reader always loads tables of one version, a writer that dies
between two writes leaves the version before it in force, and of two writers both
versions stay, the later entry being the current one.
"""
from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from netlens.operators.gate import Gate, load_gate, save_gate
from netlens.sources import fs


@dataclass
class Bundle:
    gate: Gate | None = None
    models: dict[str, PipelineModel] = field(default_factory=dict)
    features: list[str] = field(default_factory=list)
    metrics: dict[str, float] = field(default_factory=dict)
    tables: dict[str, DataFrame] = field(default_factory=dict)      # reports and the like
    version: str | None = None


def _entries(path: str) -> list[str]:
    return fs.list_files(f"{path}/pointer", (".json",))


def versions(path: str) -> list[str]:
    """The published versions, oldest first."""
    out = []
    for name in _entries(path):
        with fs.open_input(name) as f:
            out.append(json.loads(f.read())["version"])
    return out


def write_version(spark: SparkSession, bundle: Bundle, path: str) -> str:
    """Write everything under a new version folder; nothing points to it yet."""
    version = uuid.uuid4().hex
    at = f"{path}/versions/{version}"
    if bundle.gate is not None:
        save_gate(bundle.gate, spark, f"{at}/gate")
    for name, model in bundle.models.items():
        model.write().save(f"{at}/models/{name}")
    for name, df in bundle.tables.items():
        df.write.parquet(f"{at}/tables/{name}")
    spark.createDataFrame([(bundle.gate is not None, sorted(bundle.models), list(bundle.features),
                            {k: float(v) for k, v in bundle.metrics.items()}, sorted(bundle.tables))],
                          "gate boolean, models array<string>, features array<string>, "
                          "metrics map<string,double>, tables array<string>").write.parquet(f"{at}/meta")
    return version


def publish_version(path: str, version: str) -> int:
    """Point to a version by the next free entry; returns the entry's number."""
    f, p = fs.resolve(f"{path}/pointer")
    f.create_dir(p, recursive=True)
    names = _entries(path)
    number = int(names[-1].rsplit("/", 1)[-1][:-len(".json")]) + 1 if names else 0
    while not fs.publish(f"{path}/pointer/{number:010d}.json", json.dumps({"version": version}).encode()):
        number += 1
    return number


def save_bundle(spark: SparkSession, bundle: Bundle, path: str) -> str:
    version = write_version(spark, bundle, path)
    publish_version(path, version)
    return version


def load_bundle(spark: SparkSession, path: str, version: str | None = None) -> Bundle:
    """The current version, or a named one; raises if none was published."""
    if version is None:
        names = _entries(path)
        if not names:
            raise FileNotFoundError(f"no bundle version is published under {path}")
        with fs.open_input(names[-1]) as f:
            version = json.loads(f.read())["version"]
    at = f"{path}/versions/{version}"
    meta = spark.read.parquet(f"{at}/meta").first()
    return Bundle(load_gate(spark, f"{at}/gate") if meta["gate"] else None,
                  {name: PipelineModel.load(f"{at}/models/{name}") for name in meta["models"]},
                  list(meta["features"]), dict(meta["metrics"]),
                  {name: spark.read.parquet(f"{at}/tables/{name}") for name in meta["tables"]}, version)
