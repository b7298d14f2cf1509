"""Published versions of models and baselines.

A version is a folder of its own and a small manifest. The folder is written first; the manifest
appears under its final name in one step or not at all, so a version that was left half written
is never found, and of two jobs that publish at once each gets its own number.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.scoring import PipelineScorer
from plumbline.operators.semantic import SemanticBaseline
from plumbline.session import path_exists

MANIFEST = "name string, kind string, version long, path string, note string"
KINDS = ("tuned", "base")


def _commit(spark: SparkSession, path: str, content: str) -> bool:
    """Put a small file in place in one step; false if the name is taken."""
    fs_classes = spark._jvm.org.apache.hadoop.fs
    target = fs_classes.Path(path)
    part = fs_classes.Path(target.getParent(), f"_{uuid.uuid4().hex}")
    conf = spark._jsc.hadoopConfiguration()
    out = target.getFileSystem(conf).create(part)
    out.write(bytearray(content.encode()))
    out.close()
    files = fs_classes.FileContext.getFileContext(target.getFileSystem(conf).getUri(), conf)
    keep = spark.sparkContext._gateway.new_array(getattr(fs_classes, "Options$Rename"), 0)
    try:
        files.rename(part, target, keep)
    except Py4JJavaError as error:
        files.delete(part, False)
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    return True


def publish(
    spark: SparkSession, root: str, name: str, write: Callable[[str], None], kind: str = "tuned", note: str = ""
) -> int:
    """Store a version with ``write(path)`` and make it visible; returns its number, counted per name."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}, not {kind!r}")
    path = f"{root}/{name}/data/{kind}-{uuid.uuid4().hex[:12]}"
    write(path)
    newest = versions(spark, root).where(F.col("name") == name).agg(F.max("version")).first()[0]
    version = (newest or 0) + 1
    while True:
        manifest = {"name": name, "kind": kind, "version": version, "path": path, "note": note}
        if _commit(spark, f"{root}/{name}/versions/{version:08d}.json", json.dumps(manifest)):
            return version
        version += 1


def versions(spark: SparkSession, root: str) -> DataFrame:
    """``name, kind, version, path, note`` of all published versions."""
    if not path_exists(spark, root):
        return spark.createDataFrame([], MANIFEST)
    listed = spark.read.schema(MANIFEST).option("recursiveFileLookup", True).option("pathGlobFilter", "[0-9]*.json")
    return listed.json(root).where(F.col("path").isNotNull())


def resolve(spark: SparkSession, root: str, name: str, version: int | None = None, kind: str | None = None):
    """The manifest that a name stands for.

    A name is looked up as it is, then as the part before an underscore (``social`` finds
    ``social_small``; of several the first in sort order). Tuned versions go before base ones, newer
    before older, unless ``version`` or ``kind`` asks for one.
    """
    published = versions(spark, root).where((F.col("name") == name) | F.col("name").startswith(f"{name}_"))
    if version is not None:
        published = published.where(F.col("version") == version)
    if kind is not None:
        published = published.where(F.col("kind") == kind)
    order = [(F.col("name") != name).asc(), F.col("name"), (F.col("kind") != "tuned").asc(), F.col("version").desc()]
    found = published.orderBy(*order).first()
    if found is None:
        raise FileNotFoundError(f"nothing published for {name!r} in {root}")
    return found


def publish_scorer(spark: SparkSession, model: PipelineModel, root: str, name: str, kind: str = "tuned", note: str = "") -> int:
    """Publish a scorer."""
    return publish(spark, root, name, lambda path: model.write().save(path), kind, note)


def published_scorer(spark: SparkSession, root: str, name: str, version: int | None = None) -> PipelineScorer:
    """The scorer a name stands for."""
    return PipelineScorer(PipelineModel.load(resolve(spark, root, name, version)["path"]))


def publish_semantic(spark: SparkSession, baseline: SemanticBaseline, root: str, name: str, note: str = "") -> int:
    """Publish a semantic baseline: projection, clusters and expected shares become visible together."""

    def write(path: str) -> None:
        baseline.model.write().save(f"{path}/model")
        baseline.expected.write.parquet(f"{path}/expected")

    return publish(spark, root, name, write, "tuned", note)


def published_semantic(spark: SparkSession, root: str, name: str, version: int | None = None) -> SemanticBaseline:
    """The semantic baseline a name stands for."""
    path = resolve(spark, root, name, version)["path"]
    return SemanticBaseline(PipelineModel.load(f"{path}/model"), spark.read.parquet(f"{path}/expected"))
