"""What the named queries keep in the session's shared folder: the latest pages, and indexes of them. Each is written once a session and set of tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.analyzer import simple
from ..operators.index import Index, build
from ..session import ensure_checkpoint_dir, spread
from ..sources.derived import latest_pages
from ..sources.tables import read

_KEPT: dict[tuple, object] = {}


def _once(spark: SparkSession, folder: str, name: str, make: Callable[[str], object]) -> object:
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _KEPT:
        _KEPT[key] = make(f"{ensure_checkpoint_dir(spark)}/stored/{hashlib.sha256(folder.encode()).hexdigest()[:16]}/{name}")
    return _KEPT[key]


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """One row a url, the latest."""

    def make(path: str) -> str:
        table = read(spark, folder, "pages")
        spread(latest_pages(table), table).write.mode("overwrite").parquet(path)
        return path

    return spark.read.parquet(_once(spark, folder, "pages", make))


def index(spark: SparkSession, folder: str, lexeme: Callable[[str], str | None] = simple) -> Index:
    """The index of these pages by an analyzer."""
    return _once(spark, folder, f"index-{lexeme.__name__}", lambda path: build(pages(spark, folder), path, lexeme))
