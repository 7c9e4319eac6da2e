"""Readers of the tables the operators of this subpackage start from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from ..functions.hashing import compact_digest, parse_hash64
from ..session import Staging
from ..sources.current import latest_rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def current_files(files: DataFrame, staging: Staging, **cols: Column) -> DataFrame:
    """One row per file_id: that of its greatest indexed_at, with ``cols`` computed from it.

    Rows without a file_id are left out. Equal rows collapse; should readings of one time differ, the later
    loaded_at and then the greatest values win, so the result does not depend on row order.
    """
    return latest_rows(files, "file_id", ("indexed_at", "loaded_at"), cols, staging)


def hash_cols() -> dict[str, Column]:
    return {"p": parse_hash64("phash"), "d": parse_hash64("dhash"), "s": compact_digest("sha256")}
