"""Resumable runs: done units are kept under a digest of the inputs and settings."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def digest(**inputs) -> str:
    """A digest of settings, whatever the order of keys."""
    return hashlib.blake2b(json.dumps(inputs, sort_keys=True, default=str).encode(), digest_size=16).hexdigest()


def pending(units: DataFrame, done: DataFrame, key: str, by: str = "unit") -> DataFrame:
    """Units without a finished row under the same digest."""
    return units.join(done.where(F.col("digest") == key).select(by), by, "left_anti")


def finished(units: DataFrame, key: str) -> DataFrame:
    return units.withColumn("digest", F.lit(key)).withColumn("at", F.current_timestamp())
