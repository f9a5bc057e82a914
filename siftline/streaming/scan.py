"""Scanning streams: the same row-local expressions on readStream, counts by event time, and a deduplicated endpoint set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import scan as S


def scan_stream(texts: DataFrame, keys: list[str], text: str = "text", origin: str = "stream") -> DataFrame:
    """Public findings of a stream of texts."""
    return S.public(S.listed(S.scan(texts, text, origin), keys, text), keys)


def windowed_counts(found: DataFrame, ts: str = "ts", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Findings by rule and event-time window; rows later than `late` are dropped."""
    return found.withWatermark(ts, late).groupBy(F.window(ts, width), "rule").agg(F.count("*").alias("n"))


def endpoint_stream(samples: DataFrame, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Each endpoint once, as it is first seen."""
    return samples.withWatermark(ts, late).dropDuplicatesWithinWatermark(["local_port", "remote_ip", "remote_port"])
