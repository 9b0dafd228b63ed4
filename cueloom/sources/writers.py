"""Subtitles, transcripts, checkpoints and logs as text or files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clock


def _joined(cues: DataFrame, block, between: str) -> DataFrame:
    rows = cues.select("media_id", "id", block.alias("b"))
    return rows.groupBy("media_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("id", "b")))["b"], between).alias("body"))


def srt_bodies(cues: DataFrame) -> DataFrame:
    """(media_id, body): numbered cues, exact milliseconds."""
    block = F.concat((F.col("id") + 1).cast("string"), F.lit("\n"), clock(F.col("start_ms")), F.lit(" --> "), clock(F.col("end_ms")), F.lit("\n"), "text", F.lit("\n"))
    return _joined(cues, block, "\n")


def vtt_bodies(cues: DataFrame) -> DataFrame:
    block = F.concat(clock(F.col("start_ms"), "."), F.lit(" --> "), clock(F.col("end_ms"), "."), F.lit("\n"), "text", F.lit("\n"))
    return _joined(cues, block, "\n").withColumn("body", F.concat(F.lit("WEBVTT\n\n"), "body"))


def transcripts(cues: DataFrame) -> DataFrame:
    """(media_id, body): one line a segment."""
    return _joined(cues, F.concat("text", F.lit("\n")), "")


def subtitles(cues: DataFrame, formats: tuple[str, ...] = ("srt",)) -> DataFrame:
    """(media_id, format, body) for the formats srt, vtt and txt."""
    make = {"srt": srt_bodies, "vtt": vtt_bodies, "txt": transcripts}
    if unknown := [f for f in formats if f not in make]:
        raise ValueError(f"unknown subtitle formats: {unknown}")
    out = None
    for f in formats:
        one = make[f](cues).select("media_id", F.lit(f).alias("format"), "body")
        out = one if out is None else out.unionByName(one)
    return out


def write_checkpoint(segments: DataFrame, path: str, stage: str) -> None:
    """Replaces a stage's segments; the committer makes the result visible at once."""
    segments.withColumn("stage", F.lit(stage)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("stage").parquet(path)


def segments_json(segments: DataFrame) -> DataFrame:
    """(media_id, body): an array of segments in seconds."""
    one = F.struct("id", (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), "text", "speaker")
    return segments.groupBy("media_id").agg(F.to_json(F.array_sort(F.collect_list(one))).alias("body"))


def append_progress(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def append_usage(events: DataFrame, path: str) -> None:
    """Appends (ip) rows; usage_counted() sums them up, so writers never rewrite a counter."""
    events.select("ip").write.mode("append").parquet(path)


def usage_counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("ip").agg(F.count(F.lit(1)).alias("n"))
