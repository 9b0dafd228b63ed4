"""Caption bodies, subtitle files, checkpoints and job logs as rows. Schemas are explicit throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

CAPTIONS = "struct<events:array<struct<tStartMs:bigint,dDurationMs:bigint,segs:array<struct<utf8:string,tOffsetMs:bigint>>>>>"
SEGMENTS = "array<struct<id:int,start:double,end:double,text:string,speaker:string>>"
TRACKS = "map<string,array<struct<ext:string,url:string>>>"


def _events(bodies: DataFrame) -> DataFrame:
    return bodies.select("media_id", F.posexplode(F.from_json("body", CAPTIONS)["events"]).alias("at", "e"))


def manual_captions(bodies: DataFrame) -> DataFrame:
    """(media_id, id, start_ms, end_ms, text): one cue an event with text, in the body's order; missing times are 0."""
    joined = F.array_join(F.transform(F.coalesce("e.segs", F.array().cast("array<struct<utf8:string,tOffsetMs:bigint>>")), lambda s: F.coalesce(s["utf8"], F.lit(""))), "")
    start = F.coalesce("e.tStartMs", F.lit(0))
    rows = _events(bodies).select("media_id", "at", start.alias("start_ms"), (start + F.coalesce("e.dDurationMs", F.lit(0))).alias("end_ms"), T.one_line(joined).alias("text")).where("text <> ''")
    ids = F.row_number().over(Window.partitionBy("media_id").orderBy("at")) - 1
    return rows.select("media_id", ids.cast("long").alias("id"), "start_ms", "end_ms", "text")


def auto_caption_words(bodies: DataFrame) -> DataFrame:
    """(media_id, seq, text, start_ms): every piece with text, by time and then by place in the body."""
    pieces = _events(bodies).select("media_id", "at", F.coalesce("e.tStartMs", F.lit(0)).alias("t"), F.posexplode("e.segs").alias("k", "s"))
    words = pieces.select("media_id", "at", "k", T.strip(F.coalesce("s.utf8", F.lit(""))).alias("text"), (F.col("t") + F.coalesce("s.tOffsetMs", F.lit(0))).alias("start_ms")).where("text <> ''")
    seq = F.row_number().over(Window.partitionBy("media_id").orderBy("start_ms", "at", "k")) - 1
    return words.select("media_id", seq.cast("long").alias("seq"), "text", "start_ms")


def srt_cues(files: DataFrame) -> DataFrame:
    """(media_id, id, start_ms, end_ms, text) from (media_id, body).

    Blocks are parted by blank lines; the times stand on the second line, or on
    the first if the number is left out. Blocks without times or text give none.
    """
    body = F.regexp_replace(F.regexp_replace("body", "\r\n?", "\n"), r"(?U)^\s+", "")
    blocks = files.select("media_id", F.posexplode(F.split(body, r"\n\s*\n")).alias("at", "block"))
    lines = blocks.select("media_id", "at", F.split(T.strip(F.col("block")), "\n").alias("l"))
    has = lambda i: F.coalesce(F.get("l", F.lit(i)).rlike(T.CLOCK), F.lit(False))
    k = F.when(has(1), 1).when(has(0), 0)
    timed = lines.withColumn("k", k).where("k is not null").withColumn("line", F.get("l", F.col("k")))
    text = T.strip(F.array_join(F.transform(F.slice("l", F.col("k") + 2, F.greatest(F.size("l"), F.lit(1))), lambda x: T.strip(x)), " "))
    rows = timed.select("media_id", "at", T.clock_ms(F.col("line"), 1).alias("start_ms"), T.clock_ms(F.col("line"), 5).alias("end_ms"), text.alias("text")).where("text <> ''")
    ids = F.row_number().over(Window.partitionBy("media_id").orderBy("at")) - 1
    return rows.select("media_id", ids.cast("long").alias("id"), "start_ms", "end_ms", "text")


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("media_id"), F.col("value").alias("body"))
    return srt_cues(files)


def checkpoints(bodies: DataFrame) -> DataFrame:
    """(media_id, stage, id, start_ms, end_ms, text, speaker) from JSON bodies; stage defaults to transcribed."""
    parsed = bodies.select("media_id", F.from_json("body", f"struct<stage:string,segments:{SEGMENTS}>").alias("b"))
    rows = parsed.select("media_id", F.coalesce("b.stage", F.lit("transcribed")).alias("stage"), F.explode("b.segments").alias("s"))
    ms = lambda c: F.floor(F.col(c) * 1000 + 0.5).cast("long")
    return rows.select("media_id", "stage", F.col("s.id").cast("long").alias("id"), ms("s.start").alias("start_ms"), ms("s.end").alias("end_ms"), "s.text", F.coalesce("s.speaker", F.lit("SPEAKER_00")).alias("speaker"))


def progress_lines(lines: DataFrame) -> DataFrame:
    """(job_id, step, total, message); blank and unreadable lines and lines without a step are skipped."""
    parsed = lines.select("job_id", F.from_json("value", "step int, total int, message string").alias("p"))
    return parsed.where("p.step is not null").select("job_id", "p.*")


def usage_counts(bodies: DataFrame) -> DataFrame:
    """(ip, n) from JSON maps; unreadable bodies give none."""
    return bodies.select(F.explode(F.from_json("body", "map<string,int>")).alias("ip", "n"))


def select_track(info: DataFrame) -> DataFrame:
    """(media_id, kind, lang, url): the best caption track of (media_id, src, subtitles, automatic), maps of TRACKS.

    1 manual in the source language, 2 manual in a variant of it, 3 automatic in
    it, 4 without a known source the first manual language. A list counts with
    its first json3 entry, and only if that has a url.
    """
    src = F.coalesce("src", F.lit(""))

    def listed(maps: str, kind: str) -> DataFrame:
        rows = info.select("media_id", src.alias("src"), F.lit(kind).alias("kind"), F.explode(maps).alias("lang", "entries"), F.array_min(F.map_keys(maps)).alias("first"))
        return rows.withColumn("url", F.get(F.filter("entries", lambda e: e["ext"] == "json3"), F.lit(0))["url"])

    rows = listed("subtitles", "manual").unionByName(listed("automatic", "auto"))
    manual, known = F.col("kind") == "manual", F.col("src") != ""
    rank = (
        F.when(manual & known & (F.col("lang") == F.col("src")), 1)
        .when(manual & known & (F.substring_index("lang", "-", 1) == F.col("src")), 2)
        .when(~manual & known & (F.col("lang") == F.col("src")), 3)
        .when(manual & ~known & (F.col("lang") == F.col("first")), 4)
    )
    hit = rows.withColumn("rank", rank).where("rank is not null and coalesce(url, '') <> ''")
    best = F.min_by(F.struct("kind", "lang", "url"), F.struct("rank", "lang")).alias("t")
    return hit.groupBy("media_id").agg(best).select("media_id", "t.*")


def captions_or_asr(captions: DataFrame, asr: DataFrame) -> DataFrame:
    """A medium's captions if it has any, else its recognised segments."""
    return captions.unionByName(asr.join(captions.select("media_id").distinct(), "media_id", "left_anti"))


def styles(spark: SparkSession, profiles: dict[str, dict]) -> DataFrame:
    """(name, description, directives, temperature, speed, emotion) of style profiles, as a YAML file holds them."""
    row = lambda n, p: (n, p.get("description", n), (p.get("translation") or {}).get("directives") or "", (p.get("translation") or {}).get("temperature"), (p.get("tts") or {}).get("speed"), (p.get("tts") or {}).get("emotion"))
    return spark.createDataFrame([row(n, p) for n, p in sorted(profiles.items())], "name string, description string, directives string, temperature double, speed double, emotion string").orderBy("name")


def style_of(jobs: DataFrame, table: DataFrame) -> DataFrame:
    """jobs with their style's columns; an unknown style raises an error that lists the (first hundred) known ones."""
    first = [r.name for r in table.select("name").orderBy("name").limit(101).collect()]
    known = ", ".join(first[:100]) + (", ..." if len(first) > 100 else "")
    j = jobs.join(table.withColumnRenamed("name", "__s"), F.col("style") == F.col("__s"), "left")
    checked: Column = F.when(F.col("__s").isNull(), F.raise_error(F.concat(F.lit("unknown style "), "style", F.lit(f"; known: {known}"))).cast("string")).otherwise(F.col("style"))
    return j.withColumn("style", checked).drop("__s")


def deep_merge(base: dict, override: dict) -> dict:
    """Driver configuration: nested dicts merge, other values are replaced."""
    out = dict(base)
    for k, v in override.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def job_meta(bodies: DataFrame) -> DataFrame:
    """(id, status, created_at, error) from JSON bodies; unreadable ones and those without an id are skipped."""
    parsed = bodies.select(F.from_json("body", "id string, status string, created_at bigint, error string").alias("m"))
    return parsed.where("m.id is not null").select("m.*")


def media_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modified) of the files under path; their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def uploaded_inputs(files: DataFrame) -> DataFrame:
    """(job_id, path): the first file named input.* in each job's folder."""
    named = files.select("path", F.regexp_extract("path", r"([^/]+)/input\.[^/]*$", 1).alias("job_id")).where("job_id <> ''")
    return named.groupBy("job_id").agg(F.min("path").alias("path"))


def segments_of(media: DataFrame, bodies: DataFrame) -> DataFrame:
    """(media_id, n, segments): each medium's stored segments as an array by id; none where its body is missing or unreadable."""
    parsed = bodies.select("media_id", F.from_json("body", SEGMENTS).alias("segments"))
    none = F.array().cast(SEGMENTS)
    j = media.select("media_id").join(parsed, "media_id", "left").withColumn("segments", F.array_sort(F.coalesce("segments", none)))
    return j.select("media_id", F.size("segments").alias("n"), "segments")


def languages_by_code(table: DataFrame) -> DataFrame:
    return table.orderBy("code")


def style_list(table: DataFrame) -> DataFrame:
    """The fields of styles that are shown, by name."""
    return table.select("name", "description", F.col("speed").alias("tts_speed"), F.col("emotion").alias("tts_emotion")).orderBy("name")
