"""Timed-text and job tables derived from the generic test tables, in whole milliseconds.

words: a token of a conversation lasts 60 ms a character; before it lie 0 ms (first
token), 40 ms (inside a turn), 700 ms (new turn) or 2600 ms (every fifth turn).
cues: eight words of one turn. The SQL of the same tables is in sql.py.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(media_id, seq, turn, pos, text, speaker, start_ms, end_ms)"""
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.regexp_replace("text", r"^\s+|\s+$", "").alias("t")).where("t <> ''")
    tokens = said.select(F.col("conv_id").alias("media_id"), "turn", F.col("role").alias("speaker"), F.posexplode(F.split("t", r"\s+")).alias("pos", "text"))
    order = Window.partitionBy("media_id").orderBy("turn", "pos")
    seq = F.row_number().over(order) - 1
    gap = F.when(F.col("seq") == 0, 0).when(F.col("pos") > 0, 40).when(F.col("turn") % 5 == 0, 2600).otherwise(700)
    timed = tokens.withColumn("seq", seq.cast("long")).withColumn("dur", 60 * F.length("text")).withColumn("end_ms", F.sum(gap + F.col("dur")).over(order))
    return timed.select("media_id", "seq", "turn", F.col("pos").cast("long").alias("pos"), "text", "speaker", (F.col("end_ms") - F.col("dur")).alias("start_ms"), "end_ms")


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(media_id, id, start_ms, end_ms, text, speaker)"""
    w = words(spark, sf_dir)
    grouped = w.groupBy("media_id", "turn", F.floor(F.col("pos") / 8).alias("part")).agg(
        F.min("start_ms").alias("start_ms"),
        F.max("end_ms").alias("end_ms"),
        F.array_join(F.array_sort(F.collect_list(F.struct("pos", "text")))["text"], " ").alias("text"),
        F.min("speaker").alias("speaker"),
    )
    order = Window.partitionBy("media_id").orderBy("turn", "part")
    return grouped.select("media_id", (F.row_number().over(order) - 1).cast("long").alias("id"), "start_ms", "end_ms", "text", "speaker")


def cues_overlapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 7th cue starts 60 % of its length before the previous end, every 11th 50 %; lengths stay."""
    c = cues(spark, sf_dir)
    before = F.lag("end_ms").over(Window.partitionBy("media_id").orderBy("id"))
    dur = F.col("end_ms") - F.col("start_ms")
    back = F.when(F.col("id") % 7 == 0, F.floor(dur * 6 / 10)).when(F.col("id") % 11 == 0, F.floor(dur * 5 / 10))
    start = F.when(back.isNotNull() & F.col("before").isNotNull(), F.col("before") - back).otherwise(F.col("start_ms"))
    return c.withColumn("before", before).select("media_id", "id", start.cast("long").alias("start_ms"), (start + dur).cast("long").alias("end_ms"), "text", "speaker")


def tts(cue_table: DataFrame) -> DataFrame:
    """(media_id, id, tts_ms): synthesised lengths at 30 to 350 % of the slot, by id."""
    pct = F.element_at(F.array(*[F.lit(x) for x in (30, 80, 100, 150, 205, 230, 350)]), (F.col("id") % 7 + 1).cast("int"))
    return cue_table.select("media_id", "id", F.floor((F.col("end_ms") - F.col("start_ms")) * pct / 100).cast("long").alias("tts_ms"))


def media(cue_table: DataFrame) -> DataFrame:
    return cue_table.groupBy("media_id").agg((F.max("end_ms") + 1500).alias("total_ms"))


def asr_segments(cue_table: DataFrame) -> DataFrame:
    return cue_table.withColumn("no_speech_prob", (F.col("id") % 10) / 10.0).drop("speaker")


def event_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(media_id, seq, text, start_ms): a user's events as words."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("media_id"), "event_id", F.col("event_type").alias("text"), F.unix_millis(F.col("ts").cast("timestamp")).alias("start_ms"))
    return e.withColumn("seq", (F.row_number().over(Window.partitionBy("media_id").orderBy("start_ms", "event_id")) - 1).cast("long"))


def captions_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(media_id, body): a caption body with one event a turn and one piece a word."""
    w = words(spark, sf_dir)
    turns = w.groupBy("media_id", "turn").agg(F.min("start_ms").alias("s"), F.max("end_ms").alias("e"), F.array_sort(F.collect_list(F.struct("pos", "start_ms", "text"))).alias("ws"))
    segs = F.transform("ws", lambda x: F.struct(F.concat(x["text"], F.lit(" ")).alias("utf8"), (x["start_ms"] - F.col("s")).alias("tOffsetMs")))
    event = F.struct(F.col("s").alias("tStartMs"), (F.col("e") - F.col("s")).alias("dDurationMs"), segs.alias("segs"))
    return turns.select("media_id", F.struct("turn", event.alias("event")).alias("x")).groupBy("media_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list("x"))["event"].alias("events"))).alias("body"))


def job_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as finished jobs: the columns of the statistics table that the roll-ups read."""
    o, n, c, lines = (table(spark, sf_dir, x) for x in ("orders", "nation", "customer", "lineitem"))
    used = lines.groupBy("l_orderkey").agg(F.sum("l_quantity").cast("long").alias("q"), F.count(F.lit(1)).alias("k"))
    lang = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("target_language"))
    j = o.join(used, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(lang, F.col("o_custkey") == F.col("c_custkey"), "left")
    q = F.coalesce("q", F.lit(0))
    provider = F.element_at(F.array(*map(F.lit, ("together", "openai", "elevenlabs", "unlisted"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "failed").otherwise("queued")
    return j.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("created_at"), status.alias("status"), "target_language",
        provider.alias("provider"), F.coalesce("k", F.lit(0)).alias("segments_count"), q.alias("audio_seconds"), (q * 250).alias("tts_characters"), (q * 100).alias("llm_input_tokens"), (q * 60).alias("llm_output_tokens"),
    )
