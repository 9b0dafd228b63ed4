"""What surrounds a playback position: subtitle window, frame times, chat history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Milliseconds of a bin by level; an interval lies in bins of the level whose size its length doesn't exceed, two at most.
LEVELS = [60_000 * 16**k for k in range(5)] + [1 << 62]


def _binned(df: DataFrame, start: str, end: str, sizes: Column) -> DataFrame:
    """df a row for each bin of `sizes` (an array of level and size) that start to end touches, with the first one."""
    at = lambda c: F.expr(f"floor({c} / double(size))").cast("long")
    leveled = df.select("*", F.explode(sizes).alias("__z")).select("*", "__z.level", "__z.size").drop("__z")
    first = leveled.withColumn("first", at(start))
    return first.withColumn("bin", F.explode(F.sequence("first", F.greatest(F.col("first"), at(end))))).drop("size")


def context_window(probes: DataFrame, segments: DataFrame, around_ms: int = 30000) -> DataFrame:
    """(media_id, t_ms, window_start_ms, window_end_ms, ids, text): segments that overlap the time around t_ms.

    The window reaches to the first such segment's start and the last one's end,
    first and last by id. A probe without any has its plain window and no ids.
    Probes and segments meet by medium, level and bin: a segment is two rows at
    most however long it is, a probe 2 * around_ms / 60 s + 12.
    """
    p = probes.select("media_id", "t_ms").distinct().withColumn("ws", F.greatest(F.lit(0), F.col("t_ms") - around_ms)).withColumn("we", F.col("t_ms") + around_ms)
    size = lambda k: F.struct(F.lit(k).alias("level"), F.lit(LEVELS[k]).cast("long").alias("size"))
    whole = segments.where("start_ms is not null and end_ms is not null").select("media_id", "id", "start_ms", "end_ms", "text")
    own = F.when(F.col("end_ms") - F.col("start_ms") <= LEVELS[0], F.array(size(0)))
    for k in range(1, len(LEVELS)):
        own = own.when(F.col("end_ms") - F.col("start_ms") <= LEVELS[k], F.array(size(k)))
    asked = _binned(p, "ws", "we", F.array(*map(size, range(len(LEVELS))))).withColumnRenamed("first", "p_first")
    s = _binned(whole, "start_ms", "end_ms", own).withColumnRenamed("first", "s_first")
    # Both may lie in several bins; the pair counts in the first that they have in common.
    met = asked.join(s, ["media_id", "level", "bin"]).where((F.col("end_ms") >= F.col("ws")) & (F.col("start_ms") <= F.col("we")) & (F.col("bin") == F.greatest("p_first", "s_first")))
    lines = F.array_sort(F.collect_list(F.struct("id", "text")))
    hit = met.groupBy("media_id", "t_ms").agg(F.min_by("start_ms", "id").alias("s"), F.max_by("end_ms", "id").alias("e"), lines.alias("lines"))
    none = F.array().cast("array<struct<id:bigint,text:string>>")
    g = p.join(hit, ["media_id", "t_ms"], "left").withColumn("lines", F.coalesce("lines", none))
    return g.select(
        "media_id",
        "t_ms",
        F.least("ws", F.coalesce("s", "ws")).alias("window_start_ms"),
        F.greatest("we", F.coalesce("e", "we")).alias("window_end_ms"),
        F.array_join(F.col("lines.id").cast("array<string>"), ",").alias("ids"),
        F.array_join("lines.text", "\n").alias("text"),
    )


def frame_times(windows: DataFrame, media: DataFrame, interval_s: int = 5, max_frames: int = 6) -> DataFrame:
    """(media_id, t_ms, n, frame_ms): a frame each interval in the window, at least one, none after 0.1 s before the end.

    Times are hundredths of a second, as milliseconds.
    """
    step = max(1, int(interval_s)) * 1000
    w = windows.join(media, "media_id")
    at = F.slice(F.sequence(F.col("window_start_ms"), F.greatest("window_end_ms", "window_start_ms"), F.lit(step).cast("long")), 1, max_frames)
    last = F.greatest(F.lit(0), F.col("total_ms") - 100)
    rows = w.select("media_id", "t_ms", last.alias("last"), F.posexplode(at).alias("n", "f"))
    return rows.select("media_id", "t_ms", F.col("n").cast("long").alias("n"), (F.floor((F.least(F.greatest("f", F.lit(0)), "last") + 5) / 10) * 10).cast("long").alias("frame_ms"))


def chat_history(messages: DataFrame, last: int = 8) -> DataFrame:
    """The last messages of each conversation, then those of users and assistants: (conv_id, turn, role, text)."""
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return messages.withColumn("__n", nth).where((F.col("__n") <= last) & F.col("role").isin("user", "assistant")).drop("__n")


def chat_prompt(windows: DataFrame, questions: DataFrame, template: str) -> DataFrame:
    """(media_id, t_ms, question, prompt): the row that a provider answers."""
    from ..functions.text import filled

    asked = questions.join(windows, ["media_id", "t_ms"])
    values = {"subtitles": F.col("text"), "question": F.col("question"), "current_time": F.col("t_ms") / 1000, "window_start": F.col("window_start_ms") / 1000, "window_end": F.col("window_end_ms") / 1000}
    return asked.select("media_id", "t_ms", "question", filled(template, values).alias("prompt"))


def chat_messages(probes: DataFrame, segments: DataFrame, media: DataFrame, questions: DataFrame, history: DataFrame, system: str, user: str) -> DataFrame:
    """(media_id, t_ms, prompt): the messages that a model with eyes gets, as a JSON array of role and content.

    The system text, the last messages of the medium's conversation (conv_id is
    the medium), then the question filled into `user` with the subtitle lines
    around the position and the number of frames there, and the frames themselves:
    the content of that message is an array of the text and of a reference
    (medium and second) for each frame, in their order.
    """
    from ..functions.text import filled

    windows = context_window(probes, segments)
    frames = frame_times(windows, media).groupBy("media_id", "t_ms").agg(F.count(F.lit(1)).alias("frames"), F.array_sort(F.collect_list(F.struct("n", "frame_ms"))).alias("shots"))
    past = chat_history(history).groupBy(F.col("conv_id").alias("media_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("past"))
    asked = windows.join(questions, ["media_id", "t_ms"]).join(frames, ["media_id", "t_ms"], "left").join(past, "media_id", "left")
    seconds = lambda c: F.format_string("%.2f", F.col(c) / 1000)
    lines = F.when(F.col("text") == "", "(no subtitle lines found in this window)").otherwise(F.col("text"))
    values = {"current_time": seconds("t_ms"), "window_start": seconds("window_start_ms"), "window_end": seconds("window_end_ms"), "transcript_block": lines, "num_frames": F.coalesce("frames", F.lit(0)), "question": F.col("question")}
    message = lambda role, content: F.to_json(F.struct(role.alias("role"), content.alias("content")))
    none = F.lit(None).cast("string")
    part = lambda kind, text, url: F.struct(F.lit(kind).alias("type"), text.alias("text"), F.when(url.isNotNull(), F.struct(url.alias("url"))).alias("image_url"))
    shown = F.transform(F.coalesce("shots", F.array().cast("array<struct<n:bigint,frame_ms:bigint>>")), lambda x: part("image_url", none, F.concat(F.col("media_id").cast("string"), F.lit("@"), F.format_string("%.2f", x["frame_ms"] / 1000))))
    before = F.coalesce(F.transform("past", lambda m: message(m["role"], m["content"])), F.array().cast("array<string>"))
    last = message(F.lit("user"), F.concat(F.array(part("text", filled(user, values), none)), shown))
    every = F.concat(F.array(message(F.lit("system"), F.lit(system))), before, F.array(last))
    return asked.select("media_id", "t_ms", F.concat(F.lit("["), F.array_join(every, ","), F.lit("]")).alias("prompt"))
