"""Gaps, re-timing and audio plans of a whole timeline, by blocked scans over a medium's segments.

A medium is cut into stretches of ids. Windows run inside a stretch; what it adds
up to is one row, a window over a medium's stretches carries these rows' sums and
last ends on, and the carried values are added back. So a long medium is many
tasks, and what one task scans for a medium is a row for each STRETCH segments.

Times in are whole milliseconds; times that come from divisions are whole
microseconds, rounded once a row, so that sums don't depend on their order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .zipping import zip_within


@dataclass(frozen=True)
class Timing:
    """Limits of re-timing, in seconds and factors."""

    min_gap_ms: int = 50
    speed_min: float = 0.5
    speed_max: float = 2.5
    max_freeze: float = 0.2
    max_speedup: float = 1.3
    least: float = 0.01


#: Ids of one stretch.
STRETCH = 1 << 15


def _stretch(size: int) -> Column:
    return F.floor(F.col("id") / size).cast("long").alias("stretch")


def _inside():
    return Window.partitionBy("media_id", "stretch").orderBy("id")


def _over():
    return Window.partitionBy("media_id").orderBy("stretch")


def micros(seconds: Column) -> Column:
    return F.floor(seconds * 1e6 + 0.5).cast("long")


def _summed(dealt: DataFrame, *also: Column) -> DataFrame:
    """(media_id, stretch, id, start_ms, last, ...): a stretch's first segment, the end of its last one, and sums.

    The keys come out as aggregates: a join on them then puts no filter before
    the exchange, and the stretches' rows and their sums read the same one.
    """
    keys = [F.min(c).alias(f"__{c}") for c in ("media_id", "stretch")]
    out = dealt.groupBy("media_id", "stretch").agg(*keys, F.min("id").alias("id"), F.min_by("start_ms", "id").alias("start_ms"), F.max_by("end_ms", "id").alias("last"), *also)
    return out.drop("media_id", "stretch").withColumnsRenamed({"__media_id": "media_id", "__stretch": "stretch"})


def _tails(ends: DataFrame, media: DataFrame) -> DataFrame:
    """(media_id, s, e): what follows the last segment of each medium, by the sums of its stretches."""
    last = ends.groupBy("media_id").agg(F.max_by("last", "stretch").alias("s"))
    return media.join(last, "media_id", "left").select("media_id", F.coalesce("s", F.lit(0)).alias("s"), F.col("total_ms").alias("e"))


def _dealt(segments: DataFrame, stretch: int) -> DataFrame:
    return segments.select("media_id", "id", "start_ms", "end_ms", _stretch(stretch)).repartition("media_id", "stretch")


def gaps(segments: DataFrame, media: DataFrame, min_gap_ms: int = 50, stretch: int = STRETCH) -> DataFrame:
    """(media_id, id, start_ms, end_ms): stretches over min_gap_ms before each segment and, with id null, after the last.

    A gap begins at the previous row's end, even if an earlier row ends later.
    """
    dealt = _dealt(segments, stretch)
    ends = _summed(dealt)
    first = F.lag("id").over(_inside()).isNull()
    inner = dealt.select("media_id", "id", F.lag("end_ms").over(_inside()).alias("s"), F.col("start_ms").alias("e"), first.alias("first")).where("not first").drop("first")
    between = ends.select("media_id", "id", F.lag("last", 1, 0).over(_over()).alias("s"), F.col("start_ms").alias("e"))
    tail = _tails(ends, media).select("media_id", F.lit(None).cast("long").alias("id"), "s", "e")
    every = inner.unionByName(between).unionByName(tail)
    return every.where(F.col("e") - F.col("s") > min_gap_ms).select("media_id", "id", F.col("s").alias("start_ms"), F.col("e").alias("end_ms"))


def _gap_us(start: Column, before: Column, t: Timing) -> Column:
    return F.when(start - before > t.min_gap_ms, (start - before) * 1000).otherwise(0).cast("long")


def sized(segments: DataFrame, tts: DataFrame, t: Timing = Timing(), stretch: int = STRETCH) -> DataFrame:
    """Segments with a synthesised length, and their stretch, speed, target, atempo, freeze (seconds) and chunk (microseconds)."""
    s = zip_within(segments.select("*", _stretch(stretch)), tts.select("*", _stretch(stretch)), "media_id", "stretch")
    s = s.withColumn("orig", (F.col("end_ms") - F.col("start_ms")) / 1000.0).withColumn("said", F.col("tts_ms") / 1000.0)
    short = (F.col("orig") < t.least) | (F.col("said") < t.least)
    s = s.withColumn("speed", F.when(short, 1.0).otherwise(F.greatest(F.lit(t.speed_min), F.least(F.lit(t.speed_max), F.try_divide("orig", "said")))))
    s = s.withColumn("target", F.col("orig") / F.col("speed"))
    fast = F.least(F.coalesce(F.try_divide(F.col("said"), F.col("target") + t.max_freeze), F.lit(t.max_speedup)), F.lit(t.max_speedup))
    s = s.withColumn("atempo", F.when(F.col("said") - F.col("target") <= t.max_freeze, 1.0).otherwise(fast))
    s = s.withColumn("over", F.greatest(F.lit(0.0), F.col("said") / F.col("atempo") - F.col("target")))
    s = s.withColumn("freeze", F.when(F.col("over") < 0.001, 0.0).otherwise(F.col("over")))
    return s.withColumn("chunk_us", micros(F.col("target") + F.col("freeze"))).drop("over")


#: Running sums of a timeline: the new time in microseconds, gaps, rows and freezes up to and with a segment.
SUMS = ("run_us", "gaps", "rows", "freezes")


def timed(segments: DataFrame, tts: DataFrame, t: Timing = Timing(), stretch: int = STRETCH) -> DataFrame:
    """sized() with gap_us, the gap before a segment, and the running SUMS of its medium."""
    return _timed(segments, tts, t, stretch)[0]


def _timed(segments: DataFrame, tts: DataFrame, t: Timing, stretch: int) -> tuple[DataFrame, DataFrame]:
    """timed(), and what each stretch adds to the SUMS."""
    s = sized(segments, tts, t, stretch)
    gap = F.when(F.lag("id").over(_inside()).isNull(), 0).otherwise(_gap_us(F.col("start_ms"), F.lag("end_ms").over(_inside()), t))
    s = s.withColumn("gap_us", gap.cast("long"))  # of the first in a stretch: not yet
    adds = {"run_us": F.col("gap_us") + F.col("chunk_us"), "gaps": (F.col("gap_us") > 0).cast("long"), "rows": F.lit(1).cast("long"), "freezes": (F.col("freeze") > 0).cast("long")}
    ends = _summed(s, *[F.sum(x).alias(f"all_{n}") for n, x in adds.items()]).withColumnRenamed("id", "__first")
    ends = ends.withColumn("__gap", _gap_us(F.col("start_ms"), F.lag("last", 1, 0).over(_over()), t))
    before = _over().rowsBetween(Window.unboundedPreceding, -1)
    own = {"run_us": F.col("__gap"), "gaps": (F.col("__gap") > 0).cast("long")}
    ends = ends.withColumns({f"all_{n}": F.col(f"all_{n}") + x for n, x in own.items()})
    carried = [(F.coalesce(F.sum(f"all_{n}").over(before), F.lit(0)) + own.get(n, F.lit(0))).alias(f"__{n}") for n in SUMS]
    carry = ends.select("media_id", "stretch", "__first", "__gap", *carried)
    s = s.select("*", *[F.sum(x).over(_inside()).alias(n) for n, x in adds.items()])
    # From the left, so that null media stay and both readers of the dealt rows have the same exchange; a null medium has no carry.
    s = s.join(carry, ["media_id", "stretch"], "left")
    s = s.withColumns({n: F.col(n) + F.coalesce(f"__{n}", F.lit(0)) for n in SUMS})
    return s.withColumn("gap_us", F.when(F.col("id") == F.col("__first"), F.col("__gap")).otherwise(F.col("gap_us"))).drop("__first", "__gap", *[f"__{n}" for n in SUMS]), ends


def retime(segments: DataFrame, tts: DataFrame, t: Timing = Timing(), stretch: int = STRETCH) -> DataFrame:
    """(media_id, id, text, speaker, start_us, end_us) on the new timeline."""
    return timed(segments, tts, t, stretch).select("media_id", "id", "text", "speaker", (F.col("run_us") - F.col("chunk_us")).alias("start_us"), F.col("run_us").alias("end_us"))


def audio_plan(segments: DataFrame, tts: DataFrame, media: DataFrame, t: Timing = Timing(), keep_gap_audio: bool = True, mix: float = 0.0, gap_volume: float = 1.0, stretch: int = STRETCH) -> DataFrame:
    """(media_id, track, ord, kind, id, start_us, end_us, duration_us, speed, atempo, volume) rows to render.

    track `main`: gaps as original sound or silence, then speech, alone or mixed
    with the original. track `original`: gaps, speech at its speed, and silence
    for a freeze. ord orders a medium's rows; it comes from the running numbers
    of gaps, segments and freezes.
    """
    s, ends = _timed(segments, tts, t, stretch)
    no, sec = F.lit(None).cast("long"), lambda c: micros(F.col(c))
    start, end = F.col("start_ms") * 1000, F.col("end_ms") * 1000
    has_gap, has_freeze = F.col("gap_us") > 0, F.col("freeze") > 0
    gap_kind = "orig_gap" if keep_gap_audio else "silence"
    last = {"main": F.col("rows") + F.col("gaps") - 1, "original": F.col("rows") + F.col("gaps") + F.col("freezes") - 1}  # a segment's last row

    def row(when, track, back, kind, start, end, duration, speed, atempo, volume):
        d = F.lit(None).cast("double")
        made = F.struct(F.lit(track).alias("track"), (last[track] - back).alias("ord"), F.lit(kind).alias("kind"), start.alias("start_us"), end.alias("end_us"), duration.cast("long").alias("duration_us"), (d if speed is None else speed).alias("speed"), (d if atempo is None else atempo).alias("atempo"), (d if volume is None else F.lit(float(volume))).alias("volume"))
        return F.when(when, made)

    frozen = has_freeze.cast("long")
    rows = F.array(
        row(has_gap, "main", 1, gap_kind, start - F.col("gap_us"), start, F.col("gap_us"), None, None, gap_volume if keep_gap_audio else None),
        row(F.lit(True), "main", 0, "tts_mixed" if mix > 0 else "tts", start, end, F.col("chunk_us"), None, F.col("atempo"), mix if mix > 0 else None),
        row(has_gap, "original", 1 + frozen, "speech", start - F.col("gap_us"), start, F.col("gap_us"), F.lit(1.0), None, None),
        row(F.lit(True), "original", frozen, "speech", start, end, sec("target"), F.col("speed"), None, None),
        row(has_freeze, "original", 0, "silence", no, no, sec("freeze"), None, None, None),
    )
    plan = s.select("media_id", "id", F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("r")).select("media_id", "id", "r.*")
    # What follows the last segment comes after as many rows as the medium has.
    n = F.sum("all_rows") + F.sum("all_gaps")
    counts = ends.groupBy("media_id").agg(n.alias("n_main"), (n + F.sum("all_freezes")).alias("n_original"))
    tail = _tails(_summed(_dealt(segments, stretch)), media).where(F.col("e") - F.col("s") > t.min_gap_ms).join(counts, "media_id", "left")
    track = lambda name: F.struct(F.lit(name).alias("track"), F.coalesce(f"n_{name}", F.lit(0)).alias("ord"))
    after = tail.select("media_id", F.lit(None).cast("long").alias("id"), F.explode(F.array(track("main"), track("original"))).alias("x"), (F.col("s") * 1000).alias("start_us"), (F.col("e") * 1000).alias("end_us")).select("media_id", "id", "x.*", "start_us", "end_us")
    main = F.col("track") == "main"
    after = after.select(
        "media_id", "id", "track", "ord", F.when(main, gap_kind).otherwise("speech").alias("kind"), "start_us", "end_us", (F.col("end_us") - F.col("start_us")).alias("duration_us"),
        F.when(~main, 1.0).alias("speed"), F.lit(None).cast("double").alias("atempo"), F.when(main & F.lit(keep_gap_audio), float(gap_volume)).alias("volume"),
    )
    return plan.unionByName(after)


def command_plan(plan: DataFrame, pad_us: int = 2_000_000) -> DataFrame:
    """Adds a row's seek: coarse (at most pad before the start), fine, how much to read, and a floor of 1 ms for silence."""
    coarse = F.greatest(F.lit(0), F.col("start_us") - pad_us)
    return (
        plan.withColumn("coarse_us", coarse)
        .withColumn("fine_us", F.col("start_us") - coarse)
        .withColumn("read_us", F.col("end_us") - F.col("start_us") + F.col("fine_us") + 500_000)
        .withColumn("duration_us", F.when(F.col("kind") == "silence", F.greatest(F.lit(1000), F.col("duration_us"))).otherwise(F.col("duration_us")))
    )


def rescale(segments: DataFrame, media: DataFrame, slack_ms: int = 500, stretch: int = STRETCH) -> DataFrame:
    """Shrinks all times to the medium's length where the last end exceeds it by over slack_ms; times in microseconds.

    The factor is found once a medium and meets its stretches, so that a long one isn't one task.
    """
    s = segments.select("*", _stretch(stretch))
    ends = s.groupBy("media_id", "stretch").agg(F.max("end_ms").alias("last")).withColumn("last", F.max("last").over(Window.partitionBy("media_id")))
    factor = F.when(F.col("last") > F.col("total_ms") + slack_ms, F.col("total_ms") / F.col("last")).otherwise(1.0)
    factors = ends.join(media, "media_id").select("media_id", "stretch", factor.alias("factor"))
    at = lambda c: F.floor(F.col(c) * 1000 * F.col("factor") + 0.5).cast("long")
    return s.join(factors, ["media_id", "stretch"]).select("media_id", "id", at("start_ms").alias("start_us"), at("end_ms").alias("end_us"), "text", "speaker")


def voiceover_volumes(mode: Column, volume: Column, default: float = 0.35) -> Column:
    """(mix, original, gap) volumes of the modes off, bake and separate."""
    v = F.coalesce(volume, F.lit(default))
    gap = F.least(F.lit(1.0), 2 * v)
    three = lambda a, b, c: F.struct(a.alias("mix"), b.alias("original"), c.alias("gap"))
    return F.when(mode == "bake", three(v, F.lit(0.0), gap)).when(mode == "separate", three(F.lit(0.0), F.lit(1.0), gap)).otherwise(three(F.lit(0.0), F.lit(0.0), F.lit(1.0)))


#: Sample rates of recognition and of the rendered tracks.
SPEECH_RATE, TRACK_RATE = 16000, 44100


def extract_plan(media: DataFrame) -> DataFrame:
    """(media_id, source, target, codec, rate, channels): the recogniser's audio of media (media_id, path)."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return media.select("media_id", F.col("path").alias("source"), F.concat(stem, F.lit("_audio.wav")).alias("target"), F.lit("pcm_s16le").alias("codec"), F.lit(SPEECH_RATE).alias("rate"), F.lit(1).alias("channels"))


def concat_plan(plan: DataFrame) -> DataFrame:
    """(media_id, track, n, list): the files of a track's rows in their order, as a list to be joined."""
    name = F.concat(F.lit("file '"), F.col("track"), F.lit("_"), F.format_string("%05d", F.col("ord")), F.when(F.col("track") == "main", ".ts").otherwise(".wav"), F.lit("'"))
    return plan.groupBy("media_id", "track").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", name.alias("f")))), lambda x: x["f"]), "\n").alias("list"))


def mux_plan(concats: DataFrame) -> DataFrame:
    """(media_id, step, video, audio, video_codec, audio_codec, rate): join the pictures, then add the sound, encoded once."""
    joined = concats.where("track = 'main'").select("media_id", F.explode(F.array(
        F.struct(F.lit(0).alias("step"), F.lit("concat").alias("video"), F.lit(None).cast("string").alias("audio"), F.lit("copy").alias("video_codec"), F.lit(None).cast("string").alias("audio_codec"), F.lit(None).cast("int").alias("rate")),
        F.struct(F.lit(1).alias("step"), F.lit("video_only.ts").alias("video"), F.lit("video_audio.wav").alias("audio"), F.lit("copy").alias("video_codec"), F.lit("aac").alias("audio_codec"), F.lit(TRACK_RATE).alias("rate")),
    )).alias("s"))
    return joined.select("media_id", "s.*")


def pad_plan(speech: DataFrame) -> DataFrame:
    """(media_id, id, file, pad_ms, rate): the silence after each synthesised file of segments (media_id, id, text)."""
    from ..functions.text import tail_silence_ms

    return speech.select("media_id", "id", F.format_string("seg_%05d.wav", F.col("id")).alias("file"), tail_silence_ms(F.col("text")).cast("long").alias("pad_ms"), F.lit(TRACK_RATE).alias("rate"))
