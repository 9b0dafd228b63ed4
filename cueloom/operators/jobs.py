"""Job analytics: roll-ups, queues, time to live, quotas, costs. The clock is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranks

DAY = 86400
MEASURES = ("segments_count", "audio_seconds", "tts_characters", "llm_input_tokens", "llm_output_tokens")


def _since(jobs: DataFrame, now: int, days: int) -> DataFrame:
    return jobs.where(F.col("created_at") >= now - days * DAY)


def stats_summary(jobs: DataFrame, now: int, days: int = 30) -> DataFrame:
    """One row: jobs, done, failed (null without jobs) and the sums of MEASURES (0 without jobs)."""
    case = lambda s: F.sum(F.when(F.col("status") == s, 1).otherwise(0))
    return _since(jobs, now, days).agg(F.count(F.lit(1)).alias("jobs"), case("done").alias("done"), case("failed").alias("failed"), *[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in MEASURES])


def stats_by_language(jobs: DataFrame, now: int, days: int = 30) -> DataFrame:
    g = _since(jobs, now, days).where("target_language is not null").groupBy("target_language")
    return g.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("audio_seconds"), F.lit(0)).alias("audio_seconds")).orderBy(F.desc("n"), "target_language")


def recent_jobs(jobs: DataFrame, limit: int = 50) -> DataFrame:
    """The latest jobs, whatever their age; equal times by id."""
    return jobs.orderBy(F.desc("created_at"), "id").limit(limit)


def queue_position(jobs: DataFrame) -> DataFrame:
    """(queue, id, queue_position): other jobs of the queue created before a queued one, else 0.

    jobs: (queue, id, status, created_at). Jobs without a time count for none.
    One queue may hold all jobs: positions come from counts by time, see ranks.
    """
    has_time = F.coalesce("created_at", F.lit(0)) != 0
    before = ranks.earlier(jobs.where(F.col("status").isin("queued", "running") & has_time & F.col("queue").isNotNull()), "queue", at="created_at")
    mine = (F.col("status") == "queued") & has_time
    return jobs.join(before, ["queue", "created_at"], "left").select("queue", "id", F.when(mine, F.coalesce("offset", F.lit(0))).otherwise(0).alias("queue_position"))


def usage(events: DataFrame, by: str) -> DataFrame:
    return events.groupBy(by).agg(F.count(F.lit(1)).alias("used"))


def usage_quota(used: DataFrame, limit: int) -> DataFrame:
    """Adds has_trial and remaining; a limit of 0 or less gives no trial."""
    n = F.coalesce("used", F.lit(0))
    return used.withColumn("has_trial", F.lit(limit > 0) & (n < limit)).withColumn("remaining", F.greatest(F.lit(0), F.lit(limit) - n))


def latest(rows: DataFrame, key: str, *by: str) -> DataFrame:
    """The last row of each key: an upsert over an append-only table."""
    others = F.struct(*[c for c in rows.columns if c != key])
    return rows.groupBy(key).agg(F.max_by(others, F.struct(*by)).alias("r")).select(key, "r.*")


def ttl_sweep(jobs: DataFrame, now: int, max_age_hours: int, statuses: tuple[str, ...] = ("done", "failed")) -> DataFrame:
    """Jobs to delete: ended and last touched max_age_hours ago or earlier. Cancelled ones never expire by default."""
    return jobs.where((F.col("touched_at") <= now - max_age_hours * 3600) & F.col("status").isin(*statuses))


def settled_status(events: DataFrame) -> DataFrame:
    """(job_id, status): the last status by seq, but an end state stays: nothing after the first one counts."""
    ends = F.min(F.when(F.col("status").isin("done", "failed", "cancelled"), F.col("seq"))).over(Window.partitionBy("job_id"))
    kept = events.withColumn("__end", ends).where(F.col("__end").isNull() | (F.col("seq") <= F.col("__end")))
    return kept.groupBy("job_id").agg(F.max_by("status", "seq").alias("status"))


#: The file types that are taken.
UPLOADS = (".mp4", ".mov", ".avi", ".mkv", ".webm", ".m4v", ".mp3", ".wav", ".m4a", ".aac", ".flac", ".ogg", ".opus")


def upload_refusal(name: Column, size_bytes: Column, duration_s: Column, max_mb: int, max_s: int) -> Column:
    """Why an upload is refused: extension, size or duration; null if it is taken. A null duration passes, a limit of 0 is none."""
    ext = F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"(\.[^./]*)$", 1))
    long = F.lit(max_s > 0) & (F.coalesce(duration_s, F.lit(0)) > max_s)
    return F.when(~ext.isin(*UPLOADS), "extension").when(size_bytes > max_mb * 1024 * 1024, "size").when(long, "duration")


def cost_breakdown(used: DataFrame, prices: DataFrame) -> DataFrame:
    """Adds the dollars of recognition, translation and synthesis, and their total.

    Providers without a price of their own have the first row's. prices holds
    one row a provider; whether it is broadcast is the optimizer's choice by its size.
    """
    p = prices.select(F.col("provider").alias("__p"), *[c for c in prices.columns if c != "provider"])
    first = {k: F.lit(v) for k, v in prices.first().asDict().items() if k != "provider"}
    j = used.join(p, F.col("provider") == F.col("__p"), "left")
    rate = lambda c: F.coalesce(F.col(c), first[c])
    out = j.withColumn("whisper_usd", F.col("audio_seconds") / 60.0 * rate("per_minute"))
    out = out.withColumn("translation_usd", F.col("llm_input_tokens") / 1e6 * rate("per_m_in") + F.col("llm_output_tokens") / 1e6 * rate("per_m_out"))
    out = out.withColumn("tts_usd", F.col("tts_characters") / 1e6 * rate("per_m_chars"))
    return out.withColumn("total_usd", F.col("whisper_usd") + F.col("translation_usd") + F.col("tts_usd")).drop(*p.columns)


def step_share(steps: DataFrame) -> DataFrame:
    """steps (run, step, elapsed) with its percentage of the run, 0 for a run of no time, and whole minutes and seconds."""
    total = F.sum("elapsed").over(Window.partitionBy("run"))
    share = F.when(total > 0, F.col("elapsed") / total * 100).otherwise(0.0)
    return steps.withColumn("share", share).withColumn("m", F.floor(F.col("elapsed") / 60).cast("long")).withColumn("s", F.floor(F.col("elapsed") - 60 * F.floor(F.col("elapsed") / 60)).cast("long"))


def missing_files(expected: DataFrame, present: DataFrame) -> DataFrame:
    """Expected segment files (media_id, id) that are not there, with their names."""
    named = expected.withColumn("name", F.format_string("seg_%05d.wav", F.col("id")))
    return named.join(present, ["media_id", "name"], "left_anti")


def reusable_mix(requests: DataFrame, cached: DataFrame, within: float = 0.001) -> DataFrame:
    """requests (job_id, volume) with reuse: whether a cached mix has the same volume."""
    c = cached.select("job_id", F.col("volume").alias("__v"))
    return requests.join(c, "job_id", "left").withColumn("reuse", F.coalesce(F.abs(F.col("volume") - F.col("__v")) < within, F.lit(False))).drop("__v")


def readiness(probes: DataFrame, known: DataFrame) -> DataFrame:
    """probes (job_id) with code: 404 for unknown jobs, 409 for unfinished ones, else 200."""
    k = known.select(F.col("id").alias("job_id"), "status")
    return probes.join(k, "job_id", "left").withColumn("code", F.when(F.col("status").isNull(), 404).when(F.col("status") != "done", 409).otherwise(200))


def timings_json(steps: DataFrame, costs: DataFrame) -> DataFrame:
    """(run, body): a run's total time, its steps in order and its cost; steps (run, pos, step, elapsed), costs (run, total_usd)."""
    g = steps.groupBy("run").agg(F.sum("elapsed").alias("total"), F.array_sort(F.collect_list(F.struct("pos", "step", "elapsed"))).alias("steps"))
    shown = F.transform("steps", lambda s: F.struct(s["step"].alias("name"), s["elapsed"].alias("elapsed")))
    return g.join(costs, "run", "left").select("run", F.to_json(F.struct("total", shown.alias("steps"), F.col("total_usd").alias("cost"))).alias("body"))


def job_rows(runs: DataFrame, costs: DataFrame) -> DataFrame:
    """The statistics table's rows of ended runs, cancelled ones left out; created_at is when the run began.

    runs: (id, status, started_at, finished_at, params map, audio_seconds, segments_count,
    tts_characters, llm_input_tokens, llm_output_tokens, error); costs: (id, whisper_usd,
    translation_usd, tts_usd, total_usd).
    """
    p = lambda k: F.try_element_at("params", F.lit(k)).alias(k)
    ended = runs.where(F.col("status").isin("done", "failed")).join(costs, "id", "left")
    usd = [F.coalesce(f"{k}_usd", F.lit(0.0)).alias(f"{k}_cost_usd") for k in ("whisper", "translation", "tts", "total")]
    texts = [p(k) for k in ("target_language", "source_language", "style", "voice", "voiceover", "transcription_provider", "translation_provider", "tts_provider")]
    return ended.select("id", F.col("started_at").alias("created_at"), "finished_at", "status", *texts, *MEASURES, *usd, (F.col("finished_at") - F.col("started_at")).cast("double").alias("duration_seconds"), "error")


def job_created(requests: DataFrame, now: int) -> DataFrame:
    """(id, at, seq, status, created_at, error): the first row of each job's record, from requests (id)."""
    none = F.lit(None)
    return requests.select("id", F.lit(now).cast("long").alias("at"), F.lit(0).cast("long").alias("seq"), F.lit("queued").alias("status"), F.lit(now).cast("long").alias("created_at"), none.cast("string").alias("error"))


def job_updated(changes: DataFrame) -> DataFrame:
    """Rows of changes (id, at, seq, status, error) for a job's record; keys in the error are redacted."""
    from ..functions.text import redact

    return changes.select("id", "at", "seq", "status", F.lit(None).cast("long").alias("created_at"), redact(F.col("error")).alias("error"))


def job_record(rows: DataFrame) -> DataFrame:
    """(id, status, created_at, error): a job's record from its appended rows; a change without an error leaves the last one."""
    at = F.struct("at", "seq")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c)
    return rows.groupBy("id").agg(last("status"), last("created_at"), last("error"))


def without(rows: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    """rows of jobs that are not deleted; gone: (key)."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def history(jobs: DataFrame, limit: int = 100) -> DataFrame:
    """The latest jobs for a list of past ones; equal times by id."""
    return recent_jobs(jobs, limit)


def usage_counters(calls: DataFrame) -> DataFrame:
    """(run, llm_calls, llm_input_tokens, llm_output_tokens, tts_calls, tts_characters) of calls (run, kind, input_tokens, output_tokens, text)."""
    llm, tts = F.col("kind") == "llm", F.col("kind") == "tts"
    total = lambda when, c: F.coalesce(F.sum(F.when(when, F.coalesce(c, F.lit(0)))), F.lit(0))
    return calls.groupBy("run").agg(
        F.count(F.when(llm, 1)).alias("llm_calls"),
        total(llm, F.col("input_tokens")).alias("llm_input_tokens"),
        total(llm, F.col("output_tokens")).alias("llm_output_tokens"),
        F.count(F.when(tts, 1)).alias("tts_calls"),
        total(tts, F.length("text").cast("long")).alias("tts_characters"),
    )


def cost_summary(steps: DataFrame, costs: DataFrame, used: DataFrame | None = None) -> DataFrame:
    """(run, body): a line a step with minutes, seconds and share, the total time, a line a cost with what it is for, and the total.

    steps: (run, pos, step, elapsed); costs: (run, whisper_usd, translation_usd,
    tts_usd, total_usd); used: usage_counters() with audio_seconds and the
    translation's provider, which then stand before the dollars.
    """
    time = lambda s: F.format_string("%dm%04.1fs", F.floor(s / 60).cast("long"), s - 60 * F.floor(s / 60))
    line = F.concat(F.rpad("step", 30, " "), F.lit(" "), time(F.col("elapsed")), F.format_string("  (%4.1f%%)", F.col("share")))
    g = step_share(steps).withColumn("line", line).groupBy("run").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"), F.sum("elapsed").alias("total"))
    j = g.join(costs, "run", "left")
    usd = lambda name, c: F.format_string(f"{name:<22}$%8.4f", F.coalesce(F.col(c), F.lit(0.0)))
    said = [usd("Transcription", "whisper_usd"), usd("Translation", "translation_usd"), usd("TTS", "tts_usd")]
    total = usd("TOTAL API COST", "total_usd")
    if used is not None:
        j = j.join(used, "run", "left")
        n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
        cost = lambda c: F.coalesce(F.col(c), F.lit(0.0))
        said = [
            F.format_string(f"{'Transcription':<22} %7.1f min          $%8.4f", F.coalesce(F.col("audio_seconds"), F.lit(0)) / 60.0, cost("whisper_usd")),
            F.format_string("%-22s %,7d in / %,7d out  $%8.4f  (%d calls)", F.concat(F.lit("Translation ("), F.coalesce("translation", F.lit("-")), F.lit(")")), n("llm_input_tokens"), n("llm_output_tokens"), cost("translation_usd"), n("llm_calls")),
            F.format_string(f"{'TTS':<22} %,7d chars        $%8.4f  (%d calls)", n("tts_characters"), cost("tts_usd"), n("tts_calls")),
        ]
        total = F.format_string(f"{'TOTAL API COST':<22}{'':<21}$%8.4f", cost("total_usd"))
    rows = F.concat(F.col("l.line"), F.array(F.concat(F.rpad(F.lit("Total wall time"), 30, " "), F.lit(" "), time(F.col("total"))), *said, total))
    return j.select("run", F.array_join(rows, "\n").alias("body"))


def orphan_files(files: DataFrame, now: int, max_age_s: int = 3600) -> DataFrame:
    """Scratch files (path, modified_at) older than max_age_s; with 0, as when a service starts, all of them."""
    return files.where(F.lit(max_age_s <= 0) | (F.col("modified_at") < now - max_age_s))


def dispatch(jobs: DataFrame, workers: int) -> DataFrame:
    """(id, worker, turn): waiting jobs (id, created_at) dealt to `workers` in the order of their creation, equal times by id (whole numbers)."""
    n = F.col("__n")
    return ranks.numbered(jobs.select("id", "created_at"), "created_at", "id", "__n").select("id", (n % workers).cast("int").alias("worker"), F.floor(n / workers).cast("long").alias("turn"))
