"""Driver queries of sources, sinks, providers, catalogs and job records, over tables derived from the test data.

Providers are the deterministic functions below. Bodies, paths and reports are
made of the derived tables, so that each operator reads what it would in service.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import catalogs, config, providers
from ..functions import text as T
from ..operators import context, jobs
from ..operators import segments as S
from ..operators import timeline as TL
from ..sources import readers, sqlite, writers
from ..sources.stats_store import StatsStore
from ..storage import drop_at_exit, shared_dir
from ..streaming import live
from . import fixtures as X
from .queries import NOW, track_info

STYLES = {"standard": {"description": "Plain"}, "kids": {"description": "For children", "translation": {"directives": "Be simple", "temperature": 0.5}, "tts": {"speed": 1.25, "emotion": "excited"}}}
BASE = {"models": {"translation": {"provider": "together", "model": "m1"}, "tts": {"provider": "elevenlabs", "model": "v3"}, "chat": "m2"}, "tts": {"workers": 8}}
ENVIRONMENT, BASE_URLS = {"TOGETHER_API_KEY": "k1", "OPENAI_API_KEY": ""}, {"together": "https://host.invalid/v1"}
TEMPLATE = "Say {name} in {region}; {{kept}} {unknown}"


def long(c, name: str):
    return (F.col(c) if isinstance(c, str) else c).cast("long").alias(name)


def milli(c, name: str):
    return F.floor(c * 1000 + 0.5).cast("long").alias(name)


def pick(i, *values):
    return F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))


def orders(spark, d) -> DataFrame:
    return X.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("t"), F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "failed").otherwise("queued").alias("status"))


def checkpoint_scan(spark, d):
    c = X.cues(spark, d)
    one = F.struct("id", (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), "text", F.when(F.col("id") % 5 > 0, F.col("speaker")).alias("speaker"))
    bodies = c.groupBy("media_id").agg(F.collect_list(one).alias("segments")).select("media_id", F.to_json(F.struct(F.when(F.col("media_id") % 3 > 0, "translated").alias("stage"), "segments")).alias("body"))
    return readers.checkpoints(bodies)


def progress_scan(spark, d):
    e = X.table(spark, d, "events")
    line = F.to_json(F.struct((F.col("event_id") % 9).cast("int").alias("step"), F.lit(9).alias("total"), F.col("event_type").alias("message")))
    i = F.col("event_id") % 5
    lines = e.select(F.col("user_id").alias("job_id"), F.when(i == 0, "").when(i == 1, '{"step":').when(i == 2, '{"x":1}').otherwise(line).alias("value"))
    return readers.progress_lines(lines).select("job_id", long("step", "step"), long("total", "total"), "message")


def latest_progress(spark, d):
    e = X.table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").cast("int").alias("step"), F.lit(9).alias("total"), F.col("event_type").alias("message"))
    return live.latest_progress(e).select("job_id", long("step", "step"), long("total", "total"), "message")


def job_meta_scan(spark, d):
    o = orders(spark, d)
    body = F.to_json(F.struct(F.col("k").cast("string").alias("id"), "status", F.col("t").alias("created_at"), F.when(F.col("status") == "failed", "it broke").alias("error")))
    return readers.job_meta(o.select(F.when(F.col("k") % 7 == 0, "{").when(F.col("k") % 7 == 1, '{"x":1}').otherwise(body).alias("body")))


def stored_segments(spark, d):
    c = X.cues(spark, d)
    found = readers.segments_of(X.media(c), writers.segments_json(c).where(F.col("media_id") % 4 > 0).withColumn("body", F.when(F.col("media_id") % 4 == 3, "oops").otherwise(F.col("body"))))
    return found.select("media_id", long("n", "n"), F.array_join("segments.text", "|").alias("texts"))


def usage_scan(spark, d):
    used = X.table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    g = used.groupBy((F.col("user_id") % 10).alias("g")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("user_id").cast("string"), "n"))).alias("m"))
    return readers.usage_counts(g.select(F.when(F.col("g") % 4 == 3, "oops").otherwise(F.to_json("m")).alias("body"))).select("ip", long("n", "n"))


def usage_append(spark, d):
    path = f"{shared_dir(spark)}/usage-{uuid.uuid4().hex}"
    e = X.table(spark, d, "events").select(F.col("user_id").cast("string").alias("ip"), (F.col("event_id") % 2).alias("half"))
    for half in (0, 1):
        writers.append_usage(e.where(F.col("half") == half), path)
    return writers.usage_counted(spark.read.schema("ip string").parquet(path))


def media_probe(spark, d):
    m, i = X.media(X.cues(spark, d)), F.col("media_id")
    cs = F.floor(F.col("total_ms") / 10)
    clock = F.format_string("%02d:%02d:%02d.%02d", F.floor(cs / 360000), F.floor(cs / 6000) % 60, F.floor(cs / 100) % 60, cs % 100)
    report = F.when(i % 3 == 2, "no such stream").otherwise(F.concat(F.lit("Input #0\n  Duration: "), clock, F.lit(", start: 0.0\n  Video: h264"), F.when(i % 2 == 0, ", 29.97 fps, 30 tbr").otherwise("")))
    probed = m.select("media_id", F.when(i % 3 == 1, F.col("total_ms") * 8).alias("frames"), F.when(i % 3 == 1, 8000).alias("rate"), report.alias("report"))
    return probed.select("media_id", milli(T.media_seconds(F.col("frames"), F.col("rate"), F.col("report")), "length_ms"), milli(T.frame_rate(F.col("report")), "milli_fps"))


def extract_plan(spark, d):
    m = X.media(X.cues(spark, d)).select("media_id", F.concat(F.lit("/in/video."), "media_id", F.lit(".mp4")).alias("path"))
    return TL.extract_plan(m).withColumns({"rate": F.col("rate").cast("long"), "channels": F.col("channels").cast("long")})


def caption_body(url: str) -> str:
    """The offline provider of caption bodies: one event that says its url; German ones can't be had."""
    if "de" in url:
        raise OSError(url)
    return '{"events":[{"tStartMs":0,"dDurationMs":900,"segs":[{"utf8":"' + url + '"}]}]}'


def source_captions(spark, d):
    found = providers.fetch_source_captions(track_info(spark, d), caption_body)
    return readers.manual_captions(found).join(found.select("media_id", "kind"), "media_id").select("media_id", "kind", "text", "end_ms")


def prompt_fill(spark, d):
    n, r = X.table(spark, d, "nation"), X.table(spark, d, "region")
    j = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select("n_nationkey", T.filled(TEMPLATE, {"name": F.col("n_name"), "region": F.col("r_name")}).alias("prompt"))


def corrections_prompt(spark, d):
    """Each region's known errors: its nations' names in small letters."""
    n = X.table(spark, d, "nation")
    return config.corrections_blocks(n.select("n_regionkey", F.lower("n_name").alias("wrong"), F.col("n_name").alias("right")), "n_regionkey")


def style_lookup(spark, d):
    j = X.table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("conv_id") % 2 == 0, "kids").otherwise("standard").alias("style"))
    return readers.style_of(j, readers.styles(spark, STYLES)).select("conv_id", "turn", "style", "description", "directives", milli(F.col("temperature"), "temperature"), milli(F.col("speed"), "speed"), "emotion")


def native_voices_for(spark, d):
    n = X.table(spark, d, "nation").select("n_nationkey", pick(F.col("n_nationkey"), "openai", "elevenlabs", "together").alias("provider"), pick(F.col("n_nationkey"), "en", "fr", "xx", "sv").alias("lang"))
    return catalogs.native_voices_for(n, catalogs.voices(spark)).select("n_nationkey", "provider", "lang", "male", "female")


def voice_lookup(spark, d):
    i = F.col("c_custkey")
    probe = X.table(spark, d, "customer").select("c_custkey", pick(i, "elevenlabs", "openai", "together").alias("provider"), pick(F.floor(i / 3), "Daniel", "Peter", "nova", "Olivia", "dutch man", "mine").alias("voice"))
    return catalogs.voice_of(probe, catalogs.voices(spark)).select("c_custkey", "provider", "voice", "voice_id")


def voice_defaults(spark, d):
    i = F.col("c_custkey")
    c = X.table(spark, d, "customer").select("c_custkey", F.when(i % 4 == 0, F.concat(F.lit("own"), i)).alias("own"), pick(i, "male", "female", "other").alias("gender"), pick(i, "M3", "F9", "nova").alias("style"))
    return c.select("c_custkey", catalogs.default_voice(F.col("own"), F.col("gender"), F.lit("onyx"), F.lit("nova")).alias("voice"), catalogs.local_voice(F.col("style")).alias("local_style"))


def pick_voices(prompt: str) -> str:
    """The offline model that picks voices: some answers are objects, some are fenced, some name nobody."""
    n = int(prompt.rsplit(" ", 1)[1])
    return ['<think>[1]</think>```json\n["Nova", "ONYX ", "nova", "nobody", "echo", "fable"]\n```', '{"voice": "Echo", "explanation": "calm"}', "I can't say.", 'Here: [{"voice": "M1"}, {"voice": "alloy", "explanation": "x"}]'][n % 4]


def voice_match(spark, d):
    asked = X.table(spark, d, "customer").select(F.col("c_custkey").alias("answer_id"), pick(F.col("c_custkey"), "openai", "supertonic").alias("provider"), F.concat(F.lit("voice "), "c_custkey").alias("description"))
    table = catalogs.voices(spark).where("provider in ('openai', 'supertonic')")
    return providers.match_voice(asked, table, "{catalog}\n{description}", pick_voices, "en").select("answer_id", long("rank", "rank"), "name", "explanation")


def uploaded_inputs(spark, d):
    o = orders(spark, d)
    files = o.select(F.explode(F.array(F.concat(F.lit("/jobs/"), "k", F.lit("/input.mp4")), F.concat(F.lit("/jobs/"), "k", F.lit("/input.wav")), F.concat(F.lit("/jobs/"), F.col("k") + 1, F.lit("/output.mp4")))).alias("path"))
    return readers.uploaded_inputs(files)


def subtitle_bodies(spark, d):
    return writers.subtitles(X.cues(spark, d), ("vtt", "txt")).select("media_id", "format", F.md5("body").alias("body_md5"))


def checkpoint_round_trip(spark, d):
    path = f"{shared_dir(spark)}/stages-{uuid.uuid4().hex}"
    c = X.cues(spark, d)
    writers.write_checkpoint(c.limit(0), path, "translated")
    writers.write_checkpoint(c.where("id = 0"), path, "transcribed")
    writers.write_checkpoint(c, path, "transcribed")
    return spark.read.schema(c.schema.add("stage", "string")).parquet(path)


def progress_round_trip(spark, d):
    path = f"{shared_dir(spark)}/progress-{uuid.uuid4().hex}"
    e = X.table(spark, d, "events").select(F.col("user_id").cast("string").alias("job_id"), F.col("event_id").cast("int").alias("step"), F.lit(9).alias("total"), F.col("event_type").alias("message"))
    for half in (0, 1):
        writers.append_progress(e.where(F.col("step") % 2 == half), path)
    return spark.read.schema("job_id string, step long, total long, message string").json(path)


def job_record(spark, d):
    o = orders(spark, d)
    born = jobs.job_created(o.select(F.col("k").cast("string").alias("id")), NOW)
    done = o.select(F.col("k").cast("string").alias("id"), F.lit(NOW + 5).cast("long").alias("at"), F.lit(1).cast("long").alias("seq"), F.lit("running").alias("status"), F.when(F.col("k") % 2 == 0, F.concat(F.lit("key sk-"), F.repeat(F.lit("a1"), 12))).alias("error"))
    last = done.where("status is not null and cast(id as bigint) % 3 = 0").select("id", "at", F.lit(2).cast("long").alias("seq"), F.lit("failed").alias("status"), F.when(F.col("id").cast("long") % 4 == 0, "late").alias("error"))
    return jobs.job_record(born.unionByName(jobs.job_updated(done)).unionByName(jobs.job_updated(last)))


def segments_round_trip(spark, d):
    bodies = writers.segments_json(X.cues(spark, d)).select("media_id", F.concat(F.lit('{"segments":'), "body", F.lit("}")).alias("body"))
    return readers.checkpoints(bodies).drop("stage")


def _steps(spark, d):
    e = X.table(spark, d, "events").groupBy(F.col("user_id").alias("run"), F.col("event_type").alias("step")).agg(F.sum(F.floor("value")).alias("v"))
    order = {"click": 0, "view": 1, "purchase": 2}
    pos = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in order.items() for x in pair]), F.col("step")), F.lit(9))
    return e.select("run", pos.alias("pos"), "step", F.col("v").cast("double").alias("elapsed"))


def timings(spark, d):
    steps = _steps(spark, d)
    body = jobs.timings_json(steps, steps.select("run").distinct().where("run % 2 = 0").withColumn("total_usd", F.col("run") * 0.5))
    x = F.from_json("body", "total double, steps array<struct<name:string,elapsed:double>>, cost double")
    return body.select("run", x.alias("x")).select("run", milli(F.col("x.total"), "total"), F.array_join(F.array_sort(F.transform("x.steps", lambda s: F.concat(s["name"], F.lit("="), s["elapsed"].cast("long")))), ",").alias("steps"), milli(F.col("x.cost"), "cost"))


def cost_summary(spark, d):
    steps = _steps(spark, d).withColumn("pos", F.col("step"))
    costs = steps.select("run").distinct().select("run", F.lit(0.25).alias("whisper_usd"), F.lit(0.5).alias("translation_usd"), F.lit(1.0).alias("tts_usd"), F.lit(1.75).alias("total_usd"))
    e, n = X.table(spark, d, "events").groupBy(F.col("user_id").alias("run")).agg(F.count(F.lit(1)).alias("n")), F.col("n")
    used = e.select("run", (n * 30).alias("audio_seconds"), n.alias("llm_calls"), (n * 1234).alias("llm_input_tokens"), (n * 567).alias("llm_output_tokens"), (n * 2).alias("tts_calls"), (n * 89).alias("tts_characters"), pick(F.col("run"), "together", "openai").alias("translation"))
    return jobs.cost_summary(steps, costs, used)


def usage_counters(spark, d):
    c = X.table(spark, d, "conversations").select(F.col("conv_id").alias("run"), F.when(F.col("role") == "user", "llm").otherwise("tts").alias("kind"), F.length("text").cast("long").alias("input_tokens"), F.when(F.col("turn") % 2 == 0, F.col("turn")).cast("long").alias("output_tokens"), "text")
    return jobs.usage_counters(c)


def job_rows(spark, d):
    o = orders(spark, d)
    status = F.when(F.col("k") % 5 == 0, "cancelled").otherwise(F.col("status"))
    runs = o.select(
        F.col("k").cast("string").alias("id"), status.alias("status"), F.col("t").alias("started_at"), (F.col("t") + F.col("k") % 100).alias("finished_at"), F.create_map(F.lit("voice"), F.lit("nova"), F.lit("target_language"), F.concat(F.lit("l"), F.col("c") % 5)).alias("params"),
        *[F.col("k").alias(m) for m in jobs.MEASURES], F.lit(None).cast("string").alias("error"),
    )
    costs = o.where("k % 2 = 0").select(F.col("k").cast("string").alias("id"), *[F.lit(x).alias(f"{n}_usd") for n, x in (("whisper", 0.5), ("translation", 0.25), ("tts", 0.25), ("total", 1.0))])
    r = jobs.job_rows(runs, costs)
    return r.select("id", "created_at", "finished_at", "status", "target_language", "source_language", "voice", "segments_count", milli(F.col("total_cost_usd"), "total_milli"), milli(F.col("duration_seconds"), "duration_ms"))


def jobs_after_delete(spark, d):
    j = X.job_stats(spark, d).select("id", "status", F.col("created_at").alias("touched_at"))
    return jobs.without(j, jobs.ttl_sweep(j, NOW, 24 * 365))


def job_history(spark, d):
    return jobs.history(X.job_stats(spark, d).select("id", "created_at", "status"))


def orphan_files(spark, d):
    o = orders(spark, d).select(F.concat(F.lit("/tmp/"), "k").alias("path"), F.col("t").alias("modified_at"))
    return jobs.orphan_files(o, NOW, 86400 * 365)


def dispatch(spark, d):
    o = orders(spark, d).where("status = 'queued'").select(F.col("k").alias("id"), F.col("t").alias("created_at"))
    return jobs.dispatch(o, 2).select("id", long("worker", "worker"), "turn")


def readiness(spark, d):
    o = orders(spark, d)
    probes = o.select((F.col("k") + 1).cast("string").alias("job_id"))
    return jobs.readiness(probes, o.select(F.col("k").cast("string").alias("id"), "status")).select("job_id", long("code", "code"))


def mix_cache(spark, d):
    o = orders(spark, d)
    asked = o.select(F.col("k").alias("job_id"), ((F.col("k") % 10) / 10.0).alias("volume"))
    cached = o.where("k % 4 > 0").select(F.col("k").alias("job_id"), ((F.col("k") % 10) / 10.0 + (F.col("k") % 3) * 0.0006).alias("volume"))
    return jobs.reusable_mix(asked, cached).select("job_id", "reuse")


def concat_plan(spark, d):
    c = X.cues(spark, d)
    return TL.concat_plan(TL.audio_plan(c, X.tts(c), X.media(c), mix=0.35)).select("media_id", "track", "n", F.md5("list").alias("list_md5"))


def mux_plan(spark, d):
    c = X.cues(spark, d)
    return TL.mux_plan(TL.concat_plan(TL.audio_plan(c, X.tts(c), X.media(c)))).withColumns({"step": F.col("step").cast("long"), "rate": F.col("rate").cast("long")})


def pad_plan(spark, d):
    return TL.pad_plan(X.cues(spark, d)).withColumn("rate", F.col("rate").cast("long"))


def voiceover_volumes(spark, d):
    c = X.table(spark, d, "customer").select("c_custkey", pick(F.col("c_custkey"), "off", "bake", "separate").alias("mode"), F.when(F.col("c_custkey") % 4 > 0, (F.col("c_custkey") % 8) / 8.0).alias("volume"))
    v = TL.voiceover_volumes(F.col("mode"), F.col("volume"))
    return c.select("c_custkey", v.alias("v")).select("c_custkey", *[milli(F.col(f"v.{x}"), x) for x in ("mix", "original", "gap")])


def speed_gates(spark, d):
    c = X.cues(spark, d).select("media_id", "id", ((F.col("id") % 50) / 10.0).alias("speed"))
    return c.select("media_id", "id", *[milli(T.clamped_speed(F.col("speed"), p), p) for p in ("supertonic", "elevenlabs", "openai")])


def source_language(spark, d):
    i = F.col("n_nationkey")
    n = X.table(spark, d, "nation").select(i, pick(i, None, "German", "auto-detect", "AUTO-DETECT").cast("string").alias("explicit"), pick(F.floor(i / 4), "en-US", "fr", "", None).cast("string").alias("info"))
    return n.select("n_nationkey", T.source_language(catalogs.language_code(F.col("explicit")), F.col("explicit"), F.col("info")).alias("code"))


def subtitle_choice(spark, d):
    i = F.col("n_nationkey")
    n = X.table(spark, d, "nation").select(i, pick(i, "vtt, TXT,vtt", "", None, "srt,doc", " ,").cast("string").alias("asked"), (i % 2 == 0).alias("burn"))
    f = T.subtitle_formats(F.col("asked"), F.col("burn"))
    return n.select("n_nationkey", F.array_join(f, "|").alias("formats"), F.array_join(T.unknown_formats(f), "|").alias("unknown"))


def client_ip(spark, d):
    i = F.col("user_id")
    e = X.table(spark, d, "events").select("event_id", F.when(i % 3 == 0, F.concat(F.lit(" 10.0.0."), i % 7, F.lit(" , 1.1.1.1"))).when(i % 3 == 1, " ").alias("forwarded"), F.when(i % 2 == 0, F.concat(F.lit("10.1.0."), i % 5)).alias("peer"))
    return e.select("event_id", T.client_ip(F.col("forwarded"), F.col("peer")).alias("ip"))


def rate_limits(spark, d):
    i = F.col("event_id")
    e = X.table(spark, d, "events").select("event_id", F.when(i % 5 == 0, 429).when(i % 5 == 1, 500).alias("status"), pick(i, None, "Error 429", "RATE_LIMIT hit", "Rate limit!", "timeout", "rate-limit").cast("string").alias("message"))
    return e.select("event_id", T.is_rate_limit(F.col("status"), F.col("message")).alias("limited"))


def flaky(texts: list[str]) -> list[str]:
    """The offline translator that refuses batches over five texts, texts with a question mark among others, and miscounts now and then."""
    if len(texts) > 5 or (len(texts) > 1 and any("?" in t for t in texts)):
        raise ValueError("too much")
    return [t.upper() for t in texts] + (["extra"] if len(texts) == 4 else [])


def no_wait(seconds: float) -> None:
    """Offline providers need no pause between attempts."""


def translated(spark, d):
    return providers.translate(X.cues(spark, d), flaky, batch=16, retries=2, sleep=no_wait)


def speaker_voices(spark, d):
    voices = spark.createDataFrame([("user", "onyx")], "speaker string, voice string")
    s = providers.synthesize(X.cues(spark, d), voices, "nova")
    return s.select("media_id", "id", "voice", "tts_ms", long("characters", "characters"))


def spoken_length(tagged: str, voice: str) -> int:
    """The offline voice: ten milliseconds a character of what it is sent."""
    return 10 * len(tagged) + len(voice)


def spoken(spark, d):
    voices = spark.createDataFrame([("user", "onyx")], "speaker string, voice string")
    return providers.speak(X.cues(spark, d), spoken_length, "nova", voices, speed=F.when(F.col("id") % 3 == 0, F.lit("0.95")), emotion=F.when(F.col("id") % 2 == 0, F.lit("calm"))).drop("error")


def heard(path: str) -> list[dict]:
    """The offline recogniser: each chunk says its name three times, the first time before its start."""
    return [{"start_ms": a, "end_ms": a + 1500, "text": f"{path} {a}"} for a in (0, 1000, 59_500)]


def recognised_chunks(spark, d):
    chunks = S.audio_chunks(X.media(X.cues(spark, d)), 60_000, 1000).withColumn("path", F.format_string("chunk_%04d", F.col("chunk")))
    return providers.recognise_chunks(chunks, heard, sleep=no_wait).select("media_id", "id", "start_ms", "end_ms", "text")


def punctuate(text: str) -> str | None:
    """The offline punctuator: a full stop after every fifth word; it fails on some texts, says nothing on some, and goes on too long on others."""
    words = text.split(" ")
    kind = len(words[0]) % 5
    if kind == 1:
        raise OSError
    if kind == 2:
        return " "
    if kind == 3:
        return " ".join(words + words)
    return " ".join(w.replace(".", "").replace("!", "").replace("?", "") + ("." if i % 5 == 4 else "") for i, w in enumerate(words))


def punctuated(spark, d):
    w = S.chunk_words(X.words(spark, d), 12, 2000)
    return providers.restore_punctuation(w, punctuate)


def gap_sessions(spark, d):
    w = X.words(spark, d).select("media_id", F.timestamp_millis("start_ms").alias("ts"))
    return live.gap_sessions(w).select("media_id", F.unix_millis("start").alias("start_ms"), F.unix_millis("end").alias("end_ms"), "n")


def chat_messages(spark, d):
    c = X.cues(spark, d)
    probes = X.media(c).select("media_id", F.floor(F.col("total_ms") / 2).alias("t_ms"))
    asked = probes.select("media_id", "t_ms", F.concat(F.lit("What is at "), "t_ms", F.lit("?")).alias("question"))
    out = context.chat_messages(probes, c, X.media(c), asked, X.table(spark, d, "conversations"), "Answer.", "At {current_time} from {window_start} to {window_end}, {num_frames} frames:\n{transcript_block}\n{question}")
    return providers.answered(out, len_of).select("media_id", "t_ms", F.md5("prompt").alias("prompt_md5"), "answer")


def len_of(prompt: str) -> str:
    """The offline model with eyes."""
    return f"{prompt.count('role')} messages"


def joined_sets(spark, d):
    """Union, intersection and difference of two sets of media, as Spark has them."""
    c = X.media(X.cues(spark, d)).select("media_id")
    two, three = c.where("media_id % 2 = 0"), c.where("media_id % 3 = 0")
    mark = lambda df, op: df.withColumn("op", F.lit(op))
    return mark(two.union(three), "union all").unionByName(mark(two.intersect(three), "intersect")).unionByName(mark(two.exceptAll(three), "except"))


def _stats_store(spark, d) -> StatsStore:
    """Jobs stored as queued, then every second as it ended, compacted, then every third."""
    j = X.job_stats(spark, d).drop("owner", "provider")
    path = f"{shared_dir(spark)}/stats-{uuid.uuid4().hex}"
    drop_at_exit(spark, path)
    store = StatsStore(spark, path, j.schema, days=365)
    zero = {m: F.lit(0).cast(j.schema[m].dataType) for m in jobs.MEASURES}
    store.append(j.withColumns({"status": F.lit("queued"), **zero}))
    store.append(j.where("id % 2 = 0"))
    store.compact()
    store.append(j.where("id % 3 = 0"))
    return store


def _clients(spark, d):
    """Four stages a job; some name a provider by an older name, a local one, or one that doesn't speak."""
    o, i = orders(spark, d), F.col("k") + F.col("at")
    s = o.select("k", F.posexplode(F.array(*map(F.lit, ("transcription", "translation", "chat", "tts")))).alias("at", "stage"))
    s = s.select("k", "stage", pick(i, "Together", "openai", "cartesia", "faster-whisper", None, "elevenlabs", "ollama").cast("string").alias("provider"), F.concat(F.lit("m"), i % 3).alias("model"), F.when(i % 5 == 0, "mine").alias("own_key"))
    return config.clients(s, ENVIRONMENT, BASE_URLS)


def stage_clients(spark, d):
    return _clients(spark, d).select("k", "stage", "provider", "model", "key_name", "key", "base_url", "extra", "refused")


def job_keys(spark, d):
    return config.keys_of(_clients(spark, d), "k")


def job_devices(spark, d):
    i = F.col("k")
    device, compute = config.device_columns(F.col("asked"), F.col("asked_type"))
    return orders(spark, d).select("k", pick(i, "auto", "cpu", "cuda", None).cast("string").alias("asked"), pick(F.floor(i / 4), "auto", "float32", None).cast("string").alias("asked_type")).select("k", device.alias("device"), compute.alias("compute"))


def voice_catalogs(spark, d):
    """The catalog that each nation's customers are shown, by provider and language."""
    i = F.col("n_nationkey")
    asked = X.table(spark, d, "nation").select(pick(i, "openai", "elevenlabs", "together", "supertonic").alias("provider"), pick(F.floor(i / 2), "en", "fr", "ar", "xx").alias("target"))
    return catalogs.voice_catalogs(catalogs.voices(spark), asked)


def stats_store_rows(spark, d):
    return _stats_store(spark, d).read().select("id", "created_at", "status", "target_language", "audio_seconds")


def stats_store_summary(spark, d):
    return _stats_store(spark, d).summary(NOW, 1000)


def stats_store_by_language(spark, d):
    return _stats_store(spark, d).by_language(NOW, 1000)


def sqlite_jobs(spark, d):
    """Orders written as SQLite files and read back under conditions that the files answer."""
    path = f"{shared_dir(spark)}/sqlite-{uuid.uuid4().hex}"
    drop_at_exit(spark, path)
    sqlite.write_sqlite(orders(spark, d).select(F.col("k").cast("string").alias("id"), "k", "status", F.col("t").alias("created_at")), path, "jobs")
    return sqlite.read_sqlite(spark, path, "jobs", where=[("status", "=", "done"), ("created_at", ">=", NOW - 2000 * 86400)]).select("id", "k", "created_at")


def job_settings(spark, d):
    """Each job's configuration: the base, and what the job's order overrides."""
    o, i = orders(spark, d), F.col("k")
    given = F.array(
        F.struct(F.lit("models.translation.model").alias("key"), F.concat(F.lit("m"), i % 3).alias("value")),
        F.when(i % 2 == 0, F.struct(F.lit("output.fps").alias("key"), F.lit(None).cast("string").alias("value"))),
        F.when(i % 5 == 0, F.struct(F.lit("models.tts").alias("key"), F.lit("plain").alias("value"))),
    )
    overrides = o.select("k", F.explode(F.filter(given, lambda x: x.isNotNull())).alias("x")).select("k", "x.*")
    return config.merged_settings(o, BASE, overrides, "k")


def language_list(spark, d):
    """The languages of the nations, as a list by code."""
    n = X.table(spark, d, "nation").select(F.initcap(F.lower("n_name")).alias("name"), catalogs.language_code(F.col("n_name")).alias("code"))
    return readers.languages_by_code(n)


def style_list(spark, d):
    """A style for each market segment, as they are listed."""
    c = X.table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    table = c.select("name", F.concat(F.lit("For "), F.lower("name")).alias("description"), F.lit("").alias("directives"), F.lit(None).cast("double").alias("temperature"), (F.col("n") % 4 / 4).alias("speed"), F.when(F.col("n") % 2 == 0, "calm").alias("emotion"))
    return readers.style_list(table).withColumn("tts_speed", F.floor(F.col("tts_speed") * 100).cast("long"))


NAMES = (
    "checkpoint_scan progress_scan latest_progress job_meta_scan stored_segments usage_scan usage_append media_probe extract_plan source_captions "
    "prompt_fill corrections_prompt style_lookup native_voices_for voice_lookup voice_defaults voice_match uploaded_inputs subtitle_bodies "
    "checkpoint_round_trip progress_round_trip job_record segments_round_trip timings cost_summary usage_counters job_rows jobs_after_delete job_history orphan_files dispatch readiness mix_cache "
    "concat_plan mux_plan pad_plan voiceover_volumes speed_gates source_language subtitle_choice client_ip rate_limits translated speaker_voices spoken recognised_chunks punctuated gap_sessions "
    "chat_messages joined_sets stats_store_rows stats_store_summary stats_store_by_language "
    "stage_clients job_keys job_devices voice_catalogs sqlite_jobs job_settings language_list style_list"
).split()


def queries() -> dict:
    return {n: globals()[n] for n in NAMES}
