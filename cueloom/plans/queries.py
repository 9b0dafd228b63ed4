"""Driver queries: each applies operators of the engine to whole tables derived from the test data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import catalogs
from ..functions import text as T
from ..operators import context, jobs
from ..operators import segments as S
from ..operators import timeline as TL
from ..sources import readers, writers
from . import fixtures as X

#: The clock of the roll-ups, 1998-08-02 00:00 UTC, and how far back they look.
NOW, DAYS = 902016000, 3650


def stats_summary(spark, d):
    return jobs.stats_summary(X.job_stats(spark, d), NOW, DAYS)


def stats_by_language(spark, d):
    return jobs.stats_by_language(X.job_stats(spark, d), NOW, DAYS)


def recent_jobs(spark, d):
    return jobs.recent_jobs(X.job_stats(spark, d).select("id", "created_at", "status", "target_language"))


def queue_position(spark, d):
    j = X.table(spark, d, "orders").select(F.col("o_custkey").alias("queue"), F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "running").otherwise("queued").alias("status"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("created_at"))
    return jobs.queue_position(j)


def usage_quota(spark, d):
    return jobs.usage_quota(jobs.usage(X.table(spark, d, "events"), "user_id"), 100)


def cost_breakdown(spark, d):
    c = jobs.cost_breakdown(X.job_stats(spark, d), catalogs.prices(spark))
    nano = lambda x: F.floor(F.col(x) * 1e6 + 0.5).cast("long").alias(x.replace("_usd", "_musd"))
    return c.select("id", "provider", nano("whisper_usd"), nano("translation_usd"), nano("tts_usd"), nano("total_usd"))


def step_share(spark, d):
    e = X.table(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_type").alias("step"), F.floor(F.col("value") * 100 + 0.5).cast("long").alias("v"))
    steps = e.groupBy("run", "step").agg(F.sum("v").alias("v")).select("run", "step", (F.col("v") / 100.0).alias("elapsed"))
    return jobs.step_share(steps).select("run", "step", F.floor(F.col("share") * 1000 + 0.5).cast("long").alias("share_milli"), "m", "s")


def ttl_sweep(spark, d):
    j = X.job_stats(spark, d).select("id", "status", F.col("created_at").alias("touched_at"))
    return jobs.ttl_sweep(j, NOW, 24 * 365)


def stats_upsert_latest(spark, d):
    e = X.table(spark, d, "events").select("user_id", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"))
    return jobs.latest(e, "user_id", "ts_us", "event_id")


def settled_status(spark, d):
    e = X.table(spark, d, "events").select((F.col("user_id")).alias("job_id"), F.col("event_id").alias("seq"), F.element_at(F.array(*map(F.lit, ("queued", "running", "running", "running", "done", "failed", "cancelled"))), (F.col("event_id") * 7919 % 7 + 1).cast("int")).alias("status"))
    return jobs.settled_status(e)


def gap_detect(spark, d):
    c = X.cues(spark, d)
    return TL.gaps(c, X.media(c))


def retime(spark, d):
    c = X.cues(spark, d)
    return TL.retime(c, X.tts(c)).select("media_id", "id", "start_us", "end_us", "speaker")


def audio_plan(spark, d):
    c = X.cues(spark, d)
    p = TL.command_plan(TL.audio_plan(c, X.tts(c), X.media(c), mix=0.35))
    micro = lambda x: F.floor(F.col(x) * 1e6 + 0.5).cast("long").alias(x)
    return p.select("media_id", "track", F.col("ord").cast("long").alias("ord"), "kind", "id", "start_us", "end_us", "duration_us", micro("speed"), micro("atempo"), "coarse_us", "read_us")


def srt_cues(spark, d):
    return writers.srt_bodies(X.cues(spark, d)).select("media_id", F.md5("body").alias("body_md5"), F.length("body").cast("long").alias("n"))


def srt_round_trip(spark, d):
    return readers.srt_cues(writers.srt_bodies(X.cues(spark, d)))


def rescale(spark, d):
    c = X.cues(spark, d)
    return TL.rescale(c, X.media(c).withColumn("total_ms", F.when(F.col("media_id") % 2 == 0, F.floor(F.col("total_ms") * 9 / 10)).otherwise(F.col("total_ms")))).select("media_id", "id", "start_us", "end_us")


def word_ends(spark, d):
    return S.word_ends(X.event_words(spark, d), 300).select("media_id", "seq", "start_ms", "end_ms")


def chunk_words(spark, d):
    w = X.words(spark, d)
    return S.chunk_words(w, 120, 2000).groupBy("media_id", "chunk").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))


def rolling_dedup(spark, d):
    return S.rolling_dedup(X.event_words(spark, d), 4 * 3600 * 1000).select("media_id", "seq", "text")


def overlap_dedup(spark, d):
    return S.dedup_overlap(X.cues_overlapped(spark, d)).select("media_id", "id", "start_ms", "end_ms")


def sentences_from_words(spark, d):
    return S.sentences_from_words(X.words(spark, d))


def merge_continuous(spark, d):
    return S.merge_continuous(X.cues(spark, d)).select("media_id", "id", "start_ms", "end_ms", "text", "speaker")


def sentence_split(spark, d):
    docs = X.table(spark, d, "documents").select("doc_id", F.posexplode(T.sentence_parts(F.col("text"))).alias("k", "part"))
    return docs.select("doc_id", F.col("k").cast("long").alias("k"), "part")


def split_segments(spark, d):
    return S.split_sentences(S.merge_continuous(X.cues(spark, d))).select("media_id", "id", "start_ms", "end_ms", "text")


def soft_split(spark, d):
    return S.split_sentences(X.cues(spark, d), 20).select("media_id", "id", "start_ms", "end_ms", "text")


def valid_segments(spark, d):
    return S.valid_segments(X.asr_segments(X.cues(spark, d))).select("media_id", "id")


def valid_word_range(spark, d):
    c = X.asr_segments(X.cues(spark, d))
    return S.words_in_valid(X.words(spark, d), S.valid_segments(c)).select("media_id", "seq")


def redact(spark, d):
    key = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit(" sk-"), F.repeat(F.lit("aB3"), 7))).when(F.col("doc_id") % 4 == 1, F.concat(F.lit(" sk_"), F.repeat(F.lit("x_9"), 8))).when(F.col("doc_id") % 4 == 2, F.concat(F.lit(" "), F.repeat(F.lit("0aF"), 16))).otherwise(F.concat(F.lit(" "), F.repeat(F.lit("a"), 47)))
    return X.table(spark, d, "documents").select("doc_id", F.md5(T.redact(F.concat("text", key, F.lit(" end")))).alias("text_md5"))


def _probes(c):
    return X.media(c).select("media_id", F.explode(F.array(F.lit(0).cast("long"), F.floor(F.col("total_ms") / 4), F.floor(F.col("total_ms") / 2), F.col("total_ms"))).alias("t_ms"))


def context_window(spark, d):
    c = X.cues(spark, d)
    return context.context_window(_probes(c), c)


def frame_times(spark, d):
    c = X.cues(spark, d)
    return context.frame_times(context.context_window(_probes(c), c), X.media(c))


def chat_history(spark, d):
    return context.chat_history(X.table(spark, d, "conversations").withColumn("role", F.when(F.col("turn") % 5 == 4, "system").otherwise(F.col("role")))).select("conv_id", "turn", "role", "text")


def track_info(spark, d) -> DataFrame:
    """(media_id, src, subtitles, automatic): every kind of choice among caption tracks occurs."""
    m = X.table(spark, d, "conversations").select(F.col("conv_id").alias("media_id")).distinct()
    i = F.col("media_id")
    body = F.when(i % 5 == 0, '{"en-US":[{"ext":"vtt","url":"v"},{"ext":"json3","url":"m-us"}],"de":[{"ext":"json3","url":"m-de"}]}').when(i % 5 == 1, '{"en":[{"ext":"json3","url":"m-en"}]}').when(i % 5 == 2, '{"vi":[{"ext":"json3","url":"m-vi"}]}').otherwise("{}")
    auto = F.when(i % 2 == 0, '{"en":[{"ext":"json3","url":"a-en"}],"aa-en":[{"ext":"json3","url":"a-aa"}]}').otherwise('{"fr":[{"ext":"json3","url":"a-fr"}]}')
    return m.select("media_id", F.when(i % 3 > 0, "en").alias("src"), F.from_json(body, readers.TRACKS).alias("subtitles"), F.from_json(auto, readers.TRACKS).alias("automatic"))


def track_select(spark, d):
    return readers.select_track(track_info(spark, d))


def caption_parse(spark, d):
    return readers.manual_captions(X.captions_json(spark, d)).select("media_id", "id", "start_ms", "end_ms", "text")


def auto_caption_words(spark, d):
    return S.word_ends(S.rolling_dedup(readers.auto_caption_words(X.captions_json(spark, d))))


def captions_or_asr(spark, d):
    c = X.cues(spark, d)
    return readers.captions_or_asr(c.where(F.col("media_id") % 2 == 0).withColumn("source", F.lit("captions")), c.withColumn("source", F.lit("asr"))).groupBy("media_id", "source").agg(F.count(F.lit(1)).alias("n"))


def align(spark, d):
    """Texts of some chunks are refused: with a dash after every other word, with none at all, or blank; dashes in others are few."""
    w = S.chunk_words(X.words(spark, d), 120, 2000)
    k = F.col("media_id") + F.col("chunk")
    every = F.when(k % 4 == 0, 2).when(k % 4 == 1, 16).otherwise(1000)
    token = F.when(F.col("seq") % every == 1, F.concat("text", F.lit(" —"))).otherwise(F.col("text"))
    t = w.withColumn("token", token).groupBy("media_id", "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "token"))), lambda x: x["token"]), " ").alias("text"))
    return S.align(w, t.withColumn("text", F.when(k % 4 == 3, "  ").otherwise(F.col("text"))).where(k % 8 != 2))


def speech_tags(spark, d):
    c = X.cues(spark, d)
    i = F.col("id")
    return c.select("media_id", "id", T.ssml(F.col("text"), F.when(i % 3 == 0, F.lit("0.95")), F.when(i % 2 == 0, F.lit("calm"))).alias("ssml"), T.tail_silence_ms(F.col("text")).cast("long").alias("tail_ms"), T.ends_sentence(F.col("text")).alias("ends"), T.is_fragment(F.col("text")).alias("fragment"))


def breath_tags(spark, d):
    return X.table(spark, d, "conversations").select("conv_id", "turn", T.breath_tag(F.col("text")).alias("tagged"))


def batches(spark, d):
    return S.batches(X.cues(spark, d)).select("media_id", F.col("batch").cast("long").alias("batch"), "n", F.md5("prompt").alias("prompt_md5"))


def lang_code(spark, d):
    n = X.table(spark, d, "nation").select("n_nationkey", F.element_at(F.array(*map(F.lit, ("English", "GERMAN", "klingon", "zh"))), (F.col("n_nationkey") % 4 + 1).cast("int")).alias("name"))
    return n.select("n_nationkey", "name", catalogs.language_code(F.col("name")).alias("code"), T.local_tts_code(F.col("name")).alias("local_code"))


def audio_chunks(spark, d):
    return S.audio_chunks(X.media(X.cues(spark, d)), 120000, 1000)


def missing_files(spark, d):
    c = X.cues(spark, d).select("media_id", "id")
    have = c.where(F.col("id") % 10 > 0).select("media_id", F.format_string("seg_%05d.wav", F.col("id")).alias("name"))
    return jobs.missing_files(c, have)


def upload_gate(spark, d):
    p = X.table(spark, d, "pages").select("page_id", F.concat(F.col("url"), F.element_at(F.array(*map(F.lit, (".mp4", ".txt", ".WAV"))), (F.col("page_id") % 3 + 1).cast("int"))).alias("name"), F.length("html").alias("n"))
    return p.select("page_id", jobs.upload_refusal(F.col("name"), F.col("n") * 1000, F.col("page_id") % 500, 2, 300).alias("refused"))


def tempo_chain(spark, d):
    c = X.cues(spark, d)
    s = TL.sized(c, X.tts(c)).select("media_id", "id", T.tempo_chain(F.col("tts_ms") / (F.col("end_ms") - F.col("start_ms"))).alias("f"))
    product = F.aggregate("f", F.lit(1.0), lambda a, x: a * x)
    return s.select("media_id", "id", F.size("f").cast("long").alias("n"), F.floor(product * 1e6 + 0.5).cast("long").alias("product"), F.forall("f", lambda x: (x >= 0.5) & (x <= 2.0)).alias("within"))


def localise(spark, d):
    from .pipeline import localise as run

    c = X.cues(spark, d)
    captions = c.where("media_id % 2 = 0").withColumn("text", F.concat("text", F.lit(" so")))
    out = run(captions, c, X.media(c))
    return out.aligned.select("media_id", "id", "start_us", "end_us", "text")


NAMES = (
    "stats_summary stats_by_language recent_jobs queue_position usage_quota cost_breakdown step_share ttl_sweep stats_upsert_latest settled_status gap_detect retime audio_plan srt_cues "
    "srt_round_trip rescale word_ends chunk_words rolling_dedup overlap_dedup sentences_from_words merge_continuous sentence_split split_segments soft_split valid_segments valid_word_range "
    "redact context_window frame_times chat_history track_select caption_parse auto_caption_words captions_or_asr align speech_tags breath_tags batches lang_code audio_chunks "
    "missing_files upload_gate tempo_chain localise"
).split()


def queries() -> dict:
    from . import service_queries

    return {n: globals()[n] for n in NAMES} | service_queries.queries()


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retime(spark, sf_dir)
