"""Driver queries against their SQL, providers, streaming and configuration."""

import duckdb
import pytest
from pyspark.sql import functions as F

from cueloom.functions import catalogs, providers
from cueloom.operators import jobs
from cueloom.plans import fixtures, pipeline, queries, sql
from cueloom.sources import readers
from cueloom.streaming import live

TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()
SQL = sql.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = queries.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    mine = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)
    r = duck.execute(SQL[name])
    at = [[x[0] for x in r.description].index(c) for c in cols]
    assert mine == sorted((tuple(row[i] for i in at) for row in r.fetchall()), key=str)


def test_every_query_has_its_sql():
    assert set(queries.queries()) == set(SQL)


def test_each_timing_branch_occurs(spark, sf_dir):
    from cueloom.operators.timeline import timed

    c = fixtures.cues(spark, sf_dir)
    t = timed(c, fixtures.tts(c))
    row = t.agg(*[F.max(x.cast("int")) for x in (F.col("speed") == 0.5, F.col("speed") == 2.5, F.col("speed").between(0.6, 2.4), F.col("atempo") == 1.3, F.col("atempo").between(1.01, 1.29), F.col("freeze") > 0, F.col("gap_us") > 0)]).first()
    assert all(row)


def test_batches_are_halved():
    calls = []

    def call(texts):
        calls.append(len(texts))
        if len(texts) > 2 or "bad" in texts:
            raise ValueError
        return [t.upper() for t in texts]

    assert providers.halving(call, lambda t: f"<{t}>", ["a", "bad", "c", "d", "e"]) == ["A", "<bad>", "C", "D", "E"]
    assert calls[0] == 5


def test_translation_resets_speakers(spark):
    s = spark.createDataFrame([(1, i, 0, 1, f"t{i}", "B") for i in range(130)], "media_id long, id long, start_ms long, end_ms long, text string, speaker string")
    got = providers.translate(s).orderBy("id").collect()
    assert [r.text for r in got] == [f"T{i}" for i in range(130)] and {r.speaker for r in got} == {"SPEAKER_00"}


def test_resume_equals_the_whole_run(spark, sf_dir, tmp_path):
    c = fixtures.cues(spark, sf_dir).where("media_id < 3")
    media = fixtures.media(c)
    whole = pipeline.localise(c.limit(0), c, media)
    saved = pipeline.localise(c.limit(0), c, media, pipeline.Options(checkpoint=str(tmp_path / "cp")))
    key = lambda df: sorted(tuple(r) for r in df.select("media_id", "id", "start_us", "end_us", "text").collect())
    assert key(whole.aligned) == key(saved.aligned)
    assert whole.subtitles.where("body rlike '-->'").count() == media.count()


def test_costs_and_quota(spark):
    used = spark.createDataFrame([("together", 60, 1000000, 1000000, 1000000), ("unlisted", 60, 0, 0, 0)], "provider string, audio_seconds long, llm_input_tokens long, llm_output_tokens long, tts_characters long")
    got = {r.provider: r.total_usd for r in jobs.cost_breakdown(used, catalogs.prices(spark)).collect()}
    assert abs(got["together"] - (0.0015 + 1.5 + 65)) < 1e-9 and abs(got["unlisted"] - 0.0015) < 1e-9
    q = jobs.usage_quota(spark.createDataFrame([("a", 3), ("b", None)], "ip string, used long"), 2).orderBy("ip").collect()
    assert [(r.has_trial, r.remaining) for r in q] == [(False, 0), (True, 2)]
    empty = fixtures_free_jobs(spark)
    row = jobs.stats_summary(empty, 0).first()
    assert (row.jobs, row.done, row.audio_seconds) == (0, None, 0)


def fixtures_free_jobs(spark):
    return spark.createDataFrame([], "created_at long, status string, target_language string, segments_count long, audio_seconds long, tts_characters long, llm_input_tokens long, llm_output_tokens long")


def test_job_logs(spark):
    lines = spark.createDataFrame([("j", '{"step":1,"total":9,"message":"a"}'), ("j", ""), ("j", '{"step":'), ("j", '{"x":1}'), ("j", '{"step":2,"total":9,"message":"b"}')], "job_id string, value string")
    assert [(r.step, r.message) for r in live.latest_progress(readers.progress_lines(lines)).collect()] == [(2, "b")]
    e = spark.createDataFrame([("a", 1, "queued"), ("a", 2, "cancelled"), ("a", 3, "running"), ("b", 1, "queued"), ("b", 2, "running")], "job_id string, seq long, status string")
    assert {r.job_id: r.status for r in jobs.settled_status(e).collect()} == {"a": "cancelled", "b": "running"}


def test_gap_sessions_stream(spark, tmp_path):
    ts = "timestamp'2024-01-01 00:00:{}'"
    rows = spark.sql("SELECT 1L AS media_id, " + ts.format("00") + " AS ts UNION ALL SELECT 1L, " + ts.format("02") + " UNION ALL SELECT 1L, " + ts.format("05"))
    rows.write.parquet(str(tmp_path / "in"))
    assert sorted(r.n for r in live.gap_sessions(rows).collect()) == [1, 2]
    stream = live.gap_sessions(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("gaps").outputMode("complete").start()
    try:
        q.processAllAvailable()
        assert sorted(r.n for r in spark.table("gaps").collect()) == [1, 2]
    finally:
        q.stop()


def test_catalogs(spark):
    table = catalogs.voices(spark)
    answer = '<think>hm</think>```json\n["Nova", "onyx", "nova", "nobody", "echo", "fable"]\n```'
    got = catalogs.voice_candidates(spark.createDataFrame([(1, answer), (2, "none")], "answer_id long, answer string"), table).orderBy("rank").collect()
    assert [r.name for r in got] == ["nova", "onyx", "echo"]
    objects = 'Take these: [{"name": "echo"}, {"voice": " ONYX", "explanation": "deep"}, {"voice": "nova"}] or not'
    one = '{"voice": "alloy"}'
    found = catalogs.voice_candidates(spark.createDataFrame([(1, objects), (2, one), (3, "[1, null]"), (4, None)], "answer_id long, answer string"), table)
    assert sorted(tuple(r) for r in found.collect()) == [(1, 1, "onyx", "deep"), (1, 2, "nova", ""), (2, 1, "alloy", "")]
    text = {r.provider: r.catalog for r in catalogs.voice_catalog(table, "fr").collect()}
    assert text["together"].startswith("== Voices for target language (fr) ==\n  - french narrator man\n  - french narrator lady\n\n== ar ==\n") and text["together"].index("== de ==") < text["together"].index("== en ==")
    assert "  - Lior — male, french accent\n" in text["elevenlabs"]
    more = catalogs.described(table, spark.createDataFrame([("elevenlabs", "fr", "Lior", "Soft")], "provider string, lang string, name string, text string"))
    assert "  - Lior — male, french accent — Soft\n" in {r.provider: r.catalog for r in catalogs.voice_catalog(more, "fr").collect()}["elevenlabs"]
    styles = readers.styles(spark, {"standard": {"description": "d"}, "kids": {"tts": {"emotion": "excited"}}})
    assert [r.name for r in styles.collect()] == ["kids", "standard"]
    with pytest.raises(Exception, match="kids, standard"):
        readers.style_of(spark.createDataFrame([("x",)], "style string"), styles).collect()
    assert readers.deep_merge({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}, "d": 4}) == {"a": {"b": 3, "c": 2}, "d": 4}


def test_punctuation_and_recognition(spark):
    w = spark.createDataFrame([(1, 0, i, t, i * 1000, i * 1000 + 1000) for i, t in enumerate("a few years".split())], "media_id long, chunk long, seq long, text string, start_ms long, end_ms long")

    def fail(text):
        raise OSError

    assert [(r.start_ms, r.end_ms, r.text) for r in providers.restore_punctuation(w, lambda t: "A few years.").collect()] == [(0, 3000, "A few years.")]
    for silent in (fail, lambda text: " ", lambda text: "", lambda text: None):
        assert [(r.start_ms, r.end_ms, r.text) for r in providers.restore_punctuation(w, silent).collect()] == [(0, 3000, "a few years")]
    heard = providers.recognise(spark.createDataFrame([(1, "x.wav")], "media_id long, path string"), lambda p: [{"start_ms": 0, "end_ms": 900, "text": p}])
    assert [tuple(r) for r in heard.collect()] == [(1, 0, 0, 900, "x.wav", None)]


def test_attempts_and_their_pauses():
    waits, calls = [], []

    def third(x):
        calls.append(x)
        if len(calls) < 3:
            raise OSError("429")
        return x

    assert providers.attempted(third, "a", waits=providers.RECOGNITION_WAITS, sleep=waits.append) == "a" and waits == [5, 15]
    waits.clear()
    with pytest.raises(ValueError):
        providers.attempted(lambda: int("x"), sleep=waits.append)
    assert waits == [2.0, 4.0]
    waits.clear()
    assert providers.attempted(lambda: ["one"], accept=providers.batch_of(2), attempts=4, waits=(5, 15), sleep=waits.append) is None and waits == [5, 15, 15]
    assert not providers.batch_of(1)("x") and not providers.batch_of(1)([1]) and not providers.batch_of(1)(None) and providers.batch_of(2)(["a", "b"])


def test_speech_after_a_rate_limit(spark, tmp_path):
    s = spark.createDataFrame([(1, i, f"text {i}", "A" if i % 2 else "B") for i in range(12)], "media_id long, id long, text string, speaker string")

    def call(tagged, voice):
        from pathlib import Path

        seen = Path(tmp_path, tagged.split()[-1])
        if not seen.exists():
            seen.touch()
            raise RuntimeError("Rate limit reached")
        return len(tagged)

    got = providers.speak(s, call, "nova", spark.createDataFrame([("A", "onyx")], "speaker string, voice string"), workers=2, sleep=lambda seconds: None).orderBy("id").collect()
    assert [(r.id, r.voice, r.file, r.tts_ms, r.characters) for r in got] == [(i, "onyx" if i % 2 else "nova", f"1/seg_{i:05d}.wav", len(f"text {i}"), len(f"text {i}")) for i in range(12)]

    def broken(tagged, voice):
        raise RuntimeError("no such voice")

    rows = providers.speak(s, broken, "nova", sleep=lambda seconds: None)
    assert {(r.file, r.tts_ms, r.error) for r in providers.unspoken(rows).collect()} == {(None, None, "no such voice")}

    def busy(tagged, voice):
        Path(tmp_path, "calls").open("a").write("x")
        raise RuntimeError("429")

    from pathlib import Path

    rows = providers.speak(s.where("id = 0"), busy, "nova", retries=3, sleep=lambda seconds: None).collect()
    assert [(r.id, r.error) for r in rows] == [(0, "429")] and len(Path(tmp_path, "calls").read_text()) == 4  # no task is repeated for it


def test_answers_are_asked_for_once(spark, sf_dir, tmp_path):
    """However often the answers are read, each track and each chunk is one call."""
    from pathlib import Path

    from cueloom.plans import service_queries

    def counted(name, call):
        def run(x):
            with Path(tmp_path, name).open("a") as f:
                f.write("x\n")
            return call(x)

        return run

    info = queries.track_info(spark, sf_dir)
    found = providers.fetch_source_captions(info, counted("tracks", service_queries.caption_body))
    both = readers.manual_captions(found).join(found.select("media_id", "kind"), "media_id")
    assert both.count() == found.count() > 0 and {r.kind for r in both.collect()} <= {"manual", "auto"}
    assert len(Path(tmp_path, "tracks").read_text().split()) == readers.select_track(info).count()

    chunks = spark.createDataFrame([(m, k, 60_000 * k, f"{m}-{k}") for m in range(3) for k in range(4)], "media_id long, chunk long, offset_ms long, path string").repartition(2)
    heard = providers.recognise_chunks(chunks, counted("chunks", service_queries.heard), sleep=lambda seconds: None)
    assert heard.count() > 0 and heard.agg(F.max("end_ms")).first()[0] > 0
    assert len(Path(tmp_path, "chunks").read_text().split()) == 12


def test_answers_and_voice_match(spark):
    asked = spark.createDataFrame([(1, "a"), (2, "b")], "n long, prompt string")
    assert {r.n: r.answer for r in providers.answered(asked, lambda p: p * 2, accept=lambda a: a != "bb").collect()} == {1: "aa", 2: None}
    assert providers.audio_path("a.wav") == "a.wav" and providers.audio_path(("n", "b.wav")) == "b.wav"
    with open(__file__) as f:
        assert providers.audio_path(f) == __file__ and providers.audio_path(("x", f)) == __file__
    assert providers.is_rate_limit(RuntimeError("HTTP 429")) and not providers.is_rate_limit(RuntimeError("HTTP 500"))


def test_a_sqlite_table_is_read_in_ranges(spark, tmp_path):
    import sqlite3

    from cueloom.sources.sqlite import read_sqlite

    con = sqlite3.connect(tmp_path / "jobs.db")
    con.execute('CREATE TABLE jobs (id TEXT PRIMARY KEY, created_at INTEGER, audio_seconds REAL, "odd name" TEXT)')
    con.executemany("INSERT INTO jobs VALUES (?, ?, ?, ?)", [(f"j{i}", i, i / 2, None if i % 2 else "x") for i in range(100)])
    con.execute("CREATE TABLE no_jobs (id INTEGER)")
    con.commit()
    con.close()
    rows = read_sqlite(spark, str(tmp_path / "jobs.db"), "jobs", 3)
    assert rows.schema.simpleString() == "struct<id:string,created_at:bigint,audio_seconds:double,odd name:string>"
    assert sorted(tuple(r) for r in rows.collect()) == sorted((f"j{i}", i, i / 2, None if i % 2 else "x") for i in range(100))
    assert rows.rdd.getNumPartitions() == 3 and read_sqlite(spark, str(tmp_path / "jobs.db"), "no_jobs").count() == 0
    with pytest.raises(Exception, match="no table"):
        read_sqlite(spark, str(tmp_path / "jobs.db"), "absent").count()


def test_shared_folder_of_a_cluster(spark, monkeypatch):
    from cueloom import storage

    assert storage.shared_dir(spark)

    class Cluster:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "yarn"

            class _jsc:
                sc = staticmethod(lambda: type("sc", (), {"getCheckpointDir": staticmethod(lambda: type("none", (), {"isDefined": staticmethod(lambda: False)}))}))

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_dir(Cluster)
    kept = storage.written(spark.range(3), "three")
    path = storage.tables_written()[-1]
    assert kept.count() == 3
    storage.release(spark, [path])
    assert path not in storage.tables_written()


def test_providers_are_asked_once(spark, sf_dir, tmp_path):
    """What a translator says is written before it is used: asking it again would give other texts."""
    c = fixtures.cues(spark, sf_dir).where("media_id < 3")

    def counting(texts):
        import uuid
        from pathlib import Path

        for _ in texts:
            Path(tmp_path, uuid.uuid4().hex).touch()
        return [t.upper() for t in texts]

    out = pipeline.localise(c.limit(0), c, fixtures.media(c), translator=counting)
    out.aligned.count(), out.plan.count(), out.subtitles.count()
    assert len(list(tmp_path.iterdir())) == out.transcribed.count()


def test_config_and_readiness(spark, tmp_path):
    from cueloom.functions import config

    cfg = {"models": {"transcription": {"provider": "faster_whisper"}, "translation": "a-model", "tts": {"provider": "elevenlabs", "model": "v3"}}}
    assert config.required_keys(cfg) == ["ELEVENLABS_API_KEY", "TOGETHER_API_KEY"]
    assert config.missing_keys(cfg, {"TOGETHER_API_KEY": "x"}) == ["ELEVENLABS_API_KEY"]
    with pytest.raises(ValueError, match="edge"):
        config.speech_provider("edge")
    with pytest.raises(ValueError, match="ELEVENLABS_API_KEY"):
        config.client_settings(cfg, "tts", {})
    assert config.client_settings(cfg, "transcription", {})["key"] is None
    (tmp_path / "a.yaml").write_text("x: {y: 1, z: 2}\nprompt: ' Say {what} '\n")
    (tmp_path / "b.yaml").write_text("x: {y: 3}\n")
    assert config.read_yaml(str(tmp_path / "a.yaml"), str(tmp_path / "b.yaml"))["x"] == {"y": 3, "z": 2} and config.read_prompt(str(tmp_path / "a.yaml"), "prompt") == "Say {what}"
    known = spark.createDataFrame([("a", "done"), ("b", "running")], "id string, status string")
    got = jobs.readiness(spark.createDataFrame([("a",), ("b",), ("c",)], "job_id string"), known)
    assert {r.job_id: r.code for r in got.collect()} == {"a": 200, "b": 409, "c": 404}
    steps = spark.createDataFrame([(1, 0, "asr", 2.0), (1, 1, "tts", 3.0)], "run long, pos int, step string, elapsed double")
    costs = spark.createDataFrame([(1, 0.5)], "run long, total_usd double")
    assert jobs.timings_json(steps, costs).first().body == '{"total":5.0,"steps":[{"name":"asr","elapsed":2.0},{"name":"tts","elapsed":3.0}],"cost":0.5}'


def test_voice_lookup(spark):
    table = catalogs.voices(spark)
    probe = spark.createDataFrame([("elevenlabs", "Daniel"), ("elevenlabs", "mine"), ("openai", "nova")], "provider string, voice string")
    got = {r.voice: r.voice_id for r in catalogs.voice_of(probe, table).collect()}
    assert got["mine"] == "mine" and got["nova"] == "nova"
    # The catalog lists English before German, whatever the order of their codes.
    first = {n: table.where(f"provider = 'elevenlabs' and lang = '{lang}' and name = '{n}'").first().voice_id for n, lang in (("Daniel", "en"), ("Peter", "nl"))}
    assert got["Daniel"] == first["Daniel"] and first["Peter"] == catalogs.voice_of(spark.createDataFrame([("elevenlabs", "Peter")], "provider string, voice string"), table).first().voice_id
    native = {(r.provider, r.lang): (r.male, r.female) for r in catalogs.native_voices(table).collect()}
    assert native["openai", "en"] == ("onyx", "nova") and native["supertonic", "en"] == ("M1", "F1") and native["together", "tr"] == ("turkish narrator man", "turkish calm man")


def test_settled_status_stream(spark, tmp_path):
    e = spark.createDataFrame([("a", 1, "queued"), ("a", 2, "cancelled"), ("a", 3, "running"), ("b", 1, "queued"), ("b", 2, "running")], "job_id string, seq long, status string")
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = live.settled_status(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("settled").outputMode("update").start()
    try:
        q.processAllAvailable()
        assert {r.job_id: r.status for r in spark.table("settled").collect()} == {"a": "cancelled", "b": "running"}
    finally:
        q.stop()


def test_sources_and_rows(spark, tmp_path):
    bodies = spark.createDataFrame([('{"id":"a","status":"done","created_at":5}',), ("{",), ('{"x":1}',), (None,)], "body string")
    assert [tuple(r) for r in readers.job_meta(bodies).collect()] == [("a", "done", 5, None)]
    for f in ("j1/input.mp4", "j1/input.wav", "j2/other.mp4"):
        (tmp_path / f).parent.mkdir(exist_ok=True)
        (tmp_path / f).write_bytes(b"abc")
    files = readers.media_files(spark, str(tmp_path))
    assert files.count() == 3 and [(r.job_id, r.path.endswith("input.mp4")) for r in readers.uploaded_inputs(files).collect()] == [("j1", True)]

    def call(url):
        if url == "bad":
            raise OSError
        return url.upper()

    media = spark.createDataFrame([(1, "u"), (2, "bad")], "media_id long, url string")
    assert [tuple(r) for r in providers.fetch_captions(media, call).collect()] == [(1, "U")]
    runs = spark.createDataFrame([("a", "done", 10, 25, {"voice": "nova"}, 9, 1, 2, 3, 4, None), ("b", "cancelled", 1, 2, {}, 0, 0, 0, 0, 0, None)], "id string, status string, started_at long, finished_at long, params map<string,string>, audio_seconds long, segments_count long, tts_characters long, llm_input_tokens long, llm_output_tokens long, error string")
    costs = spark.createDataFrame([("a", 1.0, 2.0, 3.0, 6.0)], "id string, whisper_usd double, translation_usd double, tts_usd double, total_usd double")
    row = jobs.job_rows(runs, costs).collect()
    assert len(row) == 1 and (row[0].created_at, row[0].duration_seconds, row[0].voice, row[0].total_cost_usd, row[0].style) == (10, 15.0, "nova", 6.0, None)
    v = catalogs.native_voices_for(spark.createDataFrame([("together", "xx"), ("together", "fr")], "provider string, lang string"), catalogs.voices(spark))
    assert {r.lang: r.male for r in v.collect()} == {"xx": "tutorial man", "fr": "french narrator man"}
    d = spark.createDataFrame([(None, "male", "F3"), ("mine", "male", "Q"), (None, "x", "M2")], "e string, g string, l string")
    assert [tuple(r) for r in d.select(catalogs.default_voice(F.col("e"), F.col("g"), F.lit("m"), F.lit("f")).alias("v"), catalogs.local_voice(F.col("l")).alias("l")).collect()] == [("m", "F3"), ("mine", "M1"), ("f", "M2")]
