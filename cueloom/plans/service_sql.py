"""DuckDB SQL for the queries of service_queries, written from the definitions."""

from __future__ import annotations

from ..functions.catalogs import LANGUAGES, voice_rows
from .queries import NOW
from .service_queries import STYLES
from .sql import CUES, ENDS, JOBS, SIMPLE_END, TRACKS, TTS, WORDS


def literal(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, (int, float)) else "'" + str(x).replace("'", "''") + "'"


def values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + ")"


ORDERS = """o AS (SELECT o_orderkey AS k, o_custkey AS c, CAST(epoch(o_orderdate) AS BIGINT) AS t, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'failed' ELSE 'queued' END AS status FROM orders)"""
VOICES = "v AS (SELECT * FROM " + values(voice_rows()) + " t(provider, lang, lang_pos, pos, name, voice_id, gender, accent, description))"
NATIVE = VOICES + """, nat AS (SELECT provider, lang, coalesce(arg_min(name, pos) FILTER (gender = 'male'), arg_min(name, pos)) AS male,
  coalesce(arg_min(name, pos) FILTER (gender = 'female'), arg_max(name, pos) FILTER (pos <= 1)) AS female FROM v GROUP BY 1, 2)"""
STEPS = """s AS (SELECT user_id AS run, event_type AS step, sum(CAST(floor(value) AS BIGINT))::DOUBLE AS elapsed FROM events GROUP BY 1, 2)"""
MILLI = "CAST(floor({0} * 1000::DOUBLE + 0.5::DOUBLE) AS BIGINT)"
TAIL = "CASE WHEN " + SIMPLE_END.format(t="text") + " THEN 250 ELSE 120 END"


#: Four stages a job with their clients.
CLIENTS = ORDERS + """, g AS (SELECT k, unnest(['transcription', 'translation', 'chat', 'tts']) AS stage, unnest([0, 1, 2, 3]) + k AS i FROM o),
b AS (SELECT k, stage, i, ['together', 'openai', 'together', 'faster-whisper', 'together', 'elevenlabs', 'ollama'][i % 7 + 1] AS provider FROM g),
n AS (SELECT *, CASE provider WHEN 'together' THEN 'TOGETHER_API_KEY' WHEN 'openai' THEN 'OPENAI_API_KEY' WHEN 'elevenlabs' THEN 'ELEVENLABS_API_KEY' WHEN 'ollama' THEN 'OLLAMA_API_KEY' END AS key_name FROM b),
c AS (SELECT k, stage, provider, 'm' || i % 3 AS model, key_name, CASE WHEN i % 5 = 0 THEN 'mine' WHEN provider = 'together' THEN 'k1' END AS key, CASE WHEN provider = 'together' THEN 'https://host.invalid/v1' END AS base_url,
  provider = 'together' AS extra, CASE WHEN stage = 'tts' AND provider IN ('faster-whisper', 'ollama') THEN 'provider' WHEN key_name IS NOT NULL AND i % 5 <> 0 AND provider <> 'together' THEN key_name END AS refused FROM n)"""
MEASURES = "segments_count audio_seconds tts_characters llm_input_tokens llm_output_tokens".split()
SUMS = ", ".join(f"CAST(coalesce(sum({m}), 0) AS BIGINT) AS {m}" for m in MEASURES)
#: The table after its appends: jobs with an id divisible by 2 or 3 have their rows, others are queued.
STORED = JOBS + ", st AS (SELECT id, created_at, target_language, CASE WHEN id % 2 = 0 OR id % 3 = 0 THEN status ELSE 'queued' END AS status, " + ", ".join(f"CASE WHEN id % 2 = 0 OR id % 3 = 0 THEN {m} ELSE 0 END AS {m}" for m in MEASURES) + " FROM job_stats)"


def oracle_sql() -> dict[str, str]:
    w = lambda ctes, rest: f"WITH {ctes} {rest}"
    out = {
        "checkpoint_scan": w(CUES, "SELECT media_id, CASE WHEN media_id % 3 > 0 THEN 'translated' ELSE 'transcribed' END AS stage, id, start_ms, end_ms, text, CASE WHEN id % 5 > 0 THEN speaker ELSE 'SPEAKER_00' END AS speaker FROM cues"),
        "progress_scan": "SELECT user_id AS job_id, event_id % 9 AS step, CAST(9 AS BIGINT) AS total, event_type AS message FROM events WHERE event_id % 5 > 2",
        "latest_progress": "SELECT user_id AS job_id, max(event_id) AS step, CAST(9 AS BIGINT) AS total, arg_max(event_type, event_id) AS message FROM events GROUP BY 1",
        "job_meta_scan": w(ORDERS, "SELECT k::VARCHAR AS id, status, t AS created_at, CASE WHEN status = 'failed' THEN 'it broke' END AS error FROM o WHERE k % 7 > 1"),
        "stored_segments": w(CUES, "SELECT media_id, CASE WHEN media_id % 4 IN (0, 3) THEN 0 ELSE count(*) END AS n, CASE WHEN media_id % 4 IN (0, 3) THEN '' ELSE string_agg(text, '|' ORDER BY id) END AS texts FROM cues GROUP BY 1"),
        "usage_scan": "SELECT user_id::VARCHAR AS ip, count(*) AS n FROM events WHERE (user_id % 10) % 4 <> 3 GROUP BY 1",
        "usage_append": "SELECT user_id::VARCHAR AS ip, count(*) AS n FROM events GROUP BY 1",
        "media_probe": w(CUES, "SELECT media_id, CASE media_id % 3 WHEN 0 THEN CAST(total_ms // 10 * 10 AS BIGINT) WHEN 1 THEN total_ms END AS length_ms, CAST(CASE WHEN media_id % 3 <> 2 AND media_id % 2 = 0 THEN 29970 ELSE 30000 END AS BIGINT) AS milli_fps FROM media"),
        "extract_plan": w(CUES, "SELECT media_id, '/in/video.' || media_id || '.mp4' AS source, 'video.' || media_id || '_audio.wav' AS target, 'pcm_s16le' AS codec, CAST(16000 AS BIGINT) AS rate, CAST(1 AS BIGINT) AS channels FROM media"),
        "source_captions": w(TRACKS, "SELECT media_id, string_split(t, ',')[1] AS kind, string_split(t, ',')[3] AS text, CAST(900 AS BIGINT) AS end_ms FROM t WHERE t IS NOT NULL AND string_split(t, ',')[3] <> 'm-de'"),
        "corrections_prompt": """SELECT n_regionkey, 'Known recognition errors:' || string_agg(chr(10) || '- ''' || lower(n_name) || ''' means ''' || n_name || '''', '' ORDER BY lower(n_name)) AS block FROM nation GROUP BY 1""",
        "uploaded_inputs": w(ORDERS, "SELECT k::VARCHAR AS job_id, '/jobs/' || k || '/input.mp4' AS path FROM o"),
        "stage_clients": w(CLIENTS, "SELECT k, stage, provider, model, key_name, key, base_url, extra, refused FROM c"),
        "job_keys": w(CLIENTS, "SELECT k, coalesce(string_agg(DISTINCT key_name, ',' ORDER BY key_name), '') AS required, coalesce(string_agg(DISTINCT key_name, ',' ORDER BY key_name) FILTER (WHERE key IS NULL), '') AS missing FROM c GROUP BY 1"),
        "job_devices": w(ORDERS, """, x AS (SELECT k, ['auto', 'cpu', 'cuda', NULL][k % 4 + 1] AS a, ['auto', 'float32', NULL][k // 4 % 3 + 1] AS b FROM o), y AS (SELECT k, CASE WHEN a = 'cuda' THEN a ELSE 'cpu' END AS device, b FROM x)
            SELECT k, device, CASE WHEN b = 'float32' THEN b WHEN device = 'cpu' THEN 'int8' ELSE 'float16' END AS compute FROM y"""),
        "voice_catalogs": w(VOICES, """, a AS (SELECT DISTINCT ['openai', 'elevenlabs', 'together', 'supertonic'][n_nationkey % 4 + 1] AS provider, ['en', 'fr', 'ar', 'xx'][n_nationkey // 2 % 4 + 1] AS target FROM nation),
            l AS (SELECT provider, lang, string_agg('  - ' || name || CASE WHEN coalesce(description, '') IN ('', name) THEN '' ELSE ' — ' || description END, chr(10) ORDER BY pos) AS lines FROM v GROUP BY 1, 2),
            b AS (SELECT provider, lang, target, CASE WHEN lang = target THEN '== Voices for target language (' || lang || ') ==' WHEN lang = 'multi' THEN '== All voices (multilingual) ==' ELSE '== ' || lang || ' ==' END || chr(10) || lines || CASE WHEN lang = target THEN chr(10) ELSE '' END AS block FROM l JOIN a USING (provider))
            SELECT provider, target, string_agg(block, chr(10) ORDER BY lang <> target, lang) AS catalog FROM b GROUP BY 1, 2"""),
        "job_settings": w(ORDERS, """, b(key, value) AS (VALUES ('models.translation.provider', 'together'), ('models.translation.model', 'm1'), ('models.tts.provider', 'elevenlabs'), ('models.tts.model', 'v3'), ('models.chat', 'm2'), ('tts.workers', '8'))
            SELECT k, key, value FROM o, b WHERE key <> 'models.translation.model' AND NOT (k % 5 = 0 AND starts_with(key, 'models.tts.')) UNION ALL SELECT k, 'models.translation.model', 'm' || k % 3 FROM o
            UNION ALL SELECT k, 'output.fps', NULL FROM o WHERE k % 2 = 0 UNION ALL SELECT k, 'models.tts', 'plain' FROM o WHERE k % 5 = 0"""),
        "language_list": f"SELECT array_to_string(list_transform(string_split(lower(n_name), ' '), lambda x: upper(x[1]) || x[2:]), ' ') AS name, coalesce(code, left(lower(n_name), 2)) AS code FROM nation LEFT JOIN {values(LANGUAGES.items())} t(lang, code) ON lang = lower(n_name)",
        "style_list": "SELECT c_mktsegment AS name, 'For ' || lower(c_mktsegment) AS description, CAST(floor(count(*) % 4 / 4.0::DOUBLE * 100) AS BIGINT) AS tts_speed, CASE WHEN count(*) % 2 = 0 THEN 'calm' END AS tts_emotion FROM customer GROUP BY 1",
        "sqlite_jobs": w(ORDERS, f"SELECT k::VARCHAR AS id, k, t AS created_at FROM o WHERE status = 'done' AND t >= {NOW - 2000 * 86400}"),
        "stats_store_rows": w(STORED, "SELECT id, created_at, status, target_language, audio_seconds FROM st"),
        "stats_store_summary": w(STORED, f"SELECT count(*) AS jobs, CAST(sum(CASE WHEN status = 'done' THEN 1 ELSE 0 END) AS BIGINT) AS done, CAST(sum(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) AS BIGINT) AS failed, {SUMS} FROM st WHERE created_at >= {NOW - 1000 * 86400}"),
        "stats_store_by_language": w(STORED, f"SELECT target_language, count(*) AS n, CAST(coalesce(sum(audio_seconds), 0) AS BIGINT) AS audio_seconds FROM st WHERE created_at >= {NOW - 1000 * 86400} AND target_language IS NOT NULL GROUP BY 1"),
        "prompt_fill": "SELECT n_nationkey, 'Say ' || n_name || ' in ' || r_name || '; {kept} {unknown}' AS prompt FROM nation JOIN region ON n_regionkey = r_regionkey",
        "style_lookup": """SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN 'kids' ELSE 'standard' END AS style, CASE WHEN conv_id % 2 = 0 THEN 'For children' ELSE 'Plain' END AS description, CASE WHEN conv_id % 2 = 0 THEN 'Be simple' ELSE '' END AS directives,
            CASE WHEN conv_id % 2 = 0 THEN CAST(500 AS BIGINT) END AS temperature, CASE WHEN conv_id % 2 = 0 THEN CAST(1250 AS BIGINT) END AS speed, CASE WHEN conv_id % 2 = 0 THEN 'excited' END AS emotion FROM conversations""",
        "native_voices_for": w(NATIVE, """, n AS (SELECT n_nationkey, ['openai', 'elevenlabs', 'together'][n_nationkey % 3 + 1] AS provider, ['en', 'fr', 'xx', 'sv'][n_nationkey % 4 + 1] AS lang FROM nation)
            SELECT n_nationkey, n.provider, n.lang, coalesce(a.male, e.male) AS male, coalesce(a.female, e.female) AS female FROM n LEFT JOIN nat a ON a.provider = n.provider AND a.lang = n.lang LEFT JOIN nat e ON e.provider = n.provider AND e.lang = 'en'"""),
        "voice_lookup": w(VOICES, """, p AS (SELECT c_custkey, ['elevenlabs', 'openai', 'together'][c_custkey % 3 + 1] AS provider, ['Daniel', 'Peter', 'nova', 'Olivia', 'dutch man', 'mine'][c_custkey // 3 % 6 + 1] AS voice FROM customer)
            SELECT c_custkey, provider, voice, coalesce((SELECT voice_id FROM v WHERE v.provider = p.provider AND v.name = p.voice ORDER BY lang_pos, pos LIMIT 1), voice) AS voice_id FROM p"""),
        "voice_defaults": """SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'own' || c_custkey WHEN c_custkey % 3 = 0 THEN 'onyx' ELSE 'nova' END AS voice, CASE WHEN c_custkey % 3 = 0 THEN 'M3' ELSE 'M1' END AS local_style FROM customer""",
        "voice_match": """SELECT c_custkey AS answer_id, CAST(rank AS BIGINT) AS rank, name, explanation FROM customer, (VALUES (0, 1, 'nova', ''), (0, 2, 'onyx', ''), (0, 3, 'echo', ''), (1, 1, 'echo', 'calm'), (3, 1, 'M1', ''), (3, 2, 'alloy', 'x')) a(k, rank, name, explanation) WHERE c_custkey % 4 = k""",
        "subtitle_bodies": w(CUES, r"""SELECT media_id, 'txt' AS format, md5(string_agg(text || chr(10), '' ORDER BY id)) AS body_md5 FROM cues GROUP BY 1 UNION ALL
            SELECT media_id, 'vtt', md5('WEBVTT' || chr(10) || chr(10) || string_agg(printf('%02d:%02d:%02d.%03d', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60, start_ms % 1000) || ' --> ' || printf('%02d:%02d:%02d.%03d', end_ms // 3600000, end_ms // 60000 % 60, end_ms // 1000 % 60, end_ms % 1000) || chr(10) || text || chr(10), chr(10) ORDER BY id)) FROM cues GROUP BY 1"""),
        "checkpoint_round_trip": w(CUES, "SELECT media_id, id, start_ms, end_ms, text, speaker, 'transcribed' AS stage FROM cues"),
        "progress_round_trip": "SELECT user_id::VARCHAR AS job_id, event_id AS step, CAST(9 AS BIGINT) AS total, event_type AS message FROM events",
        "job_record": w(ORDERS, f"""SELECT k::VARCHAR AS id, CASE WHEN k % 3 = 0 THEN 'failed' ELSE 'running' END AS status, CAST({NOW} AS BIGINT) AS created_at, CASE WHEN k % 12 = 0 THEN 'late' WHEN k % 2 = 0 THEN 'key ***' END AS error FROM o"""),
        "segments_round_trip": w(CUES, "SELECT media_id, id, start_ms, end_ms, text, speaker FROM cues"),
        "timings": w(STEPS, f"SELECT run, {MILLI.format('sum(elapsed)')} AS total, string_agg(step || '=' || elapsed::BIGINT, ',' ORDER BY step || '=' || elapsed::BIGINT) AS steps, CASE WHEN run % 2 = 0 THEN {MILLI.format('(run * 0.5::DOUBLE)')} END AS cost FROM s GROUP BY run"),
        "cost_summary": w(STEPS, r""", u AS (SELECT *, sum(elapsed) OVER (PARTITION BY run) AS total FROM s), x AS (SELECT *, CAST(floor(CASE WHEN total > 0 THEN elapsed / total * 100 ELSE 0 END * 10 + 0.5) AS BIGINT) AS tenth FROM u),
            c AS (SELECT run, total, 'x' AS g, rpad(step, 30, ' ') || ' ' || floor(elapsed / 60)::BIGINT || 'm' || lpad((elapsed % 60)::BIGINT || '.0', 4, '0') || 's  (' || lpad((tenth // 10) || '.' || (tenth % 10), 4, ' ') || '%)' AS line, step, n FROM x JOIN (SELECT user_id AS run, count(*) AS n FROM events GROUP BY 1) USING (run))
            SELECT run, string_agg(line, chr(10) ORDER BY step) || chr(10) || rpad('Total wall time', 30, ' ') || ' ' || floor(any_value(total) / 60)::BIGINT || 'm' || lpad((any_value(total) % 60)::BIGINT || '.0', 4, '0') || 's' || chr(10) ||
              rpad('Transcription', 22, ' ') || ' ' || lpad((any_value(n) * 5 // 10)::BIGINT || '.' || any_value(n) * 5 % 10, 7, ' ') || ' min          $  0.2500' || chr(10) ||
              rpad('Translation (' || ['together', 'openai'][run % 2 + 1] || ')', 22, ' ') || ' ' || lpad(format('{:,}', any_value(n) * 1234), 7, ' ') || ' in / ' || lpad(format('{:,}', any_value(n) * 567), 7, ' ') || ' out  $  0.5000  (' || any_value(n) || ' calls)' || chr(10) ||
              rpad('TTS', 22, ' ') || ' ' || lpad(format('{:,}', any_value(n) * 89), 7, ' ') || ' chars        $  1.0000  (' || any_value(n) * 2 || ' calls)' || chr(10) || rpad('TOTAL API COST', 43, ' ') || '$  1.7500' AS body FROM c GROUP BY run"""),
        "usage_counters": """SELECT conv_id AS run, count(*) FILTER (role = 'user') AS llm_calls, CAST(coalesce(sum(length(text)) FILTER (role = 'user'), 0) AS BIGINT) AS llm_input_tokens, CAST(coalesce(sum(CASE WHEN turn % 2 = 0 THEN turn ELSE 0 END) FILTER (role = 'user'), 0) AS BIGINT) AS llm_output_tokens,
            count(*) FILTER (role <> 'user') AS tts_calls, CAST(coalesce(sum(length(text)) FILTER (role <> 'user'), 0) AS BIGINT) AS tts_characters FROM conversations GROUP BY 1""",
        "job_rows": w(ORDERS, """SELECT k::VARCHAR AS id, t AS created_at, t + k % 100 AS finished_at, status, 'l' || (c % 5) AS target_language, NULL::VARCHAR AS source_language, 'nova' AS voice, k AS segments_count, CAST(CASE WHEN k % 2 = 0 THEN 1000 ELSE 0 END AS BIGINT) AS total_milli, k % 100 * 1000 AS duration_ms
            FROM o WHERE k % 5 > 0 AND status <> 'queued'"""),
        "jobs_after_delete": w(JOBS, f"SELECT id, status, created_at AS touched_at FROM job_stats WHERE created_at > {NOW - 24 * 365 * 3600} OR status NOT IN ('done', 'failed')"),
        "job_history": w(JOBS, "SELECT id, created_at, status FROM job_stats ORDER BY created_at DESC, id LIMIT 100"),
        "orphan_files": w(ORDERS, f"SELECT '/tmp/' || k AS path, t AS modified_at FROM o WHERE t < {NOW - 86400 * 365}"),
        "dispatch": w(ORDERS, ", n AS (SELECT k AS id, row_number() OVER (ORDER BY t, k) - 1 AS n FROM o WHERE status = 'queued') SELECT id, n % 2 AS worker, n // 2 AS turn FROM n"),
        "readiness": w(ORDERS, "SELECT (a.k + 1)::VARCHAR AS job_id, CAST(CASE WHEN b.k IS NULL THEN 404 WHEN b.status <> 'done' THEN 409 ELSE 200 END AS BIGINT) AS code FROM o a LEFT JOIN o b ON b.k = a.k + 1"),
        "mix_cache": w(ORDERS, "SELECT k AS job_id, k % 4 > 0 AND k % 3 < 2 AS reuse FROM o"),
        "concat_plan": w(TTS, r""", r AS (SELECT media_id, id, track, k FROM timed, (VALUES ('main', 0), ('main', 1), ('original', 0), ('original', 1), ('original', 2)) v(track, k) WHERE k = 1 OR (k = 0 AND gap_us > 0) OR (k = 2 AND frozen > 0)
            UNION ALL SELECT media_id, NULL, track, 3 FROM media, (VALUES ('main'), ('original')) v(track)), n AS (SELECT *, row_number() OVER (PARTITION BY media_id, track ORDER BY id NULLS LAST, k) - 1 AS ord FROM r)
            SELECT media_id, track, count(*) AS n, md5(string_agg('file ''' || track || '_' || printf('%05d', ord) || CASE track WHEN 'main' THEN '.ts' ELSE '.wav' END || '''', chr(10) ORDER BY ord)) AS list_md5 FROM n GROUP BY 1, 2"""),
        "mux_plan": w(CUES, """SELECT media_id, s.* FROM media, (VALUES (CAST(0 AS BIGINT), 'concat', NULL::VARCHAR, 'copy', NULL::VARCHAR, NULL::BIGINT), (1, 'video_only.ts', 'video_audio.wav', 'copy', 'aac', 44100)) s(step, video, audio, video_codec, audio_codec, rate)"""),
        "pad_plan": w(CUES, f"SELECT media_id, id, printf('seg_%05d.wav', id) AS file, CAST({TAIL} AS BIGINT) AS pad_ms, CAST(44100 AS BIGINT) AS rate FROM cues"),
        "voiceover_volumes": f"""WITH c AS (SELECT c_custkey, c_custkey % 3 AS m, CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 8 / 8.0::DOUBLE ELSE 0.35::DOUBLE END AS v FROM customer)
            SELECT c_custkey, {MILLI.format("(CASE WHEN m = 1 THEN v ELSE 0 END)")} AS mix, CAST(CASE WHEN m = 2 THEN 1000 ELSE 0 END AS BIGINT) AS original, {MILLI.format("(CASE WHEN m = 0 THEN 1 ELSE least(1, 2 * v) END)")} AS gap FROM c""",
        "speed_gates": w(CUES, f""", s AS (SELECT media_id, id, id % 50 / 10.0::DOUBLE AS speed FROM cues) SELECT media_id, id, {MILLI.format("greatest(0.7::DOUBLE, least(2.0::DOUBLE, speed))")} AS supertonic, CASE WHEN speed >= 0.7::DOUBLE AND speed <= 1.2::DOUBLE THEN {MILLI.format("speed")} END AS elevenlabs,
            CASE WHEN speed >= 0.25::DOUBLE AND speed <= 4.0::DOUBLE THEN {MILLI.format("speed")} END AS openai FROM s"""),
        "source_language": """SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 1 THEN 'de' ELSE [ 'en', 'fr', NULL, NULL][n_nationkey // 4 % 4 + 1] END AS code FROM nation""",
        "subtitle_choice": """SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN CASE WHEN n_nationkey % 2 = 0 THEN 'srt|vtt|txt' ELSE 'vtt|txt' END WHEN 3 THEN 'srt|doc' ELSE 'srt' END AS formats, CASE WHEN n_nationkey % 5 = 3 THEN 'doc' ELSE '' END AS unknown FROM nation""",
        "client_ip": """SELECT event_id, CASE WHEN user_id % 3 = 0 THEN '10.0.0.' || (user_id % 7) WHEN user_id % 2 = 0 THEN '10.1.0.' || (user_id % 5) ELSE 'unknown' END AS ip FROM events""",
        "rate_limits": "SELECT event_id, event_id % 5 = 0 OR event_id % 6 IN (1, 2, 3) AS limited FROM events",
        "translated": w(CUES, "SELECT media_id, id, start_ms, end_ms, upper(replace(text, 'ß', 'ss')) AS text, 'SPEAKER_00' AS speaker FROM cues"),
        "speaker_voices": w(CUES, f"SELECT media_id, id, CASE WHEN speaker = 'user' THEN 'onyx' ELSE 'nova' END AS voice, CAST(60 * length(text) + {TAIL} AS BIGINT) AS tts_ms, length(text) AS characters FROM cues"),
        "spoken": w(CUES, """SELECT media_id, id, CASE WHEN speaker = 'user' THEN 'onyx' ELSE 'nova' END AS voice, media_id || '/' || printf('seg_%05d.wav', id) AS file, CAST(4 + 10 * (length(text) + CASE WHEN id % 3 = 0 THEN length('<speed ratio="0.95"/> ') ELSE 0 END + CASE WHEN id % 2 = 0 THEN length('<emotion value="calm"/> ') ELSE 0 END) AS BIGINT) AS tts_ms, length(text) AS characters FROM cues"""),
        # Each chunk is heard from 0, 1 and 59.5 s for 1.5 s; a chunk's first lies half over the last of the chunk before, which is no more than half, and its second after it.
        "recognised_chunks": w(CUES, r""", ch AS (SELECT media_id, CAST(unnest(range(CASE WHEN total_ms <= 60000 THEN 1 ELSE (total_ms + 59999) // 60000 END)) AS BIGINT) AS chunk, total_ms <= 60000 AS one FROM media),
            h AS (SELECT media_id, chunk, one, a, chunk * 60000 + a AS start_ms, chunk * 60000 + a + 1500 AS end_ms, printf('chunk_%04d', chunk) || ' ' || a AS text, k FROM ch, (VALUES (0, 0), (1000, 1), (59500, 2)) v(a, k)),
            g AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY start_ms, chunk, k) - 1 AS n FROM h),
            kept AS (SELECT * FROM g WHERE one OR a = 1000 OR a = 59500 OR chunk = 0 OR (chunk > 0 AND a = 0 AND NOT 2 * 1000 > 1500)),
            fixed AS (SELECT * FROM kept)
            SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY n) - 1 AS id, start_ms, end_ms, text FROM fixed"""),
        "gap_sessions": w(WORDS, r""", a AS (SELECT media_id, start_ms, start_ms - lag(start_ms) OVER (PARTITION BY media_id ORDER BY start_ms) > 2000 AS far FROM words), b AS (SELECT media_id, start_ms, sum(CASE WHEN far THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY start_ms) AS s FROM a)
            SELECT media_id, min(start_ms) AS start_ms, max(start_ms) + 2000 AS end_ms, count(*) AS n FROM b GROUP BY media_id, s"""),
        "joined_sets": w(CUES, "SELECT media_id, 'union all' AS op FROM media WHERE media_id % 2 = 0 UNION ALL SELECT media_id, 'union all' FROM media WHERE media_id % 3 = 0 UNION ALL SELECT media_id, 'intersect' FROM media WHERE media_id % 6 = 0 UNION ALL SELECT media_id, 'except' FROM media WHERE media_id % 2 = 0 AND media_id % 3 > 0"),
    }
    words12 = WORDS + r""", s0 AS (SELECT *, sum(CASE WHEN start_ms - prev > 2000 THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY seq) AS session FROM (SELECT *, lag(end_ms) OVER (PARTITION BY media_id ORDER BY seq) AS prev FROM words)),
        s1 AS (SELECT *, (row_number() OVER (PARTITION BY media_id, session ORDER BY seq) - 1) // 12 AS part FROM s0), s2 AS (SELECT *, dense_rank() OVER (PARTITION BY media_id ORDER BY session, part) - 1 AS chunk FROM s1),
        g AS (SELECT media_id, chunk, length(arg_min(text, seq)) % 5 AS kind, count(*) AS n, min(start_ms) AS s, arg_max(end_ms, seq) AS e, string_agg(text, ' ' ORDER BY seq) AS raw FROM s2 GROUP BY 1, 2),
        t AS (SELECT s2.*, kind, row_number() OVER (PARTITION BY media_id, chunk ORDER BY seq) - 1 AS i FROM s2 JOIN g USING (media_id, chunk)),
        p AS (SELECT *, replace(replace(replace(text, '.', ''), '!', ''), '?', '') || CASE WHEN i % 5 = 4 THEN '.' ELSE '' END AS token FROM t),
        e AS (SELECT *, """ + ENDS.format(w="token") + r""" AS ends FROM p WHERE kind IN (0, 4)),
        q AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY media_id, chunk ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sentence FROM e),
        r AS (SELECT media_id, chunk, sentence, arg_min(start_ms, seq) AS start_ms, arg_max(end_ms, seq) AS end_ms, string_agg(token, ' ' ORDER BY seq) AS text FROM q GROUP BY 1, 2, 3
          UNION ALL SELECT media_id, chunk, 0, s, e, CASE WHEN kind = 3 THEN raw || ' ' || raw ELSE raw END FROM g WHERE kind IN (1, 2, 3))"""
    out["punctuated"] = w(words12, "SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY chunk, sentence) - 1 AS id, start_ms, end_ms, text FROM r")
    out["chat_messages"] = w(CUES, r""", p AS (SELECT media_id, total_ms, total_ms // 2 AS t_ms, greatest(0, total_ms // 2 - 30000) AS ws, total_ms // 2 + 30000 AS we FROM media),
        x AS (SELECT p.media_id, p.t_ms, any_value(total_ms) AS total_ms, least(any_value(ws), coalesce(arg_min(start_ms, id), any_value(ws))) AS a, greatest(any_value(we), coalesce(arg_max(end_ms, id), any_value(we))) AS b, coalesce(string_agg(text, '\n' ORDER BY id), '') AS lines
          FROM p LEFT JOIN cues c ON c.media_id = p.media_id AND c.end_ms >= ws AND c.start_ms <= we GROUP BY 1, 2),
        h AS (SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 8),
        past AS (SELECT conv_id, string_agg('{"role":"' || role || '","content":"' || replace(replace(replace(text, '\', '\\'), '"', '\"'), chr(10), '\n') || '"},', '' ORDER BY turn) AS past, count(*) AS n FROM h WHERE role IN ('user', 'assistant') GROUP BY 1)
        SELECT media_id, t_ms, md5('[{"role":"system","content":"Answer."},' || coalesce(past, '') || '{"role":"user","content":[{"type":"text","text":"At ' || printf('%d.%02d', t_ms // 1000, CAST(round(t_ms % 1000 / 10.0, 0) AS BIGINT)) || ' from ' || printf('%d.%02d', a // 1000, a % 1000 // 10) || ' to ' || printf('%d.%02d', b // 1000, b % 1000 // 10) || ', ' || least(6, (b - a) // 5000 + 1) || ' frames:\n' || replace(CASE WHEN lines = '' THEN '(no subtitle lines found in this window)' ELSE lines END, '"', '\"') || '\nWhat is at ' || t_ms || '?"}' || array_to_string(list_transform(list_transform(range(least(6, (b - a) // 5000 + 1)), lambda k: (least(greatest(a + 5000 * k, 0), greatest(0, total_ms - 100)) + 5) // 10), lambda f: ',{"type":"image_url","image_url":{"url":"' || media_id || '@' || printf('%d.%02d', f // 100, f % 100) || '"}}'), '') || ']}]') AS prompt_md5, (coalesce(n, 0) + 2) || ' messages' AS answer
        FROM x LEFT JOIN past ON conv_id = media_id""")
    return out
