"""DuckDB SQL for the driver queries, over the same tables. Written from the definitions, not from the Spark plans."""

from __future__ import annotations

from .queries import DAYS, NOW

#: Common table expressions of the derived tables (see fixtures.py).
WORDS = r"""
said AS (SELECT conv_id AS media_id, turn, role AS speaker, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM conversations),
split0 AS (SELECT media_id, turn, speaker, string_split_regex(t, '\s+') AS ws FROM said WHERE t <> ''),
tok AS (SELECT media_id, turn, speaker, CAST(unnest(range(len(ws))) AS BIGINT) AS pos, unnest(ws) AS text FROM split0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY turn, pos) - 1 AS seq, 60 * length(text) AS dur FROM tok),
gapped AS (SELECT *, CASE WHEN seq = 0 THEN 0 WHEN pos > 0 THEN 40 WHEN turn % 5 = 0 THEN 2600 ELSE 700 END AS gap FROM numbered),
ended AS (SELECT *, CAST(sum(gap + dur) OVER (PARTITION BY media_id ORDER BY seq) AS BIGINT) AS end_ms FROM gapped),
words AS (SELECT media_id, seq, turn, pos, text, speaker, end_ms - dur AS start_ms, end_ms FROM ended)"""
CUES = WORDS + r""",
parts AS (SELECT media_id, turn, pos // 8 AS part, min(start_ms) AS start_ms, max(end_ms) AS end_ms, string_agg(text, ' ' ORDER BY pos) AS text, min(speaker) AS speaker FROM words GROUP BY ALL),
cues AS (SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY turn, part) - 1 AS id, start_ms, end_ms, text, speaker FROM parts),
media AS (SELECT media_id, max(end_ms) + 1500 AS total_ms FROM cues GROUP BY 1)"""
TIMED = r"""t1 AS (SELECT c.*, (end_ms - start_ms) / 1000.0::DOUBLE AS orig, tts_ms / 1000.0::DOUBLE AS said_s, lag(end_ms, 1, 0) OVER (PARTITION BY media_id ORDER BY id) AS prev FROM {cues} c JOIN {tts} USING (media_id, id)),
t2 AS (SELECT *, CASE WHEN orig < 0.01 OR said_s < 0.01 THEN 1.0::DOUBLE ELSE greatest(0.5::DOUBLE, least(2.5::DOUBLE, orig / said_s)) END AS speed FROM t1),
t3 AS (SELECT *, orig / speed AS target FROM t2),
t4 AS (SELECT *, CASE WHEN said_s - target <= 0.2::DOUBLE THEN 1.0::DOUBLE ELSE least(said_s / (target + 0.2::DOUBLE), 1.3::DOUBLE) END AS atempo FROM t3),
t5 AS (SELECT *, greatest(0::DOUBLE, said_s / atempo - target) AS over_s FROM t4),
t6 AS (SELECT *, CASE WHEN over_s < 0.001 THEN 0::DOUBLE ELSE over_s END AS frozen FROM t5),
timed AS (SELECT *, CASE WHEN start_ms - prev > 50 THEN (start_ms - prev) * 1000 ELSE 0 END AS gap_us, CAST(floor((target + frozen) * 1e6::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS chunk_us FROM t6)"""
TTS = CUES + r""",
tts AS (SELECT media_id, id, CAST(floor((end_ms - start_ms) * [30, 80, 100, 150, 205, 230, 350][id % 7 + 1] / 100) AS BIGINT) AS tts_ms FROM cues),
""" + TIMED.replace("{cues}", "cues").replace("{tts}", "tts")
JOBS = r"""
used AS (SELECT l_orderkey, CAST(sum(l_quantity) AS BIGINT) AS q, count(*) AS k FROM lineitem GROUP BY 1),
job_stats AS (SELECT o_orderkey AS id, CAST(epoch(o_orderdate) AS BIGINT) AS created_at, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'failed' ELSE 'queued' END AS status,
  n_name AS target_language, ['together', 'openai', 'elevenlabs', 'unlisted'][o_orderkey % 4 + 1] AS provider, coalesce(k, 0) AS segments_count, coalesce(q, 0) AS audio_seconds,
  coalesce(q, 0) * 250 AS tts_characters, coalesce(q, 0) * 100 AS llm_input_tokens, coalesce(q, 0) * 60 AS llm_output_tokens
  FROM orders LEFT JOIN used ON o_orderkey = l_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey)"""
EVENT_WORDS = r"""
ew AS (SELECT user_id AS media_id, event_type AS text, epoch_us(ts) // 1000 AS start_ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) - 1 AS seq FROM events)"""
TRACKS = r"""m AS (SELECT DISTINCT conv_id AS media_id, conv_id % 5 AS k, conv_id % 3 > 0 AS known FROM conversations),
t AS (SELECT media_id, CASE WHEN known THEN CASE WHEN k = 1 THEN 'manual,en,m-en' WHEN k = 0 THEN 'manual,en-US,m-us' WHEN media_id % 2 = 0 THEN 'auto,en,a-en' END ELSE CASE k WHEN 0 THEN 'manual,de,m-de' WHEN 1 THEN 'manual,en,m-en' WHEN 2 THEN 'manual,vi,m-vi' END END AS t FROM m)"""
SINCE = f"created_at >= {NOW - DAYS * 86400}"
ENDS = r"""CASE WHEN regexp_matches(rtrim({w}), '[!?。！？]$') THEN true WHEN rtrim({w}) LIKE '%.' THEN list_extract(string_split_regex(lower(rtrim({w})), '\s+'), -1) NOT IN
 ('mr.','mrs.','ms.','dr.','prof.','sr.','jr.','st.','u.s.','u.s.a.','u.k.','e.u.','etc.','vs.','i.e.','e.g.','approx.','incl.','cf.','ca.','inc.','ltd.','corp.','co.','no.','vol.','fig.','eq.','ref.','ed.','p.m.','a.m.') ELSE false END"""
SIMPLE_END = r"regexp_matches({t}, '[.!?。！？]\s*$')"
FRAGMENT = r"regexp_matches(trim({t}), '^[a-z]|^[A-Z][\s一-鿿]')"
STRIPPED = r"""(CASE WHEN len(list_filter(range(2, least(length(rtrim({p}, '.!?。！？ ')), length(ltrim({f}))) + 1), lambda n: ends_with(lower(rtrim({p}, '.!?。！？ ')), lower(substring(ltrim({f}), 1, n))))) > 0
 AND trim(ltrim(substring(ltrim({f}), list_max(list_filter(range(2, least(length(rtrim({p}, '.!?。！？ ')), length(ltrim({f}))) + 1), lambda n: ends_with(lower(rtrim({p}, '.!?。！？ ')), lower(substring(ltrim({f}), 1, n))))) + 1), ' ,，;；')) <> ''
 THEN ltrim(substring(ltrim({f}), list_max(list_filter(range(2, least(length(rtrim({p}, '.!?。！？ ')), length(ltrim({f}))) + 1), lambda n: ends_with(lower(rtrim({p}, '.!?。！？ ')), lower(substring(ltrim({f}), 1, n))))) + 1), ' ,，;；') ELSE {f} END)"""


def merge_ctes(source: str, walk: str, merged: str, longest: int | None) -> str:
    """The fold over source (media_id, id, start_ms, end_ms, text, speaker) as a recursive CTE `walk`, and its result `merged`."""
    within = "true" if longest is None else f"c.end_ms - w.start_ms <= {longest}"
    return (
        f"""
{walk} AS (
  SELECT media_id, id, id AS first, start_ms, end_ms, text, speaker, false AS grown FROM {source} WHERE id = 0
  UNION ALL
  SELECT media_id, id, CASE WHEN grows THEN first ELSE id END, CASE WHEN grows THEN cs ELSE start_ms END, end_ms, CASE WHEN NOT grows THEN text WHEN trim(added) <> '' THEN trim(ct || ' ' || added) ELSE ct END, speaker, grows
  FROM (SELECT *, CASE WHEN frag THEN """
        + STRIPPED.format(p="ct", f="text")
        + """ ELSE text END AS added FROM (
    SELECT c.*, w.first, w.start_ms AS cs, w.text AS ct, """
        + FRAGMENT.format(t="c.text")
        + """ AS frag, c.speaker = w.speaker AND c.start_ms - w.end_ms <= 1000 AND (NOT """
        + SIMPLE_END.format(t="w.text")
        + " OR "
        + FRAGMENT.format(t="c.text")
        + f""") AND {within} AS grows
    FROM {walk} w JOIN {source} c ON c.media_id = w.media_id AND c.id = w.id + 1))),
{merged}_last AS (SELECT * FROM {walk} QUALIFY id = max(id) OVER (PARTITION BY media_id, first)),
{merged} AS (SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY first) - 1 AS id, start_ms, end_ms, text, speaker FROM {merged}_last)"""
    )


MERGE = CUES + "," + merge_ctes("cues", "walk", "merged", 60000)
#: Parts of a text; a period between word characters doesn't end one. RE2 has no look-around, so what follows a mark is matched.
SPLIT = r"""list_filter(list_transform(regexp_extract_all(regexp_replace(regexp_replace({t}, '([\p{{L}}\p{{N}}_])\.([\p{{L}}\p{{N}}_])', '\1' || chr(1) || '\2', 'g'), '([\p{{L}}\p{{N}}_])\.([\p{{L}}\p{{N}}_])', '\1' || chr(1) || '\2', 'g'),
 '[^.!?。！？]*(?:[.!?。！？]+[0-9][^.!?。！？]*)*[.!?。！？]+\s*|[^.!?。！？]+$'), lambda p: regexp_replace(replace(p, chr(1), '.'), '^\s+|\s+$', '', 'g')), lambda p: p <> '')"""


def timed_parts(source: str, name: str) -> str:
    """CTE `name`: the texts p of source (media_id, id, start_ms, end_ms, p) with the segment's time shared by characters."""
    return f"""{name}_n AS (SELECT *, list_sum(list_transform(p, lambda x: length(x))) AS n, unnest(range(1, len(p) + 1)) AS k FROM {source}),
            {name}_b AS (SELECT *, coalesce(list_sum(list_transform(p[1:k - 1], lambda x: length(x))), 0) AS before FROM {name}_n),
            {name} AS (SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY id, k) - 1 AS id, CAST(start_ms + (end_ms - start_ms) * before // n AS BIGINT) AS start_ms, CAST(CASE WHEN len(p) = 1 THEN end_ms ELSE start_ms + (end_ms - start_ms) * (before + length(p[k])) // n END AS BIGINT) AS end_ms, p[k] AS text FROM {name}_b)"""


def _recursive(ctes: str, rest: str) -> str:
    return f"WITH RECURSIVE {ctes} {rest}"


def oracle_sql() -> dict[str, str]:
    w = lambda ctes, rest: f"WITH {ctes} {rest}"
    out = {
        "stats_summary": w(JOBS, f"SELECT count(*) AS jobs, CAST(sum(CASE WHEN status = 'done' THEN 1 ELSE 0 END) AS BIGINT) AS done, CAST(sum(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) AS BIGINT) AS failed, CAST(coalesce(sum(segments_count), 0) AS BIGINT) AS segments_count, CAST(coalesce(sum(audio_seconds), 0) AS BIGINT) AS audio_seconds, CAST(coalesce(sum(tts_characters), 0) AS BIGINT) AS tts_characters, CAST(coalesce(sum(llm_input_tokens), 0) AS BIGINT) AS llm_input_tokens, CAST(coalesce(sum(llm_output_tokens), 0) AS BIGINT) AS llm_output_tokens FROM job_stats WHERE {SINCE}"),
        "stats_by_language": w(JOBS, f"SELECT target_language, count(*) AS n, CAST(coalesce(sum(audio_seconds), 0) AS BIGINT) AS audio_seconds FROM job_stats WHERE {SINCE} AND target_language IS NOT NULL GROUP BY 1 ORDER BY n DESC, 1"),
        "recent_jobs": w(JOBS, "SELECT id, created_at, status, target_language FROM job_stats ORDER BY created_at DESC, id LIMIT 50"),
        "queue_position": r"""WITH q AS (SELECT o_custkey AS queue, o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'running' ELSE 'queued' END AS status, CAST(epoch(o_orderdate) AS BIGINT) AS created_at FROM orders)
            SELECT a.queue, a.id, CAST(CASE WHEN a.status = 'queued' AND a.created_at <> 0 THEN (SELECT count(*) FROM q b WHERE b.queue = a.queue AND b.status IN ('queued', 'running') AND b.created_at <> 0 AND b.created_at < a.created_at) ELSE 0 END AS BIGINT) AS queue_position FROM q a""",
        "usage_quota": "SELECT user_id, count(*) AS used, count(*) < 100 AS has_trial, greatest(0, 100 - count(*)) AS remaining FROM events GROUP BY 1",
        "cost_breakdown": w(JOBS, r""", p AS (SELECT *, CASE provider WHEN 'openai' THEN 0.006 ELSE 0.0015 END::DOUBLE AS r1, CASE provider WHEN 'openai' THEN 0.75 ELSE 0.30 END::DOUBLE AS r2, CASE provider WHEN 'openai' THEN 4.5 ELSE 1.2 END::DOUBLE AS r3, CASE provider WHEN 'openai' THEN 30 WHEN 'elevenlabs' THEN 165 ELSE 65 END::DOUBLE AS r4 FROM job_stats),
            c AS (SELECT id, provider, audio_seconds / 60.0::DOUBLE * r1 AS a, llm_input_tokens / 1e6::DOUBLE * r2 + llm_output_tokens / 1e6::DOUBLE * r3 AS b, tts_characters / 1e6::DOUBLE * r4 AS c FROM p)
            SELECT id, provider, CAST(floor(a * 1e6::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS whisper_musd, CAST(floor(b * 1e6::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS translation_musd, CAST(floor(c * 1e6::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS tts_musd, CAST(floor((a + b + c) * 1e6::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS total_musd FROM c"""),
        "step_share": r"""WITH s AS (SELECT user_id AS run, event_type AS step, sum(CAST(floor(value * 100 + 0.5) AS BIGINT)) / 100.0::DOUBLE AS elapsed FROM events GROUP BY 1, 2), t AS (SELECT *, sum(elapsed) OVER (PARTITION BY run) AS total FROM s)
            SELECT run, step, CAST(floor(CASE WHEN total > 0 THEN elapsed / total * 100 ELSE 0 END * 1000 + 0.5) AS BIGINT) AS share_milli, CAST(floor(elapsed / 60) AS BIGINT) AS m, CAST(floor(elapsed - 60 * floor(elapsed / 60)) AS BIGINT) AS s FROM t""",
        "ttl_sweep": w(JOBS, f"SELECT id, status, created_at AS touched_at FROM job_stats WHERE created_at <= {NOW - 24 * 365 * 3600} AND status IN ('done', 'failed')"),
        "stats_upsert_latest": "SELECT user_id, event_id, event_type, CAST(epoch_us(ts) AS BIGINT) AS ts_us FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
        "settled_status": r"""WITH e AS (SELECT user_id AS job_id, event_id AS seq, ['queued', 'running', 'running', 'running', 'done', 'failed', 'cancelled'][event_id * 7919 % 7 + 1] AS status FROM events)
            SELECT job_id, coalesce(arg_min(status, seq) FILTER (status IN ('done', 'failed', 'cancelled')), arg_max(status, seq)) AS status FROM e GROUP BY 1""",
        "gap_detect": w(CUES, r""", g AS (SELECT media_id, id, lag(end_ms, 1, 0) OVER (PARTITION BY media_id ORDER BY id) AS start_ms, start_ms AS end_ms FROM cues UNION ALL SELECT media_id, NULL, arg_max(end_ms, id), any_value(total_ms) FROM cues JOIN media USING (media_id) GROUP BY 1)
            SELECT media_id, id, start_ms, end_ms FROM g WHERE end_ms - start_ms > 50"""),
        "retime": w(TTS, "SELECT media_id, id, CAST(sum(gap_us + chunk_us) OVER o - chunk_us AS BIGINT) AS start_us, CAST(sum(gap_us + chunk_us) OVER o AS BIGINT) AS end_us, speaker FROM timed WINDOW o AS (PARTITION BY media_id ORDER BY id)"),
        "audio_plan": w(TTS, r""", r AS (
            SELECT media_id, id, 'main' AS track, 0 AS k, 'orig_gap' AS kind, start_ms * 1000 - gap_us AS start_us, start_ms * 1000 AS end_us, gap_us AS duration_us, NULL::DOUBLE AS speed, NULL::DOUBLE AS atempo FROM timed WHERE gap_us > 0
            UNION ALL SELECT media_id, id, 'main', 1, 'tts_mixed', start_ms * 1000, end_ms * 1000, chunk_us, NULL, atempo FROM timed
            UNION ALL SELECT media_id, id, 'original', 0, 'speech', start_ms * 1000 - gap_us, start_ms * 1000, gap_us, 1.0, NULL FROM timed WHERE gap_us > 0
            UNION ALL SELECT media_id, id, 'original', 1, 'speech', start_ms * 1000, end_ms * 1000, CAST(floor(target * 1e6::DOUBLE + 0.5::DOUBLE) AS BIGINT), speed, NULL FROM timed
            UNION ALL SELECT media_id, id, 'original', 2, 'silence', NULL, NULL, greatest(1000, CAST(floor(frozen * 1e6::DOUBLE + 0.5::DOUBLE) AS BIGINT)), NULL, NULL FROM timed WHERE frozen > 0
            UNION ALL SELECT media_id, NULL, track, 3, kind, last * 1000, total_ms * 1000, (total_ms - last) * 1000, sp, NULL FROM (SELECT media_id, arg_max(end_ms, id) AS last FROM cues GROUP BY 1) JOIN media USING (media_id), (VALUES ('main', 'orig_gap', NULL::DOUBLE), ('original', 'speech', 1.0::DOUBLE)) v(track, kind, sp) WHERE total_ms - last > 50)
            SELECT media_id, track, row_number() OVER (PARTITION BY media_id, track ORDER BY id NULLS LAST, k) - 1 AS ord, kind, id, start_us, end_us, duration_us, CAST(floor(speed * 1e6::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS speed, CAST(floor(atempo * 1e6::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS atempo,
              CASE WHEN start_us IS NULL THEN 0 ELSE greatest(0, start_us - 2000000) END AS coarse_us, end_us - start_us + (start_us - greatest(0, start_us - 2000000)) + 500000 AS read_us FROM r"""),
        "srt_cues": w(CUES, r""", b AS (SELECT media_id, string_agg((id + 1) || chr(10) || printf('%02d:%02d:%02d,%03d', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60, start_ms % 1000) || ' --> ' || printf('%02d:%02d:%02d,%03d', end_ms // 3600000, end_ms // 60000 % 60, end_ms // 1000 % 60, end_ms % 1000) || chr(10) || text || chr(10), chr(10) ORDER BY id) AS body FROM cues GROUP BY 1)
            SELECT media_id, md5(body) AS body_md5, length(body) AS n FROM b"""),
        "srt_round_trip": w(CUES, "SELECT media_id, id, start_ms, end_ms, text FROM cues"),
        "rescale": w(CUES, r""", m AS (SELECT media_id, CASE WHEN media_id % 2 = 0 THEN CAST(floor(total_ms * 9 / 10) AS BIGINT) ELSE total_ms END AS total_ms FROM media), f AS (SELECT c.*, total_ms, max(end_ms) OVER (PARTITION BY media_id) AS last FROM cues c JOIN m USING (media_id)), g AS (SELECT *, CASE WHEN last > total_ms + 500 THEN total_ms::DOUBLE / last::DOUBLE ELSE 1.0::DOUBLE END AS factor FROM f)
            SELECT media_id, id, CAST(floor((start_ms * 1000)::DOUBLE * factor + 0.5::DOUBLE) AS BIGINT) AS start_us, CAST(floor((end_ms * 1000)::DOUBLE * factor + 0.5::DOUBLE) AS BIGINT) AS end_us FROM g"""),
        "word_ends": w(EVENT_WORDS, "SELECT media_id, seq, start_ms, greatest(start_ms, coalesce(lead(start_ms) OVER (PARTITION BY media_id ORDER BY seq), start_ms + 300)) AS end_ms FROM ew"),
        "chunk_words": w(WORDS, r""", s AS (SELECT *, sum(CASE WHEN start_ms - prev > 2000 THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY seq) AS session FROM (SELECT *, lag(end_ms) OVER (PARTITION BY media_id ORDER BY seq) AS prev FROM words)), c AS (SELECT *, (row_number() OVER (PARTITION BY media_id, session ORDER BY seq) - 1) // 120 AS part FROM s)
            SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY min(seq)) - 1 AS chunk, count(*) AS n, min(seq) AS first_seq FROM c GROUP BY media_id, session, part"""),
        "rolling_dedup": _recursive(EVENT_WORDS + r""", walk AS (SELECT media_id, seq, text, start_ms, true AS kept FROM ew WHERE seq = 0 UNION ALL SELECT e.media_id, e.seq, CASE WHEN drop_it THEN w.text ELSE e.text END, CASE WHEN drop_it THEN w.start_ms ELSE e.start_ms END, NOT drop_it FROM walk w JOIN ew e ON e.media_id = w.media_id AND e.seq = w.seq + 1, LATERAL (SELECT lower(e.text) = lower(w.text) AND abs(e.start_ms - w.start_ms) < 14400000 AS drop_it))""", "SELECT media_id, seq, text FROM walk WHERE kept"),
        "overlap_dedup": _recursive(CUES + r""", o0 AS (SELECT *, lag(end_ms) OVER (PARTITION BY media_id ORDER BY id) AS before, end_ms - start_ms AS dur FROM cues), o1 AS (SELECT *, CASE WHEN before IS NULL THEN NULL WHEN id % 7 = 0 THEN dur * 6 // 10 WHEN id % 11 = 0 THEN dur * 5 // 10 END AS back FROM o0), ov AS (SELECT media_id, id, CASE WHEN back IS NULL THEN start_ms ELSE before - back END AS start_ms, CASE WHEN back IS NULL THEN end_ms ELSE before - back + dur END AS end_ms FROM o1),
            walk AS (SELECT media_id, id, start_ms, end_ms, end_ms AS last, true AS kept FROM ov WHERE id = 0 UNION ALL SELECT o.media_id, o.id, o.start_ms, o.end_ms, CASE WHEN drop_it THEN w.last ELSE o.end_ms END, NOT drop_it FROM walk w JOIN ov o ON o.media_id = w.media_id AND o.id = w.id + 1, LATERAL (SELECT o.end_ms > o.start_ms AND 2 * greatest(0, w.last - o.start_ms) > o.end_ms - o.start_ms AS drop_it))""", "SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY id) - 1 AS id, start_ms, end_ms FROM walk WHERE kept"),
        "sentences_from_words": w(WORDS, r""", e AS (SELECT *, """ + ENDS.format(w="text") + r""" AS ends FROM words), s AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY media_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS id FROM e)
            SELECT media_id, CAST(id AS BIGINT) AS id, arg_min(start_ms, seq) AS start_ms, arg_max(end_ms, seq) AS end_ms, string_agg(text, ' ' ORDER BY seq) AS text FROM s GROUP BY 1, 2"""),
        "merge_continuous": _recursive(MERGE, "SELECT media_id, id, start_ms, end_ms, text, speaker FROM merged"),
        "sentence_split": r"WITH s AS (SELECT doc_id, " + SPLIT.format(t="text") + r" AS p FROM documents) SELECT doc_id, CAST(unnest(range(len(p))) AS BIGINT) AS k, unnest(p) AS part FROM s",
        "split_segments": _recursive(MERGE + ", s0 AS (SELECT *, " + SPLIT.format(t="text") + " AS p0 FROM merged), s1 AS (SELECT media_id, id, start_ms, end_ms, CASE WHEN len(p0) <= 1 THEN [text] ELSE p0 END AS p FROM s0), " + timed_parts("s1", "parted"), "SELECT media_id, id, start_ms, end_ms, text FROM parted"),
        "valid_segments": w(CUES, r"""SELECT media_id, id FROM cues WHERE end_ms - start_ms >= 800 AND length(trim(text)) >= 4 AND (id % 10) / 10.0::DOUBLE <= 0.6::DOUBLE AND NOT regexp_matches(trim(text), '(?i)^\s*[\[\(\*]|^\s*$|\bmusic\b|\bapplause\b|\blaughter\b|\bsilence\b|\binaudible\b|\buntranscribed\b')"""),
        "redact": r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text || CASE doc_id % 4 WHEN 0 THEN ' sk-' || repeat('aB3', 7) WHEN 1 THEN ' sk_' || repeat('x_9', 8) WHEN 2 THEN ' ' || repeat('0aF', 16) ELSE ' ' || repeat('a', 47) END || ' end', 'sk-[A-Za-z0-9_-]{20,}', '***', 'g'), 'sk_[A-Za-z0-9_-]{20,}', '***', 'g'), '\b[A-Fa-f0-9]{48,}\b', '***', 'g')) AS text_md5 FROM documents""",
        "chat_history": "WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN 'system' ELSE role END AS role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) SELECT conv_id, turn, role, text FROM c WHERE n <= 8 AND role IN ('user', 'assistant')",
        "caption_parse": w(WORDS, "SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY turn) - 1 AS id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, string_agg(text, ' ' ORDER BY pos) AS text FROM words GROUP BY media_id, turn"),
        "captions_or_asr": w(CUES, "SELECT media_id, CASE WHEN media_id % 2 = 0 THEN 'captions' ELSE 'asr' END AS source, count(*) AS n FROM cues GROUP BY 1, 2"),
        "speech_tags": w(CUES, r"""SELECT media_id, id, CASE WHEN id % 3 = 0 THEN '<speed ratio="0.95"/> ' ELSE '' END || CASE WHEN id % 2 = 0 THEN '<emotion value="calm"/> ' ELSE '' END || text AS ssml, CAST(CASE WHEN """ + SIMPLE_END.format(t="text") + " THEN 250 ELSE 120 END AS BIGINT) AS tail_ms, " + ENDS.format(w="text") + " AS ends, " + FRAGMENT.format(t="text") + " AS fragment FROM cues"),
        "breath_tags": r"""WITH s AS (SELECT conv_id, turn, text AS t FROM conversations), m AS (SELECT *, list_filter(range(1, length(t) + 1), lambda i: list_contains([',', '，', ';', '；', ':', '：'], substring(t, i, 1))) AS marks FROM s), b AS (SELECT *, list_min(list_transform(marks, lambda i: abs(2 * i - length(t)) * 1000000 + i)) % 1000000 AS mid FROM m)
            SELECT conv_id, turn, CASE WHEN length(t) >= 90 AND mid IS NOT NULL AND NOT regexp_matches(substring(t, mid + 1), '^\s*<') THEN substring(t, 1, mid) || ' <breath>' || substring(t, mid + 1) ELSE t END AS tagged FROM b""",
        "lang_code": r"""WITH n AS (SELECT n_nationkey, ['English', 'GERMAN', 'klingon', 'zh'][n_nationkey % 4 + 1] AS name FROM nation) SELECT n_nationkey, name, CASE lower(name) WHEN 'english' THEN 'en' WHEN 'german' THEN 'de' ELSE substring(lower(name), 1, 2) END AS code, CASE WHEN substring(lower(name), 1, 2) IN ('en') THEN 'en' ELSE 'na' END AS local_code FROM n""",
        "audio_chunks": w(CUES, r""", n AS (SELECT media_id, total_ms, CAST(unnest(range(CASE WHEN total_ms <= 120000 THEN 1 ELSE (total_ms + 119999) // 120000 END)) AS BIGINT) AS chunk FROM media) SELECT media_id, chunk, chunk * 120000 AS offset_ms, CASE WHEN total_ms <= 120000 THEN total_ms ELSE least(121000, total_ms - chunk * 120000) END AS length_ms FROM n"""),
        "missing_files": w(CUES, "SELECT media_id, id, printf('seg_%05d.wav', id) AS name FROM cues WHERE id % 10 = 0"),
        "upload_gate": r"""SELECT page_id, CASE WHEN page_id % 3 = 1 THEN 'extension' WHEN length(html) * 1000 > 2097152 THEN 'size' WHEN page_id % 500 > 300 THEN 'duration' END AS refused FROM pages""",
    }
    chunked = WORDS + r""", s0 AS (SELECT *, sum(CASE WHEN start_ms - prev > 2000 THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY seq) AS session FROM (SELECT *, lag(end_ms) OVER (PARTITION BY media_id ORDER BY seq) AS prev FROM words)),
        s1 AS (SELECT *, (row_number() OVER (PARTITION BY media_id, session ORDER BY seq) - 1) // 120 AS part FROM s0), s2 AS (SELECT *, dense_rank() OVER (PARTITION BY media_id ORDER BY session, part) - 1 AS chunk FROM s1)"""
    out["align"] = w(chunked, r""", f AS (SELECT *, (media_id + chunk) % 8 AS k, seq % CASE (media_id + chunk) % 4 WHEN 0 THEN 2 WHEN 1 THEN 16 ELSE 1000 END = 1 AS dash FROM s2),
        g AS (SELECT media_id, chunk, any_value(k) AS k, count(*) AS n, count(*) FILTER (dash) AS extra, min(start_ms) AS s, max(end_ms) AS e, string_agg(text, ' ' ORDER BY seq) AS raw, string_agg(CASE WHEN dash THEN text || ' —' ELSE text END, ' ' ORDER BY seq) AS said FROM f GROUP BY 1, 2),
        fits AS (SELECT *, k <> 2 AND k % 4 <> 3 AND extra <= 0.15 * n AS good FROM g),
        e AS (SELECT f.*, """ + ENDS.format(w="text") + r""" AS ends FROM f JOIN fits USING (media_id, chunk) WHERE good),
        c AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY media_id, chunk ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place,
          coalesce(lag(ends AND dash) OVER (PARTITION BY media_id, chunk ORDER BY seq), false) AS led FROM e),
        n AS (SELECT media_id, chunk, dense_rank() OVER (PARTITION BY media_id, chunk ORDER BY place) - 1 AS sentence, seq, start_ms, end_ms, CASE WHEN led THEN '— ' ELSE '' END || text || CASE WHEN dash AND NOT ends THEN ' —' ELSE '' END AS piece FROM c)
        SELECT media_id, chunk, sentence, min(start_ms) AS start_ms, max(end_ms) AS end_ms, string_agg(piece, ' ' ORDER BY seq) AS text FROM n GROUP BY 1, 2, 3
        UNION ALL SELECT media_id, chunk, 0, s, e, CASE WHEN k = 2 OR k % 4 = 3 THEN raw ELSE said END FROM fits WHERE NOT good""")
    cut = "list_filter(range(1, length(text) + 1), lambda i: substring(text, i, 1) IN (',', '，', ';', '；', '、'))"
    out["soft_split"] = _recursive(
        CUES
        + ", s0 AS (SELECT *, "
        + SPLIT.format(t="text")
        + r""" AS p0 FROM cues), r0 AS (SELECT media_id, id, CAST(unnest(range(len(p0))) AS BIGINT) AS k, unnest(p0) AS text FROM s0),
        halves AS (SELECT media_id, id, k, '' AS path, text FROM r0 UNION ALL SELECT media_id, id, k, path || side, CASE side WHEN '0' THEN l ELSE r END FROM (SELECT *, rtrim(substring(text, 1, e)) AS l, ltrim(substring(text, e + 1)) AS r FROM (SELECT *, """
        + f"list_min(list_transform({cut}, lambda i: abs(2 * i - length(text)) * 1000000 + i)) % 1000000 AS e FROM halves WHERE length(text) > 20 AND len({cut}) > 0"
        + r""")), (VALUES ('0'), ('1')) v(side) WHERE l <> '' AND r <> ''),
        leaves AS (SELECT * FROM halves h WHERE NOT EXISTS (SELECT 1 FROM halves x WHERE x.media_id = h.media_id AND x.id = h.id AND x.k = h.k AND x.path = h.path || '0')),
        s2 AS (SELECT media_id, id, list(text ORDER BY k, path) AS p FROM leaves GROUP BY 1, 2),
        s1 AS (SELECT c.media_id, c.id, start_ms, end_ms, CASE WHEN coalesce(len(p), 0) <= 1 THEN [text] ELSE p END AS p FROM cues c LEFT JOIN s2 USING (media_id, id)), """
        + timed_parts("s1", "parted"),
        "SELECT media_id, id, start_ms, end_ms, text FROM parted",
    )
    out["localise"] = _recursive(
        CUES
        + ", chosen AS (SELECT media_id, id, start_ms, end_ms, CASE WHEN media_id % 2 = 0 THEN text || ' so' ELSE text END AS text, speaker FROM cues),"
        + merge_ctes("chosen", "walk", "merged", 60000)
        + ", said1 AS (SELECT media_id, id, start_ms, end_ms, upper(replace(text, 'ß', 'ss')) AS text, 'SPEAKER_00' AS speaker FROM merged),"
        + merge_ctes("said1", "walk2", "merged2", None)
        + ", s0 AS (SELECT *, "
        + SPLIT.format(t="text")
        + " AS p0 FROM merged2), s1 AS (SELECT media_id, id, start_ms, end_ms, CASE WHEN len(p0) <= 1 THEN [text] ELSE p0 END AS p FROM s0), "
        + timed_parts("s1", "parted")
        + ", spoken AS (SELECT media_id, id, 60 * length(text) + CASE WHEN "
        + SIMPLE_END.format(t="text")
        + " THEN 250 ELSE 120 END AS tts_ms FROM parted), "
        + TIMED.replace("{cues}", "parted").replace("{tts}", "spoken"),
        "SELECT media_id, id, CAST(sum(gap_us + chunk_us) OVER o - chunk_us AS BIGINT) AS start_us, CAST(sum(gap_us + chunk_us) OVER o AS BIGINT) AS end_us, text FROM timed WINDOW o AS (PARTITION BY media_id ORDER BY id)",
    )
    out["auto_caption_words"] = w(WORDS, "SELECT media_id, seq, text, start_ms, greatest(start_ms, coalesce(lead(start_ms) OVER (PARTITION BY media_id ORDER BY seq), start_ms + 300)) AS end_ms FROM words")
    out["batches"] = w(CUES, r"""SELECT media_id, id // 64 AS batch, count(*) AS n, md5(string_agg('[' || (id % 64 + 1) || ']: "' || text || '"', chr(10) ORDER BY id)) AS prompt_md5 FROM cues GROUP BY 1, 2""")
    # Peeled one factor after the other, as long as the rest is out of range.
    out["tempo_chain"] = _recursive(
        TTS
        + r""", r AS (SELECT c.media_id, c.id, tts_ms::DOUBLE / (end_ms - start_ms)::DOUBLE AS r FROM cues c JOIN tts USING (media_id, id)),
        peel AS (SELECT media_id, id, r AS rest, 1.0::DOUBLE AS peeled, 0 AS n FROM r UNION ALL SELECT media_id, id, CASE WHEN rest > 2 THEN rest / 2 ELSE rest / 0.5::DOUBLE END, CASE WHEN rest > 2 THEN peeled * 2 ELSE peeled * 0.5::DOUBLE END, n + 1 FROM peel WHERE rest > 2 OR rest < 0.5::DOUBLE)""",
        "SELECT media_id, id, CAST(n + 1 AS BIGINT) AS n, CAST(floor(peeled * rest * 1e6::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS product, rest >= 0.5::DOUBLE AND rest <= 2 AS within FROM peel WHERE rest <= 2 AND rest >= 0.5::DOUBLE",
    )
    out["track_select"] = w(TRACKS, "SELECT media_id, string_split(t, ',')[1] AS kind, string_split(t, ',')[2] AS lang, string_split(t, ',')[3] AS url FROM t WHERE t IS NOT NULL")
    probes = r""", probes AS (SELECT DISTINCT media_id, unnest([0, total_ms // 4, total_ms // 2, total_ms]) AS t_ms FROM media), win AS (SELECT *, greatest(0, t_ms - 30000) AS ws, t_ms + 30000 AS we FROM probes),
        ctx AS (SELECT p.media_id, p.t_ms, least(ws, coalesce(arg_min(c.start_ms, c.id), ws)) AS window_start_ms, greatest(we, coalesce(arg_max(c.end_ms, c.id), we)) AS window_end_ms, coalesce(string_agg(c.id::VARCHAR, ',' ORDER BY c.id), '') AS ids, coalesce(string_agg(c.text, chr(10) ORDER BY c.id), '') AS text
          FROM win p LEFT JOIN cues c ON c.media_id = p.media_id AND c.end_ms >= ws AND c.start_ms <= we GROUP BY p.media_id, p.t_ms, ws, we)"""
    out["context_window"] = w(CUES + probes, "SELECT media_id, t_ms, window_start_ms, window_end_ms, ids, text FROM ctx")
    out["frame_times"] = w(CUES + probes, r""", f AS (SELECT media_id, t_ms, total_ms, window_start_ms, unnest(range(least(6, (window_end_ms - window_start_ms) // 5000 + 1))) AS n FROM ctx JOIN media USING (media_id))
        SELECT media_id, t_ms, CAST(n AS BIGINT) AS n, (least(window_start_ms + n * 5000, greatest(0, total_ms - 100)) + 5) // 10 * 10 AS frame_ms FROM f""")
    valid = r""", ok AS (SELECT media_id, start_ms, end_ms FROM cues WHERE end_ms - start_ms >= 800 AND length(trim(text)) >= 4 AND (id % 10) / 10.0::DOUBLE <= 0.6::DOUBLE AND NOT regexp_matches(trim(text), '(?i)^\s*[\[\(\*]|\bmusic\b|\bapplause\b|\blaughter\b|\bsilence\b|\binaudible\b|\buntranscribed\b'))"""
    out["valid_word_range"] = w(CUES + valid, "SELECT media_id, seq FROM words w WHERE NOT EXISTS (SELECT 1 FROM ok WHERE ok.media_id = w.media_id) OR EXISTS (SELECT 1 FROM ok WHERE ok.media_id = w.media_id AND w.start_ms BETWEEN ok.start_ms AND ok.end_ms)")
    from . import service_sql

    return out | service_sql.oracle_sql()
