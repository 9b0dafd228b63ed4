"""Sequence operators against plain models on random segments."""

import random
import re

from pyspark.sql import functions as F

from cueloom.operators import segments as S
from cueloom.operators import timeline as TL
from cueloom.sources import readers, writers

SEG = "media_id long, id long, start_ms long, end_ms long, text string, speaker string"


def random_segments(seed, media=6, n=40):
    rnd, rows = random.Random(seed), []
    for m in range(media):
        t = 0
        for i in range(n):
            s = max(0, t + rnd.choice([-900, -100, 0, 0, 30, 400, 1000, 1001, 5000]))
            e = s + rnd.choice([0, 200, 900, 2500])
            text = rnd.choice(["go on", "The 120B.", "B model", "b model", "Stop.", "Then we", "", "end", "好。", "the end"])
            rows.append((m, i, s, e, text, rnd.choice("AAAB")))
            t = e
    return rows


def by_media(rows):
    out = {}
    for r in sorted(rows):
        out.setdefault(r[0], []).append(r)
    return out


def overlaps(before, after):
    """Every length of two characters or more at which `after` begins with what `before` ends with, case aside."""
    b, a = before.lower(), after.lower()
    return {n for n in range(2, len(a) + 1) if b[-n:] == a[:n]}


def new_part(before, after):
    """What `after` adds to `before`: all of it if the two overlap nowhere, or if nothing would be left."""
    tail = before.rstrip(".!?。！？ ")
    start = after.lstrip()
    cut = max(overlaps(tail, start), default=0)
    left = start[cut:].lstrip(" ,，;；") if cut else ""
    return left if left.strip() else after


class Speech:
    """One merged segment, grown row by row."""

    def __init__(self, row):
        self.media, _, self.start, self.end, self.text, self.who = row

    def takes(self, row, gap, longest):
        _, _, start, end, text, who = row
        closed = re.search(r"[.!?。！？]\s*\Z", self.text) is not None
        lowercase_or_initial = re.match(r"[a-z]|[A-Z][\s一-鿿]", text.strip()) is not None
        checks = [who == self.who, start - self.end <= gap, lowercase_or_initial or not closed, longest is None or end - self.start <= longest]
        return all(checks), lowercase_or_initial

    def grow(self, row, fragment):
        more = new_part(self.text, row[4]) if fragment else row[4]
        self.text = f"{self.text} {more}".strip() if more.strip() else self.text
        self.end = row[3]


def merged(rows, gap=1000, longest=60000):
    """Rows of one medium as runs: a row that its run doesn't take starts the next one."""
    runs = []
    for row in rows:
        fits, fragment = runs[-1].takes(row, gap, longest) if runs else (False, False)
        if fits:
            runs[-1].grow(row, fragment)
        else:
            runs.append(Speech(row))
    return [(r.media, i, r.start, r.end, r.text, r.who) for i, r in enumerate(runs)]


def test_models_on_literal_rows():
    assert new_part("it has the 120B.", "B model") == "B model" and new_part("with the 120 b model.", "b model is") == "is" and new_part("the end", "end") == "end"
    said = merged([(1, 0, 0, 900, "We go", "A"), (1, 1, 1000, 1500, "on. Then", "A"), (1, 2, 1600, 1900, "stop.", "A"), (1, 3, 2000, 2500, "New one", "A"), (1, 4, 2600, 2700, "and b", "B")])
    assert said == [(1, 0, 0, 1900, "We go on. Then stop.", "A"), (1, 1, 2000, 2500, "New one", "A"), (1, 2, 2600, 2700, "and b", "B")]


def test_merge_is_the_fold(spark):
    for seed in range(4):
        rows = random_segments(seed)
        for longest, stretch in ((60000, 4096), (4000, 4096), (None, 4096), (4000, 7), (2600, 1), (4000, 2), (None, 3)):
            got = sorted(tuple(r) for r in S.merge_continuous(spark.createDataFrame(rows, SEG), 1000, longest, stretch).select("media_id", "id", "start_ms", "end_ms", "text", "speaker").collect())
            want = [x for part in by_media(rows).values() for x in merged(part, longest=longest)]
            assert got == sorted(want)


def test_overlap_dedup_is_the_fold(spark):
    for seed in range(4):
        rows = random_segments(seed)
        want = []
        for part in by_media(rows).values():
            kept = []
            for r in part:
                dur = r[3] - r[2]
                if kept and dur > 0 and max(0, kept[-1][3] - r[2]) / dur > 0.5:
                    continue
                kept.append(r)
            want += [(r[0], i, r[2], r[3]) for i, r in enumerate(kept)]
        for stretch in (4096, 1, 3, 8):
            got = sorted(tuple(r) for r in S.dedup_overlap(spark.createDataFrame(rows, SEG), stretch).select("media_id", "id", "start_ms", "end_ms").collect())
            assert got == sorted(want)


def test_rolling_dedup_is_the_fold(spark):
    rnd = random.Random(5)
    rows, want = [], []
    for m in range(5):
        t, last = 0, None
        for i in range(60):
            t += rnd.choice([0, 20, 60, 90, 100, 300])
            w = rnd.choice(["a", "A", "b"])
            rows.append((m, i, w, t))
            if last is None or last[0] != w.lower() or abs(t - last[1]) >= 100:
                last = (w.lower(), t)
                want.append((m, i))
    for stretch in (4096, 1, 2, 7):
        got = sorted((r.media_id, r.seq) for r in S.rolling_dedup(spark.createDataFrame(rows, "media_id long, seq long, text string, start_ms long"), stretch=stretch).collect())
        assert got == want


def test_chunks_and_alignment(spark):
    w = spark.createDataFrame([(1, 0, "a", 0, 500), (1, 1, "b", 500, 1000), (1, 2, "c", 4000, 4500)], "media_id long, seq long, text string, start_ms long, end_ms long")
    assert [r.chunk for r in S.chunk_words(w).orderBy("seq").collect()] == [0, 0, 1]
    five = spark.createDataFrame([(1, 0, i, t, i * 1000, i * 1000 + 1000) for i, t in enumerate("a few years hello there".split())], "media_id long, chunk long, seq long, text string, start_ms long, end_ms long")
    said = spark.createDataFrame([(1, 0, "A few years. Hello there?")], "media_id long, chunk long, text string")
    assert [(r.start_ms, r.end_ms, r.text) for r in S.align(five, said).orderBy("sentence").collect()] == [(0, 3000, "A few years."), (3000, 5000, "Hello there?")]
    two = five.where("seq < 2")
    off = spark.createDataFrame([(1, 0, "one two three four five six seven eight.")], "media_id long, chunk long, text string")
    assert [(r.start_ms, r.end_ms, r.text) for r in S.align(two, off).collect()] == [(0, 2000, "one two three four five six seven eight.")]


def align_one(spark, words, said, step=1000):
    w = spark.createDataFrame([(1, 0, i, t, i * step, i * step + step) for i, t in enumerate(words)], "media_id long, chunk long, seq long, text string, start_ms long, end_ms long")
    p = spark.createDataFrame([(1, 0, said)] if said is not ... else [], "media_id long, chunk long, text string")
    return [(r.start_ms, r.end_ms, r.text) for r in S.align(w, p).orderBy("sentence").collect()]


def test_alignment_counts_all_tokens(spark):
    # Two dashes on three words are over 15 % of them, though the five tokens have three with letters.
    assert align_one(spark, ["a", "b", "c"], "a — b — c.") == [(0, 3000, "a — b — c.")]
    ten = [f"w{i}" for i in range(10)]
    assert align_one(spark, ten, "w0 w1 w2. — w3 w4 w5 w6 w7 w8 w9.") == [(0, 3000, "w0 w1 w2."), (3000, 10000, "— w3 w4 w5 w6 w7 w8 w9.")]
    # An extra token takes no word, and a sentence without a word is dropped; a word too many is left.
    assert align_one(spark, ten, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9. more.") == [(0, 10000, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9.")]
    assert align_one(spark, ten, "w0 w1 w2 w3. w4 w5 w6 w7 w8") == [(0, 4000, "w0 w1 w2 w3."), (4000, 9000, "w4 w5 w6 w7 w8")]


def test_alignment_falls_back_to_the_words(spark):
    for said in ("", "  \n", None, ...):
        assert align_one(spark, ["a", "b"], said) == [(0, 2000, "a b")]
    assert align_one(spark, ["a", "b"], "— —") == [(0, 2000, "— —")]


def test_words_without_valid_ranges_stay(spark):
    w = spark.createDataFrame([(1, 0, "a", 0, 1), (1, 1, "b", 5, 6), (1, 2, "c", 130_000, 130_001), (1, 3, "d", None, 9), (2, 0, "c", 9, 10), (3, 0, "x", 200_000, 200_001)], "media_id long, seq long, text string, start_ms long, end_ms long")
    valid = spark.createDataFrame([(1, 5, 6), (1, 5, 130_000), (3, 9, 3)], "media_id long, start_ms long, end_ms long")
    # A range over several stretches, both ends, a null start as 0, and media without ranges. A range that ends before it starts holds nothing.
    assert sorted((r.media_id, r.seq) for r in S.words_in_valid(w, valid).collect()) == [(1, 1), (1, 2), (2, 0)]


def test_context_over_stretches(spark):
    from cueloom.operators import context

    rows = [(1, 0, 0, 200_000, "long", "A"), (1, 1, 70_000, 71_000, "b", "A"), (1, 2, 119_000, 121_000, "c", "A"), (1, 3, 500_000, 500_001, "far", "A")]
    probes = spark.createDataFrame([(1, 100_000), (1, 400_000), (2, 5)], "media_id long, t_ms long")
    got = {(r.media_id, r.t_ms): (r.window_start_ms, r.window_end_ms, r.ids, r.text) for r in context.context_window(probes, spark.createDataFrame(rows, SEG)).collect()}
    assert got == {(1, 100_000): (0, 130_000, "0,1,2", "long\nb\nc"), (1, 400_000): (370_000, 430_000, "", ""), (2, 5): (0, 30_005, "", "")}


def test_split_keeps_time(spark):
    rows = [(1, 0, 0, 1000, "One. Two two.", "A"), (1, 1, 1000, 2000, " single ", "A"), (2, 0, 5, 5, "A. B.", "B"), (3, 0, 0, 10, "", "B")]
    got = S.split_sentences(spark.createDataFrame(rows, SEG)).orderBy("media_id", "id").collect()
    assert [(r.media_id, r.id, r.start_ms, r.end_ms, r.text) for r in got] == [(1, 0, 0, 333, "One."), (1, 1, 333, 1000, "Two two."), (1, 2, 1000, 2000, " single "), (2, 0, 5, 5, "A."), (2, 1, 5, 5, "B."), (3, 0, 0, 10, "")]


def test_timeline_is_gapless(spark):
    rows = [r for r in random_segments(9) if r[3] > r[2]]
    seg = spark.createDataFrame([(m, i, s, e, t, w) for m, i, s, e, t, w in rows], SEG)
    tts = seg.select("media_id", "id", ((F.col("end_ms") - F.col("start_ms")) * (F.col("id") % 5 + 1) / 2).cast("long").alias("tts_ms"))
    for part in by_media([tuple(r) for r in TL.retime(seg, tts).select("media_id", "id", "start_us", "end_us").collect()]).values():
        assert all(a[3] <= b[2] for a, b in zip(part, part[1:])) and all(r[2] <= r[3] for r in part)


def test_captions(spark):
    body = '{"events":[{"tStartMs":13240,"dDurationMs":2560,"segs":[{"utf8":"Hello\\n"},{"utf8":"there"}]},{"tStartMs":16880,"dDurationMs":1216,"segs":[{"utf8":"x"}]},{"segs":[{"utf8":" \\n"}]},{"tStartMs":1}]}'
    got = readers.manual_captions(spark.createDataFrame([(1, body), (2, "not json"), (3, None)], "media_id long, body string")).orderBy("id").collect()
    assert [(r.start_ms, r.end_ms, r.text) for r in got] == [(13240, 15800, "Hello there"), (16880, 18096, "x")]
    auto = '{"events":[{"tStartMs":1000,"segs":[{"utf8":"a"},{"utf8":" few","tOffsetMs":200},{"utf8":"\\n"}]},{"tStartMs":1180,"segs":[{"utf8":"few","tOffsetMs":20},{"utf8":"years","tOffsetMs":300}]}]}'
    words = S.word_ends(S.rolling_dedup(readers.auto_caption_words(spark.createDataFrame([(1, auto)], "media_id long, body string")))).orderBy("seq").collect()
    assert [(r.text, r.start_ms, r.end_ms) for r in words] == [("a", 1000, 1200), ("few", 1200, 1480), ("years", 1480, 1780)]


def test_srt(spark):
    body = "1\r\n00:00:01,000 --> 00:00:02,500\r\nHello\r\nthere\r\n\r\n00:00:03.000 --> 00:00:04.000\r\nNo number\r\n\r\n3\r\nno times\r\n\r\n4\r\n00:00:05,000 --> 00:00:06,000\r\n"
    got = readers.srt_cues(spark.createDataFrame([(1, body)], "media_id long, body string")).orderBy("id").collect()
    assert [(r.id, r.start_ms, r.end_ms, r.text) for r in got] == [(0, 1000, 2500, "Hello there"), (1, 3000, 4000, "No number")]
    cues = spark.createDataFrame([(1, 0, 0, 1000, "Xin chao", "A")], SEG)
    assert {r.format: r.body for r in writers.subtitles(cues, ("srt", "vtt", "txt")).collect()} == {
        "srt": "1\n00:00:00,000 --> 00:00:01,000\nXin chao\n",
        "vtt": "WEBVTT\n\n00:00:00.000 --> 00:00:01.000\nXin chao\n",
        "txt": "Xin chao\n",
    }


def test_tracks(spark):
    man, auto = '{"en":[{"ext":"json3","url":"MAN"}]}', '{"en":[{"ext":"json3","url":"AUTO"}]}'
    rows = [(1, "en", man, auto), (2, "en", "{}", auto), (3, "en", '{"vi":[{"ext":"json3","url":"V"}]}', '{"aa-en":[{"ext":"json3","url":"A"}]}'), (4, "en", '{"en-US":[{"ext":"json3","url":"US"}]}', "{}"), (5, None, "{}", auto), (6, None, man, auto)]
    df = spark.createDataFrame(rows, "media_id long, src string, s string, a string").select("media_id", "src", F.from_json("s", readers.TRACKS).alias("subtitles"), F.from_json("a", readers.TRACKS).alias("automatic"))
    assert {r.media_id: (r.kind, r.url) for r in readers.select_track(df).collect()} == {1: ("manual", "MAN"), 2: ("auto", "AUTO"), 4: ("manual", "US"), 6: ("manual", "MAN")}


def test_zip_within(spark):
    from cueloom.operators.zipping import zip_within

    a = spark.createDataFrame([(1, 0, "a"), (1, 1, None), (2, 0, "c")], "media_id long, id long, x string")
    b = spark.createDataFrame([(1, 0, 5), (1, 1, 6), (3, 0, 7)], "media_id long, id long, y long")
    assert sorted(tuple(r) for r in zip_within(a, b).collect()) == [(1, 0, "a", 5), (1, 1, None, 6)]
    assert zip_within(a.limit(0), b).count() == 0


def test_ranges_by_stretches(spark):
    """Long, nested, empty and reversed ranges; words before, between and at both ends; several lengths of a stretch."""
    rnd = random.Random(8)
    words = [(m, i, "w", rnd.choice([None, *range(0, 5000, 7)]), 0) for m in range(4) for i in range(80)]
    ranges = [(m, i, a, a + rnd.choice([-5, 0, 3, 40, 2000]), "t") for m in range(3) for i in range(6) for a in [rnd.randrange(5000)]] + [(0, 9, None, 4000, "t"), (1, 9, 10, None, "t")]
    some = {m for m, *_ in ranges}
    want = sorted((m, i) for m, i, _, t, _ in words if m not in some or any(r[0] == m and None not in r[2:4] and r[2] <= (t or 0) <= r[3] for r in ranges))
    w = spark.createDataFrame(words, "media_id long, seq long, text string, start_ms long, end_ms long").repartition(3)
    r = spark.createDataFrame(ranges, "media_id long, id long, start_ms long, end_ms long, text string")
    for stretch in (10, 700, 1 << 40):
        got = S.words_in_valid(w, r, stretch)
        assert sorted((x.media_id, x.seq) for x in got.collect()) == want and got.columns == w.columns


def test_a_segment_of_hours_is_two_rows(spark):
    from cueloom.operators import context

    hour, year = 3_600_000, 365 * 24 * 3_600_000
    rows = [(1, 0, 0, 5 * hour, "long", "A"), (1, 1, 70_000, 71_000, "short", "A"), (1, 2, 0, 3 * year, "years", "A"), (1, 3, 2 * hour, 2 * hour, "point", "A"), (1, 4, 59_000, 61_000, "edge", "A"), (1, 5, 9_000_000, 8_000_000, "back", "A")]
    seg = spark.createDataFrame(rows, SEG)
    probes = spark.createDataFrame([(1, t) for t in (0, 60_000, 2 * hour, 4 * hour, year, 4 * year)], "media_id long, t_ms long")
    got = {r.t_ms: r.ids for r in context.context_window(probes, seg).collect()}
    for t in got:
        ws, we = max(0, t - 30_000), t + 30_000
        assert got[t] == ",".join(str(i) for _, i, s, e, _, _ in rows if e >= ws and s <= we)
    sizes = context.F.array(*[context.F.struct(context.F.lit(k).alias("level"), context.F.lit(v).cast("long").alias("size")) for k, v in enumerate(context.LEVELS)])
    binned = context._binned(probes.withColumns({"ws": context.F.col("t_ms") - 30_000, "we": context.F.col("t_ms") + 30_000}), "ws", "we", sizes)
    assert binned.groupBy("t_ms").count().agg(context.F.max("count")).first()[0] <= 13
