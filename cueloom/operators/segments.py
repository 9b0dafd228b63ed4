"""Operators on ordered segments: (media_id, id, start_ms, end_ms, text, speaker).

Folds whose state depends on what was kept (merging and both kinds of
de-duplication) are rules of folds.runs(), which cuts a medium into stretches of
bounded length and joins their summaries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .folds import ALWAYS, NEVER, STRETCH, Rule, runs


def _in_order(*by: str):
    return Window.partitionBy("media_id").orderBy(*(by or ("id",)))


def renumber(df: DataFrame, *by: str) -> DataFrame:
    """Dense ids from 0 in the given order."""
    return df.withColumn("__id", (F.row_number().over(_in_order(*by)) - 1).cast("long")).drop("id").withColumnRenamed("__id", "id")


def valid_segments(asr: DataFrame) -> DataFrame:
    return asr.where(T.is_valid_segment(F.col("text"), F.col("start_ms"), F.col("end_ms"), F.col("no_speech_prob")))


#: Milliseconds of a stretch in which words and ranges are put in order.
STRETCH_MS = 600_000


def words_in_valid(words: DataFrame, valid: DataFrame, stretch_ms: int = STRETCH_MS) -> DataFrame:
    """Words whose start lies in a valid segment, both ends included; media without any keep all words. A null start is 0.

    A word is inside if the furthest end of the ranges that began before it
    reaches it. So a range is one row however long it is: words and ranges are put
    in order by stretches of time, and each stretch is told the furthest end before it.
    """
    w = words.select("media_id", F.coalesce("start_ms", F.lit(0)).cast("long").alias("__t"), F.lit(1).alias("__k"), F.lit(None).cast("long").alias("__end"), F.struct(*words.columns).alias("__w"))
    r = valid.select("media_id", F.coalesce("start_ms", F.lit(0)).cast("long").alias("__t"), F.lit(0).alias("__k"), F.when(F.col("start_ms").isNotNull(), F.col("end_ms")).cast("long").alias("__end"))
    both = w.unionByName(r, allowMissingColumns=True).withColumn("__s", F.floor(F.col("__t") / stretch_ms))
    dealt = both.repartition("media_id", "__s")
    # As in timeline: keys that come out as aggregates, so that both readers have one exchange.
    keys = [F.min(c).alias(f"{c}_") for c in ("media_id", "__s")]
    ends = dealt.groupBy("media_id", "__s").agg(*keys, F.max("__end").alias("__top"), F.min("__k").alias("__any"), F.count("__w").alias("__words")).drop("media_id", "__s").withColumnsRenamed({"media_id_": "media_id", "__s_": "__s"})
    medium = Window.partitionBy("media_id")
    reach = F.max("__top").over(medium.orderBy("__s").rowsBetween(Window.unboundedPreceding, -1))
    carried = ends.select("media_id", "__s", "__words", reach.alias("__reach"), (F.min("__any").over(medium) == 0).alias("__some")).where("__words > 0").drop("__words")
    here = F.max("__end").over(Window.partitionBy("media_id", "__s").orderBy("__t", "__k").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    met = dealt.withColumn("__here", here).where("__k = 1").join(carried, ["media_id", "__s"], "left")
    inside = F.coalesce(F.greatest("__here", "__reach") >= F.col("__t"), F.lit(False))
    return met.where(inside | ~F.coalesce("__some", F.lit(False))).select("__w.*")


def sentences_from_words(words: DataFrame) -> DataFrame:
    """(media_id, id, start_ms, end_ms, text): words up to a sentence end; blank words are skipped."""
    order = _in_order("seq")
    w = words.where(T.strip(F.coalesce("text", F.lit(""))) != "").withColumn("ends", T.ends_sentence(F.col("text")).cast("int"))
    w = w.withColumn("sid", F.sum(F.coalesce(F.lag("ends").over(order), F.lit(0))).over(order))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: T.strip(x["text"])), " ")
    return w.groupBy("media_id", F.col("sid").alias("id")).agg(F.min_by("start_ms", "seq").alias("start_ms"), F.max_by("end_ms", "seq").alias("end_ms"), text.alias("text"))


def _merging(max_gap_ms: int, max_duration_ms: int | None) -> Rule:
    """A segment starts anew where another speaker, a pause, a sentence end before no fragment, or the longest duration says so.

    A run's value is its start. While all its texts are blank (fresh) it has no
    sentence end; else the last text that isn't blank has it or not.
    """

    def limits(before, row):
        start, end, speaker, _, fragment, _ = row
        last, who, closed = before
        if None in (start, end, speaker, last, who) or speaker != who or start - last > max_gap_ms:
            return ALWAYS, ALWAYS, ALWAYS
        long = NEVER if max_duration_ms is None else end - max_duration_ms - 1
        return ALWAYS if closed and not fragment else long, long, ALWAYS

    def after(before, row):
        _, end, speaker, closed, _, blank = row
        return end, speaker, (before[2] if before else None) if blank else closed

    return Rule(
        ("start_ms", "end_ms", "speaker", "__ends", "__frag", "__blank"), limits, lambda row: row[0] or 0, lambda row: row[5], after,
        lambda before, tail: (*tail[:2], before[2] if tail[2] is None and before else tail[2]),
    )


def merge_continuous(segments: DataFrame, max_gap_ms: int = 1000, max_duration_ms: int | None = 60000, stretch: int = STRETCH) -> DataFrame:
    """Joins what a speaker goes on saying within a sentence.

    A segment extends the current one if the speaker is the same, the gap is at
    most max_gap_ms, the current text has no sentence end or the segment is a
    fragment, and the whole stays within max_duration_ms (None: no limit). A
    fragment first loses what the current text ends with. A segment without
    times or speaker stands alone; a null text is a blank one.

    What is gathered is one merged segment at a time.
    """
    text = F.coalesce("text", F.lit(""))
    s = segments.withColumn("__ends", T.ends_sentence_simple(text)).withColumn("__frag", T.is_fragment(text)).withColumn("__blank", T.strip(text) == "")
    rows = runs(s, _merging(max_gap_ms, max_duration_ms), stretch)
    parts = F.array_sort(F.collect_list(F.struct("id", F.col("text").alias("t"), F.col("__frag").alias("frag"), F.col("__blank").alias("blank"))))
    met = rows.groupBy("media_id", "run").agg(F.min_by("start_ms", "id").alias("start_ms"), F.max_by("end_ms", "id").alias("end_ms"), parts.alias("p"), F.min_by("speaker", "id").alias("speaker"))

    return renumber(met.select("media_id", F.col("run").alias("id"), "start_ms", "end_ms", T.grown(F.col("p")).alias("text"), "speaker"), "id")


def _overlapping() -> Rule:
    """A segment is kept if the last kept end lies at its middle or before; it is then the last kept one."""

    def limits(before, row):
        start, end = row
        if start is None or end is None or end <= start:
            return ALWAYS, ALWAYS, ALWAYS
        return (start + end) // 2, (start + end) // 2, ALWAYS

    return Rule(("start_ms", "end_ms"), limits, lambda row: NEVER + 1 if row[1] is None else row[1])


def dedup_overlap(segments: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Drops a segment of which over half lies before the end of the last kept one. One without times or length stays."""
    kept = runs(segments, _overlapping(), stretch).where("id = run")
    return renumber(kept.select("media_id", "id", "start_ms", "end_ms", "text", "speaker"), "id")


def _rolling(within_ms: int) -> Rule:
    """A word is kept if its text isn't the one before it, or if the last kept word starts within_ms away or further."""

    def limits(before, row):
        key, start = row
        if before is None or key is None or start is None or key != before[0]:
            return ALWAYS, ALWAYS, ALWAYS
        return start - within_ms, start - within_ms, start + within_ms

    return Rule(("__key", "start_ms"), limits, lambda row: row[1] or 0, after=lambda before, row: row[:1])


def rolling_dedup(words: DataFrame, within_ms: int = 100, stretch: int = STRETCH) -> DataFrame:
    """Drops a word equal to the last kept one, case aside, that starts under within_ms from it.

    words: (media_id, seq, text, start_ms). Words without a text or a start stay.
    """
    w = words.select("media_id", F.col("seq").alias("id"), "text", "start_ms").withColumn("__key", T.casefold(F.col("text")))
    return runs(w, _rolling(within_ms), stretch).where("id = run").select("media_id", F.col("id").alias("seq"), "text", "start_ms")


def word_ends(words: DataFrame, last_ms: int = 300) -> DataFrame:
    """A word ends where the next starts, the last one after last_ms, none before its own start."""
    after = F.coalesce(F.lead("start_ms").over(_in_order("seq")), F.col("start_ms") + last_ms)
    return words.withColumn("end_ms", F.greatest(after, "start_ms"))


def chunk_words(words: DataFrame, max_words: int = 120, max_gap_ms: int = 2000) -> DataFrame:
    """Adds chunk (from 0 in a medium): a longer gap or max_words ends one."""
    order = _in_order("seq")
    far = F.col("start_ms") - F.lag("end_ms").over(order) > max_gap_ms
    w = words.withColumn("__session", F.sum(F.when(far, 1).otherwise(0)).over(order))
    nth = F.row_number().over(Window.partitionBy("media_id", "__session").orderBy("seq")) - 1
    w = w.withColumn("__first", F.when(nth % max_words == 0, 1).otherwise(0))
    return w.withColumn("chunk", F.sum("__first").over(order) - 1).drop("__session", "__first")


def align(words: DataFrame, punctuated: DataFrame, max_mismatch: float = 0.15) -> DataFrame:
    """(media_id, chunk, sentence, start_ms, end_ms, text): punctuated tokens put on the words' times.

    words: (media_id, chunk, seq, text, start_ms, end_ms); punctuated:
    (media_id, chunk, text). A token with letters or digits takes the next word;
    others and those beyond the last word take none, words beyond the last token
    are left, and sentences without a word are dropped. A chunk is one segment
    of its whole time if the number of all its tokens differs from that of its
    words by over max_mismatch of these, or if no sentence has a word; its text is
    then the punctuated one, or the words where that is null or blank or missing.

    A chunk's words and tokens are gathered in one row: chunks are bounded by
    chunk_words().
    """
    keys = ["media_id", "chunk"]
    gathered = words.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seq", "start_ms", "end_ms", "text"))).alias("w"))
    said = punctuated.groupBy(*keys).agg(F.min(T.strip(F.col("text"))).alias("said"))
    rows = gathered.join(said, keys, "left").withColumn("said", F.when(F.col("said") != "", F.col("said"))).withColumn("n", F.size("w"))
    tokens = F.transform(F.split("said", r"(?U)\s+"), lambda t: F.struct(t.alias("text"), (T.token_key(t) != "").alias("real"), T.ends_sentence(t).alias("ends")))
    rows = rows.withColumn("t", F.coalesce(tokens, F.array().cast("array<struct<text:string,real:boolean,ends:boolean>>")))

    # Sentences as places: tokens after `a` up to `b` (from 0), words after `ka` up to `kb`.
    place = "struct<a:int,b:int,ka:int,kb:int>"
    state = F.struct(F.array().cast(f"array<{place}>").alias("out"), *[F.lit(0).alias(x) for x in ("a", "b", "ka", "kb")])

    def closed(s: Column) -> Column:
        one = F.struct(*[s[x].alias(x) for x in ("a", "b", "ka", "kb")])
        return F.when(s["kb"] > s["ka"], F.concat(s["out"], F.array(one))).otherwise(s["out"])

    def step(s: Column, token: Column) -> Column:
        def after(x: Column) -> Column:
            return F.when(token["ends"], F.struct(closed(x).alias("out"), x["b"].alias("a"), x["b"].alias("b"), x["kb"].alias("ka"), x["kb"].alias("kb"))).otherwise(x)

        took = (token["real"] & (s["kb"] < F.col("n"))).cast("int")
        return T.bound(F.struct(s["out"].alias("out"), s["a"].alias("a"), (s["b"] + 1).alias("b"), s["ka"].alias("ka"), (s["kb"] + took).alias("kb")), after)

    near = F.abs(F.size("t") - F.col("n")) <= max_mismatch * F.col("n")
    rows = rows.withColumn("s", F.when(near, F.aggregate("t", state, step, closed)).otherwise(F.array().cast(f"array<{place}>")))
    words_text = F.array_join(F.transform("w", lambda w: w["text"]), " ")
    whole = F.struct(F.get("w", F.lit(0))["start_ms"].alias("start_ms"), F.element_at("w", -1)["end_ms"].alias("end_ms"), F.coalesce("said", T.strip(words_text)).alias("text"))
    aligned = F.transform("s", lambda x: F.struct(F.get("w", x["ka"])["start_ms"].alias("start_ms"), F.get("w", x["kb"] - 1)["end_ms"].alias("end_ms"), F.array_join(F.transform(F.slice("t", x["a"] + 1, x["b"] - x["a"]), lambda t: t["text"]), " ").alias("text")))
    return rows.select(*keys, F.posexplode(F.when(F.size("s") > 0, aligned).otherwise(F.array(whole))).alias("sentence", "x")).select(*keys, F.col("sentence").cast("long").alias("sentence"), "x.*")


def split_sentences(segments: DataFrame, max_chars: int = 0) -> DataFrame:
    """A row a sentence, the segment's time shared by characters; a segment of one stays as it is.

    max_chars > 0 also cuts long sentences at clause marks.
    """
    parts = T.sentence_parts(F.col("text"))
    s = segments.withColumn("p", T.soft_split(parts, max_chars) if max_chars else parts)
    s = s.withColumn("p", F.when(F.size("p") <= 1, F.array("text")).otherwise(F.col("p"))).withColumn("n", F.aggregate("p", F.lit(0), lambda a, x: a + F.length(x)))
    rows = s.select("media_id", "id", "start_ms", "end_ms", "speaker", "n", "p", F.posexplode("p").alias("k", "part"))
    before = F.aggregate(F.slice("p", 1, F.col("k")), F.lit(0), lambda a, x: a + F.length(x))
    at = lambda chars: F.col("start_ms") + F.when(F.col("n") > 0, F.floor((F.col("end_ms") - F.col("start_ms")) * chars / F.col("n"))).otherwise(0)
    cut = rows.select("media_id", "id", "k", at(before).cast("long").alias("s"), F.when(F.size("p") == 1, F.col("end_ms")).otherwise(at(before + F.length("part"))).cast("long").alias("e"), "part", "speaker")
    out = cut.select("media_id", "id", "k", F.col("s").alias("start_ms"), F.col("e").alias("end_ms"), F.col("part").alias("text"), "speaker")
    return renumber(out, "id", "k").drop("k")


def batches(segments: DataFrame, size: int = 64) -> DataFrame:
    """(media_id, batch, n, prompt): segments in groups of `size`, as numbered lines of JSON strings."""
    body = F.expr("substring(to_json(struct(text as t)), 6, length(to_json(struct(text as t))) - 6)")
    line = F.concat(F.lit("["), F.col("id") % size + 1, F.lit("]: "), body)
    g = segments.withColumn("line", line).groupBy("media_id", F.floor(F.col("id") / size).alias("batch"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list(F.struct("id", "line")))["line"], "\n").alias("prompt"))


def audio_chunks(media: DataFrame, chunk_ms: int = 600000, overlap_ms: int = 1000) -> DataFrame:
    """(media_id, chunk, offset_ms, length_ms): one chunk if it fits, else starts every chunk_ms with an overlap."""
    n = F.when(F.col("total_ms") <= chunk_ms, 1).otherwise(F.ceil(F.col("total_ms") / chunk_ms))
    c = media.select("media_id", "total_ms", F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).alias("chunk"))
    offset = F.col("chunk") * chunk_ms
    whole = F.col("total_ms") <= chunk_ms
    return c.select("media_id", "chunk", offset.alias("offset_ms"), F.when(whole, F.col("total_ms")).otherwise(F.least(F.lit(chunk_ms + overlap_ms), F.col("total_ms") - offset)).alias("length_ms"))


def stitched(chunk_segments: DataFrame, chunks: DataFrame) -> DataFrame:
    """Shifts chunks' segments to the medium's time, sorts them, and drops overlaps where a medium has several chunks."""
    many = chunks.groupBy("media_id").agg((F.count(F.lit(1)) > 1).alias("many"))
    moved = chunk_segments.join(chunks.select("media_id", "chunk", "offset_ms"), ["media_id", "chunk"])
    moved = moved.withColumn("start_ms", F.col("start_ms") + F.col("offset_ms")).withColumn("end_ms", F.col("end_ms") + F.col("offset_ms"))
    ordered = renumber(moved, "start_ms", "chunk", "id").select("media_id", "id", "start_ms", "end_ms", "text", "speaker").join(many, "media_id")
    return dedup_overlap(ordered.where("many").drop("many")).unionByName(ordered.where("not many").drop("many"))
