"""Column builders for timed text: predicates, normalisation, tags, formats and splits.

All of them are JVM expressions but soft_split, whose cuts depend on earlier cuts,
and overlap_strip and grown, whose borders take a linear pass.
Null texts give null unless a docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that recognisers invent over music and silence.
HALLUCINATION = r"(?iU)^\s*[\[\(\*]|^\s*$|\bmusic\b|\bapplause\b|\blaughter\b|\bsilence\b|\binaudible\b|\buntranscribed\b"
#: Sentence ends, fragment starts, clause marks.
SENTENCE_END = r"[.!?。！？]\s*$"
FRAGMENT_START = "^[a-z]|^[A-Z][\\s一-鿿]"
CLAUSE_MARKS = r"[,，;；、]"
BREATH_MARKS = [",", "，", ";", "；", ":", "："]
#: Words that end in a period without ending a sentence.
ABBREVIATIONS = (
    "mr. mrs. ms. dr. prof. sr. jr. st. u.s. u.s.a. u.k. e.u. etc. vs. i.e. e.g. approx. incl. cf. ca. "
    "inc. ltd. corp. co. no. vol. fig. eq. ref. ed. p.m. a.m."
).split()
#: Shapes of provider keys.
SECRETS = (r"sk-[A-Za-z0-9_-]{20,}", r"sk_[A-Za-z0-9_-]{20,}", r"\b[A-Fa-f0-9]{48,}\b")
#: Two-letter codes of the local speech model.
LOCAL_TTS_CODES = "ar bg cs da de el en es et fi fr hi hr hu id it ja ko lt lv nl pl pt ro ru sk sl sv tr uk vi".split()
MIN_DURATION_MS, MIN_CHARS, MAX_NO_SPEECH = 800, 4, 0.6


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def one_line(text: Column) -> Column:
    """White space runs become one space; stripped."""
    return F.btrim(F.regexp_replace(text, r"(?U)\s+", " "))


def is_hallucination(text: Column) -> Column:
    return text.rlike(HALLUCINATION)


def is_valid_segment(text: Column, start_ms: Column, end_ms: Column, no_speech: Column) -> Column:
    """Keeps recogniser segments that are long, textual and likely speech. Null text is empty, null probability 0."""
    t = strip(F.coalesce(text, F.lit("")))
    return (F.length(t) >= MIN_CHARS) & (end_ms - start_ms >= MIN_DURATION_MS) & (F.coalesce(no_speech, F.lit(0.0)) <= MAX_NO_SPEECH) & ~is_hallucination(t)


def ends_sentence_simple(text: Column) -> Column:
    return text.rlike(SENTENCE_END)


def ends_sentence(word: Column) -> Column:
    """A terminal mark that is no abbreviation's period."""
    w = F.regexp_replace(word, r"(?U)\s+$", "")
    last = F.element_at(F.split(F.lower(w), r"(?U)\s+"), -1)
    return F.when(w.rlike(r"[!?。！？]$"), True).when(w.rlike(r"\.$"), ~last.isin(*ABBREVIATIONS)).otherwise(False)


def is_fragment(text: Column) -> Column:
    """Starts like the middle of a sentence: a-z, or one A-Z before white space or a Han character."""
    return strip(text).rlike(FRAGMENT_START)


#: Letters whose case folding is not their lower case: one letter for one by rule, and the Latin ones that fold to several.
FOLDED = {c: f for c in map(chr, range(0x80, 0x2000)) if len(f := c.casefold()) == 1 and f != c.lower()}
UNFOLDED = {c: c.casefold() for c in "ßẞŉﬀﬁﬂﬃﬄﬅﬆ"}


def casefold(text: Column) -> Column:
    """Case is ignored as by Unicode case folding, for letters below U+2000 and Latin ligatures."""
    out = F.translate(F.lower(text), "".join(FOLDED), "".join(FOLDED.values()))
    plain = out
    for c, several in UNFOLDED.items():
        out = F.replace(out, F.lit(c), F.lit(several))
    return F.when(plain.rlike("[" + "".join(UNFOLDED) + "]"), out).otherwise(plain)


def token_key(token: Column) -> Column:
    """A token without punctuation at its ends, case-folded."""
    return casefold(F.regexp_replace(F.regexp_replace(token, r"(?U)^[\W_]+", ""), r"(?U)[\W_]+$", ""))


def redact(text: Column) -> Column:
    for shape in SECRETS:
        text = F.regexp_replace(text, shape, "***")
    return text


def ssml(text: Column, speed: Column, emotion: Column) -> Column:
    """Speed and emotion tags before the text; a null option has no tag."""
    tag = lambda value, before, after: F.when(value.isNotNull(), F.concat(F.lit(before), value.cast("string"), F.lit(after))).otherwise("")
    return F.concat(tag(speed, '<speed ratio="', '"/> '), tag(emotion, '<emotion value="', '"/> '), text)


def tail_silence_ms(text: Column, sentence_ms: int | None = 250, other_ms: int = 120) -> Column:
    return F.when(ends_sentence_simple(text), F.lit(other_ms if sentence_ms is None else sentence_ms)).otherwise(F.lit(other_ms))


def breath_tag(text: Column, min_chars: int = 90) -> Column:
    """One ``<breath>`` after the mark nearest the middle of a long text, unless a tag follows there."""
    n = F.length(text)
    marks = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(text, i, F.lit(1)).isin(*BREATH_MARKS))
    # Twice the distance to the middle stays whole; of equal ones the first.
    at = F.array_min(F.transform(marks, lambda i: F.struct(F.abs(2 * i - n).alias("d"), i.alias("i"))))["i"]
    rest = F.substring(text, at + 1, n)
    tagged = F.concat(F.substring(text, F.lit(1), at), F.lit(" <breath>"), rest)
    return F.when((n >= min_chars) & at.isNotNull() & ~F.coalesce(rest.rlike(r"(?U)^\s*<"), F.lit(False)), tagged).otherwise(text)


def clamped_speed(speed: Column, provider: str) -> Column:
    """A provider's admissible speed: the local model clamps, hosted ones drop a value out of range."""
    if provider == "supertonic":
        return F.greatest(F.lit(0.7), F.least(F.lit(2.0), speed))
    low, high = {"elevenlabs": (0.7, 1.2), "openai": (0.25, 4.0)}[provider]
    return F.when(speed.between(low, high), speed)


def local_tts_code(language: Column) -> Column:
    code = F.substring(F.lower(F.when(F.coalesce(language, F.lit("")) == "", F.lit("en")).otherwise(language)), 1, 2)
    return F.when(code.isin(*LOCAL_TTS_CODES), code).otherwise(F.lit("na"))


def source_language(explicit_code: Column, explicit: Column, info_language: Column) -> Column:
    """The stated language's code unless it is ``auto-detect``, else the media's up to its dash, else null."""
    found = F.when(F.coalesce(info_language, F.lit("")) != "", F.substring_index(info_language, "-", 1))
    return F.when(explicit.isNotNull() & (F.lower(explicit) != "auto-detect"), explicit_code).otherwise(found)


def subtitle_formats(value: Column, burn: Column) -> Column:
    """Distinct formats in order; ``srt`` if none, and first if subtitles are burnt in."""
    cleaned = F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ","), lambda x: F.lower(strip(x))), lambda x: x != "")
    some = F.when(F.size(cleaned) == 0, F.array(F.lit("srt"))).otherwise(cleaned)
    with_burn = F.when(burn & ~F.array_contains(some, "srt"), F.concat(F.array(F.lit("srt")), some)).otherwise(some)
    return F.array_distinct(with_burn)


def unknown_formats(formats: Column) -> Column:
    return F.array_except(formats, F.array(*map(F.lit, ("srt", "vtt", "txt"))))


def client_ip(forwarded: Column, peer: Column) -> Column:
    first = F.btrim(F.split(forwarded, ",")[0])
    return F.coalesce(F.when(first != "", first), peer, F.lit("unknown"))


def is_rate_limit(status: Column, message: Column) -> Column:
    return F.coalesce(status == 429, F.lit(False)) | F.coalesce(F.lower(message).rlike("429|rate_limit|rate limit"), F.lit(False))


def tempo_chain(speed: Column) -> Column:
    """Factors within 0.5..2 whose product is the speed: twos or halves first, the rest last."""
    up = F.greatest(F.ceil(F.log2(speed)) - 1, F.lit(0)).cast("int")
    down = F.greatest(F.ceil(-F.log2(speed)) - 1, F.lit(0)).cast("int")
    peeled = F.concat(F.array_repeat(F.lit(2.0), up), F.array_repeat(F.lit(0.5), down))
    return F.concat(peeled, F.array(speed * F.pow(F.lit(2.0), down) / F.pow(F.lit(2.0), up)))


def bound(value: Column, use) -> Column:
    """use(x) with x standing for value, which is evaluated once."""
    return F.transform(F.array(value), use)[0]


#: Unicode white space, as (?U)\s has it.
WHITE = " \t\n\x0b\x0c\r\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def border(before: str, after: str) -> int:
    """The length of the longest beginning of `after` that ends `before`, in time linear in the shorter one.

    By the prefix function of `after`: how far a beginning is matched is carried
    along `before`, and on a mismatch falls back to the next shorter border.
    """
    n = min(len(before), len(after))
    if not n:
        return 0
    fall, k = [0] * n, 0
    for i in range(1, n):
        while k and after[i] != after[k]:
            k = fall[k - 1]
        k += after[i] == after[k]
        fall[i] = k
    k = 0
    for c in before[len(before) - n :]:
        if k == n:
            k = fall[k - 1]
        while k and c != after[k]:
            k = fall[k - 1]
        k += c == after[k]
    return k


def without_overlap(before: str, fragment: str) -> str:
    """The fragment without the longest prefix (two characters or more, case aside) that ends the text before it; whole if nothing else is left."""
    at_end = "\n" if before.endswith("\n") else ""
    said = (before[: len(before) - len(at_end)].rstrip(".!?。！？ ") or "") + at_end
    start = fragment.lstrip(WHITE)
    low = lambda text: "".join(c.lower() if len(c.lower()) == 1 else c for c in text)  # noqa: E731  a letter for a letter
    n = border(low(said[-len(start) :] if start else ""), low(start))
    left = start[n:].lstrip(" ,，;；") if n >= 2 else ""
    return left if left.strip(WHITE) else fragment


def overlap_strip(previous: Column, fragment: Column) -> Column:
    """without_overlap() row by row; a null text before overlaps nothing."""

    @F.pandas_udf("string")
    def strip_all(before, after):
        import pandas as pd

        return pd.Series([f if p is None or f is None else without_overlap(p, f) for p, f in zip(before, after)], dtype=object)

    return strip_all(previous, fragment)


def grown(parts: Column) -> Column:
    """The text of a merged segment from its rows in order, an array of (t, frag, blank): fragments lose what was said, blank texts add nothing."""

    @F.pandas_udf("string")
    def join_all(column):
        import pandas as pd

        def one(rows):
            text = rows[0]["t"]
            for r in rows[1:]:
                if not r["blank"]:
                    text = f"{text or ''} {without_overlap(text or '', r['t']) if r['frag'] else r['t']}".strip(WHITE)
            return text

        return pd.Series([one(rows) for rows in column], dtype=object)

    return join_all(parts)


def clock(ms: Column, mark: str = ",") -> Column:
    """HH:MM:SS and the millis after the mark, from whole milliseconds."""
    s = F.floor(ms / 1000)
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", F.floor(s / 3600), F.pmod(F.floor(s / 60), F.lit(60)), F.pmod(s, F.lit(60)), F.pmod(ms, F.lit(1000)))


CLOCK = r"(\d+):(\d{2}):(\d{2})[,.](\d{1,3})\s*-->\s*(\d+):(\d{2}):(\d{2})[,.](\d{1,3})"


def clock_ms(line: Column, first: int) -> Column:
    """Milliseconds of the time in groups first..first+3 of CLOCK; null without a match."""
    part = lambda k: F.regexp_extract(line, CLOCK, first + k).try_cast("bigint")
    return part(0) * 3600000 + part(1) * 60000 + part(2) * 1000 + part(3)


def duration_seconds(report: Column) -> Column:
    """Seconds of ``Duration: H:M:S`` in a media tool's report; null without it."""
    shape = r"Duration:\s*(\d+):(\d+):(\d+(?:\.\d+)?)"
    part = lambda k: F.regexp_extract(report, shape, k).try_cast("double")
    return part(1) * 3600 + part(2) * 60 + part(3)


def media_seconds(frames: Column, rate: Column, report: Column) -> Column:
    """A header's frames by its rate, else the report's duration."""
    return F.coalesce(F.try_divide(frames.cast("double"), rate.cast("double")), duration_seconds(report))


def frame_rate(report: Column, default: float = 30.0) -> Column:
    return F.coalesce(F.regexp_extract(report, r"(\d+(?:\.\d+)?)\s*fps", 1).try_cast("double"), F.lit(default))


def filled(template: str, values: dict[str, Column]) -> Column:
    """``{name}`` replaced by columns; unknown names stay, doubled braces become one."""
    text = F.replace(F.replace(F.lit(template.strip()), F.lit("{{"), F.lit("\x01")), F.lit("}}"), F.lit("\x02"))
    for name, value in values.items():
        text = F.replace(text, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("None")))
    return F.replace(F.replace(text, F.lit("\x01"), F.lit("{")), F.lit("\x02"), F.lit("}"))


def sentence_parts(text: Column) -> Column:
    """Sentences of a text, stripped. A period between word characters is none's end.

    What the pattern skips (a period before a digit) is kept: the rest starts
    after the last match's place, not after the matches' total length.
    """
    word = r"[\p{L}\p{N}_]"
    safe = F.regexp_replace(text, rf"(?<={word})\.(?={word})", "\x00")
    found = F.regexp_extract_all(safe, F.lit(r"([^.!?。！？]*(?:[.!?。！？]+\d[^.!?。！？]*)*[.!?。！？]+(?!\d)\s*|[^.!?。！？]+$)"), F.lit(1))
    return F.filter(F.transform(found, lambda p: strip(F.replace(p, F.lit("\x00"), F.lit(".")))), lambda p: p != "")


def soft_split(parts: Column, max_chars: int) -> Column:
    """Cuts each part over max_chars at the clause mark nearest its middle, and the halves again."""

    @F.pandas_udf("array<string>")
    def split(column):
        import re

        import pandas as pd

        marks = re.compile(CLAUSE_MARKS)

        def halves(text: str) -> list[str]:
            done, todo = [], [text]
            while todo:
                t = todo.pop()
                ends = [m.end() for m in marks.finditer(t)] if len(t) > max_chars else []
                cut = min(ends, key=lambda e: abs(2 * e - len(t)), default=None)
                left, right = (t[:cut].rstrip(), t[cut:].lstrip()) if cut else ("", "")
                if left and right:
                    todo += [right, left]
                else:
                    done.append(t)
            return done

        return pd.Series([None if row is None else [x for p in row for x in halves(p)] for row in column], dtype=object)

    return split(parts)
