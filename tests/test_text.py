"""Column builders on literal edge rows."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cueloom.functions import catalogs
from cueloom.functions import text as T


def values(spark, texts, build, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], f"i int, x {kind}")
    return [r.y for r in df.select("i", build(F.col("x")).alias("y")).orderBy("i").collect()]


def test_sentence_ends(spark):
    words = ["Mr.", "U.S.", "etc.", "end.", "好。", "what?", "wait…", "x", "so, etc.", None]
    assert values(spark, words, T.ends_sentence) == [False, False, False, True, True, True, False, False, False, False]


def test_fragments(spark):
    assert values(spark, ["b model", "B model", "Because", "好", " x", "B好"], T.is_fragment) == [True, True, False, False, True, True]


def test_validity(spark):
    rows = [("fine text", 0, 800, None), ("fine text", 0, 790, None), ("abc", 0, 900, None), ("abcd", 0, 900, 0.6), ("abcd", 0, 900, 0.61), ("[music]", 0, 900, 0.0), ("(x) hello", 0, 900, 0.0), ("great music today", 0, 900, 0.0), ("", 0, 900, 0.0), (None, 0, 900, 0.0), ("musical evening", 0, 900, 0.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, s long, e long, p double")
    got = [r.y for r in df.select("i", T.is_valid_segment(F.col("t"), F.col("s"), F.col("e"), F.col("p")).alias("y")).orderBy("i").collect()]
    assert got == [True, False, False, True, False, False, False, False, False, False, True]


def test_redaction(spark):
    texts = ["a sk-" + "x" * 20 + " b", "sk_" + "y" * 25, "0aF" * 16, "a" * 47, "sk-" + "x" * 19]
    assert values(spark, texts, T.redact) == ["a *** b", "***", "***", "a" * 47, "sk-" + "x" * 19]


def test_overlap_strip(spark):
    df = spark.createDataFrame([("it has the 120B.", "B model"), ("with the 120 b model.", "b model is"), ("the end", "end"), ("abc", "xyz"), ("say hello", "hello, world")], "p string, f string")
    assert [r.y for r in df.select(T.overlap_strip(F.col("p"), F.col("f")).alias("y")).collect()] == ["B model", "is", "end", "xyz", "world"]


def test_tokens_and_codes(spark):
    assert values(spark, ["«Hello»,", "--", "it's", "_x_", "Straße!", "ΟΔΟΣ"], T.token_key) == ["hello", "", "it's", "x", "strasse", "οδοσ"]
    folded = ["ŒUVRE", "ﬁn", "ıI", "ΣΑΣ", "Ǆ"]
    assert values(spark, folded, T.casefold) == [x.casefold() for x in folded]
    assert values(spark, ["English", "ENGLISH", "Klingon", "zh"], catalogs.language_code) == ["en", "en", "kl", "zh"]
    assert values(spark, ["English", "zh", "", None], T.local_tts_code) == ["en", "na", "en", "en"]


def test_formats(spark):
    pick = lambda burn: lambda c: T.subtitle_formats(c, F.lit(burn))
    assert values(spark, ["vtt, TXT,vtt", "", None], pick(False)) == [["vtt", "txt"], ["srt"], ["srt"]]
    assert values(spark, ["vtt"], pick(True)) == [["srt", "vtt"]]
    assert values(spark, ["vtt,doc"], lambda c: T.unknown_formats(T.subtitle_formats(c, F.lit(False)))) == [["doc"]]


def test_tempo(spark):
    for speed, chain in zip([0.5, 2.0, 2.5, 0.2, 8.0, 1.0], values(spark, [0.5, 2.0, 2.5, 0.2, 8.0, 1.0], T.tempo_chain, "double")):
        product = 1.0
        for f in chain:
            assert 0.5 <= f <= 2.0
            product *= f
        assert abs(product - speed) < 1e-9


def test_clock(spark):
    assert values(spark, [0, 1001, 3723004], lambda c: T.clock(c), "long") == ["00:00:00,000", "00:00:01,001", "01:02:03,004"]
    assert values(spark, ["Duration: 01:02:03.5, start", "none"], T.duration_seconds) == [3723.5, None]
    assert values(spark, ["h264, 29.97 fps", "x"], T.frame_rate) == [29.97, 30.0]


def test_tags(spark):
    long = "a" * 44 + ", " + "b" * 44 + ", c"
    assert values(spark, [long, "short, text", "a" * 100], T.breath_tag) == ["a" * 44 + ", <breath> " + "b" * 44 + ", c", "short, text", "a" * 100]
    assert values(spark, ["Hi."], lambda c: T.ssml(c, F.lit(None).cast("double"), F.lit("calm"))) == ['<emotion value="calm"/> Hi.']


def test_filled(spark):
    assert values(spark, ["X"], lambda c: T.filled("Say {what} to {whom} {{now}}", {"what": c})) == ["Say X to {whom} {now}"]


def test_sentence_parts(spark):
    texts = ["v2.0 is out. Next.", "no mark", "A?! B", "", "a .5 b.", "好。再见！"]
    assert values(spark, texts, T.sentence_parts) == [["v2.0 is out.", "Next."], ["no mark"], ["A?!", "B"], [], ["a .5 b."], ["好。", "再见！"]]


def test_soft_split_keeps_text(spark):
    texts = ["one, two, three, four, five, six", "，".join("字" * 9 for _ in range(4)), "nothing to cut here at all really", ",,,"]
    for text, parts in zip(texts, values(spark, [[t] for t in texts], lambda c: T.soft_split(c, 20), "array<string>")):
        assert re.sub(r"\s", "", "".join(parts)) == re.sub(r"\s", "", text)
        assert all(len(p) <= 20 or not re.search("[,，;；、]", p[:-1]) for p in parts)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text("aB .,!?。\n", max_size=12), min_size=1, max_size=20))
def test_strip_and_one_line(spark, texts):
    assert values(spark, texts, T.strip) == [t.strip() for t in texts]
    assert values(spark, texts, T.one_line) == [re.sub(r"\s+", " ", t).strip() for t in texts]


def test_borders():
    """Against every length tried; long and periodic texts take linear time."""
    import random
    import time

    r = random.Random(3)
    for _ in range(3000):
        a, b = ("".join(r.choices("ab", k=r.randrange(9))) for _ in range(2))
        assert T.border(a, b) == max(n for n in range(min(len(a), len(b)) + 1) if a.endswith(b[:n]))
    n = 100_000
    began = time.perf_counter()
    assert T.border("a" * n, "a" * n) == n and T.border("a" * n + "b", "a" * n) == 0 and T.border("ab" * n, "ba" * n) == 2 * n - 1
    text = "".join(r.choices("abcdefgh ", k=n))
    assert T.without_overlap("Well. " + text + ". ", text.upper() + ", and more") == "and more"
    assert time.perf_counter() - began < 5
