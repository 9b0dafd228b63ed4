"""Quality rules as a short-circuit cascade.

Each rule is a boolean column that is true for a text to reject. On a sample of
about SAMPLE_ROWS rows, drawn over the whole table, each rule's share of
rejected rows and its time are measured; the rules are put in the order of
rejection per cost and become one CASE expression, whose later rules run only on
rows that no earlier one rejected. The base (too few words, too many in repeated
windows) is two rules among the others. The order changes the time alone: a text
is kept if no rule rejects it.

`kept` computes in each rule what that rule needs and nothing else. `judge` also
returns FEATURES of every row, so there the rules read what is computed already.

All of it is DataFrame expressions; nothing is shuffled. The sample costs a scan
of the text column and a count.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, WORD_CLASS, fresh, own

#: Rows of the sample (twice as many at most), its seed, and how often it is repeated so that its time can be read.
SAMPLE_ROWS = 256
SAMPLE_SEED = 17
REPEATS = 4
WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED = 20
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def bound(value: Column, use) -> Column:
    """use(x) with x standing for value, which is evaluated once."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    """The words of a text that isn't null; texts of spaces and line feeds alone are cut without a pattern."""
    plain = F.flatten(F.transform(F.split(text, "\n"), lambda line: F.split(line, " ")))
    return F.array_remove(F.when(text.rlike(r"[\x09\x0B-\x0D]"), F.split(text, f"{SPACE_CLASS}+")).otherwise(plain), "")


def window_hashes(words: Column, n: Column, window: int = WINDOW) -> Column:
    """64 bits for each of the n - window + 1 runs of words, from two shorter runs that make it up and may overlap."""

    def longer(h: Column, size: int) -> Column:
        if size == window:
            return F.slice(h, 1, n - window + 1)
        step = min(size, window - size)
        return longer_of(F.zip_with(h, F.slice(h, step + 1, n), lambda x, y: F.xxhash64(x, y)), size + step)

    def longer_of(h: Column, size: int) -> Column:
        return bound(h, lambda x: longer(x, size))

    return longer_of(F.transform(words, lambda w: F.xxhash64(w)), 1)


def _covered(hashes: Column, window: int) -> Column:
    """Words that the windows standing twice cover."""
    ordered = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def starts(s: Column) -> Column:
        twice = F.filter(s, lambda e, k: (e["h"] == F.get(s, k - 1)["h"]) | (e["h"] == F.get(s, k + 1)["h"]))
        return F.sort_array(F.transform(twice, lambda e: e["i"]))

    first = F.struct(F.lit(0).alias("total"), F.lit(-window).alias("last"))
    step = lambda acc, x: F.struct((acc["total"] + F.least(F.lit(window), x - acc["last"])).alias("total"), x.alias("last"))
    return F.aggregate(bound(ordered, starts), first, step, lambda acc: acc["total"])


def repeated_words(words: Column, n: Column, window: int = WINDOW, over: int = 0) -> Column:
    """Words in windows of `window` words found twice or more; windows are told apart by 64-bit hashes.

    With `over`, a number of at most `over` percent of n may come back as 0. A
    window class of c > 1 members has c <= 2 * (c - 1), so `windows - distinct`
    bounds the members, and `window` times that the words: most texts need no sort.
    """

    def count(h: Column) -> Column:
        extra = F.size(h) - F.size(F.array_distinct(h))
        return bound(extra, lambda x: F.when(100 * 2 * window * x <= over * n, F.lit(0)).otherwise(_covered(h, window)))

    return F.when(n > window, bound(window_hashes(words, n, window), count)).otherwise(F.lit(0))


def measures(text: Column, words: Column, over: int = 0) -> dict[str, Column]:
    """What the rules read, as expressions over a text that isn't null and its words."""
    n = F.size(words)
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD_CLASS))
    return {
        "n_words": n,
        "word_chars": F.length(F.array_join(words, "")),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")),
        "n_dup_lines": bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_lines": F.size(lines),
        "n_repeat_words": repeated_words(words, n, over=over),
    }


def rules(m: dict[str, Column], text: Column, words: Column) -> dict[str, Column]:
    """The verdict's rules over measures(); true rejects. All thresholds but the number of words are shares."""
    n = m["n_words"]
    upper = F.length(F.regexp_replace(text, r"\P{Lu}+", ""))
    letters = F.length(text) - F.length(F.regexp_replace(text, r"\p{L}+", ""))
    same = F.filter(F.zip_with(words, F.slice(words, 2, F.greatest(n, F.lit(1))), lambda a, b: a == b), lambda x: x)
    return {
        "few_words": n < MIN_WORDS,
        "repetition": 100 * m["n_repeat_words"] > MAX_REPEATED * n,
        "symbols": 10 * m["n_symbols"] > n,
        "word_length": bound(m["word_chars"], lambda c: (2 * c < 5 * n) | (c > 12 * n)),
        "repeated_lines": 2 * m["n_dup_lines"] > m["n_lines"],
        "few_letters": 10 * F.size(F.filter(words, lambda w: w.rlike(r"\p{L}"))) < 7 * n,
        "upper_case": bound(upper, lambda u: F.when(u == 0, F.lit(False)).otherwise(10 * u > 6 * letters)),
        "stuttering": 10 * F.size(same) > 3 * n,
    }


def sampled(df: DataFrame, text_col: str, rows: int) -> DataFrame:
    """(text), about `rows` rows (twice as many at most) drawn over the whole table; one partition, on an executor."""
    text = df.select(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    n = df.count()
    drawn = text.sample(rows / n, SAMPLE_SEED) if n > rows else text
    return drawn.limit(2 * rows)


def cost_and_selectivity(sample: DataFrame, checks: dict[str, Column]) -> dict[str, tuple[float, float]]:
    """name -> (seconds on the sample, share that it rejects)."""
    held = sample.withColumn("__k", F.explode(F.sequence(F.lit(1), F.lit(REPEATS)))).coalesce(1).persist()
    try:
        held.count()
        out = {}
        for name, reject in checks.items():
            best, share = None, 0.0
            for _ in range(2):
                began = time.perf_counter()
                share = held.agg(F.avg(reject.cast("double"))).first()[0] or 0.0
                took = time.perf_counter() - began
                best = took if best is None else min(best, took)
            out[name] = (best, share)
        return out
    finally:
        held.unpersist()


def ordered(measured: dict[str, tuple[float, float]]) -> list[str]:
    """Names by rejection per cost, highest first; of equals the cheaper one first."""
    return sorted(measured, key=lambda k: (-measured[k][1] / max(measured[k][0], 1e-6), measured[k][0], k))


def cascade(checks: dict[str, Column], order: list[str]) -> Column:
    """The name of the first rule in order that rejects the row, else null."""
    out = F.lit(None).cast("string")
    for name in reversed(order):
        out = F.when(F.coalesce(checks[name], F.lit(False)), F.lit(name)).otherwise(out)
    return out


def rejected_by(text: Column, order: list[str]) -> Column:
    """cascade() in that order as one expression over a text; a null text is empty."""

    def of_text(t: Column) -> Column:
        return bound(words_of(t), lambda w: cascade(rules(measures(t, w, MAX_REPEATED), t, w), order))

    return bound(F.coalesce(text.cast("string"), F.lit("")), of_text)


def kept(df: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of df that judge() would keep, with their columns alone.

    Null, empty and blank texts go, very long ones are judged whole. Repeated rows
    agree. No column is added, so none clashes. An empty table gives none.
    """
    text, words = F.col("text"), F.col("words")
    sample = sampled(df, text_col, sample_rows).select("text", words_of(text).alias("words"))
    order = ordered(cost_and_selectivity(sample, rules(measures(text, words, MAX_REPEATED), text, words)))
    return df.where(rejected_by(F.col(f"`{text_col}`"), order).isNull())


def judge(df: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """df with FEATURES (long), base_failed, rejected_by and kept.

    base_failed: under MIN_WORDS words, or over MAX_REPEATED percent of them in
    repeated windows. kept: no rule of rules(), these two among them, rejects
    it; rejected_by names the first one in the measured order, which follows times
    and may differ between runs where several rules reject (kept does not).

    Null, empty and blank texts have no words and fail the base. Each row is
    judged by its own whole text, however long, so repeated rows agree. Other
    columns pass through, whatever their names; columns with the names above are
    replaced. An empty table gives none.
    """
    df = own(df, *FEATURES, "base_failed", "rejected_by", "kept")
    work, row = fresh(df, "work", "row")

    def with_features(rows: DataFrame, text: Column) -> DataFrame:
        base = rows.withColumn(work, F.struct(text.alias("text"), words_of(text).alias("words")))
        made = measures(F.col(f"{work}.text"), F.col(f"{work}.words"))
        # The row's number isn't deterministic on purpose: a filter on what follows must not be pushed below
        # this projection, where the optimizer would write every measure out once a use.
        return base.select("*", F.monotonically_increasing_id().alias(row), *[made[k].cast("long").alias(k) for k in FEATURES])

    def checks() -> dict[str, Column]:
        text, words = F.col(f"{work}.text"), F.col(f"{work}.words")
        return rules({"n_lines": measures(text, words)["n_lines"]} | {k: F.col(k) for k in FEATURES}, text, words)

    order = ordered(cost_and_selectivity(with_features(sampled(df, text_col, sample_rows), F.col("text")), checks()))
    out = with_features(df, F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    base = checks()["few_words"] | checks()["repetition"]
    out = out.withColumn("base_failed", base).withColumn("rejected_by", F.when(F.col(row) >= 0, cascade(checks(), order)))
    return out.withColumn("kept", F.col("rejected_by").isNull()).drop(work, row)
