"""Providers of recognition, translation and speech: plain functions, called a batch at a time.

The fakes are deterministic and offline. Results of real ones aren't repeatable,
so what uses an answer twice writes it first (storage.written).
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of a voice catalog at most: all of them go to the model and to each task.
MAX_NAMES = 10_000
Batch = Callable[[list[str]], list[str] | None]
#: Seconds before a repeated call of recognition.
RECOGNITION_WAITS = (5, 15, 30)


def upper_translator(texts: list[str]) -> list[str]:
    return [t.upper() for t in texts]


def attempted(call: Callable, *args, attempts: int = 3, waits: Sequence[float] | Callable[[int], float] = lambda k: 2.0**k, accept: Callable = lambda x: True, sleep: Callable[[float], None] = time.sleep):
    """call(*args), repeated after an exception or an answer that isn't accepted.

    Before repetition k = 1, 2, ... it waits waits(k), or waits[k - 1] (the last
    one again and again). The last exception is raised; a last answer that isn't
    accepted gives None.
    """
    for k in range(1, attempts + 1):
        try:
            found = call(*args)
            if accept(found):
                return found
        except Exception:  # noqa: BLE001  whatever a remote call raises
            if k == attempts:
                raise
        if k < attempts:
            sleep(waits(k) if callable(waits) else waits[min(k, len(waits)) - 1])
    return None


def batch_of(n: int) -> Callable:
    """Whether an answer is a list of n texts."""
    return lambda found: isinstance(found, (list, tuple)) and len(found) == n and all(isinstance(x, str) for x in found)


def halving(call: Batch, single: Callable[[str], str], texts: list[str]) -> list[str]:
    """A batch's answers; a refused or miscounted batch is halved, a refused single text goes to `single`."""
    try:
        found = call(texts)
    except Exception:  # noqa: BLE001  any failure of a remote call means: try smaller
        found = None
    if batch_of(len(texts))(found):
        return list(found)
    if len(texts) == 1:
        return [single(texts[0])]
    mid = len(texts) // 2
    return halving(call, single, texts[:mid]) + halving(call, single, texts[mid:])


def translate(segments: DataFrame, call: Batch = upper_translator, single: Callable[[str], str] | None = None, batch: int = 64, preserve_speaker: bool = False, retries: int = 3, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """Segments with translated texts. Batches are a medium's runs of `batch` ids; by default speakers are reset.

    A batch is asked for up to `retries` times, 2, 4, ... seconds apart, until its
    answer has a text for each of its own; then it is halved.
    """
    asked = lambda texts: attempted(call, texts, attempts=retries, accept=batch_of(len(texts)), sleep=sleep)
    one = single or (lambda t: (asked([t]) or [t])[0])

    def run(frames):
        for f in frames:
            texts, keys = f["text"].tolist(), list(zip(f["media_id"], f["id"] // batch))
            starts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
            f["text"] = [y for a, b in zip(starts, [*starts[1:], len(keys)]) for y in halving(asked, one, texts[a:b])]
            yield f

    keyed = segments.withColumn("__batch", F.floor(F.col("id") / batch))
    dealt = keyed.repartition("media_id", "__batch").sortWithinPartitions("media_id", "__batch", "id").drop("__batch")
    out = dealt.mapInPandas(run, dealt.schema)
    return out if preserve_speaker else out.withColumn("speaker", F.lit("SPEAKER_00"))


def synthesize(segments: DataFrame, voice_map: DataFrame | None, default_voice: str, ms_per_char: int = 60) -> DataFrame:
    """(media_id, id, voice, tts_ms, characters) of the offline voice: its length follows the text and its tail silence.

    voice_map: (speaker, voice), one row a speaker.
    """
    from .text import tail_silence_ms

    s = speaker_voices(segments, voice_map, default_voice)
    n = F.length("text")
    return s.select("media_id", "id", "voice", (n * ms_per_char + tail_silence_ms(F.col("text"))).cast("long").alias("tts_ms"), n.alias("characters"))


def is_rate_limit(error: BaseException) -> bool:
    text = str(error).lower()
    return getattr(error, "status_code", None) == 429 or any(x in text for x in ("429", "rate_limit", "rate limit"))


def speaker_voices(segments: DataFrame, voice_map: DataFrame | None, default_voice: str) -> DataFrame:
    """Segments with the voice of their speaker, else the default one. voice_map: (speaker, voice), one row a speaker."""
    s = segments.join(voice_map, "speaker", "left") if voice_map is not None else segments.withColumn("voice", F.lit(None).cast("string"))
    return s.withColumn("voice", F.coalesce("voice", F.lit(default_voice)))


def speak(segments: DataFrame, call: Callable[[str, str], int], default_voice: str, voice_map: DataFrame | None = None, speed: Column | None = None, emotion: Column | None = None, workers: int = 8, retries: int = 5, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(media_id, id, voice, file, tts_ms, characters) of a speech provider; call(text with tags, voice) gives a length in milliseconds.

    `workers` tasks call at a time. A call that meets a rate limit is left for
    the end of its task and repeated there one by one, 1, 2, 4, ... seconds apart.
    What fails for good, then or otherwise, is a row without a length and with its
    error, so that one bad call doesn't make Spark repeat the paid calls of a whole
    task; see unspoken(). Files are named by medium. Characters are those of the
    untagged text.
    """
    from .text import ssml

    none = F.lit(None).cast("string")
    s = speaker_voices(segments, voice_map, default_voice)
    s = s.select("media_id", "id", "voice", ssml(F.col("text"), none if speed is None else speed, none if emotion is None else emotion).alias("tagged"), F.length("text").cast("long").alias("characters"))

    def run(frames):
        import pandas as pd

        def row(r, length, error=None):
            return (r.media_id, r.id, r.voice, None if error else f"{r.media_id}/seg_{r.id:05d}.wav", length, r.characters, error)

        def table(rows):
            out = pd.DataFrame(rows, columns=["media_id", "id", "voice", "file", "tts_ms", "characters", "error"])
            return out.astype({"tts_ms": "Int64"})

        late = []
        for f in frames:
            rows = []
            for r in f.itertuples(index=False):
                try:
                    rows.append(row(r, call(r.tagged, r.voice)))
                except Exception as e:  # noqa: BLE001  the provider's own classes
                    if is_rate_limit(e):
                        late.append(r)
                    else:
                        rows.append(row(r, None, str(e) or type(e).__name__))
            yield table(rows)
        again = []
        for r in late:
            try:
                again.append(row(r, attempted(call, r.tagged, r.voice, attempts=retries, waits=lambda k: 2.0 ** (k - 1), sleep=sleep)))
            except Exception as e:  # noqa: BLE001
                again.append(row(r, None, str(e) or type(e).__name__))
        yield table(again)

    return s.repartition(workers, "media_id", "id").mapInPandas(run, "media_id long, id long, voice string, file string, tts_ms long, characters long, error string")


def unspoken(rows: DataFrame) -> DataFrame:
    """The segments of speak() that failed for good, to be asked for again or to fail the run."""
    return rows.where("error is not null")


def recognise(media: DataFrame, call: Callable[[str], list[dict]], retries: int = 3, sleep: Callable[[float], None] = time.sleep, keys: tuple[str, ...] = ("media_id",)) -> DataFrame:
    """(media_id, id, start_ms, end_ms, text, no_speech_prob): `call` gives a path's segments; it is tried up to `retries` times.

    media: (media_id, path); keys: the columns (longs) that name what is recognised.
    What keeps failing fails its task, and Spark tries that again.
    """

    def run(frames):
        import pandas as pd

        cols = [*keys, "id", "start_ms", "end_ms", "text", "no_speech_prob"]
        for f in frames:
            rows = []
            for *key, path in zip(*[f[k] for k in keys], f["path"]):
                found = attempted(call, path, attempts=retries, waits=RECOGNITION_WAITS, sleep=sleep)
                rows += [(*key, i, s["start_ms"], s["end_ms"], s["text"], s.get("no_speech_prob")) for i, s in enumerate(found)]
            yield pd.DataFrame(rows, columns=cols)

    return media.select(*keys, "path").mapInPandas(run, ", ".join(f"{k} long" for k in keys) + ", id long, start_ms long, end_ms long, text string, no_speech_prob double")


def recognise_chunks(chunks: DataFrame, call: Callable[[str], list[dict]], retries: int = 3, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """A medium's segments from its audio chunks (media_id, chunk, offset_ms, path), recognised apart and stitched together."""
    from ..operators.segments import stitched

    from ..storage import written

    # Stitching reads the answers more than once, and chunks may come from a costly plan: both are written, and a chunk is asked for once.
    chunks = written(chunks.select("media_id", "chunk", "offset_ms", "path"), "chunks")
    rows = written(recognise(chunks, call, retries, sleep, ("media_id", "chunk")), "recognised").drop("no_speech_prob").withColumn("speaker", F.lit("SPEAKER_00"))
    return stitched(rows, chunks.select("media_id", "chunk", "offset_ms"))


def answered(prompts: DataFrame, call: Callable[[str], str], retries: int = 1, accept: Callable = lambda x: True, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """prompts with `answer`: call(prompt), repeated until accepted; null if it never is or keeps failing."""

    def run(frames):
        for f in frames:
            out = []
            for p in f["prompt"]:
                try:
                    out.append(attempted(call, p, attempts=retries, waits=(0.0,), accept=accept, sleep=sleep))
                except Exception:  # noqa: BLE001  whatever a remote call raises
                    out.append(None)
            f["answer"] = out
            yield f

    fields = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in prompts.schema)
    return prompts.mapInPandas(run, f"{fields}, answer string")


def match_voice(requests: DataFrame, table: DataFrame, template: str, call: Callable[[str], str], target: str, attempts: int = 3) -> DataFrame:
    """(answer_id, rank, name, explanation): voices that a model picks from the catalog for requests (answer_id, provider, description).

    It is asked up to `attempts` times until its answer names a known voice.
    """
    from .catalogs import voice_candidates, voice_catalog
    from .text import filled

    asked = requests.join(voice_catalog(table, target), "provider")
    prompts = asked.select("answer_id", filled(template, {"catalog": F.col("catalog"), "description": F.col("description")}).alias("prompt"))
    found = table.select(F.lower("name").alias("name")).distinct().limit(MAX_NAMES + 1).collect()
    if len(found) > MAX_NAMES:
        raise ValueError(f"a voice catalog of over {MAX_NAMES} names")
    known = sorted(r.name for r in found if r.name)
    names = lambda found: bool(found) and any(n in found.lower() for n in known)
    return voice_candidates(answered(prompts, call, attempts, names), table)


def audio_path(value) -> str:
    """The path of what a recogniser is given: a path, an open file, or a pair (name, either of them)."""
    if isinstance(value, tuple):
        value = value[1]
    return str(getattr(value, "name", value))


def restore_punctuation(chunked: DataFrame, call: Callable[[str], str | None]) -> DataFrame:
    """Sentences of unpunctuated words (media_id, chunk, seq, text, start_ms, end_ms): a chunk's text goes to `call`.

    A chunk whose call fails or says nothing keeps its own words as its text, as one segment.
    """
    from ..operators.segments import align, renumber

    keys = ["media_id", "chunk"]
    raw = chunked.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(F.struct("seq", "text")))["text"], " ").alias("text"))

    def run(frames):
        for f in frames:
            out = []
            for t in f["text"]:
                try:
                    out.append(call(t))
                except Exception:  # noqa: BLE001  a failed call leaves the words as they are
                    out.append(None)
            f["text"] = out
            yield f

    # A text may be null here, unlike in raw.
    said = raw.mapInPandas(run, f"media_id {raw.schema['media_id'].dataType.simpleString()}, chunk {raw.schema['chunk'].dataType.simpleString()}, text string")
    return renumber(align(chunked, said), "chunk", "sentence").select("media_id", "id", "start_ms", "end_ms", "text")


def fetch_captions(media: DataFrame, call: Callable[[str], str | None], also: tuple[str, ...] = ()) -> DataFrame:
    """(media_id, also..., body) of the media (media_id, url, also...) whose caption body `call` gets; any failure leaves a medium out. also: columns of texts."""

    def run(frames):
        for f in frames:
            out = []
            for url in f["url"]:
                try:
                    out.append(call(url))
                except Exception:  # noqa: BLE001  without captions the medium is recognised
                    out.append(None)
            f["body"] = out
            yield f[["media_id", *also, "body"]]

    return media.select("media_id", "url", *also).mapInPandas(run, f"media_id long, {''.join(f'{c} string, ' for c in also)}body string").where("body is not null")


def fetch_source_captions(info: DataFrame, call: Callable[[str], str | None]) -> DataFrame:
    """(media_id, kind, lang, body) of the best caption track of (media_id, src, subtitles, automatic); any failure leaves a medium out.

    Answers are written at once, so that each track is asked for once however often they are read.
    """
    from ..sources.readers import select_track
    from ..storage import written

    return written(fetch_captions(select_track(info), call, ("kind", "lang")), "captions").select("media_id", "kind", "lang", "body")
