"""The localisation pipeline as one lazy plan over many media: recognise, merge, translate, split, re-time, subtitle."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import providers
from ..operators import segments as S
from ..operators import timeline as TL
from ..sources import readers, writers
from ..storage import written


@dataclass(frozen=True)
class Options:
    """Configuration of a run; it never is a DataFrame."""

    max_gap_ms: int = 1000
    max_duration_ms: int = 60000
    max_subtitle_chars: int = 0
    voice: str = "tutorial man"
    formats: tuple[str, ...] = ("srt",)
    timing: TL.Timing = field(default_factory=TL.Timing)
    checkpoint: str | None = None


@dataclass(frozen=True)
class Localised:
    transcribed: DataFrame
    sentences: DataFrame
    tts: DataFrame
    aligned: DataFrame
    plan: DataFrame
    subtitles: DataFrame


def localise(captions: DataFrame, asr: DataFrame, media: DataFrame, opts: Options = Options(), translator=providers.upper_translator) -> Localised:
    """captions win over asr; both (media_id, id, start_ms, end_ms, text, speaker)."""
    merged = S.merge_continuous(readers.captions_or_asr(captions, asr), opts.max_gap_ms, opts.max_duration_ms)
    return from_transcribed(merged, media, opts, translator)


def from_transcribed(merged: DataFrame, media: DataFrame, opts: Options = Options(), translator=providers.upper_translator) -> Localised:
    """Resumes after recognition."""
    translated = providers.translate(merged, translator)
    if opts.checkpoint:
        writers.write_checkpoint(merged, opts.checkpoint, "transcribed")
        writers.write_checkpoint(translated, opts.checkpoint, "translated")
        translated = merged.sparkSession.read.parquet(opts.checkpoint).where("stage = 'translated'").drop("stage")
    else:
        # What a provider said is used several times below; asked again it might say something else.
        translated = written(translated, "translated")
    sentences = S.split_sentences(S.merge_continuous(translated, opts.max_gap_ms, None), opts.max_subtitle_chars)
    return from_translated(sentences, media, opts, merged)


def from_translated(sentences: DataFrame, media: DataFrame, opts: Options = Options(), transcribed: DataFrame | None = None) -> Localised:
    """Resumes after translation, without merging or splitting."""
    tts = providers.synthesize(sentences, None, opts.voice).select("media_id", "id", "tts_ms")
    aligned = TL.retime(sentences, tts, opts.timing)
    cues = aligned.select("media_id", "id", F.floor(F.col("start_us") / 1000).alias("start_ms"), F.floor(F.col("end_us") / 1000).alias("end_ms"), "text", "speaker")
    plan = TL.command_plan(TL.audio_plan(sentences, tts, media, opts.timing))
    return Localised(transcribed if transcribed is not None else sentences, sentences, tts, aligned, plan, writers.subtitles(cues, opts.formats))
