"""Configuration: providers, models, keys, styles. What is asked once is a dict on the driver; what is asked row by row are columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The environment variable that holds each provider's key; local providers have none.
KEYS = {"together": "TOGETHER_API_KEY", "openai": "OPENAI_API_KEY", "elevenlabs": "ELEVENLABS_API_KEY", "ollama": "OLLAMA_API_KEY"}
LOCAL = {"faster-whisper", "faster_whisper", "local", "supertonic"}
SPEECH = {"together", "openai", "elevenlabs", "supertonic"}


#: An older name of a speech provider, which means the default one.
OLDER = {"cartesia": "together"}


def provider_and_model(entry) -> tuple[str, str | None]:
    """A stage's provider and model: a dict of both, or an older bare model name, which means the default provider."""
    if isinstance(entry, dict):
        name = str(entry.get("provider") or "together").lower()
        return OLDER.get(name, name), entry.get("model")
    return "together", entry or None


def required_keys(config: dict) -> list[str]:
    """The sorted key variables that the configured providers need."""
    used = {provider_and_model((config.get("models") or {}).get(stage))[0] for stage in ("transcription", "translation", "chat", "tts")}
    return sorted(KEYS[p] for p in used - LOCAL if p in KEYS)


def missing_keys(config: dict, environment: dict) -> list[str]:
    return [k for k in required_keys(config) if not environment.get(k)]


def speech_provider(name: str) -> str:
    """A known speech provider; others are refused, not taken for the default."""
    if name not in SPEECH:
        raise ValueError(f"unknown speech provider {name!r}; known: {', '.join(sorted(SPEECH))}")
    return name


def device_and_type(device: str = "auto", compute: str = "auto") -> tuple[str, str]:
    device = "cpu" if device == "auto" else device
    return device, compute if compute != "auto" else "int8" if device == "cpu" else "float16"


def corrections_block(pairs: dict[str, str]) -> str:
    """The prompt's block of known recognition errors; empty without any."""
    return "\n".join(["Known recognition errors:", *[f"- {wrong!r} means {right!r}" for wrong, right in pairs.items()]]) if pairs else ""


def corrections_blocks(pairs: DataFrame, key: str) -> DataFrame:
    """(key, block): corrections_block of each key's rows (key, wrong, right), in the order of `wrong`."""
    quoted = lambda c: F.concat(F.lit("'"), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))
    line = F.concat(F.lit("- "), quoted(F.col("wrong")), F.lit(" means "), quoted(F.col("right")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("wrong", line.alias("line")))), lambda x: x["line"])
    return pairs.groupBy(key).agg(F.concat(F.lit("Known recognition errors:\n"), F.array_join(lines, "\n")).alias("block"))


def client_settings(config: dict, stage: str, environment: dict, overrides: dict | None = None) -> dict:
    """What a stage's client needs: provider, model, base_url (null: the provider's own) and key; a missing key is an error.

    overrides: keys by provider, as a caller brings them; they go before the environment.
    """
    provider, model = provider_and_model((config.get("models") or {}).get(stage))
    if stage == "tts":
        speech_provider(provider)
    name = None if provider in LOCAL else KEYS.get(provider)
    key = (overrides or {}).get(provider) or (environment.get(name) if name else None)
    if name and not key:
        raise ValueError(f"{name} is not set")
    return {"provider": provider, "model": model, "base_url": (config.get("base_urls") or {}).get(provider), "key": key}


def request_options(provider: str) -> dict:
    """Further options of a request: the default provider's models are asked not to think aloud."""
    return {"extra_body": {"chat_template_kwargs": {"enable_thinking": False}}} if provider == "together" else {}


def device_columns(device: Column, compute: Column) -> tuple[Column, Column]:
    """device_and_type row by row; nulls are auto."""
    on = F.when(F.coalesce(device, F.lit("auto")) == "auto", "cpu").otherwise(device)
    kind = F.coalesce(compute, F.lit("auto"))
    return on, F.when(kind != "auto", kind).when(on == "cpu", "int8").otherwise("float16")


def _named(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key) if table else F.lit(None).cast("string")


def clients(stages: DataFrame, environment: dict[str, str], base_urls: dict[str, str] | None = None) -> DataFrame:
    """stages (stage, provider, model, own_key, ...) with what each client needs: provider, key_name, key, base_url, extra and refused.

    A null provider is the default one, and so is an older name of it. The
    caller's own key goes before the environment's; local providers need none.
    extra: whether the request carries the default provider's options. refused:
    why there is no client: an unknown speech provider, or a missing key; null if there is one.
    """
    name = F.lower(F.coalesce(F.when(F.col("provider") != "", F.col("provider")), F.lit("together")))
    s = stages.withColumn("provider", F.coalesce(_named(OLDER, name), name))
    needed = F.when(~F.col("provider").isin(*sorted(LOCAL)), _named(KEYS, F.col("provider")))
    s = s.withColumn("key_name", needed)
    given = {k: v for k, v in environment.items() if v}
    s = s.withColumn("key", F.coalesce(F.when(F.col("own_key") != "", F.col("own_key")), _named(given, F.col("key_name"))))
    s = s.withColumn("base_url", _named(base_urls or {}, F.col("provider"))).withColumn("extra", F.col("provider") == "together")
    unknown = (F.col("stage") == "tts") & ~F.col("provider").isin(*sorted(SPEECH))
    return s.withColumn("refused", F.when(unknown, "provider").when(F.col("key_name").isNotNull() & F.col("key").isNull(), F.col("key_name")))


def keys_of(found: DataFrame, by: str) -> DataFrame:
    """(by, required, missing): the sorted key names that the clients of each `by` need, and those of them that nobody gives."""
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return found.groupBy(by).agg(names(F.col("key_name")).alias("required"), names(F.when(F.col("key").isNull(), F.col("key_name"))).alias("missing"))


def read_yaml(*paths: str) -> dict:
    """One configuration of several files on the driver; later ones override earlier ones, nested keys by themselves."""
    import yaml

    from ..sources.readers import deep_merge

    out: dict = {}
    for path in paths:
        with open(path, encoding="utf-8") as f:
            out = deep_merge(out, yaml.safe_load(f) or {})
    return out


def read_prompt(path: str, key: str) -> str:
    """A prompt template of a YAML file, stripped; `text.filled` fills it row by row."""
    return read_yaml(path)[key].strip()


def flattened(config: dict, above: str = "") -> list[tuple[str, str | None]]:
    """(dotted key, value as text) of a configuration, in the order of its keys."""
    out: list[tuple[str, str | None]] = []
    for k, v in config.items():
        name = f"{above}.{k}" if above else str(k)
        out += flattened(v, name) if isinstance(v, dict) else [(name, None if v is None else str(v))]
    return out


def merged_settings(jobs: DataFrame, base: dict, overrides: DataFrame, by: str) -> DataFrame:
    """(by, key, value): each job's configuration, the flattened base with the job's overrides (by, key, value) before it.

    A null override stays null. An override of a key under which the base has
    others takes their place, and one below a plain value of the base takes that one's.
    """
    own = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).cast("string").alias("value")) for k, v in flattened(base)])
    rows = jobs.select(by).distinct().select(by, F.explode(own).alias("x")).select(by, "x.*")
    given = overrides.select(by, "key", "value").dropDuplicates([by, "key"])
    keys = given.groupBy(by).agg(F.collect_set("key").alias("__keys"))
    inside = lambda a, b: F.startswith(a, F.concat(b, F.lit(".")))
    hit = F.exists(F.coalesce("__keys", F.array().cast("array<string>")), lambda k: (k == F.col("key")) | inside(F.col("key"), k) | inside(k, F.col("key")))
    return rows.join(keys, by, "left").where(~hit).select(by, "key", "value").unionByName(given)
