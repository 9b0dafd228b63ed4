"""Configuration on the driver, the same row by row, and catalogs."""

import pytest
from pyspark.sql import functions as F

from cueloom.functions import catalogs, config
from cueloom.sources import readers

BASE = {"models": {"translation": {"provider": "together", "model": "m1"}, "tts": {"provider": "cartesia", "model": "v3"}, "chat": "m2"}, "tts": {"workers": 8}}
OVERRIDE = {"models": {"translation": {"model": "m9"}, "transcription": {"provider": "faster-whisper", "model": "small"}}, "output": {"fps": None}}


def test_merged_configuration():
    flat = dict(config.flattened(readers.deep_merge(BASE, OVERRIDE)))
    assert flat == {
        "models.translation.provider": "together", "models.translation.model": "m9", "models.tts.provider": "cartesia", "models.tts.model": "v3", "models.chat": "m2",
        "models.transcription.provider": "faster-whisper", "models.transcription.model": "small", "tts.workers": "8", "output.fps": None,
    }


def test_keys_of_a_configuration():
    cfg = readers.deep_merge(BASE, OVERRIDE)
    assert config.provider_and_model(cfg["models"]["tts"]) == ("together", "v3")  # an older name of the default provider
    assert config.required_keys(cfg) == ["TOGETHER_API_KEY"] == config.missing_keys(cfg, {}) and config.missing_keys(cfg, {"TOGETHER_API_KEY": "x"}) == []
    assert config.required_keys({"models": {"tts": {"provider": "elevenlabs"}, "chat": {"provider": "ollama"}, "transcription": {"provider": "local"}}}) == ["ELEVENLABS_API_KEY", "OLLAMA_API_KEY", "TOGETHER_API_KEY"]


def test_devices_row_by_row(spark):
    asked = [(a, b) for a in ("auto", "cpu", "cuda") for b in ("auto", "float32")]
    device, compute = config.device_columns(F.col("a"), F.col("b"))
    got = {(r.a, r.b): (r.d, r.c) for r in spark.createDataFrame(asked, "a string, b string").select("a", "b", device.alias("d"), compute.alias("c")).collect()}
    assert got == {x: config.device_and_type(*x) for x in asked}


def test_clients_row_by_row_are_those_of_the_driver(spark):
    env = {"TOGETHER_API_KEY": "k1", "ELEVENLABS_API_KEY": "k2"}
    providers = ["together", "openai", "elevenlabs", "faster-whisper", "supertonic", "cartesia", "Together", None, "", "ollama", "other"]
    rows = [(i, stage, p, own) for i, (stage, p, own) in enumerate((s, p, o) for s in ("chat", "tts") for p in providers for o in (None, "mine"))]
    found = config.clients(spark.createDataFrame(rows, "i int, stage string, provider string, own_key string").withColumn("model", F.lit("m")), env, {"together": "u"})
    by = {i: (stage, p, own) for i, stage, p, own in rows}
    for r in found.collect():
        stage, p, own = by[r.i]
        name = config.provider_and_model({"provider": p, "model": "m"})[0]
        cfg = {"models": {stage: {"provider": p, "model": "m"}}, "base_urls": {"together": "u"}}
        try:
            want = config.client_settings(cfg, stage, env, {name: own} if own else None)
        except ValueError:
            assert r.refused
            continue
        assert r.refused is None and (r.provider, r.base_url) == (want["provider"], want["base_url"]) and r.extra == bool(config.request_options(r.provider))
        if r.key_name:
            assert r.key == want["key"]
    keys = {r.stage: (r.required, r.missing) for r in config.keys_of(found, "stage").collect()}
    assert keys["chat"] == ("ELEVENLABS_API_KEY,OLLAMA_API_KEY,OPENAI_API_KEY,TOGETHER_API_KEY", "OLLAMA_API_KEY,OPENAI_API_KEY")


def test_corrections(spark):
    pairs = {"bad": "Bad", "it's": "It's", "x\\y": "X"}
    df = spark.createDataFrame([(1, *x) for x in pairs.items()], "k int, wrong string, right string")
    (r,) = config.corrections_blocks(df, "k").collect()
    lines = sorted(f"- '{a}' means '{b}'" for a, b in (("bad", "Bad"), ("it\\'s", "It\\'s"), ("x\\\\y", "X")))
    assert r.block.split("\n")[0] == config.corrections_block(pairs).split("\n")[0] and sorted(r.block.split("\n")[1:]) == lines


def test_catalogs(spark):
    table = catalogs.voices(spark)
    one = {r.provider: r.catalog for r in catalogs.voice_catalog(table, "fr").collect()}
    many = {(r.provider, r.target): r.catalog for r in catalogs.voice_catalogs(table, spark.createDataFrame([("openai", "fr"), ("elevenlabs", "fr"), ("openai", "fr")], "provider string, target string")).collect()}
    assert set(many) == {("openai", "fr"), ("elevenlabs", "fr")} and all(one[p] == c for (p, _), c in many.items())
    assert many["elevenlabs", "fr"].startswith("== Voices for target language (fr) ==")
    native = {(r.provider, r.lang): (r.male, r.female) for r in catalogs.native_voices(table).collect()}
    assert all(m and f for m, f in native.values()) and readers.languages_by_code(catalogs.languages(spark)).count() > 5
    styles = readers.style_list(readers.styles(spark, {"a": {"description": "A", "tts": {"speed": 1.5}}, "b": {}}))
    assert [r.name for r in styles.collect()] == ["a", "b"]
    known = spark.createDataFrame([(1, "a")], "id int, style string")
    assert readers.style_of(known, readers.styles(spark, {"a": {}})).count() == 1
    with pytest.raises(Exception, match="unknown style"):
        readers.style_of(known, readers.styles(spark, {"b": {}})).collect()
