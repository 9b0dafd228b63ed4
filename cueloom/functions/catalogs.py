"""Small dimension tables: languages, voices, styles and prices. All sizes are fixed by the lists below."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Language names and codes.
LANGUAGES = dict(
    english="en", spanish="es", french="fr", german="de", portuguese="pt", italian="it", dutch="nl", russian="ru",
    japanese="ja", korean="ko", chinese="zh", hindi="hi", turkish="tr", polish="pl", swedish="sv", arabic="ar",
    indonesian="id", vietnamese="vi", thai="th", greek="el", czech="cs", danish="da", finnish="fi", norwegian="no",
    romanian="ro", slovak="sk", ukrainian="uk", hungarian="hu", catalan="ca", bulgarian="bg", croatian="hr", malay="ms", tamil="ta",
)
#: US dollars a minute of audio, a million characters, a million input and output tokens. The first row is the default.
PRICES = [("together", 0.0015, 65.0, 0.30, 1.20), ("openai", 0.006, 30.0, 0.75, 4.50), ("elevenlabs", None, 165.0, None, None)]
#: Fixed values: (provider, language, name, gender, description); other voices come as a DataFrame of the same columns.
VOICES = [
    ("openai", "en", "onyx", "male", "Deep, authoritative male — narration and serious content."),
    ("openai", "en", "echo", "male", "Calm, even male — versatile for tutorials and explainers."),
    ("openai", "en", "fable", "male", "Warm British male — storytelling and audiobook feel."),
    ("openai", "en", "alloy", "neutral", "Neutral, balanced voice — general-purpose."),
    ("openai", "en", "nova", "female", "Bright, energetic female — engaging for social/short-form."),
    ("openai", "en", "shimmer", "female", "Gentle, soft female — calm narration and friendly content."),
    ("supertonic", "en", "M1", "male", "Warm, conversational male — default narrator."),
    ("supertonic", "en", "M2", "male", "Energetic male — engaging for tutorials and short-form."),
    ("supertonic", "en", "M3", "male", "Calm, low-pitched male — long-form narration."),
    ("supertonic", "en", "M4", "male", "Bright, youthful male — casual content."),
    ("supertonic", "en", "M5", "male", "Authoritative male — news and serious content."),
    ("supertonic", "en", "F1", "female", "Friendly, conversational female — default narrator."),
    ("supertonic", "en", "F2", "female", "Bright, expressive female — engaging short-form."),
    ("supertonic", "en", "F3", "female", "Soft, gentle female — calm narration."),
    ("supertonic", "en", "F4", "female", "Energetic female — kids and casual content."),
    ("supertonic", "en", "F5", "female", "Authoritative female — news and formal."),
    ("together", "en", "tutorial man", "male", "tutorial man"),
    ("together", "en", "helpful woman", "female", "helpful woman"),
    ("together", "en", "nonfiction man", "male", "nonfiction man"),
    ("together", "en", "reading man", "male", "reading man"),
    ("together", "zh", "chinese commercial man", None, "chinese commercial man"),
    ("together", "zh", "chinese female conversational", None, "chinese female conversational"),
    ("together", "ja", "japanese male conversational", None, "japanese male conversational"),
    ("together", "ja", "japanese woman conversational", None, "japanese woman conversational"),
    ("together", "ko", "korean narrator man", None, "korean narrator man"),
    ("together", "ko", "korean calm woman", None, "korean calm woman"),
    ("together", "es", "spanish narrator man", None, "spanish narrator man"),
    ("together", "es", "spanish narrator lady", None, "spanish narrator lady"),
    ("together", "fr", "french narrator man", None, "french narrator man"),
    ("together", "fr", "french narrator lady", None, "french narrator lady"),
    ("together", "de", "german reporter man", None, "german reporter man"),
    ("together", "de", "german conversational woman", None, "german conversational woman"),
    ("together", "it", "italian narrator man", None, "italian narrator man"),
    ("together", "it", "italian narrator woman", None, "italian narrator woman"),
    ("together", "nl", "dutch confident man", None, "dutch confident man"),
    ("together", "nl", "dutch man", None, "dutch man"),
    ("together", "ru", "russian narrator man 1", None, "russian narrator man 1"),
    ("together", "ru", "russian narrator woman", None, "russian narrator woman"),
    ("together", "pt", "friendly brazilian man", None, "friendly brazilian man"),
    ("together", "pt", "pleasant brazilian lady", None, "pleasant brazilian lady"),
    ("together", "hi", "hindi narrator man", None, "hindi narrator man"),
    ("together", "hi", "hindi narrator woman", None, "hindi narrator woman"),
    ("together", "tr", "turkish narrator man", None, "turkish narrator man"),
    ("together", "tr", "turkish calm man", None, "turkish calm man"),
    ("together", "pl", "polish confident man", None, "polish confident man"),
    ("together", "pl", "polish narrator woman", None, "polish narrator woman"),
    ("together", "sv", "swedish narrator man", None, "swedish narrator man"),
    ("together", "sv", "swedish calm lady", None, "swedish calm lady"),
    ("together", "ar", "middle eastern woman", None, "middle eastern woman"),
    ("together", "ar", "middle eastern woman", None, "middle eastern woman"),
]
#: The voices of the provider with ids of its own: language, name, id, gender, accent.
ELEVENLABS = [
    ("en", "Adam", "pNInz6obpgDQGcFmaJgB", "male", "american"),
    ("en", "Sarah", "EXAVITQu4vr4xnSDxMaL", "female", "american"),
    ("en", "Brian", "nPczCjzI2devNBz1zQrb", "male", "american"),
    ("en", "Bill", "pqHfZKP75CvOlQylNhV4", "male", "american"),
    ("en", "Roger", "CwhRBWXzGAHq8TQ4Fs17", "male", "american"),
    ("en", "Eric", "cjVigY5qzO86Huf0OWal", "male", "american"),
    ("en", "Chris", "iP95p4xoKVk53GoZ742B", "male", "american"),
    ("en", "Will", "bIHbv24MWmeRgasZH58o", "male", "american"),
    ("en", "Liam", "TX3LPaxmHKxFdv7VOQHJ", "male", "american"),
    ("en", "Harry", "SOYHLrjzK2X1ezoPC6cr", "male", "american"),
    ("en", "Callum", "N2lVS1w4EtoT3dr4eOWO", "male", "american"),
    ("en", "Charlie", "IKne3meq5aSn9XLyUdCD", "male", "australian"),
    ("en", "George", "JBFqnCBsd6RMkjVDRZzb", "male", "british"),
    ("en", "Daniel", "onwK4e9ZLuTAKqWW03F9", "male", "british"),
    ("en", "Bella", "hpp4J3VqNfWAUOO0d1Us", "female", "american"),
    ("en", "Matilda", "XrExE9yKIg1WjnnlVkGX", "female", "american"),
    ("en", "Jessica", "cgSgspJ2msm6clMCkdW9", "female", "american"),
    ("en", "Laura", "FGY2WhTYpPnrIDTdsKH5", "female", "american"),
    ("en", "Alice", "Xb7hH8MSUJpSbSDYk0k2", "female", "british"),
    ("en", "Lily", "pFZP5JQG7iQjIQuC4Bku", "female", "british"),
    ("en", "River", "SAz9YHcvj6GT2YYXdXww", "neutral", "american"),
    ("zh", "Lin", "UFDAUkGzdLAEJlINT3Fx", "male", "mandarin"),
    ("zh", "Lingyue", "ROfZIBAOQbwvPvLR3GMu", "female", "mandarin"),
    ("zh", "Jing", "zYD0xJl1ponKr8TwFBmJ", "male", "mandarin"),
    ("zh", "Nina", "El018FmI047NtSsCfyrY", "female", "mandarin"),
    ("ja", "Shohei", "AIg1eVkw9X3Bz8LsQQS3", "male", "japanese"),
    ("ja", "Maiko", "deKmbWEKZdwxcKxxcfvP", "female", "japanese"),
    ("ja", "Yoshio", "f7UUeltR22mzvXAsYavl", "male", "japanese"),
    ("ja", "Kana", "dhGvgIx0X6G3xzSWqOye", "female", "japanese"),
    ("ko", "Joon-ho", "NpneagLVR101ytYGxUPX", "male", "korean"),
    ("ko", "Soo", "3H7nUJE8YbxkmPW1GFts", "female", "korean"),
    ("ko", "Jae-won", "yvcSjT5PVWkS89U5mD6w", "male", "korean"),
    ("ko", "Onyu", "NaQdbkW5gNZD8wfwXeTV", "female", "korean"),
    ("es", "Carlos", "Y4HwpMNrBWN5dFKi5Lw8", "male", "colombian"),
    ("es", "Valeria", "nfyTTmgO0f6GV9CKrMWL", "female", "neutral"),
    ("es", "Brian C", "Czw3Dn181ypdrCOnPfif", "male", "neutral"),
    ("es", "Paola", "PoLFkTquRWtbexdwW3Xa", "female", "argentine"),
    ("fr", "Lior", "ljrJ081VvO1DCmonP7R8", "male", "french"),
    ("fr", "Virginie", "NzCI2wsmQgzQiufNpYi7", "female", "french"),
    ("fr", "Augustin", "kKgyAHjGAbeWHCNd7qoC", "male", "french"),
    ("fr", "Marilène", "tRQeD4idfj7AuhU7ApjT", "female", "french"),
    ("de", "Daniel", "wcqN36SUOZ0EhToc2OIu", "male", "german"),
    ("de", "Sina", "sgKauqXbUxSBZgugAiOl", "female", "german"),
    ("de", "Arthur", "3nMIMZ7RlGwsq1WLgxY3", "male", "german"),
    ("de", "Helmut", "OwYx4Jd2f6DQax9m8SVa", "male", "german"),
    ("it", "Raffaele", "YGp1lBJLaHhfIFT0yeDE", "male", "italian"),
    ("it", "Chiara", "mT0eqrjKfAPl6gQBlfBa", "female", "italian"),
    ("it", "Paolo", "mcMi8FJDhg35bMpWHv2R", "male", "italian"),
    ("it", "Cornelia", "SKEVNjRKCergbPKum64u", "female", "italian"),
    ("nl", "Ronald", "cfzqtNeB4pAo40KOcI0v", "male", "dutch"),
    ("nl", "Jolanda", "DiUBVrSFwkMaPz4XqWvR", "female", "dutch"),
    ("nl", "Thijs", "DYfqtQfWhbc1Z0SLiCWw", "male", "dutch"),
    ("nl", "Peter", "Kv97WYcYaIv0A06FfXcK", "male", "dutch"),
    ("ru", "Ivo", "hD8aK7CmEPgH3mbFO08e", "male", "russian"),
    ("ru", "Xenia", "vZopxKc6jrT5l48V9W5w", "female", "russian"),
    ("ru", "Anton", "13JzN9jg1ViUP8Pf3uet", "male", "russian"),
    ("ru", "Morna", "9AE7A1Ivnw8jKr8Us0ch", "female", "russian"),
    ("pt", "Medeiros", "E9hPCbqBRCgB3UEiCUuE", "male", "brazilian"),
    ("pt", "Luna", "jotBQRDYDizrWQAbv9VO", "female", "brazilian"),
    ("pt", "Guilherme", "Mn7FDiiQr3aIwMWsLE7r", "male", "brazilian"),
    ("pt", "Carolina", "4NRXT5DGqWzIcL6iVqtF", "female", "brazilian"),
    ("hi", "Yatin", "46xKhzYfIJMejACevZhq", "male", "hindi"),
    ("hi", "Madhusmita", "vQmxatd5nc5hsnpVWWpJ", "female", "hindi"),
    ("hi", "Niraj", "4aFkTNmCXWi67j9dQQVC", "male", "hindi"),
    ("hi", "Kalpana", "KBzY47BBXGaDJVIbCIFU", "female", "hindi"),
    ("tr", "Sinan", "Rn6ATQ4HFbyhBC6mze4Z", "male", "turkish"),
    ("tr", "Aura", "wYM8FTSOj72VzJ7kgprn", "female", "turkish"),
    ("tr", "Hakan", "EJ861k94E3y4EM3kZh71", "male", "turkish"),
    ("tr", "Dilek", "3K9SrW7hHlFO6yMzQgJV", "female", "turkish"),
    ("pl", "Gregor", "xPYhbnzKk9nCh7pnUehm", "male", "polish"),
    ("pl", "Jola", "mgxZQ8b1CA0Zl9YUTX8Z", "female", "polish"),
    ("pl", "Kris", "jnAzri3VrjEtIf7MMQ4d", "male", "polish"),
    ("pl", "Asia", "Bz1e1clEKwgN71Vx7cxj", "female", "polish"),
    ("sv", "Andreas", "TIMFVcMCO4bdy7J79GWF", "male", "swedish"),
    ("sv", "Louise", "kpTdKfohzvarfFPnwuHW", "female", "swedish"),
    ("sv", "Peter", "oJEeOXECH9V31Oci9WHK", "male", "swedish"),
    ("sv", "Olivia", "cLAH1kXlkAivJHxCW601", "female", "swedish"),
    ("ar", "Faris", "RL04FaPrUG6vS8aWd9NZ", "male", "levantine"),
    ("ar", "Haneen", "iIIMrkfGuAyFOZsShpgf", "female", "levantine"),
    ("ar", "Ashraf", "QfMIySsRuJWjZPZCnDQp", "male", "egyptian"),
    ("ar", "Sawsan", "mS4cERRqrNy5Kmlx8Udf", "female", "egyptian"),
]
VOICE_SCHEMA = "provider string, lang string, lang_pos int, pos int, name string, voice_id string, gender string, accent string, description string"


def language_code(name: Column) -> Column:
    """The map's code, else the first two characters; case is ignored."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(name)), F.substring(F.lower(name), 1, 2))


def languages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LANGUAGES.items()), "name string, code string")


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRICES, "provider string, per_minute double, per_m_chars double, per_m_in double, per_m_out double")


def voice_rows() -> list[tuple]:
    """The catalog as rows of VOICE_SCHEMA; lang_pos and pos are the catalog's order of languages and of voices in them."""
    pos: dict = {}
    langs: dict = {}
    listed = [(p, lang, name, name, gender, None, text) for p, lang, name, gender, text in VOICES]
    listed += [("elevenlabs", lang, name, voice_id, gender, accent, f"{gender}, {accent} accent") for lang, name, voice_id, gender, accent in ELEVENLABS]
    rows = []
    for provider, lang, *rest in listed:
        known = langs.setdefault(provider, {})
        at = known.setdefault(lang, len(known))
        pos[provider, lang] = pos.get((provider, lang), -1) + 1
        rows.append((provider, lang, at, pos[provider, lang], *rest))
    return rows


def voices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(voice_rows(), VOICE_SCHEMA)


def native_voices(table: DataFrame) -> DataFrame:
    """(provider, lang, male, female): the first of each gender, else the first voice and the second or last one."""
    first = lambda g: F.min_by(F.when(F.col("gender") == g, F.col("name")), F.when(F.col("gender") == g, F.col("pos")))
    return table.groupBy("provider", "lang").agg(
        F.coalesce(first("male"), F.min_by("name", "pos")).alias("male"),
        F.coalesce(first("female"), F.max_by(F.when(F.col("pos") <= 1, F.col("name")), F.when(F.col("pos") <= 1, F.col("pos")))).alias("female"),
    )


def voice_of(probe: DataFrame, table: DataFrame) -> DataFrame:
    """probe (provider, voice) with voice_id: the first voice of the name in the catalog's order of languages, else the name."""
    first = table.groupBy("provider", F.col("name").alias("voice")).agg(F.min_by("voice_id", F.struct("lang_pos", "pos")).alias("__id"))
    return probe.join(first, ["provider", "voice"], "left").withColumn("voice_id", F.coalesce("__id", "voice")).drop("__id")


def described(table: DataFrame, texts: DataFrame) -> DataFrame:
    """The catalog with descriptions from texts (provider, lang, name, text) after what is known of a voice."""
    t = texts.select("provider", "lang", "name", F.col("text").alias("__t"))
    return table.join(t, ["provider", "lang", "name"], "left").withColumn("description", F.concat_ws(" — ", "description", "__t")).select(*table.columns)


def voice_catalogs(table: DataFrame, asked: DataFrame) -> DataFrame:
    """(provider, target, catalog) of asked (provider, target): a provider's voices of the target language under a heading of their own, then the others by code.

    A voice is a line; a description that only repeats the name is left out.
    """
    line = F.when(F.coalesce("description", F.lit("")).isin("") | (F.col("description") == F.col("name")), F.concat(F.lit("  - "), "name")).otherwise(F.concat(F.lit("  - "), "name", F.lit(" — "), "description"))
    blocks = table.withColumn("line", line).groupBy("provider", "lang").agg(F.array_join(F.array_sort(F.collect_list(F.struct("pos", "line")))["line"], "\n").alias("lines"))
    mine = F.col("lang") == F.col("target")
    head = F.when(mine, F.concat(F.lit("== Voices for target language ("), "lang", F.lit(") =="))).otherwise(F.concat(F.lit("== "), F.when(F.col("lang") == "multi", "All voices (multilingual)").otherwise(F.col("lang")), F.lit(" ==")))
    text = F.concat(head, F.lit("\n"), "lines", F.when(mine, "\n").otherwise(""))
    ordered = asked.select("provider", "target").distinct().join(blocks, "provider").select("provider", "target", F.struct((~mine).alias("other"), "lang", text.alias("text")).alias("b"))
    return ordered.groupBy("provider", "target").agg(F.array_join(F.array_sort(F.collect_list("b"))["text"], "\n").alias("catalog"))


def voice_catalog(table: DataFrame, target: str) -> DataFrame:
    """(provider, catalog): voice_catalogs of every provider for one target language."""
    return voice_catalogs(table, table.select("provider", F.lit(target).alias("target"))).drop("target")


def voice_candidates(answers: DataFrame, table: DataFrame, k: int = 3) -> DataFrame:
    """(answer_id, rank, name, explanation): up to k known voices that a model's answer names, in its order.

    The answer may have thinking tags, code fences and text around a JSON array of
    strings or of objects with `voice` and `explanation`, or be one such object;
    unreadable answers give no rows. Names are matched without case and outer blanks.
    """
    bare = F.regexp_replace(F.regexp_replace("answer", r"(?s)<think>.*?</think>", ""), r"```(?:json)?", "")
    array = F.regexp_extract(bare, r"(?s)(\[.*\])", 1)
    one = F.regexp_extract(bare, r"(?s)^\s*(\{.*\})\s*$", 1)
    names = F.coalesce(F.from_json(F.when(array != "", array).otherwise(F.concat(F.lit("["), one, F.lit("]"))), "array<string>"), F.array().cast("array<string>"))
    items = answers.select("answer_id", F.posexplode(names).alias("at", "item"))
    is_object = F.coalesce(F.col("item").startswith("{"), F.lit(False))
    name = F.when(is_object, F.get_json_object("item", "$.voice")).otherwise(F.col("item"))
    why = F.coalesce(F.when(is_object, F.get_json_object("item", "$.explanation")), F.lit(""))
    asked = items.select("answer_id", "at", F.lower(F.btrim(name)).alias("key"), why.alias("why"))
    known = table.groupBy(F.lower("name").alias("key")).agg(F.min("name").alias("name"))
    # A catalog of a few hundred names; the optimizer broadcasts it while it is that small.
    hit = asked.join(known, "key").groupBy("answer_id", "name").agg(F.min("at").alias("at"), F.min_by("why", "at").alias("explanation"))
    rank = F.row_number().over(Window.partitionBy("answer_id").orderBy("at"))
    return hit.withColumn("rank", rank).where(F.col("rank") <= k).select("answer_id", "rank", "name", "explanation")


def native_voices_for(probe: DataFrame, table: DataFrame) -> DataFrame:
    """probe (provider, lang) with male and female: the language's voices, else the provider's English ones."""
    native = native_voices(table)
    english = native.where("lang = 'en'").select("provider", F.col("male").alias("__m"), F.col("female").alias("__f"))
    j = probe.join(native, ["provider", "lang"], "left").join(english, "provider", "left")
    return j.withColumn("male", F.coalesce("male", "__m")).withColumn("female", F.coalesce("female", "__f")).drop("__m", "__f")


def default_voice(explicit: Column, gender: Column, male: Column, female: Column) -> Column:
    """The stated voice, else the male one for gender ``male`` and the female one for any other."""
    return F.coalesce(explicit, F.when(gender == "male", male).otherwise(female))


def local_voice(voice: Column) -> Column:
    """A style of the local model; unknown ones are M1."""
    known = [name for provider, _, name, *_ in VOICES if provider == "supertonic"]
    return F.when(voice.isin(*known), voice).otherwise(F.lit("M1"))
