"""Languages and models: dimensions, display names, and what a request resolves to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Codes and names of the languages that speech models know.
LANGUAGES = {
    "en": "english", "zh": "chinese", "de": "german", "es": "spanish/castilian", "ru": "russian", "ko": "korean", "fr": "french", "ja": "japanese", "pt": "portuguese", "tr": "turkish",
    "pl": "polish", "ca": "catalan/valencian", "nl": "dutch/flemish", "ar": "arabic", "sv": "swedish", "it": "italian", "id": "indonesian", "hi": "hindi", "fi": "finnish", "vi": "vietnamese",
    "he": "hebrew", "uk": "ukrainian", "el": "greek", "ms": "malay", "cs": "czech", "ro": "romanian/moldavian/moldovan", "da": "danish", "hu": "hungarian", "ta": "tamil", "no": "norwegian",
    "th": "thai", "ur": "urdu", "hr": "croatian", "bg": "bulgarian", "lt": "lithuanian", "la": "latin", "mi": "maori", "ml": "malayalam", "cy": "welsh", "sk": "slovak",
    "te": "telugu", "fa": "persian", "lv": "latvian", "bn": "bengali", "sr": "serbian", "az": "azerbaijani", "sl": "slovenian", "kn": "kannada", "et": "estonian", "mk": "macedonian",
    "br": "breton", "eu": "basque", "is": "icelandic", "hy": "armenian", "ne": "nepali", "mn": "mongolian", "bs": "bosnian", "kk": "kazakh", "sq": "albanian", "sw": "swahili",
    "gl": "galician", "mr": "marathi", "pa": "punjabi/panjabi", "si": "sinhala/sinhalese", "km": "khmer", "sn": "shona", "yo": "yoruba", "so": "somali", "af": "afrikaans", "oc": "occitan",
    "ka": "georgian", "be": "belarusian", "tg": "tajik", "sd": "sindhi", "gu": "gujarati", "am": "amharic", "yi": "yiddish", "lo": "lao", "uz": "uzbek", "fo": "faroese",
    "ht": "haitian creole/haitian", "ps": "pashto/pushto", "tk": "turkmen", "nn": "nynorsk", "mt": "maltese", "sa": "sanskrit", "lb": "luxembourgish/letzeburgesch", "my": "myanmar/burmese", "bo": "tibetan", "tl": "tagalog",
    "mg": "malagasy", "as": "assamese", "tt": "tatar", "haw": "hawaiian", "ln": "lingala", "ha": "hausa", "ba": "bashkir", "jw": "javanese", "su": "sundanese",
}
# Model sizes and their labels.
MODELS = {"auto": "Auto (best for your device)", "tiny": "Tiny (fastest, lowest quality)", "base": "Base (recommended - stable)", "small": "Small (better quality)", "medium": "Medium (high quality, heavier)"}
# The public model of each size.
MODEL_IDS = {"auto": "onnx-community/whisper-base", "tiny": "onnx-community/whisper-tiny", "base": "onnx-community/whisper-base", "small": "onnx-community/whisper-small", "medium": "onnx-community/whisper-medium"}
DEFAULT_LANGUAGE = "ru"


def dim_languages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LANGUAGES.items()), "code string, name string")


def dim_models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(MODELS.items()), "model string, label string")


def dim_model_ids(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(MODEL_IDS.items()), "model string, model_id string")


def display_name(name: Column) -> Column:
    """The first character of each part between slashes in upper case, the rest as it is."""
    return F.array_join(F.transform(F.split(name, "/"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 20))), "/")


def primary(name: Column) -> Column:
    """The part before the first slash without white space at its ends."""
    return F.regexp_replace(F.split_part(name, F.lit("/"), F.lit(1)), r"^\s+|\s+$", "")


def task(mode: Column) -> Column:
    return F.when(mode == "translate", "translate").otherwise("transcribe")


def language(chosen: Column, default: str = DEFAULT_LANGUAGE, normalise: bool = False) -> Column:
    """The chosen language, or the default where it is null or empty; with ``normalise`` its primary name."""
    return F.coalesce(F.nullif(primary(chosen) if normalise else chosen, F.lit("")), F.lit(default))


def locale_default(locale: Column) -> Column:
    """Summaries are in Japanese for Japanese locales and else in English."""
    return F.when(F.startswith(locale, F.lit("ja")), "japanese").otherwise("english")


def recommended_model(model: Column, has_gpu: Column) -> Column:
    """What ``auto`` stands for on this device; other choices stay."""
    return F.when(model == "auto", F.when(has_gpu, "base").otherwise("tiny")).otherwise(model)


def with_labels(df: DataFrame, models: DataFrame) -> DataFrame:
    """Adds each row's model label; the dimension has one short row for each model."""
    return df.join(F.broadcast(models), "model", "left")
