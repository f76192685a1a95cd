"""Function words of languages, from the public lists that come with Spark's machine learning library."""

from __future__ import annotations

import re

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import SparkSession

# The languages of the lists, by code.
LISTS = {
    "en": "english", "de": "german", "fr": "french", "es": "spanish", "pt": "portuguese", "ru": "russian", "it": "italian",
    "nl": "dutch", "sv": "swedish", "da": "danish", "no": "norwegian", "fi": "finnish", "hu": "hungarian", "tr": "turkish",
}
_WORD = re.compile(r"[^\W\d_]+")
#: Letters beyond the scripts of the lists: Greek, and all that follow Cyrillic.
_OTHER_SCRIPT = re.compile("[\u0370-\u03ff\u0530-\u1dff\u2c00-\ua63f\ua6a0-\U0003ffff]")


def other_script(text: str) -> bool:
    """Whether most letters of a text are of a script that no list has."""
    return not text.isascii() and 2 * len(_OTHER_SCRIPT.findall(text)) > sum(map(len, _WORD.findall(text)))


def function_words(spark: SparkSession, languages: tuple[str, ...] = tuple(LISTS)) -> dict[str, tuple[str, ...]]:
    """The words of each language's list, in its order; forms with an apostrophe as their parts."""
    out = {}
    for lang in languages:
        words = StopWordsRemover.loadDefaultStopWords(LISTS[lang])
        out[lang] = tuple(dict.fromkeys(w for x in words for w in _WORD.findall(x.lower())))
    return out
