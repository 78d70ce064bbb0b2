"""Russian Snowball stemmer, from the published description of the algorithm.

A word has two regions: RV, what follows the first vowel, and R2, what follows the second
vowel-consonant step. Endings are removed inside RV, longest first: a perfective gerund, or else a
reflexive ending and then an adjectival, verb or noun ending; then a final и; then a derivational
ending in R2; last a superlative ending, a double н, or a soft sign.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOWELS = "аеиоуыэюя"
#: The endings of the published algorithm. Endings of a first group need а or я before them.
GERUND_1 = ("в", "вши", "вшись")
GERUND_2 = ("ив", "ивши", "ившись", "ыв", "ывши", "ывшись")
ADJECTIVE = ("ее", "ие", "ые", "ое", "ими", "ыми", "ей", "ий", "ый", "ой", "ем", "им", "ым", "ом", "его", "ого", "ему", "ому", "их", "ых", "ую", "юю", "ая", "яя", "ою", "ею")
PARTICIPLE_1 = ("ем", "нн", "вш", "ющ", "щ")
PARTICIPLE_2 = ("ивш", "ывш", "ующ")
REFLEXIVE = ("ся", "сь")
VERB_1 = ("ла", "на", "ете", "йте", "ли", "й", "л", "ем", "н", "ло", "но", "ет", "ют", "ны", "ть", "ешь", "нно")
VERB_2 = ("ила", "ыла", "ена", "ейте", "уйте", "ите", "или", "ыли", "ей", "уй", "ил", "ыл", "им", "ым", "ен", "ило", "ыло", "ено", "ят", "ует", "уют", "ит", "ыт", "ены", "ить", "ыть", "ишь", "ую", "ю")
NOUN = ("а", "ев", "ов", "ие", "ье", "е", "иями", "ями", "ами", "еи", "ии", "и", "ией", "ей", "ой", "ий", "й", "иям", "ям", "ием", "ем", "ам", "ом", "о", "у", "ах", "иях", "ях", "ы", "ь", "ию", "ью", "ю", "ия", "ья", "я")
SUPERLATIVE = ("ейш", "ейше")
DERIVATIONAL = ("ост", "ость")

_R1 = re.compile(f"[{VOWELS}][^{VOWELS}]")


def _regions(word: str) -> tuple[int, int]:
    vowel = re.search(f"[{VOWELS}]", word)
    rv = vowel.end() if vowel else len(word)
    first = _R1.search(word)
    second = _R1.search(word, first.end()) if first else None
    return rv, second.end() if second else len(word)


def _cut(word: str, start: int, free: tuple[str, ...], after_a: tuple[str, ...] = ()) -> str | None:
    """The word without the longest ending that lies behind ``start``; None if there is none."""
    for ending in sorted({*free, *after_a}, key=len, reverse=True):
        at = len(word) - len(ending)
        if at < start or not word.endswith(ending):
            continue
        if ending in free:
            return word[:at]
        if at - 1 >= start and word[at - 1] in "ая":
            return word[:at]
        return None  # the longest ending decides
    return None


def stem(word: str) -> str:
    rv, r2 = _regions(word)
    cut = _cut(word, rv, GERUND_2, GERUND_1)
    if cut is None:
        cut = _cut(word, rv, REFLEXIVE) or word
        adjective = _cut(cut, rv, ADJECTIVE)
        if adjective is not None:
            participle = _cut(adjective, rv, PARTICIPLE_2, PARTICIPLE_1)
            cut = adjective if participle is None else participle
        else:
            verb = _cut(cut, rv, VERB_2, VERB_1)
            if verb is None:
                verb = _cut(cut, rv, NOUN)
            cut = cut if verb is None else verb
    word = cut
    if word.endswith("и") and len(word) - 1 >= rv:
        word = word[:-1]
    word = _cut(word, r2, DERIVATIONAL) or word
    shorter = _cut(word, rv, SUPERLATIVE)
    if shorter is not None:
        word = shorter
    if word.endswith("нн") and len(word) - 2 >= rv:
        return word[:-1]
    if shorter is None and word.endswith("ь") and len(word) - 1 >= rv:
        return word[:-1]
    return word


@F.pandas_udf(T.StringType())
def stem_words(words: pd.Series) -> pd.Series:
    """For tables of distinct terms."""
    return words.map(stem, na_action="ignore")
