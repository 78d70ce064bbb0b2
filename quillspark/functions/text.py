"""Text normal forms, tokens, n-grams and parsers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of the normal form, spelled out so that Java and RE2 agree.
WHITE = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
TOKEN = r"[\p{L}\p{N}_]{2,}"
DIGITS = r"\p{Nd}+"
#: How a filter text asks for a rating, and the whole phrase.
RATING = r"рейтинг пользователя\s+(\d+(?:[.,]\d+)?)"
RATING_PHRASE = r"рейтинг пользователя\s+\d+(?:[.,]\d+)?\s*(?:звезд[а-я]*)?\s*(?:и выше)?"


def normalize(text: Column) -> Column:
    """Lower case, ё as е, white-space runs as one space, trimmed. Null stays null."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text), "ё", "е"), WHITE, " "))


def tokenize(text: Column) -> Column:
    """Runs of two or more letters, numbers and underscores."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def char_ngrams(text: Column, low: int, high: int) -> Column:
    """N-grams inside space-padded words; a word shorter than n gives itself once and then stops."""
    words = F.filter(F.split(text, " "), lambda w: w != "")

    def grams(word: Column) -> Column:
        padded, width = F.concat(F.lit(" "), word, F.lit(" ")), F.length(word) + 2
        sizes = F.filter(F.sequence(F.lit(low), F.lit(high)), lambda n: (n == low) | (n - 1 < width))
        return F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.greatest(width - n + 1, F.lit(1))), lambda i: F.substring(padded, i, n))))

    return F.flatten(F.transform(words, grams))


def numbers(text: Column) -> Column:
    """Distinct digit runs."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(DIGITS), F.lit(0)))


def required_rating(filter_text: Column) -> Column:
    """The rating that a normalised filter text asks for; 0 if none."""
    found = F.regexp_extract(filter_text, RATING, 1)
    return F.coalesce(F.regexp_replace(found, ",", ".").try_cast("double"), F.lit(0.0))


def filter_words(filter_text: Column) -> Column:
    """A normalised filter text without its rating phrase."""
    return F.regexp_replace(filter_text, RATING_PHRASE, "")


def prefixed(text: Column, prefix: str) -> Column:
    return F.when(F.startswith(text, F.lit(prefix)), text).otherwise(F.concat(F.lit(prefix), text))


def encoder_text(title: Column, params: Column) -> Column:
    """What an encoder reads of an item: 200 characters of title and of params, if there are any."""
    head = F.substring(F.coalesce(title, F.lit("")), 1, 200)
    tail = F.substring(F.coalesce(params, F.lit("")), 1, 200)
    return F.when(tail == "", head).otherwise(F.concat_ws(" ", head, tail))


def phrase_match(query: Column, field: Column) -> Column:
    """1 if a non-empty query is a substring of the field, else 0."""
    return F.when((query != "") & F.contains(field, query), 1.0).otherwise(0.0)


def number_coverage(query: Column, text: Column) -> Column:
    """Share of the query's digit runs that the text has; 0 without any."""
    wanted = numbers(query)
    return F.when(F.size(wanted) > 0, F.size(F.array_intersect(wanted, numbers(text))) / F.size(wanted)).otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    """Dot product of unit vectors, summed in order in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalise(vector: Column) -> Column:
    norm = F.sqrt(F.aggregate(F.transform(vector, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))
    return F.transform(vector, lambda x: x / F.greatest(norm, F.lit(1e-12)))
