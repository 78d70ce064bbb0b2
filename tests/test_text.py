import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import stemmer
from quillspark.functions import text as T


def test_normalize(spark):
    rows = [(" Ёлка\t НОВАЯ  \n", "елка новая"), ("", ""), (None, None), ("A b", "a b")]
    got = spark.createDataFrame(rows, "t string, e string").select(T.normalize(F.col("t")).alias("n"), "e").collect()
    assert all(r["n"] == r["e"] for r in got)


def test_tokens_have_two_characters(spark):
    got = spark.createDataFrame([("a bc d_e 12 x½ яб",)], "t string").select(T.tokenize(F.col("t"))).first()[0]
    assert got == ["bc", "d_e", "12", "x½", "яб"]


def plain_ngrams(text, low, high):
    out = []
    for word in text.split():
        padded = f" {word} "
        for n in range(low, high + 1):
            out.append(padded[:n])
            for i in range(1, len(padded) - n + 1):
                out.append(padded[i : i + n])
            if len(padded) <= n:
                break
    return out


def test_ngrams_match_a_plain_version(spark):
    texts = ["ab", "a", "hello big world", "", "яблоко 12"]
    for low, high in ((3, 5), (2, 5)):
        got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.char_ngrams(F.col("t"), low, high).alias("g")).collect()
        for r in got:
            assert r["g"] == plain_ngrams(r["t"], low, high)


def test_rating_and_filter(spark):
    rows = [("рейтинг пользователя 4,5 звезды и выше доставка",), ("рейтинг пользователя 4",), ("цвет красный",)]
    got = spark.createDataFrame(rows, "t string").select(T.required_rating(F.col("t")).alias("r"), F.trim(T.filter_words(F.col("t"))).alias("w")).collect()
    assert [(r["r"], r["w"]) for r in got] == [(4.5, "доставка"), (4.0, ""), (0.0, "цвет красный")]


def test_phrase_numbers_and_encoder_text(spark):
    df = spark.createDataFrame([("12 kg 7", "box 12 of 100", "")], "q string, t string, e string")
    r = df.select(T.number_coverage(F.col("q"), F.col("t")).alias("c"), T.phrase_match(F.col("e"), F.col("t")).alias("p"), T.encoder_text(F.col("t"), F.col("e")).alias("x"), T.prefixed(F.lit("query: a"), "query: ").alias("y")).first()
    assert (r["c"], r["p"], r["x"], r["y"]) == (0.5, 0.0, "box 12 of 100", "query: a")


def test_stemmer_published_examples():
    # word and stem, from the algorithm's published sample vocabulary
    pairs = {
        "в": "в", "вавиловка": "вавиловк", "вагнера": "вагнер", "вагон": "вагон", "вагона": "вагон", "вагоне": "вагон", "вагонов": "вагон", "важная": "важн", "важнее": "важн",
        "важнейшие": "важн", "важнейшими": "важн", "важничал": "важнича", "важно": "важн", "важного": "важн", "важность": "важност", "важностью": "важност", "вакханка": "вакханк",
        "валандался": "валанда", "валентина": "валентин", "валериановых": "валерианов", "валерию": "валер", "валетами": "валет",
        "па": "па", "пава": "пав", "павел": "павел", "павильон": "павильон", "павлиний": "павлин", "павлыч": "павлыч", "падает": "пада", "падал": "пада", "падаль": "падал", "падают": "пада",
        "пакостей": "пакост", "палач": "палач", "палочкой": "палочк", "пальцами": "пальц", "пальчики": "пальчик", "памятной": "памятн", "памятью": "памят",
    }
    assert {w: stemmer.stem(w) for w in pairs} == pairs


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="абвгдеийлмностуыьэюя", max_size=14))
def test_stem_is_a_prefix_or_drops_a_double_n(word):
    assert word.startswith(stemmer.stem(word)) and re.fullmatch("[а-я]*", stemmer.stem(word))


def test_stem_udf(spark):
    got = spark.createDataFrame([("вагоне",), (None,), ("word",)], "t string").select(stemmer.stem_words("t")).collect()
    assert [r[0] for r in got] == ["вагон", None, "word"]
