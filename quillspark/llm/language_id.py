"""Language ID by compression: the language whose dictionary compresses a text best.

``fit`` draws, for each language, a bounded sample of labelled texts (``per_lang`` texts, chosen by
the hash of their id) for a raw-content zstandard dictionary of ``dict_bytes``. Every drawn text has
an equal share of the dictionary: a text within its share is taken whole, a longer one by ``PIECES``
pieces spread evenly from its beginning to its end. Texts are lower-cased and every run of
non-letters becomes one space, on both sides.
``predict`` compresses every whole text in blocks of ``BLOCK`` bytes, each with each dictionary, and
takes the language with the smallest sum, so that a dictionary helps every part of a long text alike;
``score`` is the share by which the runner-up is larger, and a text whose score is below ``min_margin`` is marked ``rejected``.

Defined results: null text or text without a letter is ``und`` with score 0 and rejected; equal
sizes go to the first language by code point with score 0; with one learned language the score is
1; with none every text is ``und``. With many labels each dictionary is smaller, so that all
together stay within ``ALL_DICT_BYTES``. Null labels and null ids are never learned from; of rows that
share an id and a label the text that is first by code point is. A very long text is compressed block
by block. Input columns with the names of output columns are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read, slices, without

#: The bounds of the sample that is learned from: texts of a language, bytes of its dictionary, pieces of
#: a text that is longer than its share, and bytes of all dictionaries together.
PER_LANG = 256
DICT_BYTES = 1 << 17
PIECES = 4
ALL_DICT_BYTES = 1 << 26
MIN_MARGIN = 0.005
LEVEL = 3
#: Bytes that are compressed at once. What a dictionary saves is bounded, so in one piece a long text would have no margin.
BLOCK = 1 << 14
_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    return _OTHER.sub(" ", text.lower()).encode()


def spread(text: Column, share: Column, pieces: int = PIECES) -> Column:
    """The whole text if it has at most ``share`` characters, else ``pieces`` parts at even distances."""
    part = F.greatest(F.floor(share / pieces), F.lit(1)).cast("int")
    step = (F.length(text) - part) / max(pieces - 1, 1)
    parts = F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), lambda i: F.substring(text, (F.floor(i * step) + 1).cast("int"), part))
    return F.when(F.length(text) <= share, text).otherwise(F.array_join(parts, " "))


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_lang: int = PER_LANG, dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """Dictionary of each language. A language's ids are thinned by their hash to some four times
    ``per_lang``, however many there are, and the first ``per_lang`` in the hash's order are taken; then
    their texts are fetched. What reaches the driver is one share for each of these ids."""
    key = F.md5(F.col("id").cast("string"))
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("lang is not null and id is not null and text is not null")
    counts = rows.groupBy("lang").agg(F.count("*").alias("c")).collect()  # a row for each label
    if not counts:
        return {}
    size = min(dict_bytes, max(1, ALL_DICT_BYTES // len(counts)))
    labels = labelled.sparkSession.createDataFrame(counts, "l string, c long")
    place = F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / 2.0**32
    thin = rows.select("lang", "id").join(F.broadcast(labels), F.col("lang") == F.col("l")).where(place * F.col("c") < 4 * per_lang + 64).select("lang", "id").distinct()
    order = Window.partitionBy("lang").orderBy(key, "id")
    chosen = thin.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_lang)
    chosen = chosen.select(F.col("lang").alias("l"), F.col("id").alias("i"), F.lit(size).alias("size"), F.count("*").over(Window.partitionBy("lang")).alias("drawn"))
    share = F.ceil(F.col("size") / F.col("drawn"))
    drawn = rows.join(F.broadcast(chosen), (F.col("lang") == F.col("l")) & (F.col("id") == F.col("i")))  # per_lang rows for each label
    drawn = drawn.groupBy("lang", key.alias("k")).agg(F.min(spread(F.col("text"), share)).alias("text")).collect()
    out: dict[str, list[bytes]] = {}
    for lang, _, text in sorted(drawn, key=lambda r: (r[0], r[1])):
        got = letters(text)
        if got.strip() and got not in out.setdefault(lang, []):
            out[lang].append(got)
    return {k: b" ".join(v)[:size] for k, v in out.items() if v}


class Model:
    """Compressors of one worker."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL):
        self.langs = sorted(dictionaries)
        self.engines = []
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level)
            self.engines.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return "und", 0.0
        raw = letters(text)
        blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
        sizes = sorted((sum(len(e.compress(b)) for b in blocks), lang) for e, lang in zip(self.engines, self.langs, strict=True))
        return sizes[0][1], 1.0 if len(sizes) == 1 else 1 - sizes[0][0] / sizes[1][0]


def predict(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", min_margin: float = MIN_MARGIN, keep_text: bool = True) -> DataFrame:
    """The documents with ``lang_pred``, ``score`` and ``rejected``."""
    spark = docs.sparkSession
    docs = without(docs, "lang_pred", "score", "rejected")
    shared = spark.sparkContext.broadcast(dictionaries)
    kept = [f for f in docs.schema.fields if keep_text or f.name != text_col]
    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(shared.value)
        for b in slices(batches):
            found = [model.predict(t) for t in b.column(text_col).to_pylist()]
            cols = [b.column(c) for c in names]
            cols += [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[0] == "und" or f[1] < min_margin for f in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, [*names, "lang_pred", "score", "rejected"])

    return docs.mapInArrow(run, schema)


def fold(id_col: str = "doc_id"):
    """crc32 of the id's text, modulo 4."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def op8_language_id(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(fold() != 2))
    out = predict(docs.select("doc_id", "text"), model, keep_text=False)
    return out.select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
