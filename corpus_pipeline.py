"""From raw documents to a training mix: five stages, each one operator of ``quillspark.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's ``docs``. All but the last return the columns of ``documents``; ``n_chars``
follows the text. Documents that a stage empties of words go.

Defined results: rows with a null text go at language ID, as it rejects them; rows that share an id but
not the text, and rows without an id, are documents of their own in every stage; of rows that are
equal in id and text one stays after the n-gram Jaccard join, since they are copies; columns beyond those of
``documents``, whatever their names, stay as they are; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import decontaminate, jaccard_join, language_id, line_dedup, mixing
from quillspark.llm.common import BLANK, discard, materialise, read, scratch_scope


#: Bytes of an Arrow batch in the pipeline's session: its stages return plans that run Python workers over
#: whole texts one after the other, in executors of a few GB.
BATCH_BYTES = 2_000_000


def _bounded(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def _packed(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns that an operator looks at, and the whole row but for its text beside them under one
    name, so that no column of ``docs`` clashes with the operator's own."""
    return docs.select(*columns, F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_row"))


def _rows(docs: DataFrame) -> list:
    return [F.col("text") if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns]


def _with_new_text(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows with the operator's texts and their lengths; wordless texts go."""
    out = out.where(F.col("text").rlike(f"[^{BLANK}]"))
    length = F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars") if "n_chars" in docs.columns else None
    return out.select(*[F.col("text") if c == "text" else length if c == "n_chars" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier accepts."""
    _bounded(spark)
    model = language_id.fit(docs.where(language_id.fold() != 2))
    accepted = language_id.predict(_packed(docs, "text"), model).where("not rejected")
    return accepted.select(_rows(docs))


def stage_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the repeated line chunks of documents before them."""
    _bounded(spark)
    return _with_new_text(line_dedup.dedup(_packed(docs, "doc_id", "text")), docs)


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates (five words, similarity 0.8): that with the
    smallest id. Documents without words are components of their own. Rows without an id, and those
    that share one, are told apart by their text; equal ones are one document."""
    _bounded(spark)
    shared_ids = materialise(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").select(F.col("doc_id").alias("_id")), "shared-ids")
    key = F.col("doc_id").cast("long")
    parts = [docs]
    if not shared_ids.isEmpty():
        same = F.col("doc_id").eqNullSafe(F.col("_id"))
        rows = _packed(docs.join(shared_ids, same, "left_semi"), "doc_id", "text")
        rows = rows.groupBy("doc_id", "text").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
        parts = [docs.join(shared_ids, same, "left_anti"), materialise(rows.select(_rows(docs)), "shared-id-rows")]
    # keys of the second part lie above all ids
    keys = [key, F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 2)]
    work = None
    for part, k in zip(parts, keys):
        own = part.select(k.alias("key"), "text")
        work = own if work is None else work.unionByName(own)
    members, labels = jaccard_join.join_links(work, id_col="key", n=5, percent=80)
    found = members.join(labels, members["cid"] == labels["node"], "left")
    stays = found.where(F.coalesce("label", "cid", "doc") == F.col("doc")).select("doc").distinct()
    out = None
    for part, k in zip(parts, keys):
        kept = part.join(stays, k == stays["doc"], "left_semi")
        out = kept if out is None else out.unionByName(kept)
    return out


def stage_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages; documents that are mostly benchmark go."""
    _bounded(spark)
    clean = decontaminate.remove(_packed(docs, "text"), read(spark, sf_dir, "benchmark"))
    return _with_new_text(clean, docs)


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the weighted mix takes: the documents with size, source_size, target, taken and copies,
    which replace columns of these names."""
    _bounded(spark)
    return mixing.mix_documents(docs)


STAGES = [
    ("language ID", stage_language),
    ("line dedup", stage_lines),
    ("n-gram Jaccard join", stage_near_duplicates),
    ("benchmark decontamination", stage_benchmark),
    ("mixing", stage_mix),
]

#: SQL can't express compression, so the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other. What a stage wrote for itself, and its input, are deleted once its
    result is written; the last stage's tables stay for the reader of its result."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        keep: list[str] = []
        with scratch_scope(spark, keep):
            out = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            keep.append(out.scratch)
        discard(docs)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
