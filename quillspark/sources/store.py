"""Stored tables with keys, digests, and the checks made when they are read again."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from dataclasses import asdict, dataclass, field, is_dataclass
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_LOCAL: dict[str, str] = {}


def scratch_table(df: DataFrame) -> DataFrame:
    """Writes a table to the shared folder of ``spark.checkpoint.dir`` and reads it back, which cuts
    the lineage. Without that setting a local session, as in tests, gets a folder of its own; on a
    cluster, whose executors share no local folder, it is an error."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = _LOCAL.setdefault("root", "file://" + tempfile.mkdtemp(prefix="quill-"))
    path = f"{root.rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 of one file, read through Spark so that any store will do."""
    return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]


def frame_digest(df: DataFrame, order: str | None = None) -> str:
    """SHA-256 of column names and rows. With ``order`` a row's hash takes in its position, so that
    other orders differ; without it only the multiset counts."""
    columns = [c for c in df.columns if c != order]
    row = F.sha2(F.to_json(F.struct(*[F.col(c) for c in ([order] if order else []) + columns]), {"ignoreNullFields": "false"}), 256)
    parts = [F.conv(F.substring("_h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]
    total = df.select(row.alias("_h")).agg(F.count("*"), *[F.coalesce(F.sum(p), F.lit(0)) for p in parts]).first()
    return hashlib.sha256(json.dumps([columns, [str(v) for v in total]]).encode()).hexdigest()


def key_of(*parts) -> str:
    """Key of inputs: frames by their digest, anything else as JSON."""
    return hashlib.sha256(json.dumps([frame_digest(p) if isinstance(p, DataFrame) else p for p in parts], sort_keys=True, default=str).encode()).hexdigest()


def code_digest(package: str = "quillspark", without: tuple[str, ...] = ("llm", "plans")) -> str:
    """SHA-256 of the package's sources: results that other code made have another key."""
    root = Path(__file__).resolve().parent.parent
    h = hashlib.sha256()
    for file in sorted(root.rglob("*.py")):
        if not set(without) & set(file.relative_to(root).parts):
            h.update(str(file.relative_to(root)).encode() + b"\0" + file.read_bytes())
    return h.hexdigest()


@dataclass(frozen=True)
class BlockInputs:
    """What a block of features is made from: its tables' digests and everything that decides its values."""

    tables: dict[str, str]  # role to digest
    lexical: dict  # settings of the search
    dense: dict | None = None  # settings and encoder signature of a block with dense columns
    fold: tuple[int, int] | None = None  # seed and number of a block to train on
    code: str = field(default_factory=code_digest)

    def key(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True, default=str).encode()).hexdigest()


#: Columns of the searches that say what is relevant; only a block to train on depends on them.
ANSWERS = ("gold", "known_positives")


def block_inputs(items: DataFrame, queries: DataFrame, pairs: DataFrame, config, encoder: str | None = None, fold: tuple[int, int] | None = None) -> BlockInputs:
    """Inputs of a block: dense settings count only where an encoder makes dense columns."""
    asked = queries if fold is not None else queries.drop(*ANSWERS)
    settings = asdict(config) if is_dataclass(config) else dict(config)
    dense = {k: settings.pop(k) for k in sorted(settings) if k.startswith("e5_") or k == "max_length"}
    tables = {"items": frame_digest(items), "queries": frame_digest(asked), "pairs": frame_digest(pairs)}
    return BlockInputs(tables, settings, None if encoder is None else dense | {"encoder": encoder}, fold)


def search_key(items: DataFrame, queries: DataFrame, channel: str, config, model=None) -> str:
    """Key of a channel's stored candidates; with a location model its counts count."""
    settings = asdict(config) if is_dataclass(config) else dict(config)
    return key_of(items, queries.drop(*ANSWERS), channel, settings if model is not None else None, frame_digest(model.counts) if model is not None else None, code_digest())


def save(df: DataFrame, path: str, key: str) -> None:
    """The table and, last, its key: a broken write has no key and is not read."""
    df.write.mode("overwrite").parquet(f"{path}/rows")
    df.sparkSession.createDataFrame([(key,)], "key string").coalesce(1).write.mode("overwrite").json(f"{path}/key")


def load(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Raises ValueError if the stored table has another key or none."""
    try:
        stored = spark.read.schema("key string").json(f"{path}/key").first()
    except AnalysisException:
        stored = None
    if stored is None or stored["key"] != key:
        raise ValueError(f"{path} is missing or was made from other inputs")
    return spark.read.parquet(f"{path}/rows")


def cached(make, path: str, key: str, spark: SparkSession, rebuild: bool = False) -> DataFrame:
    """What ``make`` returns, from the store if its key fits."""
    if not rebuild:
        return load(spark, path, key)
    save(make(), path, key)
    return load(spark, path, key)


def check_queries(stored: DataFrame, given: DataFrame, position: str = "query_pos") -> None:
    """Stored and given searches must be equal row by row, nulls included."""
    columns = [c for c in given.columns if c != position]
    a = stored.select(F.col(position), *[F.col(c).cast("string").alias(c) for c in columns])
    b = given.select(F.col(position).alias("_p"), *[F.col(c).cast("string").alias(f"_{c}") for c in columns])
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    differ = a.join(b, F.col(position) == F.col("_p"), "full").where(F.col(position).isNull() | F.col("_p").isNull() | ~same)
    if not differ.isEmpty():
        raise ValueError("the stored searches are other ones or stand in another order")


def check_features(rows: DataFrame, items: DataFrame, names: list[str]) -> None:
    """Feature rows must be distinct pairs of known positions with all columns."""
    missing = [n for n in names if n not in rows.columns]
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    n, distinct = rows.agg(F.count("*"), F.count_distinct("query_id", "item_pos")).first()
    if n != distinct:
        raise ValueError("a pair occurs twice")
    if not rows.join(items, "item_pos", "left_anti").isEmpty():
        raise ValueError("a position is not in the catalogue")


def add_columns(rows: DataFrame, more: DataFrame) -> DataFrame:
    """Features widened by another block, which must have exactly one row for each of their pairs."""
    keys = ["query_id", "item_pos"]
    lacking = rows.join(more.select(keys), keys, "left_anti")
    if not lacking.isEmpty() or not more.join(rows.select(keys), keys, "left_anti").isEmpty():
        raise ValueError("the blocks are of other pairs")
    return many_to_one(rows, more, keys)


def many_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join that must not multiply rows of ``left``: a key that ``right`` has twice is an error."""
    if not right.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").isEmpty():
        raise ValueError(f"{keys} is no key of the right side")
    return left.join(right, keys, how)
