"""Pairwise rankers: a linear one, and boosted regression trees with Newton leaves.

Spark's trees take no NaN, so an unknown rating is replaced by -1; its flag column tells it apart.
Scores will not equal those of another library's trees.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SearchConfig

MISSING = -1.0
KEYS = ("query_id", "item_pos")


def fit_linear(rows: DataFrame, pairs: DataFrame, features: list[str], l2: float = 1e-3) -> list[float]:
    """Coefficients of the pairwise logistic loss: logistic regression without intercept on the
    differences of winner and loser and, mirrored, of loser and winner."""
    x = rows.select(*KEYS, _filled(features).alias("x"))
    a = x.select("query_id", F.col("item_pos").alias("winner"), F.col("x").alias("xa"))
    b = x.select("query_id", F.col("item_pos").alias("loser"), F.col("x").alias("xb"))
    d = pairs.join(a, ["query_id", "winner"]).join(b, ["query_id", "loser"])
    d = d.select("weight", *[(F.col("xa")[i] - F.col("xb")[i]).alias(f"d{i}") for i in range(len(features))])
    both = d.withColumn("label", F.lit(1.0)).unionByName(d.select("weight", *[(-F.col(f"d{i}")).alias(f"d{i}") for i in range(len(features))]).withColumn("label", F.lit(0.0)))
    table = VectorAssembler(inputCols=[f"d{i}" for i in range(len(features))], outputCol="d").transform(both)
    model = LogisticRegression(featuresCol="d", labelCol="label", weightCol="weight", fitIntercept=False, regParam=l2).fit(table)
    return [float(c) for c in model.coefficients]


def linear_score(features: list[str], coefficients: list[float]) -> Column:
    terms = [F.coalesce(F.col(c).cast("double"), F.lit(MISSING)) * F.lit(w) for c, w in zip(features, coefficients, strict=True)]
    return sum(terms[1:], terms[0])


@dataclass(frozen=True)
class Tree:
    """A regression tree as flat arrays; a leaf has itself as both children."""

    feature: tuple[int, ...]
    threshold: tuple[float, ...]
    left: tuple[int, ...]
    right: tuple[int, ...]
    value: tuple[float, ...]

    def places(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        feature, threshold, left, right = (np.asarray(a) for a in (self.feature, self.threshold, self.left, self.right))
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while True:
            below = np.where(x[rows, feature[at]] <= threshold[at], left[at], right[at])
            if (below == at).all():
                return at
            at = below

    @classmethod
    def of(cls, model: DecisionTreeRegressionModel) -> Tree:
        """The shape of a fitted tree, all leaves 0; at most 2 ** (depth + 1) nodes."""
        rows: list[list] = []

        def add(node) -> int:
            me = len(rows)
            rows.append([0, 0.0, me, me, 0.0])
            if node.subtreeDepth():
                split = node.split()
                rows[me][:2] = [split.featureIndex(), split.threshold()]
                rows[me][2] = add(node.leftChild())
                rows[me][3] = add(node.rightChild())
            return me

        add(model._java_obj.rootNode())
        return cls(*map(tuple, zip(*rows, strict=True)))


def _matrix(x: pd.Series, width: int) -> np.ndarray:
    return np.stack(x.to_numpy()) if len(x) else np.zeros((0, width))


def _filled(features: list[str]) -> Column:
    """The features as an array of doubles, null and NaN as ``MISSING``."""
    return F.array(*[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(MISSING)) for c in features])


def score(trees: list[Tree], x: Column, width: int) -> Column:
    """Sum of the trees' values, all trees in one pass over Arrow batches."""

    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        rows = _matrix(x, width)
        out = np.zeros(len(rows))
        for tree in trees:
            out += np.asarray(tree.value)[tree.places(rows)]
        return pd.Series(out)

    return run(x)


def leaf(tree: Tree, x: Column, width: int) -> Column:
    @F.pandas_udf("long")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(tree.places(_matrix(x, width)))

    return run(x)


@dataclass
class Boosted:
    features: list[str]
    trees: list[Tree] = field(default_factory=list)
    metadata: dict[str, str] = field(default_factory=dict)

    def predict(self, rows: DataFrame, trees: int | None = None) -> DataFrame:
        """Adds ``prediction``, the sum of the first ``trees`` trees; by default the chosen number."""
        if trees is None and "selected_trees" in self.metadata:
            trees = int(self.metadata["selected_trees"])
        return rows.withColumn("prediction", score(self.trees[:trees], _filled(self.features), len(self.features)))

    def save(self, spark: SparkSession, path: str) -> None:
        """Trees and description as tables, written by Spark wherever ``path`` lies."""
        nodes = [(i, k, *n) for i, t in enumerate(self.trees) for k, n in enumerate(zip(t.feature, t.threshold, t.left, t.right, t.value, strict=True))]
        spark.createDataFrame(nodes, NODES).coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")
        meta = json.dumps({"features": self.features, "trees": len(self.trees), "metadata": self.metadata}, sort_keys=True)
        spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/model")

    @classmethod
    def load(cls, spark: SparkSession, path: str, key: str | None = None) -> Boosted:
        """Raises ValueError if the model was trained on other data or parameters than ``key`` names."""
        meta = json.loads(spark.read.text(f"{path}/model").first()[0])
        if key is not None and meta["metadata"].get("training_key") != key:
            raise ValueError(f"training data or parameters of {path} have changed")
        rows: list[list[tuple]] = [[] for _ in range(meta["trees"])]
        for r in spark.read.schema(NODES).parquet(f"{path}/trees").orderBy("tree", "node").collect():  # a model's size
            rows[r["tree"]].append((r["feature"], r["threshold"], r["left"], r["right"], r["value"]))
        return cls(meta["features"], [Tree(*map(tuple, zip(*t, strict=True))) for t in rows], meta["metadata"])

    def choose(self, trees: int, weight: float, config: dict, semantic: bool = True, split: str = "holdout") -> Boosted:
        """Notes the choices made on validation data beside the model."""
        self.metadata |= {"selected_trees": str(trees), "ranker_weight": str(weight), "search_config": json.dumps(config, sort_keys=True), "semantic": str(int(semantic)), "evaluation_split": split}
        return self

    @property
    def weight(self) -> float:
        return float(self.metadata.get("ranker_weight", 0.5))

    @property
    def semantic(self) -> bool:
        return self.metadata.get("semantic", "0") == "1"

    @property
    def config(self) -> SearchConfig:
        return SearchConfig(**json.loads(self.metadata["search_config"])) if "search_config" in self.metadata else SearchConfig()


NODES = "tree int, node int, feature int, threshold double, left int, right int, value double"


def fit_boosted(rows: DataFrame, pairs: DataFrame, features: list[str], rounds: int = 50, depth: int = 6, rate: float = 0.05, l2: float = 5.0, cut_every: int = 5, materialise=None, key: str = "") -> Boosted:
    """Gradient boosting of the pairwise logistic loss.

    Each round sums the pair gradients for each row, fits a weighted tree to gradient over curvature
    and sets each leaf to sum of gradients / (sum of curvatures + l2). ``materialise`` cuts the
    lineage every few rounds; by default it checkpoints.
    """
    cut = materialise or (lambda df: df.checkpoint())
    model, width = Boosted(features, metadata={"training_key": key}), len(features)
    state = cut(rows.select(*KEYS, _filled(features).alias("x"), F.lit(0.0).alias("prediction")))
    pairs = cut(pairs.select("query_id", "winner", "loser", "weight"))
    for i in range(rounds):
        s = state.select("query_id", "item_pos", F.col("prediction").alias("s"))
        a, b = s.withColumnsRenamed({"item_pos": "winner", "s": "sa"}), s.withColumnsRenamed({"item_pos": "loser", "s": "sb"})
        p = 1.0 / (1.0 + F.exp(F.col("sa") - F.col("sb")))
        g = pairs.join(a, ["query_id", "winner"]).join(b, ["query_id", "loser"]).withColumn("g", F.col("weight") * p).withColumn("h", F.col("weight") * p * (1 - p))
        each = g.select("query_id", F.explode(F.array(F.struct(F.col("winner").alias("item_pos"), F.col("g").alias("g"), F.col("h").alias("h")), F.struct(F.col("loser").alias("item_pos"), (-F.col("g")).alias("g"), F.col("h").alias("h")))).alias("e"))
        sums = each.groupBy("query_id", F.col("e.item_pos").alias("item_pos")).agg(F.sum("e.g").alias("g"), F.sum("e.h").alias("h"))
        data = cut(state.join(sums, list(KEYS)).select("x", "g", "h", (F.col("g") / F.greatest(F.col("h"), F.lit(1e-9))).alias("target")))
        fitted = DecisionTreeRegressor(featuresCol="v", labelCol="target", weightCol="h", maxDepth=depth, seed=1).fit(data.withColumn("v", array_to_vector("x")))
        tree = Tree.of(fitted)
        found = data.groupBy(leaf(tree, F.col("x"), width).alias("leaf")).agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()  # at most 2 ** depth rows
        values = {r["leaf"]: rate * r["g"] / (r["h"] + l2) for r in found}
        tree = replace(tree, value=tuple(values.get(k, 0.0) for k in range(len(tree.value))))
        model.trees.append(tree)
        state = state.withColumn("prediction", F.col("prediction") + score([tree], F.col("x"), width))
        if (i + 1) % cut_every == 0:
            state = cut(state)
    return model
