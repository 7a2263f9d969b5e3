"""Tree ensembles as plain expressions: fitted once with Spark ML, scored without it.

A fitted pipeline of trees is read out into nested splits. One walk over a tree makes a ``Column`` of nested
conditions, another the same in SQL, so a score is a projection: no feature vectors, no per-row transform, and
filters and pruning go on through it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any, TypeVar

from pyspark.ml import PipelineModel
from pyspark.ml.feature import OneHotEncoderModel, StringIndexerModel, VectorAssembler
from pyspark.ml.regression import (
    DecisionTreeRegressionModel,
    GBTRegressionModel,
    RandomForestRegressionModel,
)
from pyspark.sql import Column
from pyspark.sql import functions as F

T = TypeVar("T")
# A leaf is {"value": number}. A split has "column", either "at_most" (a number) or "one_of" (texts), and the
# nodes "then" and "otherwise".
Node = dict[str, Any]


@dataclass(frozen=True)
class TreeModel:
    """The weighted sum of trees, divided by ``divisor``."""

    trees: tuple[Node, ...]
    weights: tuple[float, ...]
    divisor: float = 1.0

    def expression(self) -> Column:
        """The prediction; a missing text is in no set of texts."""

        def test(node: Node) -> Column:
            column = F.col(node["column"])
            if "at_most" in node:
                return column <= F.lit(float(node["at_most"]))
            return column.isin(node["one_of"])

        sums = [
            F.lit(float(w)) * _walk(tree, F.lit, lambda node, a, b: F.when(test(node), a).otherwise(b))
            for tree, w in zip(self.trees, self.weights, strict=True)
        ]
        return reduce(lambda total, term: total + term, sums, F.lit(0.0)) / F.lit(float(self.divisor))

    def sql(self) -> str:
        """The same in standard SQL, over columns of the same names."""

        def test(node: Node) -> str:
            if "at_most" in node:
                return f"{node['column']} <= {_number(node['at_most'])}"
            texts = ", ".join("'" + text.replace("'", "''") + "'" for text in node["one_of"])
            return f"{node['column']} IN ({texts})"

        def split(node: Node, a: str, b: str) -> str:
            return f"CASE WHEN {test(node)} THEN {a} ELSE {b} END"

        sums = [
            f"{_number(w)} * {_walk(tree, _number, split)}" for tree, w in zip(self.trees, self.weights, strict=True)
        ]
        return f"({' + '.join([_number(0), *sums])}) / {_number(self.divisor)}"

    def columns(self) -> set[str]:
        """The columns that any tree asks for."""
        found: set[str] = set()
        for tree in self.trees:
            _walk(tree, lambda _: None, lambda node, a, b: found.add(node["column"]))
        return found

    def to_json(self) -> str:
        return json.dumps({"trees": self.trees, "weights": self.weights, "divisor": self.divisor})

    @classmethod
    def from_json(cls, text: str) -> TreeModel:
        stored = json.loads(text)
        return cls(tuple(stored["trees"]), tuple(stored["weights"]), stored["divisor"])


def _number(value: float) -> str:
    """A double literal that is read back as the same number."""
    return f"{float(value):.17e}"


def _walk(node: Node, leaf: Callable[[float], T], split: Callable[[Node, T, T], T]) -> T:
    """Fold a tree from its leaves up."""
    if "value" in node:
        return leaf(float(node["value"]))
    return split(node, _walk(node["then"], leaf, split), _walk(node["otherwise"], leaf, split))


def compile_trees(model: PipelineModel) -> TreeModel:
    """Read a fitted pipeline of :func:`training.fit_clv_model` or ``fit_forecast_model`` with trees.

    Columns of one-hot encoded texts become tests of the text itself. Raises for other models.
    """
    regressor = model.stages[-1]
    features = _features(model.stages[:-1])
    if isinstance(regressor, DecisionTreeRegressionModel):
        trees, weights, divisor = [regressor], [1.0], 1.0
    elif isinstance(regressor, GBTRegressionModel):
        trees, weights, divisor = regressor.trees, regressor.treeWeights, 1.0
    elif isinstance(regressor, RandomForestRegressionModel):
        trees, weights = regressor.trees, [1.0] * len(regressor.trees)
        divisor = float(len(trees))
    else:
        raise TypeError(f"{type(regressor).__name__} has no trees")
    if regressor.numFeatures != len(features):
        raise ValueError(f"the trees have {regressor.numFeatures} features, the pipeline makes {len(features)}")
    read = tuple(_node(tree._java_obj.rootNode(), features) for tree in trees)
    return TreeModel(read, tuple(float(w) for w in weights), divisor)


def _features(stages: Sequence) -> list[tuple[str, str | None]]:
    """For each place of the feature vector its column and, in an encoded one, the text it stands for."""
    numbered: dict[str, tuple[str, list[str]]] = {}  # numbered column to its source and texts
    encoded: dict[str, tuple[str, list[str]]] = {}
    for stage in stages:
        if isinstance(stage, StringIndexerModel):
            numbered[stage.getOutputCol()] = (stage.getInputCol(), list(stage.labels))
        elif isinstance(stage, OneHotEncoderModel):
            encoded[stage.getOutputCol()] = numbered[stage.getInputCol()]
        elif isinstance(stage, VectorAssembler):
            places: list[tuple[str, str | None]] = []
            for name in stage.getInputCols():
                source, texts = encoded.get(name, (name, [None]))
                places += [(source, text) for text in texts]
            return places
    raise ValueError("the pipeline has no assembler of features")


def _node(node: Any, features: list[tuple[str, str | None]]) -> Node:
    if node.getClass().getSimpleName() == "LeafNode":
        return {"value": node.prediction()}
    split = node.split()
    column, text = features[split.featureIndex()]
    left, right = _node(node.leftChild(), features), _node(node.rightChild(), features)
    numeric = split.getClass().getSimpleName() == "ContinuousSplit"
    if text is None:
        if not numeric:
            raise ValueError("splits by category numbers are not supported; encode texts one-hot")
        return {"column": column, "at_most": split.threshold(), "then": left, "otherwise": right}
    # The feature is 1 for the text and 0 for any other.
    goes_left = [x <= split.threshold() if numeric else x in set(split.leftCategories()) for x in (0.0, 1.0)]
    other, same = (left if goes else right for goes in goes_left)
    return {"column": column, "one_of": [text], "then": same, "otherwise": other}
