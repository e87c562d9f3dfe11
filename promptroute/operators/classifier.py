"""Training and batch scoring of the three-class prompt classifier (Spark ML)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import (
    IDF,
    Bucketizer,
    HashingTF,
    Interaction,
    OneHotEncoder,
    RegexTokenizer,
    SQLTransformer,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptroute.functions.labels import id_label
from promptroute.operators.corpus import encode_labels, heuristic_features
from promptroute.operators.evaluation import confusion, metrics
from promptroute.operators.once import with_computed_once
from promptroute.operators.sampling import first_by_hash, stratified_split
from promptroute.session import materialise
from promptroute.settings import LABELS

MAX_TOKENS = 256
MAX_TRAINING_ROWS = 2_000_000
HASH_FEATURES = 1 << 14
NUMERIC = (
    "token_count",
    "char_count",
    "has_code_blocks",
    "question_count",
    "has_multi_step",
    "has_math",
    "has_code",
    "is_simple",
)
FLAGS = ("has_code_blocks", "has_multi_step", "has_math", "has_code", "is_simple")
# Edges of the length bands, in estimated tokens: a linear model cannot bend at a length otherwise.
LENGTH_BANDS = (0, 5, 10, 20, 30, 40, 50, 75, 100, 150, 200, 300, 500, 1000, float("inf"))
REGULARISATION = (0.001, 0.003, 0.01)
# Half L1: most hashed words say nothing about the class and should weigh nothing.
ELASTIC_NET = 0.5


def feature_pipeline(max_tokens: int = MAX_TOKENS, features: int = HASH_FEATURES) -> Pipeline:
    """Lower-cased words (the first ``max_tokens``) as hashed TF-IDF, plus the text features, the
    length band, and each yes/no feature within each band."""
    return Pipeline(
        stages=[
            RegexTokenizer(
                inputCol="prompt", outputCol="_words", pattern=r"[^\p{L}\p{N}]+", toLowercase=True
            ),
            SQLTransformer(
                statement=f"SELECT *, slice(_words, 1, {max_tokens}) AS _tokens FROM __THIS__"
            ),
            HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=features),
            IDF(inputCol="_tf", outputCol="_tfidf", minDocFreq=2),
            Bucketizer(inputCol="token_count", outputCol="_band", splits=list(LENGTH_BANDS)),
            OneHotEncoder(inputCol="_band", outputCol="_bands", handleInvalid="keep"),
            VectorAssembler(inputCols=list(FLAGS), outputCol="_flags"),
            Interaction(inputCols=["_bands", "_flags"], outputCol="_banded_flags"),
            VectorAssembler(
                inputCols=["_tfidf", "_bands", "_banded_flags", *NUMERIC], outputCol="features"
            ),
        ]
    )


def with_text_features(df: DataFrame) -> DataFrame:
    return heuristic_features(df.drop(*NUMERIC))


def macro_f1(scored: DataFrame) -> float:
    return metrics(confusion(scored)).first()["f1_macro"]


def train(
    df: DataFrame,
    key: str = "row_key",
    candidates: Sequence[float] = REGULARISATION,
    max_iter: int = 25,
    features: int = HASH_FEATURES,
    aggregation_depth: int = 2,
    max_rows: int = MAX_TRAINING_ROWS,
) -> PipelineModel:
    """Fit on the training part of ``df`` and keep the candidate with the best macro F1 on the rest.

    Of a larger training part its first ``max_rows`` in hash order are used: a linear model of some
    ten thousand weights gains nothing from more, and 25 passes over them cost alike at every size.

    ``df`` needs ``prompt``, ``source_dataset`` and ``complexity_label``; it is split here unless
    it has a ``split`` column.  The feature vectors are written once to the work folder and read
    by every fit.  Gradients are summed as a tree of ``aggregation_depth``, so the driver sees a
    few partial sums; a cluster with thousands of tasks wants a depth of 3.
    """
    if "split" not in df.columns:
        df = stratified_split(df, key)
    chosen = first_by_hash(df.filter("split = 'train'"), key, max_rows)
    df = chosen.unionByName(df.filter("split = 'val'"))
    prepared = with_text_features(encode_labels(df))
    model = feature_pipeline(features=features).fit(prepared.filter("split = 'train'"))
    vectors = materialise(
        model.transform(prepared).select("features", "label", "complexity_label", "split"),
        "vectors",
    )
    training, rest = vectors.filter("split = 'train'"), vectors.filter("split = 'val'")
    best = None
    for strength in candidates:
        fitted = LogisticRegression(
            family="multinomial",
            regParam=strength,
            elasticNetParam=ELASTIC_NET,
            maxIter=max_iter,
            aggregationDepth=aggregation_depth,
        ).fit(training)
        quality = macro_f1(with_prediction(fitted.transform(rest)))
        if best is None or quality > best[0]:
            best = (quality, fitted)
    return PipelineModel(stages=[*model.stages, best[1]])


def with_prediction(transformed: DataFrame) -> DataFrame:
    """Model output to ``predicted``, ``confidence`` and ``all_probs``."""
    probs = F.col("_probs")
    outputs = {"_probs": vector_to_array("probability"), "_class": F.col("prediction").cast("int")}
    return (
        with_computed_once(transformed, outputs)
        .withColumn("predicted", id_label(F.col("_class")))
        .withColumn("confidence", F.array_max(probs))
        .withColumn(
            "all_probs", F.map_from_arrays(F.array(*[F.lit(name) for name in LABELS]), probs)
        )
        .drop("_probs", "_class")
    )


def score(df: DataFrame, model: PipelineModel) -> DataFrame:
    """``df`` with the model's label, its probability, and the probability of each class."""
    scored = with_prediction(model.transform(with_text_features(df)))
    return scored.select(*df.columns, "predicted", "confidence", "all_probs")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
