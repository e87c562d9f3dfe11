"""From a labelled corpus to a trained, evaluated classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame

from promptroute.operators.evaluation import confusion, evaluation_report
from promptroute.operators.passes import LinearModel, pass_figures, save_model, score, train
from promptroute.operators.sampling import stratified_split
from promptroute.session import materialise
from promptroute.sources.sinks import write_json


def train_and_evaluate(
    corpus: DataFrame, key: str = "row_key", folder: str | None = None
) -> tuple[LinearModel, DataFrame]:
    """The model and its report on the validation part.

    With a ``folder`` the model, the report and the figures of every pass are written there, and so are the weights after every
    pass, from which an interrupted training goes on.
    """
    spark = corpus.sparkSession
    split = materialise(stratified_split(corpus, key), "split")
    model = train(split, key, folder=None if folder is None else f"{folder}/passes")
    cells = materialise(confusion(score(split.filter("split = 'val'"), model)), "confusion")
    report = evaluation_report(cells)
    if folder is not None:
        save_model(spark, model, f"{folder}/model")
        write_json(report, f"{folder}/evaluation")
        write_json(pass_figures(spark, model), f"{folder}/training")
    return model, report
