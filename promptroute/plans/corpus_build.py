"""From raw corpora to a labelled, balanced corpus with an evaluation sample."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptroute.operators.corpus import combine, label_corpus, label_gold
from promptroute.operators.judge import attach_verdicts
from promptroute.operators.metadata import corpus_metadata
from promptroute.operators.sampling import balance, judge_sample
from promptroute.session import delete, folders, materialise
from promptroute.settings import JUDGE_SAMPLE_SIZE, MAIN, Lexicon
from promptroute.sources.sinks import write_csv, write_json, write_parquet

KEY = "row_key"


@dataclass(frozen=True)
class Corpus:
    full: DataFrame
    balanced: DataFrame
    evaluation: DataFrame
    judged: bool

    def metadata(self) -> DataFrame:
        return corpus_metadata(self.full, self.balanced, self.evaluation, self.judged)

    def publish(self, folder: str) -> None:
        """Write the corpus, the evaluation set and the summary."""
        by = ("source_dataset", "complexity_label")
        write_parquet(self.balanced, f"{folder}/labeled", by, compact=True)
        write_csv(self.balanced, f"{folder}/labeled_csv")
        write_parquet(self.evaluation, f"{folder}/evaluation")
        write_csv(self.evaluation, f"{folder}/evaluation_csv")
        write_json(self.metadata(), f"{folder}/metadata")

    def release(self, folder: str) -> int:
        """Publish as the next version in ``folder`` and return its number.

        A version is a folder of its own whose manifest is written last: readers who go by ``latest_release`` see the version before
        or this one whole, whatever fails on the way.  The version before stays for those still reading it; older ones
        are deleted, and so is what a failed release left of this one.
        """
        spark = self.full.sparkSession
        done = releases(spark, folder)
        number = max(done, default=0) + 1
        delete(spark, _version(folder, number))
        self.publish(_version(folder, number))
        rows = [("labeled", self.balanced.count()), ("evaluation", self.evaluation.count())]
        listed = spark.createDataFrame(rows, "output string, n long").coalesce(1)
        write_json(listed.withColumn("version", F.lit(number)), f"{_version(folder, number)}/manifest")
        for old in done:
            if old < number - 1:
                delete(spark, _version(folder, old))
        return number


def _version(folder: str, number: int) -> str:
    return f"{folder}/version-{number}"


def releases(spark: SparkSession, folder: str) -> list[int]:
    """The versions in ``folder`` that have a whole manifest."""
    found = [f for f in folders(spark, folder) if f.startswith("version-")]
    return sorted(int(f.removeprefix("version-")) for f in found if "_SUCCESS" in folders(spark, f"{folder}/{f}/manifest"))


def latest_release(spark: SparkSession, folder: str) -> str | None:
    """The folder of the newest whole version, or none."""
    done = releases(spark, folder)
    return _version(folder, done[-1]) if done else None


def label_and_combine(
    gold: DataFrame, chat: DataFrame, math: DataFrame, lex: Lexicon = MAIN
) -> DataFrame:
    """Gold labels where there are any, heuristic labels elsewhere; one bag of rows.  Narrow."""
    return combine(label_gold(gold), label_corpus(chat, lex), label_corpus(math, lex), keep=(KEY,))


def build_corpus(
    gold: DataFrame,
    chat: DataFrame,
    math: DataFrame,
    verdicts: DataFrame | None = None,
    sample_size: int = JUDGE_SAMPLE_SIZE,
    lex: Lexicon = MAIN,
) -> Corpus:
    """The whole build.

    The labelled and the balanced corpus are written once: sampling reads keys and labels several times, and
    every output is made from them, which would otherwise label and choose all over again each time.
    """
    full = materialise(label_and_combine(gold, chat, math, lex), "labeled")
    balanced = materialise(balance(full, KEY), "balanced")
    sample = materialise(judge_sample(balanced, KEY, sample_size), "sample")
    return Corpus(full, balanced, attach_verdicts(sample, KEY, verdicts), verdicts is not None)
