"""Sources, sinks, features, labels, profiles, sampling and judging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptroute import schemas
from promptroute import settings as st
from promptroute.catalog import derived as dv
from promptroute.catalog import sql as q
from promptroute.functions.labels import id_label, stratum
from promptroute.functions.wording import JUDGE_TEMPLATE
from promptroute.operators import corpus as co
from promptroute.operators import judge, metadata, profile, sampling
from promptroute.plans.corpus_build import KEY
from promptroute.session import materialise, new_path
from promptroute.settings import LABELS
from promptroute.sources import corpora, sinks

JUDGE_SIZE = 60
LIMIT = 50
PER_CLASS = 20


# ------------------------------------------------------------------ sources and sinks
def chat_prompts(spark: SparkSession, d: str) -> DataFrame:
    return corpora.chat_prompts(dv.chat_records(spark, d))


def chat_prompts_any_language(spark: SparkSession, d: str) -> DataFrame:
    return corpora.chat_prompts_from_turns(dv.chat_turns(spark, d))


def chat_prompts_limited(spark: SparkSession, d: str) -> DataFrame:
    return corpora.chat_prompts_from_turns(dv.chat_turns(spark, d), limit=LIMIT)


def qa_prompts(spark: SparkSession, d: str) -> DataFrame:
    return corpora.qa_prompts(dv.questions(spark, d))


def gold_prompts(spark: SparkSession, d: str) -> DataFrame:
    return corpora.gold_prompts(dv.gold_records(spark, d))


def parquet_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "corpus")
    sinks.write_parquet(dv.corpus(spark, d), path, ("source_dataset", "complexity_label"))
    return corpora.read_corpus(spark, path, schemas.LABELED).select(
        "row_key", "prompt", "source_dataset", "complexity_label"
    )


def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "csv")
    sinks.write_csv(judge.attach_verdicts(dv.corpus(spark, d), KEY), path)
    schema = "prompt string, source_dataset string, complexity_label string, llm_judge_label string"
    return spark.read.schema(schema).options(**sinks.CSV_OPTIONS).csv(path)


def corpus_metadata(spark: SparkSession, d: str) -> DataFrame:
    full = _keys(spark, d)
    final = sampling.balance(full, KEY)
    sample = sampling.judge_sample(final, KEY, JUDGE_SIZE)
    return metadata.metadata_lines(metadata.corpus_metadata(full, final, sample, False))


# ------------------------------------------------------------------ features and labels
def labeller_features(spark: SparkSession, d: str) -> DataFrame:
    return co.heuristic_features(dv.workload(spark, d)).drop("prompt", "n", "source_dataset")


def rule_features(spark: SparkSession, d: str) -> DataFrame:
    return co.rule_features(dv.workload(spark, d)).drop("prompt", "n", "source_dataset")


def gold_labels(spark: SparkSession, d: str) -> DataFrame:
    return co.label_gold(dv.gold_corpus(spark, d)).select(
        "row_key", "routing_choice", "complexity_score", "complexity_label"
    )


def _labels(lex: st.Lexicon):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return co.label_corpus(dv.workload(spark, d), lex).select(
            "prompt_id", "source_dataset", "complexity_label"
        )

    return run


def label_counts_by_source(spark: SparkSession, d: str) -> DataFrame:
    labelled = co.label_corpus(dv.workload(spark, d))
    return labelled.groupBy("source_dataset", "complexity_label").agg(F.count("*").alias("n"))


def combined_corpus(spark: SparkSession, d: str) -> DataFrame:
    return dv.corpus(spark, d).drop(KEY)


def encoded_labels(spark: SparkSession, d: str) -> DataFrame:
    encoded = co.encode_labels(dv.corpus(spark, d))
    return encoded.select(
        KEY, "complexity_label", "label", id_label(F.col("label")).alias("decoded")
    )


def strata(spark: SparkSession, d: str) -> DataFrame:
    key = stratum(F.col("complexity_label"), F.col("source_dataset"))
    return dv.corpus(spark, d).select(KEY, key.alias("stratum"))


# ------------------------------------------------------------------ profiles
def label_distribution(spark: SparkSession, d: str) -> DataFrame:
    return profile.distribution(dv.corpus(spark, d), "complexity_label")


def routing_choice_distribution(spark: SparkSession, d: str) -> DataFrame:
    return profile.distribution(dv.gold_corpus(spark, d), "routing_choice")


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to some digits: their last bits depend on the order of summing."""
    return df.select(
        *[
            F.round(c, digits).alias(c) if t == "double" else F.col(c)
            for c, t in df.dtypes
        ]
    )


def length_profile(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(profile.length_profile(dv.workload(spark, d)))


def length_profile_by_source(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(profile.length_profile(dv.workload(spark, d), by=["source_dataset"]))


def token_profile(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(profile.token_profile(dv.workload(spark, d)))


def score_profile(spark: SparkSession, d: str) -> DataFrame:
    gold = dv.gold_corpus(spark, d)
    return _rounded(profile.describe_numeric(gold, F.col("complexity_score")))


def source_class_crosstab(spark: SparkSession, d: str) -> DataFrame:
    return profile.crosstab(dv.corpus(spark, d))


def source_class_table(spark: SparkSession, d: str) -> DataFrame:
    return profile.crosstab_wide(dv.corpus(spark, d), LABELS)


def preview_by_class(spark: SparkSession, d: str) -> DataFrame:
    return profile.preview(dv.corpus(spark, d), KEY, by="complexity_label", keys=_keys(spark, d))


def preview_first(spark: SparkSession, d: str) -> DataFrame:
    return profile.preview(dv.corpus(spark, d), KEY, k=15, width=80)


def source_totals(spark: SparkSession, d: str) -> DataFrame:
    return profile.source_totals(dv.corpus(spark, d))


def class_imbalance(spark: SparkSession, d: str) -> DataFrame:
    return profile.imbalance(dv.corpus(spark, d))


# ------------------------------------------------------------------ sampling
def _keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys, sources and labels of the corpus.  Written, since sampling reads them several times
    and would otherwise label every text anew each time."""
    return materialise(dv.corpus(spark, d).drop("prompt"), "keys")


def balanced_corpus(spark: SparkSession, d: str) -> DataFrame:
    return sampling.balance(_keys(spark, d), KEY)


def judge_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.judge_sample(_keys(spark, d), KEY, JUDGE_SIZE)


def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    return sampling.stratified_split(_keys(spark, d), KEY)


def hashed_split(spark: SparkSession, d: str) -> DataFrame:
    return sampling.stratified_split(dv.corpus(spark, d), KEY, exact=False).drop("prompt")


def sample_per_class(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sample_per_class(_keys(spark, d), KEY, PER_CLASS)


# ------------------------------------------------------------------ judge
def judge_requests(spark: SparkSession, d: str) -> DataFrame:
    return judge.judge_requests(dv.corpus(spark, d), KEY)


def _verdicts(rows: DataFrame) -> DataFrame:
    return judge.parse_verdicts(dv.judge_replies(rows), KEY)


def judge_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return _verdicts(dv.corpus(spark, d))


def judged_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = _keys(spark, d)
    sample = sampling.judge_sample(rows, KEY, JUDGE_SIZE)
    return judge.attach_verdicts(sample, KEY, _verdicts(rows))


def judge_agreement(spark: SparkSession, d: str) -> DataFrame:
    rows = _keys(spark, d)
    return _rounded(judge.agreement(judge.attach_verdicts(rows, KEY, _verdicts(rows))))


# ------------------------------------------------------------------ SQL
_RANKED_SAMPLE = f"""select row_key, source_dataset, complexity_label from
 (select *, row_number() over (partition by source_dataset, complexity_label order by h, row_key) as rn,
   count(*) over (partition by source_dataset, complexity_label) as n,
   count(*) over (partition by source_dataset) as source_n from hashed)
 where rn <= least(n, greatest(1, {JUDGE_SIZE} * n // source_n)) order by h, row_key limit {JUDGE_SIZE}"""

_BALANCED = """select row_key, source_dataset, complexity_label, prompt from
 (select *, row_number() over (partition by complexity_label order by h, row_key) as rn,
   count(*) over (partition by complexity_label) as n from hashed),
 (select max(c) as most, min(c) as least_n from (select count(*) as c from corpus group by complexity_label))
 where most / least_n < 3 or rn <= least(n, floor(least_n * 2.5::double), most)"""

_STATS = """count(v) as count, round(avg(v), 6) as mean, round(stddev_samp(v), 6) as std,
 round(min(v)::double, 6) as min, round(quantile_cont(v::double, 0.25), 6) as p25,
 round(quantile_cont(v::double, 0.5), 6) as p50, round(quantile_cont(v::double, 0.75), 6) as p75,
 round(max(v)::double, 6) as max"""

_DISTRIBUTION = """select value, count(*) as n, count(*) * 100::double / sum(count(*)) over () as pct
 from {source} where value is not null group by value"""

_before, _after = JUDGE_TEMPLATE.split("{prompt}")

QUERIES = {
    "chat_prompts": (
        chat_prompts,
        """select conv_id as row_key, prompt, source_dataset from openings
 join documents on doc_id = conv_id where lang = 'en'""",
    ),
    "chat_prompts_any_language": (chat_prompts_any_language, "select * from openings"),
    "chat_prompts_limited": (
        chat_prompts_limited,
        f"select * from openings order by md5('42|' || conv_id), conv_id limit {LIMIT}",
    ),
    "qa_prompts": (
        qa_prompts,
        f"""select item_id, {q.stripped('text')} as prompt, 'gsm8k' as source_dataset, length(text)::varchar as answer
 from benchmark where length({q.stripped('text')}) > 0""",
    ),
    "gold_prompts": (gold_prompts, "select * from gold"),
    "parquet_round_trip": (parquet_round_trip, "select * from corpus"),
    "csv_round_trip": (
        csv_round_trip,
        "select prompt, source_dataset, complexity_label, null::varchar as llm_judge_label from corpus",
    ),
    "corpus_metadata": (
        corpus_metadata,
        f"""select 'total_samples' as item, count(*)::varchar as value from ({_BALANCED})
 union all select 'original_size', count(*)::varchar from corpus
 union all select 'balancing_applied', case when (select count(*) from ({_BALANCED})) < count(*) then 'true' else 'false' end from corpus
 union all select 'eval_set_size', least({JUDGE_SIZE}, sum(greatest(1, least(n, {JUDGE_SIZE} * n // source_n))))::bigint::varchar from
  (select count(*) as n, sum(count(*)) over (partition by source_dataset) as source_n from ({_BALANCED}) group by source_dataset, complexity_label)
 union all select 'llm_judge_used', 'false'
 union all select 'class_distribution.' || complexity_label, count(*)::varchar from ({_BALANCED}) group by complexity_label
 union all select 'source_distribution.' || source_dataset, count(*)::varchar from ({_BALANCED}) group by source_dataset""",
    ),
    "labeller_features": (
        labeller_features,
        f"select prompt_id, {q.feature_columns()} from workload",
    ),
    "rule_features": (rule_features, f"select prompt_id, {q.rule_feature_columns()} from workload"),
    "gold_labels": (
        gold_labels,
        """select 'gold-' || doc_id as row_key, routing_choice, complexity_score, complexity_label
 from gold join gold_labels on row_key = 'gold-' || doc_id""",
    ),
    "heuristic_labels": (
        _labels(st.MAIN),
        f"select prompt_id, source_dataset, complexity_label from {q.labelled('workload', st.MAIN, q.MAIN_LABEL)}",
    ),
    "heuristic_labels_variant_a": (
        _labels(st.VARIANT_A),
        f"select prompt_id, source_dataset, complexity_label from {q.labelled('workload', st.VARIANT_A, q.VARIANT_LABEL)}",
    ),
    "heuristic_labels_variant_b": (
        _labels(st.VARIANT_B),
        f"select prompt_id, source_dataset, complexity_label from {q.labelled('workload', st.VARIANT_B, q.VARIANT_LABEL)}",
    ),
    "label_counts_by_source": (
        label_counts_by_source,
        f"""select source_dataset, complexity_label, count(*) as n
 from {q.labelled('workload', st.MAIN, q.MAIN_LABEL)} group by all""",
    ),
    "combined_corpus": (
        combined_corpus,
        "select prompt, source_dataset, complexity_label from corpus",
    ),
    "encoded_labels": (
        encoded_labels,
        """select row_key, complexity_label, (list_position(['small', 'medium', 'large'], complexity_label) - 1)::int as label,
 complexity_label as decoded from corpus""",
    ),
    "strata": (
        strata,
        "select row_key, complexity_label || '_' || source_dataset as stratum from corpus",
    ),
    "label_distribution": (
        label_distribution,
        _DISTRIBUTION.format(source="(select complexity_label as value from corpus)"),
    ),
    "routing_choice_distribution": (
        routing_choice_distribution,
        _DISTRIBUTION.format(source="(select routing_choice as value from gold)"),
    ),
    "length_profile": (
        length_profile,
        f"select {_STATS} from (select length(prompt) as v from workload)",
    ),
    "length_profile_by_source": (
        length_profile_by_source,
        f"select source_dataset, {_STATS} from (select source_dataset, length(prompt) as v from workload) group by source_dataset",
    ),
    "token_profile": (
        token_profile,
        f"select {_STATS} from (select length(prompt) / 4 as v from workload)",
    ),
    "score_profile": (score_profile, f"select {_STATS} from (select complexity_score as v from gold)"),
    "source_class_crosstab": (
        source_class_crosstab,
        """select source_dataset, complexity_label, grouping(source_dataset, complexity_label)::int as level,
 count(*) as n from corpus group by cube (source_dataset, complexity_label)""",
    ),
    "source_class_table": (
        source_class_table,
        """select coalesce(source_dataset, 'all') as source_dataset,
 count(*) filter (where complexity_label = 'small') as small,
 count(*) filter (where complexity_label = 'medium') as medium,
 count(*) filter (where complexity_label = 'large') as large, count(*) as "all"
 from corpus group by rollup (source_dataset)""",
    ),
    "preview_by_class": (
        preview_by_class,
        """select rn::int as position, row_key, source_dataset, complexity_label,
 case when length(prompt) > 150 then substr(prompt, 1, 150) || '...' else prompt end as prompt from
 (select *, row_number() over (partition by complexity_label order by h, row_key) as rn from hashed) where rn <= 3""",
    ),
    "preview_first": (
        preview_first,
        """select row_key, source_dataset, complexity_label,
 case when length(prompt) > 80 then substr(prompt, 1, 80) || '...' else prompt end as prompt
 from corpus order by row_key limit 15""",
    ),
    "source_totals": (
        source_totals,
        "select source_dataset, count(*) as n from corpus group by rollup (source_dataset)",
    ),
    "class_imbalance": (
        class_imbalance,
        """select max(n) as max_count, min(n) as min_count, max(n) / min(n) as ratio
 from (select count(*) as n from corpus group by complexity_label)""",
    ),
    "balanced_corpus": (
        balanced_corpus,
        f"select row_key, source_dataset, complexity_label from ({_BALANCED})",
    ),
    "judge_sample": (judge_sample, _RANKED_SAMPLE),
    "stratified_split": (
        stratified_split,
        "select row_key, source_dataset, complexity_label, split from split",
    ),
    "hashed_split": (
        hashed_split,
        """select row_key, source_dataset, complexity_label,
 case when substr(h, 1, 8) < '33333333' then 'val' else 'train' end as split from hashed""",
    ),
    "sample_per_class": (
        sample_per_class,
        f"""select row_key, source_dataset, complexity_label from (select *,
 row_number() over (partition by complexity_label order by h, row_key) as rn from hashed) where rn <= {PER_CLASS}""",
    ),
    "judge_requests": (
        judge_requests,
        f"select row_key, {q.text(_before)} || substr(prompt, 1, 1000) || {q.text(_after)} as request from corpus",
    ),
    "judge_verdicts": (judge_verdicts, "select row_key, llm_judge_label from judged"),
    "judged_sample": (
        judged_sample,
        f"select s.*, llm_judge_label from ({_RANKED_SAMPLE}) s join judged j on j.row_key = s.row_key",
    ),
    "judge_agreement": (
        judge_agreement,
        """select complexity_label, count(*) as judged,
 round(avg((complexity_label = llm_judge_label)::int), 6) as agreement
 from judged where llm_judge_label is not null group by rollup (complexity_label)""",
    ),
}
