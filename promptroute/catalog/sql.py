"""The derived tables in SQL, and helpers that spell word lists out as SQL."""

from __future__ import annotations

import re

from promptroute import settings as st
from promptroute.catalog import derived as dv


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def any_of(column: str, words) -> str:
    return "(" + " or ".join(f"contains({column}, {text(w)})" for w in words) + ")" if words else "false"


def hits(column: str, words) -> str:
    return "(" + " + ".join(f"contains({column}, {text(w)})::int" for w in words) + ")"


def listing(values) -> str:
    return "[" + ", ".join(text(v) for v in values) + "]"


# What Python counts as whitespace, for RE2.
WS = (
    r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
WORDS = f"len(regexp_extract_all(prompt, '[^{WS[1:]}+'))::int"


# A number in any script, and a character that is no part of a word, for RE2.
NUMBER = r"(\p{Nd}+\.?\p{Nd}*)"
NO_WORD = r"[^\p{L}\p{N}_]"
# The digits the replies use besides ASCII: Arabic-Indic and full-width.
DIGITS = "\u0660\u0661\u0662\u0663\u0664\u0665\u0666\u0667\u0668\u0669" + "".join(map(chr, range(0xFF10, 0xFF1A)))


def number(column: str, pattern: str) -> str:
    found = f"nullif(regexp_extract({column}, '{pattern}', 1), '')"
    return f"try_cast(translate({found}, '{DIGITS}', '{'0123456789' * 2}') as double)"


def stripped(column: str) -> str:
    return f"regexp_replace({column}, '^{WS}+|{WS}+$', '', 'g')"


def features(lex: st.Lexicon) -> dict[str, str]:
    blocks = "contains(prompt, '```')"
    if lex.indented_code:
        blocks += f" or regexp_matches(prompt, '\\n{WS}{{4,}}')"
    simple = any_of("substr(lower(prompt), 1, 50)", lex.simple)
    if lex.simple_max_chars is not None:
        simple = f"(length(prompt) < {lex.simple_max_chars} and {simple})"
    return {
        "token_count": "(length(prompt) // 4)::int",
        "char_count": "length(prompt)::int",
        "has_code_blocks": f"({blocks})",
        "question_count": "(length(prompt) - length(replace(prompt, '?', '')))::int",
        "has_multi_step": any_of("lower(prompt)", lex.reasoning),
        "has_math": f"({any_of('prompt', lex.symbols)} or {any_of('lower(prompt)', lex.math_words)})",
        "has_code": any_of("lower(prompt)", lex.code),
        "is_simple": simple,
    }


def feature_columns(lex: st.Lexicon = st.MAIN) -> str:
    return ", ".join(f"{expr} as {name}" for name, expr in features(lex).items())


MAIN_LABEL = """case
  when source_dataset = 'gsm8k' then
    case when token_count < 40 and not has_multi_step then 'medium' else 'large' end
  when is_simple and token_count < 50 then 'small'
  when token_count < 30 and not (has_multi_step or has_math or has_code or has_code_blocks) then 'small'
  when has_multi_step or has_math or has_code_blocks then 'large'
  when token_count > 300 or question_count >= 3 then 'large'
  else 'medium' end"""

VARIANT_LABEL = """case
  when source_dataset = 'gsm8k' then case when token_count < 40 then 'medium' else 'large' end
  when is_simple and token_count < 50 then 'small'
  when token_count < 30 and not (has_multi_step or has_math or has_code) then 'small'
  when has_multi_step or has_math or has_code_blocks or token_count > 300 then 'large'
  else 'medium' end"""


def labelled(table: str, lex: st.Lexicon, rule: str) -> str:
    return f"(select *, {rule} as complexity_label from (select *, {feature_columns(lex)} from {table}))"


_TEMPLATE = f"{listing(dv.TEMPLATES)}[(n % {len(dv.TEMPLATES)})::int + 1]"
_LABELS = "['small', 'medium', 'large']"
_MODEL_IDS = listing([m[0] for m in st.MODELS] + [dv.UNLISTED_MODEL])
_RULE_CASES = """
 case when proof_hit and (predicted = 'small' or (predicted = 'medium' and w > 20)) then 'large' end as r1,
 case when w > 120 then case when predicted <> 'large' then 'large' end
      when w > 100 and predicted = 'small' then 'large'
      when w > 80 and predicted = 'small' then 'medium' end as r2,
 case when depth_count >= 2 and predicted = 'small' then 'large'
      when depth_count >= 3 and predicted = 'medium' then 'large' end as r3,
 case when step_count >= 3 and predicted = 'small' and w > 30 and medium_prob > 0.1 then 'medium' end as r4,
 case when code_hit and tech_count >= 5 then case when predicted <> 'large' then 'large' end
      when code_hit and req_count >= 3 and w > 20 then
        case when predicted = 'small' then 'large'
             when predicted = 'medium' and req_count >= 5 then 'large' end
      when code_hit and req_count >= 2 and w > 15 then
        case when predicted = 'small' then 'medium' end end as r5,
 case when academic_hit and w > 20 and predicted = 'small' then 'medium' end as r6"""


def rule_feature_columns(column: str = "lower(prompt)") -> str:
    return f"""{WORDS} as word_count, {any_of(column, st.PROOF_WORDS)} as proof_hit,
 {hits(column, st.DEPTH_WORDS)} as depth_count, {hits(column, st.STEP_WORDS)} as step_count,
 {any_of(column, st.CODE_WORDS)} as code_hit, {hits(column, st.REQUIREMENT_WORDS)} as req_count,
 {hits(column, st.TECHNICAL_WORDS)} as tech_count, {any_of(column, st.ACADEMIC_WORDS)} as academic_hit,
 ({" or ".join(f"starts_with({column}, {text(w)})" for w in st.SIMPLE_STARTS)}) as simple_start"""


def _ruled(source: str) -> str:
    return f"""select *, coalesce(r6, r5, r4, r3, r2, r1, predicted) as complexity,
 coalesce(r6, r5, r4, r3, r2, r1) is not null as rule_override,
 concat_ws(',', case when r1 is not null then '1' end, case when r2 is not null then '2' end,
  case when r3 is not null then '3' end, case when r4 is not null then '4' end,
  case when r5 is not null then '5' end, case when r6 is not null then '6' end) as fired_rules,
 case when coalesce(r6, r5, r4, r3, r2, r1) is not null then least(raw_confidence, 0.85::double)
  else raw_confidence end as confidence
 from (select *, {_RULE_CASES} from (select *, word_count as w from
  (select *, {rule_feature_columns()} from {source})))"""


def _predicted(source: str, label: str) -> str:
    return f"""select *, case when predicted = 'medium' then raw_confidence
  else (1 - raw_confidence) / 2 end as medium_prob
 from (select *, {label} as predicted, (n % 49) / 100::double + 0.5::double as raw_confidence from {source})"""


def _routed(source: str) -> str:
    return f"""select r.*, m.model_id as routed_model, m.name as model_name, m.size_gb,
 m.size_gb * 5e-5 as energy_kwh, m.size_gb * 5e-5 * 0.475::double as co2_kg,
 greatest(0::double, 4.7::double * 5e-5 - m.size_gb * 5e-5) as energy_saved_kwh,
 greatest(0::double, (4.7::double * 5e-5 - m.size_gb * 5e-5) / (4.7::double * 5e-5) * 100) as energy_saved_pct,
 greatest(0, least(100, round_even(100 * (1 - m.size_gb * 5e-5 / (4.7::double * 5e-5)), 0)))::int as green_score
 from {source} r join tiers t on t.complexity = r.complexity join models m on m.model_id = t.recommended[1]"""


_models = ", ".join(f"({text(i)}, {text(n)}, {s}::double, {t}::int)" for i, n, s, t in st.MODELS)
_tiers = ", ".join(f"({text(c)}, {listing(p)}, {listing(f)})" for c, p, f in st.TIERS)
_event_label = "case event_type " + " ".join(
    f"when {text(k)} then {text(v)}" for k, v in dv.EVENT_LABELS.items()
) + " end"

CTES: dict[str, str] = {
    "models": f"select * from (values {_models}) v(model_id, name, size_gb, timeout_s)",
    "tiers": f"select * from (values {_tiers}) v(complexity, recommended, fallback)",
    "workload": f"""select n * 2 as prompt_id, n, {_TEMPLATE} || repeat(' ' || text, (n % 7)::int) as prompt,
  ['wildchat', 'gsm8k'][((n // 8) % 2)::int + 1] as source_dataset
  from (select conv_id * 8 + turn as n, text from conversations where role = 'user')
 union all
 select n * 2 + 1, n, {_TEMPLATE} || ' ' || text, 'supralabs' from (select doc_id as n, text from documents)""",
    "predictions": _predicted("workload", f"{_LABELS}[((n // 96) % 3)::int + 1]"),
    "truths": f"""select *, case when n % 5 = 0 then {_LABELS}[(n % 3)::int + 1] else predicted end as true_label
 from predictions""",
    "ruled": _ruled("predictions"),
    "routed": _routed("ruled"),
    "requests": f"""select event_id as prompt_id, event_id as n, event_type, ts,
 {_TEMPLATE.replace('n %', 'event_id %')} || ' ' || event_type || ' ' || props as prompt,
 'user' || (user_id % 10) as source_dataset from events""",
    "event_predictions": _predicted("requests", _event_label),
    "event_ruled": _ruled("event_predictions"),
    "event_routed": _routed("event_ruled"),
    "responses": f"""select prompt_id, model,
 case when (n + number + attempt * 3) % 7 <> 0 then {listing(dv.REPLIES)}[((n * 5 + number * 3 + attempt * 4) % {len(dv.REPLIES)})::int + 1] end as raw_response,
 (n * 31 + number * 17 + attempt * 5) % 997 + 0.5::double as latency_ms,
 case when (n + number + attempt * 3) % 7 = 0 then case when n % 2 = 0 then 'Request timeout' else 'Connection refused' end end as error,
 attempt from (select *, unnest(case when (n + number) % 5 = 0 then [1, 2] else [1] end) as attempt from
 (select prompt_id, n, unnest({_MODEL_IDS}) as model, unnest(range(0, {len(st.MODELS) + 1})) as number from workload))""",
    "parsed": f"""select *, case when label is null or conf is null then 'NEUTRAL' else label end as out_label,
 case when label is null or conf is null then 0 else greatest(0::double, least(1::double, conf)) end as out_conf,
 label is not null and conf is not null as ok from (
 select *, case when contains(lower(reply), 'positive') then 'POSITIVE'
  when contains(lower(reply), 'negative') then 'NEGATIVE'
  when contains(lower(reply), 'neutral') then 'NEUTRAL' end as label,
  case when c1 is not null then case when c1 > 1 then c1 / 100 else c1 end
       when c2 is not null then c2 / 100
       when c3 between 0 and 100 then case when c3 > 1 then c3 / 100 else c3 end end as conf
 from (select *, {number("lower(reply)", "confidence[:" + WS[1:-1] + "]+" + NUMBER)} as c1,
  {number("reply", NUMBER + "%")} as c2,
  {number("reply", "(?:^|" + NO_WORD + ")" + NUMBER + "(?:$|" + NO_WORD + ")")} as c3
 from (select *, case when error is null then {stripped("coalesce(raw_response, '')")} end as reply from responses)))""",
    "normalised": """select prompt_id, p.model, coalesce(m.name, 'Unknown') as model_name,
 case when m.name is null or p.error is not null or not p.ok then 'ERROR' else out_label end as label,
 case when m.name is null or p.error is not null or not p.ok then 0 else out_conf end as confidence,
 case when m.name is null then 0::double else p.latency_ms end as latency_ms,
 case when m.name is null or p.error is not null or not p.ok then 0::double else m.size_gb * 5e-5 end as energy_kwh,
 case when m.name is null or p.error is not null or not p.ok then 0::double else m.size_gb * 5e-5 * 0.475::double end as co2_kg,
 case when m.name is not null then p.reply end as raw_response,
 case when m.name is null then 'Model ' || p.model || ' not found' when p.error is not null then p.error
  when not p.ok then 'Model did not provide confidence score in expected format' end as error, attempt
 from parsed p left join models m on m.model_id = p.model""",
    "settled": """select * exclude (attempt, place) from (select *, row_number() over (
 partition by prompt_id, model order by error is null desc, attempt desc) as place from normalised) where place = 1""",
    "openings": f"""select conv_id, {stripped('text')} as prompt, 'wildchat' as source_dataset from conversations c
 where role = 'user' and turn = (select min(turn) from conversations d where d.conv_id = c.conv_id)
 and length({stripped('text')}) between 10 and 2000""",
    "gold": """select d.doc_id, text as prompt, 'supralabs' as source_dataset,
 case when toxic = 1 then 'either model' when quality = 1 then 'small model' else 'big model' end as routing_choice,
 case when d.doc_id % 11 <> 0 then (d.doc_id % 9) * 0.5::double end as complexity_score, quality as label,
 quality as original_label from documents d join labels l on l.doc_id = d.doc_id""",
    "gold_labels": """select 'gold-' || doc_id as row_key, prompt, source_dataset,
 case when routing_choice = 'small model' then 'small' when routing_choice = 'big model' then
  case when complexity_score <= 2 then 'medium' else 'large' end else 'medium' end as complexity_label from gold""",
    "unlabelled": f"""select 'chat-' || conv_id as row_key, prompt, source_dataset from openings
 join documents on doc_id = conv_id where lang = 'en'
 union all select 'math-' || item_id, {stripped('text')}, 'gsm8k' from benchmark where length({stripped('text')}) > 0""",
    "corpus": f"""select * from gold_labels union all
 select row_key, prompt, source_dataset, complexity_label from {labelled('unlabelled', st.MAIN, MAIN_LABEL)}""",
    "hashed": "select *, md5('42|' || row_key) as h from corpus",
    "split": """select row_key, source_dataset, complexity_label, stratum,
 case when rn <= quota then 'val' else 'train' end as split from
 (select *, row_number() over (partition by stratum order by h, row_key) as rn from
  (select *, complexity_label || '_' || source_dataset as stratum from hashed)) join
 (select stratum, base + case when row_number() over (order by lost desc, stratum) <= wanted - sum(base) over ()
   then 1 else 0 end as quota from
  (select stratum, (c * wanted) // n as base, (c * wanted) % n as lost, wanted from
   (select stratum, count(*)::hugeint as c, (sum(count(*)) over ())::hugeint as n,
     ceil((sum(count(*)) over ())::double * 0.2::double)::hugeint as wanted
    from (select complexity_label || '_' || source_dataset as stratum from corpus) group by stratum))) using (stratum)""",
    "judged": f"""select row_key, source_dataset, complexity_label,
 case when contains(said, 'SMALL') then 'small' when contains(said, 'MEDIUM') then 'medium'
  when contains(said, 'LARGE') then 'large' end as llm_judge_label from
 (select *, upper({listing(dv.JUDGE_REPLIES)}[(ascii(md5(row_key)) % {len(dv.JUDGE_REPLIES)})::int + 1]) as said from corpus)""",
}

_NAME = re.compile(r"\b[a-z_]+\b")


def query(body: str) -> str:
    """``body`` behind the derived tables it mentions, directly or through others."""
    needed: set[str] = set()
    todo = [body]
    while todo:
        for name in set(_NAME.findall(todo.pop())) & (CTES.keys() - needed):
            needed.add(name)
            todo.append(CTES[name])
    ctes = ",\n".join(f"{n} as ({CTES[n]})" for n in CTES if n in needed)
    return f"with {ctes}\n{body}" if ctes else body
