"""The training in passes, said again in SQL: rows of numbers, every pass as a step of one query, and scores."""

from __future__ import annotations

from promptroute.catalog import sql as q
from promptroute.operators import passes as ps
from promptroute.operators import subwords as sw
from promptroute.settings import LABELS, MAIN

CLASSES = range(ps.CLASSES)


def stratified(source: str, key: str) -> str:
    """``source`` with its exact stratified split."""
    return f"""(select * exclude (rn, quota), case when rn <= quota then 'val' else 'train' end as split from
 (select *, row_number() over (partition by stratum order by md5('42|' || {key}), {key}) as rn from
  (select *, complexity_label || '_' || source_dataset as stratum from {source})) join
 (select stratum, base + case when row_number() over (order by lost desc, stratum) <= wanted - sum(base) over ()
   then 1 else 0 end as quota from
  (select stratum, (c * wanted) // n as base, (c * wanted) % n as lost, wanted from
   (select stratum, count(*)::hugeint as c, (sum(count(*)) over ())::hugeint as n,
     ceil((sum(count(*)) over ())::double * 0.2::double)::hugeint as wanted
    from (select complexity_label || '_' || source_dataset as stratum from {source}) group by stratum))) using (stratum))"""


LABELLED = q.labelled("workload", MAIN, q.MAIN_LABEL)


def _each(form: str, between: str = ", ") -> str:
    return between.join(form.format(c=c) for c in CLASSES)


def pieces(path: str) -> list[str]:
    """The longest pieces of a vocabulary in the words of every prompt, as ``cut_prompts`` (prompt_id, words)."""
    last = f"case when spot + n > length(line) then {q.text(sw.END)} else '' end"
    return [
        f"vocabulary as materialized (select unnest(json_keys(content::json, '$.model.vocab')) as piece from read_text({q.text(path)}))",
        f"""spread as materialized (select prompt_id, generate_subscripts(words, 1) as place, unnest(words) as word from (select prompt_id,
 list_filter(regexp_split_to_array(lower(prompt), '{ps.GAPS}'), lambda w: w <> '')[1:{ps.MAX_TOKENS}] as words from workload))""",
        f"""spelt as materialized (select word, array_to_string(list_transform(range(octet_length(encode(word))),
 lambda i: {q.listing(sw.letters())}[('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::int + 1]), '') as line from (select distinct word from spread))""",
        f"""cut as (select word, line, 1 as spot, []::varchar[] as found from spelt union all
 select word, any_value(line), any_value(spot) + max(n), list_append(any_value(found), max_by(piece, n)) from
 (select word, line, spot, found, n, piece from (select *, unnest(range(1, 1 + least(40, length(line) - spot + 1))) as n from cut where spot <= length(line))
  join vocabulary on piece = substr(line, spot, n) || {last}) group by word)""",
        f"""cut_prompts as materialized (select prompt_id, coalesce(list_slice(flatten(list(found order by place)), 1, {ps.MAX_TOKENS}), []) as words from workload
 left join spread using (prompt_id) left join (select word, found from cut where spot > length(line)) using (word) group by prompt_id)""",
    ]


def _numbers() -> list[str]:
    """Prompts with label and split, and their numbers as (prompt_id, place, x)."""
    band = " + ".join(f"(token_count >= {edge})::int" for edge in ps.BANDS)
    flags = ["question_count >= 3" if f == "asks_often" else f for f in ps.FLAGS]
    held = ", ".join(f"case when {f} then {ps.FIRST_FLAG + i} end" for i, f in enumerate(flags))
    banded = ", ".join(f"case when {f} then {ps.FIRST_BANDED + i} + band * {len(flags)} end" for i, f in enumerate(flags))
    return [
        f"""prompts as materialized (select *, list_position({q.listing(LABELS)}, complexity_label) - 1 as label,
 split = 'train' as train, {band} as band, list_filter(regexp_split_to_array(lower(prompt), '{ps.GAPS}'), lambda w: w <> '')[1:{ps.MAX_TOKENS}] as words
 from {stratified(LABELLED, 'prompt_id')})""",
        f"""numbers as materialized (select prompt_id, label, train, place, sum(x) as x from (
 select prompt_id, label, train, ('0x' || substr(md5(unnest(words)), 1, 8))::bigint % {ps.BUCKETS} as place, 1 / sqrt(len(words)) as x from prompts
 union all select prompt_id, label, train, place, 1 from (select prompt_id, label, train,
  unnest([{ps.CONSTANT}, {ps.FIRST_BAND} + band, {held}, {banded}]) as place from prompts) where place is not null) group by all)""",
    ]


def _step(number: int, total: int) -> list[str]:
    """Scores under the weights so far, the mean gradient, and the weights after it."""
    rate = ps.RATE * (1 - (number - 1) / total)
    one, two = 1 - ps.BETA_1**number, 1 - ps.BETA_2**number
    bound = f"case when place < {ps.BUCKETS} then {ps.LEAST!r}::double else 0 end"
    before = number - 1
    kept = _each(
        f"case when w{{c}} = 0 then sign(g{{c}}) * greatest(abs(g{{c}}) - {bound}, 0) else g{{c}} + {bound} * sign(w{{c}}) end as g{{c}}"
    )
    moved = _each(
        f"w{{c}} * (1 - {rate!r}::double * {ps.DECAY!r}::double) - {rate!r}::double * (m{{c}} / {one!r}::double / (sqrt(s{{c}} / {two!r}::double) + {ps.EPSILON!r}::double)) as w{{c}}"
    )
    mean = _each(f"{ps.BETA_1!r}::double * m{{c}} + {1 - ps.BETA_1!r}::double * g{{c}} as m{{c}}")
    square = _each(f"{ps.BETA_2!r}::double * s{{c}} + {1 - ps.BETA_2!r}::double * g{{c}} * g{{c}} as s{{c}}")
    return [
        f"""g{number} as materialized (select place, {_each('sum(x * (p{c} - (label = {c})::int)) / (select count(*) from prompts where train) as g{c}')}
 from numbers join p{before} using (prompt_id) where train group by place)""",
        f"""w{number} as materialized (select place, {_each('m{c}')}, {_each('s{c}')}, {moved} from
 (select place, {_each('w{c}')}, {mean}, {square} from
  (select place, {_each('w{c}')}, {_each('m{c}')}, {_each('s{c}')}, {kept} from w{before} join g{number} using (place))))""",
        _shares(number),
    ]


def _shares(number: int) -> str:
    return f"""p{number} as materialized (select prompt_id, {_each('e{c} / (e0 + e1 + e2) as p{c}')} from
 (select prompt_id, {_each('exp(z{c} - greatest(z0, z1, z2)) as e{c}')} from
  (select prompt_id, {_each('coalesce(sum(x * w{c}), 0) as z{c}')} from numbers left join w{number} using (place) group by prompt_id)))"""


_CLASS = "case when p0 >= p1 and p0 >= p2 then 0 when p1 >= p2 then 1 else 2 end"


def _figures(number: int) -> str:
    loss = "-avg(ln(case label when 0 then p0 when 1 then p1 else p2 end)) filter ({0})"
    f1 = _each(
        "(2 * count(*) filter (not train and label = {c} and said = {c}) / greatest(1, "
        "count(*) filter (not train and label = {c}) + count(*) filter (not train and said = {c})))", ", "
    )
    known = _each("count(*) filter (not train and label = {c})")
    return f"""select {number} as pass, train_loss, val_loss, accuracy, list_sum(f1) / 3 as f1_macro,
 (f1[1] * known[1] + f1[2] * known[2] + f1[3] * known[3]) / list_sum(known) as f1_weighted from
 (select {loss.format('train')} as train_loss, {loss.format('not train')} as val_loss,
  avg((label = said)::int) filter (not train) as accuracy, [{f1}] as f1, [{known}] as known
  from (select *, {_CLASS} as said from p{number} join prompts using (prompt_id)))"""


def trained(body: str, passes: int = ps.PASSES, vocabulary: str | None = None) -> str:
    """``body`` over ``prompts``, ``p1`` ... (shares after every pass), ``passes`` and ``scored`` (shares of the best)."""
    prompts, numbers = _numbers()
    before = []
    if vocabulary is not None:
        before = pieces(vocabulary)
        prompts = prompts.replace("prompts as materialized (", "worded as materialized (")
        prompts = [prompts, "prompts as materialized (select worded.* exclude (words), cut_prompts.words from worded join cut_prompts using (prompt_id))"]
    else:
        prompts = [prompts]
    zero = f"w0 as materialized (select distinct place, {_each('0::double as m{c}, 0::double as s{c}, 0::double as w{c}')} from numbers where train)"
    steps = [s for n in range(1, passes + 1) for s in _step(n, passes)]
    figures = " union all ".join(map(_figures, range(1, passes + 1)))
    every = " union all ".join(f"select {n} as pass, * from p{n}" for n in range(1, passes + 1))
    parts = [
        *before, *prompts, numbers, zero, _shares(0), *steps,
        f"passes as materialized (select *, row_number() over (order by f1_macro desc, pass) = 1 as best from ({figures}))",
        f"""scored as materialized (select prompts.*, said, {_each('p{c}')}, {q.listing(LABELS)}[said + 1] as predicted, greatest(p0, p1, p2) as confidence
 from (select *, {_CLASS} as said from ({every}) where pass = (select pass from passes where best)) join prompts using (prompt_id))""",
    ]
    return f"select * from (with recursive {', '.join(parts)} {body})"


def cut_into_pieces(vocabulary: str) -> str:
    """Number and digest of the pieces of every prompt."""
    return f"""select * from (with recursive {', '.join(pieces(vocabulary))}
 select prompt_id, len(words)::int as n_pieces, md5(array_to_string(words, ' ')) as pieces_md5 from cut_prompts)"""
