"""The queries again in SQL, written apart from the Spark expressions."""

from __future__ import annotations

from tracemill.operators.model import BRACKET, PLAIN, PREFIXED, STRIPPING, TEMPLATES
from tracemill.plans import views

_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_RATE_OF = {"valid": "valid", "invalid": "not valid", "missing": "missing", "truncated": "truncated", "empty": "empty"}


def _parsed(source: str, o: str = "<think>", c: str = "</think>", tag: str = "think", prefixed: str = "false") -> str:
    q = lambda s: s.replace("[", r"\[").replace("]", r"\]")
    return f"""
select *, valid as has_valid_reasoning, truncated as has_truncated_reasoning, empty as has_empty_reasoning, missing as has_missing_reasoning,
  not valid as has_invalid_reasoning, trim(answer, {_WS}) <> '' as has_answer from (
  select *, closed and reasoning <> '' as valid, not closed and (opened or pre) as truncated, closed and reasoning = '' as empty,
    not closed and not opened and not pre as missing,
    case when closed or opened or pre then '{tag}' end as reasoning_tag from (
    select *, case when closed then trim(regexp_replace(regexp_extract(response, '(?is)^(.*?){q(c)}', 1), '(?i){q(o)}', ''), {_WS})
        when opened then regexp_extract(response, '(?is){q(o)}(.*)$', 1) when pre then trim(response, {_WS}) else '' end as reasoning,
      case when closed then trim(regexp_extract(response, '(?is)^.*?{q(c)}(.*)$', 1), {_WS}) when opened or pre then '' else response end as answer
    from (select *, regexp_matches(response, '(?i){q(c)}') as closed, regexp_matches(response, '(?i){q(o)}') as opened, {prefixed} as pre from ({source}) s) a) b) d"""


_FLAGS = "has_valid_reasoning, has_truncated_reasoning, has_empty_reasoning, has_missing_reasoning"
_SPLIT = f"doc_id, answer, reasoning, reasoning_tag, {_FLAGS}"
_P = _parsed(views.RESPONSES)


def _rates(wrap: str = "round({}, 9)") -> str:
    cols = [(f"{n}_reasoning_rate", f"coalesce(avg(({e})::int::double), 0)") for n, e in _RATE_OF.items()] + [("answer_rate", "coalesce(avg(has_answer::int::double), 0)")]
    return ", ".join(f"{wrap.format(e)} as {n}" for n, e in cols)


_NAMES = [*[f"{n}_reasoning_rate" for n in _RATE_OF], "answer_rate"]
_MEANS = ", ".join(f"round(avg({n}), 9) as {n}" for n in _NAMES)
_CORRECT = "avg(correct::int::double) as pass_at_1, avg(case when valid then correct::int::double end) as rpass_at_1"
_BY_TASK = "select {keys}, count(*) as n, " + _rates("{}") + ", " + _CORRECT + " from ({p}) x group by {keys}"


def _macro(p: str, group: str = "") -> str:
    keys = ", ".join(filter(None, [group, "task_id"]))
    own = f"{group}, " if group else ""
    tail = f" group by {group}" if group else ""
    return f"select {own}cast(sum(n) as bigint) as total, {_MEANS}, round(avg(pass_at_1), 9) as pass_at_1, round(avg(rpass_at_1), 9) as rpass_at_1 from ({_BY_TASK.format(keys=keys, p=p)}) t{tail}"


def _literal(s: str) -> str:
    return "(" + " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in s.split("\n")) + ")"


def _turn_text(spec, info_open: str, info_close: str, reasoning: bool) -> str:
    """The text of one turn (role, text, reasoning) under a template."""
    around = lambda i: "case role " + " ".join(f"when '{t[0]}' then {_literal(t[i])}" for t in spec.turns) + " end"
    plain = f"trim(text, {_WS})" if spec.trims else "text"
    if not reasoning:
        return f"{around(1)} || {plain} || {around(2)}"
    block = f"'{info_open}' || chr(10) || case when reasoning = '' then '' else reasoning || chr(10) end || '{info_close}' || chr(10) || text"
    return f"{around(1)} || case when reasoning is null then {plain} else {block} end || {around(2)}"


def _prompts(turns: str, spec, info_open: str = "<think>", info_close: str = "</think>", reasoning: bool = True, generate: bool = False, key: str = "conv_id") -> str:
    end = _literal(spec.generation_prompt) if generate else "''"
    return f"select {key}, {_literal(spec.bos)} || string_agg({_turn_text(spec, info_open, info_close, reasoning)}, '' order by turn) || {end} as prompt from ({turns}) t group by {key}"


def _prefixes() -> str:
    cols = []
    nl = "chr(10)"
    for spec, opened in ((PLAIN, False), (PREFIXED, True)):
        bare = f"rtrim({spec.name}, chr(10))"
        with_tag = bare if opened else f"{bare} || {nl} || '<think>'"
        shut = f"left({bare}, length({bare}) - 7)" if opened else bare
        made = {
            "think": f"{with_tag} || {nl} || 'Okay, ' || conv_id",
            "reply": f"{bare} || {nl} || '</think>' || {nl} || 'Answer:'" if opened else f"{bare} || {nl} || 'Answer:'",
            "both": f"{with_tag} || {nl} || 'Okay, ' || {nl} || '</think>' || {nl} || 'Answer:'",
            "closed": f"{shut} || {nl} || 'Answer:'",
            "forced": with_tag,
            "without": shut,
        }
        cols += [f"md5({e}) as {spec.name}_{n}" for n, e in made.items()]
    one, two = (_prompts(views.TURNS, s, reasoning=False, generate=True) for s in (PLAIN, PREFIXED))
    return f"select conv_id, {', '.join(cols)} from (select a.conv_id, a.prompt as plain, b.prompt as prefixed from ({one}) a join ({two}) b on a.conv_id = b.conv_id) p"


def _rfind(text: str, needle: str) -> str:
    return f"(case when {needle} = '' then length({text}) when instr(reverse({text}), reverse({needle})) = 0 then greatest(length({text}) - 1, 0) else length({text}) - instr(reverse({text}), reverse({needle})) - length({needle}) + 1 end)"


def _masked(turns: str, spec, flags: int, most: int = 32768, inject: bool = True, doubled: bool = False) -> str:
    """ids and labels as text, by code points."""
    fill = "t.reasoning"
    if flags and inject:
        fill = "case when max(t.reasoning) over (partition by t.conv_id) is null and t.turn = max(t.turn) over (partition by t.conv_id) then '' else t.reasoning end"
    filled = f"select t.conv_id, t.turn, t.role, t.text, {fill} as reasoning from ({turns}) t"
    texts = f"""select p.conv_id, rtrim(p.prompt, chr(10)) as body, l.text as reply, l.reasoning as thought from ({_prompts(filled, spec)}) p
      join (select conv_id, arg_max(text, turn) as text, arg_max(coalesce(reasoning, chr(1)), turn) as reasoning from ({filled}) f group by conv_id) l on p.conv_id = l.conv_id"""
    full = "body"
    if doubled:
        at = _rfind("body", "reply")
        full = f"case when thought = chr(1) then body else left(body, {at}) || '<think>' || chr(10) || trim(thought, {_WS}) || chr(10) || '</think>' || chr(10) || substring(body, {at} + 1) end"
    rules = []
    if flags & 1:
        rules.append("i < coalesce(think, answer)")
    if flags & 2:
        rules.append("(think is not null and i >= think and i < answer)")
    if flags & 4:
        rules.append("i >= answer")
    hit = " or ".join(rules) or "false"
    return f"""
with texts as (select conv_id, reply, {full} as whole from ({texts}) t),
  cut as (select conv_id, left(whole, {most}) as kept, least(length(whole), {most}) as n,
    case when instr(whole, '<think>') > 0 then least(instr(whole, '<think>') - 1, {most}) end as think, least({_rfind('whole', 'reply')}, {most}) as answer from texts),
  chars as (select conv_id, n, think, answer, i, unicode(substring(kept, cast(i + 1 as int), 1)) as id from (select *, unnest(range(cast(n as bigint))) as i from cut) u)
select conv_id, string_agg(id::varchar, ' ' order by i) as ids, string_agg((case when {hit} then -100 else id end)::varchar, ' ' order by i) as labels,
  cast(count(*) as int) as length, cast(sum(({hit})::int) as int) as masked, cast(count(*) - sum(({hit})::int) as int) as trainable
from chars group by conv_id"""


def _strategies() -> str:
    runs = {"default": 0, "bare": 0, "empty": 0, "mask": 2, "respond": 3}
    base = "select conv_id from (select distinct conv_id from conversations where role = 'assistant') c"
    cols = ", ".join(f"r_{n}.masked as {n}_masked, r_{n}.trainable as {n}_trainable" for n in runs)
    joins = " ".join(f"join ({_masked(views.TRAIN_TURNS, PLAIN, f)}) r_{n} on r_{n}.conv_id = b.conv_id" for n, f in runs.items())
    return f"select b.conv_id, {cols} from ({base}) b {joins}"


#: A letter that stands alone, with edges told by all letters and digits.
_EDGE = r"(?:^|[^\p{L}\p{N}_])"
_LETTER = f"""coalesce(
  nullif(regexp_extract(u, '(?:ANSWER|CHOICE)\\s*(?:IS|:)\\s*([A-Z])(?:$|[^\\p{{L}}\\p{{N}}_])', 1), ''), nullif(regexp_extract(u, '\\\\BOXED\\{{([A-Z])\\}}', 1), ''),
  nullif(regexp_extract(u, '{_EDGE}([A-Z])\\s*[.\\):]?\\s*$', 1), ''), nullif(regexp_extract(right(u, 200), '{_EDGE}([A-Z])[.:\\)\\]]\\s+\\S+.*$', 1), ''),
  nullif(regexp_extract(right(u, 200), '[\\(\\[]([A-Z])[\\)\\]]', 1), ''))"""
_CHOSEN = f"select *, coalesce(trim(answer) <> '' and letter = upper(trim(expected)), false) as right_letter from (select *, {_LETTER} as letter from (select *, replace(upper(answer), 'ẞ', 'SS') as u from ({views.CHOICES}) c) d) e"

_MSG = {"null": "reasoning", "empty": "coalesce(reasoning, '')"}
_MESSAGES = "select record_id, 'user' as role_0, instruction as content_0, cast(null as varchar) as reasoning_0, 'assistant' as role_1, response as content_1, {r} as reasoning_1 from ({src}) r"

_OUT = f"""
select record_id, nullif(trim(regexp_extract(tail_, '(?is)^(.*?)(</reasoning_steps>|$)', 1), {_WS}), '') as reasoning from (
  select record_id, case when regexp_matches(output, '(?i)<reasoning_steps>') then regexp_extract(output, '(?is)^.*<reasoning_steps>(.*)$', 1) end as tail_ from ({views.OUTPUTS}) o) t"""

_NESTED = f"select task_id, row_number() over (partition by task_id order by doc_id) - 1 as sample_id, response from ({views.RESPONSES}) r"
_DETECTED = " union all ".join(
    f"select '{s.name}' as name, {p} as prefixed, '{o}' as open_tag, '{c}' as close_tag, {st} as strips, {p} as prompt_opens, '{o}' as first_tag"
    for s, p, o, c, st in ((PLAIN, "false", "<think>", "</think>", "false"), (PREFIXED, "true", "<think>", "</think>", "false"), (STRIPPING, "true", "<think>", "</think>", "true"), (BRACKET, "false", "[THINK]", "[/THINK]", "false"))
)
_FIRST = f"select * from ({_P}) p join (select task_id as key, right_letter from ({_CHOSEN}) c) k on p.doc_id = k.key where p.doc_id < 100"
_INSTRUCTED = f"select record_id, 'user' as role, 0 as turn, instruction as text, cast(null as varchar) as reasoning from ({views.RECORDS}) r"
_JSON = "select '{\"total\":' || total || ',' || " + " || ',' || ".join(f"'\"{n}\":' || {n}" for n in _NAMES) + f" || '}}' as metrics from (select count(*) as total, {_rates()} from ({_P}) p) s"

ORACLE_SQL = {
    "parse_fields": f"select doc_id, answer, reasoning, reasoning_tag from ({_P}) p",
    "parse_flags": f"select doc_id, {_FLAGS}, has_invalid_reasoning, has_answer from ({_P}) p",
    "parse_prefixed": f"select {_SPLIT} from ({_parsed(views.RESPONSES, prefixed='true')}) p",
    "parse_override_false": f"select {_SPLIT} from ({_P}) p",
    "parse_prompt_detect": f"select {_SPLIT} from ({_parsed(views.PROMPTED, prefixed='doc_id % 2 = 0')}) p",
    "parse_template": f"select {_SPLIT} from ({_parsed(views.RESPONSES, prefixed='true')}) p",
    "parse_bracket": f"select {_SPLIT} from ({_parsed(views.BRACKETED, '[THINK]', '[/THINK]', 'THINK')}) p",
    "parse_custom_tag": f"select {_SPLIT} from ({_parsed(views.CUSTOM, '<reasoning>', '</reasoning>', 'reasoning')}) p",
    "parse_by_model": f"select doc_id, 'plain' as model, {_SPLIT.split(', ', 1)[1]} from ({_P}) p where doc_id % 2 = 0 union all select doc_id, 'bracket' as model, {_SPLIT.split(', ', 1)[1]} from ({_parsed(views.BRACKETED, '[THINK]', '[/THINK]', 'THINK')}) q where doc_id % 2 = 1",
    "parse_sql_functions": f"select doc_id, reasoning, answer, case when valid then 'valid' when empty then 'empty' when truncated then 'truncated' else 'missing' end as outcome from ({_P}) p",
    "parse_tokens": f"select doc_id, cast(len(list_filter(string_split_regex(reasoning, '[ \\n]'), lambda w: w <> '')) as int) as reasoning_token_count, cast(len(list_filter(string_split_regex(answer, '[ \\n]'), lambda w: w <> '')) as int) as answer_token_count from ({_P}) p",
    "parse_nested": f"select task_id, sample_id, answer, reasoning, {_FLAGS} from ({_parsed(_NESTED)}) p",
    "parse_arrays": f"select doc_id, 2 as n, answer as answer_0, reasoning as reasoning_0, '' as answer_1, 'x' as reasoning_1 from ({_P}) p",
    "stats_flat": f"select *, valid_reasoning_rate as vr, invalid_reasoning_rate as ir, missing_reasoning_rate as mr, truncated_reasoning_rate as tr, empty_reasoning_rate as er, answer_rate as ar from (select count(*) as total, {_rates()} from ({_P}) p) s",
    "stats_macro": _macro(_P),
    "stats_empty_task": f"select cast(sum(n) as bigint) as total, {_MEANS}, round(avg(pass_at_1), 9) as pass_at_1, round(avg(rpass_at_1), 9) as rpass_at_1 from (select coalesce(n, 0) as n, {', '.join(f'coalesce({n}, 0) as {n}' for n in _NAMES)}, pass_at_1, rpass_at_1 from (select distinct doc_id % 100 as task_id from documents) k left join ({_BY_TASK.format(keys='task_id', p=_P + ' where task_id >= 10')}) t on k.task_id = t.task_id) z",
    "stats_tokens": f"select count(*) as total, round(avg(length(reasoning)), 9) as avg_reasoning_tokens, round(avg(length(answer)), 9) as avg_answer_tokens from ({_P}) p",
    "stats_pass": f"select count(*) as total, round(avg(correct::int::double), 9) as pass_at_1, round(avg(case when valid then correct::int::double end), 9) as rpass_at_1 from ({_P}) p",
    "stats_by_source": _macro(_parsed(views.RESPONSES.replace("select doc_id,", "select doc_id, source,", 1)), "source"),
    "stats_join_results": f"select count(*) as total, round(avg(correct::int::double), 9) as pass_at_1, round(avg(case when valid then correct::int::double end), 9) as rpass_at_1 from ({_P}) p",
    "distill_prompts": f"""select record_id, 'I need assistance constructing a reasoning dataset.' || chr(10) || 'Given the following question and its correct answer, give a concise summary of the reasoning steps that explains how to arrive at the answer.'
  || chr(10) || chr(10) || 'Question: ' || instruction || chr(10) || chr(10) || 'Answer: ' || response || chr(10) || chr(10) || 'In your response, give the reasoning steps inside <reasoning_steps> tags.'
  || chr(10) || chr(10) || 'Start your reasoning with ''Okay, '', for example:' || chr(10) || '<reasoning_steps>' || chr(10) || 'Okay, [your reasoning steps here]' || chr(10) || '</reasoning_steps>' as prompt,
  'Explain.' || chr(10) || chr(10) || 'Question: ' || instruction || chr(10) || chr(10) || 'Answer: ' || response || chr(10) || chr(10) || 'In your response, give the reasoning steps inside <why> tags.'
  || chr(10) || chr(10) || 'Here is a complete example:' || chr(10) || '<why>x</why>' as with_example from ({views.RECORDS}) r""",
    "distill_extract": _OUT,
    "distill_update": f"select r.record_id, instruction, response, coalesce(o.reasoning, r.reasoning) as reasoning from ({views.RECORDS}) r join ({_OUT}) o on r.record_id = o.record_id",
    "distill_conversations": _MESSAGES.format(r="reasoning", src=views.RECORDS),
    "distill_conversations_empty": _MESSAGES.format(r="coalesce(reasoning, '')", src=views.RECORDS),
    "choice_extract": f"select task_id, letter, right_letter as correct from ({_CHOSEN}) c",
    "code_extract": f"select task_id, case when regexp_matches(answer, '(?s)```(?:python)?\\n.*?```') then regexp_extract(answer, '(?s)```(?:python)?\\n(.*?)```', 1) else answer end as code from ({views.CODE}) c",
    "eval_report": f"select 'm' as model, 'd' as dataset, count(*) as total, round(avg(right_letter::int::double), 9) as pass_at_1, {', '.join(f'round(avg(({e})::int::double), 9) as {n}' for n, e in (('vr', 'valid'), ('ir', 'not valid'), ('mr', 'missing'), ('tr', 'truncated'), ('er', 'empty')))} from ({_FIRST}) f",
    "chat_render": _prompts(views.TURNS, PLAIN, reasoning=False, generate=True),
    "chat_reasoning_history": _prompts(views.TURNS, PLAIN),
    "chat_bracket": _prompts(views.TURNS, BRACKET, "[THINK]", "[/THINK]"),
    "chat_prefixes": _prefixes(),
    "chat_stripping_template": _prompts(views.TURNS, STRIPPING, generate=True),
    "chat_single_turn": _prompts(_INSTRUCTED, PREFIXED, reasoning=False, generate=True, key="record_id"),
    "model_detect": _DETECTED,
    "mask_think": _masked(views.TRAIN_TURNS, PLAIN, 2),
    "mask_prompt_think": _masked(views.TRAIN_TURNS, PLAIN, 3),
    "mask_response": _masked(views.TRAIN_TURNS, PLAIN, 4),
    "mask_none": _masked(views.TRAIN_TURNS, PLAIN, 0),
    "mask_truncated": _masked(views.TRAIN_TURNS, PLAIN, 3, most=64),
    "mask_inject_empty": _masked(views.BARE_TRAIN_TURNS, PLAIN, 2),
    "mask_strategies": _strategies(),
    "mask_stripping": _masked(views.TRAIN_TURNS, STRIPPING, 2, doubled=True),
    "metrics_json": _JSON,
    "stream_rates": f"select time_bucket(interval '1 hour', ts) as window_start, count(*) as total, {_rates()} from ({_parsed(views.STREAMED)}) p group by 1",
}
_VALUES = lambda names, rows: f"select * from (values {', '.join(rows)}) v({names})"
ORACLE_SQL |= {
    "parse_prompt_not_prefixed": f"select {_SPLIT} from ({_parsed(views.PROMPTED)}) p",
    "records_jsonl": views.RECORDS,
    "sequences_sink": f"select ids, labels, length from ({_masked(views.TRAIN_TURNS, PLAIN, 2)}) m",
    "metrics_sink": f"select count(*) as total, {_rates()} from ({_P}) p",
    "sources_in_memory": _VALUES("task_id, sample_id, answer, reasoning", ["(0, 0, 'b', 'a')", "(0, 1, 'c', '')", "(2, 0, '', 'd')", "(-1, 0, 'e', '')"]),
    "dataset_names": _VALUES("name, path", ["('chemistry', 'data/chemistry_256.jsonl')", "('gsm8k', 'data/gsm8k_256.jsonl')", "('evalplus', 'data/evalplus_256.jsonl')", "('/data/own.jsonl', '/data/own.jsonl')"]),
    "profile_settings": _VALUES("profile, setting, value", ["('small', 'epochs', 1.0::double)", "('small', 'rate', 0.5::double)", "('unknown', 'epochs', 3.0::double)", "('unknown', 'rate', 0.5::double)"]),
    "option_checks": _VALUES("name, holds", ["('thought without block', true)", "('reply without prompt', true)", "('block without prompt', true)", "('reply with prompt', false)", "('no model', true)", "('template', false)", "('code not allowed', true)", "('found once', true)"]),
    "code_scores": "select distinct cast(doc_id % 40 as int) as task_id, cast(doc_id % 40 as int) % 10 = 3 as correct from documents",
}
assert set(TEMPLATES) == {"plain", "prefixed", "stripping", "bracket"}
