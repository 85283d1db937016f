"""Derived inputs: one SELECT text each, which Spark and DuckDB run alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: The two halves of a text.
FIRST = "substring(text, 1, cast(floor(length(text) / 2) as int))"
REST = "substring(text, cast(floor(length(text) / 2) as int) + 1)"

RESPONSES = f"""
select doc_id, doc_id % 100 as task_id, doc_id % 3 = 0 as correct, case cast(doc_id % 7 as int)
  when 0 then concat('<think>', chr(10), {FIRST}, chr(10), '</think>', chr(10), {REST})
  when 1 then concat('<THINK>', chr(10), '  ', chr(10), '</THINK>', chr(10), {REST})
  when 2 then concat('<think>', chr(10), {FIRST})
  when 3 then {FIRST}
  when 4 then concat({FIRST}, '</think>', chr(10), {REST})
  when 5 then concat('<think>', {FIRST}, '</think>', {REST}, '</think>', 'tail')
  else concat('</think>', chr(10)) end as response
from documents"""

BRACKETED = RESPONSES.replace("<think>", "[THINK]").replace("</think>", "[/THINK]").replace("<THINK>", "[think]").replace("</THINK>", "[/think]")
CUSTOM = RESPONSES.replace("think>", "reasoning>").replace("THINK>", "REASONING>")

MIXED = f"""
select doc_id, response, 'plain' as model from ({RESPONSES}) a where doc_id % 2 = 0
union all select doc_id, response, 'bracket' as model from ({BRACKETED}) b where doc_id % 2 = 1"""

PROMPTED = f"""
select doc_id, response, case when doc_id % 2 = 0 then concat('Question', chr(10), '<think>', chr(10)) else concat('Question', chr(10)) end as prompt
from ({RESPONSES}) r"""

RECORDS = f"""
select u.conv_id * 1000 + u.turn as record_id, u.text as instruction, a.text as response,
  case cast((u.conv_id + u.turn) % 3 as int) when 0 then null when 1 then '' else {FIRST.replace('text', 'a.text')} end as reasoning
from conversations u join conversations a on u.conv_id = a.conv_id and a.turn = u.turn + 1
where u.role = 'user' and a.role = 'assistant'"""

OUTPUTS = f"""
select record_id, case cast(record_id % 5 as int)
  when 0 then concat('Sure. <reasoning_steps>', chr(10), instruction, chr(10), '</reasoning_steps> done')
  when 1 then concat('<REASONING_STEPS>', instruction)
  when 2 then concat('<reasoning_steps>', chr(10), '</reasoning_steps>')
  when 3 then instruction
  else concat('<reasoning_steps>first</reasoning_steps> again <reasoning_steps> ', instruction, ' ') end as output
from ({RECORDS}) r"""

CHOICES = """
select doc_id as task_id, substring('abcde', cast(doc_id % 5 as int) + 1, 1) as expected, case cast(doc_id % 7 as int)
  when 0 then concat(text, ' So the answer is ', substring('ABCDE', cast(doc_id % 4 as int) + 1, 1), ' for sure.')
  when 1 then concat(text, ' We get ', chr(92), 'boxed{', substring('ABCDE', cast(doc_id % 5 as int) + 1, 1), '} here, as said')
  when 2 then concat(text, ' It has to be ', substring('ABCDE', cast(doc_id % 5 as int) + 1, 1), '.')
  when 3 then concat(text, ' option ', substring('ABCDE', cast(doc_id % 3 as int) + 1, 1), '. some words here!')
  when 4 then concat(text, ' It was option (', substring('ABCDE', cast(doc_id % 5 as int) + 1, 1), ') that held, ok')
  when 5 then ''
  else concat(text, ' none of these, sorry') end as answer
from documents"""

CODE = """
select doc_id as task_id, case cast(doc_id % 4 as int)
  when 0 then concat(text, 'Here:', chr(10), '```python', chr(10), 'x = ', cast(doc_id as varchar(20)), chr(10), '```', chr(10), 'done')
  when 1 then concat(text, '```', chr(10), 'y = ', cast(doc_id as varchar(20)), chr(10), '```')
  when 2 then concat(text, 'z = ', cast(doc_id as varchar(20)))
  else concat(text, '```python', chr(10), 'a', chr(10), '``` and ```', chr(10), 'b', chr(10), '```') end as answer
from documents"""

TURNS = f"""
select conv_id, turn, role, text, case when role = 'assistant' then
  case cast(turn % 3 as int) when 0 then null when 1 then '' else {FIRST} end end as reasoning
from conversations"""

#: Up to the last assistant turn of each conversation that has one.
TRAIN_TURNS = f"""
select t.* from ({TURNS}) t join (select conv_id as c, max(turn) as last from conversations where role = 'assistant' group by conv_id) l
on t.conv_id = l.c and t.turn <= l.last"""

BARE_TRAIN_TURNS = TRAIN_TURNS.replace("select t.* from", "select t.conv_id, t.turn, t.role, t.text, cast(null as varchar(10)) as reasoning from", 1)

#: Programs that a model wrote, and their tests: one in ten is right.
PROGRAMS = """
select distinct cast(doc_id % 40 as int) as task_id, concat('Here:', chr(10), '```python', chr(10), 'def f():', chr(10), '    return ', cast(cast(doc_id % 40 as int) % 10 as varchar(9)), chr(10), '```') as answer,
  concat('def check(g):', chr(10), '    assert g() == 3') as test_code, 'f' as entry_point from documents"""

STREAMED = """
select event_id, ts, case cast(event_id % 4 as int) when 0 then concat('<think>', event_type, '</think>', props) when 1 then concat('<think>', event_type)
  when 2 then '<think> </think>' else event_type end as response
from events"""


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A derived input over the tables of a folder, whose names stay local to it."""
    names = sorted({n for n in re.findall(r"(?:from|join) (\w+)", sql) if n in TABLES})
    text = re.sub(r"\b(from|join) (\w+)", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in TABLES else m[0], sql.replace("{", "{{").replace("}", "}}"))
    return spark.sql(text, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})


TABLES = frozenset("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split())
