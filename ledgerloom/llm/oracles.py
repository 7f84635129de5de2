"""Reference SQL of the registered queries, where SQL can express them."""

from __future__ import annotations


_OP4 = """
with calls as (
  select conv_id, turn, min(text) as text, conv_id || ':' || turn as call_id
  from conversations where role = 'user' and conv_id is not null and turn is not null group by conv_id, turn),
placed as (select *, row_number() over (partition by conv_id order by turn) - 1 as position from calls),
results as (
  select conv_id, turn, min(text) as content, conv_id || ':' || (turn - 1) as call_id
  from conversations where role = 'assistant' and conv_id is not null and turn is not null group by conv_id, turn),
rows as (
  select coalesce(c.conv_id, r.conv_id) as conv_id, c.position, cast(coalesce(c.turn, r.turn) as bigint) as turn,
    coalesce(c.call_id, r.call_id) as call_id, c.call_id is not null as is_call, c.text, r.content,
    case when c.call_id is null then 'orphan' when r.call_id is null then 'unanswered' else 'linked' end as status,
    case when c.call_id is null then []
      else list_concat(
        case when c.text is null then ['/message:type'] when c.text = '' then ['/message:minLength'] else [] end,
        case when c.turn < 0 then ['/turn:minimum'] else [] end) end as errors
  from placed c full join results r on c.conv_id = r.conv_id and c.call_id = r.call_id)
select conv_id, position, turn, call_id, status, cast(len(errors) as bigint) as n_errors,
  '{"arguments":' || case when is_call then '{"message":' || coalesce(to_json(text)::varchar, 'null') || ',"turn":' || turn || '}' else 'null' end
  || ',"call_id":"' || call_id || '","errors":' || to_json(errors)::varchar
  || ',"name":' || case when is_call then '"reply"' else 'null' end
  || ',"position":' || coalesce(position::varchar, 'null')
  || ',"result":' || coalesce(to_json(content)::varchar, 'null')
  || ',"status":"' || status || '"}' as json
from rows
"""


def sql() -> dict[str, str]:
    return {"op4_tool_calls": _OP4}
