"""Reference SQL for the registered queries, written from the definitions alone."""

from __future__ import annotations

from ledgerloom.catalogue.views import PRIORITIES, ROWS_PER_FILE, SEGMENTS
from ledgerloom.functions.text import GENERIC_WORDS
from ledgerloom.functions.values import INFLOW_WORDS, OUTFLOW_WORDS
from ledgerloom.operators.mapping import SYNONYMS


def norm(x: str) -> str:
    return f"upper(trim(regexp_replace(strip_accents({x}), '[^A-Za-z0-9]+', ' ', 'g')))"


def words(items: list[str]) -> str:
    return "[" + ", ".join(f"'{i}'" for i in items) + "]"


def pick(selector: str, options: list[str]) -> str:
    return f"case {selector} " + " ".join(f"when {i} then {o}" for i, o in enumerate(options)) + " end"


def generic(x: str) -> str:
    return f"({x} <> '' and len(list_filter(string_split({x}, ' '), lambda w: not list_contains({words(GENERIC_WORDS)}, w))) = 0)"


def ymd(x: str) -> str:
    return rf"""case when regexp_full_match({x}, '\d{{4}}([-/])\d{{1,2}}[-/]\d{{1,2}}') then coalesce(
        try_cast(try_strptime({x}, '%Y-%m-%d') as date), try_cast(try_strptime({x}, '%Y/%m/%d') as date)) end"""


def year_last(x: str, order: str) -> str:
    return rf"""case when regexp_full_match({x}, '\d{{1,2}}[-/]\d{{1,2}}[-/]\d{{4}}') then coalesce(
        try_cast(try_strptime({x}, '{order.replace("-", "/")}') as date), try_cast(try_strptime({x}, '{order}') as date)) end"""


def dmy(x: str) -> str:
    return year_last(x, "%d-%m-%Y")


def mdy(x: str) -> str:
    return year_last(x, "%m-%d-%Y")


def undeclared(x: str) -> str:
    first = f"try_cast(regexp_extract({x}, '^(\\d+)[-/]', 1) as int)"
    second = f"try_cast(regexp_extract({x}, '^\\d+[-/](\\d+)', 1) as int)"
    return f"""case when {ymd(x)} is not null then {ymd(x)}
        when {first} > 12 and {second} <= 12 then {dmy(x)}
        when {second} > 12 and {first} <= 12 then {mdy(x)} end"""


def minus(x: str) -> str:
    return f"replace(replace(trim({x}), '−', '-'), '–', '-')"


def money(x: str) -> str:
    """Digits kept, decimal mark decided, then whole and cents put together."""
    kept = f"regexp_replace({x}, '[^0-9,.]', '', 'g')"
    last_comma = f"strpos(reverse({kept}), ',')"
    last_dot = f"strpos(reverse({kept}), '.')"
    number = f"""case when {last_comma} > 0 and {last_dot} > 0 and {last_comma} < {last_dot}
            then replace(replace({kept}, '.', ''), ',', '.')
        when {last_comma} > 0 and {last_dot} > 0 then replace({kept}, ',', '')
        when {last_comma} in (2, 3) then replace({kept}, ',', '.')
        when {last_comma} > 0 then replace({kept}, ',', '')
        when {last_dot} in (0, 2, 3) then {kept}
        else replace({kept}, '.', '') end"""
    value = f"""case when regexp_full_match({number}, '\\d+\\.?\\d*|\\.\\d+')
        and cast({number} as decimal(30, 6)) * 100 = floor(cast({number} as decimal(30, 6)) * 100)
        then cast(cast({number} as decimal(30, 6)) * 100 as bigint) end"""
    raw = minus(x)
    return f"(case when starts_with({raw}, '-') or ({raw} like '(%' and {raw} like '%)') then -1 else 1 end * ({value}))"


def direction(x: str) -> str:
    raw = minus(x)
    return f"case when starts_with({raw}, '-') or ({raw} like '(%' and {raw} like '%)') then 'outflow' when starts_with({raw}, '+') then 'inflow' end"


def word_direction(x: str) -> str:
    hits = [f"list_has_any(string_split({norm(x)}, ' '), {words(w)})" for w in (INFLOW_WORDS, OUTFLOW_WORDS)]
    return f"case when {hits[0]} and not {hits[1]} then 'inflow' when {hits[1]} and not {hits[0]} then 'outflow' end"


def signed(minor: str, way: str) -> tuple[str, str]:
    value = f"""case when {minor} = 0 then null when {way} = 'outflow' then -abs({minor})
        when {way} = 'inflow' and {minor} > 0 then {minor} when {way} is null and {minor} < 0 then {minor} end"""
    code = f"""case when {minor} = 0 then 'zero_amount'
        when {way} = 'inflow' and {minor} < 0 then 'conflicting_amount_direction'
        when {way} is null and {minor} > 0 then 'ambiguous_amount_direction' end"""
    return value, code


def payment(x: str, column: int) -> str:
    hints = [
        ("{n} like '%CARTAO%'", "credit_card", "credit_card"),
        ("{n} like '%PIX%'", "pix", "bank_account"),
        ("{n} like '%BOLETO%'", "boleto", "bank_account"),
        ("{n} like '%SAQUE%' or {n} like '%DINHEIRO%'", "cash", "cash"),
        ("{n} like '%SALDO PICPAY%'", "digital_wallet", "wallet"),
        ("{n} like '%TRANSFERENCIA%'", "bank_transfer", "bank_account"),
    ]
    return "case " + " ".join(f"when {h[0].format(n=x)} then '{h[column]}'" for h in hints) + " end"


def grouped(mark: str) -> str:
    return f"case when cents // 100 >= 1000 then cast((cents // 100) // 1000 as varchar) || '{mark}' || lpad(cast((cents // 100) % 1000 as varchar), 3, '0') else cast(cents // 100 as varchar) end"


FRAC = "lpad(cast(cents % 100 as varchar), 2, '0')"

ORDERS = """base as (select o.*, c.c_name, c.c_mktsegment, cast(round(o_totalprice * 100) as bigint) as cents
    from orders o join customer c on o_custkey = c_custkey)"""

RAW = f"""{ORDERS}, raw_rows as (select o_custkey % 64 as file_no, o_orderkey as seq,
    'Bank ' || (o_custkey % 3) as institution, cents,
    {pick("o_orderkey % 4", ["strftime(o_orderdate, '%Y-%m-%d')", "strftime(o_orderdate, '%d/%m/%Y')", "strftime(o_orderdate, '%m/%d/%Y')", "''"])} as date_text,
    {pick("o_orderkey % 7", [f"'+R$ ' || {grouped('.')} || ',' || {FRAC}", f"'−R$ ' || {grouped('.')} || ',' || {FRAC}", f"'$' || {grouped(',')} || '.' || {FRAC}", f"'(' || (cents // 100) || '.' || {FRAC} || ')'", "'R$ XX'", "cast(cents // 100 as varchar)", "''"])} as amount_text,
    {pick("o_orderkey % 6", ["c_name", "'Cartão Visa'", "'PIX'", "c_name || ' é'", "''", "'SALDO ANTERIOR'"])} as description,
    {pick("o_orderkey % 5", ["'0'", "'000'", "''", "cast(o_orderkey // 10 as varchar)", "cast(o_orderkey as varchar)"])} as external_id,
    (o_orderkey % 25) || ':' || (o_orderkey % 61) || ':' || (o_orderkey % 60) as time_text,
    o_orderpriority || ' ' || {pick("o_orderkey % 4", ["'Crédito'", "'Pagamento'", "'Transferência'", "'compra estorno'"])} as words
    from base)"""

_VALUE, _CODE = signed("minor", "direction")

VALID = f"""{RAW}, parsed as (select *, {undeclared("date_text")} as d, {money("amount_text")} as minor,
    {direction("amount_text")} as direction, {norm("description")} as normalized from raw_rows),
  valid as (select *, {_VALUE} as amount_signed,
    list_filter([
      case when d is null and date_text <> '' then 'invalid_transaction_date' end,
      case when minor is null and amount_text <> '' then 'invalid_amount' end,
      case when d is null and date_text = '' then 'missing_transaction_date' end,
      case when minor is null then case when amount_text = '' then 'missing_amount' end else {_CODE} end,
      case when normalized = '' then 'missing_description' when {generic("normalized")} then 'generic_description_only' end
    ], lambda c: c is not null) as codes from parsed),
  judged as (select *, case when len(codes) > 0 then 'pending' else 'transaction' end as outcome from valid)"""

EVENT_TX = f"""tx as (select cast(event_id as varchar) as id, 'bank ' || (user_id % 3) as bank,
    {pick("event_id % 5", ["'0'", "'000'", "''", "cast(event_id // 40 as varchar)", "cast(event_id as varchar)"])} as external_id,
    cast(cast(ts as date) as varchar) as day, cast(cast(floor(value) as bigint) + 1 as varchar) as amount,
    upper(event_type) as words, user_id % 8 as import_seq, event_id from events),
  keyed as (select *, case when external_id not in ('0', '000', '') then
      sha256(concat_ws(chr(31), bank, '', external_id, day, amount, 'BRL')) end as strong_dedup_key,
    sha256(concat_ws(chr(31), bank, day, amount, 'BRL', words)) as semantic_fingerprint from tx)"""

WALLET = words(["data", "hora", "tipo", "origem destino", "valor", "forma de pagamento"])
BANK = words(["data", "historico", "docto", "credito", "debito", "saldo"])

PROFILES = f"""p0 as (select *, case when p_partkey % 2 = 0 then {WALLET} else {BANK} end as base from part),
  p1 as (select *, list_transform(case when p_partkey % 7 < 6
      then list_concat(base[1:cast(p_partkey % 7 as int)], base[cast(p_partkey % 7 as int) + 2:6]) else base end,
      lambda c: case when p_size % 5 = 0 and c = 'data' then 'data movimento'
        when p_size % 5 = 1 and c = 'valor' then 'montante total'
        when p_size % 5 = 1 and c = 'historico' then 'memo' else c end) as renamed from p0),
  p2 as (select *, case when p_size % 2 = 0 then list_append(renamed, lower(p_name)) else renamed end as extended from p1),
  profiles as (select *, case when p_size % 3 = 0 then list_reverse(extended) else extended end as columns,
      {pick("p_size % 4", ["','", "';'", "chr(9)", "'|'"])} as delimiter, p_size % 6 = 0 as irregular from p2)"""


def suggestion() -> str:
    """CTEs that assign columns field by field; ends in ``suggested``."""
    rows = ", ".join(
        f"({i}, '{field}', '{name}')" for i, (field, names) in enumerate(SYNONYMS.items()) for name in names
    )
    parts = [
        f"synonyms(place, field, synonym) as (values {rows})",
        "cells as (select distinct p_partkey, unnest(columns) as name from profiles)",
        """scores as (select p_partkey, name, field, max(case when name = synonym then 1.0::double else greatest(
            len(list_intersect(string_split(name, ' '), string_split(synonym, ' ')))::double
              / len(list_distinct(list_concat(string_split(name, ' '), string_split(synonym, ' ')))),
            case when contains(name, synonym) or contains(synonym, name) then 0.8::double else 0.0::double end) end) as score
          from cells, synonyms group by all)""",
        "used0 as (select p_partkey, []::varchar[] as used from profiles)",
    ]
    for i, field in enumerate(SYNONYMS):
        parts.append(
            f"""pick{i} as (select p_partkey, max(struct_pack(score := score, name := name)) as best
              from scores join used{i} using (p_partkey)
              where field = '{field}' and score >= 0.6 and not list_contains(used, name) group by p_partkey)"""
        )
        parts.append(
            f"""used{i + 1} as (select u.p_partkey, case when best is null then used else list_append(used, best.name) end as used,
              from used{i} u left join pick{i} using (p_partkey))"""
        )
    picks = ", ".join(f"pick{i}.best as b{i}" for i in range(len(SYNONYMS)))
    joins = " ".join(f"left join pick{i} using (p_partkey)" for i in range(len(SYNONYMS)))
    parts.append(f"picked as (select profiles.*, {picks} from profiles {joins})")
    place = {f: i for i, f in enumerate(SYNONYMS)}
    fields = ", ".join(f"b{i}.name as {f}" for f, i in place.items())
    amount = "greatest(" + ", ".join(f"coalesce(b{place[f]}.score, 0.0)" for f in ("amount", "credit", "debit")) + ")"
    parts.append(
        f"""suggested as (select *, {fields},
          round((coalesce(b{place['transaction_date']}.score, 0.0) + coalesce(b{place['description']}.score, 0.0) + {amount}) / 3, 4) as mapping_confidence,
          list_filter([case when b{place['transaction_date']} is null then 'transaction_date' end,
            case when b{place['description']} is null then 'description' end,
            case when {amount} = 0 then 'amount' end], lambda m: m is not null) as missing from picked)"""
    )
    return ",\n".join(parts)


SPECS = f"""specs as (
  select 'picpay_csv_v1' as format_id, ',' as delim, {WALLET} as expected, 0 as spec_order, false as learned
  union all select 'bradesco_csv_v1', ';', {BANK}, 1, false
  union all select 'learned_csv_' || lower(n_name), {pick("n_nationkey % 4", ["','", "';'", "chr(9)", "'|'"])},
    ['data', 'memo', 'valor', {pick("n_nationkey % 5", ["'docto'", "'tipo'", "'hora'", "'saldo'", "'credito'"])},
      {pick("n_nationkey % 5", ["'debito'", "'saldo'", "'forma de pagamento'", "'credito'", "'historico'"])}],
    n_nationkey + 2, true from nation)"""


def detection(specs: str) -> str:
    return f"""{PROFILES}, {suggestion()}, {specs},
  ranked as (select p_partkey, format_id, learned, round(
      (len(list_intersect(expected, columns))::double / len(expected)) * 0.85::double
        + case when delim = delimiter then 1.0::double else 0.0::double end * 0.15::double, 4) as score,
      row_number() over (partition by p_partkey order by score desc, spec_order) as place
    from profiles, specs),
  tops as (select p_partkey, string_agg(format_id || ':' || cast(round(score * 10000) as bigint), ',' order by place) filter (place <= 3) as candidates,
      max(score) filter (place = 1) as s1, max(score) filter (place = 2) as s2,
      max(format_id) filter (place = 1) as f1, bool_or(learned) filter (place = 1) as l1 from ranked group by p_partkey),
  detected as (select s.*, candidates, f1,
      case when s1 >= 0.72::double and s2 >= 0.72::double and abs(s1 - s2) <= 0.03::double then 'ambiguous'
        when s1 >= 0.72::double and l1 then 'learned' when s1 >= 0.72::double then 'known'
        when len(missing) = 0 then 'generic' else 'unknown' end as detection_status
    from suggested s join tops using (p_partkey))"""


def drift(spec_wallet: str) -> str:
    """Changes against the wallet layout where the condition holds, else the bank one."""
    return f"""spec_of as (select *, case when {spec_wallet} then {WALLET} else {BANK} end as expected,
      case when {spec_wallet} then ['data', 'origem destino', 'valor'] else ['data', 'historico'] end as required,
      case when {spec_wallet} then ',' else ';' end as spec_delimiter, not ({spec_wallet}) as grouped from {{source}}),
  gone as (select *, list_sort(list_filter(expected, lambda c: not list_contains(columns, c))) as missing_columns,
      list_sort(list_distinct(list_filter(columns, lambda c: not list_contains(expected, c)))) as unexpected,
      grouped and not list_has_any(columns, ['credito', 'debito']) as group_gone from spec_of),
  drifted as (select *, len(missing_columns) > 0 and (list_has_any(missing_columns, required) or group_gone) as breaking,
      list_filter([
        case when len(missing_columns) > 0 then 'missing_column:' || case when list_has_any(missing_columns, required) or group_gone then 'blocking' else 'warning' end || ':' || array_to_string(missing_columns, '+') end,
        case when len(unexpected) > 0 then 'unexpected_column:warning:' || array_to_string(unexpected, '+') end,
        case when delimiter <> spec_delimiter then 'delimiter_changed:warning:' end,
        case when list_filter(columns, lambda c: list_contains(expected, c)) <> list_filter(expected, lambda c: list_contains(columns, c)) then 'column_order_changed:warning:' end,
        case when irregular then 'irregular_row_width:warning:' end], lambda c: c is not null) as changes from gone)"""


# The derived files: what each order must look like once its file has been read.
AMOUNT = f"({grouped('.')} || ',' || {FRAC})"
FILES = f"""{ORDERS}, f0 as (select *, o_orderkey // {ROWS_PER_FILE} as file_no, c_name || ' José' as name,
      strftime(o_orderdate, '%Y-%m-%d') as iso, strftime(o_orderdate, '%d/%m/%Y') as dmy, {AMOUNT} as amount from base),
  rows0 as (select *, file_no % 5 as layout, 'file-' || lpad(cast(file_no as varchar), 12, '0') || '.csv' as path,
      case when file_no % 2 = 1 and file_no % 5 <> 4 then 'cp1252' else 'utf-8-sig' end as encoding,
      case when o_orderkey % 10 = 7 then name || chr(10) || '"linha", 2' else name || ', loja' end as quoted_name,
      case when file_no % 5 = 0 and o_orderkey % 10 = 7 then 2 else 1 end as line_count from f0),
  rows1 as (select *, case when layout = 1 then 3 else 1 end + sum(line_count) over (partition by file_no order by o_orderkey) as row_number,
      case layout
        when 0 then [iso, '08:' || lpad(cast(o_orderkey % 60 as varchar), 2, '0'), 'Pagamento', quoted_name, case when o_orderkey % 3 = 0 then '+R$ ' else '-R$ ' end || amount, 'Pix']
        when 1 then case when o_orderkey % 10 = 0 then [dmy, 'SALDO ANTERIOR', '0', '', '', amount]
          else list_concat(list_concat([dmy], case when o_orderkey % 10 = 3 then ['COMPRA', name] else [name] end),
            [cast(o_orderkey as varchar), case when o_orderkey % 2 = 0 then amount else '' end, case when o_orderkey % 2 = 1 then amount else '' end, '1.000,00']) end
        when 2 then [dmy, name, amount, case when o_orderkey % 2 = 0 then 'Pagamento' else 'Entrada' end]
        when 3 then [iso, name, (cents // 100) || '.' || {FRAC}, 'Payment']
        else [iso, '10:00', 'Pix', amount, 'Pix'] end as cells from rows0)"""

RULES = f"""rules0 as (select *, p_partkey % 6 as kind, p_size * 10 as priority,
      'rule-' || lpad(cast(p_partkey as varchar), 12, '0') as id,
      {pick("p_partkey % 4", ["'despesa'", "'receita'", "'transferencia_interna'", "'estorno'"])} as nature,
      case when p_partkey % 4 < 2 or p_partkey % 3 = 0 then 'cat-' || p_type end as category_id from part),
  rules as (select *, case when kind in (0, 1, 4) then {norm(pick("p_partkey % 5", [f"'{x}'" for x in PRIORITIES]))} end as description_exact,
      case when kind in (1, 2) then {pick("(p_partkey // 5) % 5", [f"'{x}'" for x in SEGMENTS])} end as merchant_exact,
      case when kind in (3, 5) then 'CUSTOMER ' || lpad(cast(p_partkey // 2 as varchar), 9, '0') end as counterparty_exact,
      case when kind in (2, 4, 5) then 'BANK ' || (p_partkey % 3) end as source_institution,
      case when kind = 4 then 'O' end as card_alias, p_partkey % 10 <> 9 as is_enabled from rules0),
  usable as (select * from rules where is_enabled and (category_id is null or category_id <> 'cat-ECONOMY'))"""

CRITERIA = {
    "description_exact": "description",
    "merchant_exact": "merchant",
    "counterparty_exact": "counterparty",
    "source_institution": "bank",
    "card_alias": "card",
}
MATCHES = " and ".join(f"(r.{c} is null or coalesce(r.{c} = t.{v}, false))" for c, v in CRITERIA.items())
ORDER_TX = f"""{ORDERS}, tx as (select cast(o_orderkey as varchar) as id, cast(o_orderdate as date) as transaction_date,
      {norm("o_orderpriority")} as description, c_mktsegment as merchant, {norm("c_name")} as counterparty,
      'BANK ' || (o_custkey % 3) as bank, case when o_orderstatus <> 'F' then o_orderstatus end as card from base)"""
PROPOSALS = f"""{ORDER_TX}, {RULES},
  matches as (select t.id, r.id as rule_id, r.priority, r.nature, r.category_id from tx t join usable r on {MATCHES}),
  tops as (select * from matches qualify priority = max(priority) over (partition by id)),
  found as (select id, count(distinct nature || '|' || coalesce(category_id, '-')) as outcomes, min(nature) as nature,
      min(category_id) as category_id, min(rule_id) as winner, list_sort(list(rule_id)) as ids from tops group by id),
  proposals as (select tx.id, case when outcomes = 1 then 'classified' else 'pending_review' end as status,
      case when outcomes = 1 then nature end as nature, case when outcomes = 1 then category_id end as category_id,
      case when outcomes = 1 then winner end as winning_rule_id, coalesce(len(ids), 0) as matched_rules,
      sha256(coalesce(array_to_string(ids, ','), '')) as evidence,
      case when outcomes is null then 'no_matching_rule' when outcomes > 1 then 'priority_conflict' end as review_reason
    from tx left join found using (id))"""
DECIDED = "decided as (select distinct cast(user_id as varchar) as id from events)"

REQUESTS = f"""{ORDERS}, req as (select event_id as seq, ts,
      case when event_id % 17 = 0 then 'missing-' || event_id else cast(user_id as varchar) end as transaction_id,
      {pick("event_id % 4", ["'despesa'", "'receita'", "'transferencia_interna'", "'estorno'"])} as nature,
      n_name, n_nationkey, n_regionkey, event_type = 'purchase' as remember, 1 + event_id % 1100 as rule_priority
    from events left join nation on n_nationkey = event_id % 30),
  checked as (select *, case
      when transaction_id not in (select cast(o_orderkey as varchar) from base) then 'transaction_not_found'
      when n_name is not null and n_regionkey = 0 then 'active_category_not_found'
      when nature in ('despesa', 'receita') and n_name is null then 'expense_or_income_requires_active_category'
      when remember and rule_priority > 1000 then 'priority_out_of_range' end as error_code from req)"""


def sql() -> dict[str, str]:
    out: dict[str, str] = {}
    talk = "select 'c' || conv_id || '-' || turn as item, text from conversations"
    out["normalize_text"] = f"""select item, {norm("text")} as normalized, lower({norm("text")}) as column_name
        from (select 'd' || doc_id as item, text from documents union all {talk})"""
    out["generic_description"] = f"with {RAW} select seq, {generic(norm('description'))} as is_generic from raw_rows"
    out["parse_money"] = f"""with {RAW} select seq, {money("amount_text")} as minor,
        case when cents % 1000 % 10 = 0 then (cents // 1000) * 100 + (cents % 1000) // 10 end as from_decimal from raw_rows"""
    clock = """o_orderkey % 25 <= 23 and o_orderkey % 61 <= 59"""
    out["parse_dates"] = f"""with {RAW} select seq, {undeclared("date_text")} as undeclared, {ymd("date_text")} as ymd,
        {dmy("date_text")} as dmy, {mdy("date_text")} as mdy,
        case when {clock.replace("o_orderkey", "seq")} then lpad(cast(seq % 25 as varchar), 2, '0') || ':' || lpad(cast(seq % 61 as varchar), 2, '0') || ':' || lpad(cast(seq % 60 as varchar), 2, '0') end as time_of_day,
        not ({clock.replace("o_orderkey", "seq")}) as bad_time from raw_rows"""
    value, code = signed("minor", "direction")
    out["signed_amount"] = f"""with {RAW}, s as (select seq, {money("amount_text")} as minor,
        coalesce({direction("amount_text")}, {word_direction("words")}) as direction from raw_rows)
        select seq, direction, {value} as signed, {code} as code from s"""
    out["payment_context"] = f"""with {RAW}, t as (select 'o' || seq as item, description || ' ' || words as text from raw_rows union all {talk}),
        n as (select item, {norm("text")} as words from t)
        select item, {payment("words", 1)} as method, {payment("words", 2)} as instrument from n"""
    uuid = "sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode(record_hash))"
    out["record_and_file_hash"] = f"""with {RAW}, h as (select seq, external_id, sha256('["' || concat_ws('","', date_text, amount_text, description, external_id) || '"]') as record_hash from raw_rows),
        u as (select *, {uuid} as s from h)
        select seq, record_hash, substr(s, 1, 8) || '-' || substr(s, 9, 4) || '-5' || substr(s, 14, 3) || '-'
          || substr('89ab89ab89ab89ab', instr('0123456789abcdef', substr(s, 17, 1)), 1) || substr(s, 18, 3) || '-' || substr(s, 21, 12) as file_id,
          external_id not in ('', '0', '000') as reliable from u"""
    out["dedup_keys"] = f"with {EVENT_TX} select id, strong_dedup_key, semantic_fingerprint from keyed"
    out["rule_fingerprints"] = f"""with {RULES}, j as (select *, '{{"card_alias":' || coalesce('"' || card_alias || '"', 'null')
          || ',"category_id":' || coalesce('"' || category_id || '"', 'null') || ',"counterparty_exact":' || coalesce('"' || counterparty_exact || '"', 'null')
          || ',"description_exact":' || coalesce('"' || description_exact || '"', 'null') || ',"merchant_exact":' || coalesce('"' || merchant_exact || '"', 'null')
          || ',"nature":"' || nature || '","priority":' || priority || ',"source_institution":' || coalesce('"' || source_institution || '"', 'null') || '}}' as payload from rules)
        select id, sha256(payload) as fingerprint,
          array_to_string(list_filter([case when priority not between 1 and 1000 then 'priority_range' end,
            case when nature in ('despesa', 'receita') and category_id is null then 'category_required' end], lambda v: v is not null), ',') as violations,
          replace(lower({norm("p_name")}), ' ', '_') as slug from j"""
    out["split_records"] = f"with {FILES} select path, encoding, row_number, len(cells) as width, array_to_string(cells, '~') as cells from rows1"
    headers = {
        0: "data,hora,tipo,origem destino,valor,forma de pagamento",
        1: "data,historico,docto,credito,debito,saldo",
        2: "data movimento,detalhes,montante,natureza",
        3: "date,description,amount,direction",
        4: "data,hora,tipo,valor,forma de pagamento",
    }
    columns = pick("layout", [f"'{h}'" for h in headers.values()])
    marks = pick("layout", ["','", "';'", "';'", "chr(9)", "'|'"])
    raw_headers = [
        "data,hora,tipo,origem / destino,valor,forma de pagamento",
        "Extrato: Ag 0000 | Conta 0;;;;;' || chr(10) || chr(10) || 'Data;Histórico;Docto.;Crédito;Débito;Saldo",
        "Data Movimento;Detalhes;Montante;Natureza",
        "Date' || chr(9) || 'Description' || chr(9) || 'Amount' || chr(9) || 'Direction",
        "data|hora|tipo|valor|forma de pagamento",
    ]
    written = """case layout when 0 then list_concat(list_concat(cells[1:3], ['"' || replace(cells[4], '"', '""') || '"', '"' || cells[5] || '"']), cells[6:6]) else cells end"""
    line = pick("layout", [f"array_to_string({written}, {mark})" for mark in ("','", "';'", "';'", "chr(9)", "'|'")])
    out["profile_files"] = f"""with {FILES}, t as (select path, layout, encoding, {columns} as columns, {marks} as delimiter,
          string_agg({line}, chr(10) order by o_orderkey) as body,
          count(*) as row_count, count(*) filter (layout = 1 and len(cells) <> 6) as irregular_row_count from rows1 group by all),
        w as (select *, {pick("layout", [f"'{h}'" for h in raw_headers])} || chr(10) || body || chr(10) as file_text from t)
        select path, encoding, delimiter, case when layout = 1 then 3 else 1 end as header_row_number, columns, row_count, irregular_row_count,
          sha256('{{"columns": ["' || replace(columns, ',', '", "') || '"], "delimiter": "' || replace(delimiter, chr(9), '\\t') || '"}}') as signature,
          case when encoding = 'utf-8-sig' then sha256(file_text) else sha256(unhex(replace(replace(replace(replace(hex(encode(file_text)), 'C3A9', 'E9'), 'C3B3', 'F3'), 'C3AD', 'ED'), 'C3A3', 'E3'))) end as source_file_hash,
          null as issue_code from w"""
    fields = ", ".join(SYNONYMS)
    out["read_ranges"] = """with r as (select cast(o_custkey % 4 as bigint) as file_no, o_orderkey, c_name, strftime(cast(o_orderdate as date), '%Y-%m-%d') as day,
            cast(round(o_totalprice * 100) as bigint) as cents, o_orderkey % 10 = 7 as two from orders join customer on o_custkey = c_custkey)
          select file_no, ',' as delimiter, 'data,descricao,valor' as columns, count(*) over (partition by file_no) as row_count,
            cast(1 + sum(case when two then 2 else 1 end) over (partition by file_no order by o_orderkey) as int) as row_number, 3 as width,
            day || '~' || c_name || case when two then chr(10) || '"linha", 2' else '' end || '~' || cents as cells from r"""
    out["suggest_mapping"] = f"with {PROFILES}, {suggestion()} select p_partkey, {fields}, mapping_confidence, array_to_string(missing, ',') as missing_fields from suggested"
    listed = "select p_partkey, detection_status, case when detection_status in ('known', 'learned') then f1 end as format_id, candidates from detected"
    out["detect_formats"] = f"with {detection(SPECS)} {listed}"
    out["detect_formats_large_registry"] = out["detect_formats"]
    learned_name = "'Banco São ' || p_size"
    out["learn_formats"] = f"""with {PROFILES}, {suggestion()}, asked as (select *, {learned_name} as institution,
          {pick("p_size % 4", ["'ymd'", "'dmy'", "'mdy'", "'xyz'"])} as date_order,
          sha256(concat_ws('|', array_to_string(columns, '|'), delimiter)) as signature from suggested),
        judged as (select *, len(missing) = 0 and p_size not in (7, 8, 9) and date_order <> 'xyz' as ok from asked),
        good as (select *, 'learned_csv_banco_sao_' || p_size || '_' || substr(signature, 1, 8) as format_id from judged where ok),
        last as (select * from good qualify row_number() over (partition by format_id order by p_partkey desc) = 1)
        select format_id, institution, 'BRL' as currency, date_order, delimiter,
          array_to_string(list_sort([transaction_date, description]), ',') as required,
          array_to_string(list_sort(list_filter([amount, credit, debit], lambda x: x is not null)), ',') as any_group, p_partkey as spec_order from last
        union all select 'picpay_csv_v1', 'PicPay', 'BRL', 'ymd', ',', 'data,origem destino,valor', null, 0
        union all select 'bradesco_csv_v1', 'Bradesco', 'BRL', 'dmy', ';', 'data,historico', 'credito,debito', 1
        union all select 'refused', null, null, null, null, null, null, count(*) from judged where not coalesce(ok, false)"""
    out["schema_drift"] = f"with {PROFILES}, {drift('p_partkey % 2 = 0').format(source='profiles')} select p_partkey, array_to_string(changes, '|') as changes, breaking as drift_breaking from drifted"
    builtin = f"specs as (select 'picpay_csv_v1' as format_id, ',' as delim, {WALLET} as expected, 0 as spec_order, false as learned union all select 'bradesco_csv_v1', ';', {BANK}, 1, false)"
    gate_drift = drift("f1 = 'picpay_csv_v1'").format(source="detected")
    out["gate_files"] = f"""with {detection(builtin)}, {gate_drift}, g as (select *, case when p_size = 50 then 'unreadable_file'
            when detection_status = 'ambiguous' then 'ambiguous_format' when detection_status = 'unknown' then 'missing_minimum_column'
            when detection_status = 'generic' and p_size % 3 = 0 then 'generic_mapping_requires_approval'
            when detection_status = 'generic' and p_size % 3 = 1 then 'missing_currency'
            when detection_status = 'generic' and p_size % 5 = 0 then 'registry_invalid'
            when detection_status in ('known', 'learned') and breaking then 'breaking_drift' end as gate_code from drifted)
        select p_partkey, detection_status, case when gate_code is null then 'processed' else 'blocked' end as ingestion_status, gate_code from g"""
    out["extract_candidates"] = f"""with {FILES} select path, row_number, cast(o_orderdate as date) as transaction_date,
          case layout when 0 then '08:' || lpad(cast(o_orderkey % 60 as varchar), 2, '0') || ':00' when 4 then '10:00:00' end as transaction_time,
          case when layout = 1 and o_orderkey % 10 = 0 then null when layout = 0 and o_orderkey % 3 <> 0 then -cents else cents end as amount_minor,
          case layout when 0 then case when o_orderkey % 3 = 0 then 'inflow' else 'outflow' end
            when 1 then case when o_orderkey % 10 = 0 then null when o_orderkey % 2 = 0 then 'inflow' else 'outflow' end
            when 2 then case when o_orderkey % 2 = 0 then 'outflow' else 'inflow' end when 3 then 'outflow' end as amount_direction,
          case when layout < 2 then 'BRL' else 'EUR' end as currency,
          case layout when 0 then quoted_name when 1 then case when o_orderkey % 10 = 0 then 'SALDO ANTERIOR' when o_orderkey % 10 = 3 then 'COMPRA; ' || name else name end when 4 then '' else name end as description_raw,
          case layout when 0 then 'PicPay' when 1 then 'Bradesco' else 'Approved' end as source_institution,
          case when layout = 1 then case when o_orderkey % 10 = 0 then '0' else cast(o_orderkey as varchar) end end as external_id,
          case when layout = 1 then case when o_orderkey % 10 = 0 then cents else 100000 end end as balance_minor,
          case when layout in (0, 4) then 'pix' end as payment_method, '' as issues,
          case when layout = 1 and o_orderkey % 10 = 0 then 'non_transaction_row' end as rejected_reason from rows1"""
    out["validate_candidates"] = f"with {VALID} select seq, amount_signed, normalized as description_normalized, array_to_string(codes, ',') as issues, outcome from judged"
    out["constraint_violations"] = f"""with {VALID} select seq, array_to_string(list_filter([
          case when seq % 9 = 0 then 'card_last_four_format' end, case when seq < 1 then 'location_positive' end,
          case when d is null then 'date_present' end, case when amount_signed is null then 'amount_not_zero' end,
          case when description = '' then 'description_present' end, case when normalized = '' then 'normalized_description_present' end],
          lambda v: v is not null), ',') as violations from judged"""
    fixed_value, fixed_code = signed("m", "w")
    out["apply_corrections"] = f"""with {VALID}, fixes as (select *, case when seq % 2 = 0 then date '2026-02-03' end as nd, case when seq % 3 = 0 then seq * 10 + 5 end as nm,
            case when seq % 5 = 0 then 'inflow' end as nw, case when seq % 4 = 0 then 'Padaria São João' end as nt from judged where outcome = 'pending'),
          fixed as (select *, coalesce(nd, d) as dd, coalesce(nm, minor) as m, coalesce(nw, direction) as w, {norm("coalesce(nt, description)")} as t,
            nd is null and nm is null and nw is null and nt is null as empty from fixes),
          again as (select *, {fixed_value} as sv, list_filter([
            case when d is null and date_text <> '' and nd is null then 'invalid_transaction_date' end,
            case when minor is null and amount_text <> '' and nm is null then 'invalid_amount' end,
            case when dd is null and date_text = '' then 'missing_transaction_date' end,
            case when m is null then case when amount_text = '' then 'missing_amount' end else {fixed_code} end,
            case when t = '' then 'missing_description' when {generic("t")} then 'generic_description_only' end], lambda c: c is not null) as c2 from fixed)
          select seq, sv as amount_signed, array_to_string(c2, ',') as issues,
            case when not empty then case when len(c2) > 0 then 'pending' else 'transaction' end end as outcome,
            case when empty then 'empty_correction' end as correction_error from again"""
    out["in_file_duplicates"] = """with r as (select l_suppkey as file_id, sha256('["' || l_partkey || '","' || cast(l_quantity as bigint) || '"]') as source_record_hash,
            l_orderkey * 10 + l_linenumber as row_number from lineitem)
          select *, row_number > min(row_number) over (partition by file_id, source_record_hash) as is_duplicate from r"""
    out["skip_imported"] = """select o_orderkey as file_no, sha256(cast(o_custkey as varchar)) as source_file_hash,
          coalesce(c_acctbal > 0, false) or row_number() over (partition by o_custkey order by o_orderkey) > 1 as already_imported
          from orders left join customer on o_custkey = c_custkey"""
    out["cross_file_duplicates"] = f"""with {EVENT_TX}, o as (select *, import_seq * 1000000000000 + event_id as ord from keyed),
          strong as (select strong_dedup_key, min(ord) as ord from o where strong_dedup_key is not null group by 1),
          kept as (select o.* from o join strong using (strong_dedup_key, ord)),
          blockers as (select semantic_fingerprint, min(ord) as ord from (select * from kept union all select * from o where strong_dedup_key is null) group by 1),
          asked as (select o.id, o.ord, strong_dedup_key is not null as is_strong, coalesce(s.ord, b.ord) as first_ord from o
            left join strong s using (strong_dedup_key) left join blockers b on strong_dedup_key is null and b.semantic_fingerprint = o.semantic_fingerprint)
          select a.id, case when a.ord <> first_ord then f.id end as existing_transaction_id,
            case when a.ord <> first_ord then case when is_strong then 'external_id' else 'semantic_fingerprint' end end as detection_strategy,
            case when a.ord <> first_ord then case when is_strong then 'confirmed_duplicate' else 'open_review' end end as duplicate_status
          from asked a join o f on f.ord = a.first_ord"""
    out["import_summary"] = f"""with {VALID}, h as (select *, sha256('["' || institution || '","' || amount_text || '","' || description || '"]') as rh, seq % 11 = 0 as bad from judged),
          r as (select *, case when bad then 'rejected' when row_number() over (partition by file_no, rh, bad order by seq) > 1 then 'duplicate' else outcome end as route from h),
          c as (select *, list_concat(case when route = 'rejected' or seq % 13 = 0 then ['invalid_row'] else [] end,
            case route when 'duplicate' then ['duplicate_record'] when 'rejected' then [] else codes end) as all_codes from r),
          counts as (select file_no, code, count(*) as n from (select file_no, unnest(all_codes) as code from c) group by all),
          maps as (select file_no, '{{' || string_agg('"' || code || '":' || n, ',' order by code) || '}}' as issue_counts from counts group by 1)
          select cast(file_no as varchar) as import_id, count(*) as records_read, count(*) filter (route = 'transaction') as transactions_created,
            count(*) filter (route = 'pending') as pending_created, count(*) filter (route = 'duplicate') as duplicates_found,
            count(*) filter (route = 'rejected') as records_rejected, true as balanced, any_value(issue_counts) as issue_counts,
            case when any_value(issue_counts) is null then 'completed' else 'completed_with_issues' end as status
          from c left join maps using (file_no) group by file_no"""
    out["store_batch"] = f"""with {FILES}, known as (select *, cents as minor from rows1 where layout < 2 and not (layout = 1 and o_orderkey % 10 = 0)),
          keyed as (select *, sha256(array_to_string(cells, '~')) as rh from known),
          firsts as (select *, case when layout = 0 and o_orderkey % 3 <> 0 or layout = 1 and o_orderkey % 2 = 1 then -cents else cents end as signed,
            {norm("case when layout = 0 then quoted_name when o_orderkey % 10 = 3 then 'COMPRA; ' || name else name end")} as t from keyed
            qualify row_number() over (partition by file_no, rh order by o_orderkey) = 1),
          weak as (select *, row_number() over (partition by cast(o_orderdate as date), signed, t order by file_no, o_orderkey) as k from firsts where layout = 0)
          select (select count(distinct file_no) from rows1) + (select count(distinct file_no) from rows1 where layout > 1) as import_attempts,
            (select count(distinct file_no) from rows1 where layout < 2) as completed_imports,
            (select count(*) from firsts where layout = 1) + (select count(*) from weak where k = 1) as transactions,
            0 as open_pending, (select count(*) from weak where k > 1) as duplicate_candidates"""
    out["active_rules"] = f"with {RULES} select id, priority, case when category_id is not null then upper(p_type[1]) || lower(p_type[2:]) end as category_name from usable"
    out["match_rules"] = f"with {PROPOSALS} select * from proposals"
    out["classify_undecided"] = f"""with {PROPOSALS}, {DECIDED}, w as (select * from proposals where id not in (select id from decided))
          select count(*) as examined, count(*) filter (status = 'classified') as classified, count(*) filter (status <> 'classified') as pending_review,
            (select count(*) from decided) as skipped_with_decision from w"""
    out["undecided_queue"] = f"with {ORDER_TX}, {DECIDED} select id, transaction_date from tx where id not in (select id from decided) order by transaction_date, id limit 500"
    out["decision_history"] = """select cast(event_id as varchar) as id, cast(user_id as varchar) as transaction_id,
          upper(event_type[1]) || event_type[2:] as category_name, ts as decided_at,
          lead(ts) over w as superseded_at, lead(ts) over w is null as is_current from events window w as (partition by user_id order by ts, event_id)"""
    out["current_decision_for"] = """with c as (select * from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1)
          select cast(event_id as varchar) as id, cast(user_id as varchar) as transaction_id, event_type as category_id from c
          where user_id in (select user_id from events where event_type = 'signup' and value > 30)"""
    episodes = """e as (select *, event_type in ('purchase', 'signup') as resolves,
            case event_type when 'click' then 'no_matching_rule' when 'view' then 'priority_conflict' when 'error' then 'user_requested' end as reason,
            case when event_type = 'view' then list_sort(['r' || (event_id % 7), 'r' || (event_id % 3)]) else [] end as cand from events),
          n as (select *, coalesce(sum(resolves::int) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as episode from e),
          g as (select cast(user_id as varchar) as transaction_id, cast(episode as bigint) as episode, min(ts) filter (not resolves) as created_at,
            min(ts) filter (resolves) as resolved_at, arg_max(reason, ts) filter (not resolves) as reason, arg_max(cand, ts) filter (not resolves) as cand
            from n group by all having count(*) filter (not resolves) > 0)"""
    out["review_queue"] = f"""with {episodes} select transaction_id, episode, case when resolved_at is null then 'open' else 'resolved' end as status, reason,
          array_to_string(cand, ',') as candidate_rule_ids, len(cand) as candidate_rules, created_at, resolved_at from g"""
    out["open_review_queue"] = f"""with {episodes} select transaction_id, reason, len(cand) as candidate_rules, created_at from g
          where resolved_at is null order by created_at limit 100"""
    out["apply_category_changes"] = """with l as (select event_id, event_type, 'CATEGORIA ' || (user_id % 40) as name from events),
          made as (select name, min(event_id) as created_seq from l where event_type in ('click', 'view') group by 1),
          sw as (select l.*, created_seq is not null and event_id > created_seq as applied from l left join made using (name) where event_type in ('error', 'purchase')),
          flag as (select name, arg_max(event_type = 'error', event_id) as flag from sw where applied group by 1)
          select name as normalized_name, coalesce(flag, true) as is_active, created_seq from made left join flag using (name)
          union all select 'refused', false, (select count(*) from sw where not applied) + (select count(*) from l where event_type = 'signup')"""
    coarse = "cast(floor(priority / 250) * 250 as int)"
    out["apply_rule_changes"] = f"""with {RULES}, j as (select *, {coarse} as cp, array_to_string(list_filter([case when {coarse} not between 1 and 1000 then 'priority_range' end,
              case when nature in ('despesa', 'receita') and category_id is null then 'category_required' end], lambda v: v is not null), ',') as broken from rules),
          e as (select *, case when broken <> '' then broken when category_id = 'cat-ECONOMY' then 'active_category_not_found' end as error_code from j),
          f as (select *, sha256('{{"card_alias":' || coalesce('"' || card_alias || '"', 'null')
          || ',"category_id":' || coalesce('"' || category_id || '"', 'null') || ',"counterparty_exact":' || coalesce('"' || counterparty_exact || '"', 'null')
          || ',"description_exact":' || coalesce('"' || description_exact || '"', 'null') || ',"merchant_exact":' || coalesce('"' || merchant_exact || '"', 'null')
          || ',"nature":"' || nature || '","priority":' || cp || ',"source_institution":' || coalesce('"' || source_institution || '"', 'null') || '}}') as fp from e)
          select fp as rule_fingerprint, 'Rule ' || arg_min(p_name, p_partkey) as name, true as is_enabled, min(p_partkey) as created_seq from f where error_code is null group by 1
          union all select error_code, 'refused', false, count(*) from f where error_code is not null group by 1"""
    out["correct_classification"] = f"""with {REQUESTS}, ok as (select * from checked where error_code is null),
          w as (select *, lag(seq) over (partition by transaction_id order by ts, seq) as prev from ok)
          select seq, transaction_id, nature, case when n_name is not null then 'n-' || n_nationkey end as category_id,
            coalesce(prev, case when transaction_id in (select cast(c_custkey as varchar) from customer) then -1 end) as previous_seq, remember as remembered from w"""
    out["correction_errors"] = f"with {REQUESTS} select coalesce(error_code, 'accepted') as result, count(*) as requests from checked group by 1"
    out["classification_overview"] = f"""with {RULES}, {episodes} select (select count(distinct p_type) from part where p_type <> 'ECONOMY') as active_categories,
          (select count(*) from usable) as enabled_rules, (select count(distinct user_id) from events) as classified_transactions,
          (select count(*) from g where resolved_at is null) as open_reviews, (select count(*) from events where event_type = 'purchase') as corrections"""
    out["check_proposals"] = f"""with {ORDER_TX}, {RULES}, p as (select b.o_orderkey, case when b.o_orderkey % 19 = 0 then 'missing' else cast(b.o_orderkey as varchar) end as transaction_id,
            case when b.o_orderkey % 7 = 0 then 'estorno' else r.nature end as nature, r.category_id, r.id as rid, r.nature as rn, u.id is not null as usable_rule, r.*
            exclude (nature, category_id, id) from base b join rules r on r.p_partkey = b.o_custkey left join usable u on u.id = r.id),
          c as (select case when transaction_id = 'missing' then 'transaction_not_found' when not usable_rule then 'winning_rule_not_available'
            when r.nature <> r.rn or not ({MATCHES}) then 'winning_rule_does_not_support_proposal' else 'accepted' end as result
            from p r left join tx t on t.id = r.transaction_id)
          select result, count(*) as proposals from c group by 1"""
    out["pending_queue"] = f"with {VALID} select lpad(cast(seq as varchar), 12, '0') as id, array_to_string(codes, ',') as issues from judged where outcome = 'pending' order by seq limit 100"
    out["classifier_view"] = f"""with {ORDERS} select cast(o_orderkey as varchar) as transaction_id, cast(o_orderdate as date) as transaction_date, cents as amount_minor, 'BRL' as currency,
          {norm("o_orderpriority")} as description, 'Bank ' || (o_custkey % 3) as source_institution, null as payment_method, null as payment_instrument,
          case when o_orderstatus <> 'F' then o_orderstatus end as card_alias, c_name as counterparty_name, lower(c_mktsegment) as merchant_name from base"""
    out["redacted_rule_list"] = f"""with {RULES} select id, p_name as name, priority, nature, case when category_id is not null then upper(p_type[1]) || lower(p_type[2:]) end as category_name, is_enabled,
          (description_exact is not null)::int + (merchant_exact is not null)::int + (counterparty_exact is not null)::int + (source_institution is not null)::int + (card_alias is not null)::int as criteria from rules"""
    out["category_list"] = "select distinct 'cat-' || p_type as id, upper(p_type[1]) || lower(p_type[2:]) as name from part where p_type <> 'ECONOMY'"
    out["outcomes_by_institution"] = f"with {VALID} select institution as source_institution, outcome, count(*) as row_count, cast(sum(amount_signed) as bigint) as total_minor from judged group by all"
    return out
