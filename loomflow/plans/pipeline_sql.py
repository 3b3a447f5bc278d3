"""SQL for the log and packed-field queries: other ways to the same rows.

The logs' layouts, which the operator mines, are written out here one by one, and packed
fields are matched by one pattern per item instead of being folded.
"""

from __future__ import annotations

_ENTRIES = r"""
with l as (select log_id, line_no, max(line) as line from am_log where log_id is not null and line_no is not null group by 1, 2),
n as (select *, lead(line) over w as l1, lead(line, 2) over w as l2, lead(line, 3) over w as l3, lead(line, 4) over w as l4 from l window w as (partition by log_id order by line_no)),
h as (
  select log_id, line_no, epoch_us(cast(x.d as timestamp)) // 1000 + cast(x.f as bigint) as ms, x.l as lv, x.c as c, x.m as m
  from (select *, regexp_extract(line, '^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d),(\d{3}) \[(\w+)\] \[[^\]]*\] \|([^|]*)\|: ?(.*)$', ['d', 'f', 'l', 'c', 'm']) as x from n) where x.d <> ''
  union all
  select log_id, line_no, epoch_us(cast(x.d || ' ' || x.t as timestamp)) // 1000 + cast(x.f as bigint)
    - case when x.z = 'Z' then 0 else (case when x.z[1] = '-' then -1 else 1 end) * (cast(x.z[2:3] as bigint) * 60 + cast(x.z[5:6] as bigint)) * 60000 end, x.l, x.c, x.m
  from (select *, regexp_extract(line, '^(\d{4}-\d\d-\d\d)T(\d\d:\d\d:\d\d)\.(\d{3})(Z|[+-]\d\d:\d\d) (\w+) +(\S+) - (.*)$', ['d', 't', 'f', 'z', 'l', 'c', 'm']) as x from n) where x.d <> ''
  union all
  select log_id, line_no, epoch_us(strptime(x.d, '%Y%m%dT%H%M%S')) // 1000, x.l, x.c, x.m
  from (select *, regexp_extract(line, '^(\S+) (\w+) (\d{8}T\d{6})Z - (.*)$', ['c', 'l', 'd', 'm']) as x from n) where x.d <> ''
  union all
  select log_id, line_no, cast(x.s || x.f as bigint), x.l, x.c, x.m
  from (select *, regexp_extract(line, '^(\d{10})\.(\d{3})\|(\w+)\|([^|]*)\|(.*)$', ['s', 'f', 'l', 'c', 'm']) as x from n) where x.s <> ''
  union all
  select log_id, line_no, epoch_us(strptime(x.d, '%Y%m%d %H:%M:%S')) // 1000 + cast(x.f as bigint), x.l, x.c, x.m
  from (select *, regexp_extract(line, '^([A-Z])(\d{8} \d\d:\d\d:\d\d)\.(\d{3})\d* \d+ (\S+?):\d+\] (.*)$', ['l', 'd', 'f', 'c', 'm']) as x from n) where x.d <> ''
  union all
  select log_id, line_no, epoch_us(strptime(x.d, '%d/%b/%Y:%H:%M:%S')) // 1000 - cast(x.s || '1' as bigint) * (cast(x.h as bigint) * 60 + cast(x.n as bigint)) * 60000, x.l, x.c, x.m
  from (select *, regexp_extract(line, '^\[(\d+/\w+/\d{4}:\d\d:\d\d:\d\d) ([+-])(\d\d)(\d\d)\] (\w+) \(([^)]*)\) (.*)$', ['d', 's', 'h', 'n', 'l', 'c', 'm']) as x from n) where x.d <> ''
  union all
  select log_id, line_no, case when t like '%T%' then epoch_us(cast(rtrim(replace(t, 'T', ' '), 'Z') as timestamp)) // 1000 else cast(t as bigint) end, lv, c, m
  from (select log_id, line_no, json_extract_string(line, '$.ts') as t, json_extract_string(line, '$.level') as lv, json_extract_string(line, '$.logger') as c, json_extract_string(line, '$.msg') as m from n where line like '{"%}')
  union all
  select log_id, line_no, epoch_us(cast(rtrim(replace(t, 'T', ' '), 'Z') as timestamp)) // 1000, lv, c, m
  from (select log_id, line_no, regexp_extract(b, '"time": "([^"]*)"', 1) as t, regexp_extract(b, '"severity": "([^"]*)"', 1) as lv, regexp_extract(b, '"component": "([^"]*)"', 1) as c, json_extract_string('{' || l4 || '}', '$.message') as m
        from (select *, concat_ws(chr(10), l1, l2, l3, l4) as b from n where line = '{')) where t <> ''
  union all
  select log_id, line_no, cast(t as bigint), lv, c, m
  from (select log_id, line_no, regexp_extract(line, '(?:^| )ts=(\d+)', 1) as t, regexp_extract(line, '(?:^| )level=(\S+)', 1) as lv, regexp_extract(line, '(?:^| )comp=(\S+)', 1) as c, regexp_replace(regexp_extract(line, '(?:^| )msg="((?:[^"\\]|\\.)*)"', 1), '\\(.)', '\1', 'g') as m from n where regexp_matches(line, '^(ts|level|comp|msg)=')) where t <> ''),
e as (select log_id, max(line_no) as last from l group by 1),
r as (select log_id, line_no as first_line, cast(coalesce(lead(line_no) over (partition by log_id order by line_no) - 1, last) as integer) as last_line, ms as ts_ms,
  case upper(lv) when 'T' then 'TRACE' when 'D' then 'DEBUG' when 'I' then 'INFO' when 'W' then 'WARN' when 'WARNING' then 'WARN' when 'E' then 'ERROR' when 'ERR' then 'ERROR' when 'F' then 'FATAL' else upper(lv) end as log_level,
  c as component, m from h join e using (log_id))
"""

P3_FOUND_SQL = _ENTRIES + "select * exclude (m) from r"

P3_ENTRIES_SQL = _ENTRIES + """
select r.* exclude (m), m || case when tail is null or o.line = '{' then '' else chr(10) || tail end as message
from r join l as o on o.log_id = r.log_id and o.line_no = r.first_line
left join (select r.log_id, r.first_line, string_agg(coalesce(line, ''), chr(10) order by line_no) as tail from r join l on l.log_id = r.log_id and line_no > first_line and line_no <= last_line group by 1, 2) t
  on t.log_id = r.log_id and t.first_line = r.first_line
"""

_LITERAL = r"""\"(?:[^\"\\]|\\.)*\"|''(?:[^''\\]|\\.)*''|`(?:[^`\\]|\\.)*`"""
_TRIM = "trim({}, ' ' || chr(9) || chr(10) || chr(13))"
_BARE = r"case when len({v}) > 1 and {v}[1] = {v}[-1] and {v}[1] in ('\"', '''', '`') then regexp_replace(replace({v}[2:-2], {v}[1] || {v}[1], {v}[1]), '\\(.)', '\1', 'g') else {v} end".replace(r"\"", '"')


def _items(source: str, name: str, key: str, plain: str) -> str:
    item = rf"(?:{_LITERAL}|\[[^\]]*\]|\{{[^}}]*\}}|{plain})+".replace(r"\"", '"')
    field = _TRIM.format(name)
    whole = field if name == "args" else f"case when {field}[1] || {field}[-1] in ('[]', '{{}}', '()') then {field}[2:-2] else {field} end"
    return f"""select distinct '{name}' as field_name, cast({key} as varchar) as row_key,
      list_filter(list_transform(regexp_extract_all({whole}, '{item}'), lambda x: {_TRIM.format("x")}), lambda x: x <> '') as items
    from {source} where {key} is not null and {field} not in ('', 'None')"""


P5_FOUND_SQL = rf"""
with f as ({_items("am_raw_events", "args", "event_id", "[^,;|]")}
  union all {_items("queries", "tables_read", "entity_id", "[^,;|\\s]")}
  union all {_items("queries", "tables_written", "entity_id", "[^,;|\\s]")}),
p as (select field_name, row_key, generate_subscripts(items, 1) as pos, unnest(items) as x from f),
k as (select *, regexp_extract(x, '(?s)^([A-Za-z_][A-Za-z0-9_.-]*)\s*(?:=>|=|:)\s*(.*)$', ['k', 'v']) as kv from p)
select field_name, row_key, cast(pos as integer) as pos,
  case when field_name = 'args' and kv.k <> '' then kv.k || '=' || {_BARE.format(v="kv.v")} else {_BARE.format(v="x")} end as item
from k
"""
