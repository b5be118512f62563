"""DuckDB SQL for the queries, written apart from the Spark code."""

from __future__ import annotations

_T = """t as (select o_orderkey as task, o_custkey as owner, year(o_orderdate) as sprint,
  case when o_orderpriority = '2-HIGH' then 'High' when o_orderpriority = '3-MEDIUM' then 'Medium' else 'Low' end as priority,
  case o_orderstatus when 'F' then 'Done' when 'O' then 'To-Do' else 'Pending' end as status, o_orderdate::date as start from orders)"""
_SUM = f"""with {_T}, s as (select c_custkey as owner, count(task)::bigint as total,
  (count(*) filter (where priority = 'High'))::bigint as high, (count(*) filter (where status = 'Done'))::bigint as done,
  (count(*) filter (where status <> 'Done'))::bigint as pending
  from customer left join t on c_custkey = owner and sprint = 1997 group by 1)"""
_DAYS = f"""with {_T}, x as (select *, case when task % 10 <> 0 then start + 10 end as fin from t),
  y as (select *, case when status = 'Done' then 0 when fin is not null then date_diff('day', date '1998-06-01', fin::date) end as days from x)"""
_A = """a as (select user_id || '/' || strftime(ts, '%Y-%m-%d') as history_id, event_id as attempt, epoch_us(ts) as start,
  floor(value * 1000)::bigint as duration, case when event_type = 'error' then 'failed' else 'passed' end as status,
  'epic' || (user_id % 3) as epic, 'feature' || (user_id % 12) as feature, event_type as story from events)"""
_LAST = f"with {_A}, l as (select * from a qualify row_number() over (partition by history_id order by start desc, attempt desc) = 1)"
_LINES = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate"
_STATUSES = ["failed", "broken", "passed", "skipped", "unknown"]
_COUNTS = ", ".join(f"(count(*) filter (where status = '{s}'))::bigint as {s}" for s in _STATUSES) + ", count(*)::bigint as total"
#: Lines as steps, by recursion from the lines that start one.
_STEPS = f"""with recursive line as (
    select l_orderkey, l_linenumber, l_quantity, l_returnflag, epoch_us(l_shipdate) as start,
      l_quantity < 15 or row_number() over w = 1 as top, row_number() over w as k from lineitem window w as (partition by l_orderkey order by {_LINES})),
  r as (
    select *, (row_number() over (partition by l_orderkey order by k) - 1)::varchar as path, 1 as depth from line where top
    union all
    select line.*, r.path || '.1', r.depth + 1 from r join line on line.l_orderkey = r.l_orderkey and line.k = r.k + 1 and not line.top),
  steps as (
    select l_orderkey::varchar as uuid, path, depth, 'line ' || l_linenumber as name, case when l_quantity > 45 then 'failed' else 'passed' end as status, start, start + l_linenumber as stop,
      1 + (exists (select 1 from line n where n.l_orderkey = r.l_orderkey and n.k = r.k + 1 and not n.top))::int as n_steps from r
    union all
    select l_orderkey::varchar, path || '.0', depth + 1, 'flag ' || l_returnflag, case when l_returnflag = 'R' then 'broken' else 'passed' end, start, null, 0 from r)"""
_PRICED = "with p as (select l_orderkey, l_linenumber, l_extendedprice, l_quantity, row_number() over (order by l_extendedprice desc, l_orderkey, l_linenumber)::bigint - 1 as position from lineitem)"
_TESTS = """with h as (select strftime(ts, '%Y-%m-%d') as run, user_id::varchar as history_id, event_id as attempt, epoch_us(ts) as start, floor(value * 1000)::bigint as duration,
  case when event_type = 'error' then 'failed' else 'passed' end as status from events)"""

ORACLES = {
    "task_summary": f"{_SUM} select * from s",
    "task_total_row": f"{_SUM} select owner::varchar as owner, total, high, done, pending from s union all select 'TOTAL', sum(total)::bigint, null, sum(done)::bigint, sum(pending)::bigint from s",
    "task_kpi": f"{_SUM} select sum(total)::bigint as total, case when sum(total) = 0 then 0.0::double else sum(done)::double / sum(total)::double end as progress, sum(pending)::bigint as pending from s",
    "task_chart_long": f"""{_SUM} select 'doughnut' as chart, 'all' as category, 'Done' as series, sum(done)::bigint as value from s
      union all select 'doughnut', 'all', 'Pending', sum(pending)::bigint from s
      union all select 'bar', owner::varchar, 'Total', total from s union all select 'bar', owner::varchar, 'High', high from s
      union all select 'bar', owner::varchar, 'Done', done from s""",
    "task_sprints": f"""with {_T}, p as (select unnest([1996, 1997]) as sp) select c_custkey as owner, sp::bigint as sprint, count(task)::bigint as total,
      (count(*) filter (where priority = 'High'))::bigint as high, (count(*) filter (where status = 'Done'))::bigint as done, (count(*) filter (where status <> 'Done'))::bigint as pending
      from customer cross join p left join t on c_custkey = owner and sprint = sp group by 1, 2""",
    "task_table": f"""with {_T}, x as (select *, (start + 10)::date as fin from t),
      y as (select *, case when status = 'Done' then 0 else date_diff('day', date '1998-06-01', fin) end as days from x),
      z as (select *, case when days < 0 and status <> 'Done' then 'OVERDUE' when priority = 'High' and status <> 'Done' then 'ATTENTION' else 'OK' end as f from y)
      select task, 'TASK-' || (100 + task) as label, start::varchar as start, fin::varchar as "end", days::bigint as days_left, f as flag,
      case when status = 'Done' then 'green' when f = 'OVERDUE' then 'red' end as colour from z""",
    "task_days_left": f"{_DAYS} select task, days::bigint as days_left from y",
    "task_flag": f"""{_DAYS} select case when days < 0 and status <> 'Done' then 'OVERDUE' when priority = 'High' and status <> 'Done' then 'ATTENTION' else 'OK' end as flag,
      count(*)::bigint as n from y group by 1""",
    "task_percent": f"""with {_T} select task, case status when 'Done' then 1.0::double when 'To-Do' then 0.0::double else round(0.1::double + 0.8::double * ((task * 7919) % 1000)::double / 1000, 2) end as pct from t""",
    "task_domain_check": f"""with {_T}, x as (select case when task % 7 = 0 then 'Urgent' when task % 11 <> 0 then priority end as p, status from t)
      select case when p in ('High', 'Medium', 'Low') and status in ('To-Do', 'In-Progress', 'Pending', 'Done') then 'valid' else 'rejected' end as outcome, count(*)::bigint as n from x group by 1""",
    "task_id_format": "select o_orderkey as task, 'TASK-' || (100 + o_orderkey) as label from orders",
    "run_latest": f"{_LAST} select history_id, attempt, status, duration from l",
    "run_retries": f"""with {_A}, n as (select *, row_number() over (partition by history_id order by start desc, attempt desc) as rn from a)
      select history_id, count(*)::bigint - 1 as retries, coalesce(string_agg(attempt::varchar, ',' order by rn) filter (where rn > 1), '') as earlier from n group by 1""",
    "run_retry_totals": f"with {_A} select count(distinct history_id)::bigint as runs, (count(*) - count(distinct history_id))::bigint as retries from a",
    "run_status_change": f"""{_LAST} select l.history_id, l.status, exists (select 1 from a where a.history_id = l.history_id and a.status <> l.status) as changed from l""",
    "run_status_counts": f"{_LAST} select {_COUNTS} from l",
    "run_duration_stats": f"{_LAST} select max(start + duration) - min(start) as wall, min(duration) as shortest, max(duration) as longest, sum(duration)::bigint as total from l",
    "run_group_counts": f"{_LAST} select epic, feature, story, count(*)::bigint as tests, (count(*) filter (where status = 'passed'))::bigint as passed from l group by 1, 2, 3",
    "run_suite_counts": f"{_LAST} select epic, count(*)::bigint as tests, (count(*) filter (where status = 'passed'))::bigint as passed from l group by 1",
    "run_tree_rollup": f"""{_LAST} select epic, feature, story, (3 - grouping(epic) - grouping(feature) - grouping(story))::bigint as depth, count(*)::bigint as tests,
      (count(*) filter (where status = 'passed'))::bigint as passed from l group by rollup (epic, feature, story)""",
    "run_child_distinct": f"{_LAST} select epic, count(distinct feature)::bigint as children from l group by 1",
    "run_metrics_long": f"""{_LAST}, c as (select {_COUNTS} from l), u as (unpivot c on {", ".join([*_STATUSES, "total"])} into name n value v)
      select 'launch_' || n as name, v as value, 'launch_' || n || ' ' || v as line from u""",
    "run_label_lookup": f"with {_A} select attempt, story, null::varchar as owner from a",
    "run_containers": f"with {_A} select epic || '-' || (attempt % 64) as container, count(*)::bigint as children, (count(*) filter (where status = 'failed'))::bigint as failed from a group by 1",
    "cat_search": "select p_partkey, p_name from part where p_name ilike '%red%'",
    "cat_search_indexed": "select p_partkey, p_name from part where p_name ilike '%red w%'",
    "cat_brand_filter": "select p_partkey, p_brand from part where p_brand = 'Brand#11'",
    "cat_two_level": "select c_custkey, n_name, r_name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name = 'ASIA' and n_nationkey % 2 = 0",
    "cat_brand_counts": "select p_brand as brand, count(*)::bigint as n from part group by 1",
    "cat_nth_strict": "select p_partkey, p_name from part order by p_partkey limit 1 offset 5",
    "cat_nth_lenient": f"""with n as (select l_orderkey, l_partkey, row_number() over (partition by l_orderkey order by {_LINES}) as rn from lineitem)
      select o_orderkey, 'part ' || l_partkey as item from orders left join n on o_orderkey = l_orderkey and rn = 5""",
    "cat_first": "select p_partkey, p_retailprice from part order by p_retailprice desc, p_partkey limit 1",
    "cat_second_else_first": """with n as (select c_custkey, c_nationkey::bigint as c_nationkey, row_number() over (partition by c_nationkey order by c_custkey) as rn, count(*) over (partition by c_nationkey) as k from customer)
      select c_custkey, c_nationkey from n where rn = least(k, 2)""",
    "cat_contains_trap": "select p_partkey, lower(p_brand) like '%brand#1%' as loose, lower(p_brand) = 'brand#1' as exact from part",
    "cat_price": "select p_partkey, case when p_partkey % 9 <> 0 then p_size::double end as price from part",
    "cat_add_all": "select count(*)::bigint as attempted, (count(*) filter (where p_partkey in (select l_partkey from lineitem where l_quantity >= 45)))::bigint as succeeded from part where p_name ilike '%a%'",
    "cart_counts": "select l_orderkey, count(*)::bigint as n, true as any_there from lineitem group by 1",
    "cart_remove_nth": f"""select l_orderkey, l_linenumber::bigint as l_linenumber, l_partkey, rn - 1 as position from
      (select *, row_number() over (partition by l_orderkey order by {_LINES}) as rn from lineitem) where rn <> 1""",
    "cart_delta": """select l_orderkey, count(*)::bigint as n_before, case when count(*) >= 2 then count(*) - 1 else count(*) end::bigint as n_after, count(*) >= 2 as one_less from lineitem group by 1""",
    "cart_snapshot_diff": """with b as (select l_orderkey, l_partkey, sum(l_quantity::bigint)::bigint as was from lineitem where l_partkey % 5 <> 0 group by 1, 2),
      n as (select l_orderkey, l_partkey, sum(l_quantity::bigint + (l_partkey % 11 = 0)::int)::bigint as now from lineitem where l_partkey % 7 <> 0 group by 1, 2)
      select coalesce(b.l_orderkey, n.l_orderkey) as l_orderkey, coalesce(b.l_partkey, n.l_partkey) as l_partkey, was, now,
      case when was is null then 'added' when now is null then 'removed' else 'changed' end as change
      from b full join n on b.l_orderkey = n.l_orderkey and b.l_partkey = n.l_partkey where was is distinct from now""",
    "addr_contains_all": "select c_custkey, c_custkey % 4 <> 0 as complete from customer join nation on c_nationkey = n_nationkey",
    "acct_duplicate": """with a as (select c_custkey, lower(c_mktsegment) || '+' || (c_custkey % 100) || '@example.org' as email from customer)
      select * from a qualify row_number() over (partition by email order by c_custkey) > 1""",
    "acct_no_match": """with a as (select c_custkey, c_name as email, case when c_custkey % 3 = 0 then 'wrong' else c_mktsegment end as password from customer)
      select c_custkey, email from a where not exists (select 1 from customer c where c.c_name = a.email and c.c_mktsegment = a.password)""",
    "body_json_or_raw": "select event_id, case when event_id % 4 = 0 then 'no json: ' || event_type else '{\"k\":' || (props->>'k') || '}' end as body from events",
    "body_envelope": """select event_id, case when event_type = 'error' then 404 else 200 end::bigint as transport, (props->>'k')::bigint as "inner",
      event_type <> 'error' and coalesce((props->>'k')::bigint < 50, false) as accepted from events""",
    "text_truncate": "select doc_id, left(text, 500) || '...' as summary from documents",
    "field_presence": "select event_id, (props->>'k') is not null as has_k, (props->'usertype'->>'usertype') is not null as has_usertype from events",
    "param_ids": "select n_nationkey::bigint as n_nationkey, case when n_nationkey % 2 = 0 then n_name else (row_number() over (order by n_nationkey) - 1)::varchar end as param_id from nation",
    "param_cross": "select r_name, n_name from region cross join nation",
    "steps_html": "select conv_id, count(*)::bigint as n_steps, '<ol>' || string_agg('<li>' || role || '</li>', '' order by turn, role) || '</ol>' as html from conversations group by 1",
    "dom_links": """with l as (select page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) as h from pages)
      select page_id, unnest(range(0, len(h)))::bigint as position, unnest(h) as href from l where len(h) > 0""",
    "dom_scope": """with l as (select page_id, regexp_extract_all(regexp_extract(html, '(?s)<nav[^>]*>(.*?)</nav>', 1), '<a href="([^"]*)"', 1) as h from pages)
      select page_id, len(h)::bigint as nav_links from l where len(h) > 0""",
    "dom_fallback": """select page_id, coalesce(nullif(regexp_extract(html, '(?s)<aside[^>]*>(.*?)</aside>', 1), ''), nullif(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1), '')) as heading from pages""",
    "dom_predicates": """select page_id, contains(html, 'lang="fr"') as is_fr, regexp_matches(html, '<a href="[^"]*the[^"]*"') as href_has_the, contains(url, '/en/') as url_has_en from pages""",
    "default_value": "select event_id, case when event_type = 'purchase' then coalesce(props, 'none given') else 'none given' end as comment from events",
    "unique_key": "select c_custkey, 'test_' || left(md5(c_name), 10) as name from customer",
    "timed_email": "select o_orderkey, 'user+' || (epoch_us(o_orderdate) // 1000000) || '@example.org' as email from orders",
    "detail_concat": """select event_id, concat_ws(chr(10), case when event_type <> 'view' then 'Params: ' || event_type end, case when event_id % 3 = 0 then 'Data: ' || user_id end, 'JSON: ' || props) as detail from events""",
    "title_code": "select c_custkey, case when c_custkey % 3 = 0 then 1 else 2 end::bigint as code from customer",
    "optional_flags": "select c_custkey, concat_ws(',', case when c_acctbal > 0 then 'newsletter' end, case when c_custkey % 2 = 0 then 'offers' end) as actions from customer",
    "bit_flags": "select p_partkey, ((p_size > 10)::bigint + 2 * (p_size > 25)::bigint + 4 * (p_size > 40)::bigint)::bigint as bits, p_size > 25 as can_write from part",
    "state_transition": "select c_custkey, case c_custkey % 4 when 0 then 'green' when 1 then 'yellow' when 2 then 'red' end as next_light from customer",
    "invoice_text": "select o_orderkey, 'Hi ' || c_name || ', Your total purchase amount is ' || floor(o_totalprice)::bigint || '. Thank you' as invoice from orders join customer on o_custkey = c_custkey",
    "metric_exports": f"""{_LAST}, r as (select count(*) as runs, sum(n - 1) as retries from (select count(*) as n from a group by history_id)),
      g as (select unnest([{", ".join(f"{{'g': 'status', 'n': '{s}', 'v': (select count(*) from l where status = '{s}')}}" for s in _STATUSES)},
        {{'g': 'time', 'n': 'duration', 'v': (select max(start + duration) - min(start) from l)}}, {{'g': 'time', 'n': 'min_duration', 'v': (select min(duration) from l)}},
        {{'g': 'time', 'n': 'max_duration', 'v': (select max(duration) from l)}}, {{'g': 'time', 'n': 'sum_duration', 'v': (select sum(duration)::bigint from l)}},
        {{'g': 'time', 'n': 'start', 'v': (select min(start) from l)}}, {{'g': 'time', 'n': 'stop', 'v': (select max(start + duration) from l)}},
        {{'g': 'retries', 'n': 'retries', 'v': (select retries::bigint from r)}}, {{'g': 'retries', 'n': 'run', 'v': (select runs from r)}}]) as x)
      select 'launch_' || x.g || '_' || x.n as name, x.v::bigint as value, 'launch_' || x.g || '_' || x.n || ' ' || x.v as line,
        'launch_' || x.g || ' ' || x.n || '=' || x.v || ' 1700000000000000000' as protocol from g""",
    "body_any_json": """select event_id, case event_id % 4 when 0 then 'no json: ' || event_type when 1 then '[{"k":' || (props->>'k') || '},1]'
      when 2 then event_id::varchar else '{"k":' || (props->>'k') || '}' end as body from events""",
    "files_results": f"""{_LAST} select epic, status, count(*)::bigint as tests, sum(duration)::bigint as "time" from l group by 1, 2""",
    "files_sections": """select r_name as section, row_number() over (partition by r_name order by n_nationkey) - 1 as position, n_nationkey::varchar as key, n_name as name
      from nation join region on n_regionkey = r_regionkey where r_name in ('ASIA', 'EUROPE')""",
    "files_attachments": """with b as (select *, '{"k":' || (props->>'k') || '}' as body from events)
      select event_id, 'GET: ' || event_type || case when event_id % 2 = 0 then chr(10) || 'Params: ' || user_id else '' end as request, body, left(body, 500) || '...' as summary,
        '{"code":"' || case event_type when 'error' then 404 when 'click' then 200 else 201 end || '"}' as headers from b""",
    "files_failed_days": f"""with {_A} select strftime(make_timestamp(start), '%Y-%m-%d') as dt, count(*)::bigint as failed, min(attempt) as "first", max(attempt) as "last" from a where status = 'failed' group by 1""",
    "files_quoted": """select c_custkey, c_name || chr(10) || 'says "hi", ' || c_custkey || '"' as text from customer""",
    "files_workbook": f"""{_SUM} select 'messages' as sheet, 2::bigint as n union all select 'tasks', (select count(*) from t where sprint = 1997)
      union all select 'summary', (select count(*) + 1 from s) union all select 'dashboard', 1""",
    "task_generated": """with d as (select i as task, ('0x' || md5('7-0-' || i)[1:8])::bigint / 4294967296.0 as o, ('0x' || md5('7-1-' || i)[1:8])::bigint / 4294967296.0 as p,
        ('0x' || md5('7-2-' || i)[1:8])::bigint / 4294967296.0 as s, ('0x' || md5('7-3-' || i)[1:8])::bigint / 4294967296.0 as q from (select o_orderkey as i from orders))
      select task, ['Ann', 'Bo', 'Cy'][floor(o * 3)::int + 1] as owner, case when p < 0.3 then 'High' when p < 0.75 then 'Medium' else 'Low' end as priority,
        case when s < 0.3 then 'Done' when s < 0.6 then 'In-Progress' when s < 0.8 then 'Pending' else 'To-Do' end as status, round(0.1 + 0.8 * q, 2) as share from d""",
    "files_steps": f"""{_STEPS} select uuid, path, depth::bigint as depth, name, status, start, stop, n_steps::bigint as n_steps from steps""",
    "files_step_stats": f"""{_STEPS}, bad as (select uuid, path, depth from steps where status in ('failed', 'broken')
        qualify row_number() over (partition by uuid order by depth desc, list_transform(string_split(path, '.'), lambda x: x::int)) = 1)
      select s.uuid, count(*)::bigint as steps, (count(*) filter (where n_steps = 0))::bigint as leaves, max(s.depth)::bigint as deepest,
      (count(*) filter (where status in ('failed', 'broken')))::bigint as failed, any_value(bad.path) as failed_at
      from steps s left join bad using (uuid) group by s.uuid""",
    "line_middle": f"{_PRICED} select * exclude (position) from p where position = (select count(*) // 2 from lineitem)",
    "line_far_lenient": f"{_PRICED} select * exclude (position) from p where position in (12345, 1000000000000)",
    "line_page": f"{_PRICED} select p.* from p, (select count(*) // 2 as half from lineitem) where position >= half - 50 and position < half + 50",
    "order_positions": "select o_orderkey, o_totalprice, row_number() over (order by o_totalprice desc, o_orderkey)::bigint - 1 as position from orders",
    "history_trend": f"""{_TESTS}, b as (select 3::bigint as version, * from h union all select 1::bigint, * from h where attempt % 3 = 2),
      l as (select *, count(*) over w as n, count(distinct status) over (partition by version, run, history_id) as kinds from b window w as (partition by version, run, history_id)
        qualify row_number() over (partition by version, run, history_id order by start desc, attempt desc) = 1),
      t as (select version, run, {_COUNTS}, sum(n - 1)::bigint as retries, (count(*) filter (where kinds > 1))::bigint as changed, min(duration) as shortest, max(duration) as longest,
        sum(duration)::bigint as time, (max(start + duration) - min(start))::bigint as wall from l group by version, run)
      select *, lag(passed) over w as passed_before, lag(failed) over w as failed_before, lag(total) over w as total_before from t window w as (partition by version order by run)""",
    "history_changes": f"""{_TESTS}, l as (select * from h qualify row_number() over (partition by run, history_id order by start desc, attempt desc) = 1),
      c as (select run, history_id, status, lag(status) over w as before, lag(run) over w as last_run from l window w as (partition by history_id order by run))
      select run, history_id, status, before, case when last_run is null then 'new' when status = 'failed' then 'broke' else 'mended' end as change
      from c where last_run is null or status <> before""",
    "ext_asof": """with e as (select user_id, event_id, epoch_us(ts) as micros, event_type from events),
      r as (select user_id, micros, max(event_id) as error_id from e where event_type = 'error' group by 1, 2)
      select e.user_id, e.event_id, e.micros, case when e.micros - r.micros <= 86400000000 then r.micros end as error_at, case when e.micros - r.micros <= 86400000000 then error_id end as error_id
      from e asof left join r on e.user_id = r.user_id and e.micros > r.micros""",
    "ext_running": f"""select l_returnflag, l_orderkey, l_linenumber, l_partkey, count(*) over w as n, (sum(l_quantity::bigint) over w)::bigint as total
      from lineitem window w as (partition by l_returnflag order by l_orderkey, {_LINES} rows unbounded preceding)""",
    "ext_moving": f"""select l_returnflag, l_orderkey, l_linenumber, l_partkey, (sum(l_quantity::bigint) over w)::bigint as total
      from lineitem window w as (partition by l_returnflag order by l_orderkey, {_LINES} rows 99 preceding)""",
    "body_indented": r"""with b as (select event_id, props->>'k' as k from events)
      select event_id, case when event_id % 5 = 0 then '{"z": {"k": ' || k || '}, "a": [1.50, "é", {}], "e": {"y": null, "b": []}, "n": ' || event_id || '},'
        when event_id % 7 = 0 then null
        else array_to_string(['{', '  "z": {', '    "k": ' || k, '  },', '  "a": [', '    1.5,', '    "\u00e9",', '    {}', '  ],', '  "e": {', '    "y": null,', '    "b": []', '  },', '  "n": ' || event_id, '}'], chr(10)) end as body from b""",
    "ext_overlap": """with l as (select l_quantity::bigint as q, date_diff('day', date '1990-01-01', l_shipdate::date) as b from lineitem),
      s as (select s_suppkey, s_suppkey * 37 % 3000 as b, s_suppkey * 37 % 3000 + (1 << (s_suppkey % 9)::int) - 1 as e from supplier)
      select s_suppkey, count(*)::bigint as lines, sum(q)::bigint as pieces, min(l.b)::bigint as "first", max(l.b + q)::bigint as "last" from s join l on l.b <= s.e and s.b <= l.b + q group by 1""",
    "ext_sketches": "select user_id % 5 as \"group\", count(*)::bigint as n, true as distinct_near, true as quantiles_near from events group by 1",
    "ext_sessions": """with e as (select user_id, epoch_us(ts) as t, max(epoch_us(ts)) over () as last from events),
      g as (select *, case when t - lag(t) over (partition by user_id order by t) < 43200000000 then 0 else 1 end as fresh from e),
      n as (select *, sum(fresh) over (partition by user_id order by t rows unbounded preceding) as k from g)
      select user_id, min(t) as begin, max(t) + 43200000000 as "end", count(*)::bigint as n from n group by user_id, k, last having max(t) + 43200000000 <= last - 2::bigint * 86400000000""",
}
