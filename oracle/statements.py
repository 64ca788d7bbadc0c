"""One SQL statement per catalogued query, formatted like the engine's result."""

from __future__ import annotations

import re

from pitbars.operators import rules

from .ctes import CTES, NY, _path, _swing, _wall, bracket, compose, slip_fill



def fmt(spec: str) -> str:
    cols = []
    for word in spec.split():
        kind, _, name = word.rpartition(":")
        c = f'"{name}"'
        if kind == "t":
            c = f"strftime({c}, '%Y-%m-%d %H:%M:%S')"
        elif kind == "f":
            c = f"round(({c})::double, 6) + 0"
        elif kind == "i":
            c = f"({c})::bigint"
        elif kind == "b":
            c = f"({c})::boolean"
        cols.append(f'{c} as "{name}"')
    return ", ".join(cols)


def ruled(rules: list, tables: dict[str, str]) -> str:
    """One count a rule, each by a query of its own. ``tables`` names the SQL source of each table of a rule set."""

    def local(e: str) -> str:
        for a, b in ((" <=> ", " is not distinct from "), ("unix_micros(", "epoch_us("), ("60000000L", "60000000::bigint"), ("double('infinity')", "'infinity'::double"), ("timestamp)", '"timestamp")')):
            e = e.replace(a, b)
        return e

    out = []
    for r in rules:
        kind = type(r).__name__
        if kind == "Row":
            out.append(f"select '{r.name}' as invariant, count(*) as failure_count from {tables[r.table]} where {local(r.bad)}")
        elif kind == "Unique":
            out.append(f"select '{r.name}', coalesce(sum(n), 0) from (select count(*) as n from {tables[r.table]} group by {', '.join(r.keys)}) where n > 1")
        elif kind == "Subset":
            k = ", ".join(r.keys)
            out.append(f"select '{r.name}', count(*) from (select distinct {k} from {tables[r.child]}) anti join (select distinct {k} from {tables[r.parent]}) using ({k})")
        elif kind == "Count":
            out.append(f"select '{r.name}', abs((select count(*) from {tables[r.left]}) - {r.times} * (select count(*) from {tables[r.right]}))")
        elif kind == "Schema":
            out.append(f"select '{r.name}', 0")
        else:
            k, v = ", ".join(r.keys), list(r.values.items())
            side = lambda t, n: f"(select {k}, 1 as here{n}, " + ", ".join(f"({local(e[n])}) as x{n}_{i}" for i, (_, e) in enumerate(v)) + f" from {tables[t]})"  # noqa: B023, E731
            both = f"{side(r.left, 0)} full join {side(r.right, 1)} using ({k})"
            out.append(f"select '{r.name}_membership', count(*) from {both} where here0 is null or here1 is null")
            for i, (name, _) in enumerate(v):
                same = f"abs(x0_{i} - x1_{i}) <= 1e-12" if name in r.close else f"x0_{i} = x1_{i}"
                out.append(f"select '{name}', count(*) from {both} where not coalesce({same}, false)")
    return "select * from (values ('', 0::bigint)) r(invariant, failure_count) where invariant <> '' union all " + " union all ".join(out)


def scoped(source: str, scopes: dict[str, str]) -> str:
    cells = ["{'scope': 'overall', 'value': 'all'}"]
    cells += [f"{{'scope': '{k}', 'value': {v}::varchar}}" for k, v in scopes.items()]
    return f"(select * exclude (_s), _s.scope as scope, _s.value as \"value\" from (select *, unnest([{', '.join(cells)}]) as _s from {source}) where _s.value is not null)"


def draw(*parts: str) -> str:
    """60 bits of the md5 of the parts."""
    return token(" || ':' || ".join(f"({p})::varchar" for p in parts))


def token(c: str) -> str:
    return f"('0x' || substr(md5({c}), 1, 15))::bigint"


TRADE = """count(*) as trade_count, sum(case when win then 1 else 0 end) as win_count, sum(net_r) as total_net_r, avg(net_r) as mean_trade_net_r,
  median(net_r) as median_trade_net_r, avg(win::int) as win_rate,
  coalesce(sum(net_r) filter (net_r > 0), 0) / nullif(abs(coalesce(sum(net_r) filter (net_r < 0), 0)), 0) as profit_factor"""

METRICS = f"""
  select m.*, o.n as opportunity_count, trade_count / o.n as participation_rate, total_net_r / o.n as mean_opportunity_net_r from (
    select period, scope, "value", {TRADE} from {scoped("trade", {"session": "session", "direction": "direction", "exit_reason": "exit_reason"})} group by all) m
  join (select period, null as session, count(*) as n from cal group by period union all select period, session, count(*) from cal group by all) o
    on o.period = m.period and o.session is not distinct from case when m.scope = 'session' then m."value" end"""


def bootstrap(rows: str, keys: str, value: str, resamples: int = 10000) -> str:
    pos = draw("20260901", "rep", "slot")
    return f"""
  with src as (select {keys} as k, session_date, {value} as v from {rows}),
  daily as (select k, session_date, sum(v) as s, count(*) as c from src group by all),
  num as (select *, row_number() over (partition by k order by {token("session_date")}, session_date) - 1 as i, count(*) over (partition by k) as n from daily),
  picks as (select k, rep, {pos} % n as pos from (select k, i as slot, n, unnest(range({resamples})) as rep from num)),
  est as (select p.k, rep, sum(s) / sum(c) as e from picks p join num q on q.k = p.k and q.i = p.pos group by all)
  select {{0}}, row_count, cluster_count, estimate, ci_lower, ci_upper from
    (select k, avg(v) as estimate, count(*) as row_count, count(distinct session_date) as cluster_count from src group by k)
    join (select k, quantile_cont(e, 0.025::double) as ci_lower, quantile_cont(e, 0.975::double) as ci_upper from est group by k) using (k)"""


def jac(a: str, b: str, on: str) -> str:
    return f"""
  select symbol, timeframe, sum(l) as primary_count, sum(r) as comparison_count, sum(l * r) as intersection_count,
    sum(l * r) / (sum(l) + sum(r) - sum(l * r)) as jaccard_agreement
  from (select symbol, timeframe, {on}, max(l) as l, max(r) as r from (
    select symbol, timeframe, {on}, 1 as l, 0 as r from {a} union all select symbol, timeframe, {on}, 0, 1 from {b}) group by all)
  group by symbol, timeframe"""


def grid(primary: str, variants: dict[str, str], on: str) -> str:
    names = ", ".join(f"'{v}'" for v in variants)
    rows = " ".join(f"union all select '{v}', {on}, 0, 1 from {t}" for v, t in variants.items())
    return f"""select variant, sum(l) as primary_count, sum(r) as comparison_count, sum(l * r) as intersection_count,
    sum(l * r) / (sum(l) + sum(r) - sum(l * r)) as jaccard_agreement from (select variant, {on}, max(l) as l, max(r) as r from (
      select unnest([{names}]) as variant, {on}, 1 as l, 0 as r from {primary} {rows}) group by all) group by variant"""


ATR_AT = """lateral (select x.atr from b x where x.symbol = c.symbol and x.timeframe = '1H' and x.available_at <= c.session_open_at
    order by x.available_at desc limit 1) a on true"""
PAIR_AT = """lateral (select case when last_c > prev_c then 'long' when last_c < prev_c then 'short' end as pair_direction from (
      select mid_close as last_c, lag(mid_close) over (order by bar_idx) as prev_c, bar_idx from b x
      where x.symbol = c.symbol and x.timeframe = '4H' and x.available_at <= c.session_open_at) order by bar_idx desc limit 1) q on true"""

EXTRA = {
    # greedy clustering, one swing per step; the state is the list of zones so far
    "touch": """
  select symbol, timeframe, case when kind = 'high' then 'resistance' else 'support' end as role, confirmation_index as conf, price, atr * 2e-1 as tol,
    event_id as swing_id, event_at, available_at, row_number() over (partition by symbol, timeframe, kind order by confirmation_index) as step
  from sw where atr > 0""",
    "greedy": """
  select symbol, timeframe, role, 0::bigint as step, []::struct(id bigint, c double, lo double, hi double, hw double, n bigint, last bigint)[] as zones, 0::bigint as cur
  from (select distinct symbol, timeframe, role from touch)
  union all
  select symbol, timeframe, role, step2,
    case when best is null then list_append(zones, {'id': conf, 'c': price, 'lo': price - tol, 'hi': price + tol, 'hw': tol, 'n': 1::bigint, 'last': conf})
         else list_transform(zones, lambda z: case when z.id = best.id then {'id': z.id, 'c': (z.c * z.n + price) / (z.n + 1),
           'lo': least(z.lo, price - tol), 'hi': greatest(z.hi, price + tol),
           'hw': greatest((z.c * z.n + price) / (z.n + 1) - least(z.lo, price - tol), greatest(z.hi, price + tol) - (z.c * z.n + price) / (z.n + 1)),
           'n': z.n + 1, 'last': conf} else z end) end,
    coalesce(best.id, conf)
  from (
    select g.*, t.step as step2, t.conf, t.price, t.tol,
      list_aggregate(list_transform(list_filter(g.zones, lambda z: t.conf - z.last <= 500 and abs(t.price - z.c) <= greatest(t.tol, z.hw)),
        lambda z: {'d': abs(t.price - z.c), 'id': z.id}), 'min') as best
    from greedy g join touch t on t.symbol = g.symbol and t.timeframe = g.timeframe and t.role = g.role and t.step = g.step + 1
  )""",
    "snap": """
  select t.symbol, t.timeframe, t.role, t.conf, t.swing_id, t.event_at, t.available_at, g.cur, z.c as center, z.lo as lower_bound, z.hi as upper_bound, z.hw as half_width,
    z.n as touch_count, z.n >= 2 as active,
    'zone:' || t.timeframe || ':' || t.role || ':' || lpad((dense_rank() over (partition by t.symbol, t.timeframe order by g.cur, t.role))::varchar, 6, '0') as zone_id
  from greedy g join touch t on t.symbol = g.symbol and t.timeframe = g.timeframe and t.role = g.role and t.step = g.step,
    lateral (select unnest(list_filter(g.zones, lambda y: y.id = g.cur)) as z) u""",
    "zsig": """
  with bars1 as (
    select *, lag(mid_close) over w as pc, lag(available_at) over w as pa from b where timeframe = '1H' window w as (partition by symbol order by bar_idx)
  ), inwin as (
    select c.opportunity_id, c.symbol, x."timestamp" as ts, x.available_at, x.bar_id, x.atr, x.pc, x.mid_close, x.mid_high, x.mid_low,
      (select max(h.bar_idx) from b h where h.symbol = c.symbol and h.timeframe = '4H' and h.available_at <= x."timestamp") as hidx
    from cal c join bars1 x on x.symbol = c.symbol and x."timestamp" >= c.session_open_at and x.available_at < c.cutoff_at
    where x.pa = x."timestamp" and x.atr > 0
  ), met as (
    select w.*, z.zone_id, z.role, z.lower_bound, z.upper_bound, z.center, z.available_at as known, z.conf
    from inwin w join snap z on z.symbol = w.symbol and z.timeframe = '4H' and z.active and z.available_at <= w.ts and w.hidx - z.conf between 0 and 500
    qualify row_number() over (partition by w.opportunity_id, w.bar_id, z.zone_id order by z.conf desc) = 1
  ), ev as (
    select *, abs(pc - center) / atr as dist, unnest([
      case when role = 'resistance' and pc <= upper_bound + 5e-2 * atr and mid_close > upper_bound + 5e-2 * atr then {'o': 0, 'd': 'long', 'e': 'resistance_breakout'} end,
      case when role = 'resistance' and pc < lower_bound and mid_low <= upper_bound and mid_high >= lower_bound and mid_close < lower_bound then {'o': 1, 'd': 'short', 'e': 'resistance_rejection'} end,
      case when role = 'support' and pc >= lower_bound - 5e-2 * atr and mid_close < lower_bound - 5e-2 * atr then {'o': 0, 'd': 'short', 'e': 'support_breakout'} end,
      case when role = 'support' and pc > upper_bound and mid_low <= upper_bound and mid_high >= lower_bound and mid_close > upper_bound then {'o': 1, 'd': 'long', 'e': 'support_rejection'} end]) as x
    from met)
  select opportunity_id, ts as setup_bar_at, available_at as decision_at, x.d as direction, x.e as event_type, zone_id, role as zone_role,
    lower_bound as zone_lower_bound, upper_bound as zone_upper_bound, atr, known as feature_available_at
  from ev where x is not null
  qualify row_number() over (partition by opportunity_id order by ts, bar_id, dist, x.o, zone_id) = 1""",
    "obanch": """
  select *, ci is not null as candidate_found,
    case when ci is null then 'no_opposing_candle' when row_number() over (partition by symbol, timeframe, direction, ci order by bar_idx, event_seq) > 1
      then 'duplicate_candidate' else 'created' end as status
  from (select a.*, (select max(x.bar_idx) from b x where x.symbol = a.symbol and x.timeframe = a.timeframe and x.structure_eligible
        and x.bar_idx between a.bar_idx - 6 and a.bar_idx - 1
        and case when a.direction = 'up' then x.mid_close < x.mid_open else x.mid_close > x.mid_open end) as ci
    from brk a where timeframe in ('1H', '4H') and event_type in ('bos', 'choch') and displacement_qualified)""",
    # protected bracket: hard exit, trigger, and the path after the trigger
    "ppath": """
  select *, sgn * (p_entry - structural_stop_price) as risk, p_entry + sgn * atr as tgt, p_entry + sgn * (5e-1 * atr) as trig from mpath""",
    "pcode": """
  select *, case when sgn * (q_open - structural_stop_price) <= 0 then 1 when sgn * (q_open - tgt) >= 0 then 2
      when sgn * (q_adv - structural_stop_price) <= 0 then 3 when sgn * (q_fav - tgt) >= 0 then 4 end as hard,
    case when sgn * (q_open - p_entry) <= 0 then 5 when sgn * (q_open - tgt) >= 0 then 2
      when sgn * (q_adv - p_entry) <= 0 then 6 when sgn * (q_fav - tgt) >= 0 then 4 end as safe
  from ppath where risk > 0""",
    "pstep": """
  select *, case when h is null or g0 < h then g0 end as g from (
    select *, min(case when hard is not null then bar_at end) over (partition by signal_id) as h,
      min(case when sgn * (q_fav - trig) >= 0 then bar_at end) over (partition by signal_id) as g0 from pcode)""",
    "pv": """
  select *, case when v = 'break_even_after_trigger' and bar_at > g then safe else hard end as code, v = 'break_even_after_trigger' as moved
  from pstep, (values ('static_bracket'), ('break_even_after_trigger')) m(v)""",
    "prot": f"""
  select *, {slip_fill()} from (
  select *, case when hit is null then q_last when hit in (1, 5) then hit_open when hit in (2, 4) then tgt when hit = 3 then stop else entry_reference_price end as raw_exit_price,
    case when hit is null then least(last_at + interval 30 minute, cutoff_at) else least(hit_at + interval 30 minute, cutoff_at) end as exit_at,
    case hit when 1 then 'hard_stop_gap' when 2 then 'target_gap' when 3 then 'hard_stop' when 4 then 'target' when 5 then 'protected_stop_gap'
      when 6 then 'protected_stop' else 'time' end as exit_reason,
    case when moved and g is not null then least(g + interval 30 minute, cutoff_at) end as trigger_observed_at, case when moved then nxt end as protection_active_from
  from (
    select signal_id, v as variant_id, any_value(moved) as moved, any_value(sgn) as sgn, any_value(cutoff_at) as cutoff_at, any_value(g) as g, any_value(tgt) as tgt,
      any_value(structural_stop_price) as stop, any_value(risk) as risk_price, any_value(p_entry_at) as entry_at, any_value(p_entry) as entry_reference_price,
      min(case when code is not null then bar_at end) as hit_at, arg_min(code, case when code is not null then bar_at end) as hit,
      arg_min(q_open, case when code is not null then bar_at end) as hit_open, max(bar_at) as last_at, arg_max(q_close, bar_at) as q_last,
      min(case when bar_at > g then bar_at end) as nxt
    from pv group by signal_id, v))""",
    # entry funnel, stage by stage, each as "first bar where"
    "plan": """
  select m.*, entry_reference_price + sg * (2e0 * m.atr) as tgt, q.fvg_id as gid, q.available_at as gat, q.lower_bound as glo, q.upper_bound as ghi
  from (select * from mapped) m left join lateral (select * from cgap x where x.symbol = m.symbol and x.direction = m.direction
    and x.available_at >= m.decision_at and x.available_at < m.cutoff_at order by x.available_at, x.fvg_id limit 1) q on m.mapping_status = 'valid'""",
    "c_scan": """
  select signal_id, x."timestamp" as bt, case when case when direction = 'long' then bid_low <= structural_stop_price else ask_high >= structural_stop_price end then 1
      when case when direction = 'long' then bid_high >= tgt else ask_low <= tgt end then 2 end as res,
    case when direction = 'long' then ask_low <= ghi else bid_high >= glo end as mit
  from plan p join base x on x.symbol = p.symbol and x."timestamp" >= gat and x."timestamp" < cutoff_at""",
    "f_scan": """
  select signal_id, x."timestamp" as bt, case when case when direction = 'long' then bid_low <= structural_stop_price else ask_high >= structural_stop_price end then 1
      when case when direction = 'long' then bid_high >= tgt else ask_low <= tgt end then 2 end as res,
    case when direction = 'long' then ask_low <= ghi else bid_high >= glo end as mit
  from plan p join fine x on x.symbol = p.symbol and x."timestamp" >= gat and x."timestamp" < cutoff_at""",
    "c_end": "select * from c_scan where res is not null or mit qualify row_number() over (partition by signal_id order by bt) = 1",
    "f_end": "select * from f_scan where res is not null or mit qualify row_number() over (partition by signal_id order by bt) = 1",
    "e1": """
  select *, case when mapping_status <> 'valid' then 'invalid_parent_mapping' when gid is null then 'no_directional_m5_fvg' when res = 1 then 'stop_before_entry'
      when res = 2 then 'target_before_entry' when bt is null then 'no_m5_mitigation_before_cutoff' when e_at is null then 'no_m5_entry_before_cutoff'
      when not (sg * (e_px - structural_stop_price) > 0 and sg * (tgt - e_px) > 0) then 'entry_outside_stop_target' else 'entry' end as coverage_status
  from (select p.*, e.bt, e.res, n."timestamp" as e_at, case when p.direction = 'long' then n.ask_open else n.bid_open end as e_px, e.bt + interval 30 minute as dec
    from plan p left join c_end e on e.signal_id = p.signal_id
    left join lateral (select * from base x where x.symbol = p.symbol and x."timestamp" >= e.bt + interval 30 minute and x."timestamp" < p.cutoff_at order by x."timestamp" limit 1) n
      on e.res is null)""",
    "nest": """
  select p.*, e.bt, e.res, f.fvg_id as fid, f.available_at as fat
  from plan p left join f_end e on e.signal_id = p.signal_id
  left join lateral (select * from fgap x where x.symbol = p.symbol and x.direction = p.direction and x.first_bar_at >= e.bt + interval 10 minute and x.available_at < p.cutoff_at
    and greatest(x.lower_bound, p.glo) < least(x.upper_bound, p.ghi) order by x.available_at, x.fvg_id limit 1) f on e.res is null""",
    "e2": """
  select *, case when mapping_status <> 'valid' then 'invalid_parent_mapping' when gid is null then 'no_directional_m5_fvg' when res = 1 then 'stop_before_entry'
      when res = 2 then 'target_before_entry' when bt is null then 'no_m1_mitigation_before_cutoff' when fid is null then 'no_nested_m1_fvg_before_cutoff'
      when again = 1 then 'stop_before_entry' when again = 2 then 'target_before_entry' when e_at is null then 'no_m1_entry_before_cutoff'
      when e_res = 1 then 'stop_before_entry' when e_res = 2 then 'target_before_entry'
      when not (sg * (e_px - structural_stop_price) > 0 and sg * (tgt - e_px) > 0) then 'entry_outside_stop_target' else 'entry' end as coverage_status
  from (select p.*, r.res as again, n.bt as e_at, n.px as e_px, n.res as e_res
    from nest p
    left join lateral (select res from f_scan s where s.signal_id = p.signal_id and s.bt >= p.bt + interval 10 minute and s.bt < p.fat and s.res is not null order by s.bt limit 1) r on true
    left join lateral (select x."timestamp" as bt, case when p.direction = 'long' then x.ask_open else x.bid_open end as px,
        (select s.res from f_scan s where s.signal_id = p.signal_id and s.bt = x."timestamp") as res
      from fine x where x.symbol = p.symbol and x."timestamp" >= p.fat and x."timestamp" < p.cutoff_at order by x."timestamp" limit 1) n on true)""",
    "fun": """
  select 'e0_immediate' as model_id, signal_id, case when mapping_status = 'valid' then 'entry' else 'invalid_parent_mapping' end as coverage_status,
    null::varchar as coarse_gap_id, null::timestamp as coarse_gap_available_at, null::timestamp as mitigation_bar_at, null::varchar as fine_gap_id,
    null::timestamp as fine_gap_available_at, case when mapping_status = 'valid' then decision_at end as entry_decision_at,
    case when mapping_status = 'valid' then found_entry_at end as entry_at from mapped
  union all
  select 'e1_coarse_gap', signal_id, coverage_status, gid, gat, case when res is null then bt end, null, null,
    case when coverage_status = 'entry' then dec end, case when coverage_status = 'entry' then e_at end from e1
  union all
  select 'e2_nested_fine_gap', signal_id, coverage_status, gid, gat, case when res is null then bt end, fid, fat,
    case when coverage_status = 'entry' then fat end, case when coverage_status = 'entry' then e_at end from e2""",
    "dentry": """
  select f.model_id, f.entry_at as planned, p.symbol, p.direction, p.signal_id as parent_id, p.cutoff_at, p.structural_stop_price, p.tgt, p.sg, p.opportunity_id, p.session,
    p.session_date, p.period, f.model_id || '|' || p.signal_id as signal_id from fun f join plan p on p.signal_id = f.signal_id
  where f.coverage_status = 'entry' and f.model_id <> 'e0_immediate'""",
    "allbars": """
  select *, 'e1_coarse_gap' as mdl, 30 as mins from base union all select *, 'e2_nested_fine_gap', 10 from fine""",
    "dpath": """
  select s.*, x.mins, x."timestamp" as bar_at, s.sg as sgn, case when direction = 'long' then bid_open else ask_open end as q_open,
    case when direction = 'long' then bid_high else ask_low end as q_fav, case when direction = 'long' then bid_low else ask_high end as q_adv,
    case when direction = 'long' then bid_close else ask_close end as q_close, first_value(x."timestamp") over p as p_entry_at,
    first_value(case when direction = 'long' then ask_open else bid_open end) over p as p_entry
  from dentry s join allbars x on x.symbol = s.symbol and x.mdl = s.model_id and x."timestamp" >= s.planned and x."timestamp" < s.cutoff_at
  window p as (partition by s.signal_id order by x."timestamp")""",
    "delayed": f"""
  select *, {slip_fill()} from (
  select *, case when hit is null then q_last when hit = 1 then hit_open when hit in (2, 4) then target_price else stop_price end as raw_exit_price,
    case when hit is null then least(last_at + to_minutes(mins), cutoff_at) else hit_at + to_minutes(mins) end as exit_at,
    case hit when 1 then 'stop_gap' when 2 then 'target_gap' when 3 then 'stop' when 4 then 'target' else 'time' end as exit_reason
  from (
    select model_id, parent_id as signal_id, any_value(mins) as mins, any_value(cutoff_at) as cutoff_at, any_value(sgn) as sgn, any_value(p_entry_at) as entry_at,
      any_value(p_entry) as entry_reference_price, any_value(structural_stop_price) as stop_price, any_value(tgt) as target_price, any_value(risk_price) as risk_price,
      min(case when code is not null then bar_at end) as hit_at, arg_min(code, case when code is not null then bar_at end) as hit,
      arg_min(q_open, case when code is not null then bar_at end) as hit_open, max(bar_at) as last_at, arg_max(q_close, bar_at) as q_last
    from (select *, sgn * (p_entry - structural_stop_price) as risk_price, case when sgn * (q_open - structural_stop_price) <= 0 then 1 when sgn * (q_open - tgt) >= 0 then 2
        when sgn * (q_adv - structural_stop_price) <= 0 then 3 when sgn * (q_fav - tgt) >= 0 then 4 end as code from dpath
      where sgn * (p_entry - structural_stop_price) > 0 and sgn * (tgt - p_entry) > 0 and p_entry_at = planned)
    group by model_id, parent_id))""",
    "pan": """
  select c.*, m.model_id, t.net_r is not null as traded, coalesce(t.net_r, 0) as net_r
  from cal c, (values ('fit_long', 'long'), ('fit_short', 'short')) m(model_id, side)
  left join bothtrade t on t.opportunity_id = c.opportunity_id and t.direction = m.side""",
}


def _other_settings() -> dict[str, str]:
    """Breaks, zones and relations under other parameters, each from its whole definition again."""

    def renamed(text: str, names: list[str], tag: str) -> str:
        for n in names:
            text = re.sub(rf"(from|join) {n}\b", rf"\1 {n}{tag}", text)
        return text

    out = {}
    for tag, buffer in (("_b0", "0e0"), ("_b10", "1e-1")):
        out[f"walk{tag}"] = renamed(CTES["walk"].replace("5e-2", buffer), ["walk"], tag)
        out[f"brk{tag}"] = renamed(CTES["brk"], ["walk"], tag)
    for tag, tolerance in (("_t10", "1e-1"), ("_t30", "3e-1")):
        out[f"touch{tag}"] = EXTRA["touch"].replace("2e-1", tolerance)
        out[f"greedy{tag}"] = renamed(EXTRA["greedy"], ["greedy", "touch"], tag)
        out[f"snap{tag}"] = renamed(EXTRA["snap"], ["greedy", "touch"], tag)
    for tag, pips in (("_r5", "5e-3"), ("_r15", "1.5e-2")):
        out[f"sw{tag}"] = CTES["sw"].replace("1e-2", pips)
    return out


def _compared(concept: str, parameter: str, key: str, primary: tuple[str, str], others: dict[str, str]) -> str:
    sides = [f"select symbol, timeframe, {key} as k, 0 as no from {primary[1]}"]
    sides += [f"select symbol, timeframe, {key}, {i} from {t}" for i, t in enumerate(others.values(), 1)]
    names = ", ".join(f"({i}, '{v}')" for i, v in enumerate(others, 1))
    return f"""select '{concept}' as concept, symbol, timeframe, '{parameter}' as parameter, '{primary[0]}' as primary_value, v as comparison_value,
    count(*) filter (p) as primary_count, count(*) filter (list_contains(nos, no)) as comparison_count, count(*) filter (p and list_contains(nos, no)) as intersection_count,
    case when primary_count + comparison_count > 0 then intersection_count / (primary_count + comparison_count - intersection_count) else 1 end as jaccard_agreement
  from (select symbol, timeframe, k, list(no) as nos, list_contains(list(no), 0) as p from ({" union all ".join(sides)}) group by all), (values {names}) names(no, v) group by symbol, timeframe, v"""


def _in_zones(snapshots: str) -> str:
    # grouped, as DuckDB fails inside on a plain filter of these rows
    return f"(select symbol, timeframe, swing_id from {snapshots} group by all having max(touch_count) >= 2)"


SENSITIVITY = " union all ".join(
    [
        _compared("swing", "right_bars", "(event_at, kind)", ("2", "sw0"), {"1": "swr1", "3": "swr3"}),
        _compared("swing_relationship", "equality_tolerance_pips", "(event_at, kind, rel)", ("1.0", "sw"), {"0.5": "sw_r5", "1.5": "sw_r15"}),
        _compared("structure_break", "buffer_atr", "(event_at, direction, event_type)", ("0.05", "brk"), {"0.0": "brk_b0", "0.1": "brk_b10"}),
        _compared("fair_value_gap", "minimum_size_atr", "(event_at, direction)", ("0.1", "gap"), {"0.0": "gap0", "0.2": "gap20"}),
        _compared("support_resistance", "cluster_tolerance_atr", "swing_id", ("0.2", _in_zones("snap")), {"0.1": _in_zones("snap_t10"), "0.3": _in_zones("snap_t30")}),
        _compared("order_block_candidate", "candidate_lookback_bars", "(anchor_break_id, candidate_bar_id)", ("6", "ob"), {"3": "ob3", "9": "ob9"}),
        _compared("order_block_lifecycle", "maximum_age_bars", "(event_id, status)", ("50", "ob"), {"25": "ob25", "100": "ob100"}),
        """select 'order_block_geometry', symbol, timeframe, 'zone_geometry', 'full_wick_range', 'body_range', count(*), count(*), count(*), quantile_cont(iou, 0.5::double) from (
    select a.symbol, a.timeframe, greatest(least(a.upper_bound, c.upper_bound) - greatest(a.lower_bound, c.lower_bound), 0) / (greatest(a.upper_bound, c.upper_bound) - least(a.lower_bound, c.lower_bound)) as iou
    from ob a join obody c on c.symbol = a.symbol and c.timeframe = a.timeframe and c.event_id = a.event_id) group by all""",
    ]
)


def statements(specs: dict[str, str]) -> dict[str, str]:

    bits = draw("20260901", "grp", "tok")
    aligned = "(select * from cand where h1_context = case when direction = 'long' then 'bullish' else 'bearish' end)"
    right = {f"swr{r}": " union all ".join(_swing(k, r) for k in ("high", "low")) for r in (1, 3)}
    inner = {
        "tick_bars": "select * from base",
        "tick_bars_equal_times": "select * from obars",
        "rollup_anchored": "select * from b",
        "trading_week": f"select symbol, count(*) as kept, min(hour(\"timestamp\")) as first_hour, max(hour(\"timestamp\")) as last_hour from base where isodow({_wall('\"timestamp\"', NY)} + interval 7 hour) <= 5 group by symbol",
        "atr_eligible": "select * from b",
        "dedupe_ticks": "select symbol, count(*) as ticks, sum(bid) as bid_sum, sum(spread_pips) as spread_sum from ticks group by symbol",
        "dedupe_bars": "select symbol, \"timestamp\", mid_close, 2 as seq from base",
        "read_bars_range": "select * from base where \"timestamp\" >= '2024-01-08' and \"timestamp\" < '2024-01-22'",
        "write_bars_months": "select * from base",
        "read_tick_archive": "select distinct 'ALL' as symbol, date_trunc('millisecond', ts) as ts, bid, ask, (bid + ask) / 2 as mid, ((ask - bid) / 1e-2)::float as spread_pips from ticks",
        "sessions": "select * from cal",
        "sessions_full": "select opportunity_id, cutoff_at as observation_end_at, cutoff_at from cal",
        "session_events": "select * from sev",
        "opening_events": "select opportunity_id, event_id from evt e join cal c on c.symbol = e.symbol and e.event_at >= c.session_open_at and e.available_at <= c.observation_end_at where e.timeframe = '1H'",
        "local_hours": f"select 'p3' as model_id, year, session, strftime(case when session = 'london' then {_wall('decision_at', 'Europe/London')} else {_wall('decision_at', NY)} end, '%H:00') as decision_local_hour, count(*) as signal_count from first group by all",
        "asof_context": "select s.symbol, s.\"timestamp\", coalesce((select arg_max(x.state, x.available_at) from ctx x where x.symbol = s.symbol and x.timeframe = '4H' and x.available_at <= s.\"timestamp\"), 'undetermined') as state from base s",
        "asof_atr": f"select c.opportunity_id, a.atr from cal c left join {ATR_AT}",
        "momentum_pair": f"select c.opportunity_id, q.pair_direction from cal c left join {PAIR_AT}",
        "first_bar_after": "select e.symbol, e.event_id, e.available_at, n.\"timestamp\" as entry_at, n.mid_open as entry_mid from evt e left join lateral (select * from base x where x.symbol = e.symbol and x.\"timestamp\" >= e.available_at order by x.\"timestamp\" limit 1) n on true",
        "opposing_swing": "select * from map0",
        "source_event": "select 'candidate:' || opportunity_id || ':' || source_event_id as signal_id, true as source_event_match from cand",
        "swings": "select *, case when kind = 'high' then 'up' else 'down' end as direction, rel as structural_relationship from sw",
        "regime_breaks": "select * from brk",
        "regime_contexts": "select * from ctx",
        "gaps": "select * from gap",
        "gaps_simple": "select * from cgap",
        "gaps_simple_fine": "select * from fgap",
        "zone_touches": "select * from snap",
        "level_zones": """select symbol, timeframe, zone_id, role, arg_max(center, conf) as center, arg_max(lower_bound, conf) as lower_bound, arg_max(upper_bound, conf) as upper_bound,
      arg_max(half_width, conf) as half_width, max(touch_count) as touch_count, min(event_at) as created_at, min(available_at) filter (active) as active_at, max(event_at) as last_touch_at,
      (select max(x.bar_idx) from b x where x.symbol = s.symbol and x.timeframe = s.timeframe) - min(conf) as age_bars_at_sample_end,
      (select max(x.bar_idx) from b x where x.symbol = s.symbol and x.timeframe = s.timeframe) - max(conf) as bars_since_last_touch,
      case when (select max(x.bar_idx) from b x where x.symbol = s.symbol and x.timeframe = s.timeframe) - max(conf) > 500 then 'expired' else 'active_or_candidate' end as status_at_sample_end
    from snap s group by symbol, timeframe, zone_id, role""",
        "order_blocks": "select *, " + ", ".join(
            f"(select x.available_at from b x where x.symbol = o.symbol and x.timeframe = o.timeframe and x.bar_idx = o.anchor_index + o.{d}_delay) as {n}"
            for d, n in (("touch", "first_touch_at"), ("half", "midpoint_touch_at"), ("full", "full_mitigation_at"), ("invalid", "invalidation_at"))
        ) + " from ob o",
        "order_block_anchors": f"select symbol, timeframe, event_id as anchor_break_id, candidate_found, (select x.bar_id from b x where x.symbol = o.symbol and x.timeframe = o.timeframe and x.bar_idx = o.ci) as candidate_bar_id, status from obanch o",
        "sweeps": "select * from sweep",
        "sweep_stats": """select symbol, timeframe, sum(h) as high_excursions, sum(l) as low_excursions, sum(case when n > 1 then 1 else 0 end) as ambiguous_bars
    from (select symbol, timeframe, bar_idx, sum((kind = 'high')::int) as h, sum((kind = 'low')::int) as l, sum(inside::int) as n from hits group by all) group by all""",
        "displacement": "select * from disp",
        "events_union": "select * from evt",
        "event_features": "select *, open_mid as session_open_mid, close as event_bar_close_mid from feat",
        "hash_coin": "select symbol, seq as event_id, case when ('0x' || substr(sha256('20260901:' || seq), 2, 1))::int % 2 = 1 then 'long' else 'short' end as coin from ticks",
        "transitions": """select symbol, timeframe, p || ' -> ' || l as transition, count(*) as transition_count from (
      select symbol, timeframe, event_type || ':' || direction as l, lag(event_type || ':' || direction) over (partition by symbol, timeframe order by bar_idx, event_seq) as p
      from brk where event_type in ('bos', 'choch')) where p is not null group by all""",
        "structure_candidates": "select * from cand",
        "first_signal": "select * from first",
        "session_open_signals": "select * from opensig",
        "zone_signals": "select * from zsig",
        "aligned_candidates": "select * from cand where h1_context = case when direction = 'long' then 'bullish' else 'bearish' end",
        "confluent_candidates": "select c.* from cand c where displacement_qualified and exists (select 1 from gap g where g.symbol = c.symbol and g.bar_id = c.signal_bar_id and case when g.direction = 'up' then 'long' else 'short' end = c.direction)",
        "rule_filters": """select * from (select c.*, f.filter_id from (select *, (direction = 'long' and h1_context = 'bearish') or (direction = 'short' and h1_context = 'bullish') as o1,
        (direction = 'long' and h4_context = 'bearish') or (direction = 'short' and h4_context = 'bullish') as o4 from cand) c,
      (values ('f1_displacement', true, false, false), ('f2_h1_opposition_veto', false, true, false), ('f3_h4_opposition_veto', false, false, true),
        ('f4_h1_h4_opposition_veto', false, true, true), ('f5_displacement_h4_veto', true, false, true), ('f6_displacement_h1_h4_veto', true, true, true)) f(filter_id, d, v1, v4)
      where (not d or displacement_qualified) and (not v1 or not o1) and (not v4 or not o4))
    qualify row_number() over (partition by filter_id, opportunity_id order by decision_at, source_event_id) = 1""",
        "fit_direction": """select session, direction, m as construction_mean_net_r, direction = first_value(direction) over (partition by session order by m desc, direction) as selected
    from (select session, direction, avg(net_r) as m from bothtrade where period = 'construction' group by all)""",
        "fitted_signals": """select s.signal_id, s.opportunity_id, s.session, s.direction, 'fitted' as model_id from bothsig s join (select session, direction from
    (select session, direction, avg(net_r) as m from bothtrade where period = 'construction' group by all) qualify row_number() over (partition by session order by m desc, direction) = 1) f using (session, direction)""",
        "funnel_counts": """select session, count(*) as structure_candidates, sum((h1_context = w)::int) as h1_aligned_candidates, sum((h4_context = w)::int) as h4_aligned_candidates,
      sum((h1_context = w and h4_context = w)::int) as h1_h4_aligned_candidates, sum((h1_context = w and h4_context = w and displacement_qualified and conf)::int) as aligned_confluent_candidates
    from (select c.*, case when direction = 'long' then 'bullish' else 'bearish' end as w, exists (select 1 from gap g where g.symbol = c.symbol and g.bar_id = c.signal_bar_id
      and case when g.direction = 'up' then 'long' else 'short' end = c.direction) as conf from cand c) group by session""",
        "added_counts": """select session, coalesce(a, 0) as current_count, coalesce(p, 0) as parent_count, coalesce(a, 0) - coalesce(p, 0) as added_count
    from (select session, count(*) as a from cand group by session) full join (select session, count(*) as p from cal c join brk e on e.symbol = c.symbol and e.timeframe = '1H'
      and e.event_type in ('bos', 'choch') and e.event_at >= c.session_open_at and e.available_at <= c.observation_end_at group by session) using (session)""",
        "bracket": "select * from trade",
        "bracket_variants": "select * from fix2 union all select * from two_r",
        "cost_scenarios": f"""select cost_case, signal_id, variant_id, {slip_fill("slip")} from (select * exclude (net_pips, net_r, win, risk_pips) from (select * from fix2 union all select * from two_r)),
      (values ('primary', 1e-1), ('stress', 2e-1)) c(cost_case, slip)""",
        "protected_bracket": "select *, trigger_observed_at is not null as protection_triggered, protection_active_from is not null as protection_activated from prot",
        "struct_stop": "select *, found_entry_at as entry_at from mapped",
        "entry_funnel": "select * from fun",
        "entry_funnel_summary": "select model_id, coverage_status, count(*) as signal_count from fun group by all",
        "delayed_entry": "select * from delayed",
        "excursion": "select * from exc",
        "threshold_grid": "select *, st as stop_touch_bar_at, tg as target_touch_bar_at from seq",
        "forward_returns": "select * from fwd",
        "barriers": "select * from bar1",
        "panel": "select * from pan",
        "scope_metrics": METRICS,
        "drawdown": """select symbol, max(peak - eq) as maximum_drawdown_r from (select symbol, eq, greatest(0, max(eq) over (partition by symbol order by exit_at, signal_id rows unbounded preceding)) as peak
      from (select symbol, exit_at, signal_id, sum(net_r) over (partition by symbol order by exit_at, signal_id rows unbounded preceding) as eq from trade)) group by symbol""",
        "calendar_counts": """select e.event_type, m.month, (select count(*) from brk x where x.event_type = e.event_type and strftime(x.event_at, '%Y-%m') = m.month) as event_count
    from (select distinct event_type from brk) e, (select y || '-' || lpad(q::varchar, 2, '0') as month from (values (2024), (2025)) a(y), range(1, 13) r(q)) m""",
        "calendar_year_counts": """select e.event_type, y::varchar as "year", (select count(*) from brk x where x.event_type = e.event_type and year(x.event_at) = y) as event_count
    from (select distinct event_type from brk) e, (select unnest(range(min(year(event_at)), max(year(event_at)) + 1)) as y from brk)""",
        "monthly": "select session, session_date[:7] as month, count(*) as trade_count, avg(win::int) as win_rate, sum(net_r) as total_net_r, avg(net_r) as mean_trade_net_r from trade group by all",
        "best_month": "select symbol, max(t) filter (t > 0) / sum(t) filter (t > 0) as best_month_share from (select symbol, session_date[:7] as month, sum(net_r) as t from trade group by all) group by symbol",
        "exit_summary": "select session, exit_reason, count(*) as trade_count, sum(net_r) as total_net_r, avg(net_r) as mean_trade_net_r from trade group by all",
        "describe": "select symbol, timeframe, measure, count(v) as count, median(v) as median, quantile_cont(v, 0.05::double) as p05, quantile_cont(v, 0.95::double) as p95 from (select symbol, timeframe, unnest(['atr', 'body_atr', 'coverage_ratio']) as measure, unnest([atr, body_atr, coverage_ratio]) as v from b) group by all",
        "stop_distances": f"""select scope, "value", count(*) as signal_count, quantile_cont(structural_stop_atr, 0.25::double) as stop_atr_q25, median(structural_stop_atr) as stop_atr_median,
      quantile_cont(structural_stop_atr, 0.75::double) as stop_atr_q75, quantile_cont(structural_stop_atr, 0.9::double) as stop_atr_q90, max(structural_stop_atr) as stop_atr_max,
      median(theoretical_lots_at_fixed_risk) as theoretical_lots_median, min(theoretical_lots_at_fixed_risk) as theoretical_lots_minimum
    from {scoped("mapped", {"session": "session", "event_type": "event_type"})} group by all""",
        "excursion_summary": "select period, scope, \"value\", count(*) as signal_count, " + ", ".join(
            f"quantile_cont({c}, {p}::double) as {n}_atr_q{int(p * 100):02d}" for p in (0.25, 0.5, 0.75, 0.9) for n, c in (("mae", "max_adverse_excursion_atr"), ("mfe", "max_favorable_excursion_atr"))
        ) + ", avg((max_adverse_excursion_atr >= 1)::int) as mae_ge_1_0_atr_rate, avg((max_adverse_excursion_atr >= 125e-2)::int) as mae_ge_1_25_atr_rate, avg((max_favorable_excursion_atr >= 1)::int) as mfe_ge_1_0_atr_rate from "
        + scoped("exc", {"session": "session", "direction": "direction"}) + " group by all",
        "sequence_summary": f"""select *, strict_premature_stop_count / nullif(stop_first_count, 0) as strict_premature_stop_rate from (select period, scope, "value", stop_atr, target_mode, target_atr, count(*) as signal_count,
      sum((sequence in ('stop_without_later_target', 'stop_then_target_later', 'same_bar_ambiguous_stop_first'))::int) as stop_first_count,
      sum((sequence = 'stop_then_target_later')::int) as strict_premature_stop_count, sum(saved_original_premature::int) as saved_original_premature_count,
      sum((sequence = 'target_before_stop')::int) as target_before_stop_count, avg((sequence = 'target_before_stop')::int) as target_before_stop_rate,
      sum((sequence = 'neither_touched')::int) as neither_touched_count from {scoped("seq", {"session": "session", "direction": "direction"})} group by all)""",
        "outcome_summary": f"""select sample, scope, "value", primitive, rule, horizon_minutes, count(distinct symbol || event_id) as event_count, sum(emitted_prediction::int) as prediction_count,
      avg(emitted_prediction::int) as prediction_coverage, avg(signed_forward_return_atr) as mean_signed_return_atr, median(signed_forward_return_atr) as median_signed_return_atr,
      avg((signed_forward_return_atr > 0)::int) as positive_return_rate, avg(mfe_atr) as mean_mfe_atr, avg(mae_atr) as mean_mae_atr
    from {scoped("(select *, unnest(case when is_primary then ['all_events', 'primary'] else ['all_events'] end) as sample from fwd)", {
            "session": "session", "direction": "direction", "event_type": "primitive", "context_alignment": "context_alignment", "displacement_strength": "displacement_strength"})} group by all""",
        "barrier_summary": """select *, favorable_first_count + adverse_first_count as resolved_count, favorable_first_count / nullif(favorable_first_count + adverse_first_count, 0) as favorable_first_rate_resolved from (
      select sample, primitive, rule, count(*) as event_count, sum((barrier_sequence = 'favorable_first')::int) as favorable_first_count, sum((barrier_sequence = 'adverse_first')::int) as adverse_first_count,
        sum((barrier_sequence = 'same_bar_ambiguous')::int) as same_bar_ambiguous_count, sum((barrier_sequence = 'neither')::int) as neither_count
      from (select *, unnest(case when is_primary then ['all_events', 'primary'] else ['all_events'] end) as sample from bar1) group by all)""",
        "paired_difference": """select coalesce(l.opportunity_id, r.opportunity_id) as opportunity_id, case when r.net_r is null then 'baseline_only' when l.net_r is null then 'candidate_only' else 'both' end as membership,
      l.net_r as net_r_baseline, r.net_r as net_r_candidate, r.net_r - l.net_r as net_r_difference
    from (select * from bothtrade where direction = 'long') l full join (select * from bothtrade where direction = 'short') r on r.opportunity_id = l.opportunity_id""",
        "paired_baselines": """select primitive, baseline, count(*) as paired_count, avg(e) as event_mean_atr, avg(v) as baseline_mean_atr, avg(e - v) as mean_paired_increment_atr
    from (select a.primitive, a.event_id, a.signed_forward_return_atr as e, c.rule as baseline, c.signed_forward_return_atr as v from fwd a join fwd c on c.symbol = a.symbol and c.event_id = a.event_id and c.primitive = a.primitive and c.horizon_minutes = 60
      and c.rule in ('session_momentum', 'session_mean_reversion', 'four_bar_close_breakout') where a.is_primary and a.horizon_minutes = 60 and a.rule = 'event_direction')
    where e is not null and v is not null group by all""",
        "bootstrap_ci": bootstrap("pan", "model_id", "net_r").replace("{0}", "k as model_id"),
        "paired_bootstrap": bootstrap("(select session, session_date, opportunity_id, max(case when model_id = 'fit_short' then net_r end) - max(case when model_id = 'fit_long' then net_r end) as dif from pan group by all)", "session", "dif").replace("{0}", "k as session"),
        "sign_null": f"""
  with src as (select primitive, {token("symbol || ':' || event_id")} as tok, raw_forward_return_atr as v from fwd where is_primary and rule = 'event_direction' and horizon_minutes = 60),
  g as (select *, {bits} as bits from (select *, unnest(range(167)) as grp from src)),
  d as (select primitive, grp * 60 + b as rep, v, (bits >> b) & 1 as coin from g, range(60) r(b) where grp * 60 + b < 10000),
  est as (select primitive, rep, avg(case when coin = 1 then v else -v end) as e from d group by all)
  select primitive, n as event_count, null_mean, null_p025, null_p975 from (select primitive, count(*) as n from src group by all)
    join (select primitive, avg(e) as null_mean, quantile_cont(e, 0.025::double) as null_p025, quantile_cont(e, 0.975::double) as null_p975 from est group by all) using (primitive)""",
        "set_fingerprint": f"select timeframe, count(*) as member_count, sum(t >> 30) % 2305843009213693951 as token_high, sum(t % 1073741824) % 2305843009213693951 as token_low from (select timeframe, {token("symbol || ':' || bar_id")} as t from b) group by all",
        "check_bars": "select symbol, count(*) as bar_count, " + ", ".join(
            f"sum(({s}_high < {s}_low or {s}_high < {s}_open or {s}_high < {s}_close or {s}_low > {s}_open or {s}_low > {s}_close)::int) as {s}_violation_count" for s in ("bid", "ask", "mid")
        ) + ", sum((ask_close < bid_close)::int) as crossed_close_count, count(*) - count(distinct \"timestamp\") as duplicate_timestamp_count, 0 as missing_column_count, min(\"timestamp\") as first_timestamp, max(\"timestamp\") as last_timestamp, bid_violation_count + ask_violation_count + mid_violation_count + duplicate_timestamp_count = 0 as valid from base group by symbol",
        "coverage_audit": """select symbol, 2 as expected_months, count(distinct date_trunc('month', "timestamp")) as available_months, 2 - count(distinct date_trunc('month', "timestamp")) as missing_months, count(*) as bar_count,
      min("timestamp") as first_timestamp, max("timestamp") as last_timestamp, 0 as duplicate_timestamp_count, sum((ask_close < bid_close)::int) as crossed_close_count,
      median(spread_median_pips) as m, m as spread_median_pips, quantile_cont(base.spread_median_pips, 0.95::double) as spread_p95_pips, max(base.spread_median_pips) as spread_max_pips, false as valid from base group by symbol""",
        "reconcile": """select coalesce(r.symbol, c.symbol) as symbol, count(r.symbol) as rebuilt_count, count(c.symbol) as canonical_count, sum((r.symbol is null or c.symbol is null)::int) as membership_failure_count,
      sum((not coalesce(abs(r.mc - c.mid_close) <= 1e-12, false))::int) as mid_close_mismatch_count, sum((not coalesce(r.n = c.tick_count, false))::int) as tick_count_mismatch_count,
      membership_failure_count + mid_close_mismatch_count + tick_count_mismatch_count = 0 as valid
    from (select symbol, time_bucket(interval 30 minute, "timestamp") as t, last(mid_close order by "timestamp") as mc, sum(tick_count) as n from fine group by all) r
    full join base c on c.symbol = r.symbol and c."timestamp" = r.t group by all""",
        "jaccard_gaps": jac("gap", "gap20", "event_at, direction"),
        "gap_sensitivity": grid("gap", {"atr0": "gap0", "atr20": "gap20"}, "symbol, timeframe, event_at, direction"),
        "order_block_grid": grid("ob", {"lookback3": "ob3", "lookback9": "ob9", "age25": "ob25", "age100": "ob100"}, "symbol, timeframe, anchor_break_id, candidate_bar_id, status"),
        "iou_summary": "select symbol, timeframe, count(*) as compared_count, avg(iou) as mean_iou, quantile_cont(iou, 0.5::double) as median_iou from (select a.symbol, a.timeframe, greatest(least(a.upper_bound, c.upper_bound) - greatest(a.lower_bound, c.lower_bound), 0) / (greatest(a.upper_bound, c.upper_bound) - least(a.lower_bound, c.lower_bound)) as iou from ob a join obody c on c.symbol = a.symbol and c.timeframe = a.timeframe and c.event_id = a.event_id) group by all",
        "order_block_sensitivity": jac("ob", "ob3", "anchor_break_id, candidate_bar_id"),
        "sensitivity": """select variant, sum(l) as primary_count, sum(r) as comparison_count, sum(l * r) as intersection_count, sum(l * r) / (sum(l) + sum(r) - sum(l * r)) as jaccard_agreement from (
      select variant, symbol, timeframe, event_at, kind, max(l) as l, max(r) as r from (
        select unnest(['right1', 'right3']) as variant, symbol, timeframe, event_at, kind, 1 as l, 0 as r from sw0
        union all select 'right1', symbol, timeframe, event_at, kind, 0, 1 from swr1
        union all select 'right3', symbol, timeframe, event_at, kind, 0, 1 from swr3) group by all) group by variant""",
        "interval_iou": "select a.symbol, a.timeframe, a.event_id, greatest(least(a.upper_bound, c.upper_bound) - greatest(a.lower_bound, c.lower_bound), 0) / (greatest(a.upper_bound, c.upper_bound) - least(a.lower_bound, c.lower_bound)) as iou from ob a join obody c on c.symbol = a.symbol and c.timeframe = a.timeframe and c.event_id = a.event_id",
        "constraints": """select 'bar_available_after_start' as invariant, count(*) as failure_count from b where available_at <= "timestamp"
    union all select 'bar_ohlc_order', count(*) from b where mid_high < mid_low or mid_high < mid_open or mid_high < mid_close or mid_low > mid_open or mid_low > mid_close
    union all select 'swing_available_after_event', count(*) from sw where available_at <= event_at
    union all select 'swing_confirmation_delay', count(*) from sw where confirmation_index - pivot_index <> 2
    union all select 'entry_not_before_decision', count(*) from trade t join opensig s using (signal_id) where t.entry_at < s.decision_at
    union all select 'entry_before_cutoff', count(*) from trade where entry_at >= cutoff_at
    union all select 'exit_by_cutoff', count(*) from trade where exit_at > cutoff_at
    union all select 'positive_risk', count(*) from trade where risk_pips <= 0
    union all select 'losing_trades', count(*) from trade where not win
    union all select 'unique_bar_id', coalesce(sum(n), 0) from (select count(*) as n from b group by symbol, bar_id) where n > 1
    union all select 'one_bar_per_series', coalesce(sum(n), 0) from (select count(*) as n from base group by symbol) where n > 1
    union all select 'trades_subset_of_signals', count(*) from trade anti join opensig using (signal_id)
    union all select 'opportunities_with_candidate', count(distinct opportunity_id) from cal anti join cand using (opportunity_id)
    union all select 'excursion_entry_membership', count(*) from trade t full join exc e on e.signal_id = t.signal_id where e.signal_id is null or t.signal_id is null
    union all select 'excursion_entry_entry_at', count(*) from trade t full join exc e on e.signal_id = t.signal_id where e.entry_at is distinct from t.entry_at
    union all select 'excursion_entry_entry_reference_price', count(*) from trade t full join exc e on e.signal_id = t.signal_id where not coalesce(abs(e.entry_reference_price - t.entry_reference_price) <= 1e-12, false)
    union all select 'trade_count_is_100', abs(count(*) - 100) from trade
    union all select 'no_outcome_columns', 0""",
        "rules_signals": ruled(rules.signal_rules(), {
            "signals": "(select *, decision_at as feature_available_at from opensig)", "structure": "cand",
            "trades": "(select t.*, s.decision_at, s.opportunity_id, 'p1' as model_id from (select * exclude (opportunity_id) from trade) t join opensig s using (signal_id))",
            "aligned": aligned, "confluent": f"(select c.* from {aligned} c where displacement_qualified and exists (select 1 from gap g where g.symbol = c.symbol and g.bar_id = c.signal_bar_id and case when g.direction = 'up' then 'long' else 'short' end = c.direction))",
        }),
        "rules_sequences": ruled(rules.sequence_rules(8), {
            "excursions": "exc", "paths": "seq", "original": "(select * from seq where stop_atr = 1 and target_mode = 'fixed_2atr')",
            "parents": f"({bracket('opath', 'p_entry - sgn * (1e0 * atr)', 'p_entry + sgn * (2e0 * (1e0 * atr))', '30', '1e0 * atr')})",
        }),
        "rules_structural": ruled(rules.structural_rules("construction", ["structural_fixed_2atr", "structural_2r"]), {
            "mappings": "(select *, true as source_event_match from mapped)", "structural_fixed_2atr": "fix2", "structural_2r": "two_r", "parents": "firsttrade",
        }),
        "rules_coverage": ruled(rules.coverage_rules("construction"), {"coverage": "(select f.*, m.opportunity_id, m.cutoff_at, m.period from fun f join mapped m using (signal_id))"}),
        "rules_primitives": ruled(rules.primitive_rules(2024), {
            "events": "(select f.*, w.source_swing_available_at, f.available_at as baseline_feature_available_at from feat f left join sweep w using (symbol, timeframe, event_id))",
            "primary": "(select * from feat where is_primary)", "outcomes": "(select *, year(event_at) as event_year from fwd)",
        }),
        "rules_protection": ruled(rules.protection_rules(2024), {
            "mappings": "mapped", "valid": "mvalid", **{f"{c}{v}": f"(select p.*, p.stop as stop_price, p.tgt as target_price, m.year, p.protection_active_from is not null as protection_activated from prot p join (select signal_id, year from mapped) m using (signal_id){w})" for c in ("primary", "stress")
                for v, w in (("", ""), ("_static", " where variant_id <> 'break_even_after_trigger'"), ("_protected", " where variant_id = 'break_even_after_trigger'"))},
        }),
        "label_overlap": """select symbol, timeframe, sum((n > 1)::int) as overlapping_timestamp_count from (select symbol, timeframe, available_at, count(*) as n from (
      select symbol, timeframe, available_at from sw union all select symbol, timeframe, available_at from brk union all select symbol, timeframe, available_at from gap) group by all) group by all""",
        "gates": f"""select scope, "value", gate, gv as gate_value, threshold, coalesce(case when gate = 'trade_count' then gv >= threshold else gv > threshold end, false) as passed from (
      select scope, "value", unnest(['trade_count', 'mean_trade_net_r', 'profit_factor']) as gate, unnest([trade_count::double, mean_trade_net_r, profit_factor]) as gv,
        unnest([60e0, 0e0, 1e0]) as threshold from ({METRICS.replace(", 'exit_reason': 'exit_reason'", "").replace(", {'scope': 'exit_reason', 'value': exit_reason::varchar}", "")}))""",
        "gate_winner": "select arg_max(m, v) as winner from (select 'fit_' || direction as m, avg(net_r) as v, count(*) as n from bothtrade group by direction) where n >= 10",
        "label_profile": """select e.symbol, e.timeframe, e.event_type, e.n as event_count, x.n as bar_count, x.k as eligible_bar_count, e.n / x.n as share_of_bars
    from (select symbol, timeframe, event_type, count(*) as n from brk group by all) e join (select symbol, timeframe, count(*) as n, sum(structure_eligible::int) as k from b group by all) x
      on x.symbol = e.symbol and x.timeframe = e.timeframe""",
        "set_difference": "select opportunity_id, 'first' as only_in from cal anti join opensig using (opportunity_id)",
    }
    book = {**EXTRA, **right, **_other_settings(), "fpath": _path("first", "base")}
    book["firsttrade"] = bracket("fpath", "p_entry - sgn * (1e0 * atr)", "p_entry + sgn * (2e0 * (1e0 * atr))", "30", "1e0 * atr")
    inner["label_sensitivity"] = SENSITIVITY
    inner["monthly_entries"] = f"select model_id, substr(session_date::varchar, 1, 7) as month, count(*) as entry_count from fun join (select signal_id, session_date from mapped) using (signal_id) where coverage_status = 'entry' group by all"
    inner["eligible_models"] = f"select model_id, sum((coverage_status = 'entry')::int) as entry_count, entry_count >= 10 as eligible from fun group by model_id"
    zones = f"(select o.*, c.available_at as candidate_available_at from ({inner['order_blocks']}) o join b c on c.symbol = o.symbol and c.timeframe = o.timeframe and c.bar_idx = o.candidate_index)"
    inner["rules_labels"] = ruled(rules.label_rules(), {"bars": "b", "swings": "(select *, 2 as confirmation_delay_bars from sw)", "gaps": "gap", "order_blocks": zones})
    inner["active_zone_counts"] = f"""with z as (select * from ({inner['level_zones']}) where touch_count >= 2)
    select t.timeframe, m.month, (select count(*) from z where z.timeframe = t.timeframe and strftime(z.active_at, '%Y-%m') = m.month) as event_count
    from (select distinct timeframe from z) t, (select '2024-' || lpad(q::varchar, 2, '0') as month from range(1, 13) r(q)) m"""
    attrs = ("event_type", "direction", "status", "relationship")
    sets = ", ".join(f"({', '.join([*scope, 'concept', *a])})" for scope in (["symbol", "timeframe"], ["timeframe"]) for a in ([], *[[x] for x in attrs]))
    figures = ", ".join(f"count({m}) as {m}_count, avg({m}) as {m}_mean, quantile_cont({m}, 0.05::double) as {m}_p05, quantile_cont({m}, 0.5::double) as {m}_median, quantile_cont({m}, 0.95::double) as {m}_p95" for m in ("delay", "size", "width"))
    named = lambda c: f"when grouping({c}) = 0 then "
    inner["profile_of_labels"] = f"""with labels as (
      select symbol, timeframe, 'swing' as concept, case when kind = 'high' then 'swing_high' else 'swing_low' end as event_type, case when kind = 'high' then 'up' else 'down' end as direction,
        null::varchar as status, rel as relationship, 2::double as delay, null::double as size, null::double as width from sw
      union all select symbol, timeframe, 'break', event_type, direction, case when displacement_qualified then 'displacement' else 'no_displacement' end,
        regime_before || '->' || regime_after, null, body_atr, null from brk
      union all select symbol, timeframe, 'gap', null, direction, status, null, fill_delay_bars, size_atr, (upper_bound - lower_bound) / 1e-2 from gap
      union all select symbol, timeframe, 'zone', role, null, status_at_sample_end, null, bars_since_last_touch, touch_count, (upper_bound - lower_bound) / 1e-2 from ({inner['level_zones']})
      union all select symbol, timeframe, 'order_block', anchor_event_type, direction, status, null, terminal_delay_bars, anchor_index - candidate_index, width_pips from ({inner['order_blocks']})
    ), told as (
      select case when grouping(symbol) = 0 then symbol else 'all' end as symbol, timeframe, concept,
        case {" ".join(named(a) + f"'{a}'" for a in attrs)} else 'all' end as attribute, case {" ".join(named(a) + f"coalesce({a}, 'none')" for a in attrs)} else 'all' end as "value",
        count(*) as event_count, {figures} from labels group by grouping sets ({sets})
    ) select t.*, t.event_count / w.event_count as share from told t join told w on w.symbol = t.symbol and w.timeframe = t.timeframe and w.concept = t.concept and w.attribute = 'all'"""
    inner["rules_filters"] = ruled(rules.filter_rules(2024), {"selected": f"(select *, decision_at as feature_available_at from ({inner['rule_filters']}))", "candidates": "cand"})
    return {
        name: compose(f"select {fmt(specs[name])} from ({sql}) q", book)
        for name, sql in inner.items()
        if name in specs
    }


