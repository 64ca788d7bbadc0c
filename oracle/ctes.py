"""Plain-SQL building blocks for checking the engine on the driver tables with DuckDB.

Each entry is one CTE; ``compose`` pulls in the ones a statement names, in order. The SQL says
the definitions again from scratch (row-wise windows, a recursive state machine, self-joins);
it shares no code with the engine.
"""

from __future__ import annotations

import re

OHLC12 = [f"{s}_{f}" for s in ("bid", "ask", "mid") for f in ("open", "high", "low", "close")]


def _bars(minutes: int, source: str = "ticks") -> str:
    return f"""
  select symbol, time_bucket(interval {minutes} minute, ts) as "timestamp",
    {", ".join(f"first({s} order by ts, seq) as {s}_open, max({s}) as {s}_high, min({s}) as {s}_low, last({s} order by ts, seq) as {s}_close" for s in ("bid", "ask", "mid"))},
    count(*) as tick_count, sum(activity)::bigint as activity_count,
    first(spread_pips order by ts, seq) as spread_open_pips,
    median(spread_pips) as spread_median_pips,
    quantile_cont(spread_pips, 0.95::double) as spread_p95_pips,
    max(spread_pips) as spread_max_pips,
    min(ts) as first_tick_timestamp, max(ts) as last_tick_timestamp
  from {source} group by all"""


def iso(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%dT%H:%M:%S+00:00')"


def _wall(c: str, zone: str) -> str:
    return f"timezone('{zone}', timezone('UTC', {c}))"


def _utc(c: str, zone: str) -> str:
    return f"timezone('UTC', timezone('{zone}', {c}))"


NY = "America/New_York"


def _swing(kind: str, right: int = 2) -> str:
    s = "" if kind == "high" else "-"
    c = f"({s}mid_{kind})"
    return f"""
  select symbol, timeframe, '{kind}' as kind, bar_idx as pivot_index, bar_idx + {right} as confirmation_index,
    "timestamp" as event_at, conf_at as available_at, mid_{kind} as price, atr, bar_id, conf_bar as confirmation_bar_id,
    plateau as plateau_size, ({c} - others) / 1e-2 as extreme_margin_pips
  from (
    select *, max({c}) over f as top, max({c}) over a as later,
      greatest(max({c}) over a, max({c}) over p) as others,
      count(*) over f as n, bool_and(structure_eligible) over f as ok,
      lead(available_at, {right}) over w as conf_at, lead(bar_id, {right}) over w as conf_bar,
      {" + ".join([f"(case when abs(lag({c},{k}) over w - max({c}) over f) <= 1e-12 then 1 else 0 end)" for k in (1, 2)]
                  + [f"(case when abs(lead({c},{k}) over w - max({c}) over f) <= 1e-12 then 1 else 0 end)" for k in range(1, right + 1)]
                  + ["1"])} as plateau
    from b
    window w as (partition by symbol, timeframe order by bar_idx),
      f as (partition by symbol, timeframe order by bar_idx rows between 2 preceding and {right} following),
      a as (partition by symbol, timeframe order by bar_idx rows between 1 following and {right} following),
      p as (partition by symbol, timeframe order by bar_idx rows between 2 preceding and 1 preceding)
  ) where n = {3 + right} and ok and abs({c} - top) <= 1e-12 and not abs(later - top) <= 1e-12"""


def _gaps(ratio: str, tag: str, age: int = 24) -> str:
    return f"""
  with formed as (
    select symbol, timeframe, bar_idx, bar_id, "timestamp" as event_at, available_at, atr,
      mid_high, mid_low, lag(mid_high, 2) over w as h2, lag(mid_low, 2) over w as l2,
      bool_and(structure_eligible) over (partition by symbol, timeframe order by bar_idx rows between 2 preceding and current row) as ok,
      count(*) over (partition by symbol, timeframe order by bar_idx rows between 2 preceding and current row) as n,
      lag(available_at, 2) over w = lag("timestamp", 1) over w and lag(available_at, 1) over w = "timestamp" as joined
    from b window w as (partition by symbol, timeframe order by bar_idx)
  ), sided as (
    select *, 'up' as direction, h2 as lower_bound, mid_low as upper_bound, mid_low - h2 as size from formed where mid_low - h2 > 0
    union all
    select *, 'down', mid_high, l2, l2 - mid_high from formed where l2 - mid_high > 0
  ), g as (
    select * from sided where ok and n = 3 and joined and size >= {ratio} * atr
  )
  select *, case when full_fill_at is not null then 'filled' when last_idx - bar_idx >= {age} then 'expired' else 'open_at_sample_end' end as status
  from (select g.symbol, g.timeframe, 'fvg:' || g.timeframe || ':' || g.direction || ':' || {iso("g.event_at")} || ':m{tag}' as event_id,
    g.event_at, g.available_at, g.direction, g.lower_bound, g.upper_bound, g.size, g.size / g.atr as size_atr, g.atr, g.bar_idx, g.bar_id,
    (select min(x.available_at) from b x where x.symbol = g.symbol and x.timeframe = g.timeframe and x.structure_eligible
       and x.bar_idx between g.bar_idx + 1 and g.bar_idx + {age}
       and case when g.direction = 'up' then x.mid_low < g.upper_bound else x.mid_high > g.lower_bound end) as partial_fill_at,
    (select min(x.available_at) from b x where x.symbol = g.symbol and x.timeframe = g.timeframe and x.structure_eligible
       and x.bar_idx between g.bar_idx + 1 and g.bar_idx + {age}
       and case when g.direction = 'up' then x.mid_low <= g.lower_bound else x.mid_high >= g.upper_bound end) as full_fill_at,
    (select min(x.bar_idx) - g.bar_idx from b x where x.symbol = g.symbol and x.timeframe = g.timeframe and x.structure_eligible
       and x.bar_idx between g.bar_idx + 1 and g.bar_idx + {age}
       and case when g.direction = 'up' then x.mid_low <= g.lower_bound else x.mid_high >= g.upper_bound end) as fill_delay_bars,
    (select max(x.bar_idx) from b x where x.symbol = g.symbol and x.timeframe = g.timeframe) as last_idx
  from g)"""


def _simple_gaps(source: str, minutes: int, name: str) -> str:
    return f"""
  with t as (
    select *, greatest(mid_high - mid_low, abs(mid_high - lag(mid_close) over w), abs(mid_low - lag(mid_close) over w)) as tr,
      lag("timestamp") over w as t1, lag("timestamp", 2) over w as t2,
      lag(mid_high, 2) over w as h2, lag(mid_low, 2) over w as l2
    from {source} window w as (partition by symbol order by "timestamp")
  ), a as (
    select *, avg(tr) over (partition by symbol order by "timestamp" rows between 13 preceding and current row) as atr,
      count(*) over (partition by symbol order by "timestamp" rows between 13 preceding and current row) as n
    from t
  ), s as (
    select *, 'long' as direction, h2 as lower_bound, mid_low as upper_bound, mid_low - h2 as size from a where mid_low - h2 > 0
    union all
    select *, 'short', mid_high, l2, l2 - mid_high from a where l2 - mid_high > 0
  )
  select symbol, direction, t2 as first_bar_at, "timestamp" as third_bar_at, "timestamp" + interval {minutes} minute as available_at,
    lower_bound, upper_bound, size, atr, 'fvg:{name}:' || direction || ':' || {iso('"timestamp"')} as fvg_id
  from s where n = 14 and "timestamp" - t1 = interval {minutes} minute and t1 - t2 = interval {minutes} minute and size >= 1e-1 * atr"""


def _order_blocks(lookback: int = 6, age: int = 50, low: str = "mid_low", high: str = "mid_high") -> str:
    return f"""
  with anchors as (
    select * from brk where timeframe in ('1H', '4H') and event_type in ('bos', 'choch') and displacement_qualified
  ), cand as (
    select a.*, (select max(x.bar_idx) from b x where x.symbol = a.symbol and x.timeframe = a.timeframe and x.structure_eligible
        and x.bar_idx between a.bar_idx - {lookback} and a.bar_idx - 1
        and case when a.direction = 'up' then x.mid_close < x.mid_open else x.mid_close > x.mid_open end) as ci
    from anchors a
  ), ranked as (
    select *, row_number() over (partition by symbol, timeframe, direction, ci order by bar_idx, event_seq) as rk from cand
  ), z as (
    select r.*, c."timestamp" as candidate_at, c.bar_id as candidate_bar_id, {low.replace("mid_", "c.mid_")} as lo, {high.replace("mid_", "c.mid_")} as hi,
      row_number() over (partition by r.symbol, r.timeframe order by r.bar_idx, r.event_seq) as ord
    from ranked r join b c on c.symbol = r.symbol and c.timeframe = r.timeframe and c.bar_idx = r.ci
    where ci is not null and rk = 1
  ), life as (
    select z.symbol, z.timeframe, z.ord,
      min(case when x.mid_low <= hi and x.mid_high >= lo then x.bar_idx end) as touch,
      min(case when case when z.direction = 'up' then x.mid_low <= (lo + hi) / 2 else x.mid_high >= (lo + hi) / 2 end then x.bar_idx end) as half,
      min(case when case when z.direction = 'up' then x.mid_low <= lo else x.mid_high >= hi end then x.bar_idx end) as fullm,
      min(case when case when z.direction = 'up' then x.mid_close < lo else x.mid_close > hi end then x.bar_idx end) as inval
    from z join b x on x.symbol = z.symbol and x.timeframe = z.timeframe and x.structure_eligible
      and x.bar_idx between z.bar_idx + 1 and z.bar_idx + {age}
    group by all
  ), w as (
    select z.*, least(coalesce(fullm, 1e9::bigint), coalesce(inval, 1e9::bigint)) as term, touch, half, fullm, inval,
      (select max(bar_idx) from b x where x.symbol = z.symbol and x.timeframe = z.timeframe) - z.bar_idx as rest
    from z left join life l on l.symbol = z.symbol and l.timeframe = z.timeframe and l.ord = z.ord
  )
  select symbol, timeframe, 'order-block:' || timeframe || ':' || direction || ':' || {iso("candidate_at")} as event_id,
    event_at, available_at, direction, event_id as anchor_break_id, event_type as anchor_event_type, candidate_at, candidate_bar_id,
    ci as candidate_index, bar_idx as anchor_index, lo as lower_bound, hi as upper_bound, (hi - lo) / 1e-2 as width_pips,
    exists (select 1 from gap g where g.symbol = w.symbol and g.timeframe = w.timeframe and g.event_at = w.event_at and g.direction = w.direction) as fvg_confluent,
    (select count(*) from w p where p.symbol = w.symbol and p.timeframe = w.timeframe and p.ord < w.ord and p.lo <= w.hi and p.hi >= w.lo) as overlap_with_prior_zone_count,
    (select count(*) from w p where p.symbol = w.symbol and p.timeframe = w.timeframe and p.ord < w.ord and p.lo <= w.hi and p.hi >= w.lo
       and ((p.lo <= w.lo and p.hi >= w.hi) or (w.lo <= p.lo and w.hi >= p.hi))) as nested_with_prior_zone_count,
    case when touch <= term then touch - bar_idx end as touch_delay, case when half <= term then half - bar_idx end as half_delay,
    case when fullm <= term then fullm - bar_idx end as full_delay, case when inval <= term then inval - bar_idx end as invalid_delay,
    case when term < 1e9 then term - bar_idx end as terminal_delay_bars, least({age}, rest) as observed_bars,
    case when inval <= term then 'invalidated' when fullm <= term then 'fully_mitigated'
         when least({age}, rest) >= {age} then 'expired' else 'active_at_sample_end' end as status
  from w"""


def _path(signals: str, source: str, start: str = "decision_at", end: str = "cutoff_at", extra: str = "") -> str:
    """Signals with every base bar on their path, exit-side quotes and the entry."""
    return f"""
  select s.*, x."timestamp" as bar_at, case when direction = 'long' then 1.0::double else -1.0::double end as sgn,
    case when direction = 'long' then bid_open else ask_open end as q_open,
    case when direction = 'long' then bid_high else ask_low end as q_fav,
    case when direction = 'long' then bid_low else ask_high end as q_adv,
    case when direction = 'long' then bid_close else ask_close end as q_close,
    first_value(x."timestamp") over p as p_entry_at,
    first_value(case when direction = 'long' then ask_open else bid_open end) over p as p_entry
  from {signals} s join {source} x on x.symbol = s.symbol and x."timestamp" >= s.{start} and x."timestamp" < s.{end} {extra}
  window p as (partition by s.signal_id order by x."timestamp")"""


def bracket(path: str, stop: str, target: str, minutes: str, risk: str, variant: str = "bracket", cap: bool = False,
            costs: str = "1e-1") -> str:
    """First-touch outcome over a path CTE, with the cost model, one row per signal."""
    hit_exit = f"least(hit_at + interval ({minutes}) minute, cutoff_at)" if cap else f"hit_at + interval ({minutes}) minute"
    return f"""
  select *, {slip_fill(costs)} from (
  select *, case when hit is null then q_last when hit = 1 then hit_open when hit in (2, 4) then target_price else stop_price end as raw_exit_price,
    case when hit is null then least(last_at + interval ({minutes}) minute, cutoff_at) else {hit_exit} end as exit_at,
    case hit when 1 then 'stop_gap' when 2 then 'target_gap' when 3 then 'stop' when 4 then 'target' else 'time' end as exit_reason
  from (
    select signal_id, any_value(symbol) as symbol, any_value(opportunity_id) as opportunity_id, any_value(session) as session,
      any_value(session_date) as session_date, any_value(period) as period, any_value(direction) as direction,
      any_value(cutoff_at) as cutoff_at, any_value(sgn) as sgn, any_value(p_entry_at) as entry_at, any_value(p_entry) as entry_reference_price,
      '{variant}' as variant_id, any_value(stop_price) as stop_price, any_value(target_price) as target_price, any_value(risk_price) as risk_price,
      min(case when code is not null then bar_at end) as hit_at, arg_min(code, case when code is not null then bar_at end) as hit,
      arg_min(q_open, case when code is not null then bar_at end) as hit_open,
      max(bar_at) as last_at, arg_max(q_close, bar_at) as q_last
    from (
      select *, case when sgn * (q_open - stop_price) <= 0 then 1 when sgn * (q_open - target_price) >= 0 then 2
          when sgn * (q_adv - stop_price) <= 0 then 3 when sgn * (q_fav - target_price) >= 0 then 4 end as code
      from (select *, {stop} as stop_price, {target} as target_price, {risk} as risk_price from {path})
      where risk_price > 0
    ) group by signal_id
  ))"""


def slip_fill(slip: str = "1e-1") -> str:
    pips = f"(sgn * ((raw_exit_price - sgn * {slip} * 1e-2) - (entry_reference_price + sgn * {slip} * 1e-2)) / 1e-2 - 7e-1)"
    return f"{pips} as net_pips, {pips} / (risk_price / 1e-2) as net_r, {pips} > 0 as win, risk_price / 1e-2 as risk_pips"


CTES: dict[str, str] = {
    "ticks": """
  select event_type as symbol, ts, event_id as seq, value - 5e-2 * (event_id % 4 + 1) as bid, value + 5e-2 * (event_id % 4 + 1) as ask,
    value as mid, 5e-2 * (event_id % 4 + 1) * 2 / 1e-2 as spread_pips, 1 as activity from events""",
    "oticks": """
  select o_orderpriority as symbol, o_orderdate::timestamp as ts, o_orderkey as seq, o_totalprice - 5e-2 * (o_orderkey % 4 + 1) as bid,
    o_totalprice + 5e-2 * (o_orderkey % 4 + 1) as ask, o_totalprice as mid, 5e-2 * (o_orderkey % 4 + 1) * 2 / 1e-2 as spread_pips, 1 as activity
  from orders""",
    "base": _bars(30),
    "fine": _bars(10),
    "obars": _bars(1440, "oticks"),
    "basei": """
  select *, row_number() over (partition by symbol order by "timestamp") - 1 as bar_idx, "timestamp" + interval 30 minute as available_at from base""",
    "routed": f"""
  select x.*, tf.timeframe, tf.minutes, {_utc("start_wall", NY)} as bucket_start, {_utc("start_wall + to_minutes(tf.minutes)", NY)} as bucket_end
  from (select *, {_wall('"timestamp"', NY)} as wall from base) x,
    (values ('1H', 60), ('4H', 240), ('1D', 1440)) tf(timeframe, minutes),
    lateral (select make_timestamp((epoch_us(wall - interval 17 hour) // (tf.minutes * 60000000::bigint)) * (tf.minutes * 60000000::bigint)) + interval 17 hour as start_wall) q
  where isodow(wall + interval 7 hour) <= 5""",
    "rolled": f"""
  select symbol, timeframe, bucket_start as "timestamp", bucket_end as available_at,
    {", ".join(f'first({s}_open order by "timestamp") as {s}_open, max({s}_high) as {s}_high, min({s}_low) as {s}_low, last({s}_close order by "timestamp") as {s}_close' for s in ("bid", "ask", "mid"))},
    sum(tick_count)::bigint as tick_count, sum(activity_count)::bigint as activity_count,
    first(spread_open_pips order by "timestamp") as spread_open_pips, median(spread_median_pips) as spread_median_pips,
    max(spread_p95_pips) as spread_p95_pips, max(spread_max_pips) as spread_max_pips, count(*) as source_count,
    min("timestamp") as first_source_timestamp, max("timestamp") as last_source_timestamp,
    round((epoch_us(bucket_end) - epoch_us(bucket_start)) / 1800000000)::int as expected_count,
    count(*) / expected_count as coverage_ratio, timeframe || ':' || {iso("bucket_start")} as bar_id
  from routed group by symbol, timeframe, bucket_start, bucket_end""",
    "b": """
  select *, coverage_ratio >= 5e-1 and atr is not null and available_at > "timestamp" as structure_eligible, abs(mid_close - mid_open) / atr as body_atr
  from (
    select *, case when count(*) over f = 14 then avg(true_range) over f end as atr from (
      select *, row_number() over w - 1 as bar_idx,
        greatest(mid_high - mid_low, abs(mid_high - lag(mid_close) over w), abs(mid_low - lag(mid_close) over w)) as true_range
      from rolled window w as (partition by symbol, timeframe order by "timestamp")
    ) window f as (partition by symbol, timeframe order by bar_idx rows between 13 preceding and current row)
  )""",
    "sw0": f"{_swing('high')} union all {_swing('low')}",
    "sw": f"""
  select *, 'swing_' || kind as event_type, 'swing:' || timeframe || ':' || kind || ':' || {iso("event_at")} || ':r2' as event_id,
    price - prev as delta,
    case when prev is null then case when kind = 'high' then 'H0' else 'L0' end
         when kind = 'high' then case when price - prev > 1e-2 then 'HH' when price - prev < -1e-2 then 'LH' else 'EQH' end
         else case when price - prev > 1e-2 then 'HL' when price - prev < -1e-2 then 'LL' else 'EQL' end end as rel
  from (select *, lag(price) over (partition by symbol, timeframe, kind order by pivot_index) as prev from sw0)""",
    # one row per bar: the state machine walked bar by bar
    "bsw": """
  select b.symbol, b.timeframe, b.bar_idx, b.mid_close, b.atr, b.structure_eligible and b.atr is not null as live,
    h.price as nh, h.rel as nh_rel, h.event_id as nh_id, l.price as nl, l.rel as nl_rel, l.event_id as nl_id
  from b left join sw h on h.symbol = b.symbol and h.timeframe = b.timeframe and h.confirmation_index = b.bar_idx and h.kind = 'high'
    left join sw l on l.symbol = b.symbol and l.timeframe = b.timeframe and l.confirmation_index = b.bar_idx and l.kind = 'low'""",
    "walk": """
  select symbol, timeframe, -1::bigint as i, null::double as hp, null::varchar as hr, null::varchar as hid, -1::bigint as hc,
    null::double as lp, null::varchar as lr, null::varchar as lid, -1::bigint as lc, false as ah, false as al,
    null::double as php, null::double as plp, 'undetermined' as reg, -1::bigint as reset_at, 'undetermined' as reg_open, false as confirmed,
    null::varchar as up_type, null::varchar as up_role, null::varchar as up_before, null::varchar as dn_type, null::varchar as dn_role, null::varchar as dn_before,
    null::varchar as mid_reg, false as live
  from (select distinct symbol, timeframe from sw)
  union all
  select symbol, timeframe, i2, hp2, hr2, hid2, hc2, lp2, lr2, lid2, lc2,
    ah2 and up_hit is null, al2 and dn_hit is null,
    case when choch_up then null else php2 end, case when choch_dn then null else plp2 end,
    case when choch_up or choch_dn then 'transition' else reg2 end,
    case when choch_up or choch_dn then i2 else reset_at end, reg, conf2,
    case when up_hit is null then null when up_hit = 'protected_high' then 'choch' when reg2 = 'bullish' then 'bos' else 'unclassified_break' end,
    up_hit, case when up_hit is not null then case when reg2 = 'bearish' and dn_hit is not null then reg2 else reg2 end end,
    case when dn_hit is null then null when dn_hit = 'protected_low' then 'choch' when reg2 = 'bearish' then 'bos' else 'unclassified_break' end,
    dn_hit, case when dn_hit is not null then reg2 end, reg2, live2
  from (
    select *, up_hit = 'protected_high' and up_hit is not null as choch_up, dn_hit = 'protected_low' and dn_hit is not null as choch_dn
    from (
      select *,
        case when not live2 then null
             when reg2 = 'bullish' then case when ah2 and mid_close > hp2 + atr * 5e-2 then 'continuation_high' end
             when reg2 = 'bearish' then case when php2 is not null and mid_close > php2 + atr * 5e-2 then 'protected_high' end
             when ah2 and mid_close > hp2 + atr * 5e-2 then 'active_high' end as up_hit,
        case when not live2 then null
             when reg2 = 'bearish' then case when al2 and mid_close < lp2 - atr * 5e-2 then 'continuation_low' end
             when reg2 = 'bullish' then case when plp2 is not null and mid_close < plp2 - atr * 5e-2 then 'protected_low' end
             when al2 and mid_close < lp2 - atr * 5e-2 then 'active_low' end as dn_hit
      from (
        select *, case when not conf2 then php when reg2 = 'bearish' then hp2 end as php2,
          case when not conf2 then plp when reg2 = 'bullish' then lp2 end as plp2
        from (
          select *, case when not conf2 then reg
              when hid2 is null or lid2 is null then 'undetermined'
              when reset_at >= 0 and (hc2 <= reset_at or lc2 <= reset_at) then 'transition'
              when hr2 = 'HH' and lr2 = 'HL' then 'bullish' when hr2 = 'LH' and lr2 = 'LL' then 'bearish'
              when hr2 = 'EQH' and lr2 = 'EQL' then 'balance' when hr2 = 'H0' or lr2 = 'L0' then 'undetermined'
              else 'transition' end as reg2
          from (
            select w.*, n.bar_idx as i2, n.mid_close, n.atr, n.live as live2, n.nh is not null or n.nl is not null as conf2,
              coalesce(n.nh, hp) as hp2, coalesce(n.nh_rel, hr) as hr2, coalesce(n.nh_id, hid) as hid2, case when n.nh is not null then n.bar_idx else hc end as hc2,
              coalesce(n.nl, lp) as lp2, coalesce(n.nl_rel, lr) as lr2, coalesce(n.nl_id, lid) as lid2, case when n.nl is not null then n.bar_idx else lc end as lc2,
              ah or n.nh is not null as ah2, al or n.nl is not null as al2
            from walk w join bsw n on n.symbol = w.symbol and n.timeframe = w.timeframe and n.bar_idx = w.i + 1
          )
        )
      )
    )
  )""",
    "brk": f"""
  select k.symbol, k.timeframe, 'break:' || k.timeframe || ':' || k.direction || ':' || {iso('b."timestamp"')} || ':b0.05' as event_id,
    k.event_type, b."timestamp" as event_at, b.available_at, k.direction, k.before as regime_before,
    case when k.event_type = 'choch' then 'transition' else k.before end as regime_after, k.role as broken_level_role,
    k.swing as broken_swing_id, k.level as broken_level, b.mid_close as close, b.atr, b.body_atr, b.body_atr >= 8e-1 as displacement_qualified,
    b.bar_id, b.bar_idx, k.event_seq
  from (
    select symbol, timeframe, i, 'up' as direction, up_type as event_type, up_role as role, mid_reg as before, hid as swing, hp as level,
      case when mid_reg = 'bearish' then 1 else 0 end as event_seq from walk where up_type is not null
    union all
    select symbol, timeframe, i, 'down', dn_type, dn_role, mid_reg, lid, lp, case when mid_reg = 'bearish' then 0 else 1 end from walk where dn_type is not null
  ) k join b on b.symbol = k.symbol and b.timeframe = k.timeframe and b.bar_idx = k.i""",
    "ctx": f"""
  select w.symbol, w.timeframe, 'context:' || w.timeframe || ':' || {iso('b."timestamp"')} || ':' || w.reg as event_id, b."timestamp" as event_at, b.available_at,
    case when w.first_live then null else w.reg_open end as previous_state, w.reg as state,
    case when w.first_live then 'initialization' when up_type = 'choch' or dn_type = 'choch' then 'choch' else 'swing_confirmation' end as cause,
    w.hid as latest_high_swing_id, w.lid as latest_low_swing_id,
    case when w.reg = 'bearish' then w.hid end as protected_high_swing_id, case when w.reg = 'bullish' then w.lid end as protected_low_swing_id
  from (select *, live and row_number() over (partition by symbol, timeframe, live order by i) = 1 as first_live from walk) w
    join b on b.symbol = w.symbol and b.timeframe = w.timeframe and b.bar_idx = w.i
  where w.live and (w.first_live or w.reg <> w.reg_open)""",
    "gap": _gaps("1e-1", "0.1"),
    "gap20": _gaps("2e-1", "0.2"),
    "gap0": _gaps("0e0", "0.0"),
    "cgap": _simple_gaps("base", 30, "30min"),
    "fgap": _simple_gaps("fine", 10, "10min"),
    "ob": _order_blocks(),
    "ob3": _order_blocks(lookback=3),
    "ob9": _order_blocks(lookback=9),
    "ob25": _order_blocks(age=25),
    "ob100": _order_blocks(age=100),
    "obody": _order_blocks(low="least(mid_open, mid_close)".replace("mid_close)", "mid_close)"), high="greatest(mid_open, mid_close)"),
    "hits": """
  select b.*, s.kind, s.event_id as source_swing_id, s.available_at as source_swing_available_at, s.price as swept_level, s.pivot_index,
    case when s.kind = 'high' then b.mid_close <= s.price else b.mid_close >= s.price end as inside
  from b, (values ('high'), ('low')) k(kd), lateral (
    select * from sw where sw.symbol = b.symbol and sw.timeframe = b.timeframe and sw.kind = kd and sw.available_at <= b."timestamp"
    order by sw.available_at desc, sw.event_id desc limit 1) s
  where b.structure_eligible and b.atr > 0
    and case when s.kind = 'high' then b.mid_high >= s.price + 5e-2 * b.atr else b.mid_low <= s.price - 5e-2 * b.atr end
  qualify row_number() over (partition by b.symbol, b.timeframe, s.kind, s.pivot_index order by b.bar_idx) = 1""",
    "sweep": f"""
  select symbol, timeframe, 'sweep:' || timeframe || ':' || {iso('"timestamp"')} || ':' || kind as event_id, "timestamp" as event_at, available_at,
    case when kind = 'high' then 'short' else 'long' end as direction, atr, body_atr, bar_id, bar_idx, source_swing_id, source_swing_available_at,
    kind as swept_side, swept_level, (case when kind = 'high' then mid_high - swept_level else swept_level - mid_low end) / atr as wick_excursion_atr
  from hits where inside qualify count(*) over (partition by symbol, timeframe, bar_idx) = 1""",
    "disp": f"""
  select symbol, timeframe, 'displacement:' || timeframe || ':' || {iso('"timestamp"')} as event_id, "timestamp" as event_at, available_at,
    case when mid_close > mid_open then 'long' else 'short' end as direction, atr, body_atr, bar_id, bar_idx
  from b where structure_eligible and body_atr >= 8e-1 and abs(mid_close - mid_open) > 1e-12""",
    "evt": """
  select symbol, timeframe, event_id, event_type as primitive, event_at, available_at, case when direction = 'up' then 'long' else 'short' end as direction,
    atr, body_atr, bar_id, bar_idx from brk where event_type in ('bos', 'choch')
  union all select symbol, timeframe, event_id, 'liquidity_sweep', event_at, available_at, direction, atr, body_atr, bar_id, bar_idx from sweep
  union all select symbol, timeframe, event_id, 'displacement', event_at, available_at, direction, atr, body_atr, bar_id, bar_idx from disp""",
    "cal": f"""
  select symbol, symbol || ':' || strftime(d, '%Y-%m-%d') || ':' || name as opportunity_id, name as session, strftime(d, '%Y-%m-%d') as session_date,
    year(d) as year, 'construction' as period, "timestamp" as session_open_at, "timestamp" + interval 90 minute as observation_end_at,
    case when name = 'london' then {_utc("d + interval 8 hour", NY)} else {_utc("d + interval 17 hour", NY)} end as cutoff_at
  from (
    select symbol, "timestamp", 'london' as name, {_wall('"timestamp"', "Europe/London")} as wall, wall::date::timestamp as d from base
    union all select symbol, "timestamp", 'new_york', {_wall('"timestamp"', NY)} as wall, wall::date::timestamp from base
  ) where isodow(wall) <= 5 and hour(wall) = 8 and minute(wall) = 0 and year(d) = 2024""",
    "cand": """
  select c.*, e.event_id as source_event_id, e.event_type, e.event_at as setup_bar_at, e.available_at as decision_at, e.atr, e.bar_id as signal_bar_id,
    e.displacement_qualified, case when e.direction = 'up' then 'long' else 'short' end as direction,
    coalesce((select arg_max(x.state, x.available_at) from ctx x where x.symbol = c.symbol and x.timeframe = '4H' and x.available_at <= e.available_at), 'undetermined') as h1_context,
    coalesce((select arg_max(x.state, x.available_at) from ctx x where x.symbol = c.symbol and x.timeframe = '1D' and x.available_at <= e.available_at), 'undetermined') as h4_context
  from cal c join brk e on e.symbol = c.symbol and e.timeframe = '1H' and e.event_type in ('bos', 'choch')
    and e.event_at >= c.session_open_at and e.available_at < c.cutoff_at""",
    "first": """
  select *, 'signal:p3:' || opportunity_id as signal_id from cand
  qualify row_number() over (partition by opportunity_id order by decision_at, source_event_id) = 1""",
    # session-open signals: direction from the last two completed 4H closes, ATR of the setup frame
    "opensig": """
  select c.*, c.session_open_at as decision_at, q.direction, a.atr, 'signal:p1:' || opportunity_id as signal_id
  from cal c, lateral (
    select case when last_c > prev_c then 'long' when last_c < prev_c then 'short' end as direction from (
      select mid_close as last_c, lag(mid_close) over (order by bar_idx) as prev_c, bar_idx from b x
      where x.symbol = c.symbol and x.timeframe = '4H' and x.available_at <= c.session_open_at) order by bar_idx desc limit 1) q,
  lateral (select case when x.atr > 0 then x.atr end as atr from b x where x.symbol = c.symbol and x.timeframe = '1H' and x.available_at <= c.session_open_at
    order by x.available_at desc limit 1) a
  where q.direction is not null and a.atr is not null""",
    "opath": _path("opensig", "base"),
    "trade": bracket("opath", "p_entry - sgn * (5e-1 * atr)", "p_entry + sgn * (1e0 * (5e-1 * atr))", "30", "5e-1 * atr"),
    # both directions at every session open
    "bothsig": """
  select c.*, c.session_open_at as decision_at, d.direction, a.atr, 'signal:fit_' || d.direction || ':' || opportunity_id as signal_id
  from cal c, (values ('long'), ('short')) d(direction),
  lateral (select case when x.atr > 0 then x.atr end as atr from b x where x.symbol = c.symbol and x.timeframe = '1H' and x.available_at <= c.session_open_at
    order by x.available_at desc limit 1) a
  where a.atr is not null""",
    "bothpath": _path("bothsig", "base"),
    "bothtrade": bracket("bothpath", "p_entry - sgn * (5e-1 * atr)", "p_entry + sgn * (1e0 * (5e-1 * atr))", "30", "5e-1 * atr"),
    "map0": """
  select f.*, s.event_id as structural_swing_id, s.event_type as structural_swing_type, s.rel as structural_swing_relationship,
    s.event_at as structural_swing_event_at, s.available_at as structural_swing_available_at,
    e.entry_at as found_entry_at, e.entry_price as found_entry, l.n, l.lo, l.hi, case when direction = 'long' then 1.0::double else -1.0::double end as sg
  from first f
  left join lateral (select * from sw x where x.symbol = f.symbol and x.timeframe = '1H' and x.kind = case when f.direction = 'long' then 'low' else 'high' end
      and x.available_at <= f.decision_at and x.event_at < f.decision_at order by confirmation_index desc, pivot_index desc, event_id desc limit 1) s on true
  left join lateral (select x."timestamp" as entry_at, case when f.direction = 'long' then x.ask_open else x.bid_open end as entry_price from base x
      where x.symbol = f.symbol and x."timestamp" >= f.decision_at and x."timestamp" < f.cutoff_at order by x."timestamp" limit 1) e on true
  left join lateral (select count(*) as n, min(bid_low) as lo, max(ask_high) as hi from base x where x.symbol = f.symbol
      and x."timestamp" >= s.event_at and x."timestamp" < s.event_at + interval 60 minute) l on true""",
    "mapped": """
  select *, case when structural_swing_id is null then 'missing_opposing_swing' when found_entry_at is null then 'missing_entry_bar'
      when coalesce(n, 0) = 0 then 'missing_swing_execution_bars' when not (dist > 0) then 'stop_wrong_side_of_entry' else 'valid' end as mapping_status,
    case when ready then found_entry end as entry_reference_price, case when ready then stop end as structural_stop_price,
    case when ready then dist end as structural_stop_distance, case when ready then dist / atr end as structural_stop_atr,
    case when ready then level end as structural_unbuffered_level, case when ready then n else 0 end as swing_execution_bar_count,
    case when ready and dist > 0 then 30 / ((dist / 1e-2) * 10) end as theoretical_lots_at_fixed_risk
  from (select *, sg * (found_entry - stop) as dist, structural_swing_id is not null and found_entry_at is not null and n > 0 as ready
    from (select *, level - sg * (1e-1 * atr) as stop from (select *, case when direction = 'long' then lo else hi end as level from map0)))""",
    "mvalid": "select * from mapped where mapping_status = 'valid'",
    "mpath": _path("mvalid", "base"),
    "fix2": bracket("mpath", "structural_stop_price", "p_entry + sgn * (2e0 * atr)", "30", "sgn * (p_entry - structural_stop_price)", "structural_fixed_2atr"),
    "two_r": bracket("mpath", "structural_stop_price", "p_entry + sgn * (2e0 * (sgn * (p_entry - structural_stop_price)))", "30",
                     "sgn * (p_entry - structural_stop_price)", "structural_2r"),
    "expath": "select *, greatest(sgn * (p_entry - q_adv) / atr, 0) as adv, greatest(sgn * (q_fav - p_entry) / atr, 0) as fav from opath",
    "exc": """
  select signal_id, any_value(symbol) as symbol, any_value(session) as session, any_value(direction) as direction, any_value(period) as period,
    any_value(atr) as atr, any_value(p_entry_at) as entry_at, any_value(p_entry) as entry_reference_price, any_value(decision_at) as decision_at, any_value(cutoff_at) as cutoff_at,
    count(*) as observed_bar_count, max(bar_at) as last_observed_bar_at, max(adv) as max_adverse_excursion_atr, max(fav) as max_favorable_excursion_atr
  from expath group by signal_id""",
    "seq": """
  select *, max(case when stop_atr = 1 and target_mode = 'fixed_2atr' then sequence end) over (partition by signal_id) as original_fixed_sequence,
    target_mode = 'fixed_2atr' and original_fixed_sequence = 'stop_then_target_later' and sequence = 'target_before_stop' as saved_original_premature
  from (
    select *, case when st is null and tg is null then 'neither_touched' when st is null or tg < st then 'target_before_stop'
        when tg is null then 'stop_without_later_target' when st < tg then 'stop_then_target_later' else 'same_bar_ambiguous_stop_first' end as sequence
    from (
      select signal_id, any_value(session) as session, any_value(direction) as direction, any_value(period) as period, stop_atr, target_mode, target_atr,
        min(case when adv >= stop_atr then bar_at end) as st, min(case when fav >= target_atr then bar_at end) as tg
      from expath, (select k::double as stop_atr, m as target_mode, case when m = 'fixed_2atr' then 2.0::double else 2.0::double * k end as target_atr
        from (values (1e0), (125e-2), (15e-1), (2e0)) s(k), (values ('fixed_2atr'), ('rr_preserving_2_to_1')) t(m))
      group by signal_id, stop_atr, target_mode, target_atr))""",
    "sev": """
  select e.*, c.opportunity_id, c.session, c.session_date, c.year, c.period, c.session_open_at, c.cutoff_at
  from evt e join cal c on c.symbol = e.symbol and e.event_at >= c.session_open_at and e.available_at > c.session_open_at and e.available_at < c.cutoff_at
  where e.timeframe = '1H'""",
    "feat": """
  select *, case when h1_context = want and h4_context = want then 'both_aligned' when h1_context = contra and h4_context = contra then 'both_opposed'
      when h1_context in ('bullish', 'bearish') and h4_context in ('bullish', 'bearish') then 'mixed' else 'undetermined' end as context_alignment,
    case when body_atr < 8e-1 then 'below_0_8' when body_atr < 12e-1 then '0_8_to_1_2' else 'at_least_1_2' end as displacement_strength,
    direction as event_direction,
    case when ('0x' || substr(sha256('20260901:' || event_id), 2, 1))::int % 2 = 1 then 'long' else 'short' end as seeded_random_direction,
    case when close > open_mid then 'long' when close < open_mid then 'short' end as session_momentum,
    case when close > open_mid then 'short' when close < open_mid then 'long' end as session_mean_reversion,
    case when pn = 4 and pok and close > ph then 'long' when pn = 4 and pok and close < pl then 'short' end as four_bar_close_breakout,
    row_number() over (partition by primitive, opportunity_id order by available_at, event_id) = 1 as is_primary
  from (
    select s.*, o.mid_open as open_mid, x.mid_close as close, x.pn, x.pok, x.ph, x.pl,
      case when s.direction = 'long' then 'bullish' else 'bearish' end as want, case when s.direction = 'long' then 'bearish' else 'bullish' end as contra,
      coalesce((select arg_max(x.state, x.available_at) from ctx x where x.symbol = s.symbol and x.timeframe = '4H' and x.available_at <= s.available_at), 'undetermined') as h1_context,
      coalesce((select arg_max(x.state, x.available_at) from ctx x where x.symbol = s.symbol and x.timeframe = '1D' and x.available_at <= s.available_at), 'undetermined') as h4_context
    from sev s left join base o on o.symbol = s.symbol and o."timestamp" = s.session_open_at
    left join (select *, count(*) over p as pn, bool_and(structure_eligible) over p as pok, max(mid_high) over p as ph, min(mid_low) over p as pl from b
      window p as (partition by symbol, timeframe order by bar_idx rows between 4 preceding and 1 preceding)) x
      on x.symbol = s.symbol and x.timeframe = s.timeframe and x.bar_id = s.bar_id)""",
    "fwd0": """
  select f.*, n.bar_idx as ei, n."timestamp" as entry_at, n.mid_open as entry, h.h as horizon_minutes, n."timestamp" + to_minutes(h.h) as exit_at,
    x.mid_open as exit, x.bar_idx as xi,
    (select max(p.mid_high) from basei p where p.symbol = f.symbol and p."timestamp" >= n."timestamp" and p."timestamp" < n."timestamp" + to_minutes(h.h)) as hi,
    (select min(p.mid_low) from basei p where p.symbol = f.symbol and p."timestamp" >= n."timestamp" and p."timestamp" < n."timestamp" + to_minutes(h.h)) as lo
  from feat f, lateral (select * from basei x where x.symbol = f.symbol and x."timestamp" >= f.available_at order by x."timestamp" limit 1) n,
    (values (30), (60), (120), (240)) h(h) join basei x on x.symbol = f.symbol and x."timestamp" = n."timestamp" + to_minutes(h.h)
  where f.atr > 0 and x.bar_idx - n.bar_idx = h.h / 30""",
    "fwd": """
  select *, (exit - entry) / atr as raw_forward_return_atr, sg * (exit - entry) / atr as signed_forward_return_atr, sg is not null as emitted_prediction,
    case when sg = 1 then greatest((hi - entry) / atr, 0) when sg = -1 then greatest((entry - lo) / atr, 0) end as mfe_atr,
    case when sg = 1 then greatest((entry - lo) / atr, 0) when sg = -1 then greatest((hi - entry) / atr, 0) end as mae_atr
  from (select *, case predicted_direction when 'long' then 1.0::double when 'short' then -1.0::double end as sg from (
    select *, unnest(['event_direction', 'seeded_random_direction', 'session_momentum', 'session_mean_reversion', 'four_bar_close_breakout']) as rule,
      unnest([event_direction, seeded_random_direction, session_momentum, session_mean_reversion, four_bar_close_breakout]) as predicted_direction from fwd0))""",
    "bar1": """
  select f.symbol, f.event_id, f.primitive, f.rule, f.predicted_direction, f.is_primary,
    case when fav is null and adv is null then 'neither' when adv is null or fav < adv then 'favorable_first'
         when fav is null or adv < fav then 'adverse_first' else 'same_bar_ambiguous' end as barrier_sequence
  from (
    select f.*,
      (select min(p."timestamp") from basei p where p.symbol = f.symbol and p."timestamp" >= f.entry_at and p."timestamp" < f.exit_at
        and case when sg = 1 then (p.mid_high - f.entry) / f.atr >= 5e-1 else (f.entry - p.mid_low) / f.atr >= 5e-1 end) as fav,
      (select min(p."timestamp") from basei p where p.symbol = f.symbol and p."timestamp" >= f.entry_at and p."timestamp" < f.exit_at
        and case when sg = 1 then (f.entry - p.mid_low) / f.atr >= 5e-1 else (p.mid_high - f.entry) / f.atr >= 5e-1 end) as adv
    from fwd f where horizon_minutes = 240 and emitted_prediction) f""",
}

_NAME = re.compile(r"[a-z_0-9]+")


def compose(final: str, extra: dict[str, str] | None = None) -> str:
    """``final`` with every CTE it needs, directly or through others, in definition order."""
    book = {**CTES, **(extra or {})}
    needed: set[str] = set()
    todo = [final]
    while todo:
        words = set(_NAME.findall(todo.pop().lower()))
        for name in book:
            if name in words and name not in needed:
                needed.add(name)
                todo.append(book[name])
    if not needed:
        return final
    recursive = "recursive " if "walk" in needed or "greedy" in needed else ""
    body = ",\n".join(f"{n} as ({book[n]})" for n in book if n in needed)
    return f"with {recursive}{body}\n{final}"
