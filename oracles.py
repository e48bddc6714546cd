"""DuckDB SQL for the registered queries, written independently of the Spark code.

Each statement is assembled from named common table expressions; ``statement`` adds
the ones a query refers to.  Sample parameters are fixed values shared with
``__spark_entry__``.
"""

from __future__ import annotations

import re

EARTH = "6371000.0"
CLUSTER_RADIUS = "(3.1392246115209545e-05 * 6371000.0)"
SPLIT, END = "2024-01-16", "2024-02-01"
BASE_FROM, BASE_TO = "2024-01-01", "2024-01-14"
CROP_FROM, CROP_TO = "2024-01-03", "2024-01-28"
RANGE_FROM, RANGE_TO = "2024-01-02", "2024-01-29"
WINDOW = 7
ACTIVE_SHARE, ACTIVE_SHARE_C2 = 0.85, 0.5
BINS, LABELS = [0.0, 0.4, 0.8, 1.0], ["high", "medium", "low"]
HOME_MEASURES = [("t_home", "H"), ("t_work", "W"), ("t_other", "O"), ("rec", "R"), ("comms", "C")]


def metres(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (f"2 * {EARTH} * asin(least(1.0, sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2)"
            f" + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))))")


CTES: dict[str, str] = {}

CTES["pings"] = """
select cast(user_id as varchar) as user_id, event_id * 8 + k as ping_id,
  b + k * (case when event_id % 6 = 0 then 120 else 300 end) as epoch_time,
  cast(-30 + (user_id * 37) % 60 as double) + cast(place as double) * cast(0.02 as double)
    + cast((event_id * 31 + k * 17) % 21 - 10 as double) * cast(0.00001 as double) as lat,
  cast(-100 + (user_id * 53) % 200 as double) + cast(place as double) * cast(0.02 as double)
    + cast((event_id * 29 + k * 13) % 21 - 10 as double) * cast(0.00001 as double) as lon,
  cast(5 + (event_id * 13 + k * 3) % 240 as double) as accuracy,
  case user_id % 5 when 0 then 'BR' when 1 then 'CO' when 2 then 'ID' when 3 then 'MX' else 'PH' end as country
from (
  select *, unnest(range(0, 2 + event_id % 4)) as k from (
    select *, case when place0 = 0 and event_id % 4 = 0 then 7
                   when place0 = 0 and user_id % 3 = 0 and d >= date '2024-01-16' then 9
                   else place0 end as place from (
      select *, case when h >= 21 or h < 8 then 0
                     when h < 17 and dow0 between 1 and 5 and event_id % 5 <> 0 then 1
                     else 2 + event_id % 5 end as place0 from (
        select event_id, user_id, cast(floor(epoch_us(ts) / 1000000) as bigint) as b,
               hour(ts) as h, dayofweek(ts) as dow0, cast(ts as date) as d from events))))
"""


def _stop_ctes(suffix: str, session: str, timed: bool) -> None:
    CTES[f"chain{suffix}"] = f"""
select *, row_number() over (partition by user_id, session_id order by epoch_time, ping_id) as pos from {session}
"""
    CTES[f"grow{suffix}"] = f"""
select user_id, session_id, pos, pos as head, [lat] as lats, [lon] as lons from chain{suffix} where pos = 1
union all
select n.user_id, n.session_id, n.pos,
  case when {metres('n.lat', 'n.lon', "list_aggregate(g.lats, 'median')", "list_aggregate(g.lons, 'median')")} <= 50
       then g.head else n.pos end,
  case when {metres('n.lat', 'n.lon', "list_aggregate(g.lats, 'median')", "list_aggregate(g.lons, 'median')")} <= 50
       then list_append(g.lats, n.lat) else [n.lat] end,
  case when {metres('n.lat', 'n.lon', "list_aggregate(g.lats, 'median')", "list_aggregate(g.lons, 'median')")} <= 50
       then list_append(g.lons, n.lon) else [n.lon] end
from grow{suffix} g join chain{suffix} n
  on n.user_id = g.user_id and n.session_id = g.session_id and n.pos = g.pos + 1
"""
    keep = "count(*) >= 2" + (" and max(epoch_time) - min(epoch_time) >= 300" if timed else "")
    CTES[f"stops_all{suffix}"] = f"""
select user_id, min(epoch_time) as t_start, max(epoch_time) as t_end, median(lat) as lat, median(lon) as lon,
  median(accuracy) filter (where pos < tail) as median_accuracy, count(*) as total_pings_stop,
  median(accuracy) as full_accuracy
from (select c.*, g.head, max(c.pos) over (partition by c.user_id, c.session_id, g.head) as tail
      from chain{suffix} c join grow{suffix} g using (user_id, session_id, pos))
group by user_id, session_id, head having {keep}
"""


CTES["sessions"] = """
select * exclude (fresh), sum(fresh) over (partition by user_id order by epoch_time, ping_id
                                            rows unbounded preceding) as session_id
from (select *, case when epoch_time - lag(epoch_time) over (partition by user_id order by epoch_time, ping_id) > 3600
                     then 1 else 0 end as fresh from pings)
"""
CTES["untimed_sessions"] = "select *, 0 as session_id from pings"
_stop_ctes("", "sessions", True)
_stop_ctes("_untimed", "untimed_sessions", False)
CTES["stops"] = "select * from stops_all where median_accuracy < 200"
CTES["ping_members"] = "select c.*, g.head from chain c join grow g using (user_id, session_id, pos)"
CTES["ping_members_untimed"] = "select c.*, g.head from chain_untimed c join grow_untimed g using (user_id, session_id, pos)"
CTES["ping_labels_untimed"] = """
select m.user_id, m.ping_id, coalesce(s.stop, -1) as stop
from ping_members_untimed m left join (
  select user_id, session_id, head, row_number() over (partition by user_id order by session_id, head) - 1 as stop
  from ping_members_untimed group by user_id, session_id, head having count(*) >= 2) s using (user_id, session_id, head)
"""
CTES["ping_labels"] = """
select m.user_id, m.ping_id, coalesce(s.stop, -1) as stop
from ping_members m left join (
  select user_id, session_id, head, row_number() over (partition by user_id order by session_id, head) - 1 as stop
  from ping_members group by user_id, session_id, head
  having count(*) >= 2 and max(epoch_time) - min(epoch_time) >= 300) s using (user_id, session_id, head)
"""

CTES["local_pings"] = """
select * replace (cast(epoch(timezone(case country when 'BR' then 'America/Sao_Paulo' when 'CO' then 'America/Bogota'
    when 'ID' then 'Asia/Jakarta' when 'MX' then 'America/Mexico_City' else 'Asia/Manila' end,
    to_timestamp(epoch_time))) as bigint) as epoch_time)
from pings
"""

# Places: close pairs, their closure, and a number by the earliest stop.
CTES["numbered"] = """
select *, row_number() over (partition by user_id order by t_start, t_end, lat, lon) as sid from stops
"""
CTES["close_pairs"] = f"""
select x.user_id, x.sid as a, y.sid as b from numbered x join numbered y on x.user_id = y.user_id
where {metres('x.lat', 'x.lon', 'y.lat', 'y.lon')} <= {CLUSTER_RADIUS}
"""
CTES["reach"] = """
select user_id, sid as a, sid as root from numbered
union
select r.user_id, e.b, r.root from reach r join close_pairs e on e.user_id = r.user_id and e.a = r.a
"""
CTES["clustered"] = """
select n.* exclude (sid), dense_rank() over (partition by n.user_id order by m.root) - 1 as cluster_label
from numbered n join (select user_id, a, min(root) as root from reach group by user_id, a) m
  on m.user_id = n.user_id and m.a = n.sid
"""

_HARD = ["pings", "sessions", "untimed_sessions", "chain", "grow", "stops_all", "chain_untimed", "grow_untimed",
         "stops_all_untimed", "stops", "numbered", "close_pairs", "reach", "clustered", "ping_members", "ping_labels"]
for _name in _HARD:
    CTES[f"{_name}_hard"] = re.sub(rf"\b({'|'.join(_HARD)})\b", r"\1_hard", CTES[_name])
_visits = CTES["pings"][CTES["pings"].index("from ("):].replace("range(0, 2 + event_id % 4)", "range(0, 6 + event_id % 10)")
CTES["pings_hard"] = f"""
select cast(user_id as varchar) as user_id, event_id * 16 + k as ping_id, b + (k // 2) * 150 as epoch_time,
  cast(-30 + (user_id * 37) % 60 as double) + cast(place as double) * cast(0.002 as double)
    + cast((event_id * 7919 + k * 104729) % 1001 - 500 as double) * cast(0.00000103 as double)
    + cast(k as double) * cast(0.00002 as double) as lat,
  cast(-100 + (user_id * 53) % 200 as double) + cast(place % 3 as double) * cast(0.001 as double)
    + cast((event_id * 6007 + k * 15485863) % 1001 - 500 as double) * cast(0.00000103 as double) as lon,
  cast(5 + (event_id * 13 + k * 3) % 240 as double) as accuracy,
  case user_id % 5 when 0 then 'BR' when 1 then 'CO' when 2 then 'ID' when 3 then 'MX' else 'PH' end as country
{_visits}"""

# The same with coordinates in whole multiples of 2^-24 degrees, and one device of all events.
_EXACT = ["pings", "untimed_sessions", "chain_untimed", "grow_untimed", "stops_all_untimed", "ping_members_untimed",
          "ping_labels_untimed"]
_DEVICE = ["pings", "sessions", "chain", "grow", "stops_all"]
for _names, _suffix in ((_EXACT, "_exact"), (_DEVICE, "_device")):
    for _name in _names:
        CTES[f"{_name}{_suffix}"] = re.sub(rf"\b({'|'.join(_names)})\b", rf"\1{_suffix}", CTES[_name])
CTES["pings_exact"] = """
select * replace (round(lat * 16777216) / 16777216 as lat, round(lon * 16777216) / 16777216 as lon) from pings_hard
"""
CTES["pings_device"] = """
select 'device' as user_id, event_id as ping_id, 1700000000 + event_id * 97 as epoch_time,
  10 + cast((event_id // 41) % 3 as double) * cast(0.00055 as double)
    + cast((event_id // 977) % 5 as double) * cast(0.0001 as double)
    + cast((event_id * 7919) % 1001 - 500 as double) * cast(0.0000004 as double) as lat,
  20 + cast((event_id * 6007) % 1001 - 500 as double) * cast(0.0000004 as double) as lon,
  cast(5 + event_id % 240 as double) as accuracy, 'XX' as country
from events
"""
CTES["grow_device_wide"] = CTES["grow_device"].replace("<= 50", "<= 150").replace("grow_device", "grow_device_wide")
CTES["stops_all_device_wide"] = CTES["stops_all_device"].replace("grow_device", "grow_device_wide")

CTES["day_cut"] = """
select c.* exclude (t_start, t_end, d), t_end - t_start as total_duration_stop_location,
  greatest(t_start, d * 86400) as t_start, least(t_end, (d + 1) * 86400) as t_end,
  least(t_end, (d + 1) * 86400) - greatest(t_start, d * 86400) as duration
from (select *, unnest(range(t_start // 86400, t_end // 86400 + 1)) as d from clustered) c
where greatest(t_start, d * 86400) < least(t_end, (d + 1) * 86400)
"""
CTES["timed"] = """
select *, make_timestamp(t_start * 1000000) as date, cast(make_timestamp(t_start * 1000000) as date) as date_trunc,
  (t_start % 86400) // 3600 as t_start_hour, (t_end % 86400) // 3600 as t_end_hour,
  dayofweek(make_timestamp(t_start * 1000000)) + 1 as weekday
from day_cut
"""
CTES["pieces"] = """
select *, 'g' || cast((cast(user_id as bigint) * 7
    + cast(round((lat - (-30 + (cast(user_id as bigint) * 37) % 60)) / 0.02) as bigint))
    % (select count(*) from supplier) as varchar) as geom_id
from timed
"""

CTES["home_days"] = """
select user_id, cluster_label, date_trunc, sum(duration) as duration, sum(total_pings_stop) as total_pings_stop
from pieces where t_start_hour >= 23 or t_end_hour <= 5 group by all
"""
CTES["home_evidence"] = """
select * from (
  select *, count(*) over w as days_count,
    case when count(*) over w >= 2 then sum(duration) over w end as duration_cum,
    case when count(*) over w >= 2 then sum(total_pings_stop) over w end as total_pings_cum
  from home_days
  window w as (partition by user_id, cluster_label order by date_trunc
               range between interval 13 days preceding and current row))
where total_pings_cum > 2
"""
CTES["home_picks"] = """
select user_id, date_trunc, min(cluster_label) as cluster_label from home_evidence group by user_id, date_trunc
"""


def _fill(picks: str) -> str:
    """Every day between a user's first and last pick, with the nearest pick; the earlier one on a tie."""
    return f"""
select user_id, day as date_trunc, arg_min(cluster_label, (gap, late)) as cluster_label, min(gap) = 0 as observed
from (select s.user_id, s.day, p.cluster_label, abs(date_diff('day', p.date_trunc, s.day)) as gap,
        case when p.date_trunc > s.day then 1 else 0 end as late
      from (select user_id, cast(unnest(generate_series(min(date_trunc), max(date_trunc), interval 1 day)) as date) as day
            from {picks} group by user_id) s join {picks} p using (user_id))
group by user_id, day
"""


CTES["home_filled"] = _fill("home_picks")
CTES["homes"] = """
select p.*, case when f.cluster_label is null then 'O' else 'H' end as location_type,
  case when f.observed then p.cluster_label else -1 end as home_label, -1 as work_label
from pieces p left join home_filled f using (user_id, cluster_label, date_trunc)
"""
CTES["work_days"] = """
select user_id, cluster_label, date_trunc, sum(duration) as duration, sum(total_pings_stop) as total_pings_stop
from pieces p where t_start_hour >= 9 and t_end_hour <= 17 and weekday not in (1, 7)
  and (user_id, cluster_label) not in (select (user_id, cluster_label) from homes where location_type = 'H')
group by all
"""
CTES["work_evidence"] = """
select * from (
  select *, case when count(*) over w >= 5 then avg(duration) over w end as duration_average from work_days
  window w as (partition by user_id, cluster_label order by date_trunc
               range between interval 27 days preceding and current row))
where duration_average >= 60
"""
CTES["work_picks"] = """
select user_id, date_trunc, min(cluster_label) as cluster_label from work_evidence group by user_id, date_trunc
"""
CTES["work_filled"] = _fill("work_picks")
CTES["labelled"] = """
select h.* replace (
    case when f.cluster_label is not null then 'W' else h.location_type end as location_type,
    case when e.cluster_label is not null then h.cluster_label else -1 end as work_label)
from homes h
left join work_filled f using (user_id, cluster_label, date_trunc)
left join work_evidence e using (user_id, cluster_label, date_trunc)
"""

CTES["budgets"] = """
select user_id, date_trunc, day_night, h / total as "H", w / total as "W", o / total as "O",
  h as "absolute_H", w as "absolute_W", o as "absolute_O"
from (
  select user_id, date_trunc, case when hour(date) >= 5 and hour(date) < 23 then 'day' else 'night' end as day_night,
    cast(sum(duration) filter (where location_type = 'H') as bigint) as h,
    cast(sum(duration) filter (where location_type = 'W') as bigint) as w,
    cast(sum(duration) filter (where location_type = 'O') as bigint) as o
  from labelled group by all)
join (select user_id, date_trunc, sum(duration) as total from labelled group by all) using (user_id, date_trunc)
"""
CTES["activity"] = f"""
select user_id, count(distinct date_trunc) filter (where date_trunc < date '{SPLIT}') as pre,
  count(distinct date_trunc) filter (where date_trunc >= date '{SPLIT}') as post, count(distinct date_trunc) as tot
from budgets where date_trunc < date '{END}' group by user_id
"""
CTES["active"] = f"""
select * from activity where pre >= {ACTIVE_SHARE} * (select max(pre) from activity)
  and tot >= {ACTIVE_SHARE} * (select max(tot) from activity)
"""
CTES["daily"] = """
select user_id, date_trunc as date, "H", case when "W" is null and "O" is null then 1 else 0 end as "R", "W",
  case when "W" is null then 0 else 1 end as "C", "O"
from (select user_id, date_trunc, sum("H") as "H", sum("W") as "W", sum("O") as "O" from budgets group by all)
where user_id in (select user_id from active)
"""


def _modal(kind: str, more: str, name: str) -> str:
    return f"""
select user_id, geom_id as {name} from (
  select user_id, geom_id, row_number() over (partition by user_id order by count(distinct date_trunc) desc, geom_id) as r
  from labelled where location_type = '{kind}' {more} group by user_id, geom_id)
where r = 1
"""


CTES["modal_home"] = _modal("H", f"and date_trunc <= date '{SPLIT}'", "geom_id_home")
CTES["modal_work"] = _modal("W", "", "geom_id_work")
CTES["metrics"] = "select * from daily left join modal_home using (user_id) left join modal_work using (user_id)"


def _admins(country: str) -> str:
    return f"""
select {country} as country, 'g' || cast(s_suppkey as varchar) as geom_id,
  case when s_nationkey % 2 = 0 then n_name end as metro_area_name,
  cast(1000 + (s_suppkey * 37) % 5000 as double) as pop, cast(s_acctbal as double) as wealth_index
from supplier join nation on s_nationkey = n_nationkey
"""


CTES["admins"] = _admins("'XX'")
CTES["admins3"] = _admins("'C' || cast(s_suppkey % 3 as varchar)")


def _percentile(source: str, keys: str) -> str:
    known = "".join(f" and {k.strip()} is not null" for k in keys.split(","))
    return f"""
select {keys}, geom_id, pop, wealth_index,
  sum(pop) over (partition by {keys} order by wealth_index desc, geom_id rows unbounded preceding)
    / sum(pop) over (partition by {keys}) as pct_wealth
from {source} where pop is not null and wealth_index is not null{known}
"""


def bin_case(value: str) -> str:
    whens = " ".join(f"when {value} > {low} and {value} <= {high} then '{name}'"
                     for low, high, name in zip(BINS, BINS[1:], LABELS))
    return f"case {whens} end"


CTES["wealth"] = _percentile("admins", "country")
CTES["wealth3"] = _percentile("admins3", "country")
CTES["wealth_metro"] = _percentile("admins", "country, metro_area_name")
CTES["wealth_labels"] = f"select *, {bin_case('pct_wealth')} as wealth_label from wealth"
CTES["metro_labels"] = f"select *, {bin_case('pct_wealth')} as wealth_label from wealth_metro"
CTES["metro_pop"] = """
select country, metro_area_name, sum(pop) as pop from admins
where metro_area_name is not null and pop is not null and wealth_index is not null group by all
"""
CTES["main_units"] = """
select * from metro_labels
where metro_area_name = (select metro_area_name from metro_pop order by pop desc, metro_area_name limit 1)
"""
CTES["unit_kind"] = """
select geom_id, case when metro_area_name is null then 'rural' else 'urban' end as urban_rural from admins
"""


def _with_weight(source: str) -> str:
    return f"""
select j.*, n_users, pop_home / n_users as weight from {source} j
join (select geom_id_home, count(distinct user_id) as n_users from {source} group by all) using (geom_id_home)
"""


CTES["at_home"] = """
select m.*, w.pop as pop_home, w.pct_wealth as pct_wealth_home, w.wealth_label as wealth_label_home
from metrics m join wealth_labels w on w.geom_id = m.geom_id_home
"""
CTES["at_both"] = """
select h.*, w.pct_wealth as pct_wealth_work, w.wealth_label as wealth_label_work
from at_home h join wealth_labels w on w.geom_id = h.geom_id_work
"""
CTES["by_home"] = _with_weight("at_home")
CTES["by_both"] = _with_weight("at_both")


def _indicator(source: str, column: str, keys: str) -> str:
    return f"""
select date, {keys}, sum(coalesce("{column}", 0) * weight) / sum(weight) as mean,
  stddev_samp(coalesce("{column}", 0)) / sqrt(count(*)) as sem, count(*) as n, count(distinct user_id) as n_unique
from {source} group by all
"""


for _name, _column in HOME_MEASURES:
    CTES[f"series_{_column.lower()}"] = _indicator("by_home", _column, "wealth_label_home")
CTES["series_hw"] = _indicator("by_both", "C", "wealth_label_home, wealth_label_work")
CTES["results"] = " union all ".join(
    [f"select '{name}' as measure, date, wealth_label_home, mean, sem, n, n_unique, null::varchar as wealth_label_work,"
     f" 'XX' as state from series_{column.lower()}" for name, column in HOME_MEASURES]
    + ["select 'comms_hw', date, wealth_label_home, mean, sem, n, n_unique, wealth_label_work, 'XX' from series_hw"])


def _baseline(source: str, value: str, groups: list[str]) -> str:
    """``base``: the weekday mean of ``value`` in the baseline period, per group."""
    same = "".join(f" and b.{g} is not distinct from s.{g}" for g in groups)
    return f"""
select s.*, (select avg({value}) from {source} b where b.date between date '{BASE_FROM}' and date '{BASE_TO}'
  and isodow(b.date) = isodow(s.date){same}) as base from {source} s
"""


def _change(source: str, groups: list[str]) -> str:
    return f"""
select * exclude (base) replace (case when base <> 0 then (mean - base) / abs(base) end as mean,
                                 case when base <> 0 then abs(sem / base) end as sem)
from ({_baseline(source, 'mean', groups)})
"""


def _wide(rows: str, label: str) -> str:
    means = ", ".join(f"max(mean) filter (where {label} = '{x}') as {x}" for x in LABELS)
    sems = ", ".join(f"max(sem) filter (where {label} = '{x}') as \"{x}_StdErr\"" for x in LABELS)
    return f"select date, {means}, {sems} from ({rows}) group by date"


CTES["wide_home"] = _wide(_change("series_h", ["wealth_label_home"]), "wealth_label_home")
CTES["wide_other"] = _wide(_change("series_o", ["wealth_label_home"]), "wealth_label_home")
CTES["first_hw"] = f"select * from series_hw where wealth_label_home = '{LABELS[0]}'"
CTES["wide_hw"] = _wide(_change("first_hw", ["wealth_label_home", "wealth_label_work"]), "wealth_label_work")

CTES["home_in_metro"] = """
select user_id, geom_id from (
  select user_id, geom_id, row_number() over (partition by user_id order by count(distinct date_trunc) desc, geom_id) as r
  from labelled where location_type = 'H' and user_id in (select user_id from active)
    and geom_id in (select geom_id from main_units) group by user_id, geom_id)
where r = 1
"""
CTES["residents"] = """
select h.user_id, 'XX' as country, m.metro_area_name, m.pop, m.wealth_index, m.pct_wealth, m.wealth_label
from home_in_metro h join main_units m using (geom_id)
"""
CTES["move_steps"] = """
select l.user_id, l.t_start, l.date_trunc as seen, l.geom_id, u.urban_rural, lag(l.geom_id) over w as prev_geom_id,
  lag(u.urban_rural) over w as prev_urban_rural, date_diff('day', lag(l.date_trunc) over w, l.date_trunc) as gap
from labelled l join unit_kind u using (geom_id) where l.location_type = 'H'
window w as (partition by l.user_id order by l.date_trunc, l.t_start)
"""
CTES["moves"] = """
select *, cast(seen - cast(back as integer) as date) as date_trunc, -back as rand_gap from (
  select *, case when urban_rural = prev_urban_rural then 'no change'
                 when urban_rural = 'urban' then 'rural to urban' else 'urban to rural' end as change,
    cast('0x' || substr(md5('0|' || user_id || '|' || cast(seen as varchar) || '|' || cast(t_start as varchar)), 1, 7)
         as bigint) % greatest(gap - 1, 1) as back
  from move_steps where prev_geom_id is not null)
"""
CTES["movers"] = """
select m.date_trunc as date, r.wealth_label, m.change, count(distinct m.user_id) as n_users, 'XX' as country
from moves m join residents r using (user_id) group by all
"""
CTES["rural_movers"] = """
select m.date_trunc as date, r.wealth_label, m.change, count(distinct m.user_id) as n_users, 'XX' as country
from moves m join residents r using (user_id)
where m.user_id in (select l.user_id from labelled l join unit_kind u using (geom_id)
                    where l.location_type = 'H' and u.urban_rural = 'rural')
group by all
"""
CTES["mover_shares"] = f"""
select *, sum(n_users) over (partition by wealth_label) as tot_users,
  n_users * 100.0 / sum(n_users) over (partition by wealth_label) as users_fraction,
  sum(n_users) over (partition by wealth_label, change order by date rows unbounded preceding) as n_users_cumsum
from movers where date < date '{END}'
"""
CTES["net_steps"] = """
select wealth_label, date, max(n_users_cumsum) filter (where change = 'urban to rural') as r,
  max(n_users_cumsum) filter (where change = 'rural to urban') as u from mover_shares group by all
"""


def _filled(column: str) -> str:
    def at(pick: str, side: str) -> str:
        return (f"(select {pick}(x.{column}, x.date) from net_steps x where x.wealth_label = s.wealth_label"
                f" and x.date {side} s.date and x.{column} is not null)")
    return f"coalesce({at('arg_min', '>=')}, {at('arg_max', '<=')})"


CTES["net_rural"] = f"""
select f.wealth_label, f.date, to_rural, to_urban, to_rural - to_urban as net_rural, n_label_users,
  (to_rural - to_urban) * 100.0 / n_label_users as net_rural_fraction
from (select s.wealth_label, s.date, {_filled('r')} as to_rural, {_filled('u')} as to_urban from net_steps s) f
join (select wealth_label, count(distinct user_id) as n_label_users from residents group by all) using (wealth_label)
"""
CTES["net_based"] = _baseline("net_rural", "net_rural_fraction", ["wealth_label"])
CTES["net_wide"] = "select date, " + ", ".join(
    f"max(net_rural_fraction - base) filter (where wealth_label = '{x}') as {x}" for x in LABELS
) + ", 'XX' as state from net_based group by date"


def _smooth(source: str, rows: int, needed: int, inside: str, after: str) -> str:
    names = [*LABELS, *[f"{x}_StdErr" for x in LABELS]]
    smooth = ", ".join(f'case when count("{c}") over w >= {needed} then avg("{c}") over w end as "{c}"' for c in names)
    bands = ", ".join(f'"{c}" - 2 * "{c}_StdErr" as "{c}_lower", "{c}" + 2 * "{c}_StdErr" as "{c}_upper"' for c in LABELS)
    return f"""
select *, {bands} from (select date, {smooth} from {source} where {inside}
  window w as (order by date rows between {rows // 2} preceding and {(rows - 1) // 2} following)) where {after}
"""


def _smooth_migration(divisor: str) -> str:
    means = ", ".join(f"avg({c}) over w as {c}" for c in LABELS)
    sems = ", ".join(f'stddev_samp({c}) over w / sqrt({divisor.format(c=c)}) as "{c}_StdErr"' for c in LABELS)
    bands = ", ".join(f'{c} - 2 * "{c}_StdErr" as "{c}_lower", {c} + 2 * "{c}_StdErr" as "{c}_upper"' for c in LABELS)
    return f"""
select *, {bands} from (select state, date, {means}, {sems} from net_wide where date <= date '{CROP_TO}'
  window w as (order by date rows between {WINDOW // 2} preceding and {(WINDOW - 1) // 2} following))
where date >= date '{CROP_FROM}'
"""


IN_CROP = f"date between date '{CROP_FROM}' and date '{CROP_TO}'"
CTES["smooth_home"] = _smooth("wide_home", WINDOW, WINDOW, "true", IN_CROP)
CTES["smooth_other"] = _smooth("wide_other", 28, 1, IN_CROP, "true")
CTES["smooth_moves"] = _smooth_migration("count({c}) over w")
CTES["smooth_moves_pandas"] = _smooth_migration("nullif(count({c}) over w - 1, 0)")


# What hangs on the admin units, once more for each country of the three-country table.
_BY_COUNTRY = ["admins", "wealth_metro", "metro_labels", "metro_pop", "main_units", "home_in_metro", "residents", "unit_kind",
               "move_steps", "moves", "movers"]


def _of_country(sql: str, k: int) -> str:
    named = re.sub(rf"\b({'|'.join(_BY_COUNTRY)})\b", rf"\1_c{k}", sql)
    return named.replace("'XX'", f"'C{k}'")


for _k in range(3):
    for _name in _BY_COUNTRY:
        CTES[f"{_name}_c{_k}"] = (f"select * from admins3 where country = 'C{_k}'" if _name == "admins"
                                  else _of_country(CTES[_name], _k))


# And for countries that have users of their own, and units whose ids collide with those of others.
_KEYED = ["labelled", "budgets", "activity", "active", *_BY_COUNTRY, "rural_movers"]
_UNIT_OF = "'g' || cast(cast(substr(geom_id, 2) as bigint) // 3 as varchar)"
for _k in range(3):
    for _name in _KEYED:
        _sql = re.sub(rf"\b({'|'.join(_KEYED)})\b", rf"\1_k{_k}", CTES[_name]).replace("'XX'", f"'C{_k}'")
        CTES[f"{_name}_k{_k}"] = _sql.replace(str(ACTIVE_SHARE), str(ACTIVE_SHARE_C2)) if _k == 2 else _sql
    CTES[f"labelled_k{_k}"] = (
        f"select * replace ({_UNIT_OF} as geom_id) from labelled where cast(user_id as bigint) % 3 = {_k}")
    CTES[f"budgets_k{_k}"] = f"select * from budgets where cast(user_id as bigint) % 3 = {_k}"
    CTES[f"admins_k{_k}"] = f"select * replace ({_UNIT_OF} as geom_id) from admins3 where country = 'C{_k}'"


def _keyed(name: str, more: str = "") -> str:
    return " union all ".join(f"select *{more.format(k=k)} from {name}_k{k}" for k in range(3))


def _countries(name: str) -> str:
    return " union all ".join(f"select * from {name}_c{k}" for k in range(3))


def statement(sql: str) -> str:
    """``sql`` with the common table expressions it needs, in dependency order."""
    ordered: list[str] = []

    def visit(text: str, inside: str | None) -> None:
        for name in CTES:
            if name != inside and name not in ordered and re.search(rf"\b(from|join)\s+{name}\b", text):
                visit(CTES[name], name)
                if name not in ordered:
                    ordered.append(name)

    visit(sql, None)
    if not ordered:
        return sql
    head = ",\n".join(f"{name} as {'' if _recursive(name) else 'materialized '}({CTES[name].strip()})" for name in ordered)
    return f"with recursive {head}\n{sql.strip()}"


def _recursive(name: str) -> bool:
    return bool(re.search(rf"\bfrom\s+{name}\b", CTES[name]))


# Column kinds of the compared output: s text, i whole number, f rounded double, d day, t second.
_KINDS = {"s": "{c}", "i": "cast({c} as bigint)", "f": "round(cast({c} as double), 6) + 0.0",
          "d": "strftime({c}, '%Y-%m-%d')", "t": "strftime({c}, '%Y-%m-%d %H:%M:%S')"}


def show(source: str, spec: str) -> str:
    """Select ``spec``, a list of ``kind:column`` items, from a table or subquery."""
    items = []
    for item in spec.split():
        kind, column = item.split(":")
        items.append(f'{_KINDS[kind].format(c=chr(34) + column + chr(34))} as "{column}"')
    table = source if re.fullmatch(r"\w+", source) else f"({source})"
    return statement(f"select {', '.join(items)} from {table}")


_STOP = "s:user_id i:t_start i:t_end f:lat f:lon f:median_accuracy i:total_pings_stop"
_PLACE = f"{_STOP} i:cluster_label"
_PIECE = f"{_PLACE} i:total_duration_stop_location i:duration"
_TIMED = f"{_PIECE} t:date d:date_trunc i:t_start_hour i:t_end_hour i:weekday"
_LABELLED = f"{_TIMED} s:geom_id s:location_type i:home_label i:work_label"
_EVIDENCE = "s:user_id i:cluster_label d:date_trunc i:duration i:total_pings_stop"
_BUDGET = "s:user_id d:date_trunc s:day_night f:H f:W f:O i:absolute_H i:absolute_W i:absolute_O"
_METRICS = "s:user_id d:date f:H i:R f:W i:C f:O"
_UNIT = "s:country s:geom_id f:pop f:wealth_index f:pct_wealth"
_HOME = f"{_METRICS} s:geom_id_home s:geom_id_work f:pop_home f:pct_wealth_home s:wealth_label_home i:n_users f:weight"
_SERIES = "f:mean f:sem i:n i:n_unique"
_LABELS = " ".join(f"f:{x}" for x in LABELS)
_ERRORS = " ".join(f"f:{x}_StdErr" for x in LABELS)
_BANDS = " ".join(f"f:{x}_lower f:{x}_upper" for x in LABELS)
_RESIDENT = "s:user_id s:country s:metro_area_name f:pop f:wealth_index f:pct_wealth s:wealth_label"
_MOVERS = "d:date s:wealth_label s:change i:n_users s:country"


def _share(source: str) -> str:
    return (f"select country, hour(make_timestamp(epoch_time * 1000000)) as hour, count(*) as pings,"
            f" count(*) * 100.0 / sum(count(*)) over (partition by country) as pct from {source} group by 1, 2")


def oracle_sql() -> dict[str, str]:
    outside = "select count(*) from pings where not coalesce({c} > -{b} and {c} < {b}, false)"
    reach_days = "p.date_trunc between v.date_trunc - 14 and v.date_trunc"
    return {
        "a1_read_pings": show("pings", "s:user_id i:ping_id i:epoch_time f:lat f:lon f:accuracy s:country"),
        "a4_read_admins": show("admins", "s:country s:geom_id s:metro_area_name f:pop f:wealth_index"),
        "a3_labelled_stage": show("select *, 'XX' as country from labelled", f"{_LABELLED} s:country"),
        "a3_budget_stage": show("select *, 'XX' as country from budgets", f"{_BUDGET} s:country"),
        "a5_two_countries": show("pings", "s:user_id i:ping_id i:epoch_time f:lat f:lon f:accuracy s:country"),
        "a5_stage_round_trip": show("pings", "s:user_id i:ping_id i:epoch_time f:lat f:lon f:accuracy s:country"),
        "b1_validate": show(
            "select 'lat_range' as rule, (" + outside.format(c="lat", b=90) + ") as violations, (select count(*) from pings)"
            " as pings union all select 'lon_range', (" + outside.format(c="lon", b=180) + "), (select count(*) from pings)"
            " union all select 'time_order', (select count(*) from (select epoch_time - lag(epoch_time) over"
            " (partition by user_id order by epoch_time, ping_id) as gap from pings) where gap < 1),"
            " (select count(*) from pings) union all select 'user_known', (select count(*) from pings where user_id is null),"
            " (select count(*) from pings) union all select 'time_known', (select count(*) from pings where epoch_time is null),"
            " (select count(*) from pings)", "s:rule i:violations i:pings"),
        "b1_drop_invalid": show(
            "select * replace (lat * 3 as lat, lon * 2 as lon) from pings where lat * 3 > -90 and lat * 3 < 90"
            " and lon * 2 > -180 and lon * 2 < 180", "s:user_id i:ping_id i:epoch_time f:lat f:lon f:accuracy s:country"),
        "b2_localise": show("local_pings", "s:user_id i:ping_id i:epoch_time"),
        "b3_top_user": show(
            "select country, user_id, observations, lat, lon from (select country, user_id, count(*) as observations,"
            " arg_min(lat, (epoch_time, ping_id)) as lat, arg_min(lon, (epoch_time, ping_id)) as lon,"
            " row_number() over (partition by country order by count(*) desc, user_id) as r"
            " from pings group by country, user_id) where r = 1", "s:country s:user_id i:observations f:lat f:lon"),
        "b4_hour_share": show(_share("pings"), "s:country i:hour i:pings f:pct"),
        "b4_hour_share_local": show(_share("local_pings"), "s:country i:hour i:pings f:pct"),
        "b5_accurate_stops": show("stops", _STOP),
        "b6_label_columns": show("labelled", _LABELLED),
        "c1_sessions": show("sessions", "s:user_id i:ping_id i:session_id"),
        "c2_stops": show("stops_all", _STOP),
        "c2_stops_split_users": show("stops_all", _STOP),
        "c2_stops_noisy": show("stops_all_hard", _STOP),
        "c3_stops_noisy": show("stops_all_untimed_exact", _STOP),
        "c2_stops_one_device": show("stops_all_device", _STOP),
        "c2_stops_through_days": show("stops_all_device_wide", _STOP),
        "c2_ping_labels_noisy": show("ping_labels_hard", "s:user_id i:ping_id i:stop"),
        "c3_ping_labels_noisy": show("ping_labels_untimed_exact", "s:user_id i:ping_id i:stop"),
        "c5_group_medians": show("select country, median(lat) as median from pings_hard group by country", "s:country f:median"),
        "c9_recluster_all": show(
            "select *, t_end - t_start as total_duration_stop_location, t_end - t_start as duration from clustered_hard", _PIECE),
        "c9_recluster_earlier": show(
            "select *, t_end - t_start as total_duration_stop_location, t_end - t_start as duration from clustered_hard", _PIECE),
        "c6_clusters_chained": show("clustered_hard", _PLACE),
        "c9_recluster_chained": show(
            "select *, t_end - t_start as total_duration_stop_location, t_end - t_start as duration from clustered_hard", _PIECE),
        "c2_ping_labels": show("ping_labels", "s:user_id i:ping_id i:stop"),
        "c3_stops_untimed": show("stops_all_untimed", _STOP),
        "c5_stops_all_accuracies": show(
            "select * replace (full_accuracy as median_accuracy) from stops_all", _STOP),
        "c6_clusters": show("clustered", _PLACE),
        "c7_stop_locations": show("clustered", _PLACE),
        "c9_recluster": show(
            "select *, t_end - t_start as total_duration_stop_location, t_end - t_start as duration from clustered", _PIECE),
        "c9_recluster_touched": show(
            "select *, t_end - t_start as total_duration_stop_location, t_end - t_start as duration from clustered", _PIECE),
        "c10_day_split": show("day_cut", _PIECE),
        "c11_time_fields": show("timed", _TIMED),
        "c12_mode_label": show(
            "select user_id, cluster_label as most_frequent_label from (select user_id, cluster_label, row_number() over"
            " (partition by user_id order by count(*) desc, cluster_label) as r from clustered group by 1, 2) where r = 1",
            "s:user_id i:most_frequent_label"),
        "d2_night_pieces": show(
            "select * from pieces where t_start_hour >= 23 or t_end_hour <= 5", "s:user_id i:t_start i:cluster_label"),
        "d3_home_evidence": show("home_evidence", f"{_EVIDENCE} i:days_count i:duration_cum i:total_pings_cum"),
        "d4_daily_home": show("home_picks", "s:user_id d:date_trunc i:cluster_label"),
        "d5_home_days": show("home_filled", "s:user_id d:date_trunc i:cluster_label i:observed"),
        "d6_home": show("homes", _LABELLED),
        "d7_work_hours": show(
            "select * from homes h where t_start_hour >= 9 and t_end_hour <= 17 and weekday not in (1, 7) and not exists"
            " (select 1 from homes o where o.user_id = h.user_id and o.cluster_label = h.cluster_label"
            " and o.location_type = 'H')", "s:user_id i:t_start i:cluster_label"),
        "d10_work_days": show("work_filled", "s:user_id d:date_trunc i:cluster_label i:observed"),
        "d8_work_evidence": show("work_evidence", f"{_EVIDENCE} f:duration_average"),
        "d11_work": show("labelled", _LABELLED),
        "d12_labels": show("labelled", _LABELLED),
        "d13_day_share": show(
            "select user_id, cluster_label, date_trunc, sum(duration) as duration, sum(duration) / sum(sum(duration)) over"
            " (partition by user_id, date_trunc) as day_share from pieces group by 1, 2, 3",
            "s:user_id i:cluster_label d:date_trunc i:duration f:day_share"),
        "d14_active_share": show(
            "select *, cluster_days / active_days as active_day_share from (select v.*,"
            f" (select count(distinct date_trunc) from pieces p where p.user_id = v.user_id and {reach_days}"
            f" and p.cluster_label = v.cluster_label) as cluster_days, (select count(distinct date_trunc) from pieces p"
            f" where p.user_id = v.user_id and {reach_days}) as active_days"
            " from (select distinct user_id, cluster_label, date_trunc from pieces) v)",
            "s:user_id i:cluster_label d:date_trunc i:cluster_days i:active_days f:active_day_share"),
        "d15_start_hours": show(
            "select location_type, weekday, t_start_hour, count(*) as pieces from labelled where t_start_hour <> 0"
            " group by all", "s:location_type i:weekday i:t_start_hour i:pieces"),
        "e1_budget": show("budgets", _BUDGET),
        "e2_active": show("active", "s:user_id i:pre i:post i:tot"),
        "e3_daily": show("daily", _METRICS),
        "e4_modal_home": show("modal_home", "s:user_id s:geom_id_home"),
        "e4_modal_work": show("modal_work", "s:user_id s:geom_id_work"),
        "e5_attach": show("metrics", f"{_METRICS} s:geom_id_home s:geom_id_work"),
        "f1_wealth_country": show("wealth", _UNIT),
        "f1_wealth_countries": show("wealth3", _UNIT),
        "f1_wealth_metro": show("wealth_metro", f"{_UNIT} s:metro_area_name"),
        "f2_urban_rural_units": show("unit_kind", "s:geom_id s:urban_rural"),
        "f3_metro_pop": show("metro_pop", "s:country s:metro_area_name f:pop"),
        "f3_main_metro": show(
            "select country, metro_area_name from (select country, metro_area_name, row_number() over (partition by country"
            " order by sum(pop) desc, metro_area_name) as r from admins3 where metro_area_name is not null"
            " and pop is not null and wealth_index is not null group by 1, 2) where r = 1", "s:country s:metro_area_name"),
        "f4_bins": show("wealth_labels", f"{_UNIT} s:wealth_label"),
        "f5_metro_units": show("metro_labels", f"{_UNIT} s:metro_area_name s:wealth_label"),
        "f6_urban_rural": show(
            "select l.user_id, l.t_start, l.cluster_label, l.geom_id, u.urban_rural from labelled l join unit_kind u"
            " using (geom_id)", "s:user_id i:t_start i:cluster_label s:geom_id s:urban_rural"),
        "g1_weights": show("by_home", _HOME),
        "g2_weights_hw": show("by_both", f"{_HOME} f:pct_wealth_work s:wealth_label_work"),
        "g3_indicator": show("series_h", f"d:date s:wealth_label_home {_SERIES}"),
        "g4_indicator_hw": show("series_hw", f"d:date s:wealth_label_home s:wealth_label_work {_SERIES}"),
        "g4_results": show("results", f"s:measure d:date s:wealth_label_home s:wealth_label_work {_SERIES} s:state"),
        "g5_change": show(_change("series_h", ["wealth_label_home"]), f"d:date s:wealth_label_home {_SERIES}"),
        "g5_change_shared": show(_change("series_o", []), f"d:date s:wealth_label_home {_SERIES}"),
        "g6_diff": show(
            "select date, wealth_label_home, n_unique - base as mean, sem, n from ("
            + _baseline("series_h", "n_unique", ["wealth_label_home"]) + ")", "d:date s:wealth_label_home f:mean f:sem i:n"),
        "g7_wide": show("select *, 't_home' as metric, 'XX' as state from wide_home",
                        f"d:date {_LABELS} {_ERRORS} s:metric s:state"),
        "g7_wide_hw": show("select *, 'comms_hw' as metric, 'XX' as state from wide_hw",
                           f"d:date {_LABELS} {_ERRORS} s:metric s:state"),
        "g7_range": show(
            "select 't_other' as metric, 'XX' as state, min(least(" + ", ".join(LABELS) + ")) as lowest, max(greatest("
            + ", ".join(LABELS) + ")) as highest from (select " + ", ".join(
                f"case when count({x}) over w = {WINDOW} then avg({x}) over w end as {x}" for x in LABELS)
            + f" from wide_other where date between date '{RANGE_FROM}' and date '{RANGE_TO}'"
            + f" window w as (order by date rows {WINDOW - 1} preceding))", "s:metric s:state f:lowest f:highest"),
        "g8_smooth": show("select *, 't_home' as metric, 'XX' as state from smooth_home",
                          f"s:metric s:state d:date {_LABELS} {_ERRORS} {_BANDS}"),
        "g8_smooth_partial": show("select *, 't_other' as metric, 'XX' as state from smooth_other",
                                  f"s:metric s:state d:date {_LABELS} {_ERRORS} {_BANDS}"),
        "h1_metro_residents": show(
            "select user_id, t_start, cluster_label from labelled where user_id in (select user_id from active) and user_id in"
            " (select user_id from labelled where location_type = 'H' and geom_id in (select geom_id from main_units))",
            "s:user_id i:t_start i:cluster_label"),
        "h2_home_unit": show("residents", _RESIDENT),
        "h2_home_unit_countries": show(_countries("residents"), _RESIDENT),
        "h6_city_countries": show(_countries("movers"), _MOVERS),
        "h3_user_info": show("select * from residents join active using (user_id)", f"{_RESIDENT} i:pre i:post i:tot"),
        "h4_moves": show("moves", "s:user_id i:t_start s:geom_id s:prev_geom_id s:urban_rural s:prev_urban_rural s:change"
                                  " i:gap i:rand_gap d:date_trunc"),
        "h5_mover_counts": show("movers", _MOVERS),
        "h6_city": show("movers", _MOVERS),
        "h7_country": show("rural_movers", _MOVERS),
        "e2_active_countries": show(_keyed("active", ", 'C{k}' as country"), "s:country s:user_id i:pre i:post i:tot"),
        "h6_city_colliding_ids": show(_keyed("movers"), _MOVERS),
        "h7_country_countries": show(_keyed("rural_movers"), _MOVERS),
        "h8_mover_shares": show("mover_shares", f"{_MOVERS} i:tot_users f:users_fraction i:n_users_cumsum"),
        "h8_net_rural": show("net_rural", "s:wealth_label d:date i:to_rural i:to_urban i:net_rural i:n_label_users"
                                          " f:net_rural_fraction"),
        "h8_net_rural_wide": show("net_wide", f"d:date {_LABELS} s:state"),
        "h9_smooth": show("smooth_moves", f"s:state d:date {_LABELS} {_ERRORS} {_BANDS}"),
        "h9_smooth_pandas_sem": show("smooth_moves_pandas", f"s:state d:date {_LABELS} {_ERRORS} {_BANDS}"),
    }
