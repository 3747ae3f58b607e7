"""SQL text that states the expected result of the catalogue queries."""

from __future__ import annotations

from failcast.operators import bagging
from failcast.schema import SEED, SENSORS

_PANEL = """
days as (
  select l_suppkey as ID, cast(l_shipdate as date) as DATE,
    max(r_name) as REGION_CLUSTER, 'V' || cast(max(l_suppkey % 5) as varchar) as MAINTENANCE_VENDOR,
    max(n_name) as MANUFACTURER, cast(max(l_suppkey % 8) as integer) as WELL_GROUP,
    max(l_quantity) as S5, max(l_discount) as S8, max(l_tax) as S13,
    case when min(l_quantity) > 40 then null else min(l_quantity) end as S15,
    max(l_extendedprice) as S16, min(l_extendedprice) as S17,
    cast(count(*) as double) as S18, min(l_discount) as S19,
    max(case when l_returnflag = 'R' and l_quantity >= 49 and l_discount >= 0.08 then 1 else 0 end)
      as EQUIPMENT_FAILURE
  from lineitem join supplier on l_suppkey = s_suppkey
    join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
  where l_shipdate is not null
  group by l_suppkey, cast(l_shipdate as date)),
log as (
  select *, cast(date_diff('day', min(DATE) over (partition by ID), DATE) as double) as AGE_OF_EQUIPMENT
  from days)"""

_RUL = _PANEL + """,
ff as (select ID, min(DATE) as FIRST_FAILURE_DATE from log where EQUIPMENT_FAILURE = 1 group by ID),
rul as (
  select log.*, FIRST_FAILURE_DATE, cast(date_diff('day', DATE, FIRST_FAILURE_DATE) as integer) as RUL_DAYS
  from log join ff using (ID) where DATE <= FIRST_FAILURE_DATE)"""

_EPOCH = "cast(date_diff('day', date '1970-01-01', DATE) as double)"

_SPLIT = _RUL + f""",
cut as (select quantile_cont({_EPOCH}, 0.7) as c1, quantile_cont({_EPOCH}, 0.85) as c2 from rul),
sp as (
  select rul.*, case when {_EPOCH} <= c1 then 'train' when {_EPOCH} <= c2 then 'val' else 'test' end as split,
    case when RUL_DAYS = 0 then 0 when RUL_DAYS between 1 and 7 then 1
         when RUL_DAYS between 8 and 30 then 2 else 3 end as true_class
  from rul, cut)"""

_WIDE = _SPLIT + """,
wide as (
  select ID, DATE, split, RUL_DAYS, true_class,
    ((S5 * 7 + S18 * 13 + dayofyear(DATE)) % 97) / 100 as p_now,
    ((S5 * 3 + S18 * 11 + dayofyear(DATE) * 2) % 89) / 100 as p_le7,
    ((S5 * 5 + S18 * 3 + dayofyear(DATE) * 3) % 101) / 100 as p_le30,
    (S5 * 7 + S18 * 13 + dayofyear(DATE)) % 120 as RUL_PRED
  from sp)"""

_LONG = _WIDE + """,
long as (
  select split, 'NOW' as task, cast(RUL_DAYS <= 0 as integer) as label, p_now as score from wide
  union all select split, 'LE_7_DAYS', cast(RUL_DAYS <= 7 as integer), p_le7 from wide
  union all select split, 'LE_30_DAYS', cast(RUL_DAYS <= 30 as integer), p_le30 from wide)"""

# Threshold points of every task and split.
_POINTS = _LONG + """,
cnt as (
  select task, split, score, cast(sum(label) as bigint) as pos, count(*) as n from long group by task, split, score),
pts as (
  select *, sum(pos) over w as tp, sum(n) over w as hits,
    sum(pos) over (partition by task, split) as positives, sum(n) over (partition by task, split) as total
  from cnt window w as (partition by task, split order by score desc)),
pr as (
  select *, tp / hits as p, case when positives = 0 then 1.0 else tp / positives end as r from pts),
area as (
  select task, split,
    sum(case when positives > 0 then pos / positives * (tp / hits) else 0 end) as pr_auc,
    case when max(positives * (total - positives)) > 0
      then sum(((tp - pos) + pos / 2) * (n - pos)) / max(positives * (total - positives)) end as roc_auc
  from pts group by task, split)"""

_BETA = "case task when 'NOW' then 3.0 when 'LE_7_DAYS' then 1.5 when 'LE_30_DAYS' then 0.8 end"
_BEST = _POINTS + f""",
fb as (
  select *, {_BETA} as beta from pr),
q as (
  select *, (1 + beta * beta) * p * r / ((beta * beta * p) + r + 1e-12) as fbeta,
    (2 * p * r) / (p + r + 1e-12) as f1 from fb),
best as (
  select task, split, score as threshold, fbeta from (
    select *, row_number() over (partition by task, split order by fbeta desc, score) as rk from q) where rk = 1),
best1 as (
  select task, split, score as threshold, f1 from (
    select *, row_number() over (partition by task, split order by f1 desc, score) as rk from q) where rk = 1)"""

_CONF = _WIDE + """,
mono as (
  select *, least(p_now, p_le7, p_le30) as a from wide),
mono2 as (select *, least(greatest(p_le7, a), p_le30) as b from mono),
mono3 as (select *, greatest(p_le30, b) as c from mono2),
parts as (
  select *, a as k0, greatest(b - a, 0.0) as k1, greatest(c - b, 0.0) as k2, greatest(1.0 - c, 0.0) as k3 from mono3),
norm as (
  select *, case when k0 + k1 + k2 + k3 = 0 then 1.0 else k0 + k1 + k2 + k3 end as tot from parts),
conf as (
  select ID, DATE, split, RUL_DAYS, true_class, p_now, p_le7, p_le30,
    k0 / tot as conf_NOW, k1 / tot as conf_D1_7, k2 / tot as conf_D8_30, k3 / tot as conf_GT_30
  from norm),
chosen as (
  select *, greatest(conf_NOW, conf_D1_7, conf_D8_30, conf_GT_30) as pred_conf,
    case when conf_NOW >= greatest(conf_D1_7, conf_D8_30, conf_GT_30) then 0
         when conf_D1_7 >= greatest(conf_D8_30, conf_GT_30) then 1
         when conf_D8_30 >= conf_GT_30 then 2 else 3 end as pred_class
  from conf)"""

_CM = _CONF + """,
lab(c, name) as (values (0, 'NOW'), (1, 'D1_7'), (2, 'D8_30'), (3, 'GT_30')),
splits as (select distinct split from chosen),
cm as (
  select s.split, t.c as tc, p.c as pc,
    (select count(*) from chosen x where x.split = s.split and x.true_class = t.c and x.pred_class = p.c) as n
  from splits s, lab t, lab p),
cls as (
  select split, c, name,
    (select sum(n) from cm where cm.split = s.split and tc = c and pc = c) as tp,
    (select sum(n) from cm where cm.split = s.split and tc = c) as support,
    (select sum(n) from cm where cm.split = s.split and pc = c) as predicted
  from splits s, lab),
per as (
  select *, case when predicted = 0 then 0 else tp / predicted end as prec,
    case when support = 0 then 0 else tp / support end as rec,
    case when support + predicted = 0 then 0 else 2 * tp / (support + predicted) end as f1,
    support + predicted > 0 as seen
  from cls)"""


def _with(ctes: str, select: str) -> str:
    return "with " + ctes.strip() + "\n" + select.strip()


def _round(columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) as {c}" for c in columns.split())


def _past(s: str, w: int) -> str:
    return f"over (partition by ID order by DATE rows between {w} preceding and 1 preceding)"


def _gate(s: str, w: int, need: int, value: str) -> str:
    return f"case when count({s}) {_past(s, w)} >= {need} then {value} end"


_D = "cast(DATE as varchar) as DATE"
_ALL_LOG = (
    f"ID, {_D}, REGION_CLUSTER, MAINTENANCE_VENDOR, MANUFACTURER, WELL_GROUP, "
    "S5, S8, S13, S15, S16, S17, S18, S19, AGE_OF_EQUIPMENT, EQUIPMENT_FAILURE"
)


def _lags() -> str:
    w = "over (partition by ID order by DATE)"
    return ", ".join(
        f"lag({s}) {w} as {s}_lag1, round({s} - lag({s}) {w}, 6) as {s}_delta1" for s in SENSORS
    )


def _roll7() -> str:
    return ", ".join(
        f"round({_gate(s, 7, 2, f'avg({s}) {_past(s, 7)}')}, 6) as {s}_roll7_mean" for s in SENSORS
    )


def _roll_many() -> str:
    out = []
    for s in SENSORS:
        for w in (7, 14, 30):
            need = max(2, w // 3)
            out.append(f"round({_gate(s, w, need, f'avg({s}) {_past(s, w)}')}, 6) as {s}_roll{w}_mean")
            out.append(f"round({_gate(s, w, need, f'stddev_samp({s}) {_past(s, w)}')}, 5) as {s}_roll{w}_std")
    return ", ".join(out)


def _slopes() -> tuple[str, str]:
    at = ", ".join(
        f"cast(count({s}) over (partition by ID order by DATE rows unbounded preceding) as double) as at_{s}"
        for s in SENSORS
    )
    out = []
    for s in SENSORS:
        for w in (7, 14, 30):
            need = max(2, w // 3)
            value = _gate(s, w, need, f"regr_slope({s}, at_{s}) {_past(s, w)}")
            out.append(f"round({value}, 5) as {s}_roll{w}_slope")
    return at, ", ".join(out)


def _hash(seed: int) -> str:
    return f"substr(md5(concat_ws('|', '{seed}', cast(ID as varchar), cast(DATE as varchar))), 1, 15)"


def build() -> dict[str, str]:
    sql: dict[str, str] = {}
    sql["daily_panel"] = _with(_PANEL, f"select {_ALL_LOG} from log")
    bad_day = "(ID % 7 = 0 and day(DATE) = 13)"
    sql["parse_coerce"] = _with(
        _PANEL,
        f"""select ID, {_D}, case when ID % 5 = 0 and day(DATE) = 20 then 0 else EQUIPMENT_FAILURE end
              as EQUIPMENT_FAILURE, S15
            from log where not {bad_day}""",
    )
    sql["date_formats"] = _with(_PANEL, f"select ID, {_D}, EQUIPMENT_FAILURE from log where not {bad_day}")
    sql["csv_log"] = sql["daily_panel"]
    sql["merged_days"] = _with(_PANEL, f"select ID, {_D}, MANUFACTURER, S5, EQUIPMENT_FAILURE from log")
    sql["first_failure"] = _with(
        _RUL, "select ID, cast(FIRST_FAILURE_DATE as varchar) as FIRST_FAILURE_DATE from ff"
    )
    sql["rul_labels"] = _with(
        _RUL, f"select ID, {_D}, cast(FIRST_FAILURE_DATE as varchar) as FIRST_FAILURE_DATE, RUL_DAYS from rul"
    )
    sql["rul_clipped"] = _with(
        _RUL,
        f"""select ID, {_D}, RUL_DAYS, least(greatest(RUL_DAYS, 0), 100) as RUL_100,
              cast(RUL_DAYS <= 7 as integer) as IMMINENT_FAILURE from rul""",
    )
    sql["horizon_class"] = _with(
        _SPLIT, f"select ID, {_D}, RUL_DAYS, true_class as FAILURE_HORIZON_CLASS from sp"
    )
    sql["task_labels"] = _with(
        _RUL,
        f"""select ID, {_D}, RUL_DAYS, task, max_days, cast(RUL_DAYS <= max_days as integer) as label
            from rul, (values ('LE_0_DAYS', 0), ('LE_7_DAYS', 7), ('LE_30_DAYS', 30)) as t(task, max_days)""",
    )
    sql["advance_label_forward"] = _with(
        _PANEL,
        f"""select ID, {_D}, FAIL_WITHIN_HORIZON from (
              select *, coalesce(max(EQUIPMENT_FAILURE) over (partition by ID order by DATE
                rows between 1 following and 7 following), 0) as FAIL_WITHIN_HORIZON from log)
            where EQUIPMENT_FAILURE = 0""",
    )
    sql["advance_label_trailing"] = _with(
        _PANEL,
        f"""select ID, {_D}, FAIL_WITHIN_HORIZON from (
              select *, coalesce(max(nxt) over (partition by ID order by DATE
                rows between 6 preceding and current row), 0) as FAIL_WITHIN_HORIZON
              from (select *, lead(EQUIPMENT_FAILURE) over (partition by ID order by DATE) as nxt from log))
            where EQUIPMENT_FAILURE = 0""",
    )
    sql["lag_delta"] = _with(_RUL, f"select ID, {_D}, {_lags()} from rul")
    sql["rolling_mean_7"] = _with(_RUL, f"select ID, {_D}, {_roll7()} from rul")
    sql["rolling_mean_std_multi"] = _with(_RUL, f"select ID, {_D}, {_roll_many()} from rul")
    at, slopes = _slopes()
    sql["rolling_slope"] = _with(
        _RUL + f", placed as (select *, {at} from rul)", f"select ID, {_D}, {slopes} from placed"
    )
    sql["time_split_2way"] = _with(
        _RUL + f", cut2 as (select quantile_cont({_EPOCH}, 0.8) as c from rul)",
        f"select ID, {_D}, case when {_EPOCH} <= c then 'train' else 'test' end as split from rul, cut2",
    )
    sql["time_split_3way"] = _with(_SPLIT, f"select ID, {_D}, split from sp")
    sql["split_profile"] = _with(
        _LONG,
        """select task, split, count(*) as n, cast(sum(label) as bigint) as positives,
             round(avg(label), 6) as positive_rate from long group by task, split""",
    )
    sql["data_profile"] = _with(
        _RUL,
        """select count(*) as n_rows, count(distinct ID) as n_ids, min(least(RUL_DAYS, 100)) as min_rul,
             max(least(RUL_DAYS, 100)) as max_rul, round(avg(cast(RUL_DAYS <= 7 as integer)), 6) as positive_rate
           from rul""",
    )
    sql["class_distribution"] = _with(
        _CM,
        """select split, c as class, name, support as n, round(support / sum(support) over (partition by split), 6)
             as share from (select split, c, name, cast(support as bigint) as support from per)""",
    )
    sql["id_rate_baseline"] = _with(
        _SPLIT
        + """, tr as (select ID, avg(cast(RUL_DAYS <= 7 as integer)) as r from sp where split = 'train' group by ID),
        gl as (select avg(cast(RUL_DAYS <= 7 as integer)) as g from sp where split = 'train')""",
        f"""select sp.ID as ID, {_D}, split, round(coalesce(r, g), 6) as score
            from sp left join tr on sp.ID = tr.ID, gl""",
    )
    sql["id_mode_baseline"] = _with(
        _SPLIT
        + """, k as (select ID, true_class, count(*) as n from sp where split = 'train' group by ID, true_class),
        own as (select ID, true_class as m from (
          select *, row_number() over (partition by ID order by n desc, true_class) as rk from k) where rk = 1),
        gl as (select true_class as g from (select true_class, sum(n) as n from k group by true_class)
          order by n desc, true_class limit 1)""",
        f"""select sp.ID as ID, {_D}, split, true_class, coalesce(m, g) as pred_class
            from sp left join own on sp.ID = own.ID, gl""",
    )
    sql["global_rate_baseline"] = _with(
        _SPLIT,
        f"""select ID, {_D}, split, round((select avg(cast(RUL_DAYS <= 30 as integer)) from sp where split = 'train'), 6)
              as score from sp""",
    )
    sql["class_weights"] = _with(
        _SPLIT + ", k as (select true_class, count(*) as n from sp where split = 'train' group by true_class)",
        """select true_class as class, n, round((select sum(n) from k) / ((select count(*) from k) * n), 6) as balanced,
             round(((select sum(n) from k) - n) / greatest(n, 1), 6) as others_per_row from k""",
    )
    filled = ", ".join(
        f"round(coalesce({s}, (select median({s}) from sp where split = 'train')), 6) as {s}" for s in SENSORS
    )
    sql["impute_median"] = _with(_SPLIT, f"select ID, {_D}, split, {filled} from sp")
    parts = " union all ".join(
        f"select '{c}' as column_name, {c} as value, count(*) as n from sp where split = 'train' and {c} is not null group by {c}"
        for c in ("REGION_CLUSTER", "MAINTENANCE_VENDOR", "MANUFACTURER")
    )
    sql["impute_mode"] = _with(
        _SPLIT + f", v as ({parts})",
        """select column_name, value, n_values from (
             select *, row_number() over (partition by column_name order by n desc, value) as rk,
               count(*) over (partition by column_name) as n_values from v) where rk = 1""",
    )
    numeric = ("WELL_GROUP", "AGE_OF_EQUIPMENT", *SENSORS)
    med = ", ".join(f"(select median({c}) from sp where split = 'train') as m_{c}" for c in numeric)
    fill = ", ".join(f"coalesce(cast({c} as double), m_{c}) as f_{c}" for c in numeric)
    stat = ", ".join(f"avg(f_{c}) as a_{c}, stddev_pop(f_{c}) as s_{c}" for c in numeric)
    z = ", ".join(
        f"round((f_{c} - a_{c}) / case when s_{c} = 0 then 1 else s_{c} end, 5) as {c}" for c in numeric
    )
    sql["standardize"] = _with(
        _SPLIT
        + f""", med as (select {med}), filled as (select ID, DATE, split, {fill} from sp, med),
        st as (select {stat} from filled where split = 'train')""",
        f"select ID, {_D}, split, {z} from filled, st",
    )
    parts = []
    for i, c in enumerate(("REGION_CLUSTER", "MAINTENANCE_VENDOR", "MANUFACTURER")):
        parts.append(f"select {i} as col, {c} as value, split from sp")
    sql["one_hot"] = _with(
        _SPLIT
        + f""", cells as ({' union all '.join(parts)}),
        dict as (select col, value, row_number() over (order by col, value) - 1 as position
          from (select distinct col, value from cells where split = 'train'))""",
        """select cast(position as integer) as position, split, count(*) as n
           from cells join dict using (col, value) group by position, split""",
    )
    sql["binary_confusion"] = _with(
        _LONG,
        """select task, split, count(*) filter (label = 1 and score >= 0.5) as tp,
             count(*) filter (label = 0 and score >= 0.5) as fp, count(*) filter (label = 1 and score < 0.5) as fn,
             count(*) filter (label = 0 and score < 0.5) as tn from long group by task, split""",
    )
    sql["binary_metrics"] = _with(
        _POINTS
        + """, k as (select task, split, count(*) filter (label = 1 and score >= 0.5) as tp,
             count(*) filter (score >= 0.5) as hits, sum(label) as pos, count(*) as n from long group by task, split),
        m as (select *, case when hits = 0 then 0 else tp / hits end as p,
             case when pos = 0 then 0 else tp / pos end as r from k)""",
        f"""select task, split, round(p, 6) as precision, round(r, 6) as recall,
              round(case when p + r = 0 then 0 else 2 * p * r / (p + r) end, 6) as f1,
              round(case when p + r = 0 then 0 else 5 * p * r / (4 * p + r) end, 6) as fbeta,
              round(hits / n, 6) as alert_rate, {_round('pr_auc roc_auc')}
            from m join area using (task, split)""",
    )
    sql["pr_curve"] = _with(
        _POINTS,
        """select task, split, score as threshold, round(p, 6) as precision, round(r, 6) as recall from pr
           union all select distinct task, split, null, 1.0, 0.0 from pr""",
    )
    sql["pr_curve_thinned"] = _with(
        _POINTS
        + """, steps as (
          select *, floor(ln(hits) / 0.02) as k1, floor(ln(greatest(cast(tp as double), 0.5)) / 0.02) as k2,
            floor(case when positives > 0 then tp / positives else 0 end / 0.02) as k3,
            floor(case when total > positives then (hits - tp) / (total - positives) else 0 end / 0.02) as k4
          from pr),
        ends as (
          select *, min(hits) over w as low, max(hits) over w as high from steps
          window w as (partition by task, split, k1, k2, k3, k4))""",
        """select task, split, score as threshold, round(p, 6) as precision, round(r, 6) as recall
           from ends where hits = low or hits = high
           union all select distinct task, split, null, 1.0, 0.0 from pr""",
    )
    sql["roc_curve"] = _with(
        _POINTS,
        """select task, split, score as threshold, round((hits - tp) / nullif(total - positives, 0), 6) as fpr,
             round(tp / nullif(positives, 0), 6) as tpr from pts
           union all select distinct task, split, null, 0.0, 0.0 from pts""",
    )
    sql["average_precision"] = _with(_POINTS, "select task, split, round(pr_auc, 6) as pr_auc from area")
    sql["roc_auc"] = _with(_POINTS, "select task, split, round(roc_auc, 6) as roc_auc from area")
    sql["fbeta_threshold"] = _with(
        _BEST, "select task, split, threshold, round(fbeta, 6) as best_fbeta from best"
    )
    sql["f1_threshold"] = _with(_BEST, "select task, split, threshold, round(f1, 6) as best_f1 from best1")
    tuned = (
        _BEST
        + """, thr as (select task, threshold from best where split = 'val'),
        k as (select task, split, threshold, count(*) filter (label = 1 and score >= threshold) as tp,
             count(*) filter (score >= threshold) as hits, cast(sum(label) as bigint) as pos, count(*) as n
           from long join thr using (task) group by task, split, threshold),
        m as (select *, case when hits = 0 then 0 else tp / hits end as p,
             case when pos = 0 then 0 else tp / pos end as r, """
        + _BETA
        + """ as beta from k),
        f as (select *, case when p + r = 0 then 0 else 2 * p * r / (p + r) end as f1,
             case when p + r = 0 then 0 else (1 + beta * beta) * p * r / (beta * beta * p + r) end as fb from m)"""
    )
    sql["tuned_evaluation"] = _with(
        tuned,
        f"""select t.task as task, t.threshold as threshold, round(v.fb, 6) as val_metric, round(t.p, 6) as precision,
              round(t.r, 6) as recall, round(t.f1, 6) as f1, round(t.fb, 6) as fbeta, {_round('pr_auc roc_auc')},
              round(t.hits / t.n, 6) as alert_rate, v.pos as positives_val, t.pos as positives_test
            from f t join f v on t.task = v.task and v.split = 'val'
              join area a on a.task = t.task and a.split = 'test'
            where t.split = 'test'""",
    )
    sql["predictability"] = _with(
        _POINTS,
        f"""select task, split, {_round('pr_auc roc_auc')}, round(base, 6) as base_rate,
              roc_auc > 0.60 and pr_auc > base as predictable
            from area join (select task, split, avg(label) as base from long group by task, split) using (task, split)""",
    )
    sql["precision_gain"] = _with(
        _LONG
        + """, k as (select task, count(*) filter (label = 1 and score >= 0.5) / count(*) filter (score >= 0.5) as p
           from long where split = 'test' group by task)""",
        """select round(max(p) filter (task = 'NOW'), 6) as baseline_precision,
             round(max(p) filter (task = 'LE_30_DAYS'), 6) as model_precision,
             round(max(p) filter (task = 'LE_30_DAYS') - max(p) filter (task = 'NOW'), 6) as gain,
             max(p) filter (task = 'LE_30_DAYS') > max(p) filter (task = 'NOW') as improved from k""",
    )
    sql["rul_error"] = _with(
        _WIDE,
        """select split, count(*) as n, round(avg(abs(RUL_DAYS - RUL_PRED)), 6) as mae,
             round(sqrt(avg((RUL_DAYS - RUL_PRED) * (RUL_DAYS - RUL_PRED))), 6) as rmse from wide group by split""",
    )
    sql["rul_error_bands"] = _with(
        _WIDE,
        """select band, count(*) as n, round(avg(abs(RUL_DAYS - RUL_PRED)), 6) as mae,
             round(sqrt(avg((RUL_DAYS - RUL_PRED) * (RUL_DAYS - RUL_PRED))), 6) as rmse
           from wide, (values (30), (14), (7)) as b(band) where RUL_DAYS <= band group by band""",
    )
    sql["event_metrics"] = _with(
        _WIDE
        + """, e as (select horizon, RUL_PRED as pred, cast(RUL_DAYS <= horizon as integer) as y,
             cast(RUL_PRED <= horizon as integer) as yhat from wide, (values (30), (14), (7)) as b(horizon)),
        c as (select horizon, pred, sum(y) as pos, count(*) as n from e group by horizon, pred),
        w as (select *, sum(pos) over u as tp, sum(n) over u as hits, sum(pos) over (partition by horizon) as tot
             from c window u as (partition by horizon order by pred)),
        ap as (select horizon, sum(pos / tot * (tp / hits)) as pr_auc from w group by horizon),
        k as (select horizon, sum(y * yhat) as tp, cast(sum(yhat) as bigint) as pred_pos,
             cast(sum(y) as bigint) as support_pos from e group by horizon)""",
        """select horizon, round(tp / pred_pos, 6) as precision, round(tp / support_pos, 6) as recall,
             round(2 * tp / (pred_pos + support_pos), 6) as f1, round(pr_auc, 6) as pr_auc, support_pos, pred_pos
           from k join ap using (horizon)""",
    )
    sql["multiclass_report"] = _with(
        _CM,
        """select split, name, round(prec, 6) as precision, round(rec, 6) as recall, round(f1, 6) as f1,
             cast(support as bigint) as support from per
           union all select split, 'accuracy', round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6),
             round(sum(tp) / sum(support), 6), cast(sum(support) as bigint) from per group by split
           union all select split, 'macro avg', round(sum(prec) / 4, 6), round(sum(rec) / 4, 6), round(sum(f1) / 4, 6),
             cast(sum(support) as bigint) from per group by split
           union all select split, 'weighted avg', round(sum(prec * support) / sum(support), 6),
             round(sum(rec * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
             cast(sum(support) as bigint) from per group by split""",
    )
    sql["multiclass_confusion"] = _with(
        _CM,
        """select split, tc as true_class, pc as pred_class, n,
             round(case when sum(n) over (partition by split, tc) = 0 then 0
               else n / sum(n) over (partition by split, tc) end, 6) as share_of_true,
             round(n / sum(n) over (partition by split), 6) as share_of_all from cm""",
    )
    sql["multiclass_metrics"] = _with(
        _CM,
        """select split, round(sum(tp) / sum(support), 6) as accuracy,
             round(avg(prec) filter (seen), 6) as macro_precision, round(avg(rec) filter (seen), 6) as macro_recall,
             round(avg(f1) filter (seen), 6) as macro_f1, round(sum(f1 * support) / sum(support), 6) as weighted_f1,
             round(sum(rec) filter (c < 3) / 3, 6) as close_recall_macro from per group by split""",
    )
    sql["close_recall"] = _with(
        _CM, "select split, round(sum(rec) / 3, 6) as close_recall_macro from per where c < 3 group by split"
    )
    sql["priority_f1"] = _with(
        _CM,
        """select split, 'priority_weighted_f1' as metric,
             round(sum(f1 * case c when 0 then 0.45 when 1 then 0.30 when 2 then 0.20 else 0.05 end), 6) as score
           from per group by split""",
    )
    sql["horizon_confidence"] = _with(
        _CONF, f"select ID, {_D}, {_round('conf_NOW conf_D1_7 conf_D8_30 conf_GT_30')} from conf"
    )
    sql["horizon_argmax"] = _with(
        _CONF, f"select ID, {_D}, pred_class, round(pred_conf, 6) as pred_conf from chosen"
    )
    decision = "case when p_now >= 0.9 then 0 when p_le7 >= 0.7 then 1 when p_le30 >= 0.5 then 2 else 3 end"
    sql["horizon_policy"] = _with(_WIDE, f"select ID, {_D}, true_class, {decision} as policy_class from wide")
    sql["horizon_cascade"] = _with(
        _WIDE,
        f"""select ID, {_D}, {decision} as cascade_class,
              case when p_now >= 0.9 then 1 when p_le7 >= 0.7 then 2 else 3 end as gates_reached from wide""",
    )
    sql["cascade_stages"] = _with(
        _WIDE
        + """, s as (
          select 1 as stage, 'NOW' as gate, true_class = 0 as y, p_now >= 0.9 as h, true as here from wide
          union all select 2, 'D1_7', true_class = 1, p_le7 >= 0.7, p_now < 0.9 from wide
          union all select 3, 'D8_30', true_class = 2, p_le30 >= 0.5, p_now < 0.9 and p_le7 < 0.7 from wide),
        k as (select stage, gate, count(*) filter (here and h and y) as tp, count(*) filter (here and h) as hits,
          count(*) filter (here and y) as pos, count(*) filter (here) as n, count(*) as total from s group by stage, gate)""",
        """select stage, gate, round(case when hits = 0 then 0 else tp / hits end, 6) as precision,
             round(case when pos = 0 then 0 else tp / pos end, 6) as recall,
             round(case when hits + pos = 0 then 0 else 2 * tp / (hits + pos) end, 6) as f1,
             case when stage = 1 then hits else n end as stage_size, total from k""",
    )
    grid = _WIDE + """,
g0 as (select i, (i + 1) / 21 as t from range(20) r(i)),
g1 as (select i as j, (i + 1) / 26 as t from range(25) r(i)),
g2 as (select i as k, (i + 1) / 21 as t from range(20) r(i)),
v as (select true_class as tc, p_now, p_le7, p_le30 from wide where split = 'val'),
pred as (
  select i, j, k, tc, case when p_now >= g0.t then 0 when p_le7 >= g1.t then 1 when p_le30 >= g2.t then 2 else 3 end as pc,
    count(*) as n
  from v, g0, g1, g2 group by all),
sup as (select tc as c, count(*) as support from v group by tc),
pp as (
  select i, j, k, c, sum(n) filter (tc = c and pc = c) as tp, sum(n) filter (pc = c) as predicted
  from pred, (values (0), (1), (2), (3)) as l(c) group by i, j, k, c),
m as (
  select i, j, k, c, coalesce(tp, 0) as tp, coalesce(predicted, 0) as predicted, coalesce(support, 0) as support
  from pp left join sup using (c)),
sc as (
  select i, j, k,
    sum(case when support + predicted = 0 then 0 else 2 * tp / (support + predicted) end
      * case c when 0 then 0.45 when 1 then 0.30 when 2 then 0.20 else 0.05 end) as score,
    min(case when (case when support = 0 then 0 else tp / support end)
      >= case c when 0 then 0.28 when 1 then 0.22 when 2 then 0.08 else 0.0 end then 1 else 0 end) = 1 as feasible
  from m group by i, j, k)"""
    sql["threshold_grid_search"] = _with(
        grid, "select cast(i as integer) as i, cast(j as integer) as j, cast(k as integer) as k, round(score, 6) as score, feasible from sc"
    )
    sql["tune_policy"] = _with(
        grid,
        """select round((i + 1) / 21, 6) as t_now, round((j + 1) / 26, 6) as t_le7, round((k + 1) / 21, 6) as t_le30,
             round(score, 6) as score, feasible
           from sc order by feasible desc, round(score, 12) desc, i, j, k limit 1""",
    )
    sql["confidence_summary"] = _with(
        _CONF,
        """select round(avg(pred_conf), 6) as mean, round(median(pred_conf), 6) as median,
             round(min(pred_conf), 6) as lowest, round(quantile_cont(pred_conf, 0.1), 6) as p10,
             round(quantile_cont(pred_conf, 0.9), 6) as p90 from chosen""",
    )
    configs = (
        _BEST
        + """, m as (select task, cast(round(score * 100) as integer) as config_id, fbeta as val_metric from q
           where split = 'val')"""
    )
    sql["top1_per_task"] = _with(
        configs,
        """select task, config_id, round(val_metric, 6) as val_metric from (
             select *, row_number() over (partition by task order by round(val_metric, 9) desc, config_id) as rk from m)
           where rk = 1""",
    )
    sql["best_flags"] = _with(
        configs,
        """select task, config_id, round(val_metric, 6) as val_metric,
             row_number() over (partition by task order by round(val_metric, 9) desc, config_id) = 1 as best_for_task,
             '{"config":' || config_id || ',"task":"' || task || '"}' as params_json from m""",
    )
    rates = " union all ".join(
        f"""select '{c}' as attribute, cast({c} as varchar) as value, count(*) as n,
              cast(sum(EQUIPMENT_FAILURE) as bigint) as positives, round(avg(EQUIPMENT_FAILURE), 6) as rate
            from log group by {c}"""
        for c in ("REGION_CLUSTER", "MAINTENANCE_VENDOR", "MANUFACTURER")
    )
    sql["segment_failure_rate"] = _with(_PANEL, rates)
    sql["segment_predictability"] = _with(
        _WIDE
        + """, e as (select sp.MANUFACTURER as value, cast(w.RUL_DAYS <= 30 as integer) as y, p_le30 as s
             from wide w join sp on w.ID = sp.ID and w.DATE = sp.DATE),
        c as (select value, s, sum(y) as pos, count(*) as n from e group by value, s),
        u as (select *, sum(pos) over x as tp, sum(n) over x as hits, sum(pos) over (partition by value) as p,
             sum(n) over (partition by value) as t from c window x as (partition by value order by s desc))""",
        """select value, round(sum(case when p > 0 then pos / p * (tp / hits) else 0 end), 6) as pr_auc,
             round(case when max(p * (t - p)) > 0 then sum(((tp - pos) + pos / 2) * (n - pos)) / max(p * (t - p)) end, 6)
               as roc_auc from u group by value""",
    )
    sql["row_cap"] = _with(
        _SPLIT, f"select ID, {_D}, RUL_DAYS from sp where split = 'train' order by {_hash(42)} limit 1000"
    )
    sql["stratified_split"] = _with(
        _PANEL
        + f""", r as (select ID, DATE, EQUIPMENT_FAILURE as y,
             row_number() over (partition by EQUIPMENT_FAILURE order by {_hash(42)}) as rk,
             count(*) over (partition by EQUIPMENT_FAILURE) as n from log)""",
        f"""select ID, {_D}, y as EQUIPMENT_FAILURE, case when rk <= floor(n * 0.7 + 0.5) then 'train'
              when rk <= floor(n * 0.85 + 0.5) then 'val' else 'test' end as split from r""",
    )
    w = "over (partition by ID, split order by DATE rows between 9 preceding and current row)"
    sql["sequence_windows"] = _with(
        _SPLIT,
        f"""select ID, {_D}, split, first_value as first_value, last_value, weighted from (
              select ID, DATE, split, count(*) {w} as k, first_value(S16) {w} as first_value, S16 as last_value,
                round({' + '.join(f'{i + 1} * nth_value(S16, {i + 1}) {w}' for i in range(10))}, 4) as weighted
              from sp) where k = 10""",
    )
    past = "over (partition by ID, split order by DATE rows between 7 preceding and 1 preceding)"
    sql["rolling_features_per_split"] = _with(
        _SPLIT,
        f"""select ID, {_D}, split, lag(S16) over (partition by ID, split order by DATE) as S16_lag1,
              round(case when count(S16) {past} >= 2 then avg(S16) {past} end, 6) as S16_roll7_mean from sp""",
    )
    sql["smote"] = _with(
        _PANEL
        + """, k as (select EQUIPMENT_FAILURE as y, floor(count(*) * 0.7 + 0.5) as n from log group by 1)""",
        """select y as EQUIPMENT_FAILURE, 0 as synthetic, cast(n as bigint) as n from k
           union all select y, 1, cast((select max(n) from k) - n as bigint) from k where n < (select max(n) from k)""",
    )
    gap = " + ".join(
        f"pow(a.{c} * {f} - b.{c} * {f}, 2)"
        for c, f in (("S5", 1), ("S8", 100), ("S13", 100), ("S16", 0.001), ("S17", 0.001), ("S18", 1))
    )
    sql["minority_neighbours"] = _with(
        _PANEL
        + f""", f as (select * from log where EQUIPMENT_FAILURE = 1),
        p as (select a.ID, a.DATE, sqrt({gap}) as distance from f a join f b on a.ID <> b.ID or a.DATE <> b.DATE),
        r as (select *, row_number() over (partition by ID, DATE order by distance) as place from p)""",
        f"select ID, {_D}, cast(place as integer) as place, round(distance, 6) as distance from r where place <= 5",
    )
    sql["one_hot_dictionary"] = _with(
        _SPLIT
        + """, cells as (select 'ID' as col, cast(ID as varchar) as value, split from sp
            union all select 'MANUFACTURER', MANUFACTURER, split from sp),
        dict as (select col, value, row_number() over (order by col, value) - 1 as position
          from (select distinct col, value from cells where split = 'train'))""",
        """select cast(position as integer) as position, split, count(*) as n
           from cells join dict using (col, value) group by position, split""",
    )
    # Three bags share a 60-bit hash; a bag's 20 bits make a Poisson number of mean 1.
    bags = " union all ".join(
        f"""select {t} as tree, label, list_sum([cast(u >= s as integer) for s in {bagging._STEPS}]) as times
            from (select label, (cast('0x' || substr(md5(concat_ws('|', '{SEED * 1_000_003 + t // 3}', cast(ID as varchar),
              cast(DATE as varchar))), 1, 15) as bigint) >> {20 * (t % 3)}) & 1048575 as u
              from (select ID, DATE, cast(RUL_DAYS <= 30 as integer) as label from sp))"""
        for t in range(5)
    )
    sql["bag_class_sizes"] = _with(
        _SPLIT + f", drawn as ({bags}), totals as (select tree, sum(times) as n from drawn group by tree)",
        """select tree, label, round(any_value(n) / 2, 6) as weight, count(*) filter (times > 0) as n_rows
           from drawn join totals using (tree) group by tree, label""",
    )
    sql["prediction_preview"] = _with(
        _WIDE, f"select ID, {_D}, RUL_DAYS, RUL_PRED from wide where split = 'test' order by ID, wide.DATE limit 10"
    )
    return sql
