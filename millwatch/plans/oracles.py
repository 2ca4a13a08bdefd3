"""The registered queries as plain SQL over the same tables, written independently.

These are the reference answers: unbucketed windows, ordinary joins, real JSON parsing.
"""

from __future__ import annotations

import re

from millwatch.functions.scalars import POSITIONS

TAG_LIST = "['click','error','purchase','signup','view']"
HOUR_US = 3_600_000_000


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


EV = """ev AS (
  SELECT 'eq' || CAST(user_id // 10 AS VARCHAR) AS equipment_id, event_type AS tag, ts, event_id AS ord,
    CASE WHEN event_type = 'signup' THEN CASE WHEN value >= 50 THEN 1::DOUBLE ELSE 0::DOUBLE END ELSE value END AS value,
    CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events)"""
RD = f"""rd AS (
  SELECT equipment_id, unnest(CASE WHEN k = 8 THEN {TAG_LIST} ELSE [tag] END) AS tag, ts, ord,
    CASE WHEN k NOT IN (7, 8) THEN value END AS value
  FROM ev)"""
PTS = f"""pts AS (
  SELECT equipment_id, tag, tick, value FROM (
    SELECT *, (epoch_us(ts) + {HOUR_US - 1}) // {HOUR_US} AS tick FROM rd)
  QUALIFY row_number() OVER (PARTITION BY equipment_id, tag, tick ORDER BY ts DESC, ord DESC) = 1)"""


# A stream closes the ticks that an equipment's own newest reading has passed by the delay, a third of the whole span.
DELAY_US = "(SELECT ((max(epoch_us(ts)) - min(epoch_us(ts))) // 3000 + 1000) * 1000 FROM rd)"
CLOSED = f"(SELECT max(epoch_us(r.ts)) - {DELAY_US} FROM rd r WHERE r.equipment_id = pts.equipment_id) // {HOUR_US}"


def _grid(extra: str = "", end: str = "max(tick)") -> str:
    return f"""tags AS (
  SELECT unnest({TAG_LIST}{extra}) AS tag, unnest(range(len({TAG_LIST}{extra}))) AS pos),
spans AS (SELECT equipment_id, min(tick) AS lo, {end} AS hi FROM pts GROUP BY 1),
grid AS (SELECT equipment_id, tag, pos, unnest(generate_series(lo, hi)) AS tick FROM spans CROSS JOIN tags),
held AS (
  SELECT g.equipment_id, g.tag, g.pos, g.tick, p.value
  FROM grid g ASOF LEFT JOIN pts p
    ON g.equipment_id = p.equipment_id AND g.tag = p.tag AND g.tick >= p.tick),
kept AS (
  SELECT equipment_id, tick, count(value) = count(*) AS complete,
    row_number() OVER (PARTITION BY equipment_id ORDER BY tick) - 1 AS seq
  FROM held GROUP BY equipment_id, tick HAVING count(value) > 0),
win AS (
  SELECT *, count_if(complete) OVER (
    PARTITION BY equipment_id ORDER BY seq ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) = 7 AS usable
  FROM kept),
sn AS (
  SELECT h.equipment_id, h.tag, h.pos, h.tick, h.value, w.seq, w.usable,
    lag(h.value) OVER (PARTITION BY h.equipment_id, h.tag ORDER BY w.seq) AS prev
  FROM held h JOIN win w USING (equipment_id, tick))"""


SNAP = (EV, RD, PTS, _grid())
STREAMED = (EV, RD, PTS, _grid(end=CLOSED))
# Snapshots of the stream, seen by models fitted on the batch snapshots.
LIVE_GRID = _grid(end=CLOSED)
for _name in ("tags", "spans", "grid", "held", "kept", "win", "sn"):
    LIVE_GRID = re.sub(rf"\b{_name}\b(?! *\()", f"s_{_name}", LIVE_GRID)


def _fit(rows: str, keys: str = "equipment_id, model_version") -> str:
    """Model tables over ``rows(equipment_id, model_version, tag, pos, value, prev, fit)``."""
    return f"""stats AS (
  SELECT {keys}, tag, pos,
    CASE WHEN min(value) <> max(value) AND bool_and(value IN (0, 1)) THEN 'binary' ELSE 'continuous' END AS tag_type,
    coalesce(avg(value), 0::DOUBLE) AS mean,
    CASE WHEN stddev_pop(value) > 0 THEN stddev_pop(value) ELSE 1::DOUBLE END AS std
  FROM {rows} GROUP BY {keys}, tag, pos),
norm AS (
  SELECT {keys}, tag, pos, tag_type,
    CASE WHEN tag_type = 'binary' THEN 0::DOUBLE ELSE mean END AS norm_mean,
    CASE WHEN tag_type = 'binary' THEN 1::DOUBLE ELSE std END AS norm_std
  FROM stats),
zs AS (
  SELECT r.*, n.tag_type, n.norm_mean, n.norm_std,
    CASE WHEN r.fit THEN (r.value - norm_mean) / norm_std END AS zy,
    CASE WHEN r.fit THEN (r.prev - norm_mean) / norm_std END AS zx
  FROM {rows} r JOIN norm n USING ({keys}, tag, pos)),
lines AS (
  SELECT {keys}, tag, pos, tag_type, norm_mean, norm_std, count(zy) AS n_windows,
    CASE WHEN coalesce(var_pop(zx), 0) = 0 THEN 0::DOUBLE ELSE regr_slope(zy, zx) END AS slope,
    CASE WHEN coalesce(var_pop(zx), 0) = 0 THEN avg(zy) ELSE regr_intercept(zy, zx) END AS "offset"
  FROM zs GROUP BY {keys}, tag, pos, tag_type, norm_mean, norm_std),
fit_err AS (
  SELECT {keys}, tag, pos, tick, abs(zy - CASE WHEN tag_type = 'binary'
      THEN greatest(least("offset" + slope * zx, 1::DOUBLE), 0::DOUBLE) ELSE "offset" + slope * zx END) AS error
  FROM zs JOIN lines USING ({keys}, tag, pos, tag_type, norm_mean, norm_std) WHERE fit),
err AS (
  SELECT {keys}, tag, pos, avg(error) AS err_mean,
    greatest(stddev_pop(error), 1e-3::DOUBLE, 0.05::DOUBLE * abs(avg(error))) AS err_std
  FROM fit_err GROUP BY {keys}, tag, pos)"""


ALL_ROWS = "trn AS (SELECT *, 0::BIGINT AS model_version, usable AS fit FROM sn)"
MODEL = (*SNAP, ALL_ROWS, _fit("trn"))


def _score(live: str, keys: str = "equipment_id, model_version") -> str:
    return f"""zscore AS (
  SELECT {keys}, v.tick, v.tag, v.pos, l.tag_type,
    (abs((v.value - norm_mean) / norm_std - CASE WHEN l.tag_type = 'binary'
       THEN greatest(least("offset" + slope * ((v.prev - norm_mean) / norm_std), 1::DOUBLE), 0::DOUBLE)
       ELSE "offset" + slope * ((v.prev - norm_mean) / norm_std) END) - err_mean) / err_std AS z
  FROM {live} v JOIN lines l USING ({keys}, tag, pos) JOIN err USING ({keys}, tag, pos)),
best AS (
  SELECT {keys}, tick, z AS anomaly_score, tag AS top_deviant_tag FROM zscore
  QUALIFY row_number() OVER (
    PARTITION BY {keys}, tick ORDER BY z DESC, CASE WHEN tag_type = 'binary' THEN 1 ELSE 0 END, pos) = 1)"""


def _window_wide(window: int = 6, tags: int = 5, rounds: int = 30, ridge: float = 1e-8) -> list[str]:
    """Weights ``wide(equipment_id, pos, tag_type, beta)`` of the window-wide forecaster, by elimination; logits by Newton steps from zero."""
    size = 1 + window * tags
    dot = lambda b: f"list_sum(list_transform(list_zip(x, {b}), lambda p: p[1] * p[2]))"
    step = (
        "list_transform(m, lambda r, i: CASE WHEN abs(m[k][k]) < 1e-9 THEN r WHEN i = k THEN list_transform(r, lambda v: v / m[k][k]) "
        "ELSE list_transform(r, lambda v, j: v - r[k] * m[k][j] / m[k][k]) END)"
    )

    def solved(name: str, system: str, keys: str) -> str:
        return f"""{name} AS (
  SELECT {keys}, 1 AS k, m FROM {system}
  UNION ALL SELECT {keys}, k + 1, {step} FROM {name} WHERE k <= {size})"""

    parts = [
        f"""zv AS MATERIALIZED (
  SELECT equipment_id, seq, bool_and(fit) AS fit, list((value - norm_mean) / norm_std ORDER BY pos) AS z
  FROM trn JOIN norm USING (equipment_id, model_version, tag, pos) GROUP BY equipment_id, seq),
xs AS MATERIALIZED (
  SELECT equipment_id, seq, z AS y, x FROM (
    SELECT *, list_concat([1::DOUBLE], {", ".join(f"lag(z, {i}) OVER w" for i in range(1, window + 1))}) AS x
    FROM zv WINDOW w AS (PARTITION BY equipment_id ORDER BY seq)) WHERE fit),
cells AS MATERIALIZED (
  SELECT equipment_id, i, list(s ORDER BY j) AS r FROM (
    SELECT equipment_id, i, j, sum(x[i] * CASE WHEN j <= {size} THEN x[j] ELSE y[j - {size}] END) AS s
    FROM xs, range(1, {size + 1}) a(i), range(1, {size + tags + 1}) b(j) GROUP BY ALL) GROUP BY ALL),
plain AS (SELECT equipment_id, list(r ORDER BY i) AS m FROM cells GROUP BY ALL)""",
        solved("lines_gj", "plain", "equipment_id"),
        f"""b0 AS MATERIALIZED (
  SELECT equipment_id, pos, list_transform(range({size}), lambda v: 0::DOUBLE) AS beta FROM norm WHERE tag_type = 'binary')""",
    ]
    for i in range(rounds):
        parts.append(
            f"""p{i} AS MATERIALIZED (
  SELECT equipment_id, pos, x, y[pos + 1] AS t, 1 / (1 + exp(-{dot("beta")})) AS p FROM xs JOIN b{i} USING (equipment_id)),
h{i} AS (
  SELECT equipment_id, pos, i, j, avg(CASE WHEN j <= {size} THEN x[i] * x[j] * p * (1 - p) ELSE x[i] * (p - t) END) AS s
  FROM p{i}, range(1, {size + 1}) a(i), range(1, {size + 2}) b(j) GROUP BY ALL),
s{i} AS MATERIALIZED (
  SELECT equipment_id, pos, list(r ORDER BY i) AS m FROM (
    SELECT equipment_id, pos, i,
      list(s + CASE WHEN j = i THEN {ridge}::DOUBLE WHEN j > {size} THEN {ridge}::DOUBLE * beta[i] ELSE 0 END ORDER BY j) AS r
    FROM h{i} JOIN b{i} USING (equipment_id, pos) GROUP BY ALL) GROUP BY ALL)"""
        )
        parts.append(solved(f"g{i}", f"s{i}", "equipment_id, pos"))
        parts.append(
            f"""b{i + 1} AS MATERIALIZED (
  SELECT equipment_id, pos, list_transform(beta, lambda v, i: v - m[i][{size + 1}]) AS beta
  FROM g{i} JOIN b{i} USING (equipment_id, pos) WHERE k > {size})"""
        )
    parts.append(
        f"""wide AS MATERIALIZED (
  SELECT equipment_id, tag, pos, tag_type,
    CASE WHEN tag_type = 'binary' THEN beta
      ELSE list_transform(range({size}), lambda i: CASE WHEN abs(m[i + 1][i + 1]) < 0.5 THEN 0 ELSE m[i + 1][{size + 1} + pos] END) END AS beta
  FROM norm JOIN lines_gj USING (equipment_id) LEFT JOIN b{rounds} USING (equipment_id, pos) WHERE k > {size})"""
    )
    return parts


WIDE_SCORE = """wide_err AS MATERIALIZED (
  SELECT equipment_id, pos, tag_type, seq, abs(y[pos + 1] - CASE WHEN tag_type = 'binary' THEN 1 / (1 + exp(-f)) ELSE f END) AS error
  FROM (
    SELECT equipment_id, pos, tag_type, seq, y, list_sum(list_transform(list_zip(x, beta), lambda p: p[1] * p[2])) AS f
    FROM xs JOIN wide USING (equipment_id))),
wide_spread AS (
  SELECT equipment_id, pos, avg(error) AS err_mean, greatest(stddev_pop(error), 1e-3::DOUBLE, 0.05::DOUBLE * abs(avg(error))) AS err_std
  FROM wide_err GROUP BY ALL)"""


LIVE_ALL = "live AS (SELECT * FROM trn WHERE usable)"

CONTROL = f"""cm AS (
  SELECT equipment_id, ts, ord, (epoch_us(ts) + {HOUR_US - 1}) // {HOUR_US} AS tick, k = 0 AS recal
  FROM ev WHERE k BETWEEN 0 AND 3),
eqs AS (SELECT DISTINCT equipment_id FROM ev),
starts AS (
  SELECT equipment_id, tick AS start FROM cm WHERE recal GROUP BY 1, 2
  UNION ALL SELECT equipment_id, NULL FROM eqs),
eps AS (
  SELECT equipment_id, start,
    row_number() OVER (PARTITION BY equipment_id ORDER BY start NULLS FIRST) - 1 AS episode,
    lead(start) OVER (PARTITION BY equipment_id ORDER BY start NULLS FIRST) AS stop
  FROM starts),
trains AS (
  SELECT equipment_id, ts, ord, tick, since FROM (
    SELECT *, max(CASE WHEN recal THEN tick END) OVER (
      PARTITION BY equipment_id ORDER BY ts, ord ROWS UNBOUNDED PRECEDING) AS since
    FROM cm) WHERE NOT recal),
found AS (
  SELECT t.equipment_id, t.tick, t.since, t.ord, count(w.seq) AS n, min(w.seq) AS fit_lo, max(w.seq) + 1 AS fit_hi,
    max(CASE WHEN w.usable THEN w.seq END) AS newest_usable
  FROM trains t LEFT JOIN win w ON w.equipment_id = t.equipment_id AND w.tick < t.tick
    AND w.tick >= coalesce(t.since, -1) AND w.tick >= t.tick - 168
  GROUP BY ALL),
won AS (
  SELECT f.equipment_id, e.episode, f.tick AS trained, f.fit_lo, f.fit_hi
  FROM found f JOIN eps e ON e.equipment_id = f.equipment_id AND e.start IS NOT DISTINCT FROM f.since
  WHERE (e.stop IS NULL OR f.tick < e.stop) AND n >= 48 AND newest_usable - 6 >= fit_lo
  QUALIFY row_number() OVER (PARTITION BY f.equipment_id, e.episode ORDER BY f.tick) = 1),
spans_all AS (
  SELECT equipment_id, episode, 'CALIBRATING' AS state, start AS valid_from, coalesce(trained, stop) AS valid_to,
    CASE WHEN trained IS NOT NULL THEN episode END AS model_version, fit_lo, fit_hi
  FROM eps LEFT JOIN won USING (equipment_id, episode)
  UNION ALL
  SELECT equipment_id, episode, 'MONITORING', trained, stop, episode, fit_lo, fit_hi
  FROM eps JOIN won USING (equipment_id, episode)),
ctl AS (SELECT * FROM spans_all WHERE valid_from IS NULL OR valid_to IS NULL OR valid_from < valid_to)"""
AT = """(c.valid_from IS NULL OR {t}.tick >= c.valid_from) AND (c.valid_to IS NULL OR {t}.tick < c.valid_to)"""
SMP = f"""smp AS (
  SELECT w.equipment_id, c.episode, w.tick, w.seq FROM win w JOIN ctl c
    ON c.equipment_id = w.equipment_id AND {AT.format(t="w")} WHERE c.state = 'CALIBRATING')"""
CTL = (*SNAP, CONTROL)

# --- inspections ---------------------------------------------------------------------------


def _measure(kind: str, side: str, pos: int) -> str:
    salt = pos * 1299709 + (15485863 if side == "R" else 32452843) + (49979687 if kind == "X" else 0)
    h = f"((l_orderkey * 7919 + l_linenumber * 104729 + {salt}) % 10007)"
    here = f"place = {pos}"
    if kind == "A":
        v = f"{h} % 2001 + 109000"
        if side == "L":
            v = f"CASE WHEN {here} AND fault = 1 THEN 113001 ELSE {v} END"
    else:
        v = f"{h} % 61 + 840"
        v = f"CASE WHEN {here} AND fault = 2 THEN {820 if side == 'L' else 920} ELSE {v} END"
        if side == "R":
            v = f"CASE WHEN {here} AND fault = 3 THEN NULL ELSE {v} END"
        else:
            v = f"CASE WHEN {here} AND fault = 4 THEN 819 ELSE {v} END"
    return f"CAST({v} AS DOUBLE) AS {kind}_{side}_{pos:02d}"


MEASURES = [f"{k}_{s}_{p}" for k in "AX" for s in "LR" for p in POSITIONS]
INSP = f"""base AS (
  SELECT *, CAST(l_orderkey AS BIGINT) * 31 + l_linenumber * 17 + l_partkey * 7 AS noise,
    make_timestamp((1704067200 + l_orderkey * 60 + l_linenumber * 5) * 1000000) AS stamp
  FROM lineitem),
flt AS (
  SELECT *, noise % 12 + 1 AS place,
    CASE WHEN noise % 1000 < CASE WHEN (l_orderkey // 120) % 5 = 0 THEN 90 ELSE 15 END
      THEN noise % 4 + 1 ELSE 0 END AS fault
  FROM base),
insp AS (
  SELECT l_returnflag AS series_id, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS row_id,
    CASE WHEN noise % 997 = 5 THEN '2024133x' ELSE strftime(stamp, '%Y%m%d') END AS INSP_DATE,
    CAST(CAST(strftime(stamp, '%H%M%S') AS INTEGER) AS VARCHAR) AS INSP_TIME,
    {", ".join(_measure(m[0], m[2], int(m[4:])) for m in MEASURES)}
  FROM flt)"""
SCALED = f"""scaled AS (
  SELECT series_id, row_id, try_strptime(INSP_DATE || lpad(INSP_TIME, 6, '0'), '%Y%m%d%H%M%S') AS inspected_at,
    {", ".join(f"{m} / 1000::DOUBLE AS {m}" for m in MEASURES)} FROM insp)"""


def _pair(kind: str, p: str, low: str, high: str, gap: str) -> str:
    a, b = f"{kind}_L_{p}", f"{kind}_R_{p}"
    return (
        f"{a} >= {low}::DOUBLE AND {a} <= {high}::DOUBLE AND {b} >= {low}::DOUBLE AND {b} <= {high}::DOUBLE "
        f"AND abs({a} - {b}) <= {gap}::DOUBLE"
    )


GOOD = " AND ".join(
    f"{_pair('A', p, '107', '113', '2.5')} AND {_pair('X', p, '0.82', '0.92', '0.1')}" for p in POSITIONS
)
JUDGED = f"judged AS (SELECT *, CASE WHEN {GOOD} THEN 0 ELSE 1 END::BIGINT AS is_ng FROM scaled)"
MINUTES = """cnt AS (
  SELECT series_id, epoch_us(inspected_at) // 60000000 AS minute, CAST(sum(is_ng) AS BIGINT) AS ng
  FROM judged WHERE inspected_at IS NOT NULL GROUP BY 1, 2)"""
FILLED = """ext AS (SELECT series_id, min(minute) AS lo, max(minute) AS hi FROM cnt GROUP BY 1),
filled AS (
  SELECT g.series_id, g.minute, g.lo, g.hi, coalesce(c.ng, 0) AS ng
  FROM (SELECT series_id, lo, hi, unnest(generate_series(lo, hi)) AS minute FROM ext) g
  LEFT JOIN cnt c USING (series_id, minute))"""
ROLLED = """rolled AS (
  SELECT *, CAST(sum(ng) OVER w AS DOUBLE) AS ng_sum_30, round(avg(ng) OVER w, 6) AS ng_mean_30,
    round(coalesce(stddev_samp(ng) OVER w, 0), 6) AS ng_std_30, CAST(max(ng) OVER w AS DOUBLE) AS ng_max_30,
    round(CASE WHEN count(*) OVER w < 2 THEN 0 ELSE
      (count(*) OVER w * sum(x * ng) OVER w - sum(x) OVER w * sum(ng) OVER w)::DOUBLE
      / (count(*) OVER w * sum(x * x) OVER w - sum(x) OVER w * sum(x) OVER w) END, 6) AS ng_slope_30,
    CASE WHEN coalesce(sum(ng) OVER f, 0) >= 4 THEN 1 ELSE 0 END::BIGINT AS target,
    CASE WHEN minute - lo + 1 <= (hi - lo + 1) - CAST(ceil((hi - lo + 1) * 0.2::DOUBLE) AS BIGINT)
      THEN 'train' ELSE 'test' END AS part
  FROM (SELECT *, CAST(minute - lo AS HUGEINT) AS x FROM filled)
  WINDOW w AS (PARTITION BY series_id ORDER BY minute ROWS BETWEEN 29 PRECEDING AND CURRENT ROW),
    f AS (PARTITION BY series_id ORDER BY minute ROWS BETWEEN 1 FOLLOWING AND 60 FOLLOWING))"""


def _ewma_term(span: int) -> str:
    alpha = f"(2::DOUBLE / {span + 1})"
    return f"sum(CASE WHEN j.minute = j.lo THEN 1::DOUBLE ELSE {alpha} END * pow(1::DOUBLE - {alpha}, i.minute - j.minute) * j.ng)"


# Weights older than 700 minutes are below 1e-20 for both spans.
EWMA = f"""ewma AS (
  SELECT i.series_id, i.minute, round(coalesce({_ewma_term(5)}, 0) - coalesce({_ewma_term(30)}, 0), 6) AS ewma_gap
  FROM filled i LEFT JOIN filled j
    ON j.series_id = i.series_id AND j.minute BETWEEN i.minute - 700 AND i.minute AND j.ng > 0
  GROUP BY i.series_id, i.minute)"""
MIN = (INSP, SCALED, JUDGED, MINUTES)
FEAT = (*MIN, FILLED, ROLLED)

# Boosting by hand: classes of equal bins, then five levels of splits for each tree.
RISK_FEATURES = ("ng_sum_30", "ng_mean_30", "ng_std_30", "ng_max_30", "ng_slope_30", "ewma_gap")
_LATE = "minute - lo >= floor(floor((hi - lo + 1) * 0.8::DOUBLE) * 0.8::DOUBLE)"
_RANKS = "[" + ", ".join(f"{k} / 64::DOUBLE" for k in range(1, 64)) + "]"
RISK_ROWS = f"""risk_rows AS MATERIALIZED (
  SELECT series_id, minute, target, part, part = 'train' AND NOT ({_LATE}) AS fit,
    [{", ".join(f"{f}::DOUBLE" for f in RISK_FEATURES)}] AS x FROM rolled JOIN ewma USING (series_id, minute)),
risk_weight AS (SELECT CASE WHEN count_if(target = 1) > 0 THEN count_if(target = 0)::DOUBLE / count_if(target = 1) ELSE 1::DOUBLE END AS pos_weight
  FROM risk_rows WHERE part = 'train'),
cuts AS MATERIALIZED ({" UNION ALL ".join(f"SELECT {i} AS f, list_sort(list_distinct(quantile_disc(x[{i}], {_RANKS}))) AS c FROM risk_rows WHERE fit" for i in range(1, 7))}),
binned AS MATERIALIZED (SELECT series_id, minute, target, fit,
    [{", ".join(f"len(list_filter((SELECT c FROM cuts WHERE f = {i}), lambda v: v < x[{i}]))" for i in range(1, 7))}] AS b FROM risk_rows),
cls_0 AS MATERIALIZED (SELECT b, count_if(fit AND target = 1) AS pos, count_if(fit AND target = 0) AS neg, 0::DOUBLE AS margin FROM binned GROUP BY b)"""


def _risk_tree(t: int) -> str:
    """``cls_{t + 1}``: classes with margins after tree t; ``nodes_{t}``: its nodes."""
    parts = [
        f"""at_{t}_0 AS MATERIALIZED (SELECT *, 1 AS node, pos + neg AS n, pos * pos_weight * (1 - p) - neg * p AS g,
    (pos * pos_weight + neg) * p * (1 - p) AS h
  FROM (SELECT *, 1 / (1 + exp(-margin)) AS p FROM cls_{t}), risk_weight)"""
    ]
    for d in range(5):
        parts.append(
            f"""split_{t}_{d} AS MATERIALIZED (
  SELECT node, f, cut, gain FROM (
    SELECT node, f, cut, nl, n - nl AS nr, round(gl * gl / nullif(hl, 0) + (g - gl) * (g - gl) / nullif(h - hl, 0) - g * g / h, 6) AS gain FROM (
      SELECT node, f, cut, sum(n) OVER upto AS nl, sum(g) OVER upto AS gl, sum(h) OVER upto AS hl,
        sum(n) OVER node_ AS n, sum(g) OVER node_ AS g, sum(h) OVER node_ AS h
      FROM (SELECT node, f, b[f] AS cut, sum(n) AS n, sum(g) AS g, sum(h) AS h FROM at_{t}_{d}, range(1, 7) r(f)
        WHERE node >= {1 << d} AND n > 0 GROUP BY ALL)
      WINDOW upto AS (PARTITION BY node, f ORDER BY cut), node_ AS (PARTITION BY node, f)))
  WHERE nl >= 20 AND nr >= 20 AND gain > 0 QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, cut) = 1),
at_{t}_{d + 1} AS MATERIALIZED (SELECT a.* REPLACE (CASE WHEN s.node IS NULL THEN a.node ELSE 2 * a.node + CAST(b[s.f] > s.cut AS INTEGER) END AS node)
  FROM at_{t}_{d} a LEFT JOIN split_{t}_{d} s ON a.node = s.node)"""
        )
    every = " UNION ALL ".join(f"SELECT * FROM split_{t}_{d}" for d in range(5))
    parts.append(
        f"""split_{t} AS MATERIALIZED (SELECT * FROM ({every})
  QUALIFY count(*) OVER () < 31 OR row_number() OVER (ORDER BY node < 16, gain, node) > 1),
leaf_{t} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN node >= 32 AND node // 2 NOT IN (SELECT node FROM split_{t}) THEN node // 2 ELSE node END AS node) FROM at_{t}_5),
value_{t} AS MATERIALIZED (SELECT k AS node, CAST(sum(n) AS BIGINT) AS n_rows, 0.03::DOUBLE * sum(g) / sum(h) AS value
  FROM (SELECT *, unnest(list_filter([node, node // 2, node // 4, node // 8, node // 16, node // 32], lambda v: v > 0)) AS k FROM leaf_{t}) WHERE n > 0 GROUP BY k),
cls_{t + 1} AS MATERIALIZED (SELECT b, pos, neg, margin + value AS margin FROM leaf_{t} JOIN value_{t} USING (node))"""
    )
    return ",\n".join(parts)


RISK_TREES = tuple(map(_risk_tree, range(3)))
RISK_NAMES = "[" + ", ".join(f"'{f}'" for f in RISK_FEATURES) + "]"
EARLY_RISK = "SELECT series_id, minute, target, round(1 / (1 + exp(-margin)), 6) AS risk, 1 / (1 + exp(-margin)) >= {} AS alarm FROM binned JOIN cls_3 USING (b)"

# --- messages --------------------------------------------------------------------------------

_NUM = "printf('%.2f', value)"
_STAMP = "'\"timestamp\":\"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') || '\",'"
_FIELD = "'\"' || tag || '\":'"
_PLAIN = f"'{{' || {_STAMP} || {_FIELD} || {_NUM} || '}}'"


def _one(body: str) -> str:
    return f"'{{\"records\":[{{' || {body} || '}}]}}'"


MSG = f"""msg AS (
  SELECT CASE WHEN k = 24 THEN 'plant/none'
      ELSE 'plant/' || equipment_id || CASE WHEN ord % 2 = 0 THEN '/a' ELSE '/b' END END AS topic,
    CASE k WHEN 7 THEN {_one(f"{_STAMP} || {_FIELD} || 'null'")}
      WHEN 8 THEN {_one(f'''{_STAMP} || '"click":null,"error":null,"purchase":null,"signup":null,"view":null' ''')}
      WHEN 11 THEN '{{"records":[' || {_PLAIN} WHEN 12 THEN '{{"records": 7}}'
      WHEN 13 THEN '{{"records":[4.5,' || {_PLAIN} || ',[]]}}'
      WHEN 14 THEN '[' || {_PLAIN} || ']' WHEN 15 THEN NULL
      WHEN 16 THEN {_one(f"{_FIELD} || {_NUM}")}
      WHEN 17 THEN {_one(f"'\"timestamp\":null,' || {_FIELD} || {_NUM}")}
      WHEN 18 THEN '{{"records":[' || {_PLAIN} || ',' || {_PLAIN} || ']}}'
      WHEN 19 THEN {_one(f"{_STAMP} || {_FIELD} || 'true'")}
      WHEN 20 THEN '{{"records":{{"a":' || {_PLAIN} || '}}}}'
      WHEN 21 THEN '{{"records":["' || replace({_PLAIN}, '"', '\\"') || '"]}}'
      WHEN 22 THEN {_one(f"{_STAMP} || '\"unrelated\":1.0'")}
      WHEN 23 THEN {_one(f"'\"timestamp\":\"soon\",' || {_FIELD} || {_NUM}")}
      ELSE {_one(f"{_STAMP} || {_FIELD} || {_NUM}")} END AS payload,
    ts AS received_at, ord AS "offset"
  FROM ev)"""
ENTRIES = """ok AS (SELECT *, CASE WHEN json_valid(payload) THEN CAST(payload AS JSON) END AS doc FROM msg),
recs AS (
  SELECT topic, received_at, "offset", json_extract(doc, '$.records') AS recs FROM ok
  WHERE json_type(doc) = 'OBJECT' AND json_type(doc, '$.records') = 'ARRAY'),
els AS (
  SELECT topic, received_at, "offset", unnest(json_extract(recs, '$[*]')) AS el,
    unnest(range(CAST(json_array_length(recs) AS BIGINT))) AS position FROM recs),
ent AS (
  SELECT topic, received_at, "offset", position, el, unnest(json_keys(el)) AS tag FROM els
  WHERE json_type(el) = 'OBJECT' AND json_type(el, '$.timestamp') <> 'NULL'),
routed AS (
  SELECT e.*, split_part(topic, '/', 2) AS equipment_id, json_extract(el, '$."' || tag || '"') AS raw
  FROM ent e WHERE topic <> 'plant/none' AND tag IN ('click', 'error', 'purchase', 'signup', 'view'))"""

MONITOR = (
    f"""tagged AS (
  SELECT s.*, c.state, c.episode AS model_version, c.fit_lo, c.fit_hi FROM sn s JOIN ctl c
    ON c.equipment_id = s.equipment_id AND {AT.format(t="s")} WHERE c.model_version IS NOT NULL)""",
    """trn AS (
  SELECT *, usable AND seq - 6 >= fit_lo AS fit FROM tagged
  WHERE state = 'CALIBRATING' AND seq >= fit_lo AND seq < fit_hi)""",
    _fit("trn"),
    "live AS (SELECT * FROM tagged WHERE state = 'MONITORING' AND usable)",
    _score("live"),
)
ALARM = """count_if(anomaly_score >= 3) OVER (PARTITION BY equipment_id, model_version ORDER BY tick
    ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3"""
# --- settings with a history: each era of a machine is a machine of its own --------------------------

MIDDLE = f"((SELECT (min(epoch_us(ts)) + max(epoch_us(ts))) // 2 FROM ev) + {HOUR_US - 1}) // {HOUR_US} - 1"
UNITS = f"""machines AS (SELECT DISTINCT equipment_id AS machine, CAST(substr(equipment_id, 3) AS INTEGER) % 4 AS n FROM ev),
units AS (
  SELECT '0|' || machine AS equipment_id, machine, n, 0 AS era, NULL AS after, CASE WHEN n IN (1, 2) THEN {MIDDLE} END AS until,
    6 AS win, {TAG_LIST} AS tags FROM machines
  UNION ALL
  SELECT '1|' || machine, machine, n, 1, {MIDDLE}, NULL, CASE n WHEN 2 THEN 4 ELSE 6 END, CASE n WHEN 1 THEN {TAG_LIST}[1:4] ELSE {TAG_LIST} END
  FROM machines WHERE n IN (1, 2))"""
_IN_ERA = f"(after IS NULL OR epoch_us(ts) > after * {HOUR_US}) AND (until IS NULL OR epoch_us(ts) <= until * {HOUR_US})"
RD_UNITS = f"""rd_units AS (
  SELECT u.equipment_id, r.tag, r.ts, r.ord, r.value FROM rd r JOIN units u ON u.machine = r.equipment_id
  WHERE {_IN_ERA} AND list_contains(u.tags, r.tag))"""


def _changed(text: str, *pairs: tuple[str, str]) -> str:
    """A fragment with parts replaced; each must be there."""
    for old, new in pairs:
        if old not in text:
            raise ValueError(f"no {old!r}")
        text = text.replace(old, new)
    return text


GRID_UNITS = _changed(
    _grid(),
    (
        f"SELECT unnest({TAG_LIST}) AS tag, unnest(range(len({TAG_LIST}))) AS pos)",
        "SELECT equipment_id, unnest(tags) AS tag, unnest(range(len(tags))) AS pos FROM units)",
    ),
    (
        "SELECT equipment_id, min(tick) AS lo, max(tick) AS hi FROM pts GROUP BY 1",
        "SELECT equipment_id, min(tick) AS lo, greatest(max(tick), coalesce(max(until), max(tick))) AS hi FROM pts JOIN units USING (equipment_id) GROUP BY 1",
    ),
    ("FROM spans CROSS JOIN tags", "FROM spans JOIN tags USING (equipment_id)"),
    (
        """count_if(complete) OVER (
    PARTITION BY equipment_id ORDER BY seq ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) = 7 AS usable
  FROM kept""",
        """seq - coalesce(max(CASE WHEN NOT complete THEN seq END) OVER (PARTITION BY equipment_id ORDER BY seq), -1) > win AS usable
  FROM kept JOIN (SELECT equipment_id, win FROM units) USING (equipment_id)""",
    ),
)
CONTROL_UNITS = _changed(
    CONTROL,
    (
        f"SELECT equipment_id, ts, ord, (epoch_us(ts) + {HOUR_US - 1}) // {HOUR_US} AS tick, k = 0 AS recal\n  FROM ev WHERE k BETWEEN 0 AND 3)",
        f"SELECT u.equipment_id, ts, ord, (epoch_us(ts) + {HOUR_US - 1}) // {HOUR_US} AS tick, k = 0 AS recal,\n"
        f"    CASE WHEN n = 3 AND epoch_us(ts) > ({MIDDLE}) * {HOUR_US} THEN 24 ELSE 48 END AS need\n"
        f"  FROM ev e JOIN units u ON u.machine = e.equipment_id WHERE k BETWEEN 0 AND 3 AND {_IN_ERA})",
    ),
    ("SELECT DISTINCT equipment_id FROM ev)", "SELECT equipment_id FROM units)"),
    ("SELECT equipment_id, ts, ord, tick, since FROM", "SELECT equipment_id, ts, ord, tick, since, need FROM"),
    ("SELECT t.equipment_id, t.tick, t.since, t.ord, count", "SELECT t.equipment_id, t.tick, t.since, t.ord, t.need, count"),
    (
        "FROM found f JOIN eps e ON e.equipment_id = f.equipment_id AND e.start IS NOT DISTINCT FROM f.since",
        "FROM found f JOIN units USING (equipment_id) JOIN eps e ON e.equipment_id = f.equipment_id AND e.start IS NOT DISTINCT FROM f.since",
    ),
    ("AND n >= 48 AND newest_usable - 6 >= fit_lo", "AND f.n >= need AND newest_usable - win >= fit_lo"),
)
ERAS = (EV, RD, UNITS, RD_UNITS, PTS.replace("FROM rd)", "FROM rd_units)"), GRID_UNITS, CONTROL_UNITS)
MONITOR_UNITS = (
    MONITOR[0],
    _changed(MONITOR[1], ("seq - 6 >= fit_lo", "seq - win >= fit_lo"), ("FROM tagged", "FROM tagged JOIN (SELECT equipment_id, win FROM units) USING (equipment_id)")),
    *MONITOR[2:],
)
# Readings as the messages carry them, in order of arrival.
RD_MESSAGES = """rd AS (
  SELECT equipment_id, tag,
    coalesce(try_strptime(json_extract_string(el, '$.timestamp'), '%Y-%m-%dT%H:%M:%S.%fZ'), received_at) AS ts,
    row_number() OVER (ORDER BY received_at, "offset", position) AS ord,
    CASE json_type(raw) WHEN 'BOOLEAN' THEN CASE WHEN raw = 'true' THEN 1::DOUBLE ELSE 0::DOUBLE END
      WHEN 'NULL' THEN NULL ELSE TRY_CAST(raw AS DOUBLE) END AS value
  FROM routed)"""

SQL: dict[str, str] = {
    "inspection_scan": _with(INSP)
    + f"SELECT series_id, row_id, INSP_DATE, INSP_TIME, {' + '.join(f'coalesce({m}, 0)' for m in MEASURES)} AS total FROM insp",
    "inspection_timestamp": _with(INSP, SCALED)
    + "SELECT series_id, row_id, epoch_us(inspected_at) AS inspected_at FROM scaled WHERE inspected_at IS NOT NULL",
    "scale_measures": _with(INSP, SCALED) + f"SELECT series_id, row_id, {', '.join(MEASURES)} FROM scaled",
    "tolerance_judge": _with(INSP, SCALED, JUDGED) + "SELECT series_id, row_id, is_ng FROM judged",
    "minute_ng_count": _with(*MIN) + "SELECT series_id, minute, ng FROM cnt",
    "gap_fill_minutes": _with(*MIN, FILLED) + "SELECT series_id, minute, ng FROM filled",
    "rolling_stats_30": _with(*FEAT)
    + "SELECT series_id, minute, ng_sum_30, ng_mean_30, ng_std_30, ng_max_30 FROM rolled",
    "trend_slope_30": _with(*FEAT) + "SELECT series_id, minute, ng_slope_30 FROM rolled",
    "ewma_gap": _with(*MIN, FILLED, EWMA) + "SELECT series_id, minute, ewma_gap FROM ewma",
    "future_target": _with(*FEAT) + "SELECT series_id, minute, target FROM rolled",
    "chrono_split": _with(*FEAT) + "SELECT series_id, minute, part FROM rolled",
    "ml_feature_table": _with(*FEAT, EWMA)
    + "SELECT series_id, minute, ng, ng_sum_30, ng_mean_30, ng_std_30, ng_max_30, ng_slope_30, ewma_gap, target, part "
    "FROM rolled JOIN ewma USING (series_id, minute)",
    "class_weight": _with(*FEAT)
    + "SELECT count_if(target = 0) AS negatives, count_if(target = 1) AS positives, "
    "round(CASE WHEN count_if(target = 1) > 0 THEN count_if(target = 0)::DOUBLE / count_if(target = 1) ELSE 1 END, 9) "
    "AS scale_pos_weight FROM rolled WHERE part = 'train'",
    "risk_train": _with(*FEAT, EWMA, RISK_ROWS, *RISK_TREES)
    + "SELECT * FROM ("
    + " UNION ALL ".join(
        f"""SELECT {t}::INTEGER AS tree, v.node::INTEGER AS node, {RISK_NAMES}[s.f] AS feature, (SELECT any_value(c[s.cut + 1]) FROM cuts WHERE cuts.f = s.f) AS cut,
  n_rows, round(value, 6) AS value FROM value_{t} v LEFT JOIN split_{t} s USING (node)"""
        for t in range(3)
    )
    + """), (SELECT count(*) AS n, count_if(part = 'train') AS n_train, count_if(part = 'train' AND target = 1) AS n_positive FROM risk_rows),
  (SELECT round(pos_weight, 9) AS scale_pos_weight FROM risk_weight)""",
    "risk_score": _with(*FEAT, EWMA, RISK_ROWS, *RISK_TREES) + EARLY_RISK.format(0.5),
    "forecast_fit_linear": _with(*MODEL, *_window_wide()).replace("WITH ", "WITH RECURSIVE ", 1)
    + f"""SELECT w.equipment_id, tag, tag_type, CAST(ceil(i / 5) AS INTEGER) AS lag,
  CASE WHEN i > 0 THEN {TAG_LIST}[(i - 1) % 5 + 1] END AS source, round(beta[i + 1], 4) AS weight
FROM wide w, range(31) r(i)""",
    "anomaly_score_linear": _with(*MODEL, *_window_wide(), WIDE_SCORE).replace("WITH ", "WITH RECURSIVE ", 1)
    + """SELECT equipment_id, tick, round(max((error - err_mean) / err_std), 4) AS anomaly_score
FROM wide_err JOIN wide_spread USING (equipment_id, pos) JOIN kept USING (equipment_id, seq) GROUP BY ALL""",
    "message_scan": _with(EV, MSG)
    + "SELECT topic, CAST(coalesce(strlen(payload), 3) AS BIGINT) AS payload_bytes, "
    'epoch_us(received_at) AS received_at, "offset" FROM msg',
    "parse_records": _with(EV, MSG, ENTRIES)
    + """SELECT equipment_id, tag,
  epoch_us(coalesce(try_strptime(json_extract_string(el, '$.timestamp'), '%Y-%m-%dT%H:%M:%S.%fZ'), received_at)) AS ts,
  CASE json_type(raw) WHEN 'BOOLEAN' THEN CASE WHEN raw = 'true' THEN 1::DOUBLE ELSE 0::DOUBLE END
    WHEN 'NULL' THEN NULL ELSE TRY_CAST(raw AS DOUBLE) END AS value, "offset", position FROM routed""",
    "route_and_whitelist": _with(EV, MSG, ENTRIES)
    + "SELECT equipment_id, topic, tag, count(*) AS n FROM routed GROUP BY ALL",
    "parse_command": _with(EV)
    + "SELECT equipment_id, ord, CASE WHEN k = 0 THEN 'recalibrate' WHEN k <= 3 THEN 'train' END AS command "
    "FROM ev WHERE k BETWEEN 0 AND 6",
    "parse_duration": """WITH t AS (SELECT p_partkey,
    CASE WHEN p_partkey % 7 = 0 THEN ' ' || p_size || ['s','m','h','d','w',''][p_partkey % 6 + 1] || ' '
      ELSE p_size || ['s','m','h','d','w',''][p_partkey % 6 + 1] END AS text FROM part)
SELECT p_partkey, text, CAST(regexp_extract(trim(text), '^(\\d+)([smhd])$', 1) AS BIGINT)
  * CASE right(trim(text), 1) WHEN 's' THEN 1 WHEN 'm' THEN 60 WHEN 'h' THEN 3600 ELSE 86400 END AS seconds
FROM t WHERE regexp_matches(trim(text), '^\\d+[smhd]$')
UNION ALL SELECT p_partkey, text, NULL FROM t WHERE NOT regexp_matches(trim(text), '^\\d+[smhd]$')""",
    "config_rows": """SELECT c_name AS equipment_id, c_custkey % 13 NOT BETWEEN 1 AND 10 AS valid,
  CASE c_custkey % 13 WHEN 1 THEN 'subscribe_topics is missing'
    WHEN 2 THEN 'subscribe_topics is empty' WHEN 3 THEN 'publish_topic is missing'
    WHEN 4 THEN 'tags is empty' WHEN 5 THEN 'resample_interval_ms is not positive'
    WHEN 6 THEN 'window_size is not positive' WHEN 7 THEN 'window_size is missing'
    WHEN 8 THEN 'max_duration is no duration' WHEN 9 THEN 'max_duration is missing'
    WHEN 10 THEN 'min_samples is not positive' ELSE '' END AS reasons,
  CASE WHEN c_custkey % 13 NOT IN (8, 9) THEN 604800::BIGINT END AS max_duration_s FROM customer""",
    "asof_snapshot": _with(*SNAP) + "SELECT equipment_id, tick, tag, value FROM held",
    "drop_empty_snapshot": _with(*SNAP) + "SELECT equipment_id, tick, seq FROM kept",
    "sliding_windows": _with(*SNAP)
    + """SELECT equipment_id, tag, tick, history, target FROM (
  SELECT equipment_id, tag, tick, usable, value AS target,
    list(value) OVER (PARTITION BY equipment_id, tag ORDER BY seq ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS h,
    array_to_string(list_transform(h, lambda v: printf('%.2f', v)), ',') AS history FROM sn) WHERE usable""",
    "recent_n": _with(*SNAP)
    + "SELECT equipment_id, tick FROM kept QUALIFY row_number() OVER (PARTITION BY equipment_id ORDER BY tick DESC) <= 100",
    "detect_tag_types": _with(*MODEL) + "SELECT equipment_id, tag, tag_type FROM stats",
    "normalization_stats": _with(*MODEL)
    + "SELECT equipment_id, tag, round(mean, 6) AS mean, round(std, 6) AS std FROM stats WHERE tag_type = 'continuous'",
    "never_observed_tags": _with(EV, RD, PTS, _grid(" || ['ghost']"))
    + "SELECT equipment_id, tag FROM sn GROUP BY 1, 2 HAVING count(value) = 0",
    "dtype_partition": _with(*MODEL)
    + """SELECT equipment_id, coalesce(string_agg(pos, ',' ORDER BY pos) FILTER (tag_type = 'continuous'), '') AS continuous,
  coalesce(string_agg(pos, ',' ORDER BY pos) FILTER (tag_type = 'binary'), '') AS "binary" FROM stats GROUP BY 1""",
    "stats_lookup": _with(*MODEL)
    + """SELECT s.equipment_id, s.tick, s.tag, s.value, round(t.mean, 6) AS mean, round(t.std, 6) AS std
FROM sn s LEFT JOIN stats t ON t.equipment_id = s.equipment_id AND t.tag = s.tag AND t.tag_type = 'continuous'""",
    "normalize": _with(*MODEL)
    + "SELECT equipment_id, tick, tag, round((value - norm_mean) / norm_std, 6) AS value FROM zs",
    "std_floor": """SELECT user_id, round(greatest(stddev_pop(value) / 100, 1e-3::DOUBLE, 0.05::DOUBLE * abs(avg(value))), 9) AS floored
FROM events GROUP BY 1""",
    "forecast_fit": _with(*MODEL)
    + """SELECT equipment_id, tag, tag_type, n_windows, round(norm_mean, 6) AS norm_mean, round(norm_std, 6) AS norm_std,
  round(slope, 6) AS slope, round("offset", 6) AS "offset" FROM lines""",
    "raw_errors": _with(*MODEL) + "SELECT equipment_id, tick, tag, round(error, 6) AS error FROM fit_err",
    "error_stats": _with(*MODEL)
    + "SELECT equipment_id, tag, round(err_mean, 6) AS err_mean, round(err_std, 6) AS err_std FROM err",
    "anomaly_score": _with(*MODEL, LIVE_ALL, _score("live"))
    + "SELECT equipment_id, tick, round(anomaly_score, 5) AS anomaly_score FROM best",
    "anomaly_score_other_order": _with(*MODEL, LIVE_ALL, _score("live"))
    + "SELECT equipment_id, tick, round(anomaly_score, 5) AS anomaly_score FROM best WHERE CAST(equipment_id[3:] AS INTEGER) % 4 <> 0",
    "top_deviant": _with(*MODEL, LIVE_ALL, _score("live")) + "SELECT equipment_id, tick, top_deviant_tag FROM best",
    "debounce": """SELECT CAST(user_id AS VARCHAR) AS equipment_id, epoch_us(ts) // 864000000000 AS model_version, event_id AS tick,
  value AS anomaly_score,
  count_if(value >= 20) OVER (PARTITION BY user_id, epoch_us(ts) // 864000000000 ORDER BY event_id
    ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3 AS alarm FROM events""",
    "train_hook": _with(*SNAP)
    + "SELECT equipment_id, count(*) AS n, CAST(pos AS INTEGER) AS pos, round(avg(value), 6) AS level FROM sn GROUP BY equipment_id, pos",
    "train_attempts": _with(EV, RD, PTS, _grid(" || ['ghost']"), CONTROL)
    + """SELECT f.equipment_id, e.episode, f.tick, f.n AS n_samples, reason,
  CASE WHEN reason LIKE 'no full%' THEN coalesce(string_agg(u.tag, ',' ORDER BY u.pos) FILTER (u.seen = 0), '') END AS unseen_tags
FROM (
  SELECT *, CASE WHEN n < 48 THEN 'too few samples'
    WHEN coalesce(newest_usable - 6, -1) < fit_lo THEN 'no full window to train on' END AS reason
  FROM found WHERE since IS DISTINCT FROM tick QUALIFY row_number() OVER (PARTITION BY equipment_id, tick ORDER BY ord) = 1) f
JOIN eps e ON e.equipment_id = f.equipment_id AND e.start IS NOT DISTINCT FROM f.since
LEFT JOIN (
  SELECT c.equipment_id, c.tick AS at, s.tag, s.pos, count(s.value) AS seen
  FROM (SELECT DISTINCT equipment_id, tick, fit_lo, fit_hi FROM found WHERE since IS DISTINCT FROM tick) c
  JOIN sn s ON s.equipment_id = c.equipment_id AND s.seq >= c.fit_lo AND s.seq < c.fit_hi GROUP BY ALL) u
  ON u.equipment_id = f.equipment_id AND u.at = f.tick
GROUP BY f.equipment_id, e.episode, f.tick, f.n, f.reason""",
    "control_intervals": _with(*CTL)
    + "SELECT equipment_id, episode, state, valid_from, valid_to, model_version, fit_lo, fit_hi FROM ctl",
    "state_asof": _with(*CTL)
    + f"""SELECT w.equipment_id, w.tick, c.state, c.episode, c.model_version
FROM win w JOIN ctl c ON c.equipment_id = w.equipment_id AND {AT.format(t="w")}""",
    "train_gate": _with(*CTL, SMP)
    + "SELECT equipment_id, count(*) AS n_samples, 48 AS min_samples, count(*) >= 48 AS allowed FROM smp GROUP BY 1",
    "calibration_append": _with(*CTL, SMP) + "SELECT equipment_id, episode, tick FROM smp",
    "calibration_count": _with(*CTL, SMP) + "SELECT equipment_id, count(*) AS n_samples FROM smp GROUP BY 1",
    "calibration_clear": _with(*CTL, SMP)
    + """SELECT s.equipment_id, s.episode, s.tick FROM smp s JOIN ctl c USING (equipment_id, episode)
WHERE c.valid_to IS NULL AND c.state = 'CALIBRATING'""",
    "calibration_read": _with(*CTL, SMP)
    + f"""SELECT s.equipment_id, s.tick * {HOUR_US} AS ts, n.tag, n.value FROM smp s JOIN sn n USING (equipment_id, tick)""",
    "calibration_prune": _with(*SNAP)
    + f"""SELECT k.equipment_id, k.tick FROM kept k
JOIN (SELECT equipment_id, max(epoch_us(ts)) AS now FROM rd GROUP BY 1) n USING (equipment_id)
WHERE k.tick * {HOUR_US} >= n.now - 604800000000""",
    "state_table": _with(EV)
    + """SELECT DISTINCT equipment_id, CASE WHEN CAST(equipment_id[3:] AS INTEGER) % 4 = 0 THEN 'MONITORING'
  WHEN CAST(equipment_id[3:] AS INTEGER) % 4 = 1 THEN 'MONITORING' ELSE 'CALIBRATING' END AS state FROM ev""",
    "model_compat": _with(EV)
    + """SELECT DISTINCT equipment_id, CAST(CAST(equipment_id[3:] AS INTEGER) % 3 AS BIGINT) AS model_version,
  CAST(equipment_id[3:] AS INTEGER) % 3 = 0 AS ok,
  CASE CAST(equipment_id[3:] AS INTEGER) % 3 WHEN 1 THEN 'window_size differs' WHEN 2 THEN 'tags differ' END AS reason FROM ev""",
    "resume_or_fallback": _with(EV)
    + """SELECT DISTINCT equipment_id, CASE WHEN n % 4 < 2 AND n % 3 = 0 THEN 'MONITORING' ELSE 'CALIBRATING' END AS state,
  CASE WHEN n % 4 < 2 AND n % 3 = 0 THEN 0::BIGINT END AS model_version,
  CASE WHEN n % 4 < 2 AND n % 3 = 1 THEN 'window_size differs' WHEN n % 4 < 2 AND n % 3 = 2 THEN 'tags differ' END AS reason
FROM (SELECT equipment_id, CAST(equipment_id[3:] AS INTEGER) AS n FROM ev)""",
    "model_save": _with(EV)
    + """SELECT DISTINCT equipment_id, 0::BIGINT AS model_version, 6 AS window_size, 5 AS n_tags FROM ev""",
    "model_load": _with(*MODEL, LIVE_ALL, _score("live"))
    + "SELECT equipment_id, tick, round(anomaly_score, 5) AS anomaly_score FROM best",
    "monitor_alarms": _with(*CTL, *MONITOR)
    + f"SELECT equipment_id, model_version, tick, round(anomaly_score, 4) AS anomaly_score, top_deviant_tag, {ALARM} AS alarm FROM best",
    "settings_intervals": _with(*ERAS)
    + """SELECT machine AS equipment_id, CAST(era AS BIGINT) AS era, episode, state, coalesce(valid_from, after + 1) AS valid_from,
  coalesce(valid_to, until + 1) AS valid_to, model_version, fit_lo, fit_hi,
  CASE WHEN era = 1 AND valid_from IS NULL THEN CASE n WHEN 1 THEN 'tags differ' ELSE 'window_size differs' END END AS cause
FROM ctl JOIN units USING (equipment_id)""",
    "settings_alarms": _with(*ERAS, *MONITOR_UNITS)
    + f"""SELECT machine AS equipment_id, CAST(era AS BIGINT) AS era, model_version, tick, anomaly_score, top_deviant_tag, alarm FROM (
  SELECT equipment_id, model_version, tick, round(anomaly_score, 4) AS anomaly_score, top_deviant_tag, {ALARM} AS alarm FROM best)
JOIN units USING (equipment_id)""",
    "message_alarms": _with(EV, MSG, ENTRIES, RD_MESSAGES, PTS, _grid(), CONTROL, *MONITOR)
    + f"SELECT equipment_id, tick, round(anomaly_score, 4) AS anomaly_score, top_deviant_tag, {ALARM} AS alarm FROM best",
    "stream_pipeline": _with(*STREAMED, CONTROL, *MONITOR)
    + f"SELECT equipment_id, tick, round(anomaly_score, 4) AS anomaly_score, top_deviant_tag, {ALARM} AS alarm FROM best",
    "stream_silent_ticks": _with(EV, RD + f""",
heard AS (
  SELECT * FROM rd WHERE CAST(substr(equipment_id, 3) AS INTEGER) % 3 = 0
    OR epoch_us(ts) < (SELECT (min(epoch_us(ts)) + max(epoch_us(ts))) // 2 FROM rd))""", PTS.replace("FROM rd", "FROM heard"), _grid(end=f"(SELECT max(epoch_us(ts)) // {HOUR_US} FROM rd)"))
    + "SELECT equipment_id, tick, tag, value FROM sn",
    "stream_snapshots": _with(*STREAMED) + "SELECT equipment_id, tick, tag, value, seq, usable FROM sn",
    "stream_control": _with(*STREAMED, CONTROL)
    + "SELECT equipment_id, episode, state, valid_from, valid_to, model_version, fit_lo, fit_hi FROM ctl",
    "stream_monitor": _with(
        *MODEL, LIVE_GRID, "live AS (SELECT *, 0::BIGINT AS model_version FROM s_sn WHERE usable)", _score("live")
    )
    + """SELECT equipment_id, tick, round(anomaly_score, 4) AS anomaly_score, top_deviant_tag,
  count_if(anomaly_score >= 3) OVER (PARTITION BY equipment_id ORDER BY tick
    ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3 AS alarm FROM best""",
    "stream_minute_features": _with(*FEAT, EWMA)
    + """SELECT series_id, minute, ng, ng_sum_30, ng_mean_30, ng_std_30, ng_max_30, ng_slope_30, ewma_gap
FROM rolled JOIN ewma USING (series_id, minute)
JOIN (SELECT series_id, max(minute) AS done FROM cnt
  WHERE minute < (SELECT max(minute) FROM cnt) GROUP BY 1) USING (series_id) WHERE minute <= done""",
    "stream_minute_changes": _with(*FEAT, EWMA)
    + """SELECT series_id, minute, ng, ng_sum_30, ng_mean_30, ng_std_30, ng_max_30, ng_slope_30, ewma_gap
FROM rolled JOIN ewma USING (series_id, minute)""",
    "stream_minute_risk": _with(*FEAT, EWMA, RISK_ROWS, *RISK_TREES)
    + f"""SELECT series_id, minute, risk, alarm FROM ({EARLY_RISK.format(0.6)})
JOIN (SELECT series_id, max(minute) AS done FROM cnt
  WHERE minute < (SELECT max(minute) FROM cnt) GROUP BY 1) USING (series_id) WHERE minute <= done""",
    "result_envelope": _with(EV)
    + f"""SELECT 'alarms/' || equipment_id AS topic,
  strftime(make_timestamp(ord * {HOUR_US}), '%Y-%m-%dT%H:%M:%S.%f+00:00') AS sent_at,
  'timestamp,edge:anomaly_score,edge:alarm,edge:top_deviant_tag' AS fields, round(value, 2) AS anomaly_score,
  CASE WHEN k >= 90 THEN 'true' ELSE 'false' END AS alarm, tag AS top_deviant_tag FROM ev""",
}
