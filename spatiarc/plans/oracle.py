"""DuckDB SQL for the named queries, over the driver's ``events`` table."""

from __future__ import annotations

import math

from spatiarc.functions.expressions import rounded_ratio_sql
from spatiarc.sources.fixtures import CELLS_SQL, GENES, SETS, expr_sql

T, F1, F2 = "hypoxia_score", "inflammation_score", "noise_score"
STEPS_RADIUS = [25.0, 50.0, 75.0, 100.0, 125.0, 150.0]


def shift_rows(steps, euclidean: bool = False):
    """The eight displacements of each step, written out here so that SQL and engine don't share them."""
    rows = []
    for s in steps:
        k = s / math.sqrt(2) if euclidean else s
        rows += [(s, "add_X", s, 0.0), (s, "minus_X", -s, 0.0), (s, "add_Y", 0.0, s), (s, "minus_Y", 0.0, -s)]
        rows += [(s, "add_X_add_Y", k, k), (s, "add_X_minus_Y", k, -k), (s, "minus_X_add_Y", -k, k), (s, "minus_X_minus_Y", -k, -k)]
    return rows


def operator_shift_rows(right, left, up, down):
    s, r, l, u, w = (float(x) for x in (max(right, left, up, down), right, left, up, down))
    return [
        (s, "add_X", r, 0.0), (s, "minus_X", -l, 0.0), (s, "add_Y", 0.0, u), (s, "minus_Y", 0.0, -w),
        (s, "add_X_add_Y", r, u), (s, "add_X_minus_Y", r, -w), (s, "minus_X_add_Y", -l, u), (s, "minus_X_minus_Y", -l, -w),
    ]


CELLS = "cells AS (SELECT obs_idx, sample_name AS sample, x_centroid AS x, y_centroid AS y, noise_score, hypoxia_score, inflammation_score FROM (" + CELLS_SQL.format(events="events") + "))"
PLACED = """origin AS (SELECT sample, min(x) AS x0, min(y) AS y0 FROM cells GROUP BY sample),
placed AS (SELECT cells.*, CAST(floor((x - x0) / 20::DOUBLE + 1e-12) AS BIGINT) AS gx, CAST(floor((y - y0) / 20::DOUBLE + 1e-12) AS BIGINT) AS gy FROM cells JOIN origin USING (sample))"""
BASE = f"{CELLS},\n{PLACED}"


def grid(agg: str = "avg", k: int = 1) -> str:
    cols = ", ".join(f"{agg}({n}) AS {n}" for n in (T, F1, F2))
    return f"grid AS (SELECT sample, gx, gy, count(*) AS n_cells, {cols} FROM placed GROUP BY ALL HAVING count(*) >= {k})"


LONG_GRID = f"""lg AS (SELECT sample, gx, gy, n_cells, '{T}' AS feature, {T} AS value FROM grid UNION ALL SELECT sample, gx, gy, n_cells, '{F1}', {F1} FROM grid
UNION ALL SELECT sample, gx, gy, n_cells, '{F2}', {F2} FROM grid)"""
LONG_CELL = f"""lc AS (SELECT sample, obs_idx, x, y, '{T}' AS feature, {T} AS value FROM cells UNION ALL SELECT sample, obs_idx, x, y, '{F1}', {F1} FROM cells
UNION ALL SELECT sample, obs_idx, x, y, '{F2}', {F2} FROM cells)"""
LOCAL = "cut AS (SELECT sample, feature, avg(value) AS cutoff FROM lg GROUP BY ALL),\nm AS (SELECT lg.*, cutoff, coalesce(value > cutoff, false) AS active FROM lg JOIN cut USING (sample, feature))"
MASKS = f"{BASE},\n{grid()},\n{LONG_GRID},\n{LOCAL}"


def shifts(rows) -> str:
    values = ", ".join(f"({s!r}::DOUBLE, '{d}', {x!r}::DOUBLE, {y!r}::DOUBLE)" for s, d, x, y in rows)
    return f"shifts(step, direction, dx, dy) AS (VALUES {values})"


def stat(rows, features, target: str = T) -> str:
    """CTEs up to ``stat``; they need ``m`` (sample, gx, gy, feature, active)."""
    listed = ", ".join(f"'{f}'" for f in features)
    j = rounded_ratio_sql
    return f"""{shifts(rows)},
still AS (SELECT f.sample, f.feature, count(*) AS cnt_all, CAST(sum(t.active::INT) AS BIGINT) AS ot, CAST(sum(f.active::INT) AS BIGINT) AS nf, CAST(sum((t.active AND f.active)::INT) AS BIGINT) AS oi
  FROM m f JOIN m t ON t.feature = '{target}' AND t.sample = f.sample AND t.gx = f.gx AND t.gy = f.gy WHERE f.feature IN ({listed}) GROUP BY ALL),
met AS (SELECT f.sample, f.feature, step, direction, count(*) AS n, sum(t.active::INT) AS t, sum(f.active::INT) AS b, sum((t.active AND f.active)::INT) AS i
  FROM (SELECT m.*, s.step, s.direction, gx + CAST(dx AS BIGINT) AS kx, gy + CAST(dy AS BIGINT) AS ky FROM m CROSS JOIN shifts s WHERE feature IN ({listed})) f
  JOIN (SELECT * FROM m WHERE feature = '{target}') t ON t.sample = f.sample AND t.gx = f.kx AND t.gy = f.ky GROUP BY ALL),
counts AS (SELECT s.*, sh.step, sh.direction, CAST(coalesce(n, 0) AS BIGINT) AS cnt_px, CAST(coalesce(t, 0) AS BIGINT) AS cnt_p1, CAST(coalesce(b, 0) AS BIGINT) AS cnt_p2, CAST(coalesce(i, 0) AS BIGINT) AS cnt_p
  FROM still s CROSS JOIN shifts sh LEFT JOIN met USING (sample, feature, step, direction)),
ratios AS (SELECT *, {j("cnt_p", "(cnt_p1 + cnt_p2 - cnt_p)")} AS pct_p, {j("cnt_p", "greatest(cnt_p1, cnt_p2)")} AS pct_pmin, {j("cnt_p", "least(cnt_p1, cnt_p2)")} AS pct_pmax,
  {j("oi", "(ot + nf - oi)")} AS pct_op, {j("oi", "greatest(ot, nf)")} AS pct_opmin, {j("oi", "least(ot, nf)")} AS pct_opmax FROM counts),
stat AS (SELECT *, pct_p - pct_op AS diff_pct FROM ratios)"""


STAT_COLUMNS = ["pct_p", "pct_pmin", "pct_pmax", "pct_op", "pct_opmin", "pct_opmax", "diff_pct", "cnt_p", "cnt_p1", "cnt_p2", "cnt_px", "cnt_all"]
STEPS = [2.0, 4.0, 6.0, 8.0, 10.0, 12.0]
VECTORS = f"""WITH {MASKS},
{stat(shift_rows(STEPS), [F1, F2])},
vectors AS (SELECT sample, feature, step, min(diff_pct) AS mn, max(diff_pct) AS mx, any_value(cnt_all) AS n_bins, any_value(ot) AS nt, any_value(nf) AS nf FROM stat GROUP BY ALL)"""
COHORT = f"{VECTORS},\ncohort AS (SELECT feature, step, avg(mn) AS mn, avg(mx) AS mx, count(*) AS n_samples FROM vectors GROUP BY ALL)"


def vector_rows(source: str, target_niche: bool = False, counts: str = "n_bins", extra: str = "", backend: str = "grid") -> str:
    ct = "CAST(NULL AS DOUBLE)" if target_niche else "round(ct.cutoff, 9)"
    join = "" if target_niche else f"LEFT JOIN cut ct ON ct.sample = v.sample AND ct.feature = '{T}'"
    share = lambda c: f"round(CAST({c} AS DOUBLE) / nullif(CAST({counts} AS DOUBLE), 0), 9)"
    return f"""SELECT round(mn, 9) AS min_djaccard, round(mx, 9) AS max_djaccard, v.feature, step, v.sample, {ct} AS cutoff_target, round(cf.cutoff, 9) AS cutoff_feature, {counts},
  nt AS n_positive_target, nf AS n_positive_feature, {share("nt")} AS positive_fraction_target, {share("nf")} AS positive_fraction_feature, nt AS n_binary_target, nf AS n_binary_feature,
  {share("nt")} AS binary_fraction_target, {share("nf")} AS binary_fraction_feature, '{"niche" if target_niche else "positive"}' AS binary_source_target, 'positive' AS binary_source_feature,
  {extra}'{backend}' AS backend FROM {source} v {join} LEFT JOIN cut cf ON cf.sample = v.sample AND cf.feature = v.feature"""


def niche_ctes(features=(T,), connectivity: int = 8) -> str:
    """Recursive labelling: CTEs ``nv`` (positive cells), ``ngrid`` (with niche_id) and ``sizes``; for WITH RECURSIVE."""
    near = "abs(n.gx - r.gx) <= 1 AND abs(n.gy - r.gy) <= 1" if connectivity == 8 else "abs(n.gx - r.gx) + abs(n.gy - r.gy) = 1"
    cut = " ".join(f"WHEN '{f}' THEN {c}::DOUBLE" for f, c in ((T, 1.5), (F1, 2.5)))
    listed = ", ".join(f"'{f}'" for f in features)
    return f"""{BASE}, {grid()}, {LONG_GRID},
nv AS (SELECT *, CASE feature {cut} END AS cutoff, coalesce(value > CASE feature {cut} END, false) AS positive FROM lg WHERE feature IN ({listed})),
pos AS (SELECT sample, feature, gx, gy FROM nv WHERE positive),
reach AS (SELECT sample, feature, gx, gy, gy * 1000000 + gx AS root FROM pos UNION
  SELECT n.sample, n.feature, n.gx, n.gy, r.root FROM reach r JOIN pos n ON n.sample = r.sample AND n.feature = r.feature AND {near}),
label AS (SELECT sample, feature, gx, gy, min(root) AS root FROM reach GROUP BY ALL),
sizes AS (SELECT sample, feature, root, count(*) AS n_grids FROM label GROUP BY ALL),
kept AS (SELECT sample, feature, root, n_grids, CAST(row_number() OVER (PARTITION BY sample, feature ORDER BY root) AS INTEGER) AS niche_id FROM sizes WHERE n_grids >= 3),
ngrid AS (SELECT nv.*, k.niche_id IS NOT NULL AS niche, coalesce(k.niche_id, 0) AS nid FROM nv LEFT JOIN label l USING (sample, feature, gx, gy) LEFT JOIN kept k USING (sample, feature, root))"""


def niche_grids(connectivity: int) -> str:
    return f"WITH RECURSIVE {niche_ctes((T,), connectivity)} SELECT sample, feature, gx, gy, n_cells, positive, niche, nid AS niche_id FROM ngrid"


def units(level: str) -> str:
    if level == "cell":
        return f"{CELLS}, {LONG_CELL}, units AS (SELECT feature, sample, CAST(obs_idx AS VARCHAR) AS key, value FROM lc WHERE feature <> '{F2}' AND value IS NOT NULL)"
    return f"{BASE}, {grid()}, {LONG_GRID}, units AS (SELECT feature, sample, concat_ws('|', gx, gy) AS key, value FROM lg WHERE feature <> '{F2}' AND value IS NOT NULL)"


def replicates(level: str, pick: str, n: int) -> str:
    return f"""{units(level)},
sized AS (SELECT feature, sample, count(*) AS n_units FROM units GROUP BY ALL),
least AS (SELECT feature, min(n_units) AS least, count(*) AS n_samples FROM sized GROUP BY ALL),
draws AS (SELECT feature, n_samples, CASE WHEN least - least % 100 = 0 THEN least ELSE least - least % 100 END AS n_draw FROM least),
named AS (SELECT *, md5(concat_ws('|', '666', feature, sample, key)) AS h FROM units),
hashed AS (SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % 2147483647 AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % 2147483647 AS b FROM named),
ranked AS (SELECT u.feature, rep, u.sample, value, n_draw, n_samples, row_number() OVER (PARTITION BY u.feature, rep, u.sample ORDER BY (a * rep * 48271 % 2147483647 + b) % 2147483647, u.key) AS place
  FROM hashed u JOIN draws USING (feature) CROSS JOIN (SELECT CAST(range AS INTEGER) AS rep FROM range(1, {n} + 1)) r),
reps AS (SELECT feature, rep, {pick}(value) AS cutoff, any_value(n_draw) AS n_per_sample, any_value(n_samples) AS n_samples FROM ranked WHERE place <= n_draw GROUP BY ALL)"""


def adjusted(x: str, y: str) -> str:
    return f"WITH {CELLS} SELECT obs_idx, sample, {x} AS x, {y} AS y, round({T}, 9) AS value FROM cells WHERE sample = 'view'"


BINS = f"""WITH {CELLS},
span AS (SELECT sample, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM cells GROUP BY sample),
binned AS (SELECT c.sample, c.{T} AS value, len(list_filter(range(1, 8), lambda i: x >= x0 + i * ((x1 - x0) / 8))) AS col, 5 - len(list_filter(range(1, 6), lambda i: y >= y0 + i * ((y1 - y0) / 6))) AS row FROM cells c JOIN span USING (sample)),
frame AS (SELECT sample, CAST(r.range AS INTEGER) AS row, CAST(c.range AS INTEGER) AS col FROM span, range(6) r, range(8) c),
tallied AS (SELECT sample, row, col, count(value) AS n, avg((value > 2)::INT::DOUBLE) AS share FROM binned GROUP BY ALL),
out AS (SELECT f.sample, f.row, f.col, coalesce(n, 0) AS n, CASE WHEN n > 3 THEN share END AS pct FROM frame f LEFT JOIN tallied t ON t.sample = f.sample AND t.row = f.row AND t.col = f.col)
SELECT sample, row, col, n, round(pct, 9) AS pct, CAST(coalesce(pct > 0.4, false) AS INTEGER) AS mask FROM out"""

RCELLS = f"{CELLS.replace('FROM (', 'FROM (', 1)}, rc AS (SELECT * FROM cells)"
RACTIVE = f"""{RCELLS}, rl AS (SELECT sample, obs_idx, x, y, '{T}' AS feature, {T} AS value FROM rc UNION ALL SELECT sample, obs_idx, x, y, '{F1}', {F1} FROM rc UNION ALL SELECT sample, obs_idx, x, y, '{F2}', {F2} FROM rc),
cut AS (SELECT sample, feature, avg(value) AS cutoff FROM rl GROUP BY ALL),
act AS (SELECT rl.sample, obs_idx, x, y, rl.feature FROM rl JOIN cut USING (sample, feature) WHERE value > cutoff)"""
NEAR = "(c.x - a.x - dx) * (c.x - a.x - dx) + (c.y - a.y - dy) * (c.y - a.y - dy) < 228.01"
STILL = f"dom AS (SELECT DISTINCT c.sample, a.feature, c.obs_idx FROM rc c JOIN (SELECT *, 0::DOUBLE AS dx, 0::DOUBLE AS dy FROM act) a ON a.sample = c.sample AND {NEAR})"


def radius_ctes(steps, features, euclidean: bool = False) -> str:
    listed = ", ".join(f"'{f}'" for f in features)
    return f"""{RACTIVE}, {shifts(shift_rows(steps, euclidean))}, {STILL},
pairs AS (SELECT c.sample, a.feature, step, direction, c.obs_idx AS anchor, a.obs_idx AS active FROM rc c JOIN (SELECT * FROM act CROSS JOIN shifts WHERE feature IN ({listed})) a ON a.sample = c.sample AND {NEAR}),
moved AS (SELECT DISTINCT sample, feature, step, direction, anchor FROM pairs),
cover AS (SELECT a.sample, a.feature, s.step, s.direction, a.n_active, coalesce(p.n, 0) AS n_covered, CAST(coalesce(p.n, 0) AS DOUBLE) / CAST(a.n_active AS DOUBLE) AS coverage
  FROM (SELECT sample, feature, count(*) AS n_active FROM act WHERE feature IN ({listed}) GROUP BY ALL) a CROSS JOIN shifts s
  LEFT JOIN (SELECT sample, feature, step, direction, count(DISTINCT active) AS n FROM pairs GROUP BY ALL) p USING (sample, feature, step, direction))"""


def radius_vectors(euclidean: bool = False, least: float = 0.0, steps=tuple(STEPS_RADIUS)) -> str:
    j = rounded_ratio_sql
    return f"""WITH {radius_ctes(steps, [F1], euclidean)},
tdom AS (SELECT sample, obs_idx FROM dom WHERE feature = '{T}'),
per AS (SELECT sample, count(*) AS n_anchors FROM rc GROUP BY sample), pt AS (SELECT sample, count(*) AS ot FROM tdom GROUP BY sample),
o AS (SELECT d.sample, d.feature, count(*) AS nd, count(t.obs_idx) AS oi FROM dom d LEFT JOIN tdom t USING (obs_idx) WHERE d.feature = '{F1}' GROUP BY ALL),
h AS (SELECT m.sample, m.feature, step, direction, count(*) AS nb, count(t.obs_idx) AS i FROM moved m LEFT JOIN tdom t ON t.obs_idx = m.anchor GROUP BY ALL),
k AS (SELECT c.*, n_anchors, ot, nd, oi, coverage >= {least} AS ok, CASE WHEN coverage >= {least} THEN coalesce(nb, 0) ELSE 0 END AS nb, CASE WHEN coverage >= {least} THEN coalesce(i, 0) ELSE 0 END AS i
  FROM cover c JOIN per USING (sample) JOIN pt USING (sample) JOIN o USING (sample, feature) LEFT JOIN h USING (sample, feature, step, direction)),
d AS (SELECT *, CASE WHEN ok THEN {j("i", "(ot + nb - i)")} END - {j("oi", "(ot + nd - oi)")} AS diff FROM k),
nt AS (SELECT sample, count(*) AS nt FROM act WHERE feature = '{T}' GROUP BY sample),
rv AS (SELECT sample, feature, step, min(diff) AS mn, max(diff) AS mx, any_value(n_anchors) AS n_anchors, any_value(n_active) AS nf, any_value(nt) AS nt, min(coverage) AS cmin, avg(coverage) AS cavg
  FROM d JOIN nt USING (sample) GROUP BY ALL)
{vector_rows("rv", counts="n_anchors", extra="round(cmin, 9) AS min_direction_coverage, round(cavg, 9) AS mean_direction_coverage, ", backend="kdtree")}"""


PAIRS_GRID = f"""{MASKS},
{shifts(shift_rows([12.0]))},
po AS (SELECT f.sample, t.feature AS target, f.feature, sum(t.active::INT) AS a0, sum(f.active::INT) AS b0, sum((t.active AND f.active)::INT) AS i0 FROM m f JOIN m t USING (sample, gx, gy) WHERE t.feature <> f.feature GROUP BY ALL),
pm AS (SELECT f.sample, t.feature AS target, f.feature, direction, sum(t.active::INT) AS a1, sum(f.active::INT) AS b1, sum((t.active AND f.active)::INT) AS i1
  FROM (SELECT m.*, direction, gx + CAST(dx AS BIGINT) AS kx, gy + CAST(dy AS BIGINT) AS ky FROM m CROSS JOIN shifts) f JOIN m t ON t.sample = f.sample AND t.gx = f.kx AND t.gy = f.ky AND t.feature <> f.feature GROUP BY ALL),
pd AS (SELECT po.sample, po.target, po.feature, {rounded_ratio_sql("i1", "(a1 + b1 - i1)")} - {rounded_ratio_sql("i0", "(a0 + b0 - i0)")} AS d FROM po CROSS JOIN shifts s LEFT JOIN pm ON pm.sample = po.sample AND pm.target = po.target AND pm.feature = po.feature AND pm.direction = s.direction),
ps AS (SELECT sample, target, feature, (min(d) + max(d)) / 2 AS projected_score FROM pd GROUP BY ALL)"""

PAIRS_RADIUS = f"""WITH {radius_ctes([75.0], [T, F1, F2])},
fs(feature) AS (VALUES ('{T}'), ('{F1}'), ('{F2}')),
n0 AS (SELECT sample, feature, count(*) AS n FROM dom GROUP BY ALL), n1 AS (SELECT sample, feature, direction, count(*) AS n FROM moved GROUP BY ALL),
i0 AS (SELECT a.sample, b.feature AS target, a.feature, count(*) AS i FROM dom a JOIN dom b USING (sample, obs_idx) GROUP BY ALL),
i1 AS (SELECT a.sample, b.feature AS target, a.feature, direction, count(*) AS i FROM moved a JOIN dom b ON b.sample = a.sample AND b.obs_idx = a.anchor GROUP BY ALL),
base AS (SELECT s.sample, t.feature AS target, f.feature, h.direction, coalesce(a.n, 0) AS a0, coalesce(b.n, 0) AS b0, coalesce(i0.i, 0) AS i0, coalesce(c.n, 0) AS b1, coalesce(i1.i, 0) AS i1
  FROM (SELECT DISTINCT sample FROM rc) s CROSS JOIN fs t CROSS JOIN fs f CROSS JOIN shifts h LEFT JOIN n0 a ON a.sample = s.sample AND a.feature = t.feature LEFT JOIN n0 b ON b.sample = s.sample AND b.feature = f.feature
  LEFT JOIN n1 c ON c.sample = s.sample AND c.feature = f.feature AND c.direction = h.direction LEFT JOIN i0 ON i0.sample = s.sample AND i0.target = t.feature AND i0.feature = f.feature
  LEFT JOIN i1 ON i1.sample = s.sample AND i1.target = t.feature AND i1.feature = f.feature AND i1.direction = h.direction WHERE t.feature <> f.feature),
dd AS (SELECT sample, target, feature, {rounded_ratio_sql("i1", "(a0 + b1 - i1)")} - {rounded_ratio_sql("i0", "(a0 + b0 - i0)")} AS d FROM base)
SELECT sample, target, feature, (min(d) + max(d)) / 2 AS projected_score FROM dd GROUP BY ALL"""

EXPR = f"expr AS ({expr_sql('events').format(string='VARCHAR')})"
GENE_BINS = f"""{EXPR}, ncell AS (SELECT count(*) AS n FROM events), genes AS (SELECT concat('G', lpad(CAST(range AS VARCHAR), 2, '0')) AS gene, CAST(range AS INTEGER) AS var_idx FROM range({GENES})),
gm AS (SELECT g.gene, var_idx, coalesce(sum(value), 0) / any_value(n) AS mean FROM genes g CROSS JOIN ncell LEFT JOIN expr USING (gene) GROUP BY ALL),
gb AS (SELECT *, CAST(least(floor((row_number() OVER (ORDER BY mean, var_idx) - 1) * 5 / {GENES}), 4) AS INTEGER) AS bin FROM gm)"""
_SETS = ", ".join(f"('{s}', '{g}')" for s, gs in SETS.items() for g in gs)
MODULE = f"""WITH {GENE_BINS}, sets(set_name, gene) AS (VALUES {_SETS}),
members AS (SELECT set_name, gene AS g_of, bin, row_number() OVER (PARTITION BY set_name, gene) AS nth FROM sets JOIN gb USING (gene)),
pool AS (SELECT me.set_name, g_of, nth, gb.gene FROM members me JOIN gb USING (bin) WHERE NOT EXISTS (SELECT 1 FROM sets s WHERE s.set_name = me.set_name AND s.gene = gb.gene)),
picked AS (SELECT *, row_number() OVER (PARTITION BY set_name, g_of, nth ORDER BY md5(concat_ws('|', '666', set_name, g_of, nth, gene)), gene) AS k FROM pool),
ctrl AS (SELECT DISTINCT set_name, gene, 1 AS c FROM picked WHERE k <= 3),
mods AS (SELECT set_name, gene, count(*) AS mm FROM sets JOIN genes USING (gene) GROUP BY ALL),
chosen AS (SELECT coalesce(a.set_name, b.set_name) AS set_name, coalesce(a.gene, b.gene) AS gene, coalesce(mm, 0) AS mm, coalesce(c, 0) AS c FROM mods a FULL JOIN ctrl b ON a.set_name = b.set_name AND a.gene = b.gene),
total AS (SELECT set_name, sum(mm) AS nm, sum(c) AS nc FROM chosen GROUP BY ALL),
sums AS (SELECT obs_idx, set_name, sum(value * mm) AS sm, sum(value * c) AS sc FROM expr JOIN chosen USING (gene) GROUP BY ALL)
SELECT event_id AS obs_idx, n.set_name, round(coalesce(sm, 0) / nullif(nm, 0) - coalesce(sc, 0) / nullif(nc, 0), 9) AS score
FROM events CROSS JOIN (SELECT DISTINCT set_name FROM sets) n LEFT JOIN total USING (set_name) LEFT JOIN sums s ON s.obs_idx = event_id AND s.set_name = n.set_name"""

GENE_GRID = f"""{BASE}, {EXPR},
gv AS (SELECT p.sample, gx, gy, coalesce(a.value, 0) AS a, coalesce(b.value, 0) AS b FROM placed p LEFT JOIN (SELECT * FROM expr WHERE gene = 'G00') a USING (obs_idx) LEFT JOIN (SELECT * FROM expr WHERE gene = 'G05') b USING (obs_idx)),
gg AS (SELECT sample, gx, gy, avg(a) AS a, avg(b) AS b FROM gv GROUP BY ALL), lg AS (SELECT sample, gx, gy, 'G00' AS feature, a AS value FROM gg UNION ALL SELECT sample, gx, gy, 'G05', b FROM gg),
{LOCAL}"""


def overlay(space: str) -> str:
    head = f"{MASKS}" if space == "grid" else f"{CELLS}, {LONG_CELL}, cut AS (SELECT sample, feature, avg(value) AS cutoff FROM lc GROUP BY ALL), m AS (SELECT lc.*, coalesce(value > cutoff, false) AS active FROM lc JOIN cut USING (sample, feature))"
    ids = "sample, gx, gy" if space == "grid" else "sample, obs_idx"
    return f"""WITH {head}, u AS (SELECT {ids}, bool_or(active) FILTER (feature = '{T}') AS a, bool_or(active) FILTER (feature = '{F1}') AS b FROM m GROUP BY ALL),
c AS (SELECT sample, count(*) AS n_units, count(*) FILTER (a) AS n_a, count(*) FILTER (b) AS n_b, count(*) FILTER (a AND b) AS n_overlap FROM u GROUP BY sample)
SELECT *, round(n_a / n_units, 9) AS fraction_a, round(n_b / n_units, 9) AS fraction_b, round(n_overlap / n_units, 9) AS fraction_overlap FROM c"""


def proportions(level: str) -> str:
    return f"""WITH {units(level)}, cuts(feature, cutoff) AS (VALUES ('{T}', 1.5::DOUBLE), ('{F1}', 2.5::DOUBLE))
SELECT sample, feature, '{level}' AS level, cutoff, count(*) AS n_units, count(*) FILTER (value > cutoff) AS n_positive, round(count(*) FILTER (value > cutoff) / count(*), 9) AS positive_fraction
FROM units JOIN cuts USING (feature) GROUP BY ALL"""


def cordstat(steps) -> str:
    return f"WITH {MASKS}, {stat(operator_shift_rows(*steps), [F1])} SELECT sample, direction, {', '.join(STAT_COLUMNS)} FROM stat"


RASTER = lambda agg: f"WITH {BASE}, {grid(agg)} SELECT sample, gx, gy, n_cells, round({T}, 9) AS {T}, round({F1}, 9) AS {F1} FROM grid"
SCORES = f"{VECTORS}, sp AS (SELECT sample, feature, (coalesce(mn, 0) + coalesce(mx, 0)) / 2 AS projected_score FROM vectors WHERE step = 12)"
LEGS = lambda src, by: f"""legs AS (SELECT {by}feature, sqrt(power(coalesce(mn, 0) - coalesce(lag(coalesce(mn, 0)) OVER w, 0), 2) + power(coalesce(mx, 0) - coalesce(lag(coalesce(mx, 0)) OVER w, 0), 2)) AS leg
  FROM {src} WINDOW w AS (PARTITION BY {by}feature ORDER BY step))"""  # noqa: E731
NICHE_T = f"WITH RECURSIVE {niche_ctes()}"

CVEC = "vectors AS (SELECT sample, feature, step, min(diff_pct) AS mn, max(diff_pct) AS mx, any_value(cnt_all) AS n_bins, any_value(ot) AS nt, any_value(nf) AS nf FROM stat GROUP BY ALL)"
OBJ = BASE.replace("event_type AS sample_name", "'obj' AS sample_name")
EXPLICIT = MASKS.replace(LOCAL, f"""cut AS (SELECT sample, feature, CASE WHEN feature = '{F1}' THEN 2.5::DOUBLE ELSE avg(value) END AS cutoff FROM lg GROUP BY sample, feature),
m AS (SELECT lg.*, cutoff, coalesce(value > cutoff, false) AS active FROM lg JOIN cut USING (sample, feature))""")
QUANTILE = f"""{BASE},
{grid('max', 2)},
{LONG_GRID},
cut AS (SELECT sample, feature, quantile_cont(value, 0.5) AS cutoff FROM lg GROUP BY ALL), m AS (SELECT lg.*, cutoff, coalesce(value > cutoff, false) AS active FROM lg JOIN cut USING (sample, feature))"""
POSITIVE = f"fm AS (SELECT sample, gx, gy, value, value > avg(value) OVER (PARTITION BY sample) AS active FROM lg WHERE feature = '{F1}')"
KIND = "CASE WHEN n.niche AND fm.active THEN 'overlap' WHEN n.niche THEN 'niche' WHEN fm.active THEN 'positive' ELSE 'other' END AS category"

ORACLE_SQL = {
    "grid_edges": f"WITH {BASE}, e AS (SELECT sample, min(x) AS x0, max(gx) AS nx FROM placed GROUP BY sample) SELECT sample, CAST(i AS INTEGER) AS i, x0 + i * 20::DOUBLE AS x_edge FROM (SELECT *, unnest(range(0, nx + 2)) AS i FROM e)",
    "stream_raster": f"WITH {CELLS} SELECT sample, CAST(floor(x / 20::DOUBLE + 1e-12) AS BIGINT) AS gx, CAST(floor(y / 20::DOUBLE + 1e-12) AS BIGINT) AS gy, count(*) AS n_cells, round(avg({T}), 9) AS value FROM cells GROUP BY ALL",
    "vectors_grid_all_points": f"WITH {OBJ},\n{grid()},\n{LONG_GRID},\n{LOCAL},\n{stat(shift_rows(STEPS), [F1])}, {CVEC} {vector_rows('vectors')}",
    "vectors_grid_explicit": f"WITH {EXPLICIT},\n{stat(shift_rows(STEPS), [F1, F2])}, {CVEC} {vector_rows('vectors')}",
    "vectors_grid_quantile": f"WITH {QUANTILE},\n{stat(shift_rows(STEPS), [F1, F2])}, {CVEC} {vector_rows('vectors')}",
    "vector_path": f"""{COHORT} SELECT feature, step, round(coalesce(lag(mn) OVER w, 0), 9) AS x0, round(coalesce(lag(mx) OVER w, 0), 9) AS y0, round(mn, 9) AS x1, round(mx, 9) AS y1, step = 12 AS is_final
FROM cohort WINDOW w AS (PARTITION BY feature ORDER BY step)""",
    "magnitude_projected": f"""{COHORT}, {LEGS('cohort', '')}, p AS (SELECT feature, (coalesce(mn, 0) + coalesce(mx, 0)) / 2 AS v FROM cohort WHERE step = 12)
SELECT feature, round(sum(leg), 9) AS vector_len, round(any_value(v), 9) AS projected_score FROM legs JOIN p USING (feature) GROUP BY feature""",
    "paired_scores": f"{SCORES} SELECT sample, round(max(projected_score) FILTER (feature = '{F1}'), 9) AS a, round(max(projected_score) FILTER (feature = '{F2}'), 9) AS b FROM sp GROUP BY sample",
    "projected_heatmap": f"""WITH {PAIRS_GRID}, o(name, i) AS (VALUES ('{T}', 0), ('{F1}', 1), ('{F2}', 2)), h AS (SELECT target, feature, avg(projected_score) AS score FROM ps GROUP BY ALL),
k AS (SELECT target, feature, score, r.i AS row, c.i AS col FROM h JOIN o r ON r.name = target JOIN o c ON c.name = feature WHERE c.i < r.i)
SELECT target, feature, round(score, 9) AS score, row, col, round(min(score) OVER (), 9) AS vmin, 0::DOUBLE AS vmax FROM k""",
    "radius_domain_categories": f"""WITH {RACTIVE}, {STILL}, md AS (SELECT DISTINCT c.obs_idx FROM rc c JOIN (SELECT *, 20::DOUBLE AS dx, -10::DOUBLE AS dy FROM act WHERE feature = '{F1}') a ON a.sample = c.sample AND {NEAR}),
k AS (SELECT sample, obs_idx IN (SELECT obs_idx FROM dom WHERE feature = '{T}') AS t, obs_idx IN (SELECT obs_idx FROM md) AS f FROM rc)
SELECT sample, CASE WHEN t AND f THEN 'overlap' WHEN t THEN 'target' WHEN f THEN 'feature' ELSE 'neither' END AS category, count(*) AS n FROM k GROUP BY ALL""",
    "niche_positive_counts_grid": f"{NICHE_T}, {POSITIVE}, k AS (SELECT n.sample, {KIND} FROM ngrid n JOIN fm USING (sample, gx, gy)) SELECT sample, category, count(*) AS n FROM k GROUP BY ALL",
    "niche_positive_counts_cell": f"{NICHE_T}, {POSITIVE}, k AS (SELECT n.sample, {KIND} FROM placed p JOIN ngrid n USING (sample, gx, gy) JOIN fm USING (sample, gx, gy)) SELECT sample, category, count(*) AS n FROM k GROUP BY ALL",
    "niche_feature_range": f"""{NICHE_T}, v AS (SELECT sample, gx, gy, value FROM lg WHERE feature = '{F1}'), q AS (SELECT sample, quantile_cont(value, 0.01) AS vmin, quantile_cont(value, 0.99) AS vmax FROM v GROUP BY sample)
SELECT v.sample, v.gx, v.gy, round(v.value, 9) AS value, n.niche, round(vmin, 9) AS vmin, round(vmax, 9) AS vmax FROM v JOIN ngrid n USING (sample, gx, gy) JOIN q ON q.sample = v.sample""",
    "spatial_overlap_points": f"""WITH {CELLS}, {LONG_CELL}, c AS (SELECT sample, feature, CASE WHEN feature = '{T}' THEN 1.5::DOUBLE ELSE avg(value) END AS cutoff FROM lc GROUP BY sample, feature)
SELECT obs_idx, sample, feature, CASE WHEN feature = '{F1}' THEN x + 5 ELSE x END AS x, y, round(value, 9) AS value FROM lc JOIN c USING (sample, feature) WHERE feature <> '{F2}' AND value > cutoff""",
    "grid_occupancy": f"WITH {BASE}, {grid()} SELECT sample, gx, gy, n_cells FROM grid",
    "grid_mean": RASTER("avg"),
    "grid_sum": RASTER("sum"),
    "grid_max": RASTER("max"),
    "grid_min_cells": f"WITH {BASE}, {grid(k=3)} SELECT sample, gx, gy, n_cells, round({T}, 9) AS {T} FROM grid",
    "grid_feature_map_quantile": f"""WITH {BASE}, {grid()}, q AS (SELECT sample, quantile_cont({T}, 0.75) AS cutoff FROM grid GROUP BY sample)
SELECT sample, gx, gy, n_cells, round({T}, 9) AS value, round(cutoff, 9) AS cutoff, coalesce({T} > cutoff, false) AS positive FROM grid JOIN q USING (sample)""",
    "spatial_adjust_rot90": adjusted("y", "0 - x"),
    "spatial_adjust_mirror": adjusted("x", "0 - y"),
    "binstat": BINS,
    "cutoff_median_of_medians_cell": f"WITH {units('cell')}, s AS (SELECT feature, sample, median(value) AS v FROM units GROUP BY ALL) SELECT feature, round(median(v), 9) AS cutoff FROM s GROUP BY ALL",
    "cutoff_mean_of_means_grid": f"WITH {units('grid')}, s AS (SELECT feature, sample, avg(value) AS v FROM units GROUP BY ALL) SELECT feature, round(avg(v), 9) AS cutoff FROM s GROUP BY ALL",
    "cutoff_balanced_mean": f"WITH {replicates('grid', 'avg', 100)} SELECT feature, round(avg(cutoff), 9) AS cutoff FROM reps GROUP BY ALL",
    "cutoff_balanced_median": f"WITH {replicates('grid', 'median', 100)} SELECT feature, round(median(cutoff), 9) AS cutoff FROM reps GROUP BY ALL",
    "cutoff_sample_stats": f"WITH {units('cell')} SELECT feature, sample, 'cell' AS level, count(*) AS n_units, round(avg(value), 9) AS sample_mean, round(median(value), 9) AS sample_median FROM units GROUP BY ALL",
    "cutoff_replicates": f"WITH {replicates('cell', 'avg', 100)} SELECT feature, rep AS repeat, round(cutoff, 9) AS cutoff, n_per_sample, n_samples, 'cell' AS level FROM reps",
    "positive_proportions_cell": proportions("cell"),
    "positive_proportions_grid": proportions("grid"),
    "niche_grids_8": niche_grids(8),
    "niche_grids_4": niche_grids(4),
    "niche_grids_distributed": niche_grids(8),
    "niche_cells": f"{NICHE_T} SELECT obs_idx, p.sample, feature, positive AS positive_grid, niche AS in_niche, nid AS niche_id FROM placed p JOIN ngrid USING (sample, gx, gy)",
    "niche_annotation": f"{NICHE_T} SELECT obs_idx, p.sample, positive AS hypoxia_score_positive_grid, niche AS hypoxia_score_niche, nid AS hypoxia_score_niche_id FROM placed p JOIN ngrid USING (sample, gx, gy)",
    "niche_summary": f"""{NICHE_T}, g AS (SELECT sample, feature, any_value(cutoff) AS cutoff, count(*) AS n_occupied_grids, count(*) FILTER (positive) AS n_positive_grids, count(*) FILTER (niche) AS n_niche_grids,
  CAST(coalesce(sum(n_cells) FILTER (positive), 0) AS BIGINT) AS n_cells_in_positive_grid, CAST(coalesce(sum(n_cells) FILTER (niche), 0) AS BIGINT) AS n_niche_cells, CAST(sum(n_cells) AS BIGINT) AS n_cells FROM ngrid GROUP BY ALL),
s AS (SELECT sample, feature, count(*) AS n_positive_components, count(*) FILTER (n_grids >= 3) AS n_niches, coalesce(max(n_grids) FILTER (n_grids >= 3), 0) AS largest_niche_grids FROM sizes GROUP BY ALL)
SELECT g.*, round(n_positive_grids / n_occupied_grids, 9) AS positive_grid_fraction, round(n_niche_grids / n_occupied_grids, 9) AS niche_grid_fraction, coalesce(n_positive_components, 0) AS n_positive_components,
  coalesce(n_niches, 0) AS n_niches, coalesce(largest_niche_grids, 0) AS largest_niche_grids, round(n_cells_in_positive_grid / n_cells, 9) AS positive_grid_cell_fraction, round(n_niche_cells / n_cells, 9) AS niche_cell_fraction,
  round(n_niche_grids * 400::DOUBLE, 9) AS niche_area FROM g LEFT JOIN s USING (sample, feature)""",
    "cordstat_step4": cordstat((4, 4, 4, 4)),
    "cordstat_operator_steps": cordstat((2, 3, 4, 5)),
    "cordstat_summary": f"WITH {MASKS}, {stat(operator_shift_rows(4, 4, 4, 4), [F1])} SELECT sample, {', '.join(f'round(avg({c}), 9) AS {c}' for c in STAT_COLUMNS)} FROM stat GROUP BY sample",
    "vectors_grid_sample": f"""{VECTORS}, known AS ({vector_rows("vectors")}) SELECT * FROM known WHERE sample = 'view'""",
    "vectors_grid_cohort": f"{COHORT} SELECT feature, step, round(mn, 9) AS min_djaccard, round(mx, 9) AS max_djaccard, n_samples FROM cohort",
    "vectors_grid_niche_target": f"""{NICHE_T}, pm AS (SELECT lg.*, avg(value) OVER (PARTITION BY sample, feature) AS cutoff FROM lg WHERE feature <> '{T}'), cut AS (SELECT DISTINCT sample, feature, first_value(cutoff) OVER (PARTITION BY sample, feature) AS cutoff FROM pm),
m AS (SELECT sample, gx, gy, feature, coalesce(value > cutoff, false) AS active FROM pm UNION ALL SELECT sample, gx, gy, '{T}', niche FROM ngrid),
{stat(shift_rows(STEPS), [F1, F2])}, vectors AS (SELECT sample, feature, step, min(diff_pct) AS mn, max(diff_pct) AS mx, any_value(cnt_all) AS n_bins, any_value(ot) AS nt, any_value(nf) AS nf FROM stat GROUP BY ALL)
{vector_rows("vectors", target_niche=True)}""",
    "vectors_grid_genes": f"""WITH {GENE_GRID}, {stat(shift_rows(STEPS), ["G05"], "G00")},
vectors AS (SELECT sample, feature, step, min(diff_pct) AS mn, max(diff_pct) AS mx, any_value(cnt_all) AS n_bins, any_value(ot) AS nt, any_value(nf) AS nf FROM stat GROUP BY ALL)
{vector_rows("vectors").replace(f"ct.feature = '{T}'", "ct.feature = 'G00'")}""",
    "projected_score": f"{COHORT} SELECT feature, round((coalesce(mn, 0) + coalesce(mx, 0)) / 2, 9) AS projected_score FROM cohort WHERE step = 12",
    "vector_magnitude": f"{COHORT}, {LEGS('cohort', '')} SELECT feature, round(sum(leg), 9) AS vector_len FROM legs GROUP BY feature",
    "sample_projected_score": f"{SCORES}, {LEGS('vectors', 'sample, ')} SELECT sample, feature, round(any_value(projected_score), 9) AS projected_score, round(sum(leg), 9) AS vector_len FROM legs JOIN sp USING (sample, feature) GROUP BY sample, feature",
    "pairwise_long": f"WITH {PAIRS_GRID} SELECT * FROM ps",
    "pairwise_matrix": f"WITH {PAIRS_GRID} SELECT target, " + ", ".join(f"round(avg(projected_score) FILTER (feature = '{f}'), 9) AS {f}" for f in (T, F1, F2)) + " FROM ps GROUP BY target",
    "radius_domain": f"""WITH {RACTIVE}, {STILL}, md AS (SELECT DISTINCT c.obs_idx FROM rc c JOIN (SELECT *, 20::DOUBLE AS dx, -10::DOUBLE AS dy FROM act WHERE feature = '{F1}') a ON a.sample = c.sample AND {NEAR})
SELECT obs_idx, sample, obs_idx IN (SELECT obs_idx FROM act WHERE feature = '{T}') AS target_positive, obs_idx IN (SELECT obs_idx FROM act WHERE feature = '{F1}') AS feature_positive,
  obs_idx IN (SELECT obs_idx FROM dom WHERE feature = '{T}') AS target_domain, obs_idx IN (SELECT obs_idx FROM md) AS feature_domain FROM rc""",
    "radius_coverage": f"WITH {radius_ctes(STEPS_RADIUS, [F1])} SELECT sample, feature, step, direction, n_active, n_covered, round(coverage, 9) AS coverage FROM cover",
    "vectors_radius_sphere": radius_vectors(),
    "vectors_radius_euclidean": radius_vectors(True),
    "radius_min_coverage": radius_vectors(least=0.9),
    "pairwise_radius": PAIRS_RADIUS,
    "module_gene_bins": f"WITH {GENE_BINS} SELECT gene, var_idx, round(mean, 9) AS mean, bin FROM gb",
    "module_scores": MODULE,
    "overlay_counts_cell": overlay("cell"),
    "overlay_counts_grid": overlay("grid"),
    "niche_overlay_counts": f"""WITH RECURSIVE {niche_ctes((T, F1))}, o AS (SELECT sample, CASE WHEN a.niche AND b.niche THEN 'overlap' WHEN a.niche THEN 'niche1' WHEN b.niche THEN 'niche2' ELSE 'other' END AS category
  FROM (SELECT * FROM ngrid WHERE feature = '{T}') a JOIN (SELECT * FROM ngrid WHERE feature = '{F1}') b USING (sample, gx, gy)) SELECT sample, category, count(*) AS n FROM o GROUP BY ALL""",
    "niche_boundary_segments": f"""{NICHE_T}, k AS (SELECT sample, gx, gy FROM ngrid WHERE niche), sides(dx, dy, ax, ay, cx, cy) AS (VALUES (-1, 0, 0, 0, 0, 1), (1, 0, 1, 0, 1, 1), (0, -1, 0, 0, 1, 0), (0, 1, 0, 1, 1, 1))
SELECT sample, (gx + ax) * 20::DOUBLE AS xa, (gy + ay) * 20::DOUBLE AS ya, (gx + cx) * 20::DOUBLE AS xb, (gy + cy) * 20::DOUBLE AS yb FROM k CROSS JOIN sides s
WHERE NOT EXISTS (SELECT 1 FROM k n WHERE n.sample = k.sample AND n.gx = k.gx + s.dx AND n.gy = k.gy + s.dy)""",
    "coloc_summary": f"{SCORES} SELECT count(*) AS n, count(*) FILTER (projected_score < -0.05) AS n_below, round(100 * count(*) FILTER (projected_score < -0.05) / count(*), 9) AS percent_below FROM sp",
    "kde_curve": f"""{SCORES}, v AS (SELECT round(projected_score, 6) AS v FROM sp), a AS (SELECT count(*) AS n, min(v) - greatest((max(v) - min(v)) * 0.12, 1e-6) AS lo, max(v) + greatest((max(v) - min(v)) * 0.12, 1e-6) AS hi, power(count(*), -0.2) * stddev_samp(v) AS h FROM v),
l AS (SELECT n, h, lo + range * ((hi - lo) / 399) AS x FROM a, range(400)) SELECT round(x, 5) AS x, round(sum(exp(-0.5 * ((x - v) / h) * ((x - v) / h))) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 5) AS density FROM l, v GROUP BY l.x""",
}

RANK = "rank() OVER (PARTITION BY sample ORDER BY pct) + (count(*) OVER (PARTITION BY sample, pct) - 1) / 2.0"
FIXED_MASK = BINS.replace("CAST(coalesce(pct > 0.4, false) AS INTEGER) AS mask", "CAST((row * 8 + col) % 3 = 0 AS INTEGER) AS mask")
PAIRED = f"{SCORES}, pr AS (SELECT sample, max(projected_score) FILTER (feature = '{F1}') - max(projected_score) FILTER (feature = '{F2}') AS d FROM sp GROUP BY sample)"
MEAN_CUT = f"(SELECT avg(v) FROM (SELECT sample, avg(value) AS v FROM lg WHERE feature = '{T}' GROUP BY sample))"
COHORT_NICHE = f"WITH RECURSIVE {niche_ctes()}".replace(f"CASE feature WHEN '{T}' THEN 1.5::DOUBLE WHEN '{F1}' THEN 2.5::DOUBLE END", MEAN_CUT)
MEANS = "gm AS (SELECT feature, avg(v) AS cutoff FROM (SELECT sample, feature, avg(value) AS v FROM lg GROUP BY ALL) GROUP BY feature)"
GLOBAL_MASKS = f"""{BASE},
{grid()},
{LONG_GRID},
{MEANS}, m AS (SELECT lg.*, cutoff, coalesce(value > cutoff, false) AS active FROM lg JOIN gm USING (feature))"""
NICHE_F1 = f"WITH RECURSIVE {niche_ctes((F1,))}"
ADJUSTED = MASKS.replace("x_centroid AS x, y_centroid AS y,", "y_centroid AS x, 0 - x_centroid AS y,")
COUNTED = """c AS (SELECT sample, count(*) AS n_units, count(*) FILTER (a) AS n_a, count(*) FILTER (b) AS n_b, count(*) FILTER (a AND b) AS n_overlap FROM u GROUP BY sample)
SELECT *, round(n_a / n_units, 9) AS fraction_a, round(n_b / n_units, 9) AS fraction_b, round(n_overlap / n_units, 9) AS fraction_overlap FROM c"""


def overlay_rule(rule: str) -> str:
    return f"""WITH {CELLS}, {LONG_CELL}, cut AS (SELECT sample, feature, {rule} AS cutoff FROM lc GROUP BY ALL), m AS (SELECT lc.*, coalesce(value > cutoff, false) AS active FROM lc JOIN cut USING (sample, feature)),
u AS (SELECT sample, obs_idx, bool_or(active) FILTER (feature = '{T}') AS a, bool_or(active) FILTER (feature = '{F1}') AS b FROM m GROUP BY ALL), {COUNTED}"""


ORACLE_SQL |= {
    "proportion_z": f"{SCORES}, c AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (projected_score < -0.05)::DOUBLE AS k FROM sp) SELECT round(k / n, 9) AS proportion, round((k / n - 0.5 + 0.5 / n) / sqrt(0.25 / n), 9) AS z FROM c",
    "binstat_mann_whitney_u": f"""WITH b AS ({BINS.replace("round(pct, 9) AS pct", "pct")}), r AS (SELECT *, {RANK} AS r FROM b WHERE pct IS NOT NULL)
SELECT sample, round(avg(pct) FILTER (mask = 1), 9) AS group_1, round(avg(pct) FILTER (mask = 0), 9) AS group_0, count(*) FILTER (mask = 1) AS n1, count(*) FILTER (mask = 0) AS n0,
  CAST(sum(r) FILTER (mask = 1) AS DOUBLE) - count(*) FILTER (mask = 1) * (count(*) FILTER (mask = 1) + 1) / 2.0 AS statistic FROM r GROUP BY sample HAVING count(*) FILTER (mask = 1) > 1 AND count(*) FILTER (mask = 0) > 1""",
    "paired_wilcoxon_w": f"""{PAIRED}, q AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r FROM pr WHERE d <> 0)
SELECT '{F1}:{F2}' AS pair, (SELECT count(*) FROM pr WHERE d IS NOT NULL) AS n_pairs, CAST(least(coalesce(sum(r) FILTER (d > 0), 0), coalesce(sum(r) FILTER (d < 0), 0)) AS DOUBLE) AS statistic FROM q""",
    "gene_layer_grid": f"""WITH {BASE}, {EXPR}, v AS (SELECT p.sample, gx, gy, 2 * coalesce(a.value, 0) AS a, 2 * coalesce(b.value, 0) AS b FROM placed p LEFT JOIN (SELECT * FROM expr WHERE gene = 'G00') a USING (obs_idx) LEFT JOIN (SELECT * FROM expr WHERE gene = 'G05') b USING (obs_idx))
SELECT sample, gx, gy, count(*) AS n_cells, round(avg(a), 9) AS "G00", round(avg(b), 9) AS "G05" FROM v GROUP BY ALL""",
    "grid_odd_feature_names": f"WITH {BASE}, {grid()}, {LONG_GRID} SELECT sample, gx, gy, n_cells, CASE feature WHEN '{T}' THEN 'gx' WHEN '{F1}' THEN 'x' ELSE 'n_cells' END AS feature, round(value, 9) AS value FROM lg",
    "points_parquet": f"WITH {CELLS} SELECT obs_idx, sample, x, y, round({T}, 9) AS {T}, round({F1}, 9) AS {F1}, round({F2}, 9) AS {F2} FROM cells",
    "module_scores_added": f"SELECT obs_idx, " + ", ".join(f"max(score) FILTER (set_name = '{n}') AS {n}" for n in SETS) + f" FROM ({MODULE}) GROUP BY obs_idx",
    "binstat_feature_cutoff": BINS,
    "binstat_given_mask": FIXED_MASK,
    "grid_feature_map_cohort": f"WITH {GLOBAL_MASKS} SELECT sample, gx, gy, n_cells, round(value, 9) AS value, round(cutoff, 9) AS cutoff, active AS positive FROM m WHERE feature = '{T}'",
    "niche_cohort_cutoff": f"""{COHORT_NICHE} SELECT sample, feature, round(any_value(cutoff), 9) AS cutoff, count(*) FILTER (positive) AS n_positive_grids, count(*) FILTER (niche) AS n_niche_grids,
  count(DISTINCT nid) FILTER (niche) AS n_niches, CAST(coalesce(sum(n_cells) FILTER (niche), 0) AS BIGINT) AS n_niche_cells FROM ngrid GROUP BY ALL""",
    "vectors_grid_niche_of_another": f"""{NICHE_F1}, pm AS (SELECT lg.*, avg(value) OVER (PARTITION BY sample, feature) AS cutoff FROM lg WHERE feature <> '{T}'), cut AS (SELECT DISTINCT sample, feature, first_value(cutoff) OVER (PARTITION BY sample, feature) AS cutoff FROM pm),
m AS (SELECT sample, gx, gy, feature, coalesce(value > cutoff, false) AS active FROM pm UNION ALL SELECT sample, gx, gy, '{T}', niche FROM ngrid),
{stat(shift_rows(STEPS), [F1, F2])}, {CVEC} {vector_rows("vectors", target_niche=True)}""",
    "niche_one_sample": f"{NICHE_T} SELECT sample, feature, count(*) AS n_components, count(*) FILTER (n_grids >= 3) AS n_niches FROM sizes WHERE sample = 'view' GROUP BY ALL",
    "api_vectors_cohort": f"""{COHORT}, {LEGS('cohort', '')}, p AS (SELECT feature, (coalesce(mn, 0) + coalesce(mx, 0)) / 2 AS v FROM cohort WHERE step = 12)
SELECT feature, round(any_value(v), 9) AS projected_score, round(sum(leg), 9) AS vector_len FROM legs JOIN p USING (feature) GROUP BY feature""",
    "api_vectors_cohort_cutoff": f"""WITH {GLOBAL_MASKS}, {stat(shift_rows(STEPS), [F1, F2])}, {CVEC}, cohort AS (SELECT feature, step, avg(mn) AS mn, avg(mx) AS mx FROM vectors GROUP BY ALL),
{LEGS('cohort', '')}, p AS (SELECT feature, (coalesce(mn, 0) + coalesce(mx, 0)) / 2 AS v FROM cohort WHERE step = 12)
SELECT feature, round(any_value(v), 9) AS projected_score, round(sum(leg), 9) AS vector_len FROM legs JOIN p USING (feature) GROUP BY feature""",
    "api_vectors_kdtree": f"WITH r AS ({radius_vectors()}) SELECT sample, feature, round((coalesce(min_djaccard, 0) + coalesce(max_djaccard, 0)) / 2, 9) AS projected_score FROM r WHERE step = 150",
    "api_vectors_kdtree_all_points": radius_vectors().replace("event_type AS sample_name", "'obj' AS sample_name"),
    "api_pairwise_kdtree": f"SELECT target, " + ", ".join(f"round(avg(projected_score) FILTER (feature = '{f}'), 9) AS {f}" for f in (T, F1, F2)) + f" FROM ({PAIRS_RADIUS}) GROUP BY target",
    "vectors_radius_niche_target": radius_vectors().replace("WITH ", f"WITH RECURSIVE {niche_ctes()}, ", 1).replace(f"{CELLS}, rc AS", "rc AS", 1)
    .replace("act AS (SELECT rl.sample, obs_idx, x, y, rl.feature FROM rl JOIN cut USING (sample, feature) WHERE value > cutoff)", f"act AS (SELECT rl.sample, obs_idx, x, y, rl.feature FROM rl JOIN cut USING (sample, feature) WHERE value > cutoff AND rl.feature <> '{T}' UNION ALL SELECT p.sample, obs_idx, x, y, '{T}' FROM placed p JOIN ngrid USING (sample, gx, gy) WHERE niche)")
    .replace("round(ct.cutoff, 9) AS cutoff_target", "CAST(NULL AS DOUBLE) AS cutoff_target").replace("'positive' AS binary_source_target", "'niche' AS binary_source_target"),
    "cordstat_adjusted": f"WITH {ADJUSTED}, {stat(operator_shift_rows(4, 4, 4, 4), [F1])} SELECT sample, direction, {', '.join(STAT_COLUMNS)} FROM stat",
    "cordstat_beyond_the_grid": cordstat((40, 35, 50, 3)),
    "overlay_counts_cohort": f"""WITH {GLOBAL_MASKS.replace("m AS (SELECT lg.*, cutoff, coalesce(value > cutoff, false)", "m AS (SELECT lg.*, coalesce(value > CASE WHEN feature = '" + F1 + "' THEN 2.5 ELSE cutoff END, false)")},
u AS (SELECT sample, gx, gy, bool_or(active) FILTER (feature = '{T}') AS a, bool_or(active) FILTER (feature = '{F1}') AS b FROM m GROUP BY ALL), {COUNTED}""",
    "overlay_counts_median": overlay_rule("median(value)"),
    "overlay_counts_quantile": overlay_rule("quantile_cont(value, 0.9)"),
    "overlay_counts_zero": overlay_rule("0::DOUBLE"),
    "niche_feature_range_cell": f"""{NICHE_T}, q AS (SELECT sample, quantile_cont({F1}, 0.1) AS vmin FROM cells GROUP BY sample)
SELECT p.sample, obs_idx, round({F1}, 9) AS value, niche, round(vmin, 9) AS vmin, CASE WHEN 4 > vmin THEN 4::DOUBLE ELSE round(vmin + 1e-12, 9) END AS vmax FROM placed p JOIN ngrid USING (sample, gx, gy) JOIN q ON q.sample = p.sample""",
    "niche_overlay_counts_cell": f"""WITH RECURSIVE {niche_ctes((T, F1))}, o AS (SELECT p.sample, CASE WHEN a.niche AND b.niche THEN 'overlap' WHEN a.niche THEN 'niche1' WHEN b.niche THEN 'niche2' ELSE 'other' END AS category
  FROM placed p JOIN (SELECT * FROM ngrid WHERE feature = '{T}') a USING (sample, gx, gy) JOIN (SELECT * FROM ngrid WHERE feature = '{F1}') b USING (sample, gx, gy)) SELECT sample, category, count(*) AS n FROM o GROUP BY ALL""",
    "cutoff_chosen_samples": f"WITH {units('grid')}, s AS (SELECT feature, sample, avg(value) AS v FROM units WHERE sample IN ('click', 'view') GROUP BY ALL) SELECT feature, round(avg(v), 9) AS cutoff FROM s GROUP BY ALL",
}
