"""The detector as SQL: moments, rotations, draws, trees, scores and flags, step by step as the library does them."""

from __future__ import annotations

from dockflow.catalog.inputs import RULES, idle_sql, sql
from dockflow.models.components import EPS, KEPT_VARIANCE, PAIRS, SWEEPS, triangle
from dockflow.models.isolation import SAMPLE, TREES
from dockflow.schemas import SEED

_D = 7
_KEYS = "run, q, wd, h"


def _usual(n: str) -> str:
    many = f"CAST(greatest({n}, 3) AS DOUBLE)"
    return f"CASE WHEN {n} > 2 THEN round(2 * (ln({many} - 1) + 0.5772156649015329) - 2 * ({many} - 1) / {many}, 9) WHEN {n} = 2 THEN 1e0 ELSE 0e0 END"


def _combination(source: str) -> str:
    return f"""SELECT station_id, CAST(consecutive_no_transactions_out AS BIGINT) AS run, CAST(quarter(date) AS INTEGER) AS q,
        CAST(isodow(date) AS INTEGER) AS wd, CAST(hour(date) AS INTEGER) AS h FROM {source}"""


def _features() -> str:
    waves = ", ".join(f"{fn}(2 * pi() / {top} * {c})" for c, top in (("q", 4), ("wd", 7), ("h", 24)) for fn in ("sin", "cos"))
    return f"[CAST(run AS DOUBLE), {waves}]"


def _turned(of: str, place: str, step: str) -> str:
    """Columns (or rows) p and q of a matrix turned by c and s."""
    return f"""list_transform({of}, lambda e, i: CASE WHEN {place} = p THEN c * e - s * {of}[i + {step}]
        WHEN {place} = q THEN s * {of}[i - {step}] + c * e ELSE e END)"""


def components_parts() -> dict[str, str]:
    """``moments``, ``solved`` (rotated matrix and axes) and ``axes`` (kept ones and what they explain) of the training rows."""
    mean = ", ".join(f"round(sum(rows * x[{i + 1}]) / sum(rows), 9)" for i in range(_D))
    cov = ", ".join(
        f"round(sum(rows * (x[{i + 1}] - mean[{i + 1}]) * (x[{j + 1}] - mean[{j + 1}])) / sum(rows), 9)" for i in range(_D) for j in range(i, _D)
    )

    def entry(i, j):
        return f"cov[{triangle(i, j) + 1}]"

    slack = [f"(total * mean[{i + 1}] * {EPS!r})" for i in range(_D)]
    scale = ", ".join(
        f"CASE WHEN {entry(i, i)} <= total * {EPS!r} * {entry(i, i)} + {slack[i]} * {slack[i]} THEN 1e0 ELSE sqrt({entry(i, i)}) END" for i in range(_D)
    )
    matrix = ", ".join(f"{entry(i, j)} / (scale[{i + 1}] * scale[{j + 1}])" for i in range(_D) for j in range(_D))
    axes = ", ".join("1e0" if i == j else "0e0" for i in range(_D) for j in range(_D))
    ps, qs = ([pair[k] for pair in PAIRS] for k in (0, 1))
    order = "PARTITION BY station_id ORDER BY value DESC, axis"
    return {
        "counted": f"SELECT *, {_features()} AS x FROM (SELECT *, count(*) AS rows FROM ({_combination('train')}) GROUP BY ALL)",
        "means": f"SELECT station_id, CAST(sum(rows) AS BIGINT) AS total, [{mean}] AS mean FROM counted GROUP BY station_id",
        "spreads": f"SELECT station_id, total, mean, [{cov}] AS cov FROM counted JOIN means USING (station_id) GROUP BY station_id, total, mean",
        "moments": f"SELECT *, [{scale}] AS scale FROM spreads",
        "rotated": f"""SELECT station_id, 0 AS step, [{matrix}] AS a, [{axes}] AS v FROM moments UNION ALL
            SELECT station_id, step + 1, {_turned('b', f'(i - 1) // {_D}', f'(q - p) * {_D}')}, {_turned('v', f'(i - 1) % {_D}', '(q - p)')} FROM
            (SELECT *, {_turned('a', f'(i - 1) % {_D}', '(q - p)')} AS b FROM
            (SELECT *, CASE WHEN off = 0 THEN 1e0 ELSE 1 / sqrt(t * t + 1) END AS c, CASE WHEN off = 0 THEN 0e0 ELSE t * (1 / sqrt(t * t + 1)) END AS s FROM
            (SELECT *, CASE WHEN th >= 0 THEN 1e0 ELSE -1e0 END / (abs(th) + sqrt(th * th + 1)) AS t FROM
            (SELECT *, a[p * {_D} + q + 1] AS off, (a[q * {_D} + q + 1] - a[p * {_D} + p + 1]) / (2 * a[p * {_D} + q + 1]) AS th FROM
            (SELECT *, {ps}[step % {len(PAIRS)} + 1] AS p, {qs}[step % {len(PAIRS)} + 1] AS q FROM rotated WHERE step < {len(PAIRS) * SWEEPS})))))""",
        "solved": f"SELECT * FROM rotated WHERE step = {len(PAIRS) * SWEEPS}",
        "valued": f"SELECT station_id, axis, greatest(a[axis * {_D + 1} + 1], 0) AS value FROM solved, range({_D}) AS r(axis)",
        "shared": "SELECT *, value / sum(value) OVER (PARTITION BY station_id) AS share FROM valued",
        "running": f"SELECT *, row_number() OVER ({order}) - 1 AS k, sum(share) OVER ({order} ROWS UNBOUNDED PRECEDING) AS upto FROM shared",
        "axes": f"SELECT *, least(count(*) FILTER (upto <= {KEPT_VARIANCE}) OVER (PARTITION BY station_id) + 1, {_D}) AS kept FROM running",
    }


def components_sql(select: str, train: str) -> str:
    return sql(select, "idle", train=train, **components_parts()).replace("WITH ", "WITH RECURSIVE ", 1).replace("rotated AS MATERIALIZED", "rotated AS")


def detector_sql(select: str, train: str, percentile: str, idle: str = "idle", **extra: str) -> str:
    """``select`` over ``flags``: the rows of ``idle`` with ``decision`` and ``anomaly``."""
    along = " + ".join(f"(x[{i + 1}] - mean[{i + 1}]) / scale[{i + 1}] * v[{i * _D} + axis + 1]" for i in range(_D))
    digits = " || ".join(f"md5('{SEED}:' || station_id || ':' || run || ':' || q || ':' || wd || ':' || h || ':' || copy || ':{g}')" for g in range(-(-TREES // 4)))
    limits = " ".join(f"WHEN '{label}' THEN {limit}" for label, limit in RULES.items())
    levels = SAMPLE.bit_length() - 1
    parts = components_parts() | extra | {
        "asked": f"SELECT DISTINCT station_id, {_KEYS} FROM (SELECT station_id, {_KEYS} FROM counted UNION ALL {_combination(idle)}) WHERE station_id IN (SELECT station_id FROM moments)",
        "points": f"""SELECT station_id, {_KEYS}, list(c ORDER BY k) AS p FROM (SELECT station_id, {_KEYS}, k, round(0e0 + {along}, 9) AS c
            FROM (SELECT *, {_features()} AS x FROM asked) JOIN axes USING (station_id) JOIN moments USING (station_id) JOIN solved USING (station_id) WHERE k < kept) GROUP BY ALL""",
        "copies": f"SELECT station_id, {_KEYS}, unnest(range(1, rows + 1)) AS copy FROM counted",
        "hashed": f"SELECT *, unnest(range({TREES})) AS tree FROM (SELECT *, {digits} AS digits FROM copies)",
        "taken": f"SELECT * FROM hashed QUALIFY row_number() OVER (PARTITION BY station_id, tree ORDER BY substr(digits, 8 * tree + 1, 8), {_KEYS}, copy) <= {SAMPLE}",
        "g0": f"""SELECT station_id, tree, p, members, CAST(ceil(log2(greatest(least(total, {SAMPLE}), 2))) AS INTEGER) AS depth, 0 AS node FROM
            (SELECT station_id, tree, {_KEYS}, count(*) AS members FROM taken GROUP BY ALL) JOIN points USING (station_id, {_KEYS}) JOIN moments USING (station_id)""",
    }
    name = f"'{SEED}:' || station_id || ':' || tree || ':' || node"
    for level in range(levels + 1):
        parts |= {
            f"s{level}": f"""SELECT station_id, tree, node, CAST(sum(members) AS BIGINT) AS n, any_value(depth) AS depth, [{', '.join(f'min(p[{d + 1}])' for d in range(_D))}] AS lows,
                [{', '.join(f'max(p[{d + 1}])' for d in range(_D))}] AS highs FROM g{level} GROUP BY station_id, tree, node""",
            f"c{level}": f"""SELECT * FROM (SELECT station_id, tree, node, d, lows[d + 1] AS low, highs[d + 1] AS high FROM s{level}, range({_D}) AS r(d))
                WHERE high > low QUALIFY row_number() OVER (PARTITION BY station_id, tree, node ORDER BY substr(md5({name}), CAST(4 * d + 1 AS INTEGER), 4) DESC, d) = 1""",
            f"x{level}": f"""SELECT station_id, tree, node, CASE WHEN split THEN d ELSE -1 END AS feature, CASE WHEN raw >= high THEN low ELSE raw END AS cut,
                CASE WHEN split THEN 0 ELSE {level} + {_usual('n')} END AS path FROM (SELECT s.*, d, low, high, d IS NOT NULL AND {level} < depth AS split,
                low + CAST('0x' || substr(md5('{SEED}:' || s.station_id || ':' || s.tree || ':' || s.node || ':cut'), 1, 8) AS BIGINT) / 4294967296e0 * (high - low) AS raw
                FROM s{level} s LEFT JOIN c{level} c ON c.station_id = s.station_id AND c.tree = s.tree AND c.node = s.node)""",
            f"g{level + 1}": f"""SELECT g.* REPLACE (2 * g.node + 1 + CASE WHEN p[feature + 1] > cut THEN 1 ELSE 0 END AS node) FROM g{level} g
                JOIN x{level} x ON x.station_id = g.station_id AND x.tree = g.tree AND x.node = g.node WHERE feature >= 0""",
        }
    parts["nodes"] = " UNION ALL ".join(f"SELECT * FROM x{level}" for level in range(levels + 1))
    parts["w0"] = f"SELECT station_id, {_KEYS}, p, tree, 0 AS node FROM points, range({TREES}) AS r(tree)"
    for level in range(levels):
        parts[f"w{level + 1}"] = f"""SELECT w.* REPLACE (CASE WHEN feature >= 0 THEN 2 * w.node + 1 + CASE WHEN p[feature + 1] > cut THEN 1 ELSE 0 END ELSE w.node END AS node)
            FROM w{level} w JOIN nodes x ON x.station_id = w.station_id AND x.tree = w.tree AND x.node = w.node"""
    parts |= {
        "paths": f"""SELECT w.station_id, {_KEYS}, CAST(sum(CAST(round(path * 1e9) AS BIGINT)) AS BIGINT) AS paths FROM w{levels} w
            JOIN nodes x ON x.station_id = w.station_id AND x.tree = w.tree AND x.node = w.node GROUP BY ALL""",
        "scores": f"""SELECT station_id, {_KEYS}, CASE WHEN u > 0 THEN -pow(2e0, -(paths / 1e9 / {TREES}e0) / u) ELSE -1e0 END AS score
            FROM (SELECT *, {_usual(f'least(total, {SAMPLE})')} AS u FROM paths JOIN moments USING (station_id))""",
        "wanted": f"""SELECT station_id, 1 - {percentile} / 100 AS c FROM (SELECT t.station_id, consecutive_no_transactions_out AS x,
            CASE p.profile_station_activity {limits} END AS lim FROM train t JOIN station_profile p ON p.station_id = t.station_id) GROUP BY station_id""",
        "ranked": """SELECT *, sum(rows) OVER (PARTITION BY station_id ORDER BY score ROWS UNBOUNDED PRECEDING) AS upto,
            round((sum(rows) OVER (PARTITION BY station_id) - 1) * c, 6) AS place FROM
            (SELECT station_id, score, c, sum(rows) AS rows FROM counted JOIN scores USING (station_id, run, q, wd, h) JOIN wanted USING (station_id)
            WHERE c > 0 AND c <= 0.5 GROUP BY ALL)""",
        "borders": """SELECT station_id, below + (above - below) * part AS threshold FROM (SELECT station_id, min(score) FILTER (upto > floor(place)) AS below,
            min(score) FILTER (upto > ceil(place)) AS above, any_value(place - floor(place)) AS part FROM ranked GROUP BY station_id)""",
        "flags": f"""SELECT i.*, score - threshold AS decision, CASE WHEN score - threshold < 0 THEN -1 WHEN score - threshold IS NOT NULL THEN 1 END AS anomaly
            FROM {idle} i LEFT JOIN scores s ON s.station_id = i.station_id AND s.run = consecutive_no_transactions_out AND s.q = quarter(date)
            AND s.wd = isodow(date) AND s.h = hour(date) LEFT JOIN borders b ON b.station_id = i.station_id""",
    }
    text = sql(select, "idle", "station_profile", train=train, **parts)
    return text.replace("WITH ", "WITH RECURSIVE ", 1).replace("rotated AS MATERIALIZED", "rotated AS")


def regrid(moved: str) -> dict[str, str]:
    """Movements and idle runs derived anew from the levels of the grid, as reports do."""
    again = f"""SELECT station_id, date, available_stands, available_bikes, status, {moved} FROM activity
        WINDOW w AS (PARTITION BY station_id ORDER BY date)"""
    return {"again": again, "again_idle": idle_sql("again")}
