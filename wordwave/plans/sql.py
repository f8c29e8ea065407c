"""DuckDB SQL of the series views and of the operators on them, built from the rules and independent of the Spark plans."""

from __future__ import annotations

import math

from ..operators.words import NORMAL_BREAKS, TIED, Param
from ..sources.series import EVENT_BANDS, LINE_BANDS

_list = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"

EVENTS = f"""SELECT user_id::VARCHAR AS object_id, event_type AS band, (list_position({_list(EVENT_BANDS)}, event_type) - 1)::INT AS band_idx,
  epoch_us(ts) - 1704067200000000 AS tus, value, event_id AS ord FROM events"""
LINES = f"""SELECT l_suppkey::VARCHAR AS object_id, l_returnflag AS band, (list_position({_list(LINE_BANDS)}, l_returnflag) - 1)::INT AS band_idx,
  epoch_us(l_shipdate) - 788918400000000 AS tus, l_quantity AS value, l_orderkey * 10 + l_linenumber AS ord FROM lineitem"""
OWN = "PARTITION BY object_id, band"


def indexed(series: str) -> str:
    return f"""s AS ({series}), p AS (SELECT *, row_number() OVER ({OWN} ORDER BY tus, ord) - 1 AS i, count(*) OVER ({OWN}) AS n,
  min(value) OVER ({OWN}) AS low, max(value) OVER ({OWN}) AS high FROM s)"""


def forward(width: int, tol: int) -> str:
    return f"""SELECT object_id, band, band_idx, n, low, high, i, j FROM (SELECT *, CASE WHEN last = n - 1 THEN n ELSE last END AS j FROM (
  SELECT *, max(i) OVER ({OWN} ORDER BY tus RANGE BETWEEN CURRENT ROW AND {width} FOLLOWING) AS last FROM p)) WHERE i <= n - 2 AND j - i > {tol}"""


def backward(width: int, tol: int) -> str:
    return f"""SELECT object_id, band, band_idx, n, low, high, b AS i, i + 1 AS j, tus AS w_end FROM (SELECT *, CASE WHEN f >= 2 THEN f ELSE 0 END AS b FROM (
  SELECT *, min(i) OVER ({OWN} ORDER BY tus RANGE BETWEEN {width} PRECEDING AND CURRENT ROW) AS f FROM p)) WHERE i >= 2 AND i - b > {tol}"""


def _digit(name: str, bins: int, x: str, length: str, wl: int) -> str:
    if name in ("mean", "min", "max") and bins in NORMAL_BREAKS:
        points = [str(b) for b in NORMAL_BREAKS[bins]]
    else:
        a, b = {
            "mean": ("low", "high"),
            "min": ("low", "high"),
            "max": ("low", "high"),
            "trend": (f"(-{math.pi / 2!r})", f"{math.pi / 2!r}"),
            "std": ("0.0::DOUBLE", "((high - low) / 2)"),
            "var": ("0.0::DOUBLE", "(high - low)"),
            "min_max": ("0.0::DOUBLE", "(high - low)"),
            "count": ("0.0::DOUBLE", f"(2.0::DOUBLE * {length} / {wl})"),
        }[name]
        points = [f"({a} + ({b} - {a}) * {k} / {bins})" for k in range(1, bins)]
    if name in TIED:
        x, points = f"round({x}, 9)", [f"round({p}, 9)" for p in points]
    return "(" + " + ".join(f"({p} <= {x})::INT" for p in points) + ")"


#: Mean of a segment within its window, by the coded spread; over a whole series it is 0.
_MEAN = "CASE WHEN sqrt(abs(any_value(x.sq) * any_value(x.sq) - any_value(x.mu) * any_value(x.mu))) > 0 THEN (avg(value) - any_value(x.mu)) / sqrt(abs(any_value(x.sq) * any_value(x.sq) - any_value(x.mu) * any_value(x.mu))) ELSE 0 END"
VALUES = {
    "mean": "0.0",
    "min": "min(value)",
    "max": "max(value)",
    "count": "count(value)::DOUBLE",
    "trend": f"coalesce(atan(CASE WHEN var_pop(tus / 86400000000.0) > 0 THEN regr_slope(value, tus / 86400000000.0) END), {math.pi / 2!r})",
    "std": "stddev_pop(value)",
    "var": "var_pop(value)",
    "min_max": "max(value) - min(value)",
}


def words(series: str, params: list[Param]) -> str:
    """CTEs up to ``words(object_id, band, band_idx, param_id, dir, pos, word)`` before the numerosity filter (effective segmentation)."""
    ctes, parts = [indexed(series)], []
    for r, (width, wl) in enumerate(dict.fromkeys((p.micros, p.word_length) for p in params)):
        mine = [(k, p) for k, p in enumerate(params) if (p.micros, p.word_length) == (width, wl)]
        names = sorted({q for _, p in mine for q in p.quantities})
        columns = ", ".join(f"{VALUES[q]} AS q_{q}" for q in names)
        if wl == 1:
            ctes.append(f"w{r} AS (SELECT *, 0 AS dir, i AS pos FROM ({forward(width, 2)}) UNION ALL SELECT * EXCLUDE (w_end), 1, 1 - j FROM ({backward(width, 2)}))")
            ctes.append(
                f"""q{r} AS (SELECT w.object_id, w.band, w.band_idx, w.dir, w.pos, any_value(w.n) AS n, any_value(w.low) AS low, any_value(w.high) AS high, {columns}
  FROM w{r} w JOIN p ON p.object_id = w.object_id AND p.band = w.band AND p.i >= w.i AND p.i < w.j GROUP BY 1, 2, 3, 4, 5)"""
            )
            source = f"q{r}"
        else:
            sub = width / wl
            ctes.append(f"w{r} AS ({backward(width, 2 * wl)})")
            bounds = ", ".join(f"count(*) FILTER (p.tus < w.w_end::DOUBLE - {(k + 1)} * {sub!r}) AS g{k}, count(*) FILTER (p.tus <= w.w_end::DOUBLE - {k} * {sub!r}) - 1 AS h{k}" for k in range(wl))
            ctes.append(
                f"""g{r} AS (SELECT w.object_id, w.band, w.band_idx, w.i, w.j, w.w_end, w.j - w.i AS m, min(p.value) AS low, max(p.value) AS high, avg(p.value) AS mu, avg(p.value * p.value) AS sq, list(p.tus ORDER BY p.i) AS ts, {bounds}
  FROM w{r} w JOIN p ON p.object_id = w.object_id AND p.band = w.band AND p.i >= w.i AND p.i < w.j GROUP BY 1, 2, 3, 4, 5, 6)"""
            )
            begin = [f"greatest(g{k}, 1)" for k in range(wl)]
            stop = [f"greatest(1, least(h{k}, {'m - 1' if k == 0 else begin[k - 1]}))" for k in range(wl)]
            valid = " AND ".join(
                f"""coalesce(w_end::DOUBLE - {k} * {sub!r} > ts[{begin[k]} + 1] AND ts[{begin[k]} + 1] >= w_end::DOUBLE - {k + 1} * {sub!r}
  AND w_end::DOUBLE - {k} * {sub!r} >= ts[{stop[k]} + 1] AND ts[{stop[k]} + 1] > w_end::DOUBLE - {k + 1} * {sub!r}, false)"""
                for k in range(wl)
            )
            pieces = " UNION ALL ".join(f"SELECT object_id, band, band_idx, i, j, m, low, high, mu, sq, {k} AS k, i + {begin[k]} AS b, i + {stop[k]} AS e FROM g{r} WHERE {valid}" for k in range(wl))
            ctes.append(
                f"""c{r} AS (SELECT x.object_id, x.band, x.band_idx, x.j, x.k, any_value(x.m) AS m, any_value(x.low) AS low, any_value(x.high) AS high, count(p.i) AS size, {columns.replace("0.0 AS q_mean", f"{_MEAN} AS q_mean")}
  FROM ({pieces}) x LEFT JOIN p ON p.object_id = x.object_id AND p.band = x.band AND p.i >= x.b AND p.i < x.e GROUP BY 1, 2, 3, 4, 5)"""
            )
            source = f"c{r}"
        for k, p in mine:
            digit = lambda q, b: _digit(q, b, f"q_{q}", "n" if wl == 1 else "m", wl)  # noqa: E731, B023
            char, base = "0", p.characters + 1
            for q, b in zip(p.quantities, p.bins, strict=True):
                char = f"({char} * {b} + {digit(q, b)})"
            if wl == 1:
                parts.append(f"SELECT object_id, band, band_idx, {k} AS param_id, dir, pos, {char}::BIGINT AS word FROM {source}")
            else:
                inner = f"SELECT object_id, band, band_idx, 1 - j AS pos, k, CASE WHEN size >= {max(1, p.tol // wl)} THEN {char} ELSE {p.characters} END AS c FROM {source}"
                parts.append(
                    f"""SELECT object_id, band, band_idx, {k} AS param_id, 1 AS dir, pos, sum(c * {base}::BIGINT ** k)::BIGINT AS word FROM ({inner})
  GROUP BY object_id, band, band_idx, pos HAVING count(*) = {wl} AND min(c) < {p.characters}"""
                )
    ctes.append("words AS (" + " UNION ALL ".join(parts) + ")")
    ctes.append(
        """kept AS (SELECT object_id, band, band_idx, param_id, dir, pos, word FROM (SELECT *, lag(word) OVER (PARTITION BY object_id, band, param_id ORDER BY dir, pos) AS before FROM words)
  WHERE word IS DISTINCT FROM before)"""
    )
    ctes.append("bag AS (SELECT object_id, band, band_idx, param_id, word, count(*) AS tf FROM kept GROUP BY 1, 2, 3, 4, 5)")
    return "WITH " + ", ".join(ctes)


def uniform(*parts: str, seed: int = 1) -> str:
    key = " || '|' || ".join([f"'{seed}'", *(f"{p}::VARCHAR" for p in parts)])
    return f"(('0x' || substr(md5({key}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def warped(pairs: str, dims: int) -> str:
    """CTEs up to ``warped(a, b, band, distance)`` of rows (a, b, band, p, q), lists of points of ``dims`` numbers: one row of the matrix a step, no root."""
    cost = f"list_sum(list_transform(range(1, {dims + 1}), lambda n: (p[i + 1][n] - y[n]) * (p[i + 1][n] - y[n])))"
    return f"""step AS (SELECT a, b, band, p, q, 0 AS i, list_concat([0.0::DOUBLE], list_transform(q, lambda y: 'infinity'::DOUBLE)) AS line FROM ({pairs})
  UNION ALL SELECT a, b, band, p, q, i + 1, list_reduce(list_transform(q, lambda y: [{cost}]), lambda acc, c, k: list_append(acc, c[1] + least(acc[len(acc)], line[k], line[k + 1])), ['infinity'::DOUBLE]) FROM step WHERE i < len(p)),
warped AS (SELECT a, b, band, line[len(line)] AS distance FROM step WHERE i = len(p))"""


def two_way_words(series: str, p: Param) -> str:
    """As :func:`words` for one parameter of two characters, forward windows cut by the single segmentator too."""
    text, sub, base = words(series, [p]), p.micros / 2, p.characters + 1
    names = ", ".join(f"{VALUES[q]} AS q_{q}" for q in sorted(set(p.quantities)))
    char = "0"
    for q, b in zip(p.quantities, p.bins, strict=True):
        char = f"({char} * {b} + {_digit(q, b, f'q_{q}', 'm', 2)})"
    pieces = " UNION ALL ".join(f"SELECT object_id, band, band_idx, i, m, low, high, {k} AS k, i + b{k} AS b, i + e{k} AS e FROM fs WHERE NOT (b{k} = m OR coalesce(ts[b{k} + 1] >= z + {k + 1} * {sub!r}, true) OR coalesce(ts[e{k}] < z + {k} * {sub!r}, true))" for k in (0, 1))
    forward_ = f"""fw AS (SELECT object_id, band, band_idx, i, j FROM ({forward(p.micros, 4)})),
fg AS (SELECT f.object_id, f.band, f.band_idx, f.i, f.j - f.i AS m, min(p.value) AS low, max(p.value) AS high, list(p.tus ORDER BY p.i) AS ts FROM fw f JOIN p ON p.object_id = f.object_id AND p.band = f.band AND p.i >= f.i AND p.i < f.j GROUP BY 1, 2, 3, 4, 5),
fh AS (SELECT *, ts[1]::DOUBLE AS z, len(list_filter(ts, lambda t: t < ts[1]::DOUBLE)) AS g0, len(list_filter(ts, lambda t: t <= ts[1]::DOUBLE + {sub!r})) AS e0, len(list_filter(ts, lambda t: t < ts[1]::DOUBLE + {sub!r})) AS g1, len(list_filter(ts, lambda t: t <= ts[1]::DOUBLE + 2 * {sub!r})) AS h1 FROM fg),
fs AS (SELECT *, greatest(0, least(g0, m - 1)) AS b0, CASE WHEN e0 = m THEN e0 ELSE greatest(e0, least(g1, m - 1)) END AS b1, greatest(e0, h1) AS e1 FROM fh),
fc AS (SELECT x.object_id, x.band, x.band_idx, x.i, x.k, any_value(x.m) AS m, any_value(x.low) AS low, any_value(x.high) AS high, count(p.i) AS size, {names}
  FROM ({pieces}) x LEFT JOIN p ON p.object_id = x.object_id AND p.band = x.band AND p.i >= x.b AND p.i < x.e GROUP BY 1, 2, 3, 4, 5),
fx AS (SELECT object_id, band, band_idx, 0 AS param_id, 0 AS dir, i AS pos, sum(c * {base}::BIGINT ** k)::BIGINT AS word FROM (SELECT *, CASE WHEN size >= {max(1, p.tol // 2)} THEN {char} ELSE {p.characters} END AS c FROM fc)
  GROUP BY object_id, band, band_idx, i HAVING count(*) = 2 AND min(c) < {p.characters})"""
    return text.replace(", words AS (", f", {forward_}, words AS (SELECT * FROM fx UNION ALL ", 1)


def cross_validated(ctes: str, place: str, k: int, classes: int = 3) -> str:
    """CTEs up to ``cvm(place, dropped, n, cv_mean, cv_std)``: class means on weights, fold by fold, of the features of every ``place`` (an expression of param_id)."""
    return f"""{ctes}, cvl AS (SELECT object_id, (object_id::BIGINT % {classes}) AS label FROM (SELECT DISTINCT object_id FROM s)),
cvf AS (SELECT object_id, label, (row_number() OVER (PARTITION BY label ORDER BY {uniform('object_id')}, object_id) - 1) % {k} AS fold FROM cvl),
cvb AS (SELECT object_id, {place} AS place, (param_id, band_idx, word) AS feature, tf FROM bag), cvs AS (SELECT unnest(range(0, {k})) AS cv),
cvn AS (SELECT cv, count(*) AS n FROM cvf, cvs WHERE fold <> cv GROUP BY 1), cvz AS (SELECT cv, label, count(*) AS size FROM cvf, cvs WHERE fold <> cv GROUP BY 1, 2),
cvx AS (SELECT cvb.*, label, fold, cv FROM cvb JOIN cvf USING (object_id), cvs), cvd AS (SELECT *, count(*) FILTER (fold <> cv) OVER (PARTITION BY place, cv, feature) AS df FROM cvx),
cvw AS (SELECT cvd.*, (1.0 + ln(tf)) * (ln((1.0 + n) / (1.0 + df)) + 1.0) AS raw FROM cvd JOIN cvn USING (cv)), cvu AS (SELECT *, raw / sqrt(sum(raw * raw) OVER (PARTITION BY place, cv, object_id)) AS w FROM cvw),
cvc AS (SELECT place, cv, feature, label AS pred, sum(w) / any_value(size) AS c FROM cvu JOIN cvz USING (cv, label) WHERE fold <> cv GROUP BY 1, 2, 3, 4), cvp AS (SELECT place, cv, pred, sum(c * c) AS pp FROM cvc GROUP BY 1, 2, 3),
cvt AS (SELECT cvu.place, cvu.cv, object_id, pred, sum(w * c) AS dot FROM cvu JOIN cvc USING (place, cv, feature) WHERE fold = cv GROUP BY 1, 2, 3, 4),
cvq AS (SELECT x.place, cvf.object_id, cvf.label, cvz.cv, cvz.label AS pred FROM (SELECT DISTINCT place FROM cvb) x, cvf JOIN cvz ON cvz.cv = cvf.fold),
cve AS (SELECT cvq.*, round(coalesce(pp, 0) - 2 * coalesce(dot, 0), 9) AS far FROM cvq LEFT JOIN cvp USING (place, cv, pred) LEFT JOIN cvt USING (place, cv, object_id, pred)),
cvr AS (SELECT place, cv, object_id, label, pred FROM cve QUALIFY row_number() OVER (PARTITION BY place, cv, object_id ORDER BY far, pred) = 1),
cva AS (SELECT place, cv, avg(r) AS ba FROM (SELECT place, cv, label, avg((label = pred)::INT) AS r FROM cvr GROUP BY 1, 2, 3) GROUP BY 1, 2),
cvm AS (SELECT place, avg(ba) AS cv_mean, stddev_pop(ba) AS cv_std, (SELECT count(*) FROM cvf) AS n, (SELECT count(*) FROM cvf) - (SELECT count(DISTINCT object_id) FROM cvb WHERE cvb.place = cva.place) AS dropped FROM cva GROUP BY 1)"""
