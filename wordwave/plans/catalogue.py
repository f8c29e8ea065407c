"""Queries over the test tables, one for each operator, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import config
from ..operators import classify, compact, dtw, features, search, sliders, words, workflow
from ..operators.store import written
from ..operators.words import Param
from ..sources import series as source
from ..sources.series import DAY, table
from . import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "bag_wl1"

#: Windows of the queries: ten days over events, four hundred over line items.
SHORT, LONG = 10.0, 400.0


def query(sql_text: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql_text is not None:
            ORACLE_SQL[key] = sql_text
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Rounds, and turns -0.0 into 0.0."""
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in columns})


def r(expression: str, digits: int = 6) -> str:
    return f"(round({expression}, {digits}) + 0.0)"


EV, LI = sql.EVENTS, sql.LINES
_ev, _li = source.events_series, source.line_series

# ---------------------------------------------------------------- metadata views

META_SQL = """SELECT c_custkey AS object_id, c_nationkey % 5 AS label, CASE WHEN c_custkey % 3 <> 0 AND c_custkey > 3 THEN c_custkey - c_custkey % 3 END AS reference_object_id,
  CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END AS ddf, (c_acctbal + 1000) / 5000 AS redshift FROM customer"""
DETECT_SQL = "SELECT o_custkey AS object_id, count(*) AS detections FROM orders GROUP BY 1"


def metadata(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.alias("object_id"),
        (F.col("c_nationkey") % 5).alias("label"),
        F.when((k % 3 != 0) & (k > 3), k - k % 3).alias("reference_object_id"),
        F.when(k % 4 == 0, 1).otherwise(0).alias("ddf"),
        ((F.col("c_acctbal") + 1000) / 5000).alias("redshift"),
    )


def detections(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("object_id")).agg(F.count(F.lit(1)).alias("detections"))


# ---------------------------------------------------------------- profiles and aggregates


@query(f"""SELECT object_id, count(*) AS n, {r('(max(tus) - min(tus)) / 86400000000.0')} AS duration, {r('avg(value)')} AS mean, {r('stddev_pop(value)')} AS std FROM ({EV}) GROUP BY 1""")
def obs_profile(spark, d):
    return rounded(workflow.profile(_ev(spark, d)), "duration", "mean", "std")


@query(f"""WITH o AS (SELECT object_id, count(*) AS n, (max(tus) - min(tus)) / 86400000000.0 AS duration FROM ({EV}) GROUP BY 1)
SELECT floor(avg(2 * n))::BIGINT AS budget, {r('avg(duration)')} AS mean_duration, {r('stddev_pop(duration)')} AS std_duration, {r('avg(duration) + stddev_pop(duration)')} AS max_window FROM o""")
def dataset_scalars(spark, d):
    return rounded(workflow.dataset_scalars(_ev(spark, d)), "mean_duration", "std_duration", "max_window")


@query(f"SELECT label, count(*) AS n FROM ({META_SQL}) GROUP BY 1")
def class_count(spark, d):
    return metadata(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT label, count(*) FILTER (ddf = 0) AS wide, count(*) FILTER (ddf = 1) AS deep FROM ({META_SQL}) GROUP BY 1")
def class_by_survey_pivot(spark, d):
    return metadata(spark, d).groupBy("label").pivot("ddf", [0, 1]).agg(F.count(F.lit(1))).na.fill(0).select("label", F.col("0").alias("wide"), F.col("1").alias("deep"))


_CODES = [6, 15, 16, 42, 52, 53, 62, 64, 65, 67, 88, 90, 92, 95, 99, 991, 992, 993, 994, 995]
_CASES = " ".join(f"WHEN {i} THEN '{config.MERGED_CLASSES[c]}'" for i, c in enumerate(_CODES))
_NUMBERS = " ".join(f"WHEN '{k}' THEN {v}" for k, v in config.MERGED_NUMBERS.items())


@query(f"""WITH m AS (SELECT CASE c_nationkey % 20 {_CASES} END AS merged FROM customer)
SELECT merged, CASE merged {_NUMBERS} END AS number, count(*) AS n FROM m GROUP BY 1, 2""")
def merged_label_count(spark, d):
    codes = F.array(*(F.lit(c) for c in _CODES))
    code = F.get(codes, F.col("c_nationkey") % 20)
    names = F.create_map(*(x for k, v in config.MERGED_CLASSES.items() for x in (F.lit(k), F.lit(v))))
    numbers = F.create_map(*(x for k, v in config.MERGED_NUMBERS.items() for x in (F.lit(k), F.lit(v))))
    return table(spark, d, "customer").select(names[code].alias("merged")).groupBy("merged").agg(F.count(F.lit(1)).alias("n")).select("merged", numbers[F.col("merged")].alias("number"), "n")


@query(f"SELECT label, dense_rank() OVER (ORDER BY label) - 1 AS idx, n FROM (SELECT label * 7 + 3 AS label, count(*) AS n FROM ({META_SQL}) GROUP BY 1)")
def label_index(spark, d):
    from pyspark.sql import Window as W

    counts = metadata(spark, d).groupBy((F.col("label") * 7 + 3).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("label", (F.dense_rank().over(W.orderBy("label")) - 1).cast("long").alias("idx"), "n")


@query(f"SELECT band, count(DISTINCT object_id) AS objects FROM ({EV}) GROUP BY 1")
def objects_per_band(spark, d):
    return _ev(spark, d).groupBy("band").agg(F.countDistinct("object_id").alias("objects"))


@query(f"SELECT label, count(*) AS n FROM ({META_SQL}) GROUP BY 1 HAVING count(*) >= 20")
def freq_class_having(spark, d):
    return metadata(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n")).where("n >= 20")


@query(f"SELECT label, n FROM (SELECT label, count(*) AS n FROM ({META_SQL}) GROUP BY 1) ORDER BY n DESC, label LIMIT 3")
def class_frequency_top(spark, d):
    return metadata(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(3)


@query("SELECT o_custkey AS object_id, sum((o_totalprice > 100000)::INT)::BIGINT AS detections FROM orders GROUP BY 1 HAVING sum((o_totalprice > 100000)::INT) > 5")
def detections_having(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("object_id")).agg(F.sum((F.col("o_totalprice") > 100000).cast("long")).alias("detections")).where("detections > 5")


@query(f"SELECT object_id, label, redshift FROM ({META_SQL}) WHERE ddf = 1")
def survey_filter(spark, d):
    return metadata(spark, d).where("ddf = 1").select("object_id", "label", "redshift")


@query(f"SELECT object_id, label FROM ({META_SQL}) WHERE label IN (1, 3)")
def class_membership(spark, d):
    return metadata(spark, d).where(F.col("label").isin(1, 3)).select("object_id", "label")


@query(f"SELECT object_id, band, tus, value, ord FROM ({EV}) WHERE band = 'click'")
def single_band(spark, d):
    return _ev(spark, d).where("band = 'click'").select("object_id", "band", "tus", "value", "ord")


@query(f"SELECT s.object_id, s.band, s.value, m.label FROM ({EV}) s JOIN ({META_SQL}) m ON m.object_id::VARCHAR = s.object_id")
def obs_meta_join(spark, d):
    m = metadata(spark, d).select(F.col("object_id").cast("string").alias("object_id"), "label")
    return _ev(spark, d).join(m, "object_id").select("object_id", "band", "value", "label")


@query(f"SELECT object_id, label FROM ({META_SQL}) WHERE object_id IN (SELECT object_id FROM ({DETECT_SQL}) WHERE detections > 10)")
def semi_join_ids(spark, d):
    return metadata(spark, d).join(detections(spark, d).where("detections > 10"), "object_id", "left_semi").select("object_id", "label")


@query(f"SELECT object_id, label, reference_object_id FROM ({META_SQL}) m WHERE NOT EXISTS (SELECT 1 FROM ({DETECT_SQL}) x WHERE x.detections <= 8 AND x.object_id = m.reference_object_id)")
def anti_join_ids(spark, d):
    bad = detections(spark, d).where("detections <= 8").select(F.col("object_id").alias("bad"))
    m = metadata(spark, d)
    return m.join(bad, m["reference_object_id"] == bad["bad"], "left_anti").select("object_id", "label", "reference_object_id")


@query(f"""WITH m AS ({META_SQL}) SELECT b.object_id, count(a.object_id) AS n FROM m b LEFT JOIN m a ON a.reference_object_id = b.object_id WHERE b.reference_object_id IS NULL GROUP BY 1""")
def left_count_augment(spark, d):
    m = metadata(spark, d)
    added = m.where("reference_object_id is not null").groupBy(F.col("reference_object_id").alias("object_id")).agg(F.count(F.lit(1)).alias("n"))
    return m.where("reference_object_id is null").select("object_id").join(added, "object_id", "left").select("object_id", F.coalesce("n", F.lit(0)).alias("n"))


_GAPS = f"SELECT object_id, band, ord, (tus - lag(tus) OVER ({sql.OWN} ORDER BY tus, ord)) / 86400000000.0 AS gap FROM ({EV})"


@query(f"SELECT object_id, band, ord, {r('gap')} AS gap FROM ({_GAPS}) WHERE gap IS NOT NULL")
def interval_diff(spark, d):
    return rounded(workflow.intervals(_ev(spark, d)), "gap")


@query(f"SELECT least(floor(gap / 1.5), 19)::BIGINT AS bucket, count(*) AS n FROM ({_GAPS}) WHERE gap BETWEEN 0 AND 30 GROUP BY 1")
def interval_histogram(spark, d):
    return workflow.histogram(workflow.intervals(_ev(spark, d)), "gap", 0.0, 30.0, 20)


@query(f"""SELECT band, {r('min(value)')} AS low, {r('quantile_cont(value, 0.25)')} AS q1, {r('quantile_cont(value, 0.5)')} AS median, {r('quantile_cont(value, 0.75)')} AS q3, {r('max(value)')} AS high FROM ({EV}) GROUP BY 1""")
def boxplot_summary(spark, d):
    return rounded(workflow.five_numbers(_ev(spark, d), "band", "value"), "low", "q1", "median", "q3", "high")


# ---------------------------------------------------------------- sequences


@query(f"SELECT object_id, band, string_agg(round(value, 2)::DECIMAL(12, 2)::VARCHAR, ',' ORDER BY tus, ord) AS points FROM ({EV}) GROUP BY 1, 2")
def series_collect(spark, d):
    rows = _ev(spark, d).groupBy("object_id", "band").agg(F.array_sort(F.collect_list(F.struct("tus", "ord", F.round("value", 2).cast("decimal(12,2)").cast("string").alias("v")))).alias("p"))
    return rows.select("object_id", "band", F.array_join(F.transform("p", lambda x: x["v"]), ",").alias("points"))


@query(f"SELECT object_id, band, ord, {r(f'(tus - min(tus) OVER (PARTITION BY object_id)) / 86400000000.0')} AS time FROM ({EV})")
def time_rebase(spark, d):
    from pyspark.sql import Window as W

    s = _ev(spark, d)
    return rounded(s.select("object_id", "band", "ord", ((F.col("tus") - F.min("tus").over(W.partitionBy("object_id"))) / float(DAY)).alias("time")), "time")


@query(f"""SELECT object_id, band, ord, {r(f'coalesce((value - avg(value) OVER ({sql.OWN})) / nullif(stddev_pop(value) OVER ({sql.OWN}), 0), 0)')} AS z,
  {r(f'coalesce((value - min(value) OVER ({sql.OWN})) / nullif(max(value) OVER ({sql.OWN}) - min(value) OVER ({sql.OWN}), 0), 0)')} AS scaled FROM ({LI})""")
def zscore_series(spark, d):
    from pyspark.sql import Window as W

    own, v = W.partitionBy("object_id", "band"), F.col("value")
    z = F.coalesce(F.try_divide(v - F.avg(v).over(own), F.stddev_pop(v).over(own)), F.lit(0.0))
    scaled = F.coalesce(F.try_divide(v - F.min(v).over(own), F.max(v).over(own) - F.min(v).over(own)), F.lit(0.0))
    return rounded(_li(spark, d).select("object_id", "band", "ord", z.alias("z"), scaled.alias("scaled")), "z", "scaled")


@query(f"""SELECT object_id, band, NOT bool_or(coalesce(step <= 0, false)) AS increasing FROM (SELECT *, tus - lag(tus) OVER ({sql.OWN} ORDER BY tus, ord) AS step FROM ({LI})) GROUP BY 1, 2""")
def monotonic_check(spark, d):
    return workflow.increasing_times(_li(spark, d))


# ---------------------------------------------------------------- windows

_P = f"WITH {sql.indexed(EV)}"
_PL = f"WITH {sql.indexed(LI)}"
_W = round(SHORT * DAY)
_WL = round(LONG * DAY)


@query(f"{_P} SELECT object_id, band, i, j FROM ({sql.forward(_W, 2)})")
def slide_forward(spark, d):
    return words.forward_windows(_ev(spark, d), _W, 2)


@query(f"{_P} SELECT object_id, band, i, j FROM ({sql.backward(_W, 2)})")
def slide_backward(spark, d):
    return words.backward_windows(_ev(spark, d), _W, 2)


@query(f"{_PL} SELECT object_id, band, i, j FROM ({sql.backward(_WL, 4)})")
def slide_backward_ties(spark, d):
    return words.backward_windows(_li(spark, d), _WL, 4)


@query(f"""{_P}, x AS (SELECT *, min(tus) OVER ({sql.OWN}) AS t0, max(tus) OVER ({sql.OWN}) AS t1, max(i) OVER ({sql.OWN} ORDER BY tus RANGE BETWEEN CURRENT ROW AND {_W} FOLLOWING) + 1 AS ahead,
  min(i) OVER ({sql.OWN} ORDER BY tus RANGE BETWEEN {_W} PRECEDING AND CURRENT ROW) AS behind FROM p)
SELECT object_id, band, 0 AS dir, i, ahead AS j FROM x WHERE i < n - 1 AND tus + {_W} <= t1 AND ahead - i > 2
UNION ALL SELECT object_id, band, 1, behind, i FROM x WHERE i > 1 AND tus - {_W} >= t0 AND i - behind > 2""")
def slide_two_way_legacy(spark, d):
    return sliders.two_way(_ev(spark, d), _W, 2)


@query(f"""{_P}, e AS (SELECT object_id, band, min(tus) AS a, max(tus) AS b FROM p GROUP BY 1, 2),
k AS (SELECT object_id, band, a, unnest(range(0, ((b - a) // {3 * DAY})::BIGINT)) AS k FROM e), c AS (
SELECT k.object_id, k.band, k.k, count(*) FILTER (p.tus < a + k * {3 * DAY}) AS i, count(*) FILTER (p.tus <= a + k * {3 * DAY} + {5 * DAY}) AS j FROM k JOIN p USING (object_id, band) GROUP BY 1, 2, 3)
SELECT object_id, band, k, CASE WHEN i >= j THEN -1 ELSE i END AS i, CASE WHEN i >= j THEN -1 ELSE j END AS j FROM c""")
def slide_fixed_step(spark, d):
    return sliders.fixed_step(_ev(spark, d), 5 * DAY, 3 * DAY, overlapping=False)


@query(f"""{_P} SELECT object_id, band, k.i AS k, (SELECT min(q.i) FROM p q WHERE q.object_id = k.object_id AND q.band = k.band AND q.tus = k.tus) AS i,
  max(k.i) OVER ({sql.OWN} ORDER BY tus RANGE BETWEEN CURRENT ROW AND {5 * DAY} FOLLOWING) + 1 AS j FROM p k QUALIFY k.i < k.n - 1""")
def slide_every_point(spark, d):
    return sliders.fixed_step(_ev(spark, d), 5 * DAY)


@query(f"""SELECT object_id, band, k, k * 2 AS i, k * 2 + 4 AS j FROM (SELECT object_id, band, unnest(range(0, (count(*) // 2)::BIGINT)) AS k FROM ({EV}) GROUP BY 1, 2)""")
def slide_index(spark, d):
    return sliders.by_index(_ev(spark, d), 4, 2)


@query(f"""WITH w AS (SELECT object_id, band, k, k * 9 AS i, k * 9 + 9 AS j FROM (SELECT object_id, band, unnest(range(0, (count(*) // 9)::BIGINT)) AS k FROM ({LI}) GROUP BY 1, 2))
SELECT object_id, band, k, i, j, s AS segment, i + s * 2 AS b, i + (s + 1) * 2 AS e FROM w, range(0, 4) x(s)""")
def segment_legacy_index(spark, d):
    return sliders.index_segments(sliders.by_index(_li(spark, d), 9, 9), 4)


def _segments_sql(series: str, width: int, wl: int) -> str:
    sub = width / wl
    bounds = ", ".join(f"count(*) FILTER (p.tus < w.w_end::DOUBLE - {k + 1} * {sub!r}) AS g{k}, count(*) FILTER (p.tus <= w.w_end::DOUBLE - {k} * {sub!r}) - 1 AS h{k}" for k in range(wl))
    begin = [f"greatest(g{k}, 1)" for k in range(wl)]
    stop = [f"greatest(1, least(h{k}, {'m - 1' if k == 0 else begin[k - 1]}))" for k in range(wl)]
    rows = []
    for k in range(wl):
        a, b = f"w_end::DOUBLE - {k + 1} * {sub!r}", f"w_end::DOUBLE - {k} * {sub!r}"
        valid = f"coalesce({b} > ts[{begin[k]} + 1] AND ts[{begin[k]} + 1] >= {a} AND {b} >= ts[{stop[k]} + 1] AND ts[{stop[k]} + 1] > {a}, false)"
        rows.append(f"SELECT object_id, band, i, j, {k} AS k, (CASE WHEN {valid} THEN {begin[k]} ELSE -1 END)::BIGINT AS b, (CASE WHEN {valid} THEN {stop[k]} ELSE -1 END)::BIGINT AS e FROM g")
    return f"""WITH {sql.indexed(series)}, w AS ({sql.backward(width, 2 * wl)}), g AS (SELECT w.object_id, w.band, w.i, w.j, w.w_end, w.j - w.i AS m, list(p.tus ORDER BY p.i) AS ts, {bounds}
  FROM w JOIN p ON p.object_id = w.object_id AND p.band = w.band AND p.i >= w.i AND p.i < w.j GROUP BY 1, 2, 3, 4, 5) {' UNION ALL '.join(rows)}"""


@query(_segments_sql(LI, _WL, 3).replace("{wl}", "3"))
def segment_backward_wl3(spark, d):
    rows = words.windows(_li(spark, d), [Param(LONG, 3, ("min",))]).where("dir = 1")
    rows = rows.withColumn("bounds", words.backward_bounds(F.col("ts"), F.col("w_end"), _WL, 3))
    found = rows.select("object_id", "band", "i", "j", F.posexplode(words.backward_segments(F.col("ts"), F.col("w_end"), _WL, 3, F.col("bounds"))).alias("k", "s"))
    return found.select("object_id", "band", "i", "j", "k", F.col("s.b").cast("long").alias("b"), F.col("s.e").cast("long").alias("e"))


@query(f"""WITH RECURSIVE {sql.indexed(LI)}, w AS (SELECT * FROM ({sql.forward(_WL, 6)})), g AS (
  SELECT w.object_id, w.band, w.i, w.j, (w.j - w.i) AS m, list(p.tus ORDER BY p.i) AS ts FROM w JOIN p ON p.object_id = w.object_id AND p.band = w.band AND p.i >= w.i AND p.i < w.j GROUP BY 1, 2, 3, 4),
c AS (SELECT *, k, ts[1]::DOUBLE + k * {_WL / 3!r} AS a, ts[1]::DOUBLE + (k + 1) * {_WL / 3!r} AS b FROM g, range(0, 3) x(k)),
h AS (SELECT object_id, band, i, j, k, m, ts, a, b, len(list_filter(ts, lambda t: t < a)) AS g, len(list_filter(ts, lambda t: t <= b)) AS h FROM c),
s AS (SELECT *, 0::BIGINT AS prev, h AS stop FROM h WHERE k = 0 UNION ALL
  SELECT h.object_id, h.band, h.i, h.j, h.k, h.m, h.ts, h.a, h.b, h.g, h.h, s.stop, greatest(s.stop, h.h) FROM s JOIN h ON h.object_id = s.object_id AND h.band = s.band AND h.i = s.i AND h.k = s.k + 1),
z AS (SELECT *, CASE WHEN prev = m THEN prev ELSE greatest(prev, least(g, m - 1)) END AS begin_ FROM s),
e AS (SELECT *, begin_ = m OR coalesce(ts[begin_ + 1] >= b, true) OR coalesce(ts[stop] < a, true) AS empty_ FROM z)
SELECT object_id, band, i, j, k::INT AS k, (CASE WHEN empty_ THEN -1 ELSE begin_ END)::BIGINT AS b, (CASE WHEN empty_ THEN -1 ELSE stop END)::BIGINT AS e FROM e""".replace("s AS (SELECT *, 0::BIGINT", "sg AS (SELECT *, 0::BIGINT").replace("FROM s JOIN h ON h.object_id = s.object_id AND h.band = s.band AND h.i = s.i AND h.k = s.k + 1)", "FROM sg JOIN h ON h.object_id = sg.object_id AND h.band = sg.band AND h.i = sg.i AND h.k = sg.k + 1)").replace("h.h, s.stop, greatest(s.stop, h.h)", "h.h, sg.stop, greatest(sg.stop, h.h)").replace("AS begin_ FROM s)", "AS begin_ FROM sg)"))
def segment_single_wl3(spark, d):
    rows = words.windows(_li(spark, d), [Param(LONG, 3, ("min",))]).where("dir = 0")
    found = rows.select("object_id", "band", "i", "j", F.posexplode(words.single_segments(F.col("ts"), F.get("ts", F.lit(0)), _WL, 3)).alias("k", "s"))
    return found.select("object_id", "band", "i", "j", "k", F.col("s.b").cast("long").alias("b"), F.col("s.e").cast("long").alias("e"))


@query(f"""{_PL} SELECT object_id, band, i, {r(f'sum(value) OVER ({sql.OWN} ORDER BY i)')} AS cum1, {r(f'sum(value * value) OVER ({sql.OWN} ORDER BY i)')} AS cum2 FROM p""")
def prefix_sums(spark, d):
    from pyspark.sql import Window as W

    run = W.partitionBy("object_id", "band").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    rows = words.indexed(_li(spark, d))
    return rounded(rows.select("object_id", "band", "i", F.sum("value").over(run).alias("cum1"), F.sum(F.col("value") * F.col("value")).over(run).alias("cum2")), "cum1", "cum2")


@query(f"""{_PL}, w AS ({sql.backward(_WL, 4)}) SELECT w.object_id, w.band, w.i, w.j, {r('avg(p.value)')} AS mu, {r('sqrt(abs(avg(p.value * p.value) * avg(p.value * p.value) - avg(p.value) * avg(p.value)))', 5)} AS sigma
FROM w JOIN p ON p.object_id = w.object_id AND p.band = w.band AND p.i >= w.i AND p.i < w.j GROUP BY 1, 2, 3, 4""")
def window_mean_sigma(spark, d):
    rows = words.windows(_li(spark, d), [Param(LONG, 2, ("mean",))]).where("dir = 1")
    n = F.size("vs").cast("double")
    mu, sq = words._moment(F.col("vs"), lambda v: v) / n, words._moment(F.col("vs"), lambda v: v * v) / n
    return rounded(rounded(rows.select("object_id", "band", "i", "j", mu.alias("mu"), F.sqrt(F.abs(sq * sq - mu * mu)).alias("sigma")), "mu"), "sigma", digits=5)


# ---------------------------------------------------------------- quantities and words

_QUANTITIES = ("mean", "trend", "std", "var", "min_max", "min", "max", "count")


def _quantity(name: str):
    value = {"mean": "avg(p.value)"}.get(name, sql.VALUES[name].replace("value", "p.value").replace("tus", "p.tus"))
    text = f"""{_PL}, w AS ({sql.backward(_WL, 2)}) SELECT w.object_id, w.band, w.i, w.j, {r(value)} AS x
FROM w JOIN p ON p.object_id = w.object_id AND p.band = w.band AND p.i >= w.i AND p.i < w.j GROUP BY 1, 2, 3, 4"""

    def run(spark, d):
        rows = words.windows(_li(spark, d), [Param(LONG, 1, (name,))]).where("dir = 1")
        x = words._moment(F.col("vs"), lambda v: v) / F.size("vs") if name == "mean" else words.quantity(name, F.col("ts"), F.col("vs"), F.col("vs"))
        return rounded(rows.select("object_id", "band", "i", "j", x.alias("x")), "x")

    query(text, f"quantity_{name}")(run)


for _q in _QUANTITIES:
    _quantity(_q)


def _bag(name: str, series: str, load, params: list[Param], columns: str = "object_id, band, band_idx, param_id, word, tf"):
    def run(spark, d):
        return words.bag(words.words(load(spark, d), params)).select(*columns.split(", "))

    query(f"{sql.words(series, params)} SELECT {columns} FROM bag", name)(run)


WL1 = [Param(SHORT, 1, ("min_max",))]
_bag("bag_wl1", EV, _ev, WL1)
for _q in _QUANTITIES:
    _bag(f"word_wl1_{_q}", EV, _ev, [Param(SHORT, 1, (_q,))])
_bag("word_wl1_alpha6", EV, _ev, [Param(SHORT, 1, ("max",), (6,)), Param(SHORT, 1, ("min_max",), (6,)), Param(SHORT, 1, ("count",), (2,))])
_bag("word_fused_TrMm", LI, _li, [Param(LONG, 1, ("trend", "min_max"))])
_bag("word_wl2_backward", LI, _li, [Param(LONG, 2, ("min_max",))])
_bag("word_wl3_backward_fused", LI, _li, [Param(LONG, 3, ("min_max", "count"), (3, 2))])
MULTI = [Param(5.0, 1, ("min_max",)), Param(SHORT, 1, ("min_max",)), Param(SHORT, 1, ("max", "count"), (4, 2)), Param(15.0, 2, ("min_max",))]
_bag("bag_multi_param", EV, _ev, MULTI)


@query(f"{sql.words(EV, WL1)} SELECT object_id, band, dir, pos, word FROM kept")
def numerosity_reduction(spark, d):
    return words.words(_ev(spark, d), WL1).select("object_id", "band", "dir", "pos", "word")


@query(f"{sql.words(EV, WL1)} SELECT object_id, band, dir, pos, word FROM words")
def words_all(spark, d):
    return words.words(_ev(spark, d), WL1, num_reduction=False).select("object_id", "band", "dir", "pos", "word")


def _feature_sql(params: list[Param], bands: int) -> str:
    at, cases = 0, []
    for k, p in enumerate(params):
        cases.append(f"WHEN {k} THEN {at} + band_idx * {p.words} + word")
        at += p.words * bands
    return f"(CASE param_id {' '.join(cases)} END)::BIGINT"


@query(f"{sql.words(EV, MULTI)} SELECT object_id, {_feature_sql(MULTI, 5)} AS feature, tf FROM bag")
def bag_feature_ids(spark, d):
    return words.feature_ids(words.bag(words.words(_ev(spark, d), MULTI)), MULTI, 5).select("object_id", "feature", "tf")


@query(f"{sql.words(EV, WL1)} SELECT object_id, (word * 5 + band_idx)::BIGINT AS feature, tf FROM bag")
def bag_interleaved_layout(spark, d):
    return words.feature_ids(words.bag(words.words(_ev(spark, d), WL1)), WL1, 5, "interleaved").select("object_id", "feature", "tf")


_FUSED = [Param(LONG, 2, ("min_max", "count"), (3, 2))]


@query(f"{sql.words(LI, _FUSED)} SELECT DISTINCT word, array_to_string(list_transform(range(0, 2), lambda k: CASE WHEN (word // (7 ** k)::BIGINT) % 7 = 6 THEN '#' ELSE (((word // (7 ** k)::BIGINT) % 7) // 2)::VARCHAR || '.' || (((word // (7 ** k)::BIGINT) % 7) % 2)::VARCHAR END), ' ') AS decoded FROM kept")
def word_decode(spark, d):
    rows = words.words(_li(spark, d), _FUSED).select("word").distinct()
    text = F.transform(words.decode_word(F.col("word"), _FUSED[0]), lambda c: F.when(c.isNull(), "#").otherwise(F.array_join(F.transform(c, lambda x: x.cast("string")), ".")))
    return rows.select("word", F.array_join(text, " ").alias("decoded"))


@query(f"{sql.words(EV, WL1)} SELECT DISTINCT object_id FROM s WHERE object_id NOT IN (SELECT object_id FROM bag)")
def dropped_objects(spark, d):
    s = _ev(spark, d)
    return words.dropped_objects(s, words.bag(words.words(s, WL1)))


_TWO_WAY = [Param(LONG, 2, ("min_max",))]


@query(f"{sql.two_way_words(LI, _TWO_WAY[0])} SELECT object_id, band, band_idx, param_id, word, tf FROM bag")
def words_two_way_segmentation(spark, d):
    return words.bag(words.words(_li(spark, d), _TWO_WAY, segmentation="two_way"))


# ---------------------------------------------------------------- features

_BAGF = f"{sql.words(EV, WL1)}, f AS (SELECT object_id, (band_idx * {WL1[0].words} + word)::BIGINT AS feature, tf FROM bag), nobj AS (SELECT count(DISTINCT object_id) AS n_ FROM s)"


def _counts(spark, d) -> tuple[DataFrame, int]:
    s = _ev(spark, d)
    bag = words.feature_ids(words.bag(words.words(s, WL1)), WL1, 5).select("object_id", "feature", "tf")
    return written(bag), s.select("object_id").distinct().count()


_IDF = "idf AS (SELECT feature, count(*) AS df, ln((1.0 + (SELECT n_ FROM nobj)) / (1.0 + count(*))) + 1.0 AS idf FROM f GROUP BY 1)"
_LTC = f"{_BAGF}, {_IDF}, w AS (SELECT object_id, feature, (1.0 + ln(tf)) * idf AS w FROM f JOIN idf USING (feature)), ltc AS (SELECT object_id, feature, w / sqrt(sum(w * w) OVER (PARTITION BY object_id)) AS weight FROM w)"


@query(f"{_BAGF}, {_IDF} SELECT feature, df, {r('idf')} AS idf FROM idf")
def idf_table(spark, d):
    bag, n = _counts(spark, d)
    return rounded(features.idf_table(bag, n), "idf")


@query(f"{_LTC} SELECT object_id, feature, {r('weight')} AS weight FROM ltc")
def tfidf_ltc(spark, d):
    bag, n = _counts(spark, d)
    return rounded(features.tfidf(bag, n), "weight")


@query(f"{_BAGF}, w AS (SELECT object_id, feature, tf::DOUBLE AS w FROM f) SELECT object_id, feature, {r('w / sqrt(sum(w * w) OVER (PARTITION BY object_id))')} AS weight FROM w")
def smart_scheme_nnc(spark, d):
    bag, n = _counts(spark, d)
    return rounded(features.tfidf(bag, n, "nnc"), "weight")


_LAB = "lab AS (SELECT DISTINCT object_id, (object_id::BIGINT % 3) AS label FROM s)"


def _labels(s: DataFrame, k: int = 3) -> DataFrame:
    return s.select("object_id").distinct().select("object_id", (F.col("object_id").cast("long") % k).alias("label"))


@query(f"""{_BAGF}, {_LAB}, c AS (SELECT label, feature, sum(tf)::BIGINT AS tf FROM f JOIN lab USING (object_id) GROUP BY 1, 2), i AS (SELECT feature, ln((1.0 + 3) / (1.0 + count(*))) + 1.0 AS idf FROM c GROUP BY 1),
w AS (SELECT label, feature, (1.0 + ln(tf)) * idf AS w FROM c JOIN i USING (feature)) SELECT label, feature, {r('w / sqrt(sum(w * w) OVER (PARTITION BY label))')} AS weight FROM w""")
def tfidf_class_based(spark, d):
    bag, _ = _counts(spark, d)
    sums = features.class_sums(bag, _labels(_ev(spark, d)))
    return rounded(features.tfidf(sums, 3, doc="label"), "weight")


@query(f"{_BAGF} SELECT feature, {r('sum(tf * tf)::DOUBLE / (SELECT n_ FROM nobj) - (sum(tf)::DOUBLE / (SELECT n_ FROM nobj)) * (sum(tf)::DOUBLE / (SELECT n_ FROM nobj))')} AS variance FROM f GROUP BY 1")
def feature_variances(spark, d):
    bag, n = _counts(spark, d)
    return rounded(features.variances(bag, n), "variance")


@query(f"{_BAGF}, v AS (SELECT feature, sum(tf * tf)::DOUBLE / (SELECT n_ FROM nobj) - (sum(tf)::DOUBLE / (SELECT n_ FROM nobj)) * (sum(tf)::DOUBLE / (SELECT n_ FROM nobj)) AS v FROM f GROUP BY 1) SELECT feature FROM v WHERE v > 0")
def zero_variance_features(spark, d):
    bag, n = _counts(spark, d)
    return features.drop_zero_variance(bag, n).select("feature").distinct()


TWO = [Param(LONG, 1, ("min_max",)), Param(LONG, 1, ("max", "min"))]
_PAIR = f"{sql.words(LI, TWO)}, b AS (SELECT param_id, word, object_id, sum(tf) FILTER (band_idx = 0)::DOUBLE AS x0_, sum(tf) FILTER (band_idx = 1)::DOUBLE AS x1_, sum(tf) FILTER (band_idx = 2)::DOUBLE AS x2_, any_value(object_id::BIGINT % 3)::DOUBLE AS y FROM bag GROUP BY 1, 2, 3), x AS (SELECT param_id, word, y, coalesce(x0_, 0) AS x0, coalesce(x1_, 0) AS x1, coalesce(x2_, 0) AS x2 FROM b)"


@query(f"""{_PAIR} SELECT param_id, word, sum(x0 * x0) AS x0x0, sum(x0 * x1) AS x0x1, sum(x0 * x2) AS x0x2, sum(x1 * x1) AS x1x1, sum(x1 * x2) AS x1x2, sum(x2 * x2) AS x2x2, sum(x0 * y) AS x0y, sum(x1 * y) AS x1y, sum(x2 * y) AS x2y FROM x GROUP BY 1, 2""")
def manova_gram(spark, d):
    s = _li(spark, d)
    return features.gram(words.bag(words.words(s, TWO)), _labels(s), 3)


_DET = "(a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d))"


_SC = f"""{_PAIR}, g AS (SELECT param_id, word, sum(x0 * x0) AS a, sum(x0 * x1) AS b, sum(x0 * x2) AS c, sum(x1 * x1) AS d, sum(x1 * x2) AS e, sum(x2 * x2) AS f, sum(x0 * y) AS u, sum(x1 * y) AS v, sum(x2 * y) AS w FROM x GROUP BY 1, 2),
yy AS (SELECT sum((object_id::BIGINT % 3) * (object_id::BIGINT % 3))::DOUBLE AS yy FROM (SELECT DISTINCT object_id FROM s)),
sc AS (SELECT param_id, word, CASE WHEN abs({_DET}) > 1e-6 THEN (u * (u * (d * f - e * e) + v * (c * e - b * f) + w * (b * e - c * d)) + v * (u * (c * e - b * f) + v * (a * f - c * c) + w * (b * c - a * e)) + w * (u * (b * e - c * d) + v * (b * c - a * e) + w * (a * d - b * b))) / {_DET} / (SELECT yy FROM yy) ELSE 0 END AS score FROM g)"""


@query(f"{_SC} SELECT param_id::INT AS param_id, word, {r('score')} AS score FROM sc")
def manova_scores(spark, d):
    s = _li(spark, d)
    return rounded(features.manova_scores(words.bag(words.words(s, TWO)), _labels(s), 3), "score")


_TOP = "top AS (SELECT param_id, word FROM sc ORDER BY round(score, 9) DESC, param_id DESC, word DESC LIMIT {})"


@query(f"{_SC}, {_TOP.format(5)} SELECT object_id, band, band_idx, param_id, word, tf FROM bag JOIN top USING (param_id, word)")
def manova_rank_top_k(spark, d):
    s = _li(spark, d)
    bag = written(words.bag(words.words(s, TWO)))
    return features.select_top(bag, features.manova_scores(bag, _labels(s), 3), 5).select("object_id", "band", "band_idx", "param_id", "word", "tf")


@query(f"""{_SC}, own AS (SELECT param_id, word, sum(v) AS v FROM (SELECT param_id, word, band_idx, sum(tf * tf)::DOUBLE / (SELECT count(DISTINCT object_id) FROM s) - (sum(tf)::DOUBLE / (SELECT count(DISTINCT object_id) FROM s)) ** 2 AS v FROM bag GROUP BY 1, 2, 3) GROUP BY 1, 2),
run AS (SELECT row_number() OVER w AS k, sum(v) OVER w AS e, sum(score) OVER w AS c FROM sc JOIN own USING (param_id, word) WINDOW w AS (ORDER BY round(score, 9) DESC, param_id DESC, word DESC ROWS UNBOUNDED PRECEDING))
SELECT k, {r('(e - min(e) OVER ()) / (max(e) OVER () - min(e) OVER ())')} AS explained, {r('(c - min(c) OVER ()) / (max(c) OVER () - min(c) OVER ())')} AS cumulative FROM run""")
def manova_explained_top(spark, d):
    s = _li(spark, d)
    bag = written(words.bag(words.words(s, TWO)))
    return rounded(features.explained_by_top(bag, features.manova_scores(bag, _labels(s), 3), s.select("object_id").distinct().count()), "explained", "cumulative")


@query(f"""{_BAGF}, v AS (SELECT feature, round(sum(tf * tf)::DOUBLE / (SELECT n_ FROM nobj) - (sum(tf)::DOUBLE / (SELECT n_ FROM nobj)) * (sum(tf)::DOUBLE / (SELECT n_ FROM nobj)), 9) AS score FROM f GROUP BY 1),
best AS (SELECT feature, row_number() OVER (ORDER BY score DESC, feature) - 1 AS rank FROM v ORDER BY score DESC, feature LIMIT 3) SELECT object_id AS row, rank, tf AS weight FROM f JOIN best USING (feature)""")
def columns_by_rank(spark, d):
    bag, n = _counts(spark, d)
    ranking = features.variances(bag, n).select("feature", F.round("variance", 9).alias("score"))
    return features.take_ranked(bag.select(F.col("object_id").alias("row"), "feature", F.col("tf").alias("weight")), ranking, 3).withColumn("rank", F.col("rank").cast("long"))


@query(f"""{_BAGF}, {_LAB}, z AS (SELECT label, count(*) AS size FROM lab GROUP BY 1), t AS (SELECT sum(size) AS n, count(*) AS k FROM z),
q AS (SELECT feature, label, sum(tf)::DOUBLE AS s, sum(tf * tf)::DOUBLE AS q FROM f JOIN lab USING (object_id) GROUP BY 1, 2),
a AS (SELECT feature, sum(s) AS s, sum(q) AS q, sum(s * s / size) AS b FROM q JOIN z USING (label) GROUP BY 1)
SELECT feature, {r('(b - s * s / n) / (k - 1) / nullif((q - b) / (n - k), 0)')} AS f FROM a, t""")
def anova_f(spark, d):
    bag, _ = _counts(spark, d)
    return rounded(features.anova_f(bag, _labels(_ev(spark, d))), "f")


# ---------------------------------------------------------------- classification

_CENT = f"{_LTC}, {_LAB}, z AS (SELECT label, count(*) AS size FROM lab GROUP BY 1), cen AS (SELECT label, feature, sum(weight) / any_value(size) AS c FROM ltc JOIN lab USING (object_id) JOIN z USING (label) GROUP BY 1, 2)"


@query(f"{_CENT} SELECT label, feature, {r('c')} AS weight FROM cen")
def centroids(spark, d):
    bag, n = _counts(spark, d)
    return rounded(classify.centroids(features.tfidf(bag, n), _labels(_ev(spark, d))), "weight")


_PRED = f"""{_CENT}, nq AS (SELECT object_id, sum(weight * weight) AS qq FROM ltc GROUP BY 1), np AS (SELECT label, sum(c * c) AS pp FROM cen GROUP BY 1),
dot AS (SELECT object_id, cen.label, sum(weight * c) AS dot FROM ltc JOIN cen USING (feature) GROUP BY 1, 2),
dist AS (SELECT nq.object_id, np.label, round(sqrt(greatest(qq + pp - 2 * coalesce(dot, 0), 0)), 9) AS distance FROM nq CROSS JOIN np LEFT JOIN dot ON dot.object_id = nq.object_id AND dot.label = np.label),
pred AS (SELECT object_id, label AS pred, distance FROM dist QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY distance, label) = 1)"""


def _predicted(spark, d) -> DataFrame:
    bag, n = _counts(spark, d)
    weights, labels = features.tfidf(bag, n), _labels(_ev(spark, d))
    return classify.nearest(weights, classify.centroids(weights, labels)).join(labels, "object_id")


@query(f"{_PRED} SELECT object_id, pred, {r('distance')} AS distance FROM pred")
def knn_prototype_predict(spark, d):
    return rounded(_predicted(spark, d).select("object_id", "pred", "distance"), "distance")


@query(f"{_PRED} SELECT {r('avg(r)')} AS balanced_accuracy FROM (SELECT label, avg((label = pred)::INT) AS r FROM pred JOIN lab USING (object_id) GROUP BY 1)")
def balanced_accuracy(spark, d):
    return rounded(classify.balanced_accuracy(_predicted(spark, d)), "balanced_accuracy")


@query(f"{_PRED} SELECT label, pred, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY label), 2) AS share FROM pred JOIN lab USING (object_id) GROUP BY 1, 2")
def confusion_matrix_norm(spark, d):
    return classify.confusion(_predicted(spark, d))


_EMB = "e AS (SELECT vec_id AS object_id, label, embedding::DOUBLE[] AS f FROM embeddings)"


_EUCLID = "round(sqrt(list_sum(list_transform(range(1, 65), lambda i: (q.f[i] - t.f[i]) * (q.f[i] - t.f[i])))), 9)"


def _embeddings(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("object_id"), "label", F.col("embedding").cast("array<double>").alias("features"))


@query(f"""WITH {_EMB}, q AS (SELECT object_id, f FROM e WHERE object_id % 50 = 0)
SELECT q.object_id, t.label AS pred FROM q JOIN e t ON t.object_id <> q.object_id QUALIFY row_number() OVER (PARTITION BY q.object_id ORDER BY {_EUCLID}, t.label) = 1""")
def knn_predict(spark, d):
    e = _embeddings(spark, d)
    return classify.k_nearest_others(e.where("object_id % 50 = 0").select("object_id", "features"), e)


@query(f"""WITH {_EMB}, q AS (SELECT object_id, f FROM e WHERE object_id % 50 = 0),
near AS (SELECT q.object_id, t.label, {_EUCLID} AS d FROM q JOIN e t ON t.object_id <> q.object_id QUALIFY row_number() OVER (PARTITION BY q.object_id ORDER BY {_EUCLID}, t.label) <= 5)
SELECT object_id, label AS pred FROM (SELECT object_id, label, count(*) AS votes, min(d) AS d FROM near GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY votes DESC, d, label) = 1""")
def knn_majority(spark, d):
    e = _embeddings(spark, d)
    return classify.k_nearest_others(e.where("object_id % 50 = 0").select("object_id", "features"), e, 5)


def _split_embeddings(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = _embeddings(spark, d)
    wide = e.select("object_id", *(F.get("features", F.lit(i)).alias(f"fea{i + 1}") for i in range(64)))
    return wide.where("object_id % 5 <> 0"), wide.where("object_id % 5 = 0"), e.select("object_id", "label")


_HALF = f"{_EMB}, a AS (SELECT * FROM e WHERE object_id % 5 <> 0), b AS (SELECT * FROM e WHERE object_id % 5 = 0)"


@query(f"""WITH {_HALF}, m AS (SELECT label, i, avg(v) AS v FROM (SELECT label, unnest(range(1, 65)) AS i, unnest(f) AS v FROM a) GROUP BY 1, 2), t AS (SELECT label, list(v ORDER BY i) AS f FROM m GROUP BY 1)
SELECT q.object_id, q.label, t.label AS pred FROM b q, t QUALIFY row_number() OVER (PARTITION BY q.object_id ORDER BY {_EUCLID}, t.label) = 1""")
def knn_wrapper_prototype(spark, d):
    train, test, labels = _split_embeddings(spark, d)
    return classify.KnnClassifier().fit(train, labels).predict(test, labels)


@query(f"""WITH {_HALF}, u AS (SELECT object_id, label, unnest(range(1, 65)) AS i, unnest(f) / sqrt(list_sum(list_transform(f, lambda x: x * x))) AS v FROM e), m AS (SELECT i, avg(v) AS m, stddev_pop(v) AS s FROM u WHERE object_id % 5 <> 0 GROUP BY 1),
z AS (SELECT object_id, label, list(CASE WHEN s > 0 THEN (v - m) / s ELSE v - m END ORDER BY i) AS f FROM u JOIN m USING (i) GROUP BY 1, 2)
SELECT q.object_id, q.label, t.label AS pred FROM z q JOIN z t ON q.object_id % 5 = 0 AND t.object_id % 5 <> 0 QUALIFY row_number() OVER (PARTITION BY q.object_id ORDER BY {_EUCLID.replace(', 9)', ', 7)')}, t.label) = 1""")
def knn_wrapper_scaled(spark, d):
    train, test, labels = _split_embeddings(spark, d)
    return classify.KnnClassifier(prototype=False, normalizer=True, scaler=True).fit(train, labels).predict(test, labels)


@query(f"""WITH RECURSIVE {_EMB}, v AS (SELECT object_id, list_transform(range(0, 16), lambda k: f[k * 4 + 1:k * 4 + 4]) AS x FROM e),
t AS (SELECT a.object_id AS a, b.object_id AS b, a.x AS p, b.x AS q, 0 AS i, list_concat([0.0::DOUBLE], list_transform(b.x, lambda y: 'infinity'::DOUBLE)) AS row FROM v a, v b WHERE a.object_id % 50 = 0
  UNION ALL SELECT a, b, p, q, i + 1, list_reduce(list_transform(q, lambda y: [list_sum(list_transform(range(1, 5), lambda n: (p[i + 1][n] - y[n]) * (p[i + 1][n] - y[n])))]),
    lambda acc, c, k: list_append(acc, c[1] + least(acc[len(acc)], row[k], row[k + 1])), ['infinity'::DOUBLE]) FROM t WHERE i < len(p))
SELECT a, b, {r('sqrt(row[len(row)])')} AS distance FROM t WHERE i = len(p)""")
def dtw_dependent(spark, d):
    e = _embeddings(spark, d).select("object_id", "features")
    return rounded(dtw.dependent_matrix(e.where("object_id % 50 = 0"), e, 16, 4), "distance")


@query("SELECT vec_id AS object_id, label, unnest(range(0, 64)) AS time, unnest(embedding) AS value FROM embeddings")
def arrays_to_series(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("object_id"), "label", F.col("embedding").alias("values"))
    return source.explode_arrays(e.withColumn("times", F.sequence(F.lit(0).cast("long"), F.size("values").cast("long") - 1)))


@query(f"SELECT o.object_id, o.n, {r('o.mean')} AS mean, m.redshift, m.ddf FROM (SELECT object_id, count(*) AS n, avg(value) AS mean FROM ({EV}) GROUP BY 1) o JOIN ({META_SQL}) m ON m.object_id::VARCHAR = o.object_id")
def metadata_appended(spark, d):
    f = workflow.profile(_ev(spark, d)).select("object_id", "n", "mean")
    m = metadata(spark, d).withColumn("object_id", F.col("object_id").cast("string"))
    return rounded(features.with_metadata(f, m, ["redshift", "ddf"]), "mean")


@query(f"SELECT label, {r('sum(count(*)) OVER () / count(*) OVER () / count(*)')} AS weight FROM ({META_SQL}) GROUP BY 1".replace("count(*) OVER ()", "(SELECT count(DISTINCT label) FROM (" + META_SQL + "))").replace("sum(count(*)) OVER ()", "(SELECT count(*) FROM (" + META_SQL + "))"))
def class_weights_flat(spark, d):
    return rounded(classify.class_weights(metadata(spark, d)), "weight")


@query(f"""WITH m AS ({META_SQL}), x AS (SELECT object_id, ddf, least(floor(10.0 * (ln(least(greatest(redshift + 0.01, 0.1), 3.0)) - ln(0.1::DOUBLE)) / (ln(3.0::DOUBLE) - ln(0.1::DOUBLE)))::BIGINT + 1, 10) AS bin FROM m)
SELECT object_id, {r('count(*) OVER (PARTITION BY ddf) / greatest(count(*) OVER (PARTITION BY ddf, bin), 100)')} AS weight FROM x""")
def redshift_weights(spark, d):
    return rounded(classify.redshift_weights(metadata(spark, d).withColumn("redshift", F.col("redshift") + 0.01)), "weight")


@query(None)
def gbt_classify(spark, d):
    from pyspark.ml.functions import array_to_vector

    e = table(spark, d, "embeddings").select("vec_id", F.col("label").cast("double").alias("label"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = classify.boosted_trees(e.where("vec_id % 5 <> 0"))
    return model.transform(e.where("vec_id % 5 = 0")).select("vec_id", "label", F.col("prediction").alias("pred"))


@query(None)
def lsa_svd(spark, d):
    bag, n = _counts(spark, d)
    return rounded(features.lsa(written(features.tfidf(bag, n)), 3)[0], "score")


@query(None)
def lsa_explained(spark, d):
    bag, n = _counts(spark, d)
    return rounded(features.explained(features.lsa(written(features.tfidf(bag, n)), 3)[0]), "variance", "cumulative", "normalised")


def _compact(spark, d, method: str) -> DataFrame:
    s = _li(spark, d)
    bag = written(words.feature_ids(words.bag(words.words(s, TWO)), TWO, 3))
    return compact.CompactModel.fit(bag, _labels(s), method, budget=6, n_bands=3).transform(bag)


@query(None)
def compact_lsa(spark, d):
    return _compact(spark, d, "LSA")


@query(f"""{_SC}, {_TOP.format(2)}, best AS (SELECT object_id, {_feature_sql(TWO, 3)} AS feature, tf FROM bag JOIN top USING (param_id, word)),
idf AS (SELECT feature, ln((1.0 + (SELECT count(DISTINCT object_id) FROM s)) / (1.0 + count(*))) + 1.0 AS idf FROM best GROUP BY 1), w AS (SELECT object_id, feature, (1.0 + ln(tf)) * idf AS w FROM best JOIN idf USING (feature))
SELECT object_id, feature, {r('w / sqrt(sum(w * w) OVER (PARTITION BY object_id))')} AS weight FROM w""")
def compact_manova(spark, d):
    return rounded(_compact(spark, d, "MANOVA"), "weight")


_OLDER_POINTS = [round(b, 9) for b in (-0.6744897501960817, 0.0, 0.6744897501960817)]


@query(f"""{_P}, x AS (SELECT *, min(tus) OVER ({sql.OWN}) AS t0, max(tus) OVER ({sql.OWN}) AS t1, max(i) OVER ({sql.OWN} ORDER BY tus RANGE BETWEEN CURRENT ROW AND {_W} FOLLOWING) + 1 AS ahead,
  min(i) OVER ({sql.OWN} ORDER BY tus RANGE BETWEEN {_W} PRECEDING AND CURRENT ROW) AS behind FROM p),
w AS (SELECT object_id, band, 0 AS dir, i, ahead AS j FROM x WHERE i < n - 1 AND tus + {_W} <= t1 AND ahead - i > 2 UNION ALL SELECT object_id, band, 1, behind, i FROM x WHERE i > 1 AND tus - {_W} >= t0 AND i - behind > 2),
m AS (SELECT object_id, band, avg(value) AS mu, stddev_pop(value) AS sigma FROM p GROUP BY 1, 2),
c AS (SELECT w.object_id, w.band, w.dir, CASE WHEN w.dir = 0 THEN w.i ELSE -w.j END AS pos, avg(p.value) AS v FROM w JOIN p ON p.object_id = w.object_id AND p.band = w.band AND p.i >= w.i AND p.i < w.j GROUP BY 1, 2, 3, 4),
z AS (SELECT c.*, round(CASE WHEN sigma > 0 THEN (v - mu) / sigma ELSE 0 END, 9) AS z FROM c JOIN m USING (object_id, band)),
u AS (SELECT object_id, band, dir, pos, ({' + '.join(f'({b} <= z)::INT' for b in _OLDER_POINTS)})::BIGINT AS word FROM z)
SELECT object_id, band, dir, pos, word FROM u QUALIFY word IS DISTINCT FROM lag(word) OVER ({sql.OWN} ORDER BY dir, pos)""")
def words_older(spark, d):
    return compact.older_words(_ev(spark, d), _W, 1, "mean")


# ---------------------------------------------------------------- folds, samples, augmentation

_M = f"m AS ({META_SQL})"
_FOLD = f"""WITH {_M}, base AS (SELECT object_id, label, (row_number() OVER (PARTITION BY label ORDER BY {sql.uniform('object_id')}, object_id) - 1) % 5 AS fold FROM m WHERE reference_object_id IS NULL),
fold AS (SELECT m.object_id, m.label, base.fold FROM m LEFT JOIN base ON base.object_id = coalesce(m.reference_object_id, m.object_id))"""


@query(f"{_FOLD} SELECT object_id, label, fold FROM fold")
def strat_folds(spark, d):
    return workflow.stratified_folds(metadata(spark, d)).withColumn("fold", F.col("fold").cast("long"))


@query(f"{_FOLD} SELECT object_id, label, 'train' AS part FROM fold WHERE fold <> 2 UNION ALL SELECT object_id, label, 'test' FROM fold WHERE fold = 2")
def fold_splits(spark, d):
    train, test = workflow.fold_split(workflow.stratified_folds(metadata(spark, d)), 2)
    return train.select("object_id", "label", F.lit("train").alias("part")).unionByName(test.select("object_id", "label", F.lit("test").alias("part")))


@query(f"""WITH {_M} SELECT object_id, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY {sql.uniform('object_id')}, object_id) <= floor(count(*) OVER (PARTITION BY label) * 0.7) THEN 'train' ELSE 'test' END AS part FROM m""")
def strat_train_test(spark, d):
    return workflow.train_test(metadata(spark, d), Decimal("0.7"))


@query(f"""WITH {_M} SELECT object_id, label FROM m QUALIFY row_number() OVER (PARTITION BY label ORDER BY {sql.uniform('object_id', seed=7)}, object_id) <= 10""")
def sample_per_class(spark, d):
    return workflow.sample_per_class(metadata(spark, d), 10, seed=7).select("object_id", "label")


_MD = f"WITH {_M}, x AS (SELECT m.*, coalesce(detections, 0) AS detections FROM m LEFT JOIN ({DETECT_SQL}) q USING (object_id))"


@query(f"""{_MD}, k AS (SELECT * FROM x WHERE reference_object_id IS NULL OR detections > 5) SELECT object_id, label, reference_object_id, detections FROM k
QUALIFY reference_object_id IS NULL OR row_number() OVER (PARTITION BY reference_object_id ORDER BY object_id) <= 1""")
def augment_cap_v1(spark, d):
    return workflow.cap_augmentations(metadata(spark, d), detections(spark, d), 5, 1).select("object_id", "label", "reference_object_id", "detections")


@query(f"""{_MD}, k AS (SELECT * FROM x WHERE detections > 2), o AS (SELECT * FROM k WHERE reference_object_id IS NULL), c AS (SELECT label, 150 // count(*) AS cap FROM o GROUP BY 1),
a AS (SELECT k.object_id, k.label, k.reference_object_id, row_number() OVER (PARTITION BY k.reference_object_id ORDER BY k.object_id) AS r FROM k WHERE k.reference_object_id IN (SELECT object_id FROM o))
SELECT object_id, label, reference_object_id FROM o UNION ALL SELECT object_id, a.label, reference_object_id FROM a JOIN c USING (label) WHERE r <= cap""")
def augment_cap_v3(spark, d):
    return workflow.cap_by_class(metadata(spark, d), detections(spark, d), 2, 150).select("object_id", "label", "reference_object_id")


@query(f"WITH {_M} SELECT object_id, label FROM m WHERE label <> 2 OR reference_object_id IS NULL OR {sql.uniform('object_id')} < exp(-redshift)")
def bias_filter(spark, d):
    return workflow.bias_filter(metadata(spark, d), biased=2).select("object_id", "label")


_ERF_X = "((abs(value) / 40.0 - 5.5) / 2)"
_ERF = f"(CASE WHEN {_ERF_X} = 0 THEN 0 ELSE sign({_ERF_X}) * 2 / sqrt(pi()) * exp(-{_ERF_X} * {_ERF_X}) * list_sum(list_transform(range(0, 90), lambda n: exp((2 * n + 1) * ln(abs({_ERF_X})) + 2 * n * ln(2.0::DOUBLE) + lgamma(n + 1) - lgamma(2 * n + 2)))) END)"


@query(f"""SELECT object_id, sum(({sql.uniform('object_id', 'ord')} < ({_ERF} + 1) / 2)::INT)::BIGINT AS detections, sum(({sql.uniform('object_id', 'ord')} < ({_ERF} + 1) / 2)::INT) >= 2 AS passes FROM ({EV}) GROUP BY 1""")
def erf_detection(spark, d):
    o = _ev(spark, d).withColumnRenamed("value", "flux").withColumn("flux_error", F.lit(40.0))
    return workflow.detection_filter(o)


# ---------------------------------------------------------------- search summaries

_RES = """res AS (SELECT ['Mm', 'Tr', 'MmMn', 'Mm-Tr', 'TrMm-Mn', 'Mm-Tr-Mn'][1 + l_partkey % 6] AS quantity, l_suppkey AS win, l_linenumber AS wl, max(l_discount * 5 + l_tax) AS cv_mean, max(l_quantity) > 20 AS valid_cv FROM lineitem GROUP BY 1, 2, 3)"""


def _results(spark, d) -> DataFrame:
    names = F.array(*(F.lit(x) for x in ("Mm", "Tr", "MmMn", "Mm-Tr", "TrMm-Mn", "Mm-Tr-Mn")))
    li = table(spark, d, "lineitem")
    return li.groupBy(F.get(names, (F.col("l_partkey") % 6).cast("int")).alias("quantity"), F.col("l_suppkey").alias("win"), F.col("l_linenumber").alias("wl")).agg(
        F.max(F.col("l_discount") * 5 + F.col("l_tax")).alias("cv_mean"), (F.max("l_quantity") > 20).alias("valid_cv")
    )


@query(f"WITH {_RES} SELECT quantity, win, wl, {r('cv_mean')} AS cv_mean FROM res WHERE valid_cv QUALIFY row_number() OVER (PARTITION BY quantity ORDER BY cv_mean DESC, win, wl) = 1")
def search_best_per_quantity(spark, d):
    return rounded(workflow.best_per_quantity(_results(spark, d)).select("quantity", "win", "wl", "cv_mean"), "cv_mean")


@query(f"""WITH {_RES}, b AS (SELECT *, len(string_split(quantity, '-')) AS count_qs FROM res WHERE valid_cv), c AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY count_qs ORDER BY cv_mean DESC, quantity, win, wl) = 1)
SELECT quantity, win, wl, {r('cv_mean')} AS cv_mean FROM c WHERE count_qs < (SELECT max(count_qs) FROM c)""")
def search_top1_combo(spark, d):
    return rounded(workflow.best_per_size(_results(spark, d)).select("quantity", "win", "wl", "cv_mean"), "cv_mean")


@query(f"WITH {_RES} SELECT quantity, win, wl, {r('cv_mean')} AS cv_mean FROM (SELECT *, max(cv_mean) OVER (PARTITION BY quantity) AS top FROM res) WHERE cv_mean = top")
def group_max_ties(spark, d):
    return rounded(workflow.group_max(_results(spark, d), "quantity", "cv_mean"), "cv_mean").select("quantity", "win", "wl", "cv_mean")


@query(f"WITH {_RES} SELECT quantity, win, wl, {r('cv_mean')} AS cv_mean FROM res WHERE valid_cv ORDER BY res.cv_mean DESC, quantity, win, wl LIMIT 4")
def top_k_rank(spark, d):
    return rounded(_results(spark, d).where("valid_cv").orderBy(F.desc("cv_mean"), "quantity", "win", "wl").limit(4).select("quantity", "win", "wl", "cv_mean"), "cv_mean")


@query(f"WITH {_RES} SELECT quantity, wl, (4 ** (wl * len(string_split(quantity, '-'))))::DOUBLE AS features, count(*) AS n FROM res GROUP BY 1, 2")
def search_complexity(spark, d):
    x = F.col("wl") * F.size(F.split("quantity", "-"))
    return _results(spark, d).groupBy("quantity", "wl").agg(F.count(F.lit(1)).alias("n")).select("quantity", "wl", F.pow(F.lit(4.0), x).alias("features"), "n")


@query(f"WITH {_RES}, b AS (SELECT * FROM res QUALIFY row_number() OVER (PARTITION BY wl ORDER BY cv_mean DESC, win) = 1) SELECT wl, win, {r('cv_mean')} AS score, cv_mean = max(cv_mean) OVER () AS top FROM b")
def increments_per_word_length(spark, d):
    results = _results(spark, d).groupBy("wl", "win").agg(F.max("cv_mean").alias("cv_mean"))
    return rounded(workflow.best_increments(results), "score")


_N1, _N2 = 60, 30


@query(f"""WITH {_M}, d AS (SELECT object_id, label FROM m QUALIFY row_number() OVER (PARTITION BY label ORDER BY {sql.uniform('object_id')}, object_id) <= floor(count(*) OVER (PARTITION BY label) * ({_N1 + _N2} / (SELECT count(*) FROM m)::DOUBLE)))
SELECT object_id, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY {sql.uniform('object_id', seed=2)}, object_id) <= floor(count(*) OVER (PARTITION BY label) * {_N1 / (_N1 + _N2)!r}::DOUBLE) THEN 'train' ELSE 'test' END AS part FROM d""")
def two_stage_split(spark, d):
    return workflow.two_stage_split(metadata(spark, d), _N1, _N2)


@query(f"""{_MD}, o AS (SELECT object_id, label, row_number() OVER (PARTITION BY label ORDER BY {sql.uniform('object_id')}, object_id) AS place, count(*) OVER (PARTITION BY label) AS n FROM x WHERE detections > 5 AND reference_object_id IS NULL)
SELECT object_id, label, size FROM o, (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (1.0::DOUBLE)) z(size) WHERE place <= floor(n * size)""")
def generated_training_sets(spark, d):
    return workflow.generated_sets(metadata(spark, d), detections(spark, d), 5, [0.25, 0.5, 1.0])


_SINGLES = ("mean", "trend", "var", "min_max", "min", "max")


def _folds(s: DataFrame, k: int = 5) -> DataFrame:
    return workflow.stratified_folds(_labels(s).withColumn("reference_object_id", F.lit(None).cast("string")), k)


_GRID = search.grid([(q,) for q in _SINGLES], [5.0, SHORT], [1, 2])
_SIDE = search.grid([("min_max",), ("max", "count")], [5.0, SHORT], [1, 2])
_PLACES = list(dict.fromkeys((p.days, p.word_length) for p in _SIDE))
_CODES_SQL = ", ".join(f"({i}, '{config.code_of([list(p.quantities)])}', {p.days}::DOUBLE, {p.word_length})" for i, p in enumerate(_GRID))
_PLACES_SQL = ", ".join(f"({i}, {w}::DOUBLE, {wl})" for i, (w, wl) in enumerate(_PLACES))
_PLACE_OF = "CASE param_id " + " ".join(f"WHEN {i} THEN {_PLACES.index((p.days, p.word_length))}" for i, p in enumerate(_SIDE)) + " END"


@query(f"""{sql.cross_validated(sql.words(EV, _GRID), 'param_id', 5)} SELECT g.id AS param_id, quantity, win, wl, 4 AS alpha, dropped, dropped <= 0.05 * n AS valid_cv, {r('cv_mean')} AS cv_mean, {r('cv_std')} AS cv_std
FROM (VALUES {_CODES_SQL}) g(id, quantity, win, wl) JOIN cvm ON cvm.place = g.id""")
def search_grid_cv(spark, d):
    s = _ev(spark, d)
    return rounded(search.grid_search(s, _folds(s), _GRID, 5), "cv_mean", "cv_std")


@query(f"""{sql.cross_validated(sql.words(EV, _SIDE), _PLACE_OF, 5)} SELECT win, wl, dropped, dropped <= 0.05 * n AS valid_cv, {r('cv_mean')} AS cv_mean, {r('cv_std')} AS cv_std FROM (VALUES {_PLACES_SQL}) g(id, win, wl) JOIN cvm ON cvm.place = g.id""")
def search_resolutions(spark, d):
    s = _ev(spark, d)
    return rounded(search.resolution_scores(s, _folds(s), [("min_max",), ("max", "count")], [5.0, SHORT], [1, 2], 5), "cv_mean", "cv_std")


@query(None)
def search_stack(spark, d):
    s = _ev(spark, d)
    found = search.stack_search(s, _folds(s), search.grid([("min_max",)], [5.0, SHORT, 15.0], [1]), 5, top_k=1)
    return spark.createDataFrame([(" ".join(f"{p.days}:{p.word_length}" for p in stack), round(score, 6)) for stack, score in found], "stack string, cv_mean double")


@query(None)
def search_first_additions(spark, d):
    s = _ev(spark, d)
    return rounded(search.first_additions(s, _folds(s), search.grid([("min_max",)], [5.0, SHORT, 15.0], [1]), 5, top_k=1), "cv_mean", "rise")


def _cv(spark, d, method: str) -> DataFrame:
    s = _li(spark, d)
    bag = words.feature_ids(words.bag(words.words(s, TWO)), TWO, 3)
    return rounded(search.cv_pipeline(bag, _folds(s, 3), 3, method, budget=6, n_bands=3), "balanced_accuracy")


@query(None)
def cv_pipeline_lsa(spark, d):
    return _cv(spark, d, "LSA")


@query(None)
def cv_pipeline_manova(spark, d):
    return _cv(spark, d, "MANOVA")


# ---------------------------------------------------------------- time aggregation, warping


@query(f"""WITH s AS ({EV}), x AS (SELECT *, tus - min(tus) OVER ({sql.OWN}) AS rel FROM s), b AS (SELECT object_id, band, rel // {3 * DAY} AS bucket, count(*) AS n, avg(value) AS mean, CASE WHEN max(rel) > min(rel) THEN regr_slope(value, rel / 86400000000.0) ELSE 0 END AS slope FROM x GROUP BY 1, 2, 3),
l AS (SELECT object_id, band, max(rel) AS last FROM x GROUP BY 1, 2), e AS (SELECT object_id, band, unnest(range(0, ((last - 1) // {3 * DAY} + 1)::BIGINT)) AS bucket FROM l WHERE last > 0)
SELECT e.object_id, e.band, e.bucket, coalesce(n, 0) AS n, {r('mean')} AS mean, {r('slope')} AS slope FROM e LEFT JOIN b USING (object_id, band, bucket)""")
def tumbling_time_agg(spark, d):
    return rounded(sliders.tumbling_time(_ev(spark, d), 3 * DAY), "mean", "slope")


@query(f"""WITH RECURSIVE {sql.indexed(EV)}, o AS (SELECT object_id, band, i, n, tus, value, tus AS open FROM p WHERE i = 0 AND n > 1
  UNION ALL SELECT p.object_id, p.band, p.i, p.n, p.tus, p.value, CASE WHEN p.tus > o.open + {3 * DAY} THEN p.tus ELSE o.open END FROM o JOIN p ON p.object_id = o.object_id AND p.band = o.band AND p.i = o.i + 1 WHERE p.i < p.n - 1),
z AS (SELECT *, min(tus) OVER ({sql.OWN}) AS zero FROM o)
SELECT object_id, band, open - zero AS start, count(*) AS n, {r('avg(value)')} AS mean, {r('coalesce(regr_slope(value, (tus - zero) / 86400000000.0), 0)')} AS slope FROM z GROUP BY 1, 2, 3 HAVING count(*) >= 2""")
def tumbling_obs_agg(spark, d):
    return rounded(sliders.tumbling_observed(_ev(spark, d), 3 * DAY), "mean", "slope")


_GAP = 5 * DAY


@query(f"""WITH s AS ({EV}), x AS (SELECT *, min(tus) OVER ({sql.OWN}) AS zero, lead(tus) OVER ({sql.OWN} ORDER BY tus, ord) AS t2, lead(value) OVER ({sql.OWN} ORDER BY tus, ord) AS v2 FROM s),
g AS (SELECT *, unnest(range((tus - zero) // {_GAP} + 1, (t2 - zero) // {_GAP})) AS k FROM x WHERE t2 IS NOT NULL), h AS (SELECT *, zero + ((k + part) * {_GAP})::BIGINT AS made FROM g, (VALUES (0.0::DOUBLE), (0.5::DOUBLE), (1.0::DOUBLE)) y(part))
SELECT object_id, band, tus, {r('value')} AS value, false AS interpolated FROM s UNION ALL SELECT object_id, band, made, {r('value + (v2 - value) * (made - tus) / (t2 - tus)')}, true FROM h""")
def interpolated_gaps(spark, d):
    return rounded(sliders.interpolate_gaps(_ev(spark, d), _GAP), "value")


@query(f"""WITH RECURSIVE s AS ({EV}), v AS (SELECT object_id, band, list(value ORDER BY tus, ord) AS x FROM s GROUP BY 1, 2),
{sql.warped("SELECT a.object_id AS a, b.object_id AS b, a.band, list_transform(a.x, lambda z: [z]) AS p, list_transform(b.x, lambda z: [z]) AS q FROM v a JOIN v b ON a.band = b.band WHERE a.object_id::BIGINT % 50 = 0", 1)}
SELECT a, b, {r('sum(distance)')} AS distance FROM warped GROUP BY 1, 2""")
def dtw_distance(spark, d):
    s = dtw.sequences(_ev(spark, d))
    return rounded(dtw.distance_matrix(s.where("cast(object_id as long) % 50 = 0"), s), "distance")


@query(f"""WITH RECURSIVE s AS ({EV}), y AS (SELECT *, tus - min(tus) OVER ({sql.OWN}) AS rel FROM s),
l AS (SELECT object_id, band, max(rel) AS last FROM y GROUP BY 1, 2),
g AS (SELECT object_id, band, rel // {3 * DAY} AS bucket, avg(value) AS mean, coalesce(CASE WHEN max(rel) > min(rel) THEN regr_slope(value, rel / 86400000000.0) ELSE 0 END, 0) AS slope FROM y GROUP BY 1, 2, 3),
v AS (SELECT object_id, band, list([slope, mean] ORDER BY bucket) AS x FROM g JOIN l USING (object_id, band) WHERE bucket <= (last - 1) // {3 * DAY} AND last > 0 GROUP BY 1, 2),
{sql.warped("SELECT a.object_id AS a, b.object_id AS b, a.band, a.x AS p, b.x AS q FROM v a JOIN v b ON a.band = b.band WHERE a.object_id::BIGINT % 50 = 0", 2)}
SELECT a AS object_id, b AS other, band, {r('distance', 4)} AS distance FROM warped""")
def irregular_dtw(spark, d):
    t = sliders.tumbling_time(_ev(spark, d), 3 * DAY)
    seg = F.when(F.col("n") > 0, F.struct("slope", "mean"))
    a = t.groupBy("object_id", "band").agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", seg.alias("s")))), lambda x: x["s"]).alias("values"))
    a = written(a)  # that both sides, and the count of queries, read
    found = dtw.every_distance(a.where("cast(object_id as long) % 50 = 0"), a, digits=4)
    return found.select(F.col("a").alias("object_id"), F.col("b").alias("other"), "band", "distance")
