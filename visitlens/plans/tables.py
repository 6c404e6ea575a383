"""Wide tables of cases, baselines of survey fields, and fields beside the fraud score."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from visitlens.functions.columns import haversine_km, right_closed_bin
from visitlens.operators.ranks import counted_percentiles
from visitlens.plans.fraud import composite_fraud_score
from visitlens.plans.fraud import _composite_sql as composite_sql
from visitlens.plans.grid import VISIT_CELLS_SQL, visit_cells
from visitlens.plans.ordered import BY_TIME, HAVERSINE_SQL
from visitlens.registry import query
from visitlens.sources.views import answers, cells, visits, with_views

#: What is shown of a visit: a weight where there is one, else a cross.
_SHOWN = "CASE WHEN visit_id % 3 <> 0 THEN CAST(CAST(k AS BIGINT) AS {text}) ELSE 'X' END"
_MODES = ("opportunity_name", "flw_name", "status", "event_type")
_STEPS = HAVERSINE_SQL.format(a="lat0", b="latitude", c="lon0", d="longitude")


@query("aggr_case_visit_table", with_views(f"""v AS (SELECT *, {_SHOWN.format(text="VARCHAR")} AS shown, ROW_NUMBER() OVER w AS i, LAG(latitude) OVER w AS lat0, LAG(longitude) OVER w AS lon0
  FROM visits WHERE latitude IS NOT NULL AND longitude IS NOT NULL WINDOW w AS (PARTITION BY case_id ORDER BY visit_date, visit_id)),
d AS (SELECT case_id, visit_day, string_agg(shown, ', ' ORDER BY i) AS shown FROM v GROUP BY ALL),
t AS (SELECT case_id, COUNT(*) AS days, string_agg(visit_day || ': ' || shown, '; ' ORDER BY visit_day) AS timeline FROM d GROUP BY case_id),
m AS (SELECT case_id, """ + ", ".join(f"(SELECT arg_min({c}, row(-n, {c})) FROM (SELECT {c}, COUNT(*) AS n FROM v y WHERE y.case_id = z.case_id AND {c} IS NOT NULL GROUP BY {c})) AS {c}" for c in _MODES) + f""" FROM (SELECT DISTINCT case_id FROM v) z),
s AS (SELECT case_id, COUNT(*) AS total_visits, arg_min(visit_id, i) AS first_visit, arg_min(latitude, i) AS latitude, arg_min(longitude, i) AS longitude,
  COALESCE(string_agg((i - 1) || '-' || i || ': ' || CAST(CAST(ROUND({_STEPS}, 2) AS DECIMAL(12, 2)) AS VARCHAR) || ' km', '; ' ORDER BY i) FILTER (WHERE i > 1), '') AS distances FROM v GROUP BY case_id)
SELECT s.*, days, timeline, {", ".join(_MODES)} FROM s JOIN t ON t.case_id = s.case_id JOIN m ON m.case_id = s.case_id"""))
def case_visit_table(spark: SparkSession, d: str) -> DataFrame:
    """A row for each case: its commonest names (the least of equals), its first place, what was weighed on each day that it was
    visited, and the way between its visits. Days without visits are left out instead of being columns, so that no date is part of
    the schema."""
    w = Window.partitionBy("case_id").orderBy(*BY_TIME)
    v = visits(spark, d).where("latitude IS NOT NULL AND longitude IS NOT NULL").withColumns({
        "shown": F.expr(_SHOWN.format(text="STRING")), "i": F.row_number().over(w), "km": haversine_km(F.lag("latitude").over(w), F.lag("longitude").over(w), F.col("latitude"), F.col("longitude")),
    })
    listed = lambda order, text, sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text.alias("t")))), lambda x: x["t"]), sep)
    days = v.groupBy("case_id", "visit_day").agg(listed("i", F.col("shown"), ", ").alias("shown"))
    days = days.groupBy("case_id").agg(F.count("*").alias("days"), listed("visit_day", F.concat(F.col("visit_day").cast("string"), F.lit(": "), "shown"), "; ").alias("timeline"))
    step = F.when(F.col("i") > 1, F.concat((F.col("i") - 1).cast("string"), F.lit("-"), F.col("i").cast("string"), F.lit(": "), F.round("km", 2).cast("decimal(12,2)").cast("string"), F.lit(" km")))
    ways = F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("i", step.alias("t")))), lambda x: x["t"].isNotNull()), lambda x: x["t"]), "; ")
    first = lambda c: F.min_by(c, "i").alias(c)
    s = v.groupBy("case_id").agg(F.count("*").alias("total_visits"), F.min_by("visit_id", "i").alias("first_visit"), first("latitude"), first("longitude"), ways.alias("distances"), *(F.mode(c, True).alias(c) for c in _MODES))
    return s.join(days, "case_id")


#: Least number of answers, most categories (fixed values); fields with blanks as a category, without them, and of numbers in bins.
RESPONSES, MOST_CATEGORIES, BLANK = 50, 20, "__BLANK__"
_WITH_BLANKS, _WITHOUT = ("gender", "unwell", "muac_colour", "glasses"), ("opportunity_name", "event_type", "case_id", "diligence_2")
_BINNED = {"age_months": (0.0, 6.0), "measured_cm": (8.5, 1.0)}
_FIELDS = {c: f"COALESCE(NULLIF({c}, ''), '{BLANK}')" for c in _WITH_BLANKS} | {c: f"CAST({c} AS {{text}})" for c in _WITHOUT}
_FIELDS_SQL = " UNION ALL ".join(f"SELECT '{c}' AS field, {e.format(text='VARCHAR')} AS category FROM answers" for c, e in _FIELDS.items())
_BINNED_SQL = " UNION ALL ".join(f"SELECT '{c}' AS field, {c}::DOUBLE AS x, CAST(GREATEST(CEIL(({c} - {a}::DOUBLE) / {s}::DOUBLE) - 1, 0) AS INT) AS bin, {a}::DOUBLE AS a, {s}::DOUBLE AS s FROM answers" for c, (a, s) in _BINNED.items())
_QUARTERS = (0.25, 0.5, 0.75)


@query("aggr_baseline_fields", with_views(f"""l AS ({_FIELDS_SQL}), n AS (SELECT field, category, COUNT(*) AS n FROM l WHERE category IS NOT NULL GROUP BY ALL),
k AS (SELECT *, SUM(n) OVER (PARTITION BY field) AS total, COUNT(*) OVER (PARTITION BY field) AS kinds FROM n),
x AS (SELECT * FROM ({_BINNED_SQL}) WHERE x IS NOT NULL),
y AS (SELECT field, COUNT(*) AS total, AVG(x) AS mean, stddev_pop(x) AS sd, {", ".join(f"quantile_cont(x, {q}) AS q{int(100 * q)}" for q in _QUARTERS)} FROM x GROUP BY field),
b AS (SELECT field, bin, ANY_VALUE(a) AS a, ANY_VALUE(s) AS s, COUNT(*) AS n FROM x GROUP BY field, bin)
SELECT field, 'categorical' AS kind, category, NULL::DOUBLE AS low, NULL::DOUBLE AS high, n, ROUND(n * 1.0 / total, 8) AS proportion, CAST(total AS BIGINT) AS responses, NULL::DOUBLE AS mean, NULL::DOUBLE AS std, NULL::DOUBLE AS q25, NULL::DOUBLE AS q50, NULL::DOUBLE AS q75
FROM k WHERE total >= {RESPONSES} AND kinds <= {MOST_CATEGORIES}
UNION ALL SELECT b.field, 'binned', NULL, a + bin * s, a + (bin + 1) * s, n, ROUND(n * 1.0 / total, 8), total, ROUND(mean, 6), ROUND(sd, 6), ROUND(q25, 6), ROUND(q50, 6), ROUND(q75, 6) FROM b JOIN y ON y.field = b.field WHERE total >= {RESPONSES}"""))
def baseline_fields(spark: SparkSession, d: str) -> DataFrame:
    """Counts and shares of the answers of every field with enough of them and few categories, and of the bins of numbers (right-closed,
    the first on both sides) beside their mean, deviation and quartiles."""
    v = answers(spark, d)
    pairs = F.array(*(F.struct(F.lit(c).alias("field"), F.expr(e.format(text="STRING")).alias("category")) for c, e in _FIELDS.items()))
    n = v.select(F.inline(pairs)).where("category IS NOT NULL").groupBy("field", "category").agg(F.count("*").alias("n"))
    sums = n.groupBy("field").agg(F.sum("n").alias("responses"), F.count("*").alias("kinds")).where((F.col("responses") >= RESPONSES) & (F.col("kinds") <= MOST_CATEGORIES))
    none = F.lit(None).cast("double")
    numbers = ("mean", "std", "q25", "q50", "q75")
    text = n.join(sums, "field").select("field", F.lit("categorical").alias("kind"), "category", none.alias("low"), none.alias("high"), "n", F.round(F.col("n") / F.col("responses"), 8).alias("proportion"), "responses", *(none.alias(c) for c in numbers))
    values = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("x"), right_closed_bin(c, a, s).alias("bin"), F.lit(a).alias("a"), F.lit(s).alias("s")) for c, (a, s) in _BINNED.items()))
    x = v.select(F.inline(values)).where("x IS NOT NULL")
    y = x.groupBy("field").agg(F.count("*").alias("responses"), F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_pop("x"), 6).alias("std")).where(F.col("responses") >= RESPONSES)
    q = counted_percentiles(x, "field", "x", list(_QUARTERS), "q").select("field", *(F.round(F.col("q")[i], 6).alias(f"q{int(100 * p)}") for i, p in enumerate(_QUARTERS)))
    bins = x.groupBy("field", "bin", "a", "s").agg(F.count("*").alias("n")).join(y, "field").join(q, "field")
    low = F.col("a") + F.col("bin") * F.col("s")
    binned = bins.select("field", F.lit("binned").alias("kind"), F.lit(None).cast("string").alias("category"), low.alias("low"), (F.col("a") + (F.col("bin") + 1) * F.col("s")).alias("high"), "n", F.round(F.col("n") / F.col("responses"), 8).alias("proportion"), "responses", *numbers)
    return text.unionByName(binned)


@query("aggr_field_fraud_distribution", with_views(composite_sql() + """,
scored AS (SELECT flw_id, ROUND(x, 4) AS composite FROM z), means AS (SELECT flw_id, AVG(measured_cm) AS x FROM answers GROUP BY flw_id),
span AS (SELECT MIN(x) - 0.02 * (MAX(x) - MIN(x)) AS a, MAX(x) + 0.02 * (MAX(x) - MIN(x)) AS b FROM means)
SELECT CAST(GREATEST(CEIL((means.x - a) / ((b - a) / 50)) - 1, 0) AS INT) AS bin, COUNT(*) AS flws, ROUND(100.0 * COUNT(*) / SUM(COUNT(*)) OVER (), 6) AS pct, ROUND(quantile_cont(composite, 0.5), 6) AS median_fraud
FROM means JOIN scored ON scored.flw_id = means.flw_id, span GROUP BY 1"""))
def field_fraud_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Workers by the mean of a field in fifty equal bins over its range and two per cent more on either side, right-closed: their
    share, and the median of their fraud scores."""
    f = answers(spark, d).groupBy("flw_id").agg(F.avg("measured_cm").alias("x")).join(composite_fraud_score(spark, d).select("flw_id", "composite"), "flw_id")
    span = F.max("x") - F.min("x")
    r = F.broadcast(f.agg((F.min("x") - 0.02 * span).alias("a"), (F.max("x") + 0.02 * span).alias("b"), F.count("*").alias("every")))
    bin_ = F.greatest(F.ceil((F.col("x") - F.col("a")) / ((F.col("b") - F.col("a")) / 50)) - 1, F.lit(0)).cast("int")
    g = f.join(r).groupBy(bin_.alias("bin"))
    return g.agg(F.count("*").alias("flws"), F.round(100.0 * F.count("*") / F.first("every"), 6).alias("pct"), F.round(F.percentile("composite", 0.5), 6).alias("median_fraud"))


_TIMES = (2, 3)


def _children_sql(n: int) -> str:
    return f"""SELECT 'cell_{n}00m_' || prow || '_' || pcol AS cell_id, {n}00 AS resolution_m, prow AS row, pcol AS col, COALESCE(SUM(population), 0) AS population,
  ROUND(7.0::DOUBLE + (pcol + 0.5) * {n} * 0.002::DOUBLE, 7) AS center_longitude, ROUND(9.0::DOUBLE + (prow + 0.5) * {n} * 0.0025::DOUBLE, 7) AS center_latitude,
  string_agg('cell_100m_' || r || '_' || c, ';' ORDER BY r, c) AS child_100m_cell_ids, '[' || string_agg(CAST(CAST(COALESCE(population, 0) AS DECIMAL(20, 6)) AS VARCHAR), ',' ORDER BY r, c) || ']' AS child_100m_population_breakdown
FROM (SELECT prow, pcol, prow * {n} + dr.range AS r, pcol * {n} + dc.range AS c FROM (SELECT DISTINCT row // {n} AS prow, col // {n} AS pcol FROM vc), range({n}) dr, range({n}) dc) k
LEFT JOIN cells ON cells.row = r AND cells.col = c GROUP BY prow, pcol"""


@query("aggr_visited_parent_cells", with_views("vc AS (SELECT CAST(FLOOR((latitude - 9.0) / 0.0025) AS BIGINT) AS row, CAST(FLOOR((longitude - 7.0) / 0.002) AS BIGINT) AS col FROM visits) " + " UNION ALL ".join(_children_sql(n) for n in _TIMES)))
def visited_parent_cells(spark: SparkSession, d: str) -> DataFrame:
    """The cells of two and three hundred metres that visits are in: people of all their children in order of rows, nothing for those
    that the raster lacks, and their names."""
    v, c = visit_cells(visits(spark, d)), cells(spark, d).select("row", "col", "population")
    out = None
    for n in _TIMES:
        parents = v.select(F.expr(f"row div {n}").alias("prow"), F.expr(f"col div {n}").alias("pcol")).distinct()
        child = F.explode(F.array(*(F.struct((F.col("prow") * n + i).alias("row"), (F.col("pcol") * n + j).alias("col")) for i in range(n) for j in range(n)))).alias("c")
        own = parents.select("prow", "pcol", child).select("prow", "pcol", "c.*").join(c, ["row", "col"], "left").withColumn("population", F.coalesce("population", F.lit(0.0)))
        each = F.array_sort(F.collect_list(F.struct("row", "col", "population")))  # n times n of them
        g = own.groupBy("prow", "pcol").agg(F.sum("population").alias("population"), each.alias("each"))
        name = lambda x: F.concat(F.lit("cell_100m_"), x["row"], F.lit("_"), x["col"])
        people = lambda x: x["population"].cast("decimal(20,6)").cast("string")
        part = g.select(
            F.concat(F.lit(f"cell_{n}00m_"), "prow", F.lit("_"), "pcol").alias("cell_id"), F.lit(100 * n).alias("resolution_m"), F.col("prow").alias("row"), F.col("pcol").alias("col"), "population",
            F.round(7.0 + (F.col("pcol") + 0.5) * n * 0.002, 7).alias("center_longitude"), F.round(9.0 + (F.col("prow") + 0.5) * n * 0.0025, 7).alias("center_latitude"),
            F.array_join(F.transform("each", name), ";").alias("child_100m_cell_ids"), F.concat(F.lit("["), F.array_join(F.transform("each", people), ","), F.lit("]")).alias("child_100m_population_breakdown"),
        )
        out = part if out is None else out.unionByName(part)
    return out


_PERIODS = {"Monthly": ("strftime(visit_date, '%Y-%m')", "date_format(visit_date, 'yyyy-MM')"), "Quarterly": ("year(visit_date) || 'Q' || quarter(visit_date)", "concat(year(visit_date), 'Q', quarter(visit_date))")}


@query("aggr_grid_time_series", with_views(VISIT_CELLS_SQL + " " + " UNION ALL ".join(f"SELECT '{k}' AS aggregation, {sql} AS time_period, COUNT(*) AS total_visits, COUNT(DISTINCT opportunity_id) AS opportunities, COUNT(DISTINCT flw_id) AS flws FROM vc JOIN cells c ON c.row = vc.row AND c.col = vc.col GROUP BY 2" for k, (sql, _) in _PERIODS.items())))
def grid_time_series(spark: SparkSession, d: str) -> DataFrame:
    """Visits to peopled cells, opportunities and workers by month and by quarter, in one pass over the visits."""
    j = visit_cells(visits(spark, d)).join(cells(spark, d).select("row", "col"), ["row", "col"])
    periods = F.inline(F.array(*(F.struct(F.lit(k).alias("aggregation"), F.expr(e).alias("time_period")) for k, (_, e) in _PERIODS.items())))
    return j.select("opportunity_id", "flw_id", periods).groupBy("aggregation", "time_period").agg(F.count("*").alias("total_visits"), F.count_distinct("opportunity_id").alias("opportunities"), F.count_distinct("flw_id").alias("flws"))
