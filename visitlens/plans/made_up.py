"""Made-up workers from the baseline: bad ones, subtle ones, and ones that copy a few visits over and over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from visitlens.operators.ranks import numbered
from visitlens.registry import query
from visitlens.sources.views import answers, visits, with_views

BLANK = "__BLANK__"
#: How often a worker gives its one answer, and what is added to the shares of that and of the blank answer (fixed values).
MODES = {"bad": (0.95, 0.8, 0.5), "subtle": (0.70, 0.20, 0.10)}
CATEGORIES = ("gender", "unwell", "muac_colour", "glasses")
#: Start, size and number of the bins of fields that are numbers.
NUMBERS = {"age_months": (0.0, 12.0, 5), "measured_cm": (9.5, 1.0, 12)}
VISITS, TEMPLATES, COPIES, APART = 30, 10, 10, 1.8


def draw(*parts: Column) -> Column:
    """A number from 0 to under 1 that depends on the parts alone, so on no partition."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("double") / 2.0**32


def draw_sql(*parts: str) -> str:
    return f"(CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


_KEYS = {f: f"COALESCE(NULLIF({f}, ''), '{BLANK}')" for f in CATEGORIES}
_BINS = {f: f"CASE WHEN {f} >= {a}{{d}} AND {f} <= {a + s * n}{{d}} THEN lpad(CAST(CAST(least(floor(({f} - {a}{{d}}) / {s}{{d}}), {n - 1}) AS INT) AS {{text}}), 2, '0') END" for f, (a, s, n) in NUMBERS.items()}
_FROM = {f: f"{a}{{d}} + {s}{{d}} * (CAST(value AS INT) + {{u}})" for f, (a, s, _) in NUMBERS.items()}


def baseline_steps(v: DataFrame) -> DataFrame:
    """(mode, often, field, target, steps): each field's answers as steps from 0 to 1, wide as their shares of the baseline with the
    mode's additions; the target is the rarest answer for bad workers and the commonest for subtle ones."""
    keys = {f: F.expr(k) for f, k in _KEYS.items()} | {f: F.expr(k.format(d="D", text="STRING")) for f, k in _BINS.items()}
    n = v.select(F.inline(F.array(*(F.struct(F.lit(f).alias("field"), k.alias("value")) for f, k in keys.items())))).where("value IS NOT NULL").groupBy("field", "value").agg(F.count("*").alias("n"))
    field = Window.partitionBy("field")  # a field's answers are few
    modes = F.array(*(F.struct(F.lit(m).alias("mode"), F.lit(o).alias("often"), F.lit(t).alias("more"), F.lit(b).alias("blank")) for m, (o, t, b) in MODES.items()))
    shares = n.select("*", (F.col("n") / F.sum("n").over(field)).alias("share")).select("*", F.inline(modes))
    rare, common = F.min_by("value", F.struct("n", "value")), F.min_by("value", F.struct(-F.col("n"), "value"))
    targets = n.groupBy("field").agg(rare.alias("rare"), common.alias("common"))
    own = F.when(F.col("mode") == "bad", F.col("rare")).otherwise(F.col("common"))
    p = shares.join(targets, "field").withColumn("target", own)
    p = p.withColumn("p", F.col("share") + F.when(F.col("value") == F.col("target"), F.col("more")).otherwise(0.0) + F.when(F.col("value") == BLANK, F.col("blank")).otherwise(0.0))
    upto, every = Window.partitionBy("mode", "field").orderBy("value").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("mode", "field")
    p = p.withColumns({"hi": F.sum("p").over(upto), "total": F.sum("p").over(every)})
    return p.groupBy("mode", "often", "field", "target").agg(F.array_sort(F.collect_list(F.struct((F.col("hi") / F.col("total")).alias("hi"), "value"))).alias("steps"))


_DRAWN = [draw_sql("mode", "field", "flw_id", "visit", f"'{k}'") for k in "abc"]
_LONG_SQL = " UNION ALL ".join(f"SELECT '{f}' AS field, {k.format(d='::DOUBLE', text='VARCHAR')} AS value FROM answers" for f, k in {**_KEYS, **_BINS}.items())
_MODES_SQL = ", ".join(f"('{m}', {o}::DOUBLE, {t}::DOUBLE, {b}::DOUBLE)" for m, (o, t, b) in MODES.items())


@query("ml_synthetic_bad_subtle", with_views(f"""n AS (SELECT field, value, COUNT(*) AS n FROM ({_LONG_SQL}) WHERE value IS NOT NULL GROUP BY ALL),
g AS (SELECT field, arg_min(value, row(n, value)) AS rare, arg_min(value, row(-n, value)) AS common FROM n GROUP BY field),
p AS (SELECT mode, often, n.field, value, CASE WHEN mode = 'bad' THEN rare ELSE common END AS target,
    n / SUM(n) OVER (PARTITION BY mode, n.field)::DOUBLE + CASE WHEN value = CASE WHEN mode = 'bad' THEN rare ELSE common END THEN more ELSE 0 END + CASE WHEN value = '{BLANK}' THEN blank ELSE 0 END AS p
  FROM n JOIN g ON g.field = n.field, (VALUES {_MODES_SQL}) m(mode, often, more, blank)),
s AS (SELECT *, SUM(p) OVER (PARTITION BY mode, field ORDER BY value) / SUM(p) OVER (PARTITION BY mode, field) AS hi FROM p),
w AS (SELECT DISTINCT flw_id FROM answers), r AS (SELECT range AS visit FROM range({VISITS})),
f AS (SELECT DISTINCT mode, field, often, target FROM p),
x AS (SELECT f.*, flw_id, visit, {", ".join(f"{x} AS u{k}" for k, x in enumerate(_DRAWN))} FROM f, w, r),
y AS (SELECT x.mode, x.field, flw_id, visit, u2, CASE WHEN u0 < x.often THEN x.target ELSE (SELECT min(value) FROM s WHERE s.mode = x.mode AND s.field = x.field AND s.hi > u1) END AS value FROM x)
SELECT mode, concat('SYN', upper(left(mode, 1)), '_', flw_id) AS worker, visit, field, CASE WHEN value = '{BLANK}' THEN NULL """ + " ".join(f"WHEN field = '{f}' THEN CAST(ROUND({e.format(d='::DOUBLE', u='u2')}, 2) AS VARCHAR)" for f, e in _FROM.items()) + " ELSE value END AS value FROM y"))
def synthetic_bad_subtle(spark: SparkSession, d: str) -> DataFrame:
    """Two made-up workers for each real one, thirty visits each: a bad one, who gives the rarest answers, and a subtle one, who gives
    the commonest; otherwise answers are drawn from the baseline's shares, with blanks more often. The draws depend on names alone."""
    v = answers(spark, d)
    steps = baseline_steps(v)
    workers = v.select("flw_id").distinct().select("flw_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(VISITS - 1).cast("bigint"))).alias("visit"))
    every = F.broadcast(steps.agg(F.collect_list(F.struct(*steps.columns)).alias("every")))  # an entry for each field and mode
    x = workers.join(every).select("flw_id", "visit", F.inline("every"))
    u = [draw(F.col("mode"), F.col("field"), F.col("flw_id").cast("string"), F.col("visit").cast("string"), F.lit(k)) for k in "abc"]
    x = x.select("mode", "often", "field", "target", "steps", "flw_id", "visit", *(c.alias(f"u{k}") for k, c in enumerate(u)))
    drawn = F.get(F.filter("steps", lambda s: s["hi"] > F.col("u1")), F.lit(0))["value"]
    x = x.withColumn("value", F.when(F.col("u0") < F.col("often"), F.col("target")).otherwise(drawn))
    value = F.when(F.col("value") == BLANK, None)
    for f, (a, s, _) in NUMBERS.items():
        value = value.when(F.col("field") == f, F.round(a + s * (F.expr("TRY_CAST(value AS INT)") + F.col("u2")), 2).cast("string"))
    name = F.concat(F.lit("SYN"), F.upper(F.substring("mode", 1, 1)), F.lit("_"), "flw_id")
    return x.select("mode", name.alias("worker"), "visit", "field", value.otherwise(F.col("value")).alias("value"))


_PICK = draw_sql("'copy'", "flw_id", "template")


@query("ml_synthetic_duplicators", with_views(f"""n AS (SELECT *, ROW_NUMBER() OVER (ORDER BY visit_id) - 1 AS place, COUNT(*) OVER () AS every, MAX(visit_date) OVER () AS last FROM visits),
w AS (SELECT DISTINCT flw_id FROM visits), p AS (SELECT flw_id, t.range AS template, c.range AS copy FROM w, range({TEMPLATES}) t, range({COPIES}) c)
SELECT concat('SYNDUP_', p.flw_id) AS worker, p.flw_id * {TEMPLATES * COPIES} + template * {COPIES} + copy AS visit_number, n.visit_id AS original, n.case_id, n.gender, n.muac_cm,
  date_diff('day', CAST(last AS DATE), CAST(last - INTERVAL 180 DAY + to_seconds((template * {COPIES} + copy) * {int(APART * 86400)}) AS DATE)) AS days_from_last
FROM p JOIN n ON n.place = CAST(FLOOR({_PICK.replace("flw_id", "p.flw_id")} * n.every) AS BIGINT)"""))
def synthetic_duplicators(spark: SparkSession, d: str) -> DataFrame:
    """A made-up worker for each real one, who hands in ten copies of each of ten visits of anybody's, drawn with replacement: the
    visits are numbered across tasks, and a draw meets its visit by that number."""
    v = numbered(visits(spark, d).select("visit_id", "flw_id", "case_id", "gender", "muac_cm", "visit_date"), ["visit_id"])
    size = F.broadcast(v.agg(F.count("*").alias("every"), F.max("visit_date").alias("last")))
    t = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(TEMPLATES - 1).cast("bigint"))).alias("template")
    picks = v.select("flw_id").distinct().select("flw_id", t).join(size)
    u = draw(F.lit("copy"), F.col("flw_id").cast("string"), F.col("template").cast("string"))
    picks = picks.select(F.col("flw_id").alias("copier"), "template", "last", F.floor(u * F.col("every")).alias("place"))
    c = picks.join(v, "place").select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(COPIES - 1).cast("bigint"))).alias("copy"))
    number = F.col("template") * COPIES + F.col("copy")
    at = F.col("last") - F.expr("INTERVAL 180 DAYS") + F.make_dt_interval(secs=number * int(APART * 86400))
    return c.select(
        F.concat(F.lit("SYNDUP_"), "copier").alias("worker"), (F.col("copier") * (TEMPLATES * COPIES) + number).alias("visit_number"), F.col("visit_id").alias("original"), "case_id", "gender", "muac_cm",
        F.datediff(at.cast("date"), F.col("last").cast("date")).cast("bigint").alias("days_from_last"),
    )
