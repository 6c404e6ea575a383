"""Intake: pages of a query, flattened cases, files known by their names, villages and settlements, names matched by likeness."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from visitlens.plans.cleaning import token_sort_ratios
from visitlens.registry import query
from visitlens.sources.storage import saved, scratch, set_changed
from visitlens.sources.views import cells, table, visits, with_views


def read_pages(pages: DataFrame, fetch, size: int, schema: str) -> DataFrame:
    """The rows of a paged source: each task asks for the pages of its numbers (first, first + 1, ... first + step - 1) in
    turn and stops at a page that isn't full. fetch(offset, limit) gives a list of tuples; pages: (first, step)."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for first, step in zip(b["first"], b["step"], strict=True):
                for page in range(first, first + step):
                    rows = fetch(page * size, size)
                    if rows:
                        yield pd.DataFrame(rows, columns=names)
                    if len(rows) < size:
                        break

    return pages.select("first", "step").mapInPandas(run, schema)


@query("src_paged_pull", "SELECT range AS id, range * 7 % 101 AS value FROM range(12345)")
def paged_pull(spark: SparkSession, d: str) -> DataFrame:
    """Pages of a source that ends within one, pulled by several tasks; here the source is a function of the row number."""
    total = 12_345

    def fetch(offset: int, limit: int) -> list[tuple[int, int]]:
        return [(i, i * 7 % 101) for i in range(offset, min(total, offset + limit))]

    starts = spark.range(0, 16, 4, 4).select(F.col("id").alias("first"), F.lit(4).cast("bigint").alias("step"))
    return read_pages(starts, fetch, 1000, "id bigint, value bigint")


@query("src_case_flatten", "SELECT c_custkey AS case_id, c_name AS name, CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE c_nationkey END AS buildings, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE round(c_acctbal, 2) END AS surface_area, 'owner_' || c_nationkey AS owner_id, c_custkey % 3 = 0 AS closed FROM customer")
def case_flatten(spark: SparkSession, d: str) -> DataFrame:
    """Cases as a service returns them: an envelope around named properties, all text; numbers that can't be read become zero."""
    c = table(spark, d, "customer")
    text = lambda bad, x: F.when(bad, F.lit("unknown")).otherwise(x.cast("string"))
    properties = F.struct(F.col("c_name").alias("name"), text(F.col("c_custkey") % 7 == 0, F.col("c_nationkey")).alias("buildings"), text(F.col("c_custkey") % 5 == 0, F.round("c_acctbal", 2)).alias("surface_area"))
    envelope = F.struct(F.col("c_custkey").cast("string").alias("case_id"), properties.alias("properties"), F.concat(F.lit("owner_"), "c_nationkey").alias("owner_id"), (F.col("c_custkey") % 3 == 0).alias("closed"))
    path = scratch(spark, "cases")
    c.select(F.to_json(envelope).alias("value")).write.text(path)
    raw = spark.read.json(path, schema="case_id string, properties struct<name: string, buildings: string, surface_area: string>, owner_id string, closed boolean")
    number = lambda c, kind: F.coalesce(F.expr(f"try_cast(properties.{c} AS {kind})"), F.lit(0).cast(kind))
    return raw.select(F.col("case_id").cast("bigint").alias("case_id"), "properties.name", number("buildings", "int").alias("buildings"), number("surface_area", "double").alias("surface_area"), "owner_id", "closed")


@query("src_csv_label_from_prefix", "SELECT CASE WHEN c_nationkey < 10 THEN 'real' ELSE 'fake' END AS classification, c_custkey, c_name FROM customer WHERE c_nationkey < 20")
def csv_label_from_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Files of one folder, labelled by how their names begin; text is trimmed and files of other names are left out."""
    path = scratch(spark, "named-csv")
    c = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("  "), "c_name", F.lit(" ")).alias("c_name"), F.when(F.col("c_nationkey") < 10, "real").when(F.col("c_nationkey") < 20, "fake").otherwise("notes").alias("kind"))
    for kind in ("real", "fake", "notes"):
        c.where(F.col("kind") == kind).drop("kind").write.csv(f"{path}/{kind}_visits_2024.csv", header=True)
    raw = spark.read.option("recursiveFileLookup", "true").csv(path, header=True, schema="c_custkey bigint, c_name string").select("*", F.regexp_extract("_metadata.file_path", r"/(real|fake)[^/]*\.csv/", 1).alias("classification"))
    return raw.where("classification <> ''").select("classification", "c_custkey", F.trim("c_name").alias("c_name"))


#: What a file of buildings is called: state, area and ward.
BUILDING_FILE = r"^(.+?)_state_(.+?)_lga_(.+?)_ward_(.+?)_buildings_data\.csv$"


@query("src_building_files", "SELECT 'Region' || CAST(n_regionkey AS VARCHAR) AS state, 'Nation' || CAST(n_nationkey % 3 AS VARCHAR) AS lga, n_name AS ward, s_suppkey AS building, s_acctbal AS area_in_meters, CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE 0.5::DOUBLE END AS confidence FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 6 <> 0")
def building_files(spark: SparkSession, d: str) -> DataFrame:
    """Buildings whose ward stands in the file's name: bad places are left out, bad numbers become zero."""
    path = scratch(spark, "buildings")
    n = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    name = F.concat(F.lit("country_state_region"), "n_regionkey", F.lit("_lga_nation"), F.col("n_nationkey") % 3, F.lit("_ward_"), F.lower("n_name"), F.lit("_buildings_data.csv"))
    bad = lambda test, x: F.when(test, F.lit("n/a")).otherwise(x.cast("string"))
    k = F.col("s_suppkey")
    rows = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(name.alias("file"), k.alias("building"), bad(k % 6 == 0, F.lit(9.5)).alias("latitude"), F.lit("7.5").alias("longitude"), F.col("s_acctbal").cast("string").alias("area"), bad(k % 4 == 0, F.lit(0.5)).alias("confidence"))
    rows.write.partitionBy("file").csv(path, header=True)
    schema = "building bigint, latitude string, longitude string, area string, confidence string"
    raw = spark.read.option("recursiveFileLookup", "true").csv(path, header=True, schema=schema).select("*", F.regexp_extract("_metadata.file_path", "/file=([^/]+)/", 1).alias("file"))
    part = lambda i: F.initcap(F.regexp_extract("file", BUILDING_FILE, i))
    number = lambda c: F.expr(f"try_cast({c} AS DOUBLE)")
    placed = raw.where(number("latitude").isNotNull() & number("longitude").isNotNull())
    return placed.select(part(2).alias("state"), part(3).alias("lga"), F.upper(part(4)).alias("ward"), "building", F.coalesce(number("area"), F.lit(0.0)).alias("area_in_meters"), F.coalesce(number("confidence"), F.lit(0.0)).alias("confidence"))


@query("join_building_file_ward", "WITH w AS (SELECT n_nationkey AS ward_id, r_name AS state, n_name AS ward FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT n_nationkey + 100, r_name, n_name FROM nation JOIN region ON r_regionkey = n_regionkey), f AS (SELECT c_custkey AS file_id, upper(r_name) AS state, CASE WHEN c_custkey % 9 = 0 THEN 'nowhere' ELSE lower(n_name) END AS ward FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey) SELECT file_id, MIN(ward_id) AS ward_id FROM f JOIN w ON lower(w.state) = lower(f.state) AND lower(w.ward) = lower(f.ward) GROUP BY file_id")
def building_file_ward(spark: SparkSession, d: str) -> DataFrame:
    """Files matched to wards by state and ward, letter case set aside; of several wards the first wins."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    places = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    wards = places.select(F.col("n_nationkey").alias("ward_id"), F.col("r_name").alias("state"), F.col("n_name").alias("ward"))
    wards = wards.unionByName(wards.withColumn("ward_id", F.col("ward_id") + 100))
    files = table(spark, d, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("file_id"), F.upper("r_name").alias("state"), F.when(F.col("c_custkey") % 9 == 0, "nowhere").otherwise(F.lower("n_name")).alias("ward"))
    firsts = wards.groupBy(F.lower("state").alias("s"), F.lower("ward").alias("w")).agg(F.min("ward_id").alias("ward_id"))
    return files.join(firsts, (F.lower("state") == F.col("s")) & (F.lower("ward") == F.col("w"))).select("file_id", "ward_id")


def villages(spark: SparkSession, d: str) -> DataFrame:
    """(id, name, state, lga, ward): a list of villages, one for each part."""
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), (F.col("p_size") % 5).cast("string").alias("state"), F.col("p_type").alias("lga"), F.concat("p_brand", F.lit("-"), F.col("p_size") % 10).alias("ward"))


def settlements(spark: SparkSession, d: str) -> DataFrame:
    """(id, name, state, lga, ward, lat, lon): settlements whose names are spelt in other ways; some wards have none."""
    k = F.col("id")
    words = F.array_join(F.reverse(F.split("name", " ")), " ")
    name = F.when(k % 3 == 0, F.upper(words)).when(k % 3 == 1, F.concat(F.substring("name", 1, 6), F.lit("x"), F.substring("name", 7, 99))).otherwise(F.col("name"))
    v = villages(spark, d).where(F.substring("ward", -1, 1) != "7")
    return v.select((k + 1_000_000).alias("id"), name.alias("name"), "state", "lga", "ward", (9.0 + (k % 100) / 100.0).alias("lat"), (7.0 + (k % 90) / 100.0).alias("lon"))


@query("src_village_scan", "SELECT p_partkey AS id, p_name AS name, CAST(p_size % 5 AS VARCHAR) AS state, p_type AS lga, p_brand || '-' || (p_size % 10) AS ward FROM part")
def village_scan(spark: SparkSession, d: str) -> DataFrame:
    """A list of villages as CSV, read with its schema."""
    path = scratch(spark, "villages")
    villages(spark, d).write.csv(path, header=True)
    return spark.read.csv(path, header=True, schema="id bigint, name string, state string, lga string, ward string")


def _keys(name: Column) -> Column:
    """Keys of a name such that two names alike by four fifths (twice the common subsequence over both lengths) share one.

    A name of n characters shares n / 5 - 1 pairs of neighbouring characters or more with such a partner, so of its n - 1 pairs,
    in an order fixed for all names, the first ones up to the last but that many hold a common one; likewise two thirds of its
    characters. Pairs serve names of ten characters or more, characters those of fourteen or fewer, so every two meet.
    """
    n = F.length(name)
    numbered = lambda parts: F.transform(parts, lambda x, i: F.struct(F.xxhash64(x).alias("order"), F.concat(x, F.size(F.filter(F.slice(parts, F.lit(1), i), lambda y: y == x)).cast("string")).alias("key")))
    first = lambda parts, m: F.transform(F.slice(F.array_sort(numbered(parts)), F.lit(1), F.greatest(m, F.lit(0)).cast("int")), lambda x: x["key"])
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: name.substr(i, F.lit(2)))
    characters = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: name.substr(i, F.lit(1)))
    by_pairs = F.when(n >= 10, first(pairs, n - F.ceil(n / 5.0 - 1))).otherwise(F.array().cast("array<string>"))
    by_characters = F.when((n > 0) & (n <= 14), F.transform(first(characters, n - F.ceil(n * 2 / 3.0) + 1), lambda x: F.concat(F.lit("1:"), x))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(by_pairs, by_characters))


def match_names(v: DataFrame, s: DataFrame, least: float = 80.0) -> DataFrame:
    """(id, match, ratio): for each village of v (id, name, state, lga, ward) the settlement of s whose name is most like its
    own, at `least` per cent; ties go to the lowest id. Candidates are the settlements of the ward, of the area where the ward
    has none, of the state where the area has none either. Two names are compared once, however many wards have them both, and
    only if they share a key in one."""
    levels = {"w": ("state", "lga", "ward"), "l": ("state", "lga"), "s": ("state",)}
    block = lambda level: F.concat_ws("\x1f", F.lit(level), *(F.lower(F.trim(c)) for c in levels[level]))
    sorted_name = F.array_join(F.array_sort(F.split(F.lower(F.trim(F.regexp_replace("name", r"\s+", " "))), " ")), " ")
    names = s.select("id", F.explode(F.array(*map(block, levels))).alias("block"), sorted_name.alias("own")).groupBy("block", "own").agg(F.min("id").alias("match"))
    blocks = saved(names.select("block").distinct(), "blocks")
    wanted = v.select("id", sorted_name.alias("name"), *(block(k).alias(k) for k in levels))
    for k in levels:
        wanted = wanted.join(blocks.withColumnRenamed("block", f"has_{k}"), F.col(k) == F.col(f"has_{k}"), "left")
    wanted = wanted.select("id", "name", F.coalesce(*(F.col(f"has_{k}") for k in levels)).alias("block")).where("block IS NOT NULL")
    asked = wanted.select("name", "block").distinct()
    left, right = (x.withColumn("key", F.explode(_keys(F.col(c)))) for x, c in ((asked, "name"), (names.select("block", "own"), "own")))
    alike = (F.length("own") * 3 >= F.length("name") * 2) & (F.length("own") * 2 <= F.length("name") * 3)
    pairs = saved(left.join(right, ["block", "key"]).where(alike).select("block", "name", "own").distinct(), "pairs")

    def ratios(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield x.assign(ratio=token_sort_ratios(x["name"].tolist(), x["own"].tolist()))

    scored = pairs.select("name", "own").distinct().mapInPandas(ratios, "name string, own string, ratio double").where(F.col("ratio") >= least)
    best = pairs.join(scored, ["name", "own"]).join(names, ["block", "own"]).groupBy("block", "name").agg(F.max_by("match", F.struct("ratio", -F.col("match"))).alias("match"), F.max("ratio").alias("ratio"))
    return wanted.join(best, ["block", "name"]).select("id", "match", F.round("ratio", 4).alias("ratio"))


@query("join_fuzzy_names")
def fuzzy_names(spark: SparkSession, d: str) -> DataFrame:
    """All villages with the settlements whose names are most like theirs."""
    return match_names(villages(spark, d), settlements(spark, d))


@query("src_latest_file", "SELECT 'visits_b.csv' AS file_name, 3 AS n_files, CAST((SELECT COUNT(*) FROM nation WHERE n_nationkey % 3 = 1) AS BIGINT) AS n_rows")
def latest_file(spark: SparkSession, d: str) -> DataFrame:
    """The newest of the files of one domain by their time of change, office lock files left aside, and its rows. Each file has a
    third of the table; their times of change are set a minute apart, the lock file's last."""
    path = scratch(spark, "exports")
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    for i, name in enumerate(("visits_a.csv", "visits_b.csv", "~$visits_z.csv")):
        n.where(F.col("n_nationkey") % 3 == i).write.csv(f"{path}/{name}", header=True)
        set_changed(spark, f"{path}/{name}", 1_700_000_000_000 + 60_000 * i)
    own = "regexp_extract(_metadata.file_path, '/([^/]+\\\\.csv)/', 1)"
    files = spark.read.option("recursiveFileLookup", "true").csv(path, header=True, schema="n_nationkey int, n_name string").select(F.expr(own).alias("file_name"), "_metadata.file_modification_time")
    per_file = files.groupBy("file_name").agg(F.max("file_modification_time").alias("changed"), F.count("*").alias("n"))
    locked = F.startswith("file_name", F.lit("~$")) | F.startswith("file_name", F.lit("%7E$"))
    return per_file.agg(F.max_by("file_name", F.when(~locked, F.col("changed"))).alias("file_name"), F.count("*").cast("int").alias("n_files"), F.max_by("n", F.when(~locked, F.col("changed"))).alias("n_rows"))


@query("proj_microplan_headers", with_views("SELECT du_name AS name, 'OA' || (service_area_id % 4) || '-' || service_area_id AS service_area_id, buildings, flw_id AS flw FROM dus"))
def microplan_headers(spark: SparkSession, d: str) -> DataFrame:
    """A plan's headers as they come, brought to one spelling; the area's id gets its office before it."""
    from visitlens.functions.resolve import standardised
    from visitlens.sources.views import delivery_units

    raw = delivery_units(spark, d).select(F.col("du_name").alias(" Name "), F.col("service_area_id").alias("Service Area"), (F.col("service_area_id") % 4).alias("OA"), F.col("buildings").alias("Buildings"), F.col("flw_id").alias("FLW"))
    plain = standardised(raw, {"name": ["name"], "area": ["service_area_id", "service area"], "oa": ["oa"], "buildings": ["buildings"], "flw": ["flw", "flw_id"]})
    return plain.select("name", F.concat(F.lit("OA"), "oa", F.lit("-"), "area").alias("service_area_id"), "buildings", "flw")


@query("src_polygon_table", with_views("SELECT 'opp_' || (row % 3) || '_' || row || '_' || col AS ward_id, 4 AS corners, col + 0.5 AS x, row + 0.5 AS y FROM cells"))
def polygon_table(spark: SparkSession, d: str) -> DataFrame:
    """A CSV of polygons as text, read to boundaries: an id from two columns, the corners, their mean."""
    path = scratch(spark, "polygons")
    corner = lambda dx, dy: F.concat((F.col("col") + dx).cast("string"), F.lit(" "), (F.col("row") + dy).cast("string"))
    wkt = F.concat(F.lit("POLYGON (("), F.concat_ws(", ", corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1), corner(0, 0)), F.lit("))"))
    cells(spark, d).select(F.concat(F.lit("opp_"), F.col("row") % 3).alias("opp_id"), F.concat("row", F.lit("_"), "col").alias("cluster_id"), wkt.alias("WKT")).write.csv(path, header=True, quoteAll=True)
    raw = spark.read.csv(path, header=True, schema="opp_id string, cluster_id string, wkt string")
    ring = F.transform(F.split(F.regexp_extract("wkt", r"\(\((.*)\)\)", 1), ", "), lambda p: F.struct(F.split_part(p, F.lit(" "), F.lit(1)).cast("double").alias("x"), F.split_part(p, F.lit(" "), F.lit(2)).cast("double").alias("y")))
    open_ = raw.withColumn("ring", F.slice(ring, F.lit(1), F.size(ring) - 1))
    mean = lambda c: F.aggregate(F.transform("ring", lambda p: p[c]), F.lit(0.0), lambda a, x: a + x) / F.size("ring")
    return open_.select(F.concat_ws("_", "opp_id", "cluster_id").alias("ward_id"), F.size("ring").alias("corners"), mean("x").alias("x"), mean("y").alias("y"))


@query("src_baseline_table", with_views("SELECT field, CAST(bin AS VARCHAR) AS bin, COUNT(*) AS n, ROUND(COUNT(*) * 1.0 / SUM(COUNT(*)) OVER (PARTITION BY field), 8) AS share FROM (SELECT 'age_months' AS field, CAST(GREATEST(CEIL(age_months / 5.0) - 1, 0) AS INT)::VARCHAR AS bin FROM visits UNION ALL SELECT 'gender', COALESCE(gender, '__BLANK__') FROM visits) GROUP BY field, bin"))
def baseline_table(spark: SparkSession, d: str) -> DataFrame:
    """The baseline's counts and shares by field, written as a table and read back for later runs."""
    age = F.struct(F.lit("age_months").alias("field"), F.greatest(F.ceil(F.col("age_months") / 5.0) - 1, F.lit(0)).cast("string").alias("bin"))
    gender = F.struct(F.lit("gender").alias("field"), F.coalesce("gender", F.lit("__BLANK__")).alias("bin"))
    counts = visits(spark, d).select(F.inline(F.array(age, gender))).groupBy("field", "bin").agg(F.count("*").alias("n"))
    every = counts.groupBy("field").agg(F.sum("n").alias("every"))
    path = scratch(spark, "baseline")
    counts.join(every, "field").select("field", "bin", "n", F.round(F.col("n") / F.col("every"), 8).alias("share")).write.partitionBy("field").parquet(path)
    return spark.read.schema("bin string, n bigint, share double, field string").parquet(path)


@query("join_rebinned_baseline", with_views("""b AS (SELECT LEAST(CAST(FLOOR(value / 100) AS INT), 9) AS i, COUNT(*) AS n, quantile_cont(k, 0.5) AS med FROM visits GROUP BY 1), p AS (SELECT i, 100.0 * n / SUM(n) OVER () AS pct, med, i * 100.0 AS lo, i * 100.0 + 100 AS hi FROM b), e AS (SELECT range AS j, range * 70.0 AS x, range * 70.0 + 70 AS y FROM range(12)),
o AS (SELECT j, SUM(pct * (LEAST(hi, y) - GREATEST(lo, x)) / 100) AS w FROM e JOIN p ON lo < y AND x < hi GROUP BY j)
SELECT e.j, ROUND(COALESCE(100 * w / SUM(w) OVER (), 0), 6) AS pct, ROUND(med, 6) AS median FROM e LEFT JOIN o USING (j) LEFT JOIN p ON (x + y) / 2 >= lo AND (x + y) / 2 < hi"""))
def rebinned_baseline(spark: SparkSession, d: str) -> DataFrame:
    """A baseline's bins brought to other edges: shares by overlap and then to a hundred again, medians of the bin that holds the middle."""
    v = visits(spark, d)
    b = v.groupBy(F.least(F.floor(F.col("value") / 100), F.lit(9)).alias("i")).agg(F.count("*").alias("n"), F.percentile("k", 0.5).alias("med"))
    p = b.join(b.agg(F.sum("n").alias("every"))).select((100.0 * F.col("n") / F.col("every")).alias("pct"), "med", (F.col("i") * 100.0).alias("lo"), (F.col("i") * 100.0 + 100).alias("hi"))  # ten rows
    e = spark.range(12).select(F.col("id").alias("j"), (F.col("id") * 70.0).alias("x"), (F.col("id") * 70.0 + 70).alias("y"))
    overlap = F.greatest(F.lit(0.0), F.least("hi", "y") - F.greatest("lo", "x")) / 100
    middle = (F.col("x") + F.col("y")) / 2
    o = e.join(F.broadcast(p), (F.col("lo") < F.col("y")) & (F.col("x") < F.col("hi")), "left").groupBy("j").agg(F.coalesce(F.sum(F.col("pct") * overlap), F.lit(0.0)).alias("w"), F.max(F.when((middle >= F.col("lo")) & (middle < F.col("hi")), F.col("med"))).alias("median"))
    return o.select("j", F.round(100 * F.col("w") / F.sum("w").over(Window.partitionBy()), 6).alias("pct"), F.round("median", 6).alias("median"))
