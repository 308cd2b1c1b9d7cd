"""Queries on territories, blocks, signatures and sources, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kronopanel.functions.calendar_time import flexible_date, squash_name
from kronopanel.operators import entities as E
from kronopanel.operators import mapping as M
from kronopanel.operators.panel import panel_from_blocks
from kronopanel.plans.inputs import PANEL_SQL, TERRITORY_SQL, Registry, panel, r4, territory
from kronopanel.session import table
from kronopanel.sources.files import frame_digest, missing_days, parse_power, typed_events

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

_SQUASH = "trim(lower(regexp_replace({0}, '\\s+', ' ', 'g')))"


@query(f"WITH {TERRITORY_SQL} SELECT territory_id, region_code, lat, lon FROM territory")
def scd_version(spark: SparkSession, root: str) -> DataFrame:
    return territory(spark, root)


@query(f"""WITH v AS (SELECT y, territory_id, {_SQUASH.format("municipal_district_type")} AS k FROM (SELECT *, row_number() OVER (PARTITION BY y, territory_id ORDER BY (year_from <= y AND year_to >= y) DESC, year_from DESC, oktmo, municipal_district_name, municipal_district_type, region_code, municipal_district_center_lat) AS rn
  FROM (SELECT DISTINCT * FROM oktmo_reference) r, (VALUES (2018), (2024)) t(y) WHERE r.year_from <= t.y) WHERE rn = 1)
SELECT a.territory_id, a.k AS kind_a, b.k AS kind_b FROM v a JOIN v b USING (territory_id) WHERE a.y = 2018 AND b.y = 2024 AND a.k <> b.k""")
def kind_changes(spark: SparkSession, root: str) -> DataFrame:
    return E.kind_changes(table(spark, root, "oktmo_reference"), 2018, 2024)


@query("SELECT DISTINCT territory_id, nullif(regexp_replace(regexp_replace(oktmo, '\\.0+$', ''), '[^0-9]', '', 'g'), '') AS code, left(nullif(regexp_replace(regexp_replace(oktmo, '\\.0+$', ''), '[^0-9]', '', 'g'), ''), 2) AS region FROM oktmo_reference WHERE oktmo IS NOT NULL")
def normalized_codes(spark: SparkSession, root: str) -> DataFrame:
    r = table(spark, root, "oktmo_reference").where("oktmo is not null").select("territory_id", E.digits_only(F.col("oktmo")).alias("code")).distinct()
    return r.withColumn("region", F.substring("code", 1, 2))


@query("""WITH reg AS (SELECT DISTINCT region_code FROM oktmo_reference WHERE region_code IS NOT NULL), c AS (SELECT DISTINCT nullif(regexp_replace(regexp_replace(oktmo, '\\.0+$', ''), '[^0-9]', '', 'g'), '') AS code FROM oktmo_reference)
SELECT code, coalesce(a.region_code, b.region_code) AS region FROM c LEFT JOIN reg a ON length(a.region_code) = 3 AND a.region_code = left(code, 3) LEFT JOIN reg b ON length(b.region_code) = 2 AND b.region_code = left(code, 2) WHERE code IS NOT NULL""")
def region_of_code(spark: SparkSession, root: str) -> DataFrame:
    r = table(spark, root, "oktmo_reference")
    codes = r.select(E.digits_only(F.col("oktmo")).alias("code")).distinct().where("code is not null")
    return E.region_of_code(codes, "code", r.select("region_code").distinct().where("region_code is not null"))


@query("""WITH o AS (SELECT *, lag(mo) OVER w AS pm, lag(category_15) OVER w AS pc, lag(period) OVER w AS pp, row_number() OVER w AS rn FROM raw_blocks WINDOW w AS (ORDER BY row_no)),
b AS (SELECT *, sum((rn = 1 OR mo IS DISTINCT FROM pm OR category_15 IS DISTINCT FROM pc OR NOT coalesce(period > pp, false))::INT) OVER (ORDER BY row_no) AS block FROM o) SELECT row_no, block::BIGINT AS block FROM b""")
def series_blocks(spark: SparkSession, root: str) -> DataFrame:
    """Runs of an ordered export, numbered without moving all rows into one task."""
    return E.series_blocks(table(spark, root, "raw_blocks"), "row_no", ["mo", "category_15"], "period").select("row_no", "block")


@query("SELECT block_id, count(DISTINCT period) AS periods, min(period) AS first_period, max(period) AS last_period, count(v) AS n_values, round(sum(v), 2) AS total FROM (SELECT *, CASE WHEN isnan(value) THEN NULL ELSE value END AS v FROM raw_blocks) GROUP BY 1".replace("round(sum(v), 2)", "round(sum(v) + 0.0033, 2)"))
def block_summaries(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "raw_blocks").withColumn("v", F.nanvl("value", F.lit(None).cast("double")))
    out = rows.groupBy("block_id").agg(F.countDistinct("period").alias("periods"), F.min("period").alias("first_period"), F.max("period").alias("last_period"), F.count("v").alias("n_values"), F.sum("v").alias("s"))
    return out.withColumn("total", F.round(F.col("s") + 0.0033, 2)).drop("s")


@query(f"""WITH {PANEL_SQL}, s AS (SELECT unique_id, list_sort(list((year(ds) * 12 + month(ds))::VARCHAR || '=' || round_even(y, 0)::BIGINT::VARCHAR)) AS sig FROM panel GROUP BY 1), u AS (SELECT sig, min(unique_id) AS k FROM s GROUP BY 1 HAVING count(*) = 1) SELECT k AS left_key, 'old-' || k AS right_key FROM u""")
def signature_match(spark: SparkSession, root: str) -> DataFrame:
    """Series matched by their whole content to a re-keyed copy, where the content is unique."""
    p = panel(spark, root).select(F.col("unique_id").alias("key"), (F.year("ds") * 12 + F.month("ds")).alias("m"), "y")
    left = E.signatures(p, "key", "m", "y")
    right = E.signatures(p.withColumn("key", F.concat(F.lit("old-"), "key")), "key", "m", "y")
    return E.signature_match(left, right).select("left_key", "right_key")


@query(f"""WITH r AS (SELECT DISTINCT territory_id, region_code, {_SQUASH.format("municipal_district_name")} AS name FROM oktmo_reference WHERE municipal_district_name IS NOT NULL AND region_code IS NOT NULL), u AS (SELECT region_code, name, min(territory_id) AS k FROM r GROUP BY ALL HAVING count(DISTINCT territory_id) = 1)
SELECT region_code, name, k AS left_key, 'b' || k AS right_key FROM u""")
def unique_name_bridge(spark: SparkSession, root: str) -> DataFrame:
    r = table(spark, root, "oktmo_reference").where("municipal_district_name is not null and region_code is not null").select(F.col("territory_id").alias("key"), "region_code", squash_name(F.col("municipal_district_name")).alias("name")).distinct()
    return E.unique_name_bridge(r, r.withColumn("key", F.concat(F.lit("b"), F.col("key").cast("string"))), "region_code", "name")


@query(f"""WITH r AS (SELECT DISTINCT {_SQUASH.format("municipal_district_name")} AS name, region_code AS region, nullif(regexp_replace(regexp_replace(oktmo, '\\.0+$', ''), '[^0-9]', '', 'g'), '') AS code FROM oktmo_reference WHERE municipal_district_name IS NOT NULL AND region_code IS NOT NULL),
one AS (SELECT name, region, min(code) AS code FROM r GROUP BY ALL HAVING count(DISTINCT code) = 1) SELECT n.name, n.region, one.code FROM (SELECT DISTINCT name, region FROM r) n LEFT JOIN one USING (name, region)""")
def match_unique_code(spark: SparkSession, root: str) -> DataFrame:
    r = table(spark, root, "oktmo_reference").where("municipal_district_name is not null and region_code is not null").select(squash_name(F.col("municipal_district_name")).alias("name"), F.col("region_code").alias("region"), E.digits_only(F.col("oktmo")).alias("code")).distinct()
    return E.match_unique_code(r.select("name", "region").distinct(), r)


@query()
def candidate_regions(spark: SparkSession, root: str) -> DataFrame:
    """Regions that know each name of the export (word boundaries of Cyrillic: no SQL twin)."""
    pick = lambda c: E.name_root(F.col(c)).alias("root")
    ref = table(spark, root, "oktmo_reference").where("municipal_district_name is not null and region_code is not null").select(pick("municipal_district_name"), F.col("region_code").alias("region")).distinct().where("root <> ''")
    names = table(spark, root, "raw_blocks").where("mo is not null").select(pick("mo")).distinct()
    return E.candidate_regions(names, ref).select("root", F.size("regions").cast("long").alias("n_regions"), "source")


@query("""WITH p AS (SELECT DISTINCT predecessor AS left_key, successor AS right_key, 1 AS territory FROM reorganizations WHERE predecessor IS NOT NULL AND successor IS NOT NULL), l AS (SELECT left_key, count(DISTINCT right_key) AS rights, count(DISTINCT territory) AS ts FROM p GROUP BY 1), r AS (SELECT right_key, count(DISTINCT left_key) AS lefts FROM p GROUP BY 1)
SELECT count(DISTINCT CASE WHEN rights = 1 AND lefts = 1 THEN left_key END) AS one_to_one, count(DISTINCT CASE WHEN rights > 1 THEN left_key END) AS split, count(DISTINCT CASE WHEN lefts > 1 THEN right_key END) AS glued, bool_and(ts = 1) AS same_territory FROM p JOIN l USING (left_key) JOIN r USING (right_key)""")
def crosswalk_agreement(spark: SparkSession, root: str) -> DataFrame:
    p = table(spark, root, "reorganizations").where("predecessor is not null and successor is not null").select(F.col("predecessor").alias("left_key"), F.col("successor").alias("right_key"), F.lit(1).alias("territory")).distinct()
    return E.crosswalk_agreement(p)


@query("SELECT series_key, reading_id, last_value(frequency IGNORE NULLS) OVER (PARTITION BY series_key ORDER BY reading_id) AS frequency FROM national_series")
def ffill_frequency(spark: SparkSession, root: str) -> DataFrame:
    return E.forward_fill(table(spark, root, "national_series").select("series_key", "reading_id", "frequency"), "reading_id", "frequency", "series_key")


@query(f"WITH {PANEL_SQL} SELECT round(median(ln(a.y / b.y)), 4) AS log_share FROM panel a JOIN panel b ON a.territory_id = b.territory_id AND a.ds = b.ds WHERE a.category = 'food' AND b.category = 'total' AND a.y > 0 AND b.y > 0")
def typical_category_share(spark: SparkSession, root: str) -> DataFrame:
    return E.typical_share(panel(spark, root), "food", "total").select(*r4("log_share"))


@query("""WITH m AS (SELECT DISTINCT block_id, hash FROM (SELECT block_id, (block_id % 240 + 1) AS hash FROM raw_blocks)), r AS (SELECT hash AS territory_id, category_15 AS category, (CASE WHEN period LIKE '__.____' THEN right(period, 4) || '-' || left(period, 2) ELSE left(period, 7) END || '-01')::DATE AS ds, max(CASE WHEN isnan(value) THEN NULL ELSE value END) AS y FROM raw_blocks JOIN m USING (block_id) GROUP BY ALL)
SELECT territory_id || '__' || category AS unique_id, ds, round(y, 4) AS y FROM r WHERE y IS NOT NULL""")
def panel_from_export(spark: SparkSession, root: str) -> DataFrame:
    """Panel of the export, its blocks assigned to territories by a given mapping."""
    raw = table(spark, root, "raw_blocks").withColumn("value", F.nanvl("value", F.lit(None).cast("double")))
    mapping = raw.select("block_id", (F.col("block_id") % 240 + 1).alias("territory_id")).distinct()
    return panel_from_blocks(raw, mapping, F.trunc(flexible_date(F.col("period")), "MM")).select("unique_id", "ds", *r4("y"))


@query()
def ambiguous_assignment(spark: SparkSession, root: str) -> DataFrame:
    """Exported series of names that several territories share, grouped one to one around their totals (assignment: no SQL twin)."""
    blocks, shares = _blocks(spark, root), _shares(spark, root)
    shared = blocks.where("category = 'total'").groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name")
    return M.group_blocks(blocks.where("size(v) > 0").join(shared, "name", "left_semi"), shares, "total")


_POWER = '{"header": {"fill_value": -999.0}, "properties": {"parameter": {"T2M": {"202401": -5.5, "202402": -999.0, "202413": 3.0}, "PRECTOTCORR": {"202401": 1.25, "202402": 2.0, "202413": 9.0}}}}'


@query("SELECT * FROM (VALUES ('a', DATE '2024-01-01', -5.5::DOUBLE, 1.25::DOUBLE), ('a', DATE '2024-02-01', NULL, 2.0)) t(cell, ds, t2m, prectot)")
def power_months(spark: SparkSession, root: str) -> DataFrame:
    return parse_power(spark.createDataFrame([("a", _POWER)], "cell string, payload string"))


@query("SELECT try_strptime(d, '%Y%m%d')::DATE AS sqldate, TRY_CAST(q AS INT) AS quad_class, TRY_CAST(g AS DOUBLE) AS goldstein FROM (VALUES ('20240105', '4', '-2.5'), ('someday', 'x', ''), (NULL, '1', '3')) t(d, q, g)")
def typed_event_fields(spark: SparkSession, root: str) -> DataFrame:
    return typed_events(spark.createDataFrame([("20240105", "4", "-2.5"), ("someday", "x", ""), (None, "1", "3")], "sqldate string, quad_class string, goldstein string"))


@query("SELECT g::DATE AS day FROM generate_series(DATE '2023-12-25', DATE '2024-02-05', INTERVAL 1 DAY) s(g) WHERE g::DATE NOT IN (SELECT DISTINCT ts::DATE FROM events)")
def missing_event_days(spark: SparkSession, root: str) -> DataFrame:
    return missing_days(table(spark, root, "events"), "ts", "2023-12-25", "2024-02-05")


@query()
def table_fingerprints(spark: SparkSession, root: str) -> DataFrame:
    """Order-independent digests of input tables (engine-specific hash: no SQL twin)."""
    names = ["consumption", "oof_old", "oof_new"]
    return spark.createDataFrame([(n, frame_digest(table(spark, root, n))) for n in names], "name string, digest string")


#: The letters of the transliteration, and what each becomes.
_LETTERS = "'абвгдеёжзийклмнопрстуфхцчшщъыьэюя', 'abvgdeejzijklmnoprstufhccss_y_eua'"


@query(f"SELECT DISTINCT municipal_district_type AS kind, trim(regexp_replace(translate(lower(municipal_district_type), {_LETTERS}), '[^a-z0-9]+', '-', 'g'), '-') AS slug, left(trim(regexp_replace(translate(lower(municipal_district_type), {_LETTERS}), '[^0-9a-z]', '_', 'g'), '_'), 40) AS key FROM oktmo_reference WHERE municipal_district_type IS NOT NULL")
def kind_slugs(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "oktmo_reference").where("municipal_district_type is not null").select(F.col("municipal_district_type").alias("kind")).distinct().select("kind", E.slugify(F.col("kind")).alias("slug"), E.column_key(F.col("kind")).alias("key"))


# -- from names to territories ----------------------------------------------------------------------


def _places(spark: SparkSession, root: str) -> DataFrame:
    """The ordered lists of exported names: one list per category, one place per block."""
    r = table(spark, root, "raw_blocks").where("mo is not null and block_id is not null and category_15 is not null")
    return r.groupBy("block_id", F.col("category_15").alias("list")).agg(F.min("row_no").alias("pos"), F.min_by("mo", "row_no").alias("name")).select("list", "pos", "name", F.col("block_id").alias("block"))


def _known_names(spark: SparkSession, root: str) -> DataFrame:
    ref = table(spark, root, "oktmo_reference").where("municipal_district_name is not null and region_code is not null")
    return ref.select(E.name_root(F.col("municipal_district_name")).alias("root"), F.col("region_code").alias("region")).distinct().where("root <> ''")


#: Regions that are cities.
FEDERAL = ("77", "78", "92")


@query()
def resolved_regions(spark: SparkSession, root: str) -> DataFrame:
    """Region of each exported name: candidates, smoothed along the list, repaired, with source and confidence (sequential: no SQL twin)."""
    return M.resolve_regions(_places(spark, root), _known_names(spark, root), federal=FEDERAL)


def _total_places(spark: SparkSession, root: str) -> DataFrame:
    return _places(spark, root).where("list = 'total'")


def _blocks(spark: SparkSession, root: str) -> DataFrame:
    """Exported series: block, name, category and arrays of months and positive values."""
    raw = table(spark, root, "raw_blocks").where("block_id is not null and mo is not null").withColumn("value", F.nanvl("value", F.lit(None).cast("double"))).withColumn("ds", F.trunc(flexible_date(F.col("period")), "MM"))
    cells = raw.where("value > 0 and ds is not null").groupBy("block_id", "ds").agg(F.min_by("value", "row_no").alias("v"))
    arrays = cells.groupBy("block_id").agg(F.sort_array(F.collect_list(F.struct((F.year("ds") * 12 + F.month("ds")).alias("m"), "v"))).alias("c"))
    heads = raw.groupBy("block_id").agg(F.min_by("mo", "row_no").alias("name"), F.min_by("category_15", "row_no").alias("category"))
    return heads.join(arrays, "block_id", "left").select(F.col("block_id").alias("block"), squash_name(F.col("name")).alias("name"), "category", F.coalesce("c.m", F.array().cast("array<int>")).alias("m"), F.coalesce("c.v", F.array().cast("array<double>")).alias("v"))


def _shares(spark: SparkSession, root: str) -> DataFrame:
    """Usual log share of each category in its territory's total."""
    p = panel(spark, root)
    whole = p.where("category = 'total'").select("territory_id", "ds", F.col("y").alias("whole"))
    return p.join(whole, ["territory_id", "ds"]).where("y > 0 and whole > 0").groupBy("category").agg(F.median(F.ln(F.col("y") / F.col("whole"))).alias("share"))


def _mapping(spark: SparkSession, root: str) -> DataFrame:
    resolved = M.resolve_regions(_total_places(spark, root), _known_names(spark, root), federal=FEDERAL)
    return M.build_mapping(_blocks(spark, root), resolved, _shares(spark, root), "total")


@query()
def entity_mapping(spark: SparkSession, root: str) -> DataFrame:
    """Every exported block with its territory, by name, order, level and coverage (assignment: no SQL twin)."""
    return _mapping(spark, root)


@query()
def mapping_report(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "raw_blocks").select(F.col("block_id").alias("block"), F.col("category_15").alias("category"), "period")
    return M.mapping_report(rows, _mapping(spark, root))


@query()
def crosswalk_table(spark: SparkSession, root: str) -> DataFrame:
    """Blocks whose whole content is one official series, with their official and their heuristic territory."""
    raw = table(spark, root, "raw_blocks").where("block_id is not null").withColumn("value", F.nanvl("value", F.lit(None).cast("double"))).withColumn("ds", F.trunc(flexible_date(F.col("period")), "MM"))
    cells = raw.where("value is not null and ds is not null").select(F.concat_ws("/", F.col("block_id").cast("string"), "category_15").alias("key"), (F.year("ds") * 12 + F.month("ds")).alias("m"), "value").distinct()
    left = E.signatures(cells, "key", "m", "value")
    right = E.signatures(panel(spark, root).select(F.concat_ws("/", F.col("territory_id").cast("string"), "category").alias("key"), (F.year("ds") * 12 + F.month("ds")).alias("m"), "y"), "key", "m", "y")
    part = lambda c, i: F.split_part(c, F.lit("/"), F.lit(i))
    pairs = E.signature_match(left, right).where(part("left_key", 2) == part("right_key", 2))
    pairs = pairs.select(part("left_key", 1).cast("long").alias("block"), part("left_key", 2).alias("category"), part("right_key", 1).cast("int").alias("territory_id"))
    return M.crosswalk_table(pairs, _mapping(spark, root), _territories(spark, root))


def _territories(spark: SparkSession, root: str) -> DataFrame:
    c = E.canonical_versions(table(spark, root, "oktmo_reference"), 2024).withColumn("code", E.digits_only(F.col("oktmo")))
    return M.territory_table(c.withColumn("region", F.substring("code", 1, 2)).where("region is not null"))


_CANON = """canon AS (SELECT *, nullif(regexp_replace(regexp_replace(oktmo, '\\.0+$', ''), '[^0-9]', '', 'g'), '') AS code FROM (
    SELECT *, row_number() OVER (PARTITION BY territory_id ORDER BY (year_from <= 2024 AND year_to >= 2024) DESC, year_from DESC, oktmo, municipal_district_name, municipal_district_type, region_code, municipal_district_center_lat) AS rn
    FROM (SELECT DISTINCT * FROM oktmo_reference WHERE year_from <= 2024)) WHERE rn = 1)"""
_KIND = r"""CASE WHEN k LIKE '%внутригородск%' THEN 'intracity' WHEN regexp_matches(k, 'городской\s+округ') THEN 'urban_okrug' WHEN regexp_matches(k, 'муниципальный\s+округ') THEN 'municipal_okrug'
    WHEN regexp_matches(k, 'муниципальный\s+район') OR regexp_matches(' ' || k || ' ', '[^а-яё](район|улус|кожуун|аймак)[^а-яё]') THEN 'municipal_district' WHEN regexp_matches(' ' || k || ' ', '[^а-яё]поселение[^а-яё]') THEN 'settlement' ELSE 'other' END"""


@query(f"""WITH {_CANON}, t AS (SELECT *, lower(coalesce(municipal_district_type, municipal_district_name)) AS k FROM canon WHERE code IS NOT NULL)
SELECT left(code, 2) || '-' || lpad(territory_id::VARCHAR, 4, '0') AS territory, territory_id, left(code, 2) AS region, trim(municipal_district_name) AS name, {_KIND} AS kind, left(code, 8) AS code FROM t""")
def territory_table(spark: SparkSession, root: str) -> DataFrame:
    return _territories(spark, root)


@query(f"""WITH {_CANON}, p AS (SELECT DISTINCT region_code, left(code, 2) AS region FROM canon WHERE region_code IS NOT NULL AND code IS NOT NULL), a AS (SELECT region_code, count(*) AS na FROM p GROUP BY 1), b AS (SELECT region, count(*) AS nb FROM p GROUP BY 1)
SELECT region_code, region FROM p JOIN a USING (region_code) JOIN b USING (region) WHERE na > 1 OR nb > 1""")
def region_conflicts(spark: SparkSession, root: str) -> DataFrame:
    c = E.canonical_versions(table(spark, root, "oktmo_reference"), 2024)
    return M.region_conflicts(c.withColumn("region", F.substring(E.digits_only(F.col("oktmo")), 1, 2)), "region_code", "region")


@query()
def matched_codes(spark: SparkSession, root: str) -> DataFrame:
    """Code of each exported name in its resolved region, by root, else by stem among compatible kinds (names: no SQL twin)."""
    ref = table(spark, root, "oktmo_reference").where("municipal_district_name is not null and region_code is not null").select(F.col("municipal_district_name").alias("name"), F.col("region_code").alias("region"), E.digits_only(F.col("oktmo")).alias("code")).distinct()
    names = M.resolve_regions(_total_places(spark, root), _known_names(spark, root), federal=FEDERAL).where("region is not null")
    return M.match_codes(names.select("name", "region"), ref)


def _named_territories(spark: SparkSession, root: str) -> DataFrame:
    """Every name of the acts as a territory of its own."""
    a = table(spark, root, "reorganizations")
    names = a.select(squash_name(F.col("predecessor")).alias("name")).unionByName(a.select(squash_name(F.col("successor")).alias("name"))).where("name <> ''").distinct()
    return names.select("name", F.concat(F.lit("t-"), "name").alias("territory"))


def _acts(spark: SparkSession, root: str) -> DataFrame:
    r = table(spark, root, "reorganizations").select(squash_name(F.col("predecessor")).alias("predecessor"), squash_name(F.col("successor")).alias("successor"), F.lower(F.trim("relation")).alias("relation"), F.date_format(flexible_date(F.col("effective")), "yyyy-MM-dd").alias("effective"))
    return r.where("effective is not null").distinct()


_ACTS = f"""r AS (SELECT DISTINCT {_SQUASH.format("predecessor")} AS predecessor, {_SQUASH.format("successor")} AS successor, lower(trim(relation)) AS relation,
    coalesce(try_strptime(trim(effective), '%d.%m.%Y')::DATE, try_strptime(trim(effective), '%Y/%m/%d')::DATE, try_strptime(trim(effective), '%Y-%m-%d')::DATE, try_strptime(trim(effective), '%Y-%m')::DATE, try_strptime(trim(effective), '%m.%Y')::DATE)::VARCHAR AS effective FROM reorganizations),
    acts AS (SELECT * FROM r WHERE effective IS NOT NULL), names AS (SELECT DISTINCT name FROM (SELECT {_SQUASH.format("predecessor")} AS name FROM reorganizations UNION ALL SELECT {_SQUASH.format("successor")} FROM reorganizations) WHERE name <> '')"""


@query(f"""WITH {_ACTS}, a AS (SELECT 't-' || predecessor AS pid, 't-' || successor AS sid, relation, effective FROM acts WHERE predecessor IN (SELECT name FROM names) AND successor IN (SELECT name FROM names) AND relation IN ('continuation', 'merge') AND predecessor <> successor),
m AS (SELECT pid AS t, effective FROM a UNION ALL SELECT sid, effective FROM a), b AS (SELECT t, max(effective) AS broken FROM m GROUP BY 1), l AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY pid ORDER BY effective DESC, sid DESC, relation DESC) = 1)
SELECT name, 't-' || name AS old_territory, CASE WHEN relation = 'continuation' THEN sid ELSE 't-' || name END AS territory, broken AS admin_break_at, sid AS successor_territory FROM names LEFT JOIN b ON b.t = 't-' || name LEFT JOIN l ON l.pid = 't-' || name""")
def reorganized_territories(spark: SparkSession, root: str) -> DataFrame:
    return M.apply_reorganizations(_named_territories(spark, root), _acts(spark, root))


@query(f"""WITH {_ACTS} SELECT predecessor, successor, relation, p AS problem FROM (SELECT *, CASE WHEN NOT coalesce(relation IN ('continuation', 'merge'), false) THEN 'relation' WHEN predecessor IS NULL OR predecessor NOT IN (SELECT name FROM names) THEN 'predecessor' WHEN successor IS NULL OR successor NOT IN (SELECT name FROM names) THEN 'successor' END AS p FROM acts) WHERE p IS NOT NULL""")
def reorganization_problems(spark: SparkSession, root: str) -> DataFrame:
    return M.reorganization_problems(_named_territories(spark, root), _acts(spark, root))


@query("SELECT event_id, e.region_code AS code, k.region AS region_code FROM (SELECT event_id, region_code FROM event_calendar) e LEFT JOIN (SELECT DISTINCT region_code AS region FROM oktmo_reference WHERE region_code IS NOT NULL) k ON k.region = e.region_code")
def events_by_region(spark: SparkSession, root: str) -> DataFrame:
    """Events under the regions of the reference; unknown codes stay without region."""
    known = table(spark, root, "oktmo_reference").where("region_code is not null").select(F.col("region_code").alias("code"), F.col("region_code").alias("region")).distinct()
    return M.map_regions(table(spark, root, "event_calendar").select("event_id", F.col("region_code").alias("code")), "code", known).select("event_id", "code", "region_code")


@query(f"""WITH {PANEL_SQL}, {_ACTS}, side AS (SELECT predecessor AS name, effective FROM acts WHERE relation IN ('continuation', 'merge') UNION ALL SELECT successor, effective FROM acts WHERE relation IN ('continuation', 'merge')),
t AS (SELECT DISTINCT territory_id, {_SQUASH.format("municipal_district_name")} AS name FROM oktmo_reference WHERE municipal_district_name IS NOT NULL), b AS (SELECT territory_id, max(effective) AS admin_break_at FROM side JOIN t USING (name) GROUP BY 1)
SELECT unique_id, count(*) AS n_obs, any_value(admin_break_at) AS admin_break_at FROM panel LEFT JOIN b USING (territory_id) GROUP BY 1""")
def panel_admin_breaks(spark: SparkSession, root: str) -> DataFrame:
    """Series with the last reorganisation that names their territory."""
    from kronopanel.operators.panel import series_flags, with_admin_breaks

    p = panel(spark, root)
    acts = _acts(spark, root).where("relation in ('continuation', 'merge')")
    side = acts.select(F.col("predecessor").alias("name"), "effective").unionByName(acts.select(F.col("successor").alias("name"), "effective"))
    t = table(spark, root, "oktmo_reference").where("municipal_district_name is not null").select("territory_id", squash_name(F.col("municipal_district_name")).alias("name")).distinct()
    breaks = side.join(t, "name").join(p.select("unique_id", "territory_id").distinct(), "territory_id").select("unique_id", F.col("effective").alias("admin_break_at"))
    return with_admin_breaks(series_flags(p), breaks).select("unique_id", "n_obs", "admin_break_at")
