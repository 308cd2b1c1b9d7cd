"""Queries of the general data-pipeline operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kronopanel.operators.asof_attributes import attributes_as_of
from kronopanel.functions.calendar_time import squash_name
from kronopanel.operators.history import history_from_acts, history_from_snapshots
from kronopanel.operators.regular_grid import regular_grid
from kronopanel.operators.table_diff import diff_copies
from kronopanel.plans.inputs import plain_nan
from kronopanel.session import table

OOF_KEY = ["unique_id", "ds", "fold", "model"]
OOF_FIELDS = ["horizon", "y", "y_hat"]


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    known = attributes_as_of(table(spark, root, "event_calendar"), table(spark, root, "exog_block"))
    return known.select("event_id", "value_id")


def p1_values_known(spark: SparkSession, root: str) -> DataFrame:
    """Every event with the block values in force at its moment."""
    known = attributes_as_of(table(spark, root, "event_calendar"), table(spark, root, "exog_block"))
    return known.select("event_id", F.col("attribute").alias("block"), F.round("value", 4).alias("value"))


def _differences(spark: SparkSession, root: str) -> DataFrame:
    return diff_copies(table(spark, root, "oof_old"), table(spark, root, "oof_new"), OOF_KEY, OOF_FIELDS, tolerance=0.01)


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    issue = F.when(F.col("presence") == "right_only", F.array(F.lit("missing_in_old"))).when(F.col("presence") == "left_only", F.array(F.lit("missing_in_new"))).otherwise(F.col("differences.field"))
    return _differences(spark, root).select("unique_id", F.date_format("ds", "yyyy-MM-dd").alias("ds"), "fold", "model", F.explode(issue).alias("issue"))


def p2_difference_profile(spark: SparkSession, root: str) -> DataFrame:
    """How many keys differ, by model and by what is wrong with them."""
    found = p2_found(spark, root)
    return found.groupBy("model", "issue").agg(F.count("*").alias("n"))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    history = history_from_acts(table(spark, root, "reorganizations"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return history.select("predecessor", "successor", day("valid_from").alias("valid_from"), F.coalesce(day("valid_to"), F.lit("9999-12-31")).alias("valid_to"))


def p4_kind_history(spark: SparkSession, root: str) -> DataFrame:
    """History of each territory's kind from yearly snapshots of the reference."""
    r = table(spark, root, "oktmo_reference").where("territory_id is not null and year_from is not null and year_to is not null")
    span = r.agg(F.min("year_from").alias("lo"), F.max(F.when(F.col("year_to") < 9999, F.col("year_to") + 1).otherwise(F.col("year_from"))).alias("hi"))
    years = r.crossJoin(F.broadcast(span)).where("year_from <= least(year_to, hi)")  # one row of bounds
    years = years.select("territory_id", "year_from", squash_name(F.col("municipal_district_type")).alias("kind"), F.explode(F.sequence("year_from", F.least("year_to", "hi"))).alias("y"))
    taken = years.groupBy(F.col("territory_id").cast("string").alias("territory"), F.make_date("y", F.lit(1), F.lit(1)).alias("d")).agg(F.max_by("kind", F.struct("year_from", F.coalesce("kind", F.lit("")))).alias("kind"))
    out = history_from_snapshots(taken, entity="territory", taken_on="d", payload="kind")
    return out.select("territory", "kind", *[F.year(c).cast("string").alias(c) for c in ("valid_from", "valid_to")])


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    grid = regular_grid(table(spark, root, "national_series"))
    return grid.where("status <> 'observed'").select("series_key", F.date_format("period_start", "yyyy-MM-dd").alias("period_start"))


def p5_regular_series(spark: SparkSession, root: str) -> DataFrame:
    """The regular series: observed values, filled values and marked gaps."""
    return regular_grid(table(spark, root, "national_series"))


QUERIES = {
    "p1_found": p1_found,
    "p1_values_known": p1_values_known,
    "p2_found": p2_found,
    "p2_difference_profile": p2_difference_profile,
    "p4_found": p4_found,
    "p4_kind_history": p4_kind_history,
    "p5_found": p5_found,
    "p5_regular_series": p5_regular_series,
}

_P1 = """
WITH ev AS (SELECT DISTINCT event_id, region_code, coalesce(date, published_at) AS at FROM event_calendar),
ch AS (
  SELECT *, regexp_replace(lower(trim(kind)), '[\\s_-]+', '_', 'g') AS k FROM exog_block
  WHERE value IS NOT NULL AND NOT isnan(value) AND published_at IS NOT NULL
), hit AS (
  SELECT e.event_id, c.block, c.value_id, c.value,
         row_number() OVER (PARTITION BY e.event_id, c.block ORDER BY c.ds DESC NULLS LAST, c.published_at DESC, c.value_id) AS rn
  FROM ev e JOIN ch c ON (c.region_code = 'all' OR c.region_code = e.region_code) AND c.published_at <= e.at
   AND (c.k <> 'known_future' OR date_trunc('month', c.ds) = date_trunc('month', e.at))
)
"""
_P2 = """
WITH o AS (SELECT DISTINCT unique_id, ds, fold, model, horizon, CASE WHEN isnan(y) THEN NULL ELSE y END AS y, CASE WHEN isnan(y_hat) THEN NULL ELSE y_hat END AS y_hat FROM oof_old),
n AS (SELECT DISTINCT unique_id, ds, fold, model, horizon, CASE WHEN isnan(y) THEN NULL ELSE y END AS y, CASE WHEN isnan(y_hat) THEN NULL ELSE y_hat END AS y_hat FROM oof_new),
j AS (
  SELECT coalesce(o.unique_id, n.unique_id) AS unique_id, coalesce(o.ds, n.ds) AS ds, coalesce(o.fold, n.fold) AS fold, coalesce(o.model, n.model) AS model,
         o.fold IS NULL AS no_old, n.fold IS NULL AS no_new,
         o.horizon AS h1, n.horizon AS h2, o.y AS y1, n.y AS y2, o.y_hat AS f1, n.y_hat AS f2
  FROM o FULL JOIN n ON o.unique_id = n.unique_id AND o.ds = n.ds AND o.fold = n.fold AND o.model = n.model
), found AS (
  SELECT unique_id, strftime(ds, '%Y-%m-%d') AS ds, fold, model, unnest(
    CASE WHEN no_old THEN ['missing_in_old'] WHEN no_new THEN ['missing_in_new'] ELSE list_filter([
      CASE WHEN (h1 IS NULL) <> (h2 IS NULL) OR abs(h1 - h2) > 0.01 THEN 'horizon' END,
      CASE WHEN (y1 IS NULL) <> (y2 IS NULL) OR abs(y1 - y2) > 0.01 THEN 'y' END,
      CASE WHEN (f1 IS NULL) <> (f2 IS NULL) OR abs(f1 - f2) > 0.01 THEN 'y_hat' END], lambda x: x IS NOT NULL) END) AS issue
  FROM j
)
"""
_DATE = """coalesce(try_strptime({0}, '%d.%m.%Y')::DATE, try_strptime({0}, '%Y/%m/%d')::DATE, try_strptime({0}, '%Y-%m')::DATE,
  try_strptime(left({0}, 10), '%Y-%m-%d')::DATE,
  CASE WHEN {0} LIKE '%-Q%' THEN make_date(left({0}, 4)::INT, right({0}, 1)::INT * 3 - 2, 1) END)"""
ORACLE = {
    "p1_found": _P1 + "SELECT event_id, value_id FROM hit WHERE rn = 1",
    "p1_values_known": _P1 + "SELECT event_id, block, round(value, 4) AS value FROM hit WHERE rn = 1",
    "p2_found": _P2 + "SELECT unique_id, ds, fold, model, issue FROM found",
    "p2_difference_profile": _P2 + "SELECT model, issue, count(*) AS n FROM found GROUP BY ALL",
    "p4_kind_history": """WITH r AS (SELECT territory_id, year_from, year_to, trim(lower(regexp_replace(municipal_district_type, '\\s+', ' ', 'g'))) AS kind FROM oktmo_reference WHERE territory_id IS NOT NULL AND year_from IS NOT NULL AND year_to IS NOT NULL),
        b AS (SELECT min(year_from) AS lo, max(CASE WHEN year_to < 9999 THEN year_to + 1 ELSE year_from END) AS hi FROM r),
        e AS (SELECT territory_id, year_from, kind, unnest(generate_series(year_from::BIGINT, least(year_to, hi)::BIGINT)) AS y FROM r, b WHERE year_from <= least(year_to, hi)),
        s AS (SELECT territory_id, y, kind FROM (SELECT *, row_number() OVER (PARTITION BY territory_id, y ORDER BY year_from DESC, coalesce(kind, '') DESC) AS rn FROM e) WHERE rn = 1),
        last AS (SELECT max(y) AS last FROM s), i AS (SELECT *, (lag(kind) OVER w IS DISTINCT FROM kind OR lag(y) OVER w IS DISTINCT FROM y - 1)::INT AS new FROM s WHERE kind IS NOT NULL WINDOW w AS (PARTITION BY territory_id ORDER BY y)),
        g AS (SELECT *, sum(new) OVER (PARTITION BY territory_id ORDER BY y) AS run FROM i)
        SELECT territory_id::VARCHAR AS territory, any_value(kind) AS kind, min(y)::VARCHAR AS valid_from, CASE WHEN max(y) < any_value(last) THEN (max(y) + 1)::VARCHAR END AS valid_to FROM g, last GROUP BY territory_id, run""",
    "p4_found": f"""
WITH r AS (
  SELECT lower(trim(regexp_replace(predecessor, '\\s+', ' ', 'g'))) AS p, nullif(lower(trim(regexp_replace(successor, '\\s+', ' ', 'g'))), '') AS s,
         {_DATE.format("trim(effective)")} AS d, trim(source) AS a, recorded_at, reorg_id
  FROM reorganizations WHERE predecessor IS NOT NULL
), act AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY p, a ORDER BY recorded_at DESC, reorg_id DESC) = 1
), dated AS (SELECT * FROM act WHERE d IS NOT NULL QUALIFY row_number() OVER (PARTITION BY p, d ORDER BY recorded_at DESC, reorg_id DESC) = 1
), kept AS (SELECT * FROM dated QUALIFY row_number() OVER (PARTITION BY p ORDER BY d) = 1 OR s IS DISTINCT FROM lag(s) OVER (PARTITION BY p ORDER BY d)
), spans AS (SELECT p, s, d, lead(d) OVER (PARTITION BY p ORDER BY d) AS u FROM kept)
SELECT p AS predecessor, s AS successor, strftime(d, '%Y-%m-%d') AS valid_from, coalesce(strftime(u, '%Y-%m-%d'), '9999-12-31') AS valid_to FROM spans WHERE s IS NOT NULL
""",
    "p5_found": f"""
WITH r AS (
  SELECT series_key, CASE WHEN lower(trim(frequency)) IN ('daily', 'day', 'd') THEN 'day' WHEN lower(trim(frequency)) IN ('weekly', 'week', 'w') THEN 'week'
    WHEN lower(trim(frequency)) IN ('monthly', 'month', 'm') THEN 'month' WHEN lower(trim(frequency)) IN ('quarterly', 'quarter', 'q') THEN 'quarter' END AS f,
    {_DATE.format("trim(period)")} AS d, value FROM national_series
), freq AS (SELECT series_key, arg_min(f, (-n, o)) AS f FROM (SELECT series_key, f, count(*) AS n, CASE f WHEN 'day' THEN 0 WHEN 'week' THEN 1 WHEN 'month' THEN 2 ELSE 3 END AS o FROM r WHERE f IS NOT NULL GROUP BY ALL) GROUP BY 1
), seen AS (SELECT DISTINCT r.series_key, freq.f, date_trunc(freq.f, r.d)::DATE AS p FROM r JOIN freq USING (series_key) WHERE r.value IS NOT NULL AND NOT isnan(r.value) AND r.d IS NOT NULL
), span AS (SELECT series_key, f, min(p) AS a, max(p) AS b FROM seen GROUP BY ALL
), grid AS (SELECT series_key, unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, CASE f WHEN 'day' THEN INTERVAL 1 DAY WHEN 'week' THEN INTERVAL 7 DAY WHEN 'month' THEN INTERVAL 1 MONTH ELSE INTERVAL 3 MONTH END))::DATE AS p FROM span)
SELECT series_key, strftime(p, '%Y-%m-%d') AS period_start FROM grid ANTI JOIN seen USING (series_key, p)
""",
}
ORACLE = {name: plain_nan(sql) for name, sql in ORACLE.items()}
