"""Inputs the queries derive from the tables, each with its SQL text."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kronopanel.functions.calendar_time import flexible_date
from kronopanel.operators.panel import official_panel
from kronopanel.session import table

PANEL_SQL = """panel AS (
  SELECT territory_id::VARCHAR || '__' || category AS unique_id, territory_id, category, (date || '-01')::DATE AS ds, max(value)::DOUBLE AS y
  FROM consumption WHERE value IS NOT NULL AND territory_id IS NOT NULL GROUP BY territory_id, category, date)"""
MI = "(year({0}) * 12 + month({0}))"
OOF_SQL = """oof AS (
  SELECT DISTINCT unique_id, ds, fold, horizon, model, y, y_hat, split_part(unique_id, '__', 2) AS category, (split_part(fold, '_', 2) || '-01')::DATE AS cutoff
  FROM oof_old WHERE y IS NOT NULL AND y_hat IS NOT NULL AND NOT isnan(y) AND NOT isnan(y_hat))"""
TERRITORY_SQL = """territory AS (
  SELECT territory_id, region_code, municipal_district_center_lat AS lat, municipal_district_center_lon AS lon FROM (
    SELECT *, row_number() OVER (PARTITION BY territory_id ORDER BY (year_from <= 2024 AND year_to >= 2024) DESC, year_from DESC, oktmo, municipal_district_name, municipal_district_type, region_code, municipal_district_center_lat) AS rn
    FROM (SELECT DISTINCT * FROM oktmo_reference WHERE year_from <= 2024)) WHERE rn = 1)"""
EDGES_SQL = """edges AS (
  SELECT t.territory_id AS x, u.territory_id AS y, ((t.territory_id * 7 + k * 13) % 50 + 1)::DOUBLE AS distance
  FROM (SELECT DISTINCT territory_id FROM oktmo_reference) t, (VALUES (1), (2), (7)) v(k), (SELECT DISTINCT territory_id FROM oktmo_reference) u WHERE u.territory_id = t.territory_id + k)"""
#: A period in any of its notations as a date; a quarter stands for its first month.
PERIOD_SQL = """coalesce(try_strptime({0}, '%d.%m.%Y')::DATE, try_strptime({0}, '%Y/%m/%d')::DATE, try_strptime({0}, '%Y-%m')::DATE, try_strptime(left({0}, 10), '%Y-%m-%d')::DATE, try_strptime({0}, '%m.%Y')::DATE,
  CASE WHEN {0} LIKE '%-Q%' THEN make_date(left({0}, 4)::INT, right({0}, 1)::INT * 3 - 2, 1) END)"""
NATIONAL_SQL = f"""national AS (
  SELECT series_key AS unique_id, slug, date_trunc('month', d)::DATE AS ds, avg(value) AS y FROM (SELECT *, {PERIOD_SQL.format("trim(period)")} AS d FROM national_series)
  WHERE d IS NOT NULL AND value IS NOT NULL AND NOT isnan(value) GROUP BY ALL)"""
NEWS_SQL = "news AS (SELECT event_type AS kind, (props ->> '$.k')::INT AS class, value, ts::DATE AS added, user_id FROM events)"
#: Groups of event kinds whose shares are features.
NEWS_GROUPS = {"buying": ("purchase", "refund"), "looking": ("view", "click")}


def panel(spark: SparkSession, root: str) -> DataFrame:
    return official_panel(table(spark, root, "consumption"))


def oof(spark: SparkSession, root: str) -> DataFrame:
    """Forecasts of the older run that have a value and an actual."""
    o = table(spark, root, "oof_old").where("y is not null and y_hat is not null and not isnan(y) and not isnan(y_hat)").dropDuplicates()
    return o.withColumn("category", F.split_part("unique_id", F.lit("__"), F.lit(2))).withColumn("cutoff", F.to_date(F.concat(F.split_part("fold", F.lit("_"), F.lit(2)), F.lit("-01"))))


def territory(spark: SparkSession, root: str) -> DataFrame:
    from kronopanel.operators.entities import canonical_versions

    return canonical_versions(table(spark, root, "oktmo_reference"), 2024).select("territory_id", "region_code", F.col("municipal_district_center_lat").alias("lat"), F.col("municipal_district_center_lon").alias("lon"))


def edges(spark: SparkSession, root: str) -> DataFrame:
    """A road graph on the territories: each is linked to the next, second and seventh one."""
    t = table(spark, root, "oktmo_reference").select("territory_id").distinct()
    link = t.select(F.col("territory_id").alias("x"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(7))).alias("k"))
    link = link.select("x", (F.col("x") + F.col("k")).alias("y"), ((F.col("x") * 7 + F.col("k") * 13) % 50 + 1).cast("double").alias("distance"))
    return link.join(t.withColumnRenamed("territory_id", "y"), "y", "left_semi").select("x", "y", "distance")


def national(spark: SparkSession, root: str) -> DataFrame:
    """National readings by month, whatever the notation of their period; a quarter stands for its first month."""
    n = table(spark, root, "national_series").where(F.col("value").isNotNull() & ~F.isnan("value"))
    n = n.withColumn("ds", F.trunc(flexible_date(F.col("period")), "MM")).where("ds is not null")
    return n.groupBy(F.col("series_key").alias("unique_id"), "slug", "ds").agg(F.avg("value").alias("y"))


def news(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "events")
    return e.select(F.col("event_type").alias("kind"), F.get_json_object("props", "$.k").try_cast("int").alias("class"), "value", F.to_date("ts").alias("added"), "user_id")


def numbered(panel_df: DataFrame) -> DataFrame:
    """Panel with the row position within its series."""
    return panel_df.withColumn("t", F.row_number().over(Window.partitionBy("unique_id").orderBy("ds")) - 1)


#: Added before rounding: values that are exact decimals would otherwise sit on a rounding tie, which two
#: engines break by their summation order.
NUDGE = 3.3e-7


def r4(*cols: str) -> list:
    """Columns rounded to four decimals, without ties and without a negative zero."""
    return [rounded(F.col(f"`{c}`")).alias(c) for c in cols]


def rounded(c):  # noqa: ANN001, ANN201
    return F.round(c + F.lit(NUDGE), 4) + F.lit(0.0)


def s4(*cols: str) -> str:
    return ", ".join(f"round({c}, 4) AS {c}" for c in cols)


def steady(sql: str) -> str:
    """Rewrite each ``round(x, 4)`` of a SQL text as ``r4`` rounds."""
    out, i = [], 0
    while (j := sql.find("round(", i)) >= 0:
        if j and (sql[j - 1].isalnum() or sql[j - 1] == "_"):
            out.append(sql[i : j + 6])
            i = j + 6
            continue
        depth, k = 1, j + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        inner = sql[j + 6 : k - 1]
        head, _, digits = inner.rpartition(",")
        out.append(sql[i:j] + (f"(round(({steady(head)}) + {NUDGE}, 4) + 0.0)" if digits.strip() == "4" else f"round({steady(inner)})"))
        i = k
    return "".join(out) + sql[i:]


def plain_nan(sql: str) -> str:
    """``isnan`` by text: the SQL engine folds the function away where a file's statistics leave NaN out."""
    return re.sub(r"isnan\(([^()]+)\)", r"coalesce(\1::VARCHAR LIKE '%nan', false)", sql)


class Registry:
    """Queries of a module by function name, with the SQL twin of those that have one."""

    def __init__(self) -> None:
        self.queries: dict = {}
        self.oracle: dict = {}

    def __call__(self, sql: str | None = None):  # noqa: ANN204
        def keep(f):  # noqa: ANN001, ANN202
            self.queries[f.__name__] = f
            if sql is not None:
                self.oracle[f.__name__] = plain_nan(steady(sql))
            return f

        return keep
