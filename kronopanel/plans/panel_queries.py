"""Queries on panel building, features and point-in-time joins, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kronopanel.functions.calendar_time import latest_published_month, published_on, step_of
from kronopanel.operators import features as X
from kronopanel.operators import panel as P
from kronopanel.plans.inputs import EDGES_SQL, MI, NATIONAL_SQL, NEWS_GROUPS, NEWS_SQL, PANEL_SQL, TERRITORY_SQL, Registry, edges, national, news, panel, r4, rounded, s4, territory
from kronopanel.session import table

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle


@query(f"WITH {PANEL_SQL} SELECT unique_id, ds, y FROM panel")
def panel_build(spark: SparkSession, root: str) -> DataFrame:
    return panel(spark, root).select("unique_id", "ds", "y")


@query("""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN t.territory_id IS NULL THEN 'unknown_territory'
  WHEN c.category IS NULL OR c.category NOT IN ('total', 'food', 'health', 'transport', 'catering', 'marketplaces') THEN 'unknown_category' WHEN c.value IS NULL THEN 'no_value' END AS reason
  FROM consumption c LEFT JOIN (SELECT DISTINCT territory_id FROM oktmo_reference) t ON c.territory_id = t.territory_id) WHERE reason IS NOT NULL GROUP BY 1""")
def panel_rejected_rows(spark: SparkSession, root: str) -> DataFrame:
    return P.rejected_rows(table(spark, root, "consumption"), table(spark, root, "oktmo_reference"))


@query(f"""WITH {PANEL_SQL}, g AS (SELECT {MI.format("max(ds)")} - {MI.format("min(ds)")} + 1 AS months FROM panel)
SELECT unique_id, count(*) AS n_obs, min(ds) AS first_ds, max(ds) AS last_ds, count(*) = any_value(months) AS is_complete, count(*) < {MI.format("max(ds)")} - {MI.format("min(ds)")} + 1 AS has_gaps FROM panel, g GROUP BY 1""")
def panel_flags(spark: SparkSession, root: str) -> DataFrame:
    return P.series_flags(panel(spark, root))


@query("""WITH c AS (SELECT territory_id::VARCHAR || '__' || category AS unique_id, (date || '-01')::DATE AS ds, value::DOUBLE AS y FROM consumption)
SELECT unnest(['nulls', 'negative', 'not_finite', 'not_month_start', 'duplicate_keys']) AS rule,
  unnest([(SELECT count(*) FROM c WHERE unique_id IS NULL OR ds IS NULL OR y IS NULL), (SELECT count(*) FROM c WHERE y < 0), (SELECT count(*) FROM c WHERE isnan(y) OR isinf(y)), (SELECT count(*) FROM c WHERE day(ds) <> 1),
  (SELECT count(*) - count(DISTINCT (unique_id, ds)) FROM c)]) AS n""")
def panel_contract_violations(spark: SparkSession, root: str) -> DataFrame:
    c = table(spark, root, "consumption").select(F.concat(F.col("territory_id").cast("string"), F.lit("__"), "category").alias("unique_id"), F.to_date(F.concat("date", F.lit("-01"))).alias("ds"), F.col("value").cast("double").alias("y"))
    return P.contract_violations(c)


@query(f"""WITH {PANEL_SQL}, level AS (SELECT territory_id, median(y) AS level FROM panel WHERE category = 'total' AND ds <= DATE '2023-12-01' GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY level, territory_id) AS rn, count(*) OVER () AS n FROM level)
SELECT territory_id, round(ln(level), 4) AS size_level, (CASE WHEN n = 1 THEN 1 ELSE greatest(1, ceil((rn - 1) * 5 / (n - 1)::DOUBLE)) END)::INT AS size_group FROM r""")
def static_size_group(spark: SparkSession, root: str) -> DataFrame:
    return P.size_groups(panel(spark, root), "2023-12-01").select("territory_id", *r4("size_level"), "size_group")


@query(f"""WITH {PANEL_SQL}, w AS (SELECT territory_id, ds, max(y) FILTER (category = 'total') AS total, max(y) FILTER (category = 'food') AS food, max(y) FILTER (category = 'health') AS health FROM panel GROUP BY 1, 2),
f AS (SELECT *, (food + health) / nullif(total, 0) AS ratio FROM w WHERE total IS NOT NULL AND food IS NOT NULL AND health IS NOT NULL)
SELECT count(*) AS n, round(median(ratio), 4) AS ratio_median, round(quantile_cont(ratio, 0.05), 4) AS ratio_p05, round(quantile_cont(ratio, 0.95), 4) AS ratio_p95,
  round(avg((ratio > 1)::INT), 4) AS share_sum_exceeds_total, round(avg((food <= total AND health <= total)::INT), 4) AS share_each_part_le_total FROM f""")
def panel_additivity(spark: SparkSession, root: str) -> DataFrame:
    out = P.partial_additivity(panel(spark, root), ["food", "health"])
    return out.select("n", *r4(*[c for c in out.columns if c != "n"]))


_LAGS_SQL = f"""WITH {PANEL_SQL}, p AS (SELECT unique_id, ds, y, {MI.format("ds")} AS mi FROM panel), w AS (SELECT *,
  {", ".join(f"max(y) OVER (PARTITION BY unique_id ORDER BY mi RANGE BETWEEN {k} PRECEDING AND {k} PRECEDING) / y AS lag_{k}" for k in X.LAGS)},
  {", ".join(f"avg(y) OVER (PARTITION BY unique_id ORDER BY mi RANGE BETWEEN {k - 1} PRECEDING AND CURRENT ROW) / y AS roll_mean_{k}, stddev_pop(y) OVER (PARTITION BY unique_id ORDER BY mi RANGE BETWEEN {k - 1} PRECEDING AND CURRENT ROW) / y AS roll_std_{k}" for k in X.WINDOWS)},
  count(y) OVER (PARTITION BY unique_id ORDER BY mi) AS n_history FROM p WHERE y > 0)"""


@query(_LAGS_SQL + f" SELECT unique_id, ds AS origin, y AS y_last, {s4(*[f'lag_{k}' for k in X.LAGS])}, n_history FROM w")
def lag_ratios(spark: SparkSession, root: str) -> DataFrame:
    return X.lag_features(panel(spark, root)).select("unique_id", "origin", "y_last", *r4(*[f"lag_{k}" for k in X.LAGS]), "n_history")


@query(_LAGS_SQL + f" SELECT unique_id, ds AS origin, {s4(*[f'roll_{a}_{k}' for k in X.WINDOWS for a in ('mean', 'std')])} FROM w")
def rolling_stats(spark: SparkSession, root: str) -> DataFrame:
    return X.lag_features(panel(spark, root)).select("unique_id", "origin", *r4(*[f"roll_{a}_{k}" for k in X.WINDOWS for a in ("mean", "std")]))


@query(_LAGS_SQL + f""", o AS (SELECT w.*, s.step, (w.ds + to_months(s.step::INT))::DATE AS target_ds FROM w, range(1, 4) s(step) WHERE n_history >= 7)
SELECT o.unique_id, o.ds AS origin, o.step, round(ln((p.y + 1) / (o.y + 1)), 4) AS target, {s4("lag_1", "lag_12")} FROM o JOIN panel p ON p.unique_id = o.unique_id AND p.ds = o.target_ds""")
def direct_features(spark: SparkSession, root: str) -> DataFrame:
    rows = X.direct_rows(panel(spark, root), 3)
    return rows.select("unique_id", "origin", F.col("step").cast("long").alias("step"), *r4("target", "lag_1", "lag_12"))


@query(f"""WITH {NATIONAL_SQL}, m AS (SELECT *, avg(y) OVER h AS a, count(*) OVER h AS n FROM national WINDOW h AS (PARTITION BY unique_id ORDER BY ds ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING)),
c AS (SELECT *, CASE WHEN n = 12 THEN a END AS ma12 FROM m), d AS (SELECT *, (ma12 + lead(ma12) OVER (PARTITION BY unique_id ORDER BY ds)) / 2 AS ma FROM c)
SELECT unique_id, ds, round(ma, 4) AS ma, round(y / nullif(ma, 0), 4) AS ratio FROM d""")
def centered_ma(spark: SparkSession, root: str) -> DataFrame:
    return X.ratio_to_moving_average(national(spark, root)).select("unique_id", "ds", *r4("ma", "ratio"))


_SEASON_SQL = f"""WITH {NATIONAL_SQL}, k AS (SELECT * FROM national WHERE ds <= DATE '2024-04-01'), m AS (SELECT *, avg(y) OVER h AS a, count(*) OVER h AS n FROM k WINDOW h AS (PARTITION BY unique_id ORDER BY ds ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING)),
c AS (SELECT *, CASE WHEN n = 12 THEN a END AS ma12 FROM m), d AS (SELECT *, y / nullif((ma12 + lead(ma12) OVER (PARTITION BY unique_id ORDER BY ds)) / 2, 0) AS ratio FROM c),
b AS (SELECT unique_id, month(ds) AS month, median(ratio) AS raw FROM d WHERE ratio IS NOT NULL GROUP BY ALL)"""


@query(_SEASON_SQL + ' SELECT unique_id, month::INT AS month, round(raw / avg(raw) OVER (PARTITION BY unique_id), 4) AS "index" FROM b')
def seasonal_index_as_of_origin(spark: SparkSession, root: str) -> DataFrame:
    return X.seasonal_index_as_of(national(spark, root), "unique_id", "2024-06-01", 35).select("unique_id", "month", *r4("index"))


_PSI_SQL = f"""WITH {PANEL_SQL}, p AS (SELECT *, count(y) OVER (PARTITION BY unique_id, year(ds)) AS n, avg(y) OVER (PARTITION BY unique_id, year(ds)) AS mean FROM panel),
b AS (SELECT category, month(ds)::INT AS month, median(y / nullif(mean, 0)) AS raw FROM p WHERE n = 12 GROUP BY ALL), i AS (SELECT category, month, raw / avg(raw) OVER (PARTITION BY category) AS idx FROM b)"""


@query(_PSI_SQL + ' SELECT category, month, round(idx, 4) AS "index" FROM i')
def panel_seasonal_profile(spark: SparkSession, root: str) -> DataFrame:
    return X.panel_seasonal_index(panel(spark, root)).select("category", "month", *r4("index"))


@query(_PSI_SQL + " SELECT category, round(max(idx) / min(idx), 4) AS amplitude FROM i GROUP BY 1")
def seasonal_amplitude(spark: SparkSession, root: str) -> DataFrame:
    return X.seasonal_amplitude(X.panel_seasonal_index(panel(spark, root))).select("category", *r4("amplitude"))


@query("""SELECT o::DATE AS origin, lag::INT AS lag, (SELECT max(p)::DATE FROM generate_series(DATE '2018-01-01', DATE '2025-12-01', INTERVAL 1 MONTH) g(p) WHERE last_day(p::DATE) + lag::INT <= last_day(o::DATE)) AS month
FROM generate_series(DATE '2023-01-01', DATE '2024-12-01', INTERVAL 1 MONTH) a(o), (VALUES (0), (7), (35), (45), (60)) v(lag)""")
def asof_published_month(spark: SparkSession, root: str) -> DataFrame:
    o = X.month_spine(spark, "2023-01-01", "2024-12-01").select(F.col("ds").alias("origin"), F.explode(F.array(*[F.lit(k) for k in (0, 7, 35, 45, 60)])).alias("lag"))
    return o.withColumn("month", latest_published_month(F.col("origin"), F.col("lag")))


_TOTALS = "t AS (SELECT ds, avg(y) AS total FROM panel WHERE category = 'total' GROUP BY 1), f AS (SELECT ds, avg(y) AS food FROM panel WHERE category = 'food' GROUP BY 1)"


def _monthly(spark: SparkSession, root: str) -> DataFrame:
    return panel(spark, root).groupBy("ds").agg(F.avg(F.when(F.col("category") == "total", F.col("y"))).alias("total"), F.avg(F.when(F.col("category") == "food", F.col("y"))).alias("food"))


@query(f"""WITH {PANEL_SQL}, {_TOTALS}, o AS (SELECT DISTINCT ds AS origin FROM panel)
SELECT origin, ds, round(total, 4) AS total FROM (SELECT o.origin, t.ds, t.total, row_number() OVER (PARTITION BY o.origin ORDER BY t.ds DESC) AS rn FROM o LEFT JOIN t ON last_day(t.ds) + 35 <= last_day(o.origin)) WHERE rn = 1""")
def asof_join(spark: SparkSession, root: str) -> DataFrame:
    m = _monthly(spark, root)
    out = X.as_of_origin(m.select("ds", "total"), m.select(F.col("ds").alias("origin")), 35)
    return out.select("origin", F.when(F.col("total").isNotNull(), F.col("ds")).alias("ds"), *r4("total"))


@query(f"""WITH {PANEL_SQL}, {_TOTALS}, o AS (SELECT DISTINCT ds AS origin FROM panel)
SELECT o.origin, round(t.total, 4) AS nat35__total, round(f.food, 4) AS nat60__food FROM o
LEFT JOIN t ON t.ds = (SELECT max(p.ds) FROM t p WHERE last_day(p.ds) + 35 <= last_day(o.origin)) LEFT JOIN f ON f.ds = (SELECT max(p.ds) FROM f p WHERE last_day(p.ds) + 60 <= last_day(o.origin))""")
def national_asof_multi_lag(spark: SparkSession, root: str) -> DataFrame:
    m = _monthly(spark, root)
    return X.as_of_many_lags(m, m.select(F.col("ds").alias("origin")), {"total": 35, "food": 60}).select("origin", *r4("nat35__total", "nat60__food"))


@query(f"""WITH {NATIONAL_SQL}, g AS (SELECT unique_id, ds, y, row_number() OVER w AS rn, y / nullif(lag(y) OVER w, 0) - 1 AS mom, y / nullif(lag(y, 12) OVER w, 0) - 1 AS yoy FROM national WINDOW w AS (PARTITION BY unique_id ORDER BY ds))
SELECT unique_id, ds, {s4("mom", "yoy")}, round(mom - lag(mom) OVER (PARTITION BY unique_id ORDER BY ds), 4) AS mom_change FROM g""")
def growth_mom_yoy(spark: SparkSession, root: str) -> DataFrame:
    return X.growth(national(spark, root)).select("unique_id", "ds", *r4("mom", "yoy", "mom_change"))


@query(f"""WITH {NATIONAL_SQL} SELECT ds AS month, round(avg(y) FILTER (slug = 'consumer-spending'), 4) AS ind_consumer, round(avg(y) FILTER (slug = 'wages-growth'), 4) AS ind_wages FROM national WHERE slug IN ('consumer-spending', 'wages-growth') GROUP BY 1""")
def pivot_indicator(spark: SparkSession, root: str) -> DataFrame:
    n = national(spark, root).where(F.col("slug").isin("consumer-spending", "wages-growth")).withColumnRenamed("y", "value").withColumnRenamed("ds", "month")
    out = X.pivot_indicator(n, "slug", ["consumer-spending", "wages-growth"], "ind_")
    return out.select("month", rounded(F.col("`ind_consumer-spending`")).alias("ind_consumer"), rounded(F.col("`ind_wages-growth`")).alias("ind_wages"))


_NEWS_AGG = "count(*) AS news_events, round(sum(value), 4) AS news_value, round(avg(value), 4) AS news_mean, round(min(value), 4) AS news_min, round(avg(coalesce(class = 4, false)::INT), 4) AS news_conflict_share, round(avg((kind IN ('purchase', 'refund'))::INT), 4) AS news_share_buying, round(avg((kind IN ('view', 'click'))::INT), 4) AS news_share_looking"


def _news_cols() -> list:
    return ["news_events", *r4("news_value", "news_mean", "news_min", "news_conflict_share", "news_share_buying", "news_share_looking")]


@query(f"WITH {NEWS_SQL} SELECT (user_id % 7)::INT AS region, added AS ds, {_NEWS_AGG} FROM news GROUP BY ALL")
def news_daily_features(spark: SparkSession, root: str) -> DataFrame:
    n = news(spark, root).withColumn("region", (F.col("user_id") % 7).cast("int")).withColumnRenamed("added", "ds").withColumn("added", F.col("ds"))
    return X.event_counts(n, ["region", "ds"], NEWS_GROUPS).select("region", "ds", *_news_cols())


@query(f"WITH {NEWS_SQL} SELECT date_trunc('week', added)::DATE AS ds, {_NEWS_AGG} FROM news WHERE added <= DATE '2024-01-20' GROUP BY ALL")
def news_country_features_at_cutoff(spark: SparkSession, root: str) -> DataFrame:
    n = news(spark, root).withColumn("ds", F.to_date(F.date_trunc("week", "added")))
    return X.event_counts(n, ["ds"], NEWS_GROUPS, cutoff=F.lit("2024-01-20").cast("date")).select("ds", *_news_cols())


@query("""WITH e AS (SELECT DISTINCT event_id, region_code FROM event_calendar), m AS (SELECT DISTINCT region_code FROM oktmo_reference)
SELECT count(*) AS n, count(*) FILTER (m.region_code IS NULL) AS unmapped, round(count(*) FILTER (m.region_code IS NULL) / nullif(count(*), 0), 4) AS share FROM e LEFT JOIN m USING (region_code) WHERE e.region_code IS NOT NULL""")
def news_unmapped_share(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "event_calendar").select("event_id", "region_code").distinct()
    return X.unmapped_share(e, "region_code", table(spark, root, "oktmo_reference")).select("n", "unmapped", *r4("share"))


@query(f"""WITH {NEWS_SQL}, d AS (SELECT user_id % 7 AS region, added AS ds, count(*) AS n FROM news GROUP BY ALL),
w AS (SELECT *, count(n) OVER b AS c, avg(n) OVER b AS m, stddev_samp(n) OVER b AS s FROM d WINDOW b AS (PARTITION BY region ORDER BY ds ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING))
SELECT region::INT AS region, ds, n, round(CASE WHEN c >= 2 THEN (n - m) / CASE WHEN s > 0 THEN s ELSE greatest(abs(m) * 0.1, 1e-9) END END, 4) AS n_z FROM w""")
def novelty_z(spark: SparkSession, root: str) -> DataFrame:
    d = news(spark, root).groupBy((F.col("user_id") % 7).cast("int").alias("region"), F.col("added").alias("ds")).agg(F.count("*").alias("n"))
    return X.novelty(d, "n", "region").select("region", "ds", "n", *r4("n_z"))


_KNOWN_SQL = """WITH e AS (SELECT DISTINCT event_id, coalesce(nullif(region_code, ''), 'all') AS scope, kind, date_trunc('month', coalesce(date, published_at))::DATE AS start, coalesce(published_at, date) AS pub FROM event_calendar),
r AS (SELECT DISTINCT region_code FROM oktmo_reference WHERE region_code IS NOT NULL), o AS (SELECT g::DATE AS origin FROM generate_series(DATE '2023-01-01', DATE '2024-12-01', INTERVAL 1 MONTH) t(g)),
k AS (SELECT r.region_code, o.origin, e.kind, max((e.start = o.origin)::INT) AS flag, max(power(0.5, date_diff('month', e.start, o.origin))) AS trace
  FROM r, o JOIN e ON date_trunc('month', e.pub)::DATE <= o.origin AND e.start <= o.origin WHERE e.kind IS NOT NULL AND (e.scope = 'all' OR e.scope = r.region_code) GROUP BY ALL)"""


def _known(spark: SparkSession, root: str) -> DataFrame:
    regions = table(spark, root, "oktmo_reference").where("region_code is not null").select("region_code").distinct()
    grid = regions.crossJoin(X.month_spine(spark, "2023-01-01", "2024-12-01").withColumnRenamed("ds", "origin"))
    return X.events_as_of(table(spark, root, "event_calendar"), grid)


@query(_KNOWN_SQL + " SELECT region_code, origin, kind FROM k WHERE flag = 1")
def events_known_at_origin(spark: SparkSession, root: str) -> DataFrame:
    return _known(spark, root).where("flag = 1").select("region_code", "origin", "kind")


@query(_KNOWN_SQL + " SELECT region_code, origin, kind, round(trace, 4) AS trace FROM k")
def event_decay(spark: SparkSession, root: str) -> DataFrame:
    return _known(spark, root).select("region_code", "origin", "kind", *r4("trace"))


_NN_SQL = EDGES_SQL + """, b AS (SELECT x, y, min(distance) AS distance FROM (SELECT x, y, distance FROM edges UNION ALL SELECT y, x, distance FROM edges) WHERE x <> y GROUP BY 1, 2),
nn AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY distance, y) AS rank FROM b QUALIFY rank <= 3)"""


@query(f"WITH {_NN_SQL} SELECT x, y, distance, rank::INT AS rank FROM nn")
def nearest_neighbours(spark: SparkSession, root: str) -> DataFrame:
    return X.nearest_neighbours(edges(spark, root), 3)


@query(f"""WITH {PANEL_SQL}, {_NN_SQL}, p AS (SELECT territory_id, category, ds, ln(y) AS l, {MI.format("ds")} AS mi FROM panel WHERE y > 0),
q AS (SELECT *, l - max(l) OVER (PARTITION BY territory_id, category ORDER BY mi RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS g1, l - max(l) OVER (PARTITION BY territory_id, category ORDER BY mi RANGE BETWEEN 3 PRECEDING AND 3 PRECEDING) AS g3 FROM p),
a AS (SELECT nn.x, q.category, q.ds, avg(q.l) AS nl, avg(q.g1) AS n1, avg(q.g3) AS n3 FROM nn JOIN q ON q.territory_id = nn.y GROUP BY ALL)
SELECT p.territory_id, p.category, p.ds, round(n1, 4) AS neighbour_growth_1, round(n3, 4) AS neighbour_growth_3, round(p.l - nl, 4) AS neighbour_gap FROM p JOIN a ON a.x = p.territory_id AND a.category = p.category AND a.ds = p.ds""")
def neighbour_features(spark: SparkSession, root: str) -> DataFrame:
    out = X.neighbour_features(panel(spark, root), X.nearest_neighbours(edges(spark, root), 3))
    return out.select("territory_id", "category", "ds", *r4("neighbour_growth_1", "neighbour_growth_3", "neighbour_gap"))


@query(f"""WITH {_NN_SQL}, t AS (SELECT DISTINCT territory_id FROM oktmo_reference), d AS (SELECT x, avg(distance) AS m FROM nn GROUP BY 1)
SELECT territory_id, CASE WHEN territory_id % 5 > 0 THEN round(ln((territory_id % 5) * 10), 4) END AS log_access, round(ln(1 + m), 4) AS log_distance FROM t LEFT JOIN d ON d.x = t.territory_id""")
def access_features(spark: SparkSession, root: str) -> DataFrame:
    t = table(spark, root, "oktmo_reference").select("territory_id").distinct()
    index = t.select("territory_id", ((F.col("territory_id") % 5) * 10.0).alias("access"))
    return X.access_features(t, index, X.nearest_neighbours(edges(spark, root), 3)).select("territory_id", *r4("log_access", "log_distance"))


_CELL = "floor(lat / 0.5 + 0.5) * 0.5 AS cell_lat, ((floor((lon + 180) / 0.625 + 0.5)::BIGINT % 576) + 576) % 576 * 0.625 - 180 AS cell_lon"


@query(f"WITH {TERRITORY_SQL} SELECT territory_id, {_CELL} FROM territory WHERE lat IS NOT NULL AND lon IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lon)")
def grid_cells(spark: SparkSession, root: str) -> DataFrame:
    t = territory(spark, root).where("lat is not null and lon is not null and not isnan(lat) and not isnan(lon)")
    lat, lon = X.grid_cell(F.col("lat"), F.col("lon"))
    return t.select("territory_id", lat.alias("cell_lat"), lon.alias("cell_lon"))


_WEATHER_SQL = "weather AS (SELECT region_code AS cell, ds, avg(value) AS t FROM exog_block WHERE block = 'weather' AND ds IS NOT NULL AND value IS NOT NULL AND region_code IS NOT NULL GROUP BY ALL), norm AS (SELECT cell, month(ds) AS moy, avg(t) AS norm FROM weather WHERE year(ds) BETWEEN 2022 AND 2023 GROUP BY ALL)"


def _weather(spark: SparkSession, root: str) -> DataFrame:
    w = table(spark, root, "exog_block").where("block = 'weather' and ds is not null and value is not null and region_code is not null")
    return w.groupBy(F.col("region_code").alias("cell"), "ds").agg(F.avg("value").alias("t"))


@query(f"""WITH {_WEATHER_SQL}, a AS (SELECT w.cell, w.ds, w.t - n.norm AS anomaly FROM weather w LEFT JOIN norm n ON n.cell = w.cell AND n.moy = month(w.ds))
SELECT cell, ds, round(anomaly, 4) AS anomaly, round(avg(anomaly) OVER (PARTITION BY cell ORDER BY ds ROWS 2 PRECEDING), 4) AS anomaly_3 FROM a""")
def weather_anomaly(spark: SparkSession, root: str) -> DataFrame:
    a = X.with_norms(_weather(spark, root), "t", 2022, 2023)
    return X.rolling_mean(a, "anomaly", "cell").select("cell", "ds", *r4("anomaly", "anomaly_3"))


@query(f"WITH {_WEATHER_SQL} SELECT cell, g::DATE AS ds, round(norm, 4) AS norm FROM generate_series(DATE '2025-01-01', DATE '2025-12-01', INTERVAL 1 MONTH) s(g) JOIN norm ON moy = month(g)")
def climate_norms(spark: SparkSession, root: str) -> DataFrame:
    return X.climate_norms(_weather(spark, root), "t", X.month_spine(spark, "2025-01-01", "2025-12-01"), 2022, 2023).select("cell", "ds", *r4("norm"))


@query("""SELECT g::DATE AS ds, round(sin(2 * pi() * month(g) / 12), 4) AS month_sin, round(cos(2 * pi() * month(g) / 12), 4) AS month_cos, day(last_day(g::DATE))::INT AS days_in_month,
 (month(g) IN (3, 11))::INT AS is_sales_month, (month(g) = 12)::INT AS is_december, (month(g) = 1)::INT AS is_january FROM generate_series(DATE '2023-01-01', DATE '2025-12-01', INTERVAL 1 MONTH) s(g)""")
def calendar_features(spark: SparkSession, root: str) -> DataFrame:
    out = X.calendar_features(X.month_spine(spark, "2023-01-01", "2025-12-01"))
    return out.select("ds", *r4("month_sin", "month_cos"), "days_in_month", "is_sales_month", "is_december", "is_january")


@query(f"WITH {PANEL_SQL} SELECT unique_id, g::DATE AS ds FROM (SELECT unique_id, min(ds) AS a, max(ds) AS b FROM panel GROUP BY 1), generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 MONTH) s(g) ANTI JOIN panel p ON p.unique_id = unique_id AND p.ds = g::DATE".replace("ANTI JOIN panel p ON p.unique_id = unique_id AND p.ds = g::DATE", "WHERE (unique_id, g::DATE) NOT IN (SELECT (unique_id, ds) FROM panel)"))
def month_spine_gaps(spark: SparkSession, root: str) -> DataFrame:
    """Months missing inside each series."""
    p = panel(spark, root)
    spine = p.groupBy("unique_id").agg(F.explode(F.sequence(F.min("ds"), F.max("ds"), F.expr("interval 1 month"))).alias("ds"))
    return spine.join(p, ["unique_id", "ds"], "left_anti")


@query("""WITH m(year, month, days) AS (VALUES (2024, 1, '1,2,3,4,5,6,7,8,13,14,20,21,27,28'), (2024, 2, '3,4,10,11,17,18,22*,23,24,25'), (2024, 11, '2*,3,4,9,10,16,17,23,24,30'), (2024, 12, '1,7,8,14,15,21,22,29,30+,31+')),
t AS (SELECT year, month, unnest(string_split(days, ',')) AS d FROM m) SELECT make_date(year, month, 1) AS ds, count(*) FILTER (d NOT LIKE '%*')::INT AS days_off, count(*) FILTER (d LIKE '%*')::INT AS short_days, count(*) FILTER (d LIKE '%+')::INT AS moved_days,
 (day(last_day(make_date(year, month, 1))) - count(*) FILTER (d NOT LIKE '%*'))::INT AS working_days FROM t GROUP BY year, month""")
def calendar_day_tokens(spark: SparkSession, root: str) -> DataFrame:
    rows = [(2024, 1, "1,2,3,4,5,6,7,8,13,14,20,21,27,28"), (2024, 2, "3,4,10,11,17,18,22*,23,24,25"), (2024, 11, "2*,3,4,9,10,16,17,23,24,30"), (2024, 12, "1,7,8,14,15,21,22,29,30+,31+")]
    return X.parse_day_tokens(spark.createDataFrame(rows, "year int, month int, days string"))


@query("SELECT DISTINCT ds, (split_part(fold, '_', 2) || '-01')::DATE AS cutoff, ((year(ds) - split_part(split_part(fold, '_', 2), '-', 1)::INT) * 12 + month(ds) - split_part(fold, '-', 2)::INT)::INT AS step, (last_day(ds) + 35)::DATE AS published FROM oof_old WHERE fold IS NOT NULL AND ds IS NOT NULL")
def steps_and_publication(spark: SparkSession, root: str) -> DataFrame:
    o = table(spark, root, "oof_old").where("fold is not null and ds is not null").select("ds", F.to_date(F.concat(F.split_part("fold", F.lit("_"), F.lit(2)), F.lit("-01"))).alias("cutoff")).distinct()
    return o.select("ds", "cutoff", step_of(F.col("ds"), F.col("cutoff")).alias("step"), published_on(F.col("ds"), 35).alias("published"))


# -- national indicators ------------------------------------------------------------------------------

from kronopanel.operators import national as N  # noqa: E402
from kronopanel.plans.inputs import PERIOD_SQL  # noqa: E402

INDICATORS = (
    N.Indicator("consumer-spending", "nat_spending", ("type",), "growth"), N.Indicator("wages-growth", "nat_growth", ("type", "value_type")), N.Indicator("index-sa", "nat_index_sa", ("type",)),
    N.Indicator("wages-median", "wages", (), "growth", 60), N.Indicator("turnover-raw", "business", (), "growth", 45), N.Indicator("payroll-sa", "payroll", (), "growth", 60),
    N.Indicator("rate-raw", "key_rate", ("value_type",), "level", N.WEEKLY_LAG), N.Indicator("inflation-sa", "infl", ("type",), "level", N.WEEKLY_LAG),
    N.Indicator("wages-weekly", "weekly_spend", ("type",), "change", N.WEEKLY_LAG), N.Indicator("activity-age", "activity_index", ("type",)),
)


def _key_sql(dims: tuple[str, ...]) -> str:
    joined = " || '|' || ".join(f"coalesce({d}, 'none')" for d in dims)
    return f"left(trim(regexp_replace(translate(lower({joined}), 'абвгдеёжзийклмнопрстуфхцчшщъыьэюя', 'abvgdeejzijklmnoprstufhccss_y_eua'), '[^0-9a-z]', '_', 'g'), '_'), 40)"


_SOURCES_SQL = " UNION ALL ".join(
    f"SELECT {i} AS i, '{s.slug}' AS source, {s.lag} AS lag, '{s.mode}' AS mode, " + (f"'{s.prefix}_' || {_key_sql(s.dims)}" if s.dims else f"'{s.prefix}'") + f" AS feature, ds, value FROM rd WHERE slug = '{s.slug}'" for i, s in enumerate(INDICATORS)
)
_PARTS_SQL = f"""rd AS (SELECT *, date_trunc('month', {PERIOD_SQL.format("trim(period)")})::DATE AS ds FROM national_series WHERE value IS NOT NULL AND NOT isnan(value)), nm AS ({_SOURCES_SQL}),
mo AS (SELECT i, source, lag, mode, feature, ds, avg(value) AS value FROM nm WHERE ds IS NOT NULL GROUP BY ALL),
gr AS (SELECT g.*, m.value FROM (SELECT * FROM (SELECT DISTINCT i, source, lag, mode, feature FROM mo WHERE mode <> 'level') JOIN (SELECT DISTINCT i, ds FROM mo) USING (i)) g LEFT JOIN mo m USING (i, feature, ds)),
fi AS (SELECT *, last_value(value IGNORE NULLS) OVER (PARTITION BY i, feature ORDER BY ds) AS f FROM gr),
dv AS (SELECT *, f / nullif(lag(f) OVER w, 0) - 1 AS mom, f / nullif(lag(f, 12) OVER w, 0) - 1 AS yoy, value - lag(value) OVER w AS accel FROM fi WINDOW w AS (PARTITION BY i, feature ORDER BY ds)),
parts AS (SELECT source, lag, feature, ds, value FROM mo WHERE mode <> 'growth' UNION ALL SELECT source, lag, feature || '_mom', ds, mom FROM dv WHERE mode = 'growth' UNION ALL SELECT source, lag, feature || '_yoy', ds, yoy FROM dv WHERE mode = 'growth' UNION ALL SELECT source, lag, feature || '_accel', ds, accel FROM dv WHERE mode = 'change')"""


def _indicators(spark: SparkSession, root: str) -> DataFrame:
    from kronopanel.functions.calendar_time import flexible_date

    r = table(spark, root, "national_series").withColumn("ds", flexible_date(F.col("period")))
    return N.indicator_values(r, INDICATORS)


@query(f"WITH {_PARTS_SQL} SELECT source, lag::INT AS lag, feature, ds, round(value, 4) AS value FROM parts WHERE value IS NOT NULL")
def national_parts(spark: SparkSession, root: str) -> DataFrame:
    """Monthly features of ten national sources: levels, growth, changes."""
    return _indicators(spark, root).select("source", "lag", "feature", "ds", *r4("value"))


@query(f"""WITH {_PARTS_SQL}, og AS (SELECT g::DATE AS origin FROM generate_series(DATE '2023-06-01', DATE '2024-12-01', INTERVAL 1 MONTH) s(g)), lg AS (SELECT DISTINCT lag, feature FROM parts WHERE value IS NOT NULL),
ok AS (SELECT origin, lag, (date_trunc('month', last_day(origin) - lag::INT + 1) - INTERVAL 1 MONTH)::DATE AS ds FROM og, (SELECT DISTINCT lag FROM lg)), pv AS (SELECT lag, feature, ds, avg(value) AS value FROM parts WHERE value IS NOT NULL GROUP BY ALL)
SELECT origin, 'nat' || ok.lag || '__' || lg.feature AS feature, round(pv.value, 4) AS value FROM ok JOIN lg USING (lag) JOIN pv ON pv.lag = ok.lag AND pv.feature = lg.feature AND pv.ds = ok.ds""")
def national_known(spark: SparkSession, root: str) -> DataFrame:
    """Every national feature as known at the end of each origin month, by the lag of its source."""
    origins = X.month_spine(spark, "2023-06-01", "2024-12-01").withColumnRenamed("ds", "origin")
    wide = N.national_as_of(N.national_groups(_indicators(spark, root)), origins)
    cols = [c for c in wide.columns if c != "origin"]
    return wide.unpivot(["origin"], cols, "feature", "value").where("value is not null").select("origin", "feature", *r4("value"))


@query(f"""WITH {PANEL_SQL}, p0 AS (SELECT *, count(y) OVER (PARTITION BY unique_id, year(ds)) AS n, avg(y) OVER (PARTITION BY unique_id, year(ds)) AS mean FROM panel), b AS (SELECT category, month(ds) AS month, median(y / nullif(mean, 0)) AS raw FROM p0 WHERE n = 12 GROUP BY ALL),
i AS (SELECT category, month, raw / avg(raw) OVER (PARTITION BY category) AS s FROM b), u AS (SELECT unique_id, min(category) AS category FROM panel WHERE ds <= DATE '2024-06-01' GROUP BY 1), f AS (SELECT u.*, g::DATE AS ds FROM u, generate_series(DATE '2024-07-01', DATE '2024-12-01', INTERVAL 1 MONTH) s(g))
SELECT unique_id, ds, round(sin(2 * pi() * month(ds) / 12), 4) AS month_sin, round(cos(2 * pi() * month(ds) / 12), 4) AS month_cos, round(coalesce(s, 1.0), 4) AS seasonal_index FROM f LEFT JOIN i ON i.category = f.category AND i.month = month(ds)""")
def future_covariates(spark: SparkSession, root: str) -> DataFrame:
    """Known-future covariates of the six months after a cutoff."""
    p = panel(spark, root)
    return N.covariates(N.future_rows(p, "2024-06-01", 6), X.panel_seasonal_index(p)).select("unique_id", "ds", *r4("month_sin", "month_cos", "seasonal_index"))
