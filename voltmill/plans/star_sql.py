"""DuckDB definitions that the oracles share: calendar, slots and daily evidence."""

DAILY = """SELECT station_key, date_key, CAST(sum(o) AS BIGINT) AS observation_count, CAST(sum(rep) AS BIGINT) AS report_count, count(rating) AS review_count,
  CAST(sum(a) AS BIGINT) AS available_count, CAST(sum(b) AS BIGINT) AS busy_count, CAST(sum(x) AS BIGINT) AS broken_count,
  sum(a)::DOUBLE / nullif(sum(o), 0) AS availability_ratio, sum(b)::DOUBLE / nullif(sum(o), 0) AS busy_ratio, sum(x)::DOUBLE / nullif(sum(o), 0) AS broken_ratio,
  avg(q) AS avg_queue_score, max(q) AS peak_queue_score, avg(rating) AS avg_rating, avg(f) AS data_completeness_score, count(DISTINCT source_key) AS source_count,
  'cold' AS maturity, true AS has_evidence
FROM (
  SELECT station_key, date_key, 1 AS o, 0 AS rep, CAST(NULL AS INT) AS rating, CAST(availability_status = 'available' AS INT) AS a, CAST(availability_status = 'busy' AS INT) AS b,
    CAST(availability_status = 'broken' AS INT) AS x, CASE queue_level WHEN 'none' THEN 0.0::DOUBLE WHEN 'short' THEN 0.33::DOUBLE WHEN 'medium' THEN 0.66::DOUBLE WHEN 'long' THEN 1.0::DOUBLE END AS q,
    CAST(availability_status <> 'unknown' AND queue_level <> 'unknown' AND total_connectors > 0 AS INT) AS f, source_key FROM fact_observation
  UNION ALL SELECT station_key, date_key, 0, 1, NULL, 0, 0, 0, NULL, NULL, NULL FROM fact_report
  UNION ALL SELECT station_key, date_key, 0, 0, rating, 0, 0, 0, NULL, NULL, NULL FROM fact_review
) GROUP BY station_key, date_key"""

DIM_DATE = """SELECT CAST(strftime(d, '%Y%m%d') AS INT) AS date_key, CAST(d AS DATE) AS full_date, CAST(year(d) AS INT) AS year, CAST(quarter(d) AS INT) AS quarter, CAST(month(d) AS INT) AS month,
  monthname(d) AS month_name, CAST(week(d) AS INT) AS week, CAST(day(d) AS INT) AS day, CAST(isodow(d) AS INT) AS day_of_week, dayname(d) AS day_name, isodow(d) >= 6 AS is_weekend
FROM generate_series(DATE '2024-01-01', DATE '2032-12-31', INTERVAL 1 DAY) t(d)"""

DIM_TIME = """SELECT CAST(i AS INT) AS time_key, printf('%02d:%02d', i // 4, (i % 4) * 15) AS slot_15min, CAST(i // 4 AS INT) AS hour, CAST((i % 4) * 15 AS INT) AS minute,
  CASE WHEN i // 4 < 6 THEN 'night' WHEN i // 4 < 12 THEN 'morning' WHEN i // 4 < 18 THEN 'afternoon' ELSE 'evening' END AS day_part FROM range(96) t(i)"""

CTES = {"fact_daily": DAILY, "dim_date": DIM_DATE, "dim_time": DIM_TIME}
