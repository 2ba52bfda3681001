"""DuckDB oracle SQL, one statement per registered key.

Each statement rebuilds the logical views from the raw tables with the same
binding expressions as the Spark side (``duck_with``) and then states the
metric in plain SQL.  Column names and types are aligned with the Spark
output (counts BIGINT, measures DOUBLE, money sums exact DECIMAL).
"""

from __future__ import annotations

import datetime as _dt

from clinops.functions.labels import CATEGORY_LABELS, STATUS_LABELS, VALUE_LABELS
from clinops.operators import ledger as _ledger
from clinops.operators.metrics import _month_start
from clinops.operators.profile import KPI_CARDS, KPI_PLACEHOLDER
from clinops.sources.tables import (
    OPS_AS_OF, OPS_TABLES, PG_TABLES, VIEWS, WEAR_AS_OF_TS, duck_view_sql, duck_with, view_as_of,
)

ORACLE: dict[str, str] = {}


def _reg(key: str, sql: str) -> None:
    ORACLE[key] = sql


def _ts(d) -> str:
    if isinstance(d, _dt.datetime):
        return f"TIMESTAMP '{d.strftime('%Y-%m-%d %H:%M:%S')}'"
    return f"TIMESTAMP '{d.strftime('%Y-%m-%d')} 00:00:00'"


def _d(d) -> str:
    if isinstance(d, _dt.datetime):
        d = d.date()
    return f"DATE '{d.isoformat()}'"


A = OPS_AS_OF
W = WEAR_AS_OF_TS

# ---- operations metrics ----------------------------------------------------
_SPINE12 = _month_start(A, 11)
_reg("timeline", duck_with("treatments") + f"""
, spine AS (
  SELECT CAST(i AS INTEGER) AS month_idx, {_d(_SPINE12)} + to_months(CAST(i AS INTEGER)) AS m FROM range(12) t(i))
, counts AS (
  SELECT strftime(treatment_date, '%Y-%m') AS month, count(*) AS c
  FROM treatments WHERE treatment_date >= {_ts(_SPINE12)} GROUP BY 1)
SELECT s.month_idx, strftime(s.m, '%Y-%m') AS month,
       CAST(year(s.m) % 100 AS VARCHAR) || '년 ' || CAST(month(s.m) AS VARCHAR) || '월' AS label,
       CAST(coalesce(c.c, 0) AS DOUBLE) AS value
FROM spine s LEFT JOIN counts c ON c.month = strftime(s.m, '%Y-%m')
""")

_reg("gauge", duck_with("treatments") + f"""
SELECT current, CAST(greatest(30000, floor(CAST(current AS DOUBLE) * 1.15::DOUBLE) + 5000) AS BIGINT) AS max_value,
       '금년 진료 헤더 건수' AS title
FROM (SELECT count(*) AS current FROM treatments
      WHERE treatment_date >= {_ts(_dt.date(A.year, 1, 1))} AND treatment_date < {_ts(_dt.date(A.year + 1, 1, 1))})
""")

_MIX = """
SELECT CASE bucket WHEN 'OUTPATIENT' THEN '외래' WHEN 'INPATIENT' THEN '입원' WHEN 'EMERGENCY' THEN '응급'
                   ELSE bucket END AS name, CAST(c AS DOUBLE) AS value
FROM (SELECT coalesce(nullif(trim(treatment_type), ''), '미분류') AS bucket, count(*) AS c
      FROM treatments GROUP BY 1)
"""
_reg("treatment_mix", duck_with("treatments") + _MIX)
_reg("treatment_mix_share", duck_with("treatments") + f"""
, mix AS ({_MIX})
SELECT name, value, sum(value) OVER () AS total, round_even(value * 100.0 / sum(value) OVER (), 2) AS pct FROM mix
""")

_DEPT_COUNTS = """
, dc AS (
  SELECT t.department_id, d.department_name, count(t.treatment_id) AS c
  FROM (SELECT department_id, treatment_id FROM treatments WHERE department_id IS NOT NULL) t
  JOIN department d ON d.id = t.department_id
  GROUP BY t.department_id, d.department_name)
"""
_reg("production_top", duck_with("department", "treatments") + _DEPT_COUNTS + """
, top AS (SELECT CAST(row_number() OVER (ORDER BY c DESC, department_id) AS INTEGER) AS rank,
                 department_id, substr(department_name, 1, 24) AS category, CAST(c AS DOUBLE) AS value
          FROM dc ORDER BY c DESC, department_id LIMIT 3)
SELECT * FROM top
UNION ALL
SELECT 1, CAST(NULL AS BIGINT), '데이터 없음', 0.0::DOUBLE WHERE NOT EXISTS (SELECT 1 FROM top)
""")

_L6 = _month_start(A, 5)
_LEAGUE = _DEPT_COUNTS + f"""
, top AS (SELECT CAST(row_number() OVER (ORDER BY c DESC, department_id) AS INTEGER) AS rank, department_id,
                 department_name, c FROM dc ORDER BY c DESC, department_id LIMIT 5)
, months AS (SELECT CAST(i AS INTEGER) AS month_idx, strftime({_d(_L6)} + to_months(CAST(i AS INTEGER)), '%Y-%m') AS month
             FROM range(6) t(i))
, mc AS (SELECT department_id, strftime(treatment_date, '%Y-%m') AS month, count(*) AS mc FROM treatments
         WHERE treatment_date >= {_ts(_L6)} AND department_id IN (SELECT department_id FROM top) GROUP BY 1, 2)
, series AS (SELECT t.rank, t.department_id, t.department_name, t.c, m.month_idx,
                    CAST(coalesce(mc.mc, 0) AS DOUBLE) AS v,
                    sum(CAST(coalesce(mc.mc, 0) AS DOUBLE)) OVER (PARTITION BY t.department_id) AS tot
             FROM top t JOIN months m ON TRUE
             LEFT JOIN mc ON mc.department_id = t.department_id AND mc.month = m.month)
, rows AS (SELECT rank, department_id, substr(department_name, 1, 32) AS name,
                  CAST(c AS DOUBLE) * 150000.0::DOUBLE AS actual,
                  CASE WHEN CAST(c AS DOUBLE) * 150000.0::DOUBLE > 0
                       THEN CAST(c AS DOUBLE) * 150000.0::DOUBLE * 1.08::DOUBLE ELSE 250000.0::DOUBLE END AS target,
                  month_idx,
                  CASE WHEN tot = 0 THEN greatest(1.0::DOUBLE, CAST(c AS DOUBLE) / 6.0) ELSE v END AS spark_value
           FROM series)
"""
_reg("league_table", duck_with("department", "treatments") + _LEAGUE + """
SELECT rank, department_id, name, actual, target, month_idx, spark_value FROM rows
""")
_reg("league_ranked", duck_with("department", "treatments") + _LEAGUE + """
SELECT rank, department_id, name, actual, target, greatest(max(spark_value), 1.0) * 0.9::DOUBLE AS target_line
FROM rows GROUP BY rank, department_id, name, actual, target
""")

_reg("kpi_revenue", duck_with("examination_schedule", "examination") + """
, rev AS (SELECT sum(e.examination_price * s.n) AS rev
          FROM (SELECT examination_id, count(*) AS n FROM examination_schedule GROUP BY 1) s
          JOIN examination e ON e.examination_id = s.examination_id)
SELECT CAST(greatest(coalesce(rev, 0), 0) AS DOUBLE) AS actual,
       CAST(round_even(CAST(greatest(coalesce(rev, 0), 0) AS DECIMAL(38,2)) * 1.025::DECIMAL(4,3), 2) AS DOUBLE) AS target,
       '검사 일정과 검사 단가로 잡은 추정 매출' AS label
FROM rev
""")

_D30, _D60 = A - _dt.timedelta(days=30), A - _dt.timedelta(days=60)
_reg("kpi_growth", duck_with("treatments") + f"""
, c AS (SELECT count(*) FILTER (WHERE treatment_date >= {_ts(_D30)}) AS r30,
               count(*) FILTER (WHERE treatment_date < {_ts(_D30)}) AS p30
        FROM treatments WHERE treatment_date >= {_ts(_D60)})
, g AS (SELECT r30, p30, CASE WHEN p30 <= 0 THEN CASE WHEN r30 > 0 THEN 4.0 ELSE 0.0 END
                        ELSE round_even(CAST(r30 - p30 AS DOUBLE) / CAST(p30 AS DOUBLE) * 100.0, 1) END::DOUBLE AS growth_pct
        FROM c)
SELECT r30, p30, growth_pct, CASE WHEN growth_pct >= 0 THEN 'up' ELSE 'down' END AS direction,
       abs(growth_pct) AS magnitude FROM g
""")


# ---------------------------------------------------------------------------
# SQL mirrors of the column functions (DuckDB dialect)
# ---------------------------------------------------------------------------

FMT_TS = "'%Y년 %-m월 %-d일 %H:%M'"
FMT_D = "'%Y년 %-m월 %-d일'"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def s_strip(x):
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def s_name(x):
    v = s_strip(x)
    return (f"(CASE WHEN {v} = '' THEN {x} WHEN length({v}) = 1 THEN {v} || '*' "
            f"ELSE substr({v}, 1, 1) || repeat('*', CAST(length({v}) - 1 AS INTEGER)) END)")


def s_rrn(x):
    v = s_strip(x)
    return (f"(CASE WHEN {v} = '' THEN {x} WHEN length({v}) >= 8 THEN substr({v}, 1, 8) || '******' "
            f"ELSE substr({v}, 1, 1) || '******' END)")


def s_text(x):
    v = s_strip(x)
    return (f"(CASE WHEN {v} = '' THEN {x} WHEN length({v}) <= 2 THEN substr({v}, 1, 1) || '*' "
            f"ELSE substr({v}, 1, 2) || repeat('*', CAST(length({v}) - 2 AS INTEGER)) END)")


def s_email(x):
    v = s_strip(x)
    local, dom = f"split_part({v}, '@', 1)", f"substr({v}, instr({v}, '@') + 1)"
    return (f"(CASE WHEN instr({v}, '@') = 0 THEN {s_name(v)} WHEN {local} = '' THEN '***@' || {dom} "
            f"ELSE substr({local}, 1, 1) || '***@' || {dom} END)")


def s_phone(x):
    v = s_strip(x)
    return (f"(CASE WHEN length({v}) <= 4 THEN repeat('*', CAST(length({v}) AS INTEGER)) "
            f"ELSE substr({v}, 1, 3) || '****' || right({v}, 4) END)")


def s_address(x):
    return f"(CASE WHEN {x} = '' THEN {x} ELSE substr({x}, 1, 2) || '***' END)"


def s_id(x):
    s = f"CAST({x} AS VARCHAR)"
    return f"(CASE WHEN {x} IS NULL THEN NULL WHEN length({s}) >= 2 THEN '***' || right({s}, 2) ELSE '***' END)"


def s_numid(x):
    s = s_strip(f"CAST({x} AS VARCHAR)")
    return f"(CASE WHEN {s} IS NULL OR {s} = '' THEN NULL WHEN length({s}) >= 2 THEN '***' || right({s}, 2) ELSE '***' END)"


def s_wtext(x):
    return f"(CASE WHEN {x} != '' THEN {s_text(x)} ELSE {x} END)"


def s_sha(x):
    return f"sha256(CAST({x} AS VARCHAR))"


def s_case(expr, mapping: dict) -> str:
    whens = " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in mapping.items())
    return f"(CASE {expr} {whens} END)"


def s_status(x):
    s = s_strip(f"CAST({x} AS VARCHAR)")
    return f"(CASE WHEN {s} IS NULL OR {s} = '' THEN NULL ELSE coalesce({s_case(f'upper({s})', STATUS_LABELS)}, {s}) END)"


def s_category(x):
    s = s_strip(f"coalesce(CAST({x} AS VARCHAR), '')")
    return f"(CASE WHEN {s} = '' THEN '기타' ELSE coalesce({s_case(f'upper({s})', CATEGORY_LABELS)}, {s}) END)"


def s_translate(x, col):
    s = f"CAST({x} AS VARCHAR)"
    empty = "'본원'" if col == "intt_cd" else "'없음'"
    return (f"(CASE WHEN {s} IS NULL OR {s} = '' THEN {empty} ELSE coalesce("
            f"{s_case(f'upper({s})', VALUE_LABELS)}, {s_case(s, VALUE_LABELS)}, {s}) END)")


def s_fmt_ts(x):
    return f"strftime({x}, {FMT_TS})"


def s_fmt_d(x):
    return f"strftime({x}, {FMT_D})"


def s_dec_display(x):
    return (f"(CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS DECIMAL(38,0)) AS VARCHAR) "
            f"ELSE CAST(CAST({x} AS DOUBLE) AS VARCHAR) END)")


def s_or_default(x, d):
    return f"coalesce(CASE WHEN CAST({x} AS VARCHAR) != '' THEN {x} END, {d})"


# ---- masking / labels / display -------------------------------------------
_reg("mask_customers", duck_with("Patient") + f"""
SELECT {s_id('patient_no')} AS patient_no, {s_name('patient_name')} AS patient_name, patient_gender,
       patient_foreign, created_date, intt_cd,
       {s_sha('patient_no')} AS patient_no_sha256, {s_sha('patient_name')} AS patient_name_sha256
FROM "Patient"
""")

_reg("mask_contact", duck_with("Patient") + f"""
SELECT {s_id('patient_no')} AS patient_no, {s_rrn('patient_rrn')} AS patient_rrn,
       {s_email('patient_email')} AS patient_email, {s_phone('patient_tel')} AS patient_tel,
       {s_address('patient_address')} AS patient_address,
       CASE WHEN patient_passport IS NOT NULL THEN '********' END AS patient_passport,
       patient_birth, CASE WHEN patient_birth IS NOT NULL THEN '****-**-**' END AS patient_birth_text,
       {s_sha('patient_no')} AS patient_no_sha256, {s_sha('patient_rrn')} AS patient_rrn_sha256,
       {s_sha('patient_email')} AS patient_email_sha256, {s_sha('patient_tel')} AS patient_tel_sha256,
       {s_sha('patient_address')} AS patient_address_sha256, {s_sha('patient_passport')} AS patient_passport_sha256
FROM "Patient"
""")

_reg("mask_ids", duck_with("treatments") + f"""
SELECT treatment_id, {s_id('patient_no')} AS patient_no, {s_id('treatment_doc')} AS treatment_doc, department_id,
       {s_sha('patient_no')} AS patient_no_sha256, {s_sha('treatment_doc')} AS treatment_doc_sha256
FROM treatments
""")

_reg("mask_text_columns", duck_with("treatments") + f"""
, t AS (SELECT treatment_id, treatment_comment, 'C-' || CAST(treatment_id AS VARCHAR) AS certificate_number,
               treatment_dept AS prescription_memo, treatment_type AS clinical_findings FROM treatments)
SELECT treatment_id, {s_text('treatment_comment')} AS treatment_comment,
       {s_text('certificate_number')} AS certificate_number, {s_text('prescription_memo')} AS prescription_memo,
       {s_text('clinical_findings')} AS clinical_findings,
       {s_sha('treatment_comment')} AS treatment_comment_sha256, {s_sha('certificate_number')} AS certificate_number_sha256,
       {s_sha('prescription_memo')} AS prescription_memo_sha256, {s_sha('clinical_findings')} AS clinical_findings_sha256
FROM t
""")

_reg("mask_events", duck_with("patient_clinical_event") + f"""
SELECT {s_numid('clinical_event_id')} AS clinical_event_id, {s_id('patient_no')} AS patient_no, category, occurred_on,
       {s_wtext('department')} AS department, {s_wtext('title')} AS title, summary, status, institution_name,
       {s_numid('source_mysql_treatment_id')} AS source_mysql_treatment_id, created_date, intt_cd,
       {s_sha('patient_no')} AS patient_no_sha256
FROM patient_clinical_event
""")

_reg("label_codes", duck_with("patient_clinical_event") + f"""
SELECT clinical_event_id, category, {s_category('category')} AS category_kr, status, {s_status('status')} AS status_kr
FROM patient_clinical_event
""")

_reg("translate_values", duck_with("treatments") + f"""
SELECT treatment_id, {s_translate('treatment_status', 'treatment_status')} AS treatment_status,
       {s_translate('treatment_type', 'treatment_type')} AS treatment_type, {s_translate('intt_cd', 'intt_cd')} AS intt_cd
FROM treatments
""")

_reg("format_datetimes", f"""
SELECT event_id, {s_fmt_ts('ts')} AS ts_kr, {s_fmt_d('CAST(ts AS DATE)')} AS d_kr,
       CASE WHEN event_id % 5 = 0 THEN 'Tx-' || event_type
            ELSE {s_fmt_ts("CASE WHEN event_id % 3 = 1 THEN ts + INTERVAL 9 HOUR ELSE ts END")} END AS iso_kr
FROM events
""")

_reg("format_cells", duck_with("examination") + f"""
SELECT examination_id, examination_name, {s_dec_display('examination_price')} AS examination_price,
       {s_fmt_ts('created_date')} AS created_date
FROM examination
""")

# ---- table profiles ----------------------------------------------------------
_OPS_BOUND = [n for n, _ in OPS_TABLES if n in VIEWS]
_OPS_ORD = {n: i + 1 for i, (n, _) in enumerate(OPS_TABLES)}
_OPS_CAP = dict(OPS_TABLES)


def _stats_sql():
    parts = []
    for n in _OPS_BOUND:
        day = view_as_of(n).date()
        parts.append(
            f"SELECT {_OPS_ORD[n]} AS ordinal, {_q(n)} AS table_name, {_q(_OPS_CAP[n])} AS table_name_kr, "
            f"count(*) AS total_count, count(*) FILTER (WHERE created_date >= {_ts(day)}) AS today_count, "
            f"{s_fmt_ts('max(created_date)')} AS last_created_at FROM ({duck_view_sql(n)})")
    return "\nUNION ALL\n".join(parts)


_reg("table_stats", _stats_sql())


def _trend_sql():
    parts = []
    for n in _OPS_BOUND:
        lo = view_as_of(n).date() - _dt.timedelta(days=13)
        parts.append(
            f"SELECT {_q(n)} AS table_name, strftime(created_date, '%Y-%m-%d') AS day, count(*) AS count "
            f"FROM ({duck_view_sql(n)}) WHERE created_date >= {_ts(lo)} GROUP BY 2")
    return "\nUNION ALL\n".join(parts)


_reg("table_daily_trend", _trend_sql())


def _counts_sql():
    parts = []
    for i, (n, cap) in enumerate(PG_TABLES):
        if n in VIEWS or n == "user_daily_wellness":
            cnt = f"(SELECT count(*) FROM ({duck_view_sql(n)}))"
        else:
            cnt = "CAST(-1 AS BIGINT)"
        parts.append(f"SELECT {i + 1} AS ordinal, {_q(n)} AS table_key, {_q(cap)} AS label_kr, {_q(n)} AS sql_name, "
                     f"{cnt} AS total_count, greatest(CAST(0 AS BIGINT), {cnt}) AS chart_count")
    return "\nUNION ALL\n".join(parts)


_reg("table_counts", _counts_sql())

_reg("table_search", f"""
WITH stats AS ({_stats_sql()})
, hits AS (SELECT * FROM stats WHERE contains(lower(table_name), 'a') OR contains(lower(table_name_kr), 'a'))
, num AS (SELECT *, CAST(row_number() OVER (ORDER BY ordinal) AS INTEGER) AS pos, count(*) OVER () AS n FROM hits)
, pg AS (SELECT *, CAST(greatest(1, ceil(n / 5.0)) AS INTEGER) AS total_pages FROM num)
, cur AS (SELECT *, CAST(least(greatest(2, 1), total_pages) AS INTEGER) AS page FROM pg)
SELECT ordinal, table_name, table_name_kr, total_count, today_count, last_created_at, pos, total_pages, page
FROM cur WHERE pos > (page - 1) * 5 AND pos <= page * 5
""")

_reg("table_recent_rows", duck_with("treatments") + f"""
, top AS (SELECT * FROM treatments ORDER BY created_date DESC NULLS LAST, treatment_id DESC LIMIT 20)
SELECT treatment_id, checkIn_id, {s_id('patient_no')} AS patient_no, {s_id('treatment_doc')} AS treatment_doc,
       department_id, treatment_type, treatment_status, {s_fmt_ts('treatment_date')} AS treatment_date,
       {s_text('treatment_comment')} AS treatment_comment, treatment_dept, {s_fmt_ts('created_date')} AS created_date,
       {s_fmt_ts('last_modified_date')} AS last_modified_date, intt_cd,
       {s_fmt_ts('synced_to_postgres_at')} AS synced_to_postgres_at,
       {s_sha('patient_no')} AS patient_no_sha256, {s_sha('treatment_doc')} AS treatment_doc_sha256,
       {s_sha('treatment_comment')} AS treatment_comment_sha256
FROM top
""")

# ---- wearable side -----------------------------------------------------------
_W24 = W - _dt.timedelta(hours=24)
_reg("vitals_aggregate", duck_with("user_vital_measurement", "user_daily_wellness") + f"""
SELECT count(*) AS total_vitals,
       count(*) FILTER (WHERE CAST(measured_at AS DATE) = {_d(W)}) AS today_vitals,
       count(*) FILTER (WHERE synced_to_mysql_at IS NULL) AS pending_mysql_sync,
       round_even(avg(CASE WHEN measured_at >= {_ts(_W24)} AND heart_rate_bpm IS NOT NULL THEN heart_rate_bpm END), 1)
         AS avg_heart_rate_24h,
       (SELECT count(*) FROM user_daily_wellness WHERE synced_to_mysql_at IS NULL) AS pending_daily_mysql_sync
FROM user_vital_measurement
""")

_reg("pending_sync", duck_with("user_vital_measurement") + """
SELECT vital_id, patient_no, measured_at, created_date, intt_cd FROM user_vital_measurement
WHERE synced_to_mysql_at IS NULL
""")

_reg("recent_vitals", duck_with("user_vital_measurement") + f"""
, top AS (SELECT * FROM user_vital_measurement ORDER BY measured_at DESC, vital_id DESC LIMIT 12)
SELECT {s_numid('vital_id')} AS vital_id, {s_id('patient_no')} AS patient_no, {s_fmt_ts('measured_at')} AS measured_at,
       heart_rate_bpm, blood_pressure_systolic, blood_pressure_diastolic,
       CAST(body_temp_c AS DOUBLE) AS body_temp_c, CAST(stress_score AS DOUBLE) AS stress_score, source_channel,
       synced_to_mysql_at IS NOT NULL AS synced_mysql, {s_sha('patient_no')} AS patient_no_sha256
FROM top
""")

_reg("recent_events", duck_with("patient_clinical_event") + f"""
, top AS (SELECT * FROM patient_clinical_event ORDER BY occurred_on DESC, clinical_event_id DESC LIMIT 15)
SELECT {s_numid('clinical_event_id')} AS clinical_event_id, {s_id('patient_no')} AS patient_no, category,
       {s_fmt_d('occurred_on')} AS occurred_on, {s_wtext('department')} AS department, {s_wtext('title')} AS title,
       status, {s_numid('source_mysql_treatment_id')} AS source_mysql_treatment_id,
       {s_category('category')} AS category_kr, {s_status('status')} AS status_kr,
       bool_or(source_mysql_treatment_id IS NOT NULL) OVER () AS include_mysql_treatment_id_column,
       {s_sha('patient_no')} AS patient_no_sha256
FROM top
""")

_reg("recent_wellness", duck_with("user_daily_wellness") + f"""
, top AS (SELECT * FROM user_daily_wellness ORDER BY summary_date DESC, patient_no ASC LIMIT 10)
SELECT {s_id('patient_no')} AS patient_no, {s_fmt_d('summary_date')} AS summary_date, step_count, step_goal,
       CAST(sleep_hours AS DOUBLE) AS sleep_hours, CAST(stress_level AS DOUBLE) AS stress_level,
       synced_to_mysql_at IS NOT NULL AS synced_mysql, {s_sha('patient_no')} AS patient_no_sha256
FROM top
""")

_reg("clinical_by_category", duck_with("patient_clinical_event") + f"""
SELECT coalesce(category, 'None') AS category, {s_category("coalesce(category, 'None')")} AS label_kr, count(*) AS count
FROM patient_clinical_event GROUP BY category
""")

_reg("etl_state", duck_with("etl_runtime_state") + f"""
, r AS (SELECT *, row_number() OVER (PARTITION BY job_code ORDER BY updated_at DESC, cursor_value DESC) AS rn
        FROM etl_runtime_state)
SELECT job_code, cursor_value, {s_fmt_ts('updated_at')} AS updated_at FROM r WHERE rn = 1
""")

_reg("latest_vitals", duck_with("user_vital_measurement") + f"""
, r AS (SELECT *, row_number() OVER (PARTITION BY patient_no ORDER BY measured_at DESC, vital_id DESC) AS rn
        FROM user_vital_measurement)
SELECT patient_no, vital_id, {s_fmt_ts('measured_at')} AS measured_at, heart_rate_bpm, blood_pressure_systolic,
       blood_pressure_diastolic, CAST(body_temp_c AS DOUBLE) AS body_temp_c, CAST(stress_score AS DOUBLE) AS stress_score,
       source_channel
FROM r WHERE rn = 1
""")

_reg("hourly_hr_sliding", duck_with("user_vital_measurement") + """
, h AS (SELECT date_diff('day', DATE '2000-01-01', CAST(measured_at AS DATE)) * 24 + hour(measured_at) AS hour_idx,
               sum(heart_rate_bpm) AS s, count(heart_rate_bpm) AS n
        FROM user_vital_measurement WHERE heart_rate_bpm IS NOT NULL GROUP BY 1)
SELECT hour_idx,
       CAST(sum(n) OVER w AS BIGINT) AS n_readings,
       round_even(CAST(sum(s) OVER w AS DOUBLE) / CAST(sum(n) OVER w AS DOUBLE), 1) AS avg_hr_24h
FROM h WINDOW w AS (ORDER BY hour_idx RANGE BETWEEN 23 PRECEDING AND CURRENT ROW)
""")

_reg("vitals_long", duck_with("user_vital_measurement") + "\nSELECT * FROM (\n" + "\nUNION ALL\n".join(
    f"SELECT vital_id, patient_no, measured_at, {_q(m)} AS metric_type, CAST({m} AS DOUBLE) AS value, {_q(u)} AS unit "
    f"FROM user_vital_measurement WHERE {m} IS NOT NULL"
    for m, u in {"heart_rate_bpm": "bpm", "blood_pressure_systolic": "mmHg", "blood_pressure_diastolic": "mmHg",
                 "body_temp_c": "°C", "stress_score": "score"}.items()) + ")\n")

# ---- patient -----------------------------------------------------------------
_REQUESTS = """
SELECT CASE c_custkey % 5 WHEN 0 THEN 'patient_no' WHEN 1 THEN 'app_user_id' WHEN 2 THEN 'email'
            WHEN 3 THEN 'tel' ELSE 'patient_no' END AS "by",
       CASE c_custkey % 5 WHEN 0 THEN CAST(c_custkey AS VARCHAR)
            WHEN 1 THEN 'U' || CAST(c_custkey AS VARCHAR)
            WHEN 2 THEN CASE WHEN c_custkey % 50 = 0 THEN NULL WHEN c_custkey % 45 = 0 THEN '@clinic.example'
                             ELSE lower(c_mktsegment) || CAST(c_custkey AS VARCHAR) || '@clinic.example' END
            WHEN 3 THEN ' ' || '010-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') || '-' ||
                        lpad(CAST((c_custkey * 31) % 10000 AS VARCHAR), 4, '0') || ' '
            ELSE 'x' || CAST(c_custkey AS VARCHAR) END AS value
FROM customer
"""
_reg("resolve_patient", duck_with("Patient", "user_app_profile") + f"""
, req AS ({_REQUESTS})
, lk AS (SELECT "by", key, min(patient_no) AS patient_no FROM (
           SELECT 'patient_no' AS "by", CAST(patient_no AS VARCHAR) AS key, patient_no FROM "Patient"
           UNION ALL SELECT 'app_user_id', app_user_id, patient_no FROM user_app_profile
           UNION ALL SELECT 'email', patient_email, patient_no FROM "Patient"
           UNION ALL SELECT 'tel', patient_tel, patient_no FROM "Patient") WHERE key IS NOT NULL GROUP BY 1, 2)
, rk AS (SELECT "by", value, CASE WHEN {s_strip('value')} IS NULL OR {s_strip('value')} = '' THEN NULL
                          WHEN "by" = 'patient_no' THEN CAST(TRY_CAST({s_strip('value')} AS BIGINT) AS VARCHAR)
                          WHEN "by" IN ('app_user_id', 'email', 'tel') THEN {s_strip('value')} END AS key FROM req)
SELECT rk."by", rk.value, lk.patient_no FROM rk LEFT JOIN lk ON lk."by" = rk."by" AND lk.key = rk.key
""")

_reg("patient_card", duck_with("Patient", "user_app_profile") + f"""
SELECT {s_id('p.patient_no')} AS patient_no, {s_name('p.patient_name')} AS patient_name,
       {s_rrn('p.patient_rrn')} AS patient_rrn, p.patient_gender, {s_fmt_d('p.patient_birth')} AS patient_birth,
       {s_address('p.patient_address')} AS patient_address, {s_email('p.patient_email')} AS patient_email,
       {s_phone('p.patient_tel')} AS patient_tel, p.patient_foreign,
       CASE WHEN p.patient_passport IS NOT NULL THEN '********' END AS patient_passport,
       p.patient_hypass_YN, {s_fmt_ts('p.patient_last_visit')} AS patient_last_visit, p.guardian,
       {s_fmt_ts('p.created_date')} AS created_date, {s_fmt_ts('p.last_modified_date')} AS last_modified_date,
       p.intt_cd,
       {s_id('pr.patient_no')} AS profile_patient_no, pr.app_user_id AS profile_app_user_id,
       pr.blood_type AS profile_blood_type, {s_dec_display('pr.height_cm')} AS profile_height_cm,
       {s_dec_display('pr.weight_kg')} AS profile_weight_kg, {s_fmt_ts('pr.created_date')} AS profile_created_date,
       {s_fmt_ts('pr.last_modified_date')} AS profile_last_modified_date, pr.intt_cd AS profile_intt_cd
FROM "Patient" p LEFT JOIN user_app_profile pr ON pr.patient_no = p.patient_no
""")

_reg("patient_360", duck_with("Patient", "user_app_profile", "disability", "patient_clinical_event",
                              "user_vital_measurement", "user_daily_wellness") + f"""
, ev AS (SELECT patient_no, count(*) AS n_events, count(DISTINCT category) AS n_categories FROM patient_clinical_event
         GROUP BY 1)
, ec AS (SELECT patient_no, string_agg(category || ':' || CAST(n AS VARCHAR), ',' ORDER BY category) AS events_by_category
         FROM (SELECT patient_no, coalesce(category, 'None') AS category, count(*) AS n FROM patient_clinical_event
               GROUP BY 1, 2) GROUP BY 1)
, ne AS (SELECT patient_no, occurred_on, title,
                row_number() OVER (PARTITION BY patient_no ORDER BY occurred_on DESC, clinical_event_id DESC) AS rn
         FROM patient_clinical_event)
, lv AS (SELECT *,
                row_number() OVER (PARTITION BY patient_no ORDER BY measured_at DESC, vital_id DESC) AS rn
         FROM user_vital_measurement)
, td AS (SELECT patient_no, step_count, step_goal, sleep_hours, stress_level FROM user_daily_wellness
         WHERE summary_date = {_d(W)})
SELECT p.patient_no, p.patient_name, pr.app_user_id, pr.blood_type, CAST(pr.height_cm AS DOUBLE) AS height_cm,
       CAST(pr.weight_kg AS DOUBLE) AS weight_kg, pr.intt_cd AS profile_intt_cd, d.disability_grade,
       d.disability_type, d.assistive_device_YN, d.disability_device_type,
       CAST(coalesce(ev.n_events, 0) AS BIGINT) AS n_events, CAST(coalesce(ev.n_categories, 0) AS BIGINT) AS n_categories,
       ec.events_by_category, {s_fmt_d('ne.occurred_on')} AS latest_event_on, ne.title AS latest_event_title,
       lv.vital_id AS latest_vital_id, {s_fmt_ts('lv.measured_at')} AS latest_measured_at,
       lv.heart_rate_bpm AS latest_heart_rate_bpm, lv.blood_pressure_systolic AS latest_blood_pressure_systolic,
       lv.blood_pressure_diastolic AS latest_blood_pressure_diastolic,
       CAST(lv.body_temp_c AS DOUBLE) AS latest_body_temp_c, CAST(lv.stress_score AS DOUBLE) AS latest_stress_score,
       lv.source_channel AS latest_source_channel,
       td.step_count AS today_step_count, td.step_goal AS today_step_goal, CAST(td.sleep_hours AS DOUBLE) AS today_sleep_hours,
       CAST(td.stress_level AS DOUBLE) AS today_stress_level
FROM "Patient" p
LEFT JOIN user_app_profile pr ON pr.patient_no = p.patient_no
LEFT JOIN disability d ON d.patient_no = p.patient_no
LEFT JOIN ev ON ev.patient_no = p.patient_no
LEFT JOIN ec ON ec.patient_no = p.patient_no
LEFT JOIN ne ON ne.patient_no = p.patient_no AND ne.rn = 1
LEFT JOIN lv ON lv.patient_no = p.patient_no AND lv.rn = 1
LEFT JOIN td ON td.patient_no = p.patient_no
""")

_reg("patient_events", duck_with("patient_clinical_event") + f"""
SELECT patient_no, category, clinical_event_id, occurred_on, {s_fmt_d('occurred_on')} AS occurred_on_kr, department,
       title, summary, {s_status('status')} AS status, institution_name
FROM patient_clinical_event
""")

# ---- upsert family / sync ----------------------------------------------------
_PT_COLS = ["patient_no", "patient_name", "patient_rrn", "patient_gender", "patient_birth", "patient_address",
            "patient_email", "patient_tel", "patient_foreign", "patient_passport", "patient_hypass_YN",
            "patient_last_visit", "guardian", "created_date", "last_modified_date", "intt_cd"]


def _merge_cols(cols, keys, updates):
    out = []
    for c in cols:
        if c in keys:
            out.append(f"CASE WHEN t.__t THEN t.{c} ELSE s.{c} END AS {c}")
        elif c in updates:
            out.append(f"CASE WHEN s.__s THEN s.{c} ELSE t.{c} END AS {c}")
        else:
            out.append(f"CASE WHEN t.__t THEN t.{c} ELSE s.{c} END AS {c}")
    out.append("CASE WHEN s.__s AND t.__t THEN 'update' WHEN s.__s THEN 'insert' ELSE 'keep' END AS action")
    return ",\n       ".join(out)


def _on(keys):
    return " AND ".join(f"t.{k} IS NOT DISTINCT FROM s.{k}" for k in keys)


_UPSERT_PATIENTS = duck_with("Patient") + f"""
, tgt AS (SELECT * REPLACE (lower(patient_name) AS patient_name, 'OLD' AS patient_address,
                            '000-0000-0000' AS patient_tel, created_date AS last_modified_date,
                            CAST(NULL AS TIMESTAMP) AS patient_last_visit, 'OLD' AS guardian), TRUE AS __t
          FROM "Patient" WHERE patient_no % 3 <> 2)
, src AS (SELECT *, TRUE AS __s FROM "Patient")
, merged AS (
SELECT {_merge_cols(_PT_COLS, ['patient_no'], ['patient_name', 'patient_gender', 'patient_birth', 'patient_address',
                                                 'patient_last_visit', 'last_modified_date', 'intt_cd'])}
FROM tgt t FULL OUTER JOIN src s ON {_on(['patient_no'])})
"""
_reg("upsert_patients", _UPSERT_PATIENTS + "SELECT * FROM merged")

_PR_COLS = ["patient_no", "app_user_id", "blood_type", "height_cm", "weight_kg", "created_date",
            "last_modified_date", "intt_cd"]
_reg("upsert_profiles", duck_with("user_app_profile") + f"""
, tgt AS (SELECT * REPLACE ('UNKNOWN' AS blood_type, 'OLD' AS app_user_id, 'MYSQL' AS intt_cd), TRUE AS __t
          FROM user_app_profile WHERE patient_no % 4 = 0)
, src AS (SELECT *, TRUE AS __s FROM user_app_profile)
SELECT {_merge_cols(_PR_COLS, ['patient_no'], ['app_user_id', 'blood_type', 'height_cm', 'weight_kg',
                                                'last_modified_date', 'intt_cd'])}
FROM tgt t FULL OUTER JOIN src s ON {_on(['patient_no'])}
""")

_reg("insert_if_absent", duck_with("treatments") + """
, t AS (SELECT treatment_id, patient_no, treatment_type, intt_cd FROM treatments)
SELECT * FROM t WHERE treatment_id % 2 = 0
UNION ALL
SELECT * FROM t r WHERE NOT EXISTS (SELECT 1 FROM t k WHERE k.treatment_id % 2 = 0 AND k.treatment_id IS NOT DISTINCT FROM r.treatment_id)
""")

_reg("delete_where", duck_with("treatments") + """
SELECT treatment_id, treatment_status, intt_cd FROM treatments
WHERE NOT coalesce(treatment_status = 'CANCELLED' AND intt_cd = 'HQ', FALSE)
""")

_reg("append_rows", duck_with("treatments") + """
SELECT treatment_id, patient_no, treatment_date, treatment_comment FROM treatments
WHERE treatment_date < TIMESTAMP '2001-01-01 00:00:00'
UNION ALL
SELECT treatment_id, patient_no, treatment_date, CAST(NULL AS VARCHAR) FROM treatments
WHERE treatment_date >= TIMESTAMP '2001-01-01 00:00:00'
""")

_reg("evolve_schema", duck_with("Patient") + """
SELECT patient_no, patient_gender, intt_cd, CAST(NULL AS VARCHAR) AS patient_hypass_YN FROM "Patient"
WHERE patient_no % 10 <> 0
UNION ALL
SELECT patient_no, patient_gender, intt_cd, CASE WHEN patient_no % 20 = 0 THEN 'Y' ELSE 'N' END FROM "Patient"
WHERE patient_no % 10 = 0
""")

_reg("assign_keys", duck_with("Patient", "treatments") + """
SELECT patient_no, patient_name,
       coalesce((SELECT max(treatment_id) FROM treatments), 10000000) + row_number() OVER (ORDER BY patient_no)
         AS treatment_id
FROM "Patient"
""")

_VCOPY = f"""vital_id, patient_no, measured_at, heart_rate_bpm, blood_pressure_systolic, blood_pressure_diastolic,
       CAST(body_temp_c AS DOUBLE) AS body_temp_c, CAST(stress_score AS DOUBLE) AS stress_score, source_channel,
       coalesce(created_date, {_ts(W)}) AS created_date, {s_or_default('intt_cd', "'ETL_SYNC'")} AS intt_cd"""
_VITALS_RUN = duck_with("user_vital_measurement") + f"""
, tgt AS (SELECT {_VCOPY} FROM user_vital_measurement WHERE vital_id % 6 = 1 OR vital_id % 9 = 0)
, batch AS (SELECT {_VCOPY} FROM user_vital_measurement WHERE synced_to_mysql_at IS NULL)
, firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY patient_no, measured_at ORDER BY vital_id) AS rn
                            FROM batch) WHERE rn = 1)
, ins AS (SELECT * EXCLUDE (rn) FROM firsts b WHERE NOT EXISTS (
            SELECT 1 FROM tgt k WHERE k.patient_no IS NOT DISTINCT FROM b.patient_no
                                  AND k.measured_at IS NOT DISTINCT FROM b.measured_at))
"""
_reg("sync_vitals", _VITALS_RUN + "SELECT * FROM ins")

_reg("mark_synced", duck_with("user_vital_measurement") + f"""
SELECT vital_id, coalesce(synced_to_mysql_at, {_ts(W)}) AS synced_to_mysql_at FROM user_vital_measurement
""")

_DCOPY = f"""patient_no, summary_date, step_count, step_goal, CAST(sleep_hours AS DOUBLE) AS sleep_hours,
       CAST(stress_level AS DOUBLE) AS stress_level, coalesce(created_date, {_ts(W)}) AS created_date,
       coalesce(last_modified_date, {_ts(W)}) AS last_modified_date, {s_or_default('intt_cd', "'ETL_SYNC'")} AS intt_cd"""
_DAILY_COLS = ["patient_no", "summary_date", "step_count", "step_goal", "sleep_hours", "stress_level",
               "created_date", "last_modified_date", "intt_cd"]
_SYNC_DAILY = duck_with("user_daily_wellness") + f"""
, tgt AS (SELECT {_DCOPY.replace('step_count,', 'step_count - 1 AS step_count,', 1)}, TRUE AS __t
          FROM user_daily_wellness WHERE patient_no % 3 = 0)
, src AS (SELECT {_DCOPY}, TRUE AS __s FROM user_daily_wellness WHERE synced_to_mysql_at IS NULL)
, merged AS (SELECT {_merge_cols(_DAILY_COLS, ['patient_no', 'summary_date'],
                                 ['step_count', 'step_goal', 'sleep_hours', 'stress_level', 'last_modified_date',
                                  'intt_cd'])}
             FROM tgt t FULL OUTER JOIN src s ON {_on(['patient_no', 'summary_date'])})
"""
_reg("sync_daily", _SYNC_DAILY + "SELECT * FROM merged")

_TREAT_RUN = duck_with("treatments", "patient_clinical_event") + f"""
, batch AS (SELECT * FROM treatments WHERE synced_to_postgres_at IS NULL AND patient_no IS NOT NULL)
, ex AS (SELECT DISTINCT source_mysql_treatment_id AS treatment_id FROM patient_clinical_event
         WHERE source_mysql_treatment_id IS NOT NULL)
, tagged AS (SELECT b.*, ex.treatment_id IS NOT NULL AS ex FROM batch b LEFT JOIN ex ON ex.treatment_id = b.treatment_id)
, ins AS (
  SELECT patient_no,
         CASE WHEN treatment_type IN ('OUTPATIENT', 'INPATIENT', 'EMERGENCY') THEN treatment_type ELSE 'OUTPATIENT' END
           AS category,
         CAST(treatment_date AS DATE) AS occurred_on, treatment_dept AS department,
         substr(coalesce(CASE WHEN treatment_dept != '' THEN treatment_dept END, treatment_type, 'None')
                || ' 진료 #' || CAST(treatment_id AS VARCHAR), 1, 200) AS title,
         treatment_comment AS summary, treatment_status AS status, CAST(NULL AS VARCHAR) AS institution_name,
         treatment_id AS source_mysql_treatment_id, {_ts(W)} AS created_date, 'ETL_SYNC' AS intt_cd,
         coalesce((SELECT max(clinical_event_id) FROM patient_clinical_event), 0)
           + row_number() OVER (ORDER BY treatment_id) AS clinical_event_id
  FROM tagged WHERE NOT ex)
"""
_reg("sync_treatments", _TREAT_RUN + "SELECT * FROM ins")

_reg("mark_treatments", duck_with("treatments") + f"""
SELECT treatment_id,
       CASE WHEN synced_to_postgres_at IS NULL AND patient_no IS NOT NULL THEN {_ts(W)} ELSE synced_to_postgres_at END
         AS synced_to_postgres_at,
       CASE WHEN synced_to_postgres_at IS NULL AND patient_no IS NOT NULL THEN {_ts(W)} ELSE last_modified_date END
         AS last_modified_date
FROM treatments
""")

_reg("mark_daily", duck_with("user_daily_wellness") + f"""
SELECT patient_no, summary_date, coalesce(synced_to_mysql_at, {_ts(W)}) AS synced_to_mysql_at FROM user_daily_wellness
""")

_reg("sync_stats", f"""
WITH v AS ({_VITALS_RUN} SELECT count(*) AS vitals_examined,
                 (SELECT count(*) FROM ins) AS vitals_copied FROM batch)
, t AS ({_TREAT_RUN} SELECT count(*) AS examined, count(*) FILTER (WHERE NOT ex) AS inserted,
                 count(*) FILTER (WHERE ex) AS skipped_existing_pg, count(*) AS marked_mysql FROM tagged)
, d AS ({_SYNC_DAILY} SELECT count(*) FILTER (WHERE action <> 'keep') AS daily_copied FROM merged)
, p AS ({_UPSERT_PATIENTS} SELECT count(*) FILTER (WHERE action <> 'keep') AS patients_upserted FROM merged)
, q AS ({ORACLE["upsert_profiles"]})
SELECT v.vitals_examined, v.vitals_copied, v.vitals_examined - v.vitals_copied AS vitals_duplicate,
       v.vitals_examined AS vital_ids_marked, t.examined, t.inserted, t.skipped_existing_pg, t.marked_mysql,
       d.daily_copied, d.daily_copied AS daily_marked, p.patients_upserted,
       (SELECT count(*) FROM q WHERE action <> 'keep') AS profiles_upserted, CAST(0 AS BIGINT) AS errors
FROM v, t, d, p
""")

_reg("sync_quarantine", duck_with("user_vital_measurement") + f"""
, batch AS (SELECT {_VCOPY} FROM user_vital_measurement WHERE synced_to_mysql_at IS NULL)
, r AS (SELECT vital_id, patient_no,
               CASE WHEN patient_no IS NULL THEN 'missing patient_no'
                    WHEN measured_at IS NULL THEN 'missing measured_at'
                    WHEN NOT (heart_rate_bpm BETWEEN 20 AND 250) THEN 'heart_rate_bpm out of range'
                    WHEN NOT (body_temp_c BETWEEN 30 AND 45) THEN 'body_temp_c out of range'
                    WHEN NOT (stress_score BETWEEN 0 AND 100) THEN 'stress_score out of range' END AS reason
        FROM batch)
SELECT * FROM r WHERE reason IS NOT NULL
""")

_INC = duck_view_sql("wellness_increment")
_reg("daily_wellness_rollup", f"""
WITH inc AS ({_INC})
, stored AS (
  SELECT patient_no, summary_date, CAST(step_count AS BIGINT) AS step_count, 1000 AS step_goal, sleep_hours,
         stress_level, CASE WHEN (patient_no + day(summary_date)) % 2 = 0 THEN NULL ELSE last_modified_date END
           AS synced_to_mysql_at, created_date, last_modified_date, 'APP' AS intt_cd
  FROM (SELECT patient_no, summary_date, sum(step_delta) AS step_count,
               arg_max_null(sleep_hours, (measured_at, event_id)) AS sleep_hours,
               arg_max_null(stress_level, (measured_at, event_id)) AS stress_level,
               min(measured_at) AS created_date, max(measured_at) AS last_modified_date
        FROM inc WHERE event_id % 2 = 0 GROUP BY 1, 2))
, delta AS (
  SELECT patient_no, summary_date, CAST(sum(step_delta) AS BIGINT) AS step_delta,
         arg_max_null(sleep_hours, (measured_at, event_id)) AS sleep_hours,
         arg_max_null(stress_level, (measured_at, event_id)) AS stress_level, max(measured_at) AS last_reading_at
  FROM inc WHERE event_id % 2 = 1 GROUP BY 1, 2)
SELECT coalesce(s.patient_no, d.patient_no) AS patient_no, coalesce(s.summary_date, d.summary_date) AS summary_date,
       CAST(coalesce(s.step_count, 0) + coalesce(d.step_delta, 0) AS BIGINT) AS step_count,
       coalesce(s.step_goal, 1000) AS step_goal,
       CASE WHEN d.last_reading_at IS NOT NULL THEN d.sleep_hours ELSE s.sleep_hours END AS sleep_hours,
       CASE WHEN d.last_reading_at IS NOT NULL THEN d.stress_level ELSE s.stress_level END AS stress_level,
       CASE WHEN d.last_reading_at IS NOT NULL THEN NULL ELSE s.synced_to_mysql_at END AS synced_to_mysql_at,
       coalesce(s.created_date, {_ts(W)}) AS created_date,
       CASE WHEN d.last_reading_at IS NOT NULL THEN {_ts(W)} ELSE s.last_modified_date END AS last_modified_date,
       CASE WHEN d.last_reading_at IS NOT NULL THEN 'ETL_SYNC' ELSE s.intt_cd END AS intt_cd
FROM stored s FULL OUTER JOIN delta d ON d.patient_no = s.patient_no AND d.summary_date = s.summary_date
""")

_SUFFIX = W.strftime("%Y%m%d%H%M%S")
_ENC = duck_with("Patient", "treatments", "department") + f"""
, enc AS (SELECT patient_no, CASE WHEN patient_no % 10 < 7 THEN 'COMPLETED' ELSE 'CANCELLED' END AS status
          FROM "Patient")
, keyed AS (SELECT *, coalesce((SELECT max(treatment_id) FROM treatments), 10000000)
                      + row_number() OVER (ORDER BY patient_no) AS k,
                   (SELECT max(id) FROM department) AS department_id FROM enc)
"""
_reg("encounter_fanout", _ENC + f"""
SELECT patient_no, k AS treatment_id, k AS checkIn_id, department_id, 'check_in' AS record_type, status,
       'pipeline-{_SUFFIX}' AS comment, {_ts(W)} AS created_date FROM keyed
UNION ALL
SELECT patient_no, k, k, department_id, 'treatment', status, 'completion-{_SUFFIX}', {_ts(W)} FROM keyed
UNION ALL
SELECT patient_no, k, k, department_id, 'out_treatment', status,
       CASE WHEN status = 'COMPLETED' THEN NULL ELSE '종료-{_SUFFIX}' END, {_ts(W)} FROM keyed
UNION ALL
SELECT patient_no, k, k, department_id, 'prescription', CASE WHEN status = 'COMPLETED' THEN 'DISPENSED' ELSE 'CANCELLED' END,
       CASE WHEN status = 'COMPLETED' THEN NULL ELSE '실패 취소-{_SUFFIX}' END, {_ts(W)} FROM keyed
""")
_reg("encounter_counts", duck_with("Patient") + """
, enc AS (SELECT CASE WHEN patient_no % 10 < 7 THEN 'COMPLETED' ELSE 'CANCELLED' END AS status FROM "Patient")
SELECT count(*) FILTER (WHERE status = 'COMPLETED') AS completed_count,
       count(*) FILTER (WHERE status = 'CANCELLED') AS cancelled_count, count(*) AS completion_rows FROM enc
""")

# ---- ledger ----------------------------------------------------------------
_reg("ledger_state", duck_with("batch_job_log") + """
SELECT batch_log_id, status, CASE WHEN status = 'RUNNING' THEN NULL ELSE finished_at END AS finished_at,
       CASE WHEN status = 'FAILED' THEN next_retry_at END AS next_retry_at,
       CASE WHEN status IN ('FAILED', 'RETRIED') THEN substr(trim(error_message), 1, 4000) END AS error_message,
       CASE WHEN status = 'RUNNING' THEN 1 WHEN status = 'RETRIED' THEN 3 ELSE 2 END AS transitions
FROM batch_job_log
""")

_reg("ledger_backoff", duck_with("batch_job_log") + f"""
SELECT batch_log_id, attempt_no, max_attempts, finished_at,
       CASE WHEN attempt_no < greatest(1, max_attempts) THEN finished_at + INTERVAL {_ledger.RETRY_DELAY_MIN} MINUTE END
         AS next_retry_at
FROM batch_job_log WHERE status IN ('FAILED', 'RETRIED')
""")

_DUE = duck_with("batch_job_log") + f"""
, due AS (SELECT batch_log_id, job_name, attempt_no, max_attempts, next_retry_at FROM batch_job_log
          WHERE status = 'FAILED' AND next_retry_at IS NOT NULL AND next_retry_at <= {_ts(W)}
            AND attempt_no < max_attempts ORDER BY next_retry_at, batch_log_id LIMIT 10)
"""
_reg("ledger_due_retries", _DUE + "SELECT * FROM due")

_reg("ledger_recent", duck_with("batch_job_log") + """
SELECT batch_log_id, job_name, trigger_type, status, attempt_no, max_attempts, retry_of_log_id, started_at,
       finished_at, next_retry_at, error_message, created_date, last_modified_date
FROM batch_job_log WHERE status = 'FAILED' ORDER BY batch_log_id DESC LIMIT 50
""")

_reg("ledger_retry_plan", _DUE + f"""
SELECT batch_log_id AS retry_of_log_id, job_name, 'retry' AS trigger_type, 'RUNNING' AS status,
       attempt_no + 1 AS attempt_no, max_attempts, {_ts(W)} AS started_at,
       '{{"retry_of_log_id":' || CAST(batch_log_id AS VARCHAR) || ',"previous_attempt":' || CAST(attempt_no AS VARCHAR)
         || '}}' AS request_payload
FROM due
""")

_KNOWN = ", ".join(_q(k) for k in _ledger.KNOWN_PAYLOAD_FIELDS)
_reg("ledger_payload_json", duck_with("batch_job_log") + f"""
SELECT batch_log_id, coalesce(json_extract_string(result_payload, '$.job'), job_name) AS job,
       json_extract_string(result_payload, '$.batch_log_id') AS payload_batch_log_id,
       json_extract_string(result_payload, '$.suffix') AS suffix,
       json_extract_string(result_payload, '$.patients_inserted_from') AS patients_inserted_from,
       json_extract_string(result_payload, '$.check_ins') AS check_ins,
       json_extract_string(result_payload, '$.treatments') AS treatments,
       json_extract_string(result_payload, '$.prescription_ids') AS prescription_ids,
       array_to_string(x, ',') AS extra_keys,
       array_to_string(list_transform(x, lambda k: k || '=' || coalesce(json_extract_string(result_payload, '$.' || k), 'null')),
                       ',') AS extra
FROM (SELECT *, list_sort(list_filter(json_keys(result_payload), lambda k: NOT list_contains([{_KNOWN}], k))) AS x
      FROM batch_job_log WHERE result_payload IS NOT NULL)
""")



def _kpi_sql():
    agg = ORACLE["vitals_aggregate"].split("\nSELECT ", 1)
    cte = agg[0]
    body = "SELECT " + agg[1]
    parts = []
    for i, (label, kind, src) in enumerate(KPI_CARDS):
        if kind == "count":
            val = f"(SELECT max(total_count) FROM counts WHERE table_key = {_q(src)})"
        else:
            val = f"(SELECT {src} FROM va)"
        parts.append(f"SELECT {i + 1} AS ordinal, {_q(label)} AS label, "
                     f"coalesce(CAST({val} AS VARCHAR), {_q(KPI_PLACEHOLDER)}) AS value")
    return (cte + f", counts AS ({_counts_sql()})\n, va AS ({body})\n" + "\nUNION ALL\n".join(parts))


_reg("wearable_kpi_cards", _kpi_sql())

_LOG_COLS = [n for n, _ in VIEWS["batch_job_log"].columns]


def _retry_cycle_sql():
    upd = []
    for c in _LOG_COLS:
        if c == "status":
            upd.append("CASE WHEN d.batch_log_id IS NOT NULL THEN 'RETRIED' ELSE l.status END AS status")
        elif c == "next_retry_at":
            upd.append("CASE WHEN d.batch_log_id IS NOT NULL THEN NULL ELSE l.next_retry_at END AS next_retry_at")
        elif c == "last_modified_date":
            upd.append(f"CASE WHEN d.batch_log_id IS NOT NULL THEN {_ts(W)} ELSE l.last_modified_date END "
                       "AS last_modified_date")
        else:
            upd.append(f"l.{c}")
    new = {
        "batch_log_id": "(SELECT max(batch_log_id) FROM batch_job_log) + row_number() OVER "
                        "(ORDER BY next_retry_at, batch_log_id)",
        "job_name": "job_name", "trigger_type": "'retry'", "status": "'RUNNING'",
        "attempt_no": "attempt_no + 1", "max_attempts": "3", "retry_of_log_id": "batch_log_id",
        "started_at": _ts(W), "finished_at": "CAST(NULL AS TIMESTAMP)", "next_retry_at": "CAST(NULL AS TIMESTAMP)",
        "request_payload": "'{\"retry_of_log_id\":' || CAST(batch_log_id AS VARCHAR) || ',\"previous_attempt\":' "
                           "|| CAST(attempt_no AS VARCHAR) || '}'",
        "result_payload": "CAST(NULL AS VARCHAR)", "error_message": "CAST(NULL AS VARCHAR)",
        "created_date": _ts(W), "last_modified_date": _ts(W), "intt_cd": "'BATCH'",
    }
    return (_DUE + "SELECT " + ", ".join(upd) + " FROM batch_job_log l LEFT JOIN due d ON d.batch_log_id = l.batch_log_id"
            + "\nUNION ALL\nSELECT " + ", ".join(f"{new[c]} AS {c}" for c in _LOG_COLS) + " FROM due")


_reg("ledger_retry_cycle", _retry_cycle_sql())

_reg("my_health", f"""
SELECT r."by" AS resolved_by, r.value, f.*
FROM ({ORACLE['resolve_patient']}) r
JOIN ({ORACLE['patient_360']}) f ON f.patient_no = r.patient_no
WHERE r.patient_no IS NOT NULL
""")

_reg("my_health_events", f"""
SELECT r."by" AS resolved_by, r.value, e.*
FROM ({ORACLE['resolve_patient']}) r
JOIN ({duck_with("patient_clinical_event")} SELECT patient_no, coalesce(category, 'None') AS category, clinical_event_id,
      {s_fmt_d('occurred_on')} AS occurred_on_kr, department, title, summary, {s_status('status')} AS status,
      institution_name FROM patient_clinical_event) e ON e.patient_no = r.patient_no
WHERE r.patient_no IS NOT NULL
""")

_reg("format_odd_values", """
WITH o AS (SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS d, CAST(ts AS DATE) AS dd, event_type,
  CAST(12345678 + event_id AS DECIMAL(16,2)) + CAST(event_id % 100 AS DECIMAL(16,2)) / 100 AS big,
  event_id % 1000 AS m FROM events)
SELECT event_id,
  CASE event_id % 9 WHEN 0 THEN d || 'T10:00:99' WHEN 1 THEN d || 'T10:00+99:99' WHEN 2 THEN d || ' 10:00|Tab'
    WHEN 3 THEN CAST(year(dd + INTERVAL 1 DAY) AS VARCHAR) || '년 ' || CAST(month(dd + INTERVAL 1 DAY) AS VARCHAR)
      || '월 ' || CAST(day(dd + INTERVAL 1 DAY) AS VARCHAR) || '일 14:00' WHEN 4 THEN d || 'T24:00'
    WHEN 5 THEN '2024-02-30T10:00' WHEN 6 THEN event_type || 'T|' WHEN 7 THEN '' END AS iso_kr,
  CAST(12345678 + event_id AS VARCHAR) || CASE WHEN event_id % 100 = 0 THEN ''
    ELSE '.' || rtrim(lpad(CAST(event_id % 100 AS VARCHAR), 2, '0'), '0') END AS big,
  CASE WHEN m = 0 THEN '0' ELSE '0.' || rtrim(lpad(CAST(m AS VARCHAR), 6, '0'), '0') END AS small
FROM o
""")

_reg("mask_institutions", duck_with("health_checkup_institution") + f"""
SELECT institution_id, region_code, institution_name, institution_type, {s_address('address')} AS address,
       {s_phone('phone_number')} AS phone_number, is_active, created_date, intt_cd,
       {s_sha('address')} AS address_sha256, {s_sha('phone_number')} AS phone_number_sha256
FROM health_checkup_institution
""")

_reg("mask_certificates", duck_with("diagnosis_certificate") + f"""
SELECT certificate_id, {s_text('certificate_number')} AS certificate_number, {s_id('patient_id')} AS patient_id,
       {s_id('doctor_id')} AS doctor_id, {s_name('diagnosis_name')} AS diagnosis_name, diagnosis_date,
       {s_text('clinical_findings')} AS clinical_findings, {s_text('purpose')} AS purpose, status,
       created_date, last_modified_date, intt_cd,
       {s_sha('certificate_number')} AS certificate_number_sha256, {s_sha('patient_id')} AS patient_id_sha256,
       {s_sha('doctor_id')} AS doctor_id_sha256, {s_sha('diagnosis_name')} AS diagnosis_name_sha256,
       {s_sha('clinical_findings')} AS clinical_findings_sha256, {s_sha('purpose')} AS purpose_sha256
FROM diagnosis_certificate
""")

# ---- completion batch, checked sync, newest events, ledger writes --------------------
_DONE = duck_with("Patient", "treatments", "department", "check_in", "Prescription") + f"""
, top AS (SELECT patient_no, CASE WHEN patient_no % 10 < 7 THEN 'COMPLETED' ELSE 'CANCELLED' END AS status
          FROM "Patient" ORDER BY patient_no DESC LIMIT 100)
, k AS (SELECT *, row_number() OVER (ORDER BY patient_no DESC) AS i, (SELECT max(id) FROM department) AS department_id,
               (SELECT coalesce(max("checkIn_id"), 0) FROM check_in) AS c, (SELECT coalesce(max(treatment_id), 0) FROM treatments) AS t,
               (SELECT coalesce(max(prescription_id), 0) FROM "Prescription") AS p FROM top)
"""
_STAMPS = f"{_ts(W)} AS created_date, {_ts(W)} AS last_modified_date, 'PIPELINE' AS intt_cd"
_reg("completion_check_ins", _DONE + f"""
SELECT c + i AS "checkIn_id", patient_no, CAST(NULL AS BIGINT) AS user_id, {_ts(W)} AS "checkIn_date",
       status AS "checkIn_status", 'pipeline-{_SUFFIX}' AS "checkIn_comment", {_STAMPS} FROM k
""")
_reg("completion_treatments", _DONE + f"""
SELECT t + i AS treatment_id, c + i AS "checkIn_id", patient_no, CAST(900001 AS BIGINT) AS treatment_doc, department_id,
       'OUTPATIENT' AS treatment_type, status AS treatment_status, {_ts(W)} AS treatment_date,
       {_ts(W)} AS treatment_start_time, {_ts(W)} AS treatment_end_time, 'completion-{_SUFFIX}' AS treatment_comment,
       CAST(NULL AS VARCHAR) AS treatment_dept, {_STAMPS} FROM k
""")
_reg("completion_out_treatments", _DONE + f"""
SELECT t + i AS treatment_id, c + i AS "checkIn_id", status AS treatment_status, CAST(NULL AS BIGINT) AS pre_treatment_id,
       CASE WHEN status <> 'COMPLETED' THEN '종료-{_SUFFIX}' END AS treatment_comment, {_STAMPS} FROM k
""")
_reg("completion_prescriptions", _DONE + f"""
SELECT p + i AS prescription_id, t + i AS treatment_id, patient_no, CAST(900001 AS BIGINT) AS prescription_doc,
       {_ts(W)} AS prescription_date, CASE WHEN status = 'COMPLETED' THEN 'DISPENSED' ELSE 'CANCELLED' END AS prescription_status,
       'OUTPATIENT' AS prescription_type, CASE WHEN status <> 'COMPLETED' THEN '실패 취소-{_SUFFIX}' END AS prescription_memo,
       {_STAMPS} FROM k
""")

_reg("sync_stats_checked", duck_with("user_vital_measurement") + f"""
, tgt AS (SELECT {_VCOPY} FROM user_vital_measurement WHERE vital_id % 6 = 1 OR vital_id % 9 = 0)
, batch AS (SELECT {_VCOPY} FROM user_vital_measurement WHERE synced_to_mysql_at IS NULL)
, r AS (SELECT *, patient_no IS NULL OR measured_at IS NULL OR coalesce(heart_rate_bpm NOT BETWEEN 20 AND 250, FALSE)
               OR coalesce(body_temp_c NOT BETWEEN 30 AND 45, FALSE) OR coalesce(stress_score NOT BETWEEN 0 AND 100, FALSE) AS bad
        FROM batch)
, good AS (SELECT *, row_number() OVER (PARTITION BY patient_no, measured_at ORDER BY vital_id) AS rn FROM r WHERE NOT bad)
, ins AS (SELECT * FROM good g WHERE rn = 1 AND NOT EXISTS (
            SELECT 1 FROM tgt k WHERE k.patient_no = g.patient_no AND k.measured_at = g.measured_at))
SELECT count(*) AS vitals_examined, (SELECT count(*) FROM ins) AS vitals_copied,
       (SELECT count(*) FROM good) - (SELECT count(*) FROM ins) AS vitals_duplicate,
       count(*) FILTER (WHERE bad) AS errors, count(*) FILTER (WHERE bad) AS still_pending FROM r
""")

_NEWEST = duck_with("patient_clinical_event") + """
, newest AS (SELECT * FROM (SELECT * REPLACE (coalesce(category, 'None') AS category), row_number() OVER (
               PARTITION BY patient_no, coalesce(category, 'None')
               ORDER BY occurred_on DESC NULLS LAST, clinical_event_id DESC)::INT AS rank FROM patient_clinical_event)
             WHERE rank <= 5)
"""
_reg("newest_events", _NEWEST + """
SELECT patient_no, category, rank, clinical_event_id, occurred_on, title FROM newest
""")
_reg("my_health_categories", f"""
SELECT r."by" AS resolved_by, r.value, r.patient_no, coalesce(m.j, '{{}}') AS clinical_events_by_category
FROM ({ORACLE['resolve_patient']}) r LEFT JOIN (
  SELECT patient_no, '{{' || string_agg(to_json(category) || ':' || events, ',' ORDER BY category) || '}}' AS j FROM (
    SELECT patient_no, category, '[' || string_agg(to_json({{'clinical_event_id': clinical_event_id, 'category': category,
             'occurred_on': coalesce(occurred_kr, ''), 'department': department, 'title': title, 'summary': summary,
             'status': status_kr, 'institution_name': institution_name}})::VARCHAR, ',' ORDER BY rank) || ']' AS events
    FROM ({_NEWEST} SELECT *, {s_fmt_d('occurred_on')} AS occurred_kr, {s_status('status')} AS status_kr FROM newest)
    GROUP BY patient_no, category) GROUP BY patient_no) m ON m.patient_no = r.patient_no
WHERE r.patient_no IS NOT NULL
""")

_reg("ledger_finish", duck_with("batch_job_log") + f"""
, e AS (SELECT *, status = 'RUNNING' AS hit, batch_log_id % 2 = 1 AS bad FROM batch_job_log)
SELECT batch_log_id, CASE WHEN NOT hit THEN status WHEN bad THEN 'FAILED' ELSE 'SUCCESS' END AS status,
       CASE WHEN hit THEN {_ts(W)} ELSE finished_at END AS finished_at,
       CASE WHEN NOT hit THEN next_retry_at WHEN bad AND attempt_no < greatest(1, max_attempts)
            THEN {_ts(W)} + INTERVAL 5 MINUTE END AS next_retry_at,
       CASE WHEN hit AND NOT bad THEN '{{"job":"' || job_name || '","note":"완료","suffix":null}}' ELSE result_payload END
         AS result_payload,
       CASE WHEN NOT hit THEN error_message WHEN bad THEN '실패 ' || job_name END AS error_message,
       CASE WHEN hit THEN {_ts(W)} ELSE last_modified_date END AS last_modified_date FROM e
""")

_reg("resolve_patient_indexed", ORACLE["resolve_patient"])

_reg("treatment_mix_folded", duck_with("treatments") + """
, t AS (SELECT CASE treatment_id % 4 WHEN 0 THEN lower(treatment_type) WHEN 1 THEN replace(treatment_type, 'E', 'É')
               WHEN 2 THEN upper(treatment_type[1]) || lower(treatment_type[2:]) ELSE treatment_type END AS treatment_type
        FROM treatments)
, p AS (SELECT coalesce(nullif(trim(treatment_type), ''), '미분류') AS spelling, count(*) AS n FROM t GROUP BY 1)
SELECT min(spelling) AS name, count(*) AS spellings, sum(n)::BIGINT AS value FROM p GROUP BY lower(strip_accents(spelling))
""")


# ---- snapshots as cells: every block of the two dashboards, stated from the blocks' own statements ----

def _cells_sql(block, sql, position, texts=(), numbers=(), item="0"):
    """Cells of the rows of ``sql``: (SQL expression, field) pairs of text and of number fields."""
    head = f"SELECT '{block}' AS block, CAST({position} AS INTEGER) AS position"
    out = [f"{head}, '{f}' AS field, CAST({item} AS INTEGER) AS item, CAST({x} AS VARCHAR) AS text, "
           f"CAST(NULL AS DOUBLE) AS number FROM ({sql})" for x, f in texts]
    out += [f"{head}, '{f}' AS field, CAST({item} AS INTEGER) AS item, CAST(NULL AS VARCHAR) AS text, "
            f"CAST({x} AS DOUBLE) AS number FROM ({sql})" for x, f in numbers]
    return out


def _pairs(*names):
    return [(n, n) for n in names]


def _placed(key, order):
    """The statement of a newest-n list with each row's place."""
    head, tail = ORACLE[key].rsplit("\nSELECT ", 1)
    return f"{head}\nSELECT row_number() OVER (ORDER BY {order}) - 1 AS place, {tail}"


_reg("snapshot_cells", "\nUNION ALL\n".join(
    _cells_sql("gauge", ORACLE["gauge"], 0, _pairs("title"), _pairs("current", "max_value"))
    + _cells_sql("timeline", ORACLE["timeline"], 0, [("label", "labels")], [("value", "values")], item="month_idx")
    + _cells_sql("pie_sales", f"SELECT *, row_number() OVER (ORDER BY value DESC, name DESC) - 1 AS place "
                 f"FROM ({ORACLE['treatment_mix']})", "place", _pairs("name"), _pairs("value"))
    + _cells_sql("league_table", f"SELECT DISTINCT rank, name, actual, target FROM ({ORACLE['league_table']})", "rank - 1",
                 _pairs("name"), _pairs("actual", "target"))
    + _cells_sql("league_table", ORACLE["league_table"], "rank - 1", (), [("spark_value", "spark")], item="month_idx")
    + _cells_sql("production", ORACLE["production_top"], 0, [("category", "categories")], [("value", "values")], item="rank - 1")
    + _cells_sql("kpi", ORACLE["kpi_revenue"], 0, _pairs("label"), _pairs("actual", "target"))
    + _cells_sql("kpi", ORACLE["kpi_growth"], 0, (), _pairs("growth_pct"))))

_reg("wearable_snapshot_cells", "\nUNION ALL\n".join(
    _cells_sql("connected", "SELECT 1", 0, [("TRUE", "connected")])
    + _cells_sql("generated_at", "SELECT 1", 0, [(f"strftime({_ts(W)}, {FMT_TS})", "generated_at")])
    + _cells_sql("table_counts", f"SELECT *, row_number() OVER (ORDER BY ordinal) - 1 AS place FROM ({ORACLE['table_counts']})",
                 "place", _pairs("table_key", "label_kr", "sql_name"), _pairs("total_count"))
    + _cells_sql("etl", f"SELECT s.* FROM (SELECT 1) LEFT JOIN (SELECT * FROM ({ORACLE['etl_state']}) "
                 "WHERE job_code = 'wearable_round_robin') s ON TRUE", 0, [("updated_at", "wearable_updated_at")],
                 [("cursor_value", "wearable_round_robin_cursor")])
    + _cells_sql("clinical_by_category", f"SELECT *, row_number() OVER (ORDER BY count DESC, category DESC) - 1 AS place "
                 f"FROM ({ORACLE['clinical_by_category']})", "place", _pairs("category", "label_kr"), _pairs("count"))
    + _cells_sql("vitals_aggregate", ORACLE["vitals_aggregate"], 0, (), _pairs(
        "total_vitals", "today_vitals", "pending_mysql_sync", "avg_heart_rate_24h", "pending_daily_mysql_sync"))
    + _cells_sql("recent_vitals", _placed("recent_vitals", "top.measured_at DESC, top.vital_id DESC"), "place",
                 _pairs("vital_id", "patient_no", "measured_at", "source_channel", "synced_mysql", "patient_no_sha256"),
                 _pairs("heart_rate_bpm", "blood_pressure_systolic", "blood_pressure_diastolic", "body_temp_c", "stress_score"))
    + _cells_sql("recent_clinical_events", _placed("recent_events", "top.occurred_on DESC, top.clinical_event_id DESC"), "place",
                 _pairs("clinical_event_id", "patient_no", "category", "occurred_on", "department", "title", "status",
                        "source_mysql_treatment_id", "category_kr", "status_kr", "patient_no_sha256"))
    + _cells_sql("include_mysql_treatment_id_column",
                 f"SELECT coalesce(bool_or(include_mysql_treatment_id_column), FALSE) AS f FROM ({ORACLE['recent_events']})", 0,
                 [("f", "include_mysql_treatment_id_column")])
    + _cells_sql("daily_wellness_sample_rows", _placed("recent_wellness", "top.summary_date DESC, top.patient_no ASC"), "place",
                 _pairs("patient_no", "summary_date", "synced_mysql", "patient_no_sha256"),
                 _pairs("step_count", "step_goal", "sleep_hours", "stress_level"))))
