"""Mask rules on hand-made edge values."""

import datetime as dt
import hashlib

from pyspark.sql import functions as F

from clinops.functions import text
from clinops.operators.mask import sanitize


def apply(spark, fn, values):
    df = spark.createDataFrame([(v,) for v in values], "c string")
    return [r[0] for r in df.select(fn(F.col("c"))).collect()]


def test_mask_name(spark):
    assert apply(spark, text.mask_name, [None, "", " ", "a", "ab", "홍길동", "\t김"]) == [
        None, "", " ", "a*", "a*", "홍**", "김*"]


def test_mask_text(spark):
    assert apply(spark, text.mask_text, [None, "", " ", "a", "ab", "abc", "진단명입니다"]) == [
        None, "", " ", "a*", "a*", "ab*", "진단****"]


def test_mask_rrn(spark):
    assert apply(spark, text.mask_rrn, [None, "", "1234567", "12345678", "900101-1234567"]) == [
        None, "", "1******", "12345678******", "900101-1******"]


def test_mask_email(spark):
    assert apply(spark, text.mask_email, ["plain", "@dom.kr", "a@b@c", "john@x.com", " ", None]) == [
        "p****", "***@dom.kr", "a***@b@c", "j***@x.com", "", None]


def test_mask_phone(spark):
    assert apply(spark, text.mask_phone, ["", "1234", "12345", "010-1234-5678"]) == [
        "", "****", "123****2345", "010****5678"]


def test_mask_id_types(spark):
    df = spark.createDataFrame([(None, None), (7, "7"), (42, "42"), (12345678, "")], "i long, s string")
    out = df.select(text.mask_id(F.col("i")), text.mask_id(F.col("s")), text.mask_numeric_id(F.col("s"))).collect()
    assert [tuple(r) for r in out] == [(None, None, None), ("***", "***", "***"), ("***42", "***42", "***42"),
                                       ("***78", "***", None)]


def test_sanitize_rules_and_hashes(spark):
    df = spark.createDataFrame(
        [(15, "홍길동", "900101-1234567", "a@b.kr", "01012345678", "M1234", "서울시 강남구", "1990-01-01",
          dt.date(1990, 1, 1), "진료 메모", "내과")],
        "patient_no long, patient_name string, patient_rrn string, patient_email string, patient_tel string, "
        "patient_passport string, address string, patient_birth string, birth_day date, treatment_comment string, "
        "department_name string")
    r = sanitize(df).collect()[0].asDict()
    assert r["patient_no"] == "***15"
    assert r["patient_name"] == "홍**"
    assert r["patient_rrn"] == "900101-1******"
    assert r["patient_email"] == "a***@b.kr"
    assert r["patient_tel"] == "010****5678"
    assert r["patient_passport"] == "********"
    assert r["address"] == "서울***"
    assert r["patient_birth"] == "****-**-**"
    assert r["birth_day"] == dt.date(1990, 1, 1)          # typed date not masked (parity)
    assert r["treatment_comment"] == "진료***"
    assert r["department_name"] == "내과"                  # excluded name column
    assert r["patient_no_sha256"] == hashlib.sha256(b"15").hexdigest()
    assert r["patient_name_sha256"] == hashlib.sha256("홍길동".encode()).hexdigest()
    assert "patient_birth_sha256" not in r
    strict = sanitize(df, strict=True).collect()[0]
    assert strict["birth_day"] == "****-**-**"


def test_sanitize_wearable_extras(spark):
    df = spark.createDataFrame([(123, 5, "긴 제목입니다", "", None)],
                               "vital_id long, patient_no long, title string, department string, source_mysql_treatment_id long")
    r = sanitize(df, profile="wearable").collect()[0]
    assert (r.vital_id, r.patient_no, r.title, r.department, r.source_mysql_treatment_id) == (
        "***23", "***", "긴 *****", "", None)


def test_key_sidecar_is_opt_in(spark):
    from clinops.operators import vitals as V
    from clinops.sources.tables import load_view
    v = load_view(spark, "/root/testdata/sf0.001", "user_vital_measurement")
    assert "patient_no_key" not in V.recent_vitals(v).columns
    r = V.recent_vitals(v, with_keys=True).collect()[0]
    assert r.patient_no == "***" + str(r.patient_no_key)[-2:] or len(str(r.patient_no_key)) < 2


def test_hash_salt_option(spark):
    df = spark.createDataFrame([(15,)], "patient_no long")
    plain = sanitize(df).collect()[0].patient_no_sha256
    salted = sanitize(df, hash_salt="s3cr3t").collect()[0].patient_no_sha256
    assert plain == hashlib.sha256(b"15").hexdigest()
    assert salted == hashlib.sha256(b"s3cr3t15").hexdigest()
