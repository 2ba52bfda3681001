"""Display and label behaviour (ported from the reference's unit tests as
expectations on DataFrame columns)."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F
from pyspark.sql import types as T

from clinops.functions import display, labels


def one(spark, schema, values, expr_fn):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(expr_fn(F.col(df.columns[0]), df.schema.fields[0].dataType)).collect()]


def test_datetime_caption_none_date_naive(spark):
    s = T.StructType([T.StructField("v", T.TimestampNTZType())])
    assert one(spark, s, [None, dt.datetime(2024, 3, 5, 7, 8, 9)], display.format_datetime) == [
        None, "2024년 3월 5일 07:08"]
    s = T.StructType([T.StructField("v", T.DateType())])
    assert one(spark, s, [dt.date(2024, 12, 31)], display.format_datetime) == ["2024년 12월 31일"]


def test_datetime_caption_iso_text(spark):
    s = T.StructType([T.StructField("v", T.StringType())])
    got = one(spark, s, ["2024-01-02T03:04:05.123456", "2024-01-02T03:04:05Z", "2024-01-02T03:04:05+09:00",
                         "2024-01-02T20:30:00-05:00", "Text", "plain", None], display.format_datetime)
    assert got == ["2024년 1월 2일 03:04", "2024년 1월 2일 12:04", "2024년 1월 2일 03:04",
                   "2024년 1월 3일 10:30", "Text", "plain", None]


def test_cell_display_decimal(spark):
    s = T.StructType([T.StructField("v", T.DecimalType(10, 2))])
    got = one(spark, s, [Decimal("10.00"), Decimal("1.50"), None], display.cell_display)
    assert got == ["10", "1.5", None]


def test_format_cells_keeps_hash_columns(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 9, 0), "2024-01-01T00:00:00")],
                               "t timestamp_ntz, x_sha256 string")
    out = display.format_cells(df).collect()[0]
    assert out["t"] == "2024년 1월 1일 09:00"
    assert out["x_sha256"] == "2024-01-01T00:00:00"


def test_status_label(spark):
    df = spark.createDataFrame([("COMPLETED",), ("completed",), (None,), ("  ",), ("UNKNOWN_X",), (" pending ",)], "c string")
    got = [r[0] for r in df.select(labels.status_label(F.col("c"))).collect()]
    assert got == ["완료", "완료", None, None, "UNKNOWN_X", "대기"]


def test_category_label(spark):
    df = spark.createDataFrame([("OUTPATIENT",), ("lab",), (None,), ("",), ("ERROR",)], "c string")
    got = [r[0] for r in df.select(labels.category_label(F.col("c"))).collect()]
    assert got == ["외래", "검사실", "기타", "기타", "ERROR"]


def test_translate_values(spark):
    df = spark.createDataFrame([("M", None, "scheduler", 1), ("y", "", "RETRIED", 0), ("x", "HQ", None, 5)],
                               "g string, intt_cd string, t string, n int")
    out = labels.translate_values(df, ["g", "intt_cd", "t", "n"]).collect()
    assert [tuple(r) for r in out] == [("남", "본원", "스케줄러", "예"), ("예", "본원", "재처리됨", "아니오"),
                                      ("x", "HQ", "없음", "5")]


def test_column_captions(spark):
    assert labels.column_caption("patient_no") == "환자번호"
    assert labels.column_caption("foo_id") == "식별자"
    assert labels.column_caption("visit_no") == "번호"
    assert labels.column_caption("use_yn") == "여부"
    assert labels.column_caption("zip_code") == "코드"
    assert labels.column_caption("run_status") == "상태"
    assert labels.column_caption("visit_time") == "일시"
    assert labels.column_caption("nick_name") == "명칭"
    assert labels.column_caption("anything") == "항목"
    df = spark.createDataFrame([(1, "a")], "patient_no long, foo_id string")
    caps = labels.column_captions(spark, df, "t").collect()
    assert [(r.ordinal, r.column_name, r.caption) for r in caps] == [(1, "patient_no", "환자번호"), (2, "foo_id", "식별자")]
    meta = labels.with_captions(df).schema["foo_id"].metadata
    assert meta["caption"] == "식별자"
