"""Directories of files and spellings of time."""

import datetime as dt

import pandas as pd
import pytest

from barloom.plans.ingest import ingest, ingest_directory
from barloom.sources import tables
from barloom.sources.delimited import Layout, read_files
from barloom.sources.timestamps import PATTERNS, recognized


@pytest.mark.parametrize(
    "text,want",
    [
        ("13 Jan 2024", "2024-01-13"), ("13.01.24", "2024-01-13"), ("13/1/24 12:30 PM", "2024-01-13 12:30"),
        ("Jan 13, 2024 12:00 AM", "2024-01-13"), ("1/13/2024 1:05:07 pm", "2024-01-13 13:05:07"),
        ("Saturday, 13 January 2024 9 pm", "2024-01-13 21:00"), ("13-JAN-76", "1976-01-13"),
        ("2024-01-13T09:05:06.1234567Z", "2024-01-13 09:05:06.123456"), ("2024-01-13 09:05:06+0530", "2024-01-13 03:35:06"),
        ("13.01.2024 09:00:00.000 GMT-0100", "2024-01-13 10:00"), ("20240113", "2024-01-13"), ("20240113.0", "2024-01-13"),
        ("20240113 0905", "2024-01-13 09:05"), ("20240113090507", "2024-01-13 09:05:07"), ("20240113T090507", "2024-01-13 09:05:07"),
        ("2024/1/3 9:05", "2024-01-03 09:05"), ("3.4.2024", "2024-04-03"), (" May 3rd, 1999 ", "1999-05-03"), ("29.02.2024", "2024-02-29"),
    ],
)
def test_spellings(spark, text, want):
    row = spark.createDataFrame([(text,)], "t string").select(recognized("t").alias("ts")).first()
    assert row.ts == pd.Timestamp(want).to_pydatetime()


def test_what_is_no_time(spark):
    texts = ["", " ", None, "x", "12", "1.5", "1.2345", "31.02.2024", "2024-13-45", "2024-01-13 25:00", "13 Jan 2024 13:00 PM"]
    texts += ["99999999", "1704067200", "09:00", "jan", "2024-01-13 tail", "-5", "1e5", "13 Foo 2024", "2024-01-13 09:00 " * 3000]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", recognized("t").alias("ts")).collect()
    assert [r.t for r in rows if r.ts is not None] == [] and len(PATTERNS) == 34


HOURS = pd.date_range("2024-01-01", periods=240, freq="h")


def bars(order, sep=",", spell="%Y-%m-%d %H:%M", shift=0, quote=False, note=None):
    """A file with a header in the given order; open 1, high 9, low 0.5, close 2, plus the row."""
    rows = [sep.join(order)]
    for i, t in enumerate(HOURS):
        known = {"Open": 11 + i, "High": 19 + i, "Low": 10 + i, "Close": 12 + i, "Volume": i + 1, "Note": note}
        cells = [t.strftime(spell) if c in ("Date", "Gmt time", "Timestamp") else str(known[c] + shift if c != "Note" else note) for c in order]
        rows.append(sep.join(f'"{c}"' if quote or "\n" in c or sep in c else c for c in cells))
    return "\n".join(rows) + "\n"


@pytest.fixture()
def folder(tmp_path):
    files = {
        "EURUSD60.csv": bars(["Date", "Open", "High", "Low", "Close", "Volume"]),
        "GBPUSD60.csv": bars(["Date", "Close", "High", "Low", "Open", "Volume"], spell="%d %b %Y %I:%M %p", shift=100),
        "USD_JPY data.csv": bars(["Gmt time", "Low", "Open", "High", "Close"], sep=";", spell="%d.%m.%y %H:%M", quote=True, shift=200),
        "AUDCAD60.csv": bars(["Timestamp", "Open", "High", "Low", "Close", "Note"], note='two\nlines, ""quoted""'),
        "XAUUSD60.csv": "Date Time Open High Low Close\n" + "".join(f"{t:%Y.%m.%d}  {t:%H:%M} {11 + i} {19 + i}\t{10 + i} {12 + i}\n" for i, t in enumerate(HOURS)),
        "NZDUSD5.csv": "Timestamp,Bid,Ask,Last\n" + "".join(f"{t + dt.timedelta(minutes=m):%Y-%m-%d %H:%M},1,3,2\n" for t in HOURS for m in (0, 1, 5)),
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    return tmp_path


def test_each_file_has_its_own_layout(spark, folder):
    found = ingest_directory(spark, str(folder))
    got = found.bars.toPandas().sort_values(["instrument", "ts"])
    for name, shift in (("EUR_USD", 0), ("GBP_USD", 100), ("USD_JPY", 200), ("AUD_CAD", 0), ("XAU_USD", 0)):
        b = got[got.instrument == name].reset_index(drop=True)
        assert list(b.ts) == list(HOURS), name
        for column, first in (("open", 11), ("high", 19), ("low", 10), ("close", 12)):
            assert list(b[column]) == [first + shift + i for i in range(240)], (name, column)
    ticks = got[got.instrument == "NZD_USD"]
    assert len(ticks) == 480 and set(ticks.close) == {2.0} and ticks.volume.sum() == 720
    assert found.files.where("code IS NOT NULL").count() == 0 and len(found.mappings) == 6
    account = {r.instrument: r for r in found.accounting.collect()}
    assert all(account[n].uploaded_rows == account[n].parsed_rows == account[n].usable_rows == 240 for n in ("EUR_USD", "GBP_USD", "USD_JPY", "XAU_USD"))
    assert account["AUD_CAD"].parsed_rows == 240 and account["NZD_USD"].parsed_rows == 720


def test_files_that_cannot_be_read_are_issues(spark, folder):
    whole = bars(["Date", "Open", "High", "Low", "Close"])
    (folder / "CHFJPY60.csv").write_text(whole + "2024-02-01,1,2\n2024-02-01,1,2\n")
    (folder / "CADJPY60.csv").write_text(bars(["Date", "Open", "High", "Low"]))
    (folder / "EURGBP60.csv").write_text("just text\n\nand more\n")
    (folder / "EURCHF.csv").write_text("Timestamp,Bid,Last\n" + "".join(f"{t},1,2\n" for t in HOURS))
    (folder / "GBPJPY60.csv").write_text("".join(f"{t:%Y-%m-%d %H:%M},1,1\n" for t in HOURS))
    (folder / "EURJPY60.csv").write_text(bars(["Timestamp", "Open", "High", "Low", "Close", "Note"], note="a\nb") + '2024-02-01,1,"2\n2"\n')
    (folder / "GBPCHF60.csv").write_text(bars(["Date", "Open", "High", "Low", "Close"], spell="day %j"))
    found = ingest_directory(spark, str(folder))
    codes = {(r.instrument, r.code): r.n for r in found.issues.collect() if r.severity == "error"}
    assert codes.pop(("CHF_JPY", "malformed_rows")) == 2 and codes.pop(("EUR_JPY", "malformed_rows")) == 1
    assert set(codes) == {
        ("CAD_JPY", "missing_columns"), ("EUR_GBP", "too_few_columns"), ("EUR_CHF", "missing_timeframe"),
        ("GBP_JPY", "ambiguous_columns"), ("GBP_CHF", "bad_timestamp_format"), ("GBP_CHF", "insufficient_rows_after_cleaning"),
    }
    sizes = {r.instrument: r["count"] for r in found.bars.groupBy("instrument").count().collect()}
    assert sizes == {"EUR_USD": 240, "GBP_USD": 240, "USD_JPY": 240, "AUD_CAD": 240, "XAU_USD": 240, "NZD_USD": 480}
    account = {r.instrument: (r.uploaded_rows, r.parsed_rows, r.usable_rows) for r in found.accounting.collect()}
    assert account["CHF_JPY"] == (242, 0, 0) and account["GBP_CHF"] == (240, 240, 0)


def test_records_keep_quotes_and_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,"b ""q"", c",d\n"x\ny",,"z"\n1,2\n')
    rows = read_files(spark, [str(tmp_path / "a.csv")], Layout(",", 3, None), True).collect()
    assert [tuple(r)[2:5] for r in rows[:2]] == [("a", 'b "q", c', "d"), ("x\ny", None, "z")]
    assert [r["_corrupt"] is None for r in rows] == [True, True, False]


def test_a_column_of_mixed_times(spark):
    rows = ["Time,Open,High,Low,Close"]
    for i, t in enumerate(HOURS):
        spelled = t.strftime(["%Y-%m-%d %H:%M", "%d %b %Y %I:%M %p", "%d.%m.%y %H:%M", "%Y%m%d %H%M"][i % 4])
        rows.append(f"{spelled if i else 'unknown'},2,3,1,2")
    lines = spark.createDataFrame([(0, i, r) for i, r in enumerate(rows)], "block int, line bigint, value string")
    found = ingest(lines, "A")
    assert found.bars.count() == 239 and found.accounting.first().invalid_timestamp == 1
    lost = spark.createDataFrame([(0, 0, rows[0])] + [(0, i, "some day,2,3,1,2") for i in range(1, 300)], "block int, line bigint, value string")
    found = ingest(lost, "A")
    assert "bad_timestamp_format" in {r.code for r in found.issues.collect()} and found.bars.count() == 0


def test_fingerprints_see_where_a_null_is(spark):
    schema = "instrument string, ts timestamp_ntz, bid double, ask double"
    at = dt.datetime(2024, 1, 31, 5)
    a = spark.createDataFrame([("A", at, None, 5.0), ("B", at, 1.0, 2.0)], schema)
    b = spark.createDataFrame([("B", at, 1.0, 2.0), ("A", at, 5.0, None)], schema)
    assert tables.fingerprint(a).first() != tables.fingerprint(b).first()
    assert tables.fingerprint(a).first() == tables.fingerprint(a.orderBy("bid")).first()
    parts = [tables.part_fingerprints(x) for x in (a, b)]
    assert [tuple(r) for r in tables.differing_parts(*parts).collect()] == [("A", "2024-01", 1, 1)]
    assert tables.whole_fingerprint(parts[0]).first() == tables.fingerprint(a).first()
    assert tables.whole_fingerprint(tables.part_fingerprints(a.limit(0))).first() == tables.fingerprint(a.limit(0)).first()
    one = tables.united(tables.part_fingerprints(a.where("bid > 0")), tables.part_fingerprints(a.where("bid IS NULL")))
    assert tables.differing_parts(parts[0], one).count() == 0
    assert {r.found_rows for r in tables.differing_parts(parts[0], parts[1].where("instrument = 'B'")).collect()} == {None}


def test_the_clock_is_searched_once(spark):
    """One search tells the date, the clock's parts and what is left; texts with marks are no times."""
    table = spark.createDataFrame([("2024-01-01 10:00\n",), ("2024-01-01\x01 10:00",), ("2024-01-01 10:00 pm +0530",)], "t string")
    plan = table.select(recognized("t").alias("ts"))._jdf.queryExecution().analyzed().toString()
    assert plan.count(r"[t, ]+(\d{1,2})(?::(\d{2})") == 1
    got = [str(r.ts) for r in table.select(recognized("t").alias("ts")).collect()]
    assert got == ["2024-01-01 10:00:00", "None", "2024-01-01 16:30:00"]
