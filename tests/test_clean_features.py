"""Cleaning bounds, coercion, calendar and spatial features on hand-made rows."""

import datetime as dt

from zonecast.config import RAW_COLUMNS
from zonecast.operators.clean import clean_trips, cleaning_summary
from zonecast.sources.trips import RAW_TEXT_SCHEMA, parse_raw_trips


def raw_text_row(**kw):
    base = dict(VendorID="1", tpep_pickup_datetime="2015-01-05 08:00:00", tpep_dropoff_datetime="2015-01-05 08:20:00",
                passenger_count="1", trip_distance="3.0", pickup_longitude="-73.98", pickup_latitude="40.75",
                dropoff_longitude="-73.95", dropoff_latitude="40.72", payment_type="1", fare_amount="12.0",
                extra="0.5", mta_tax="0.5", tip_amount="1.0", tolls_amount="0.0", improvement_surcharge="0.3",
                total_amount="14.3", store_and_fwd_flag=" n ")
    base.update(kw)
    return tuple(base[c] for c in RAW_COLUMNS)


def frame(spark, rows):
    return parse_raw_trips(spark.createDataFrame(rows, RAW_TEXT_SCHEMA))


def test_counters_and_coercion(spark):
    rows = [raw_text_row(), raw_text_row(fare_amount="abc"), raw_text_row(tpep_pickup_datetime="not a time"),
            raw_text_row(trip_distance=None), raw_text_row(extra="x"),
            raw_text_row(tpep_dropoff_datetime="2015-01-05 07:59:00")]
    s = cleaning_summary(frame(spark, rows)).first().asDict()
    # missing critical (bad timestamp, NULL distance) -> 4 left; text in fare / extra -> 2 left; dropoff<pickup -> 1
    assert s == dict(raw_rows=6, after_dropna=4, after_numeric_coercion=2, clean_rows=1, removed_rows=5)


def test_inclusive_bounds(spark):
    rows = [
        raw_text_row(tpep_dropoff_datetime="2015-01-05 08:01:00", trip_distance="1.0"),  # 1 min, speed 60 -> keep
        raw_text_row(tpep_dropoff_datetime="2015-01-05 08:00:59"),   # 0.98 min -> drop
        raw_text_row(tpep_dropoff_datetime="2015-01-05 12:00:00", trip_distance="10"),  # 240 min -> keep
        raw_text_row(passenger_count="0"), raw_text_row(passenger_count="8"), raw_text_row(passenger_count="9"),
        raw_text_row(pickup_latitude="0", pickup_longitude="0"),
        raw_text_row(pickup_latitude="41.2"), raw_text_row(pickup_latitude="41.21"),
        raw_text_row(trip_distance="0.1", tpep_dropoff_datetime="2015-01-05 08:05:00"),  # speed 1.2 -> keep
        raw_text_row(trip_distance="0.09"),
    ]
    kept = clean_trips(frame(spark, rows)).count()
    assert kept == 5


def test_features(spark):
    rows = [raw_text_row(pickup_latitude="40.765", pickup_longitude="-73.985",
                         tpep_pickup_datetime="2015-12-31 17:30:00", tpep_dropoff_datetime="2015-12-31 17:45:00",
                         store_and_fwd_flag=None),
            raw_text_row(tpep_pickup_datetime="2016-01-03 00:10:00", tpep_dropoff_datetime="2016-01-03 00:30:00")]
    out = {r["hour"]: r for r in clean_trips(frame(spark, rows)).collect()}
    a, b = out[17], out[0]
    assert a["pickup_lat_bin"] == 40.76 and a["pickup_lon_bin"] == -73.98  # half-even on x*100
    assert a["pickup_zone"] == "40.76_-73.98"
    assert a["day_of_week"] == 3 and a["week_of_year"] == 53 and a["is_month_end"] == 1
    assert a["is_peak_hour"] == 1 and a["is_high_travel_period"] == 1 and a["store_and_fwd_flag"] == "N"
    assert a["pickup_date"] == dt.date(2015, 12, 31) and a["trip_duration_min"] == 15.0
    assert b["day_of_week"] == 6 and b["is_weekend"] == 1 and b["week_of_year"] == 53 and b["is_month_start"] == 1
    assert b["store_and_fwd_flag"] == "N" and abs(b["speed_kph"] - 9.0) < 1e-12


def test_filters_reach_parquet_scan(spark):
    from zonecast.sources.trips import raw_trips
    from tests.conftest import SF_SMOKE

    plan = clean_trips(raw_trips(spark, SF_SMOKE)).select("pickup_zone")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(event_id)" in plan
    assert "props" not in plan.split("ReadSchema")[1].split("\n")[0]
