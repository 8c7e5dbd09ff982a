"""Column functions, table-driven."""

import pytest
from pyspark.sql import functions as F

from deltaboard.functions import codecs, lookups, severity, text, timing
from deltaboard.functions.geo import with_geohash


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


PLATFORMS = [
    ("tube", "Northbound - Platform 3", "Platform 3 (Northbound)"),
    ("tube", "Inbound - 2", "Platform 2 (Inbound)"),
    ("tube", "A -  - B", "Platform  (A)"),
    ("tube", "4", "Platform 4"),
    ("tube", "PLAT 12", "Platform 12"),
    ("tube", "plat 7b", "plat 7b"),
    ("overground", "d", "Platform D"),
    ("dlr", "4a", "Platform 4A"),
    ("dlr", "ab", "ab"),
    ("tube", "\tWestbound Platform ", "Westbound Platform"),
    ("bus", "Stop fc", "Stop FC"),
    ("BUS", "stop  k", "Stop K"),
    ("bus", "a - b", "Stop A - B"),
    ("bus", None, ""),
    ("bus", " Null ", ""),
    ("tube", "Platform Unknown", "Platform not assigned"),
    (None, "no platform", "Platform not assigned"),
    (None, "9", "Platform 9"),
]


def test_platform_labels(spark):
    got = values(
        spark, [p[:2] for p in PLATFORMS], "m string, p string", text.presentable_platform(F.col("m"), F.col("p"))
    )
    assert [g[0] for g in got] == [p[2] for p in PLATFORMS]


def test_display_names(spark):
    rows = [
        (None, "Pimlico Bus Station"), ("null", "A Underground Station"), (" \t", "B DLR Station"), (" Brixton ", "X"),
        ("NULL", None), ("Bank DLR Stop", "X"),
    ]
    got = values(spark, rows, "t string, d string", text.display_name(F.col("t"), F.col("d")))
    assert [g[0] for g in got] == ["Pimlico Bus", "A", "B", "Brixton", None, "Bank Stop"]


def test_keys_and_directions(spark):
    got = values(
        spark, [("a b/ç%",), (None,)], "c string", text.station_topic(F.col("c")), text.normalize_key(F.col("c"))
    )
    assert got == [("Station_A~B~~%", "A~B~~%"), ("Station_", "")]
    rows = [(None, "Inbound 2"), ("  ", None), ("InBound ", "x"), ("OUT", None)]
    got = values(spark, rows, "d string, p string", text.direction_or_default(F.col("d"), F.col("p")))
    assert [g[0] for g in got] == ["inbound", "outbound", "inbound ", "out"]
    assert values(spark, [("éa bC",), ("",)], "c string", text.capitalise_first(F.col("c"))) == [("Éa bC",), ("",)]


STAMPS = [
    ("1748372000000", 1748372000000, 1748372000000),
    (" -5\n", -5, -5),
    ("2026-06-01T02:06:13Z", 1780279573000, 2026),
    ("2026-06-01T02:06:13.0326", 1780279573032, 2026),
    ("2026-06-01T02:06", 1780279560000, 2026),
    ("2026-06-01T03:06:13+01:00", 1780279573000, 2026),
    ("2026-06", 0, 2026),
    ("2026-06-01", 0, 2026),
    ("99999999999999999999", 0, 2**63 - 1),
    ("x1", 0, 0),
    ("", 0, 0),
    (None, 0, 0),
]


def test_watermark_forms(spark):
    got = values(
        spark, [(s[0],) for s in STAMPS], "v string", timing.to_epoch_ms(F.col("v")), timing.numeric_prefix(F.col("v"))
    )
    assert got == [s[1:] for s in STAMPS]


def test_instants(spark):
    df = spark.sql(
        "SELECT explode(array(timestamp'2024-01-05 00:00:00', timestamp'2024-01-05 00:00:00.12',"
        " timestamp'2024-01-05 00:00:00.000450')) AS t"
    )
    got = [r[0] for r in df.select(timing.iso_instant(F.col("t"))).collect()]
    assert got == ["2024-01-05T00:00:00Z", "2024-01-05T00:00:00.120Z", "2024-01-05T00:00:00.000450Z"]


def bisected(lat, lon, precision=9):
    """Geohash by halving the ranges, bit by bit."""
    lats, lons, bits, out = [-90.0, 90.0], [-180.0, 180.0], [], ""
    for n in range(5 * precision):
        span, value = (lons, lon) if n % 2 == 0 else (lats, lat)
        mid = (span[0] + span[1]) / 2
        bits.append(int(value >= mid))
        span[0 if value >= mid else 1] = mid
    for i in range(0, len(bits), 5):
        out += "0123456789bcdefghjkmnpqrstuvwxyz"[int("".join(map(str, bits[i : i + 5])), 2)]
    return out


def test_geohash(spark):
    rows = [(51.46792, -0.20931), (0.0, 0.0), (-1e-17, -1e-17), (90.0, 180.0), (-90.0, -180.0), (57.64911, 10.40744), (None, 1.0)]
    got = [r[0] for r in with_geohash(spark.createDataFrame(rows, "lat double, lon double")).select("geo_hash").collect()]
    assert got == [None if lat is None else bisected(lat, lon) for lat, lon in rows]
    assert got[5] == "u4pruydqq"


@pytest.mark.parametrize(
    "entries, expected",
    [
        ([("10", "Good Service", None), ("6", "Severe Delays", "Signal"), ("9", "Minor Delays", "x")], ("Severe Delays", "Signal")),
        ([("9", "First", "a"), ("14", "Second", "b")], ("First", "a")),
        ([("x", "Bad code", "a"), ("99", "Odd code", "b")], ("Odd code", "b")),
        ([("x", "Bad code", "a"), (None, "No code", "b")], ("Bad code", "a")),
        ([], ("Unknown", None)),
        (None, ("Unknown", None)),
    ],
)
def test_worst_status(spark, entries, expected):
    kind = "array<struct<statusSeverity:string,statusSeverityDescription:string,reason:string>>"
    df = spark.createDataFrame([(entries,)], f"s {kind}").select(severity.worst_status(F.col("s")).alias("w"))
    assert tuple(df.select("w.*").head()) == expected


def test_severity_priorities(spark):
    got = values(
        spark, [(i,) for i in range(22)], "c int", severity.severity_priority(F.col("c"))
    )
    assert [g[0] for g in got] == [1, 9, 9, 7, 8, 7, 6, 5, 5, 4, 0, 7, 2, 2, 4, 5, 9, 4, 0, 2, 9, 0]


def test_good_service_messages_are_stable(spark):
    df = spark.range(40).select(severity.good_service_message(F.col("id")).alias("m"))
    seen = [r[0] for r in df.collect()]
    assert seen[:12] == lookups.GOOD_SERVICE_MESSAGES and seen[12:24] == seen[:12]


def test_json_columns(spark):
    rows = [('{"bus":{"modeName":"bus","lines":{"39":{"id":"39","name":"39","directions":["outbound","inbound"]}}}}', '["a"]'), ("{oops", None)]
    df = spark.createDataFrame(rows, "m string, k string")
    got = df.select(codecs.modes_from_json(F.col("m")).alias("m"), codecs.decode_list(F.col("k")).alias("k")).collect()
    assert got[0].m[0].mode == "bus" and got[0].m[0].lines[0].directions == ["inbound", "outbound"]
    assert got[0].k == ["a"] and got[1].m == [] and got[1].k == []
    back = df.limit(1).select(codecs.modes_from_json(codecs.modes_to_json(codecs.modes_from_json(F.col("m")))).alias("m")).head()
    assert back.m == got[0].m


def test_stop_type_of_mode(spark):
    got = values(spark, [("Tube",), ("river-bus",), ("rocket",)], "m string", lookups.expected_stop_type(F.col("m")))
    assert [g[0] for g in got] == ["NaptanMetroStation", "NaptanFerryPort", None]
