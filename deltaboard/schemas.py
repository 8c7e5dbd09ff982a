"""Schemas of feeds, tables and documents."""

from __future__ import annotations



class Schema(str):
    """A DDL text, usable wherever Spark takes a schema, that knows its columns."""

    @property
    def types(self) -> dict[str, str]:
        found, depth, start = {}, 0, 0
        for i, ch in enumerate(f"{self},"):
            depth += (ch == "<") - (ch == ">")
            if ch == "," and depth == 0:
                name, kind = self[start:i].split(None, 1)
                found[name] = kind.strip()
                start = i + 1
        return found

    @property
    def names(self) -> list[str]:
        return list(self.types)


# Raw feeds, as they are landed: one JSON object per row, plus the landing columns.
LANDING = "mode string, cycle bigint, feed_seq bigint, fetched_at timestamp"

RAW_ARRIVAL = Schema(
    f"{LANDING}, id string, naptanId string, stationName string, lineId string, lineName string, "
    "platformName string, direction string, destinationName string, destinationId string, "
    "destinationNaptanId string, modeName string, currentLocation string, towards string, "
    "timeToLive string, timeToStation int, expectedArrival timestamp"
)
RAW_BOARD = Schema(
    f"{LANDING}, requestedStation string, requestedLine string, naptanId string, stationName string, "
    "lineId string, platformName string, destinationName string, destinationNaptanId string, "
    "departureStatus string, estimatedTimeOfDeparture timestamp, scheduledTimeOfDeparture timestamp"
)
RAW_LINE = Schema("mode string, id string, name string")
RAW_STOP_POINT = Schema(
    "line_id string, naptanId string, commonName string, lat double, lon double, stopType string, "
    "indicator string, stopLetter string, icsCode string, towards string, compassPoint string, "
    "stationNaptan string"
)
RAW_ROUTE_SEQUENCE = Schema(
    "line_id string, direction string, orderedLineRoutes array<struct<naptanIds:array<string>>>"
)
STATUS_ITEM = "struct<statusSeverity:string,statusSeverityDescription:string,reason:string>"
RAW_LINE_STATUS = Schema(
    "sync_id bigint, feed_seq bigint, fetched_at timestamp, mode string, id string, name string, "
    f"lineStatuses array<{STATUS_ITEM}>"
)

# Normalised rows.
ARRIVAL = Schema(
    "mode string, cycle bigint, feed_seq bigint, fetched_at timestamp, naptan_id string, station_name string, "
    "line_id string, line_name string, platform string, direction string, dest_id string, dest_name string, "
    "towards string, eta timestamp"
)
BOARD = Schema(
    "mode string, cycle bigint, feed_seq bigint, fetched_at timestamp, naptan_id string, line_id string, "
    "entry_line_id string, platform string, dest_id string, dest_name string, status string, "
    "estimated timestamp, scheduled timestamp"
)
PLANNED = Schema(
    "mode string, cycle bigint, naptan_id string, common_name string, line_id string, line_name string"
)
# One row per finished poll: how many rows it fetched. Null boards are not waited for.
POLL = Schema("mode string, cycle bigint, fetched_at timestamp, arrivals bigint, boards bigint")
# What a board plan asks for, and its figures per mode.
BOARD_CALL = Schema("mode string, cycle bigint, pick_no int, naptan_id string, source_id string, line_id string")
BOARD_SUMMARY = Schema("mode string, candidates bigint, termini bigint, stations bigint, calls bigint, skipped bigint")
DEPARTING = Schema("line_id string, naptan_id string, departing string")

# Documents, in the canonical form: arrays sorted by key, so that they compare
# field by field. Maps appear in the JSON payload only.
ITEM = "struct<destId:string,platform:string,eta:string,displayName:string>"
DIRECTION = f"struct<direction:string,preds:array<{ITEM}>>"
LINE = f"struct<line_id:string,line_name:string,dirs:array<{DIRECTION}>>"
STATION_DOC = Schema(
    f"mode string, cycle bigint, station_key string, id string, name string, lut string, lines array<{LINE}>"
)

MODES = "array<struct<mode:string,lines:array<struct<id:string,name:string,directions:array<string>>>>>"
STATION = Schema(
    "naptan_id string, common_name string, lat double, lon double, geo_hash string, stop_type string, "
    "indicator string, stop_letter string, last_updated bigint, ics_code string, towards string, "
    f"compass_point string, station_naptan string, modes {MODES}, search_keys array<string>"
)
MODES_JSON = (
    "map<string,struct<modeName:string,"
    "lines:map<string,struct<id:string,name:string,directions:array<string>>>>>"
)
# The stored station row: nested columns as JSON text.
STATION_ROW = Schema(
    "naptan_id string, common_name string, lat double, lon double, geo_hash string, stop_type string, "
    "indicator string, stop_letter string, last_updated string, ics_code string, towards string, "
    "compass_point string, station_naptan string, modes_json string, search_keys_json string"
)
LINE_STATUS = Schema(
    "id string, name string, mode string, description string, reason string, last_updated bigint"
)
ROUTE_DIRECTIONS = Schema("line_id string, directions_json string, last_updated bigint")
DIRECTIONS_JSON = "array<struct<direction:string,destinations:array<struct<id:string>>>>"
SUBSCRIBED = Schema("naptan_id string")
SUBSCRIBED_DOC = Schema("doc_id string, stationCounts map<string,bigint>, last_updated string")
SYNC_METADATA = Schema("key string, value string")

# State tables.
STATION_STATE = Schema("mode string, station_key string, cycle bigint, digest string, last_emit bigint")
FENCE = Schema("mode string, cycle bigint")
STATUS_STATE = Schema("id string, sync_id bigint, description string, reason string")
QUEUE = Schema("channel string, topic string, payload string, since bigint")
OUTBOX = Schema(
    "channel string, topic string, payload string, priority string, ttl_ms bigint, batch_no bigint, batch_id bigint"
)
