"""Constant lookups of the data model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop type that a mode's stations must have.
STOP_TYPE_BY_MODE = {
    "bus": "NaptanPublicBusCoachTram",
    "tube": "NaptanMetroStation",
    "underground": "NaptanMetroStation",
    "overground": "NaptanRailStation",
    "elizabeth-line": "NaptanRailStation",
    "dlr": "NaptanMetroStation",
    "national-rail": "NaptanRailStation",
    "tram": "NaptanPublicBusCoachTram",
    "river-bus": "NaptanFerryPort",
    "cable-car": "NaptanCableCarStation",
}
BUS_STOP_TYPE = "NaptanPublicBusCoachTram"

# Modes whose platforms are assigned late, and modes with boards.
LATE_PLATFORM_MODES = ["overground", "dlr", "elizabeth-line"]
BOARD_MODES = ["elizabeth-line", "overground"]

# Twin records of two stations, as (mode, record to publish under,
# record with the usable rows, name to publish).
STATION_ALIASES = [
    ("elizabeth-line", "910GLIVST", "910GLIVSTLL", "London Liverpool Street"),
    ("elizabeth-line", "910GPADTON", "910GPADTLL", "London Paddington"),
]

# Display priority of a severity code; codes not listed have 0.
CODES_BY_PRIORITY = {
    9: [1, 2, 16, 20],
    8: [4],
    7: [3, 5, 11],
    6: [6],
    5: [7, 8, 15],
    4: [9, 14, 17],
    2: [12, 13, 19],
    1: [0],
}

GOOD_SERVICE = "Good Service"
# Messages shown for a good service that comes without a reason.
GOOD_SERVICE_MESSAGES = [
    "Please mind the gap between the train and the platform. Mind the gap.",
    "Please stand behind the yellow line and stay back from the platform edge.",
    "See it, say it, sorted. Text the British Transport Police on 61016.",
    "Please hold the handrail on the escalators and always stand on the right.",
    "Please move down inside the carriages and use all available space.",
    "Please offer your seat to those who may need it more than you. Thank you.",
    "Please keep all personal belongings with you at all times. Thank you.",
    "Check before you travel. Plan your journey at tfl.gov.uk or on the TfL Go app.",
    "Please have your tickets or contactless cards ready before the barriers.",
    "Follow the signs for a way out and keep to the left when on the stairs.",
    "For a more comfortable journey, please carry a bottle of water with you.",
    "Please keep the doorways clear to allow other customers to board the train.",
]


def expected_stop_type(mode: Column) -> Column:
    """Stop type for a mode, null for an unknown mode."""
    pairs = [F.lit(part) for pair in STOP_TYPE_BY_MODE.items() for part in pair]
    return F.try_element_at(F.create_map(*pairs), F.lower(mode))
