"""End-to-end plans: arrivals cycle, line statuses, station sync, replication."""
