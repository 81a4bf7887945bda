"""Packet-traffic statistics as Spark DataFrame operators."""

from wiretally.schema import CAPTURES, GEO_SCHEMA, PACKET_SCHEMA, REPORT_SCHEMA

__all__ = ["CAPTURES", "GEO_SCHEMA", "PACKET_SCHEMA", "REPORT_SCHEMA"]
