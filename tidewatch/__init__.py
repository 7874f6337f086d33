"""Threat-hunting analytics over endpoint telemetry, as Spark DataFrame operators."""
