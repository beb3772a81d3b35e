"""Telemetry analytics as Spark jobs: ingest, rollups, alerts, serving and audits."""
