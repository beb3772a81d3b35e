"""Multi-step jobs: blocked scans, ingest, refresh and table lifecycle."""
