"""DataFrame-to-DataFrame operators over readings, rollups and alerts."""
