"""cadence.sources."""
