"""Reading change logs: log conversions, snapshots, spills and stream sources."""
