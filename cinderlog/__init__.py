"""Cinderlog: log analytics (ingest, search, roll-up, alerts, retention) as Spark jobs."""
