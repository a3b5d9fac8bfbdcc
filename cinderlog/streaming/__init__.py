"""Continuous jobs: ingest, windowed counts and the alert loop."""
