"""Where rows come from and go to: JSON batches, Parquet tables, CSV exports, generated logs."""
