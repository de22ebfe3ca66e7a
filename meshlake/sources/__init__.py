"""Where rows come from: Parquet tables, and the same tables as streams."""
