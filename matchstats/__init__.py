"""Match statistics on Spark: ingest, running player and character state, statistic cells, rollups and player views."""
