"""Market and company research on Spark: tables of bars, events, news, filings and documents in, DataFrames out."""
