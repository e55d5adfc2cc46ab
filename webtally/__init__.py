"""Profile, clean and count large web-crawl text corpora with PySpark DataFrames."""
