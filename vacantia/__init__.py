"""vacantia: a PySpark-native engine for corpora of job postings."""
