"""Market lake analytics on Spark: ingest, upsertable lake, marts, lookups, checks."""
