"""Composite queries: staging, marts, lookups, checks, the scheduled run."""
