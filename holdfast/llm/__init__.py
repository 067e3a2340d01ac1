"""Preparation of large text cohorts: copies, leaks, toxicity, hosts, mixing and sharding."""
