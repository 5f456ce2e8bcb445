"""Reusable physical patterns: skew-proof lookups, two-level prefix scans, durable cuts of lineage."""
