"""Audit risk ranking of customers as Spark jobs.

Rule-based ledger tests, a per-customer evidence matrix, audit scores and an
Isolation Forest ranking.  A high rank is a priority for review; it is never
proof of fraud, error or irregularity.
"""
