"""AI traffic security analytics on Spark: scans, verdicts, policies, replays, audits, evaluations."""

__version__ = "0.1.0"
