"""Claim analytics on Spark: DataFrame operators for scoring, planning and verifying claims."""
