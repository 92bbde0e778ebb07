"""Loan-book analytics as DataFrame-to-DataFrame operators on Spark."""
