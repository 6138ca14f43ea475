"""Claim verification and corpus analytics expressed as Spark DataFrame operators."""
