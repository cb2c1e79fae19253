"""Disclosure and engagement analytics as Spark DataFrame jobs."""
