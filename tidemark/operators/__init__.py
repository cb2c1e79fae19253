"""Governed disclosure operators over DataFrames."""
