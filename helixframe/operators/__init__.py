"""Operators over DataFrames of variants."""
