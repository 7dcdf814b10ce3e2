"""Relational and graph operators over DataFrames."""
