"""Relational, temporal, vector and graph operators over DataFrames."""
