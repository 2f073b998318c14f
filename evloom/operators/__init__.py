"""Operators over DataFrames of events, graphs, versions and workflow records."""
