"""Operators over DataFrames: preparing tables, joins, aggregations, ranking, labelling, graphs, export, validation."""
