"""Readers and writers: delimited tables, Turtle, semantic descriptions, training files, records."""
