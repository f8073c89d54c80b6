"""Operators that prepare text for language-model training.

Every operator takes and returns DataFrames, keeps row data off the driver and
writes what it reads twice as a table in the folder the cluster shares.
"""
