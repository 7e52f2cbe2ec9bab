"""Panel analytics for ranked events, written as Spark DataFrame plans.

A panel has one row per (event, entity); events happen in time order and each
event produces a ranking. Functions take and return DataFrames and do no I/O
unless they are sources, sinks or say so.
"""
