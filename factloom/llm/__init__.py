"""Training-data pipeline operators.

A self-contained subpackage: nothing else in ``factloom`` imports it, and it
imports nothing of the relational side.  Every operator takes DataFrames and
column names and returns a DataFrame; the thin ``opN_*`` queries that apply
them to the whole driver tables are in :mod:`factloom.llm.registry`.
"""
