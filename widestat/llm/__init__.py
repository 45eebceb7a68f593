"""Operators of a training-data pipeline: thirteen document operators over tables
with an integer id and a text column.  Nothing else in the library imports
this subpackage; `queries` registers one query per operator."""
