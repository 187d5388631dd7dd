"""Operators of a training-data pipeline. Nothing else in the library imports
this subpackage; ``queries`` holds the registered queries and their SQL."""
