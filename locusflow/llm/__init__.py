"""Operators of a training-data pipeline. Nothing outside this subpackage imports it.

Every operator takes and returns DataFrames. Common rules, unless an operator's own docstring
says otherwise: a null text is an empty text, extra columns are ignored, an empty table gives an
empty result, and rows that repeat are each answered.
"""
