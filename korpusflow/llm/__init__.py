"""Operators for preparing language-model training data.

Nothing outside this package imports it.  Every operator takes a DataFrame and
column names and returns a DataFrame.  Common rules, unless a docstring says
otherwise: a null text counts as the empty text; a null id is an id like any
other; input columns with the name of a result column are replaced by it; an
empty table gives an empty result with the same columns.
"""
