"""Operators that prepare text corpora for language-model training.

Nothing outside this subpackage imports it.  Every operator takes and returns DataFrames; the module
``registry`` holds the registered queries and their SQL.
"""
