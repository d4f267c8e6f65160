"""quern: a PySpark-native engine that grinds raw text and dialogue into training data.

Operators are functions from DataFrames (or Columns) to DataFrames; Catalyst
plans them.  Sub-packages: ``functions`` (Column builders), ``operators``
(DataFrame transforms), ``sources`` (readers and writers), ``plans`` (named
queries with their SQL oracles), ``streaming``, and the optional ``llm``.
"""

__version__ = "0.1.0"
