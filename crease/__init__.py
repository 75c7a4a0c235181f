"""crease — ball-by-ball sports analytics as Spark DataFrame operators.

Every public operator takes and returns ``pyspark.sql.DataFrame`` objects and
stays lazy unless its docstring says it runs a (small, bounded) action.
Column names are parameters, so the operators also apply to other event tables.
"""

__version__ = "0.1.0"
