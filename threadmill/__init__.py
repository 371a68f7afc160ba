"""threadmill: community discussions to question-and-answer tables on Spark.

Every operator is a ``DataFrame -> DataFrame`` function built from Spark SQL
expressions, windows, joins and aggregations, so the same code runs on a batch
table or (where it is stateless) on a streaming DataFrame.
"""

__version__ = "0.1.0"
