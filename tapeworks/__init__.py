"""tapeworks: a Spark-native engine for daily market panels, news events and
forecast evaluation.

Every public function takes and returns ``pyspark.sql.DataFrame`` objects and
performs no action (no ``collect``/``count``) unless its docstring says so.
Parameters such as ``as_of`` dates, lexicons and ``k`` are explicit arguments.
"""

__version__ = "0.1.0"
