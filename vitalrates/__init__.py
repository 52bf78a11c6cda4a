"""vitalrates: population and vital-event rates as lazy Spark DataFrame operators.

Every public operator takes and returns ``pyspark.sql.DataFrame`` objects (or
``Column`` expressions) and never triggers an action, so whole pipelines are a
single Catalyst plan.
"""

__version__ = "0.1.0"
