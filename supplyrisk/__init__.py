"""supplyrisk: supply-risk analytics as Spark DataFrame operators.

Every public function takes and returns a ``pyspark.sql.DataFrame`` (or a
``Column`` for scalar rules), so callers compose them into one lazy plan
and Catalyst decides joins, shuffles and pushdown.  Modules:

* ``sources``    typed scans, sinks, the binding to the driver test tables
* ``functions``  column-level rules (bands, rounding, days of supply, ...)
* ``operators``  panel, features, labels, validation, star schema,
                 reports, evaluation and the risk model
* ``plans``      plan inspection helpers used by tests and the bench
* ``streaming``  (empty: the workload is batch only)
"""

from supplyrisk.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
