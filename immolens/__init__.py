"""immolens — property-listings analytics on Spark.

Every public operator is a ``DataFrame -> DataFrame`` transformation built
from ``pyspark.sql.functions`` (no Python UDFs).  Layout:

* ``sources``   – driver-table adapter, snapshot files, model/metric stores
* ``functions`` – column-level helpers (text, numbers, labels)
* ``operators`` – quality, cleaning, features, warehouse, marts, market
                  panels, models, scoring
* ``plans``     – end-to-end jobs and the query catalogue
"""

from immolens.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
