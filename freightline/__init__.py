"""freightline: logistics analytics as Spark DataFrame transforms.

Every public function takes and returns DataFrames (or Columns); nothing is
collected to the driver.  Sub-packages:

* ``sources``    table and file readers, derived test views, sinks
* ``functions``  column-level helpers (calendar, geo, hashing, carbon factors)
* ``operators``  cleaning, data quality, joins, aggregates, windows, ordering
* ``plans``      multi-step jobs: scaling, forecasting, models, carbon, network, ledger
* ``streaming``  Structured Streaming pipelines for sensor and ledger feeds
"""

__version__ = "0.1.0"
