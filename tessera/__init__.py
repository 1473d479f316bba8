"""tessera: exploratory analytics and KPI reporting as Spark DataFrame operators.

Every operator takes a DataFrame and returns DataFrames (data and report);
nothing collects rows to the driver except per-column / per-pair aggregates
whose size is bounded by the schema, not by the data.
"""

from tessera.session import get_spark, checkpoint_dir  # noqa: F401

__version__ = "0.1.0"
