"""Table-in, table-out PySpark operators for curating and modeling long-format measurements."""

__version__ = "0.1.0"
