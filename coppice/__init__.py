"""Survey-table preparation and forest explanation as Spark DataFrame operators."""

__version__ = "0.1.0"
