"""millrace: data-pipeline operators as pure ``DataFrame -> DataFrame`` functions on Spark."""

__version__ = "0.1.0"
