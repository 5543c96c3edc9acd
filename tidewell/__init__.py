"""tidewell: data access and analytics expressed as Spark logical plans."""

__version__ = "0.1.0"
