"""attestia: agreement, adjudication and governance analytics for human annotation data, on Spark."""

__version__ = "0.1.0"
