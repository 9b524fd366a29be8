"""Event, labeling and data-preparation engine for ordered series on Spark."""

__version__ = "0.1.0"
