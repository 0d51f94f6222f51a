"""File formats as Spark data sources, and files as sinks."""
