"""Table profiling, data-quality checks and baseline modelling as Spark jobs."""

__version__ = "0.1.0"
