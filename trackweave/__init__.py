"""trackweave: urban-rail network analytics as declarative PySpark plans."""

__version__ = "0.1.1"
