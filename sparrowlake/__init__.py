"""sparrowlake: lazy PySpark operators for user-item interaction analytics."""

__version__ = "0.1.0"
