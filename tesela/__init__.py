"""Retrieval analytics and document processing expressed as Spark plans."""

__version__ = "0.1.0"

try:  # functions travel with their tasks, so the executors need no copy of the package
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
except (ImportError, AttributeError):
    pass
