"""An ordered, versioned change log of keys and values as Spark DataFrames."""

__version__ = "0.2.0"


def version_info() -> str:
    """This package's version and Spark's."""
    import pyspark

    return f"stratalog {__version__}, Spark {pyspark.__version__}"
