"""eoframe: earth-observation cube and catalogue analytics on Spark.

Pixels are long DataFrames (one row per time, y, x; one column per band),
scenes and products are nested catalogue rows. Every operator is a function
from DataFrames/Columns to DataFrames/Columns, so Catalyst sees one plan.
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Pickle this package's functions by value inside UDFs.

    Executors then need no copy of the package on their Python path (the
    pandas-backed operators reference module-level helpers). On a cluster the
    package can also be shipped with ``--py-files``; this keeps a driver-only
    install working.
    """
    import sys
    try:
        from pyspark import cloudpickle
        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # noqa: BLE001 - older pickler: executors need the package installed
        pass


_ship_by_value()
