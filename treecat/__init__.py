"""Query engine for hierarchical sample catalogs, on Spark DataFrames.

>>> import treecat
>>> d = treecat.load("s3a://bucket/catalog")
>>> d.filter_datetime("2023-01-01/2023-01-31", level=1).data.head()
"""

from .dataset import Dataset, from_levels
from .frame import Frame, available_backends, register_backend
from .loader import clear_cache, get_backend, load, use
from .logs import verbose
from .operators.concat import concat

__version__ = "0.1.0"

__all__ = ["Dataset", "Frame", "available_backends", "clear_cache", "concat", "from_levels", "get_backend", "load", "register_backend", "use", "verbose"]
