"""The first-generation single-file format: reading, navigation, compilation, sanity checks."""

from .compile import compile_subset
from .container import load, load_metadata, ordered_columns, read
from .sanity import sanity_check
from .text import bytes_of, points, to_geodataframe

__all__ = ["bytes_of", "compile_subset", "load", "load_metadata", "ordered_columns", "points", "read", "sanity_check", "to_geodataframe"]
