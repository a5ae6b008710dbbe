"""Errors, all below :class:`TreecatError`."""


class TreecatError(Exception):
    """Anything this library raises on purpose."""


class FormatError(TreecatError):
    """A path or file is not a catalog this library reads."""


class SchemaError(TreecatError):
    """A tree schema is malformed, or schemas do not fit together."""


class StorageError(TreecatError):
    """A file is missing or cannot be read."""


class QueryError(TreecatError):
    """A query's arguments do not fit the dataset."""


class NavigationError(TreecatError):
    """A sample cannot be found or descended into."""


class BackendError(TreecatError):
    """An output backend is not known or not installed."""
