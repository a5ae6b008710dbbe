"""Loading of catalogs, and the settings that go with it."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession

from . import constants as C
from .dataset import Dataset, from_levels
from .errors import BackendError, QueryError
from .frame import available_backends
from .operators.concat import concat
from .sources import cache as disk_cache, collection
from .sources.backends import create_backend
from .sources.detect import detect, refuse_legacy

_settings = {"backend": "arrow"}


def use(backend: str) -> None:
    """The output backend of datasets loaded from now on."""
    if backend not in available_backends():
        raise BackendError(f"{backend!r} is not one of {available_backends()}")
    _settings["backend"] = backend


def get_backend() -> str:
    return _settings["backend"]


def load(path: str | Sequence[str], base_path: str | None = None, backend: str | None = None, cache: bool = True, persist: bool = False, spark: SparkSession | None = None, columns: dict[int, Sequence[str]] | None = None, header: str | None = None, opener: str | None = None) -> Dataset:
    """A catalog in any layout; a list is loaded and concatenated, in the list's order.

    ``base_path`` says where the archives of a consolidated catalog are, if not
    beside it. Without ``cache`` the collection document is read anew; with
    ``persist`` the level tables stay cached once read. ``columns`` names what
    is wanted of a level, beside the columns that navigation needs; archives,
    whose source cannot see a query's columns, then read no others. ``header``
    and ``opener`` are hooks (``"module:function"``) for archives with another
    header and for streams of another kind.
    """
    if not isinstance(path, str):
        paths = list(path)
        if not paths:
            raise QueryError("there is no path to load")
        spark = spark or SparkSession.builder.getOrCreate()
        one = lambda p: load(p, base_path, backend, cache, persist, spark, columns, header, opener)
        with ThreadPoolExecutor(8) as pool:  # opening is waiting for small reads
            found = list(pool.map(one, paths))
        return found[0] if len(found) == 1 else concat(found)
    refuse_legacy(path)
    backend = backend or _settings["backend"]
    if backend not in available_backends():
        raise BackendError(f"{backend!r} is not one of {available_backends()}")
    spark = spark or SparkSession.builder.getOrCreate()
    kind, where = detect(spark, path)
    if not cache:
        collection.forget()
    source = create_backend(kind)
    root = source.root(where, base_path)
    need = C.NAVIGATION[kind] | {C.PARENT_ID, C.RELATIVE_PATH, C.SOURCE_FILE}
    wanted = {n: [*need, *names] for n, names in columns.items()} if columns else None
    hooks = {"header": header, "opener": opener} if kind == C.ARCHIVE else {}
    document, raw = source.scan(spark, where, wanted, **hooks)
    dataset = from_levels(spark, document, raw, kind, where, root, backend)
    return dataset.persist() if persist else dataset


def clear_cache() -> None:
    """Forget collection documents and the disk cache."""
    collection.forget()
    disk_cache.clear()
