"""Virtual file paths: plain functions for single paths, Column versions for tables."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, functions as F

from .. import constants as C
from ..errors import FormatError

_SUBFILE = r"^/vsisubfile/(\d+)_(\d+),(.*)$"


def is_local(path: str) -> bool:
    return not re.match(r"[A-Za-z][A-Za-z0-9+.-]*://", path) and not is_vsi(path)


def is_vsi(path: str) -> bool:
    return path.startswith((*C.VSI_OF_SCHEME.values(), C.VSI_HTTP, C.VSI_SUBFILE, C.VSI_ZIP))


def to_vsi(path: str) -> str:
    """A storage path as a virtual one; local paths become absolute, unknown schemes stay."""
    if path.startswith(("http://", "https://")):
        return C.VSI_HTTP + path
    for scheme, prefix in C.VSI_OF_SCHEME.items():
        if path.startswith(scheme):
            return prefix + path[len(scheme) :]
    return os.path.realpath(path) if is_local(path) else path


def from_vsi(path: str) -> str:
    """The opposite of :func:`to_vsi`; ``/vsiaz/`` gives ``az://``."""
    if path.startswith(C.VSI_HTTP):
        return path[len(C.VSI_HTTP) :]
    for scheme, prefix in C.VSI_OF_SCHEME.items():
        if path.startswith(prefix):
            return scheme + path[len(prefix) :]
    return path


def parse_subfile(pointer: str) -> tuple[str, int, int]:
    """(root, offset, size) of ``/vsisubfile/{offset}_{size},{root}``."""
    if not (found := re.match(_SUBFILE, pointer, re.S)):
        raise FormatError(f"not a byte-range pointer: {pointer!r}")
    return found[3], int(found[1]), int(found[2])


def subfile(offset: Column, size: Column, root: Column) -> Column:
    """Byte-range pointers; null where any part is."""
    return F.concat(F.lit(C.VSI_SUBFILE), offset.cast("string"), F.lit("_"), size.cast("string"), F.lit(","), root)


def subfile_parts(pointer: Column) -> tuple[Column, Column, Column]:
    """(root, offset, size) columns of byte-range pointers; null where it is none."""
    part = lambda n: F.when(pointer.rlike(_SUBFILE), F.regexp_extract(pointer, _SUBFILE, n))
    return part(3), part(1).cast("long"), part(2).cast("long")


def folder_pointer(root: Column, below: Column, kind: Column) -> Column:
    """Pointers of a plain folder: a FOLDER's child table or a FILE itself, below ``{root}DATA/``."""
    inside = F.when(below.endswith("/"), below).otherwise(F.concat(below, F.lit("/")))
    return F.when(kind == C.FOLDER, F.concat(root, F.lit("DATA/"), inside, F.lit("__meta__"))).when(kind == C.FILE, F.concat(root, F.lit("DATA/"), below))


def with_slash(root: str) -> str:
    return root if root.endswith("/") else root + "/"
