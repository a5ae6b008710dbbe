"""Seekable byte streams that tasks open by path, without the JVM.

Local paths and ``file:`` are opened directly, http(s) by range requests, other
schemes through ``pyarrow.fs``. Spark's names of schemes are understood:
``s3a`` and ``s3n`` are S3 (at ``AWS_ENDPOINT_URL``, in ``AWS_REGION``, if set), ``az`` and ``azure`` are containers of the account
that ``AZURE_STORAGE_ACCOUNT`` names. Where that does not do, an opener of the
user's own, named as ``"module:function"``, takes the path and gives the stream.
"""

from __future__ import annotations

import importlib
import io
import os
import urllib.request
from collections.abc import Callable
from urllib.parse import unquote, urlsplit

import pyarrow.fs as pafs

from ..errors import StorageError

BUFFER = 1 << 20


def named(hook: str) -> Callable:
    """The function that ``"module:function"`` names."""
    module, mark, name = hook.partition(":")
    if not mark:
        raise StorageError(f"{hook!r} does not name a function as module:function")
    return getattr(importlib.import_module(module), name)


class _Ranged(io.RawIOBase):
    """A file of which any bytes [a, b) can be had."""

    def __init__(self, size: int, fetch: Callable[[int, int], bytes]):
        self._size, self._fetch, self._at = size, fetch, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, to: int, whence: int = 0) -> int:
        self._at = to + (0, self._at, self._size)[whence]
        return self._at

    def tell(self) -> int:
        return self._at

    def readinto(self, into) -> int:
        end = min(self._at + len(into), self._size)
        if end <= self._at:
            return 0
        got = self._fetch(self._at, end)
        into[: len(got)] = got
        self._at += len(got)
        return len(got)


def window(whole, offset: int, size: int) -> io.RawIOBase:
    """Bytes [offset, offset + size) of a seekable file, as a file."""

    def fetch(a: int, b: int) -> bytes:
        whole.seek(offset + a)
        return whole.read(b - a)

    return _Ranged(size, fetch)


def _http(url: str) -> io.RawIOBase:
    def fetch(a: int, b: int) -> bytes:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"Range": f"bytes={a}-{b - 1}"}), timeout=60) as answer:
            if answer.status == 206:
                return answer.read()
            raise StorageError(f"{url} does not serve byte ranges (status {answer.status})")

    with urllib.request.urlopen(urllib.request.Request(url, method="HEAD"), timeout=60) as answer:
        size = answer.headers.get("Content-Length")
    if size is None:
        raise StorageError(f"{url} does not tell its length")
    return _Ranged(int(size), fetch)


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow's file system for a path, and the path in it."""
    scheme, mark, rest = path.partition("://")
    if not mark:
        return pafs.LocalFileSystem(), unquote(urlsplit(path).path) if path.startswith("file:") else path
    if scheme in ("s3", "s3a", "s3n"):
        region, endpoint = os.environ.get("AWS_REGION") or os.environ.get("AWS_DEFAULT_REGION"), os.environ.get("AWS_ENDPOINT_URL")
        if region or endpoint:
            return pafs.S3FileSystem(region=region, endpoint_override=endpoint), rest
        return pafs.FileSystem.from_uri(f"s3://{rest}")  # asks for the bucket's region
    if scheme in ("az", "azure"):
        return pafs.AzureFileSystem(account_name=os.environ["AZURE_STORAGE_ACCOUNT"]), rest
    return pafs.FileSystem.from_uri(path)


def open_input(path: str, opener: str | None = None):
    """A buffered, seekable stream of the file's bytes."""
    if opener:
        return named(opener)(path)
    if path.startswith(("http://", "https://")):
        return io.BufferedReader(_http(path), BUFFER)
    fs, inner = file_system(path)
    return open(inner, "rb", BUFFER) if isinstance(fs, pafs.LocalFileSystem) else io.BufferedReader(pa_raw(fs.open_input_file(inner)), BUFFER)


def pa_raw(file) -> io.RawIOBase:
    """A pyarrow file as a raw Python one."""

    def fetch(a: int, b: int) -> bytes:
        return file.read_at(b - a, a)

    return _Ranged(file.size(), fetch)
