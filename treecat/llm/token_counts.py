"""Token counts of sections, attributed by offsets.

A document is encoded once, whole, by byte-level BPE. Token lengths in bytes
give every token's span; the spans are interval-joined to the sections (lines
of a text, or the fields a record is made of), and a token that reaches over a
boundary is allocated by an explicit rule:

* ``first``: the section with the token's first byte,
* ``last``: the section with its last byte,
* ``majority``: the section with most of its bytes, the earlier one in a tie,
* ``split``: every section gets the share of bytes it holds.

Under every rule the sections' counts add up to the document's.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ._shared import slices, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how this vocabulary's pre-tokeniser splits text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("first", "last", "majority", "split")

_loaded: dict[int, tuple] = {}


def _encoding(raw: bytes, pattern: str) -> tuple:
    """(tiktoken encoding, byte length by token id), built once per worker."""
    key = hash((raw, pattern))
    if key not in _loaded:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            sizes[rank] = len(token)
        _loaded[key] = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes
    return _loaded[key]


def attribute(ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, boundary-crossing tokens touched) per section.

    ``ends`` are the tokens' ends in bytes, ``bounds`` the starts of the
    sections and, last, the end of all. An empty section holds no byte and so
    gets nothing.
    """
    n = len(bounds) - 1
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    low = np.searchsorted(bounds, starts, "right") - 1
    high = np.searchsorted(bounds, ends - 1, "right") - 1
    over = np.flatnonzero(high > low)
    to, share = {"first": low, "last": high}.get(rule, low), np.ones(len(ends))
    crossing = np.zeros(n, np.int64)
    extra_to, extra = [], []
    if rule in ("majority", "split"):
        to = to.copy()
    for t in over:
        inside = np.arange(low[t], high[t] + 1)
        held = np.minimum(bounds[inside + 1], ends[t]) - np.maximum(bounds[inside], starts[t])
        crossing[inside[held > 0]] += 1
        if rule == "majority":
            to[t] = inside[np.argmax(held)]
        elif rule == "split":
            share[t] = 0.0
            extra_to += inside.tolist()
            extra += (held / held.sum()).tolist()
    counts = np.bincount(to, share, n)
    if extra_to:
        counts += np.bincount(np.array(extra_to), np.array(extra), n)
    return counts, crossing


def _lines(text: str) -> list[str]:
    """Lines with their ends; a text has at least one."""
    parts = text.split("\n")
    return [*(x + "\n" for x in parts[:-1]), parts[-1]]


def section_token_counts(
    docs: DataFrame,
    key: str = "doc_id",
    fields: Sequence[str] = ("text",),
    by_line: bool = True,
    rule: str = "first",
    separator: str = "\n",
    vocabulary: str = VOCABULARY,
    pattern: str = PATTERN,
) -> DataFrame:
    """``(key, section, char_start, char_end, tokens, crossing, doc_tokens)``, a row per section.

    With ``by_line`` the only field's lines are the sections; else the fields
    are, joined by ``separator``, which belongs to the field before it. Spans
    are in characters. A null is an empty string; an empty document has one
    empty section with no tokens (or one per field). Repeated rows stay; texts
    of any length are encoded whole; no rows give no rows. A key column that is
    named like one of the others is called ``key``.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}, not {rule!r}")
    if by_line and len(fields) != 1:
        raise ValueError("lines are taken from one field")
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:  # the tokenizer's own file, under a megabyte
        raw = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(key).alias("key"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"f{n}") for n, c in enumerate(fields)))
    kind = rows.schema["key"].dataType.simpleString()
    names = ["key", "section", "char_start", "char_end", "tokens", "crossing", "doc_tokens"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, sizes = _encoding(raw.value, pattern)
        for b in slices(batches):
            repeat, columns = [], [[] for _ in names[1:]]
            for i, values in enumerate(zip(*(c.to_pylist() for c in b.columns[1:]))):
                parts = _lines(values[0]) if by_line else [*(v + separator for v in values[:-1]), values[-1]]
                ids = encoding.encode_to_numpy("".join(parts))
                bounds = np.concatenate(([0], np.cumsum([len(p.encode("utf-8", "surrogatepass")) for p in parts])))
                chars = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
                counts, crossing = attribute(np.cumsum(sizes[ids]), bounds, rule)
                repeat += [i] * len(parts)
                for c, v in zip(columns, (np.arange(len(parts)), chars[:-1], chars[1:], counts, crossing, np.full(len(parts), len(ids)))):
                    c.append(v)
            flat = [np.concatenate(c) if c else np.empty(0) for c in columns]
            types = (pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(repeat, pa.int64())), *(pa.array(c).cast(t) for c, t in zip(flat, types))], names=names)

    found = rows.mapInArrow(count, f"key {kind}, section int, char_start long, char_end long, tokens double, crossing int, doc_tokens long")
    return found if key in names else found.withColumnRenamed("key", key)


def op3_offset_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every line of every text of ``documents``, as ``section_token_counts`` has them."""
    return section_token_counts(table(spark, sf_dir, "documents"), rule="majority")
