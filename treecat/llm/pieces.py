"""SentencePiece encoding and decoding, batched in numpy, by the search that the model file calls for.

In a unigram model the best segmentation of a text is the one whose pieces'
scores sum highest: a Viterbi search. In a BPE model scores are merge ranks, so
the sum says nothing; its encoding comes from merging the neighbours whose
union has the highest score, the leftmost in a tie, until none is a piece.
No piece has a space after another character, so both run word by word
(a word keeps the spaces before it), once for each distinct word of a batch.
A word longer than any piece is first cut wherever no piece that occurs in it
reaches over, which neither search can do either; so a line of Chinese, or one
without any space, is cut to short parts where the vocabulary allows it, and
parts of any length take the same batched search.

Viterbi: parts of equal length advance together: the hashes of all their
substrings that end at a position probe the sorted piece hashes, vectorised
maxima keep the best sum and the piece that led to it. In a tie the longer last
piece wins. Merging: all parts of a batch stand end to end as one array of
tokens; each round makes, in every part, the merges of its best pair, and asks
the same hashes for the pairs that arise. Merges of one pair are made together
as long as none of them gives rise to a pair that would come first.

A character without a piece costs the lowest score less 10 and becomes byte
pieces. Spaces stand for the model's space mark, so that a mark in the text
itself takes the byte pieces and every text comes back exactly. Each word's
pieces are checked to spell it; a false hash match would show there, and the
word is then searched by plain dictionary look-ups.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ._shared import map_arrow, slices, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Fixed values of the model format: the space mark, and a score that marks pieces no text search may use.
MARK, NEVER = "▁", -1e8
PENALTY = 10.0
_WORD = re.compile(r" *[^ \n]+| +|\n")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Tells substrings of different lengths apart in one table.
_LENGTH = np.uint64(0xD6E8FEB86659FD93)
#: Distinct words whose pieces a task remembers, and how many pieces they may have together.
_CACHE, _CACHED = 200_000, 1 << 21
#: Characters of one batched search, which takes some 100 bytes for each.
_CELLS = 1 << 18
#: Top bits of a hash that a first look asks for, before the sorted keys are searched.
_FILTER_BITS = 18
_FILTER_SHIFT = np.uint64(64 - _FILTER_BITS)


def read_model(path: str) -> list[tuple[str, float, str]]:
    """(piece, score, kind) by id; kind is normal, byte or other (control, unknown, unused)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = lambda i: "byte" if sp.is_byte(i) else "other" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else "normal"
    return [(sp.id_to_piece(i), sp.get_score(i), kind(i)) for i in range(sp.get_piece_size())]


def is_bpe(path: str) -> bool:
    """Whether the model file says that its scores are merge ranks."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    spec = sentencepiece_model_pb2.ModelProto.FromString(sp.serialized_model_proto()).trainer_spec
    if spec.model_type == spec.BPE and any(sp.is_unused(i) for i in range(sp.get_piece_size())):
        raise ValueError("unused pieces, which merges take apart again, are not supported")
    return spec.model_type == spec.BPE


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    with np.errstate(over="ignore"):
        out[1:] = np.cumprod(np.full(n - 1, base, np.uint64))
    return out


def _runs_of(values: np.ndarray) -> list[tuple[int, int]]:
    """[begin, end) of the runs of equal values."""
    edges = np.flatnonzero(np.append(True, values[1:] != values[:-1])).tolist() if len(values) else []
    return list(zip(edges, [*edges[1:], len(values)]))


def _codes(text: str) -> np.ndarray:
    """Code points."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class _Words(dict):
    """Word -> its number; ``new`` collects words not seen before."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []
        self.ids, self.sizes = np.empty(0, np.int32), np.empty(0, np.int64)

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number


class PieceModel:
    """Encoder of the pieces; by merges if ``merges``, else by the highest sum of scores."""

    def __init__(self, pieces: list[tuple[str, float, str]], merges: bool = False):
        self.merges = merges
        self.texts: list[bytes] = []
        self.strings: dict[int, str] = {}
        self.bytes_id = np.full(256, -1, np.int64)
        self.scores: dict[str, tuple[float, int]] = {}
        for i, (piece, score, kind) in enumerate(pieces):
            if kind == "byte":
                value = int(piece[3:-1], 16)
                self.bytes_id[value] = i
                self.texts.append(bytes([value]))
            elif kind == "normal":
                text = piece.replace(MARK, " ")
                self.texts.append(text.encode())
                if text and (merges or score > NEVER):
                    self.scores[text] = (score, i)
                    self.strings[i] = text
            else:
                self.texts.append(b"")
        if (self.bytes_id < 0).any():
            raise ValueError("the model has no byte pieces to fall back on")
        if any(" " in p.lstrip(" ") or ("\n" in p and len(p) > 1) for p in self.scores):
            raise ValueError("a piece reaches over a word's end")
        self.unknown = min((s for s, _ in self.scores.values()), default=0.0) - PENALTY
        self.tables = {}
        for n in sorted({len(p) for p in self.scores}):
            mine = [p for p in self.scores if len(p) == n]
            codes = np.array([[ord(c) for c in p] for p in mine], np.uint64)
            hashes = ((codes + np.uint64(1)) * _powers(_BASE, n)).sum(axis=1, dtype=np.uint64)
            order = np.argsort(hashes)
            found = [self.scores[mine[k]] for k in order]
            may_be = np.zeros(1 << _FILTER_BITS, bool)
            may_be[(hashes >> _FILTER_SHIFT).astype(np.int64)] = True
            self.tables[n] = hashes[order], np.array([s for s, _ in found]), np.array([i for _, i in found]), may_be
        self.longest = max(self.tables, default=1)
        self.lengths = np.zeros(len(pieces), np.int64)
        for i, text in self.strings.items():
            self.lengths[i] = len(text)
        self.places = np.cumsum(self.lengths) - self.lengths
        self.codes = _codes("".join(self.strings[i] for i in sorted(self.strings)))
        # one table of all lengths, as the pairs of a round differ in theirs
        parts = [(h + np.array([n], np.uint64) * _LENGTH, s, i) for n, (h, s, i, _) in self.tables.items()]
        keys, scores, ids = (np.concatenate([p[k] for p in parts]) if parts else np.empty(0, np.uint64) for k in range(3))
        order = np.argsort(keys)
        may_be = np.zeros(1 << _FILTER_BITS, bool)
        may_be[(keys >> _FILTER_SHIFT).astype(np.int64)] = True
        self.all = keys[order], -scores[order].astype(np.float32), ids[order].astype(np.int32), may_be

    def _match(self, n: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, score, id) of those of the hashes that are pieces of n characters."""
        keys, scores, ids, may_be = self.tables[n]
        rows = np.flatnonzero(may_be[(hashes >> _FILTER_SHIFT).astype(np.int64)])
        hashes = hashes[rows]
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        same = keys[at] == hashes
        rows, at = rows[same], at[same]
        return rows, scores[at], ids[at]

    def _equal_length(self, words: list[str]) -> list[list[int]]:
        """Piece ids of words of one length; -1 stands for a character without a piece."""
        m, size = len(words), len(words[0])
        codes = _codes("".join(words)).reshape(m, size).astype(np.uint64)
        sums = np.zeros((size + 1, m), np.uint64)
        np.cumsum((codes.T + np.uint64(1)) * _powers(_BASE, size)[:, None], axis=0, out=sums[1:])
        back = _powers(_INVERSE, size + 1)
        best = np.full((size + 1, m), -np.inf)
        best[0] = 0.0
        taken, which = np.zeros((size + 1, m), np.int64), np.full((size + 1, m), -1, np.int64)
        for j in range(1, size + 1):
            for n in range(min(j, self.longest), 0, -1):
                if n == 1:  # a step that every word can take
                    total = best[j - 1] + self.unknown
                    better = total > best[j]
                    best[j][better], taken[j][better], which[j][better] = total[better], 1, -1
                if n in self.tables:
                    rows, score, piece = self._match(n, (sums[j] - sums[j - n]) * back[j - n])
                    total = best[j - n][rows] + score
                    better = total > best[j][rows]
                    rows = rows[better]
                    best[j][rows], taken[j][rows], which[j][rows] = total[better], n, piece[better]
        out: list[list[int]] = [[] for _ in words]
        at, alive = np.full(m, size), np.arange(m)
        while len(alive):
            for w, p in zip(alive.tolist(), which[at[alive], alive].tolist()):
                out[w].append(p)
            at[alive] -= taken[at[alive], alive]
            alive = alive[at[alive] > 0]
        return [x[::-1] for x in out]

    def _parts(self, word: str) -> list[str]:
        """The word, cut wherever no piece that occurs in it reaches over."""
        n = len(word)
        if n <= self.longest:
            return [word]
        codes = _codes(word).astype(np.uint64)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((codes + np.uint64(1)) * _powers(_BASE, n), dtype=np.uint64)))
        back = _powers(_INVERSE, n)
        edge = np.zeros(n + 1, np.int64)
        for size in self.tables:
            if 1 < size <= n:
                at = self._match(size, (sums[size:] - sums[: n + 1 - size]) * back[: n + 1 - size])[0]
                edge[at + 1] += 1  # the places inside the piece
                edge[at + size] -= 1
        cuts = [0, *(1 + np.flatnonzero(np.cumsum(edge)[1:n] == 0)).tolist(), n]
        return [word[a:b] for a, b in zip(cuts, cuts[1:])]

    def _merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(piece ids end to end, how many each word has) by merges; -1 stands for a character without a piece."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        n = int(sizes.sum())
        codes = _codes("".join(words)).astype(np.uint64)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((codes + np.uint64(1)) * _powers(_BASE, n), dtype=np.uint64)))
        back = _powers(_INVERSE, n + 1)
        keys, costs, ids, may_be = self.all

        def look(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Cost and id of the piece that the characters [a, b) make; infinite and -1 without one."""
            asked = (sums[b] - sums[a]) * back[a] + (b - a).astype(np.uint64) * _LENGTH
            cost, piece = np.full(len(a), np.inf, np.float32), np.full(len(a), -1, np.int32)
            at = np.flatnonzero(may_be[(asked >> _FILTER_SHIFT).astype(np.int64)])
            place = np.minimum(np.searchsorted(keys, asked[at]), len(keys) - 1)
            same = keys[place] == asked[at]
            cost[at[same]], piece[at[same]] = costs[place[same]], ids[place[same]]
            return cost, piece

        def join(a: np.ndarray, b: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """``look`` where ``ok``, which keeps pairs inside one word."""
            cost, piece = np.full(len(a), np.inf, np.float32), np.full(len(a), -1, np.int32)
            cost[ok], piece[ok] = look(a[ok], b[ok])
            return cost, piece

        final = np.full(n, -2, np.int32)  # by first character; -2 where none begins
        begin, word = np.arange(n), np.repeat(np.arange(len(words)), sizes)
        end, own = begin + 1, look(begin, begin + 1)[1]
        with_next = np.append(word[1:] == word[:-1], False) if n else np.zeros(0, bool)
        cost, union = join(begin, np.append(end[1:], n), with_next)
        while len(begin):
            heads = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.minimum.reduceat(cost, heads)
            lengths = np.diff(np.append(heads, len(begin)))
            going = np.isfinite(least)
            if not going.all():  # words without a pair to merge are done
                stay = np.repeat(going, lengths)
                final[begin[~stay]] = own[~stay]
                begin, end, own, word, cost, union = (x[stay] for x in (begin, end, own, word, cost, union))
                least, lengths = least[going], lengths[going]
                if not len(begin):
                    break
            best = np.repeat(least, lengths)
            at = np.flatnonzero(cost == best)
            # of a run of overlapping pairs every other one, from the left
            starts = np.flatnonzero(np.append(True, np.diff(at) > 1))
            at = at[(np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))) % 2 == 0]
            # what each merge gives rise to, made from left to right: a pair with the merge before or the token there, and one with the next token
            left = np.where(np.append(False, np.diff(at) == 2), np.append(at[:1], at[:-1]), at - 1)
            has_left, has_right = left >= 0, at + 2 < len(begin)
            left, right = np.maximum(left, 0), np.minimum(at + 2, len(begin) - 1)
            has_left &= word[left] == word[at]
            has_right &= word[right] == word[at]
            before, after = join(begin[left], end[at + 1], has_left)[0], join(begin[at], end[right], has_right)[0]
            early = np.minimum(before, after) <= best[at]
            if early.any():  # then that pair comes before the word's further merges
                count = np.cumsum(early) - early
                first = np.flatnonzero(np.append(True, np.diff(word[at]) != 0))
                at = at[count == np.repeat(count[first], np.diff(np.append(first, len(at))))]
            end[at], own[at] = end[at + 1], union[at]
            keep = np.ones(len(begin), bool)
            keep[at + 1] = False
            changed = np.zeros(len(begin), bool)
            changed[at] = True
            changed[np.maximum(at - 1, 0)] = True
            changed[np.maximum(at - 2, 0)] = True  # the token before, where a merged one's second half stands between
            begin, end, own, word, cost, union, changed = (x[keep] for x in (begin, end, own, word, cost, union, changed))
            row = np.flatnonzero(changed)
            then = np.minimum(row + 1, len(begin) - 1)
            cost[row], union[row] = join(begin[row], end[then], (then > row) & (word[then] == word[row]))
        there = final > -2
        return final[there], np.bincount(np.repeat(np.arange(len(words)), sizes)[there], minlength=len(words))

    def _plain_merged(self, word: str) -> list[int]:
        """The merges of one word of any length, from a heap of pairs."""
        n = len(word)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple[float, int, int]] = []

        def push(a: int, end: int) -> None:
            if end - a <= self.longest and (found := self.scores.get(word[a:end])):
                heapq.heappush(heap, (-found[0], a, end))

        for i in range(n - 1):
            push(i, i + 2)
        while heap:
            _, a, end = heapq.heappop(heap)
            if not alive[a] or (b := after[a]) >= n or after[b] != end:
                continue  # one of the pair has been merged since
            alive[b], after[a] = False, end
            if end < n:
                before[end] = a
                push(a, after[end])
            if before[a] >= 0:
                push(before[a], end)
        return [self.scores.get(word[i : after[i]], (0.0, -1))[1] for i in range(n) if alive[i]]

    def plain(self, word: str) -> list[int]:
        """The same search for one word of any length, by dictionary look-ups."""
        if self.merges:
            return self._plain_merged(word)
        best, taken, which = [0.0], [0], [-1]
        for j in range(1, len(word) + 1):
            top, size, piece = -np.inf, 1, -1
            for n in range(min(j, self.longest), 0, -1):
                score, i = self.scores.get(word[j - n : j], (self.unknown, -1) if n == 1 else (-np.inf, -1))
                if best[j - n] + score > top:
                    top, size, piece = best[j - n] + score, n, i
            best.append(top)
            taken.append(size)
            which.append(piece)
        out, j = [], len(word)
        while j:
            out.append(which[j])
            j -= taken[j]
        return out[::-1]

    def _spelled(self, word: str, pieces: list[int]) -> list[int]:
        """Ids of one word with byte pieces put in for each -1."""
        out, at = [], 0
        for p in pieces:
            if p >= 0:
                at += len(self.strings[p])
                out.append(p)
            else:
                out += self.bytes_id[list(word[at].encode("utf-8", "surrogatepass"))].tolist()
                at += 1
        return out

    def _searched(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(piece ids end to end, how many each part has), in batches of bounded size; the pieces may be false hash matches."""
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        if self.merges:
            filled = np.cumsum(sizes) // _CELLS
            found = [self._merged(parts[a:b]) for a, b in _runs_of(filled)]
        else:
            lists: list[list[int]] = [[]] * len(parts)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                for a, b in _runs_of(np.arange(1, len(at) + 1) * size // _CELLS):
                    for i, pieces in zip(at[a:b].tolist(), self._equal_length([parts[i] for i in at[a:b].tolist()])):
                        lists[i] = pieces
            found = [(np.fromiter((p for x in lists for p in x), np.int32), np.fromiter(map(len, lists), np.int64, len(lists)))]
        return np.concatenate([x for x, _ in found]), np.concatenate([n for _, n in found])

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(piece ids end to end, how many each word has), bytes of characters without a piece included; some ``_CELLS`` characters of words at a time."""
        filled = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) // _CELLS
        found = [self._encoded(words[a:b]) for a, b in _runs_of(filled)] or [(np.empty(0, np.int32), np.empty(0, np.int64))]
        return np.concatenate([x for x, _ in found]), np.concatenate([n for _, n in found])

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``encode_words`` of some words, but not none."""
        cut = {i: self._parts(w) for i, w in enumerate(words) if len(w) > self.longest}
        parts = [p for i, w in enumerate(words) for p in (cut[i] if i in cut else (w,))] if cut else words
        per_word = np.ones(len(words), np.int64)
        for i, x in cut.items():
            per_word[i] = len(x)
        ids, counts = self._searched(parts)
        counts = np.add.reduceat(counts, np.cumsum(per_word) - per_word)
        # the pieces' characters, laid end to end, must be the words'
        text, owner = "".join(words), np.repeat(np.arange(len(words)), counts)
        codes, known = _codes(text), ids >= 0
        lengths = np.where(known, self.lengths[ids], 1)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        right = np.bincount(owner, lengths, len(words)).astype(np.int64) == sizes
        if right.all():
            at = np.repeat(np.where(known, self.places[ids], -1) - starts, lengths) + np.arange(int(ends[-1]))
            same = np.repeat(~known, lengths) | (self.codes[np.maximum(at, 0)] == codes)
            right[np.repeat(owner, lengths)[~same]] = False
        if not right.all():
            lists = np.split(ids, np.cumsum(counts)[:-1])
            lists = [self.plain(w) if not ok else x.tolist() for w, x, ok in zip(words, lists, right.tolist())]
            lists = [self._spelled(w, x) for w, x in zip(words, lists)]
            return np.fromiter((p for x in lists for p in x), np.int32), np.fromiter(map(len, lists), np.int64, len(lists))
        if not known.all():
            odd = np.flatnonzero(~known)
            raw = [text[i].encode("utf-8", "surrogatepass") for i in starts[odd].tolist()]
            wide = np.ones(len(ids), np.int64)
            wide[odd] = list(map(len, raw))
            ids, counts = np.repeat(ids, wide), np.bincount(owner, wide, len(words)).astype(np.int64)
            ids[ids < 0] = self.bytes_id[np.frombuffer(b"".join(raw), np.uint8)]
        return ids, counts

    def encode(self, texts: list[str | None], seen: _Words | None = None) -> list[np.ndarray]:
        """Piece ids of every text; a null or empty text has none. A text gets one space put before it.

        ``seen`` remembers words from call to call.
        """
        seen = _Words() if seen is None else seen
        if len(seen) > _CACHE or len(seen.ids) > _CACHED:
            seen.__init__()
            seen.clear()
        number = seen.__getitem__
        numbers = [np.fromiter(map(number, _WORD.findall(f" {t}")), np.int64) if t else np.empty(0, np.int64) for t in texts]
        if seen.new:
            ids, counts = self.encode_words(seen.new)
            seen.ids, seen.sizes, seen.new = np.concatenate([seen.ids, ids]), np.concatenate([seen.sizes, counts]), []
        first = np.cumsum(seen.sizes) - seen.sizes
        out = []
        for words in numbers:
            n = seen.sizes[words]
            ends = np.cumsum(n)
            out.append(seen.ids[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first[words] - (ends - n), n)])
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of piece ids: the opposite of ``encode``."""
        raw = b"".join(map(self.texts.__getitem__, ids))
        return raw[1:].decode("utf-8", "replace") if raw[:1] == b" " else raw.decode("utf-8", "replace")


def encode_pieces(docs: DataFrame, text: str = "text", model: str = MODEL) -> DataFrame:
    """``docs`` with ``piece_ids array<int>, n_pieces int, round_trip boolean`` (replaced if there).

    The ids are those of the library's ``encode``, except that a literal space
    mark takes byte pieces; a BPE model is searched by merges, others by Viterbi.
    ``round_trip`` says whether decoding gives back the text, a null as "". A
    null or empty text has no pieces. Repeated rows stay, an empty table gives
    none, all other columns are kept, and a text of any length, with or without
    spaces, takes the same search.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((read_model(model), is_bpe(model)))  # the tokenizer's own pieces: a bounded table
    added = {"piece_ids": "array<int>", "n_pieces": "int", "round_trip": "boolean"}
    docs = docs.drop(*(c for c in added if c != text))
    schema = docs.select("*", *(F.lit(None).cast(t).alias(c) for c, t in added.items())).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, seen = PieceModel(*shared.value), _Words()
        for b in slices(batches):
            texts = b.column(text).to_pylist()
            ids = pieces.encode(texts, seen)
            back = [pieces.decode(x.tolist()) == (t or "") for x, t in zip(ids, texts)]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
            flat = np.concatenate([*ids, np.empty(0, np.int32)]).astype(np.int32)
            new = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(np.diff(offsets), pa.int32()), pa.array(back, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, *added])

    return map_arrow(docs, run, schema)


def decode_pieces(docs: DataFrame, ids: str = "piece_ids", name: str = "text", model: str = MODEL) -> DataFrame:
    """``docs`` with the text of its piece ids in ``name``; null ids give a null, unknown ids an error."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_model(model))
    docs = docs.drop(name)
    schema = docs.select("*", F.lit("").alias(name)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = PieceModel(shared.value)
        for b in batches:
            out = [None if x is None else pieces.decode(x) for x in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[*b.schema.names, name])

    return map_arrow(docs, run, schema)


def op7_sentencepiece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` encoded and decoded, as ``encode_pieces`` has it."""
    return encode_pieces(table(spark, sf_dir, "documents").select("doc_id", "text"))
