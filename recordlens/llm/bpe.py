"""Byte-level BPE encoding and decoding by a rank file, with a hierarchical-bitmap rank queue.

The bytes of a pre-token form a doubly linked list.  Every adjacent pair whose
join has a rank is filed under that rank: a bucket holds the list positions in
order, a bitmap of two levels over the ranks says which buckets are filled.  The
next merge is the first set bit of the top word, then of the word below it, then
the leftmost position of that bucket.  A position whose pair has changed since it was filed is stale
and is skipped.  A pre-token of n bytes costs O(n log n), however long it is.
"""

from __future__ import annotations

import base64
import re
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, types as T

from .common import fields, kept_columns, over_batches

# White space as the rank files' pattern has it: Unicode's, so without the four separators 1C to 1F.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# Cutting before every space is safe unless a space inside or at the end of a run of white space belongs to a longer
# match: white space, a space, and then white space or the end.
UNSAFE = re.compile(f"[{SPACE}] (?![^{SPACE}])")
# The cut for such texts: other characters with one space before them, or white space up to that space.
RUNS = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
# Bytes of text that a worker takes apart at once.
BYTES_AT_ONCE = 2 << 20
# Runs, and pre-tokens, whose ids a worker remembers, and the longest of them; longer pre-tokens have a queue of their own.
REMEMBERED = 250_000
LONGEST_REMEMBERED = 48
# Bytes of new pre-tokens whose pairs are looked up at once.
PLACES_AT_ONCE = 1 << 16


def read_ranks(data: bytes) -> dict[bytes, int]:
    """A rank file: on each line a token in base64 and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if rank}


# Bits of a rank that one word of the bitmap covers; the top word has a bit for each of those words.
WORD_BITS = 9


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token.  ``ranks`` holds every single byte."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n, get, inside = len(piece), ranks.get, (1 << WORD_BITS) - 1
    end = list(range(1, n + 1))  # of the token that begins here; 0 once it is merged into the one before
    before = list(range(-1, n))  # where the token before the one that begins here begins
    buckets: dict[int, list[int]] = {}  # positions by rank, as heaps
    words: dict[int, int] = {}  # which ranks have a bucket
    top = 0  # which words have a bit
    for i in range(n - 1):
        rank = get(piece[i:i + 2])
        if rank is not None:
            if rank in buckets:
                buckets[rank].append(i)
            else:
                buckets[rank] = [i]
                high = rank >> WORD_BITS
                words[high] = words.get(high, 0) | 1 << (rank & inside)
                top |= 1 << high
    while top:
        high = (top & -top).bit_length() - 1
        word = words[high]
        lowest = word & -word
        rank = high << WORD_BITS | lowest.bit_length() - 1
        bucket = buckets[rank]
        i = heappop(bucket)
        if not bucket:
            del buckets[rank]
            words[high] = word = word ^ lowest
            if not word:
                top ^= 1 << high
        middle = end[i]
        if not middle or middle == n or get(piece[i:end[middle]]) != rank:
            continue  # stale
        last = end[i] = end[middle]
        end[middle] = 0
        found = []
        if last < n:
            before[last] = i
            found.append((i, get(piece[i:end[last]])))
        if i:
            found.append((before[i], get(piece[before[i]:last])))
        for i, rank in found:
            if rank is None:
                continue
            if rank in buckets:
                heappush(buckets[rank], i)
            else:
                buckets[rank] = [i]
                high = rank >> WORD_BITS
                words[high] = words.get(high, 0) | 1 << (rank & inside)
                top |= 1 << high
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i:end[i]]])
        i = end[i]
    return ids


class Pairs:
    """The rank of every pair of tokens whose join has one."""

    def __init__(self, ranks: dict[bytes, int]):
        self.none = max(ranks.values(), default=0) + 1  # the id of no token
        found = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    found[left * (self.none + 1) + right] = rank
        self.keys = np.array([*sorted(found), np.iinfo(np.int64).max], np.int64)
        self.ranks = np.array([*(found[k] for k in self.keys[:-1].tolist()), -1], np.int64)

    def rank(self, left, right):
        """-1 where the join has no rank."""
        key = np.asarray(left, np.int64) * (self.none + 1) + right
        place = np.searchsorted(self.keys, key)
        return np.where(self.keys[place] == key, self.ranks[place], -1)


def merge_all(pieces: list[bytes], pairs: Pairs, single: np.ndarray) -> list[bytes]:
    """``merge`` of many short pre-tokens at once, as packed ids.

    They lie behind each other in one linked list with a border between them, so
    one queue serves all.  Each pop takes a rank's leftmost position in every
    pre-token: merges in different pre-tokens do not touch.
    """
    sizes = np.array([len(piece) for piece in pieces], np.int64)
    n = int(sizes.sum())
    starts = np.concatenate([[0], np.cumsum(sizes)])
    piece = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
    # Place n stands for no token, before the first and after the last of a pre-token.
    token = np.append(single[np.frombuffer(b"".join(pieces), np.uint8)], pairs.none).astype(np.int32)
    after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
    after[starts[1:] - 1] = before[starts[:-1]] = after[n] = n
    alive = np.ones(n, bool)
    rank = np.full(n + 1, -1, np.int32)  # of the pair that begins here
    for first in range(0, n, PLACES_AT_ONCE):
        here = slice(first, min(n, first + PLACES_AT_ONCE))
        rank[here] = pairs.rank(token[here], token[after[here]])
    buckets: dict[int, list[np.ndarray]] = {}
    words: dict[int, int] = {}
    top, inside = 0, (1 << WORD_BITS) - 1

    def file(ranks: np.ndarray, places: np.ndarray) -> int:
        """Buckets for these pairs; the words that got their first bit."""
        some = ranks >= 0
        ranks, places = ranks[some], places[some]
        order = np.argsort(ranks, kind="stable")
        ranks, places = ranks[order], places[order]
        edges = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
        new = 0
        for first, last, r in zip(edges[:-1], edges[1:], ranks[edges[:-1]].tolist() if len(ranks) else [], strict=False):
            if r in buckets:
                buckets[r].append(places[first:last])
            else:
                buckets[r] = [places[first:last]]
                words[r >> WORD_BITS] = words.get(r >> WORD_BITS, 0) | 1 << (r & inside)
                new |= 1 << (r >> WORD_BITS)
        return new

    top = file(rank[:n], np.arange(n, dtype=np.int32))
    while top:
        high = (top & -top).bit_length() - 1
        word = words[high]
        lowest = word & -word
        now = high << WORD_BITS | lowest.bit_length() - 1
        filed = buckets.pop(now)
        words[high] = word ^ lowest
        if word == lowest:
            top ^= 1 << high
        at = filed[0] if len(filed) == 1 else np.unique(np.concatenate(filed))
        at = at[rank[at] == now]  # others are stale
        if not len(at):
            continue
        owner = piece[at]
        leftmost = np.append(True, owner[1:] != owner[:-1])
        if not leftmost.all():
            top |= file(np.full(len(at) - int(leftmost.sum()), now, np.int32), at[~leftmost])
            at = at[leftmost]
        middle = after[at]
        last = after[middle]
        token[at], after[at], before[last] = now, last, at
        alive[middle], rank[middle] = False, -1
        previous = before[at]
        rank[at] = right = pairs.rank(now, token[last])
        rank[previous] = left = pairs.rank(token[previous], now)
        rank[n] = -1
        top |= file(np.concatenate([right, left]), np.concatenate([at, previous]))
    packed = token[:n][alive].astype("<u4").tobytes()
    ends = (4 * np.concatenate([[0], np.cumsum(alive)])[starts]).tolist()
    return [packed[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pairs = ranks, Pairs(ranks)
        self.tokens = [b""] * self.pairs.none
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        self.cut = regex.compile(pattern).findall
        self.pieces: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}  # of a space and the key

    def _learn(self, runs: set[str], spaced: set[str]) -> None:
        """Remember the ids of these runs."""
        cut = [(self.runs, run, self.cut(run)) for run in runs] + [(self.spaced, run, self.cut(" " + run)) for run in spaced]
        new = {piece for _, _, pieces in cut for piece in pieces if piece not in self.pieces}
        short = []
        for piece in new:
            data = piece.encode()
            whole = self.ranks.get(data)
            if whole is None and len(data) <= LONGEST_REMEMBERED:
                short.append((piece, data))
            else:
                self.pieces[piece] = np.array([whole] if whole is not None else merge(data, self.ranks), "<u4").tobytes()
        if short:
            ids = merge_all([data for _, data in short], self.pairs, self.single)
            self.pieces.update(zip((piece for piece, _ in short), ids, strict=True))
        for known, run, pieces in cut:
            known[run] = b"".join(map(self.pieces.__getitem__, pieces))

    def _forget(self) -> None:
        for known in (self.pieces, self.runs, self.spaced):
            if len(known) > REMEMBERED:
                known.clear()
            for key in [key for key in known if len(key) > LONGEST_REMEMBERED]:
                del known[key]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        odd = [bool(text and UNSAFE.search(text)) for text in texts]
        runs: set[str] = set()
        spaced: set[str] = set()
        for text, runwise in zip(texts, odd, strict=True):
            if runwise:
                runs.update(RUNS.findall(text))
            elif text:
                first, *rest = text.split(" ")
                runs.add(first)
                spaced.update(rest)
        self._learn(runs - self.runs.keys(), spaced - self.spaced.keys())
        out = []
        for text, runwise in zip(texts, odd, strict=True):
            if runwise:
                out.append(b"".join(map(self.runs.__getitem__, RUNS.findall(text))))
            elif text:
                first, *rest = text.split(" ")
                out.append(self.runs[first] + b"".join(map(self.spaced.__getitem__, rest)))
            else:
                out.append(b"")
        self._forget()
        return out

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


_codecs: dict[tuple[int, str], Codec] = {}


def _codec(ranks, pattern: str) -> Codec:
    """One codec per worker and rank table."""
    key = (hash(ranks.value), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(read_ranks(ranks.value), pattern)
    return _codecs[key]


def encode(docs: DataFrame, ranks: bytes, pattern: str, *, text: str = "text", decoded: bool = False) -> DataFrame:
    """Every row with ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit integers), whole texts.

    ``ranks`` is the content of a rank file (below a megabyte, broadcast once);
    ``pattern`` cuts a text into pre-tokens, none of which may mix white space
    with later text beyond one leading space.  With ``decoded`` the ids are
    decoded again into ``decoded`` (bytes).  A null or empty text has no ids.
    Repeated rows stay repeated.  Input columns named like an output are
    replaced; all others, but for the text, are kept.  An empty table gives an
    empty table.  A text that is one very long pre-token takes O(n log n).
    """
    made = ["n_tokens", "ids", *["decoded"] * decoded]
    keep = [c for c in kept_columns(docs, made) if c != text]
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    schema = T.StructType(fields(docs, keep) + [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]
                          + [T.StructField("decoded", T.BinaryType())] * decoded)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = _codec(shared, pattern)
        pa.default_memory_pool().release_unused()  # what earlier slices, or other stages of this worker, have left
        ids = codec.encode(batch.column(len(keep)).to_pylist())
        out = [*batch.columns[:-1], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
        if decoded:
            out.append(pa.array([codec.decode(x) for x in ids], pa.binary()))
        return pa.RecordBatch.from_arrays(out, [*keep, *made])

    return over_batches(docs.select(*keep, text), schema, work, size=BYTES_AT_ONCE)


def decode(encoded: DataFrame, ranks: bytes, *, ids: str = "ids") -> DataFrame:
    """Every row with ``decoded``, the bytes that its ``ids`` stand for; null ids stand for none."""
    keep = kept_columns(encoded, ["decoded"])
    place = keep.index(ids)
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)
    schema = T.StructType(fields(encoded, keep) + [T.StructField("decoded", T.BinaryType())])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = _codec(shared, "")
        out = [codec.decode(x) if x else b"" for x in batch.column(place).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*keep, "decoded"])

    return over_batches(encoded.select(*keep), schema, work)
