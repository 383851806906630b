"""Token ids of documents as Parquet files from which single columns, documents and pages can be read.

A file's rows lie in ascending document order.  ``ids`` is a list column,
dictionary encoded (a vocabulary repeats its ids) in pages of few rows;
``doc_id``, ``n_tokens`` and ``local_start`` are delta encoded.  Row groups and pages
have a set size and the writer adds column and page indexes, so a reader of some
documents, or of the metadata alone, touches only their pages.
"""

from __future__ import annotations

import json
import os
import string
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import over_batches, slices

# Chunks of a text whose ids a worker remembers, and the longest of them in bytes.
REMEMBERED = 900_000
LONGEST_REMEMBERED = 48
# Bytes of text that a worker takes apart at once.
BYTES_AT_ONCE = 4 << 20
# Chunks that the tokenizer encodes in one call.
CHUNKS_AT_ONCE = 4096

FILE_OPTIONS = {
    "parquet.writer.version": "v2",  # delta encoding where no dictionary is used
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#ids.list.element": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "1000",
    "compression": "zstd",
}


# One mark after an ASCII letter or digit and before white space is a pre-token of its own, whatever surrounds it.
KINDS = np.zeros(256, np.uint8)
LETTER, MARK, SPACE = 1, 2, 4
for kind, held in ((LETTER, string.ascii_letters + string.digits), (MARK, ".,;:!?"), (SPACE, " \t\n\r\f\v")):
    KINDS[np.frombuffer(held.encode(), np.uint8)] = kind
# One word, and one with marks after it, to a tokenizer that keeps letters together and marks too; nothing in it is composed.
PLAIN_WORD = "^[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$"
MARKED_WORD = "^[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+[!-/:-@\\[-`{-~]+$"
# Such chunks that the tokenizer is given as one text.
WORDS_A_TEXT = 64
# Stands for the id after each document; holds a space, so no chunk is like it.
END = b" end"


class Numbers(dict):
    """Chunks in the order in which they were first met."""

    def __init__(self, chunks: list[bytes]):
        super().__init__(zip(chunks, range(len(chunks)), strict=True))
        self.chunks = chunks

    def __missing__(self, chunk: bytes) -> int:
        self[chunk] = number = len(self.chunks)
        self.chunks.append(chunk)
        return number


class Encoder:
    """A tokenizer's ids of a text, from those of its chunks between ASCII white space.

    Holds for tokenizers that lower-case, let no token reach across white space and
    drop it, and cut marks from letters.  Chunks are looked up without their last mark
    and in lower case (A-Z alone; a text with ``<|`` may name special tokens and keeps
    its case).
    """

    def __init__(self, definition: str, end: int | None = None):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        self.tokenizer = Tokenizer.from_str(definition)
        self.end = [END] if end is not None else []
        # Ids with which a word ends, if the vocabulary tells them from others.
        suffix = json.loads(definition)["model"].get("end_of_word_suffix")
        ends = [number for piece, number in self.tokenizer.get_vocab(with_added_tokens=False).items() if suffix and piece.endswith(suffix)]
        self.ends = np.zeros(max(ends, default=-1) + 1, bool)
        self.ends[ends] = True
        self._keep(list(self.end), np.full(len(self.end), end or 0, np.int32), np.ones(len(self.end), np.int64))

    def _keep(self, chunks: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Remember these chunks alone; their ids lie behind each other."""
        self.numbers = Numbers(chunks)
        self.ids, self.sizes, self.starts = ids, sizes, np.cumsum(sizes) - sizes

    def _learn(self, known: int) -> None:
        new = self.numbers.chunks[known:]
        # Parts of a chunk, each ending as words do; 0 where that is not known.
        texts = pa.array(new, pa.binary()).cast(pa.string())
        plain, marked = (pc.match_substring_regex(texts, kind).to_numpy(zero_copy_only=False) for kind in (PLAIN_WORD, MARKED_WORD))
        parts = (plain + 2 * marked.astype(np.int64)) * (len(self.ends) > 0)
        words, others = np.flatnonzero(parts), np.flatnonzero(parts == 0)
        # Chunks in the order in which they are encoded, with their ids behind each other.
        found = [self._words_of([new[k] for k in words.tolist()], parts[words]), self._ids_of([new[k].decode() for k in others.tolist()])]
        ids, sizes = (np.concatenate(x) for x in zip(*found, strict=True))
        place = np.argsort(np.concatenate([words, others]), kind="stable")
        self.ids, self.starts = np.concatenate([self.ids, ids]), np.append(self.starts, (len(self.ids) + np.cumsum(sizes) - sizes)[place])
        self.sizes = np.append(self.sizes, sizes[place])

    def _ids_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts behind each other, and each text's number of ids."""
        ids, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for first in range(0, len(texts), CHUNKS_AT_ONCE):
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts[first:first + CHUNKS_AT_ONCE], add_special_tokens=False)]
            ids.append(np.fromiter(chain.from_iterable(found), np.int32))
            sizes.append(np.array([*map(len, found)], np.int64))
        return np.concatenate(ids), np.concatenate(sizes)

    def _words_of(self, words: list[bytes], parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``_ids_of`` plain words, many in a text: the last id of each of their parts is one with which words end."""
        ids, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for first in range(0, len(words), CHUNKS_AT_ONCE):
            here = words[first:first + CHUNKS_AT_ONCE]
            found, _ = self._ids_of([b" ".join(here[k:k + WORDS_A_TEXT]).decode() for k in range(0, len(here), WORDS_A_TEXT)])
            ends = np.flatnonzero((found < len(self.ends)) & self.ends[np.minimum(found, len(self.ends) - 1)])
            last = np.cumsum(parts[first:first + CHUNKS_AT_ONCE])
            if len(ends) == last[-1] and ends[-1] == len(found) - 1:
                counts = np.diff(ends[last - 1], prepend=-1)
            else:
                found, counts = self._ids_of([word.decode() for word in here])
            ids.append(found)
            sizes.append(counts)
        return np.concatenate(ids), np.concatenate(sizes)

    def _gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks behind each other, and each chunk's number of ids."""
        sizes = self.sizes[numbers]
        before = np.cumsum(sizes) - sizes
        return self.ids[np.repeat(self.starts[numbers] - before, sizes) + np.arange(int(sizes.sum()))], sizes

    def _number(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all chunks, with that of ``END`` after each text, and where each text's begin; a chunk of these texts is looked up once."""
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        distinct = coded.dictionary.cast(pa.binary()).to_pylist()
        codes = coded.indices.to_numpy()
        ends = lists.offsets.to_numpy()
        if b"" in distinct:  # beside white space at the ends of a text
            empty = distinct.index(b"")
            full = codes != empty
            ends, codes = np.append(0, np.cumsum(full))[ends], codes[full]
            codes = codes - (codes > empty)
            del distinct[empty]
        met = np.fromiter(map(self.numbers.__getitem__, distinct), np.int64, len(distinct))
        numbers = met[codes]
        if self.end:
            numbers, ends = np.insert(numbers, ends[1:], self.numbers[END]), ends + np.arange(len(ends))
        return numbers, ends

    def encode(self, texts: list[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's begin (one more entry at the end)."""
        cut = marks_apart(lower_case(pa.array(texts, pa.string()).fill_null("")))
        known = len(self.numbers.chunks)
        numbers, counts = self._number(cut)
        if len(self.numbers.chunks) > known:
            self._learn(known)
        ids, sizes = self._gather(numbers)
        if len(self.numbers.chunks) > REMEMBERED:
            seen = np.unique(np.append(numbers, np.arange(len(self.end))))
            chunks = [self.numbers.chunks[k] for k in seen.tolist()]
            short = np.array([len(c) <= LONGEST_REMEMBERED or c == END for c in chunks], bool)
            self._keep([c for c, kept in zip(chunks, short.tolist(), strict=True) if kept], *self._gather(seen[short]))
        return ids, np.append(0, np.cumsum(sizes))[counts]


def lower_case(texts: pa.StringArray) -> pa.StringArray:
    """A-Z in lower case, but for texts that may name special tokens."""
    lower, named = pc.ascii_lower(texts), pc.match_substring(texts, "<|")
    return pc.if_else(named, texts, lower) if named.true_count else lower


def marks_apart(texts: pa.StringArray) -> pa.StringArray:
    """The texts with a space before each mark that is a pre-token of its own, all texts at once."""
    _, offsets, data = texts.buffers()
    if not len(texts) or data is None:
        return texts
    offsets = np.frombuffer(offsets, np.int32)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    kinds = KINDS[data]
    at = np.flatnonzero(kinds[1:-1] == MARK) + 1
    at = at[(kinds[at - 1] == LETTER) & (kinds[at + 1] == SPACE)]
    text = np.searchsorted(offsets, at, "right")  # the text after the one that holds it
    at = at[(at > offsets[text - 1]) & (at + 1 < offsets[text])]
    moved = (offsets + np.searchsorted(at, offsets)).astype(np.int32)
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(moved), pa.py_buffer(np.insert(data, at, ord(" "))))


_encoders: dict[int, Encoder] = {}


def write_tokens(docs: DataFrame, path: str, tokenizer: str, *, end: int | None = None, text: str = "text",
                 doc_id: str = "doc_id", options: dict[str, str] | None = None) -> None:
    """Write ``doc_id``, ``n_tokens``, ``part``, ``local_start`` and ``ids`` of every row to ``path``.

    ``tokenizer`` is a tokenizer's definition (JSON, a few MB, broadcast once);
    ``end`` is appended to each document.  Rows are dealt out by ranges of the id
    and written in its order, ties (repeated ids) in the order of the text's hash; a
    null id comes first.  A null or empty text is ``end`` alone, or nothing.  Other
    columns are not written.  A task encodes its range as a stream: neither long
    texts nor large ranges are held whole.  An empty table writes an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)
    order = [F.col("doc_id"), F.col("_tie")]
    ranged = (docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("_tie"), F.col(text).alias("_text"))
              .repartitionByRange(*order).sortWithinPartitions(*order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash((shared.value, end))
        if key not in _encoders:
            _encoders.clear()
            _encoders[key] = Encoder(shared.value, end)
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            for first, rows in slices(batch, BYTES_AT_ONCE):
                piece = batch.slice(first, rows)
                ids, offsets = _encoders[key].encode(piece.column(2))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(np.diff(offsets)), pa.array(np.full(rows, part), pa.int32()), pa.array(at + offsets[:-1]),
                     pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))],
                    ["doc_id", "n_tokens", "part", "local_start", "ids"])
                at += int(offsets[-1])

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = ranged.mapInArrow(run, f"doc_id {kind}, n_tokens long, part int, local_start long, ids array<int>")
    rows.write.options(**{**FILE_OPTIONS, **(options or {})}).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids`` of the written documents.

    The starts of the parts, one number a file, are summed from the metadata columns alone.
    """
    rows = spark.read.parquet(path)
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("_sum"))
    before = sums.select("part", F.sum("_sum").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    return rows.join(F.broadcast(before), "part").select(
        "doc_id", (F.coalesce("_before", F.lit(0)) + F.col("local_start")).alias("start"), "n_tokens", "ids")


def id_checksums(tokens: DataFrame) -> DataFrame:
    """``read_tokens`` rows with ``ids_crc32`` (of the ids as little-endian unsigned 32-bit integers) for their ids."""
    keep = [c for c in tokens.columns if c != "ids"]
    schema = tokens.select(*keep).schema.add("ids_crc32", "long")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column(len(keep))
        data = ids.flatten().to_numpy().astype("<u4").tobytes()
        ends = np.cumsum([0, *ids.value_lengths().to_pylist()]) * 4
        crc = [zlib.crc32(data[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(crc, pa.int64())], [*keep, "ids_crc32"])

    return over_batches(tokens.select(*keep, "ids"), schema, work, size=1 << 40)
