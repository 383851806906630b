"""Phrases of two to five words that stand together more often than their parts would by chance.

The texts are parsed prefix-free: a window of four words whose hash is divisible by
``MODULUS`` begins a chunk, and a chunk runs through the window that begins the
next, so neighbours share four words.  Equal chunks are one entry of a dictionary
with the number of times they occur.  N-grams are counted inside the distinct
chunks, weighted by that number; one that lies in two chunks belongs to the chunk in
which it starts before the shared window, so each occurrence counts once.

Counting goes by length: words first, then hashes of pairs of frequent words, then
the pairs themselves and longer runs of them.  What is frequent reaches the tasks as a
bitmap of set size (``BITS``); a false hit, there or among the hashes, only means one
more phrase is counted.  The counts that remain are of the words as written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..session import cut_lineage
from .common import over_batches
from .hashing import mixed

LONGEST = 5
OVERLAP = LONGEST - 1
MODULUS = 32
# Bits of a bitmap of frequent phrases, a power of two: 16 MB, whatever the corpus.
BITS = 1 << 27
BITS_A_BUCKET = 8 * 4096  # of Spark's bitmap aggregates
# Bytes of text that a worker takes apart at once.
BYTES_AT_ONCE = 4 << 20

BLANK, BREAK = 0x20, 0x0A
_BETWEEN = np.zeros(256, bool)
_BETWEEN[[0x20, 0x09]] = True
_PIECE_END = np.zeros(256, bool)
_PIECE_END[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_ODD), -1, 1 << 64))
_STEP = np.uint64(0xD1B54A32D192ED03)


def _gathered(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The stretches of a byte array as strings."""
    offsets = np.append(0, np.cumsum(lengths))
    places = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths)
    buffers = [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[places])]
    return pa.LargeStringArray.from_buffers(len(starts), *buffers[1:]).cast(pa.string())


def _run_hashes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A hash of each of the stretches that lie behind each other."""
    powers = np.full(len(data), _ODD)
    back = np.full(len(data), _BACK)
    if len(data):
        powers[0] = back[0] = 1
    np.cumprod(powers, out=powers)
    np.cumprod(back, out=back)
    sums = np.append(np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers, dtype=np.uint64))
    return mixed((sums[offsets[1:]] - sums[offsets[:-1]]) * back[offsets[:-1]])


class Words:
    """The words of a byte array in which one blank or one break follows each word."""

    def __init__(self, data: np.ndarray):
        after = (data == BLANK) | (data == BREAK)
        self.ends = np.flatnonzero(after)  # of the word without what follows it
        self.starts = np.append(0, self.ends[:-1] + 1) if len(self.ends) else self.ends
        self.breaks = data[self.ends] == BREAK
        self.data = np.where(after, np.uint8(BLANK), data)
        edges = pa.py_buffer(np.append(0, self.ends + 1).astype(np.int32))
        coded = pa.StringArray.from_buffers(len(self.ends), edges, pa.py_buffer(self.data)).dictionary_encode()
        self.ids = coded.indices.to_numpy().astype(np.int64)
        self.distinct = len(coded.dictionary)
        _, places, letters = coded.dictionary.buffers()
        places = np.frombuffer(places, np.int32)[:self.distinct + 1] if self.distinct else np.zeros(1, np.int32)
        self.hashes = _run_hashes(np.frombuffer(letters or b"", np.uint8)[:places[-1]], places)[self.ids]

    def texts(self, first: np.ndarray, words: int) -> pa.Array:
        """The phrases of so many words that begin at these words."""
        return _gathered(self.data, self.starts[first], self.ends[first + words - 1] - self.starts[first])


def _chained(hashes: np.ndarray, words: int) -> np.ndarray:
    """A hash of the ``words`` words from each place on, where so many follow."""
    many = len(hashes) - words + 1
    out = np.zeros(max(many, 0), np.uint64)
    for k in range(words if many > 0 else 0):
        out = mixed(out * _STEP + hashes[k:k + many])
    return out


def _normal(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts in lower case with one blank or break after each word, and each text's number of words."""
    texts = texts.fill_null("").cast(pa.large_string())
    _, places, letters = texts.buffers()
    places = np.frombuffer(places, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(letters or b"", np.uint8)[places[0]:places[-1]]
    places = places - places[0]
    # A break behind each text, then one blank or break kept behind each word.
    data = _LOWER[np.insert(raw, places[1:], BREAK)]
    borders = places[1:] + np.arange(1, len(texts) + 1)
    ends = _PIECE_END[data]
    word = ~(ends | _BETWEEN[data])
    last = np.flatnonzero(word[:-1] & ~word[1:])
    first = np.flatnonzero(np.append(True, ~word[:-1]) & word)
    pieces = np.cumsum(ends, dtype=np.int32)
    broken = np.ones(len(last), bool)
    broken[:-1] = pieces[last[:-1]] != pieces[first[1:]]
    data[last + 1] = np.where(broken, BREAK, BLANK)
    word[last + 1] = True
    return data[word], np.diff(np.searchsorted(last, borders), prepend=0)


def _parsed(texts: pa.Array, modulus: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The chunks of texts, the number of the text each is of, and whether another follows it."""
    data, sizes = _normal(texts)
    words = Words(data)
    ends = np.cumsum(sizes)
    text_of = np.repeat(np.arange(len(sizes)), sizes)
    begins = np.zeros(len(words.ids), bool)
    windows = _chained(words.hashes, OVERLAP)
    inside = text_of[:len(windows)] == text_of[OVERLAP - 1:] if len(windows) else np.zeros(0, bool)
    begins[:len(windows)] = inside & (windows % np.uint64(modulus) == 0)
    begins[(ends - sizes)[sizes > 0]] = True
    first = np.flatnonzero(begins)
    text = text_of[first]
    follows = np.append(text[1:] == text[:-1], False) if len(first) else np.zeros(0, bool)
    stop = np.where(follows, np.append(first[1:], 0)[:len(first)] + OVERLAP, ends[text])
    last = words.ends[stop - 1]
    # What stands behind a chunk's last word may differ; a chunk always ends in a break.
    lengths = last + 1 - words.starts[first]
    offsets = np.append(0, np.cumsum(lengths))
    places = np.arange(offsets[-1]) + np.repeat(words.starts[first] - offsets[:-1], lengths)
    letters = data[places]
    letters[offsets[1:] - 1] = BREAK
    return pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(letters)), text, follows


def chunk_dictionary(docs: DataFrame, *, text: str = "text", lang: str = "lang", modulus: int = MODULUS) -> DataFrame:
    """``lang, chunk, follows, times`` of all distinct chunks, written.

    In ``chunk`` a blank follows each word and a line feed the last of a piece;
    ``follows``: its last four words are the next chunk's first.
    """
    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        chunks, text_of, follows = _parsed(batch.column(1), modulus)
        if not len(chunks):
            return None
        table = pa.table({"lang": batch.column(0).take(pa.array(text_of)), "chunk": chunks, "follows": pa.array(follows),
                          "times": np.ones(len(chunks), np.int64)})
        table = table.group_by(["lang", "chunk", "follows"]).aggregate([("times", "sum")]).rename_columns(table.column_names)
        return table.cast(pa.schema([("lang", pa.string()), ("chunk", pa.string()), ("follows", pa.bool_()), ("times", pa.int64())])
                          ).combine_chunks().to_batches()[0]

    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    chunks = over_batches(rows, "lang string, chunk string, follows boolean, times long", work, BYTES_AT_ONCE)
    return cut_lineage(chunks.groupBy("lang", "chunk", "follows").agg(F.sum("times").alias("times")))


class Chunks:
    """A slice of the dictionary, taken apart."""

    def __init__(self, batch: pa.RecordBatch):
        langs = batch.column(0).dictionary_encode()
        self.langs = langs.dictionary
        chunks = batch.column(3).cast(pa.large_string())
        _, places, letters = chunks.buffers()
        places = np.frombuffer(places, np.int64)[chunks.offset:chunks.offset + len(chunks) + 1]
        self.words = words = Words(np.frombuffer(letters or b"", np.uint8)[places[0]:places[-1]])
        ends = np.searchsorted(words.ends, places[1:] - places[0])
        sizes = np.diff(ends, prepend=0)
        follows = batch.column(1).to_numpy(zero_copy_only=False)
        many = np.arange(len(words.ids))
        self.owned = many < np.repeat(ends - OVERLAP * follows, sizes)
        self.times = np.repeat(batch.column(2).to_numpy(), sizes)
        codes = langs.indices.to_numpy().astype(np.int64)
        self.lang = np.repeat(codes, sizes)
        salts = _run_hashes(*_letters(self.langs))
        self.hashes = mixed(words.hashes ^ np.repeat(salts[codes], sizes))
        stops = np.flatnonzero(words.breaks)
        self.room = stops[np.searchsorted(stops, many)] - many + 1 if len(stops) else many

    def counted(self, places: np.ndarray, keys: np.ndarray, words: int) -> pa.RecordBatch | None:
        """The phrases of so many words at these places, equal keys being equal phrases, with the sum of their times."""
        order = np.argsort(keys, kind="stable")
        places, keys = places[order], keys[order]
        heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]) if len(keys) else keys)
        if not len(heads):
            return None
        sums, first = np.add.reduceat(self.times[places], heads), places[heads]
        return pa.RecordBatch.from_arrays(
            [self.langs.take(pa.array(self.lang[first])), self.words.texts(first, words), pa.array(np.full(len(first), words, np.int32)),
             pa.array(sums)], ["lang", "phrase", "words", "f"])

    def hash_of(self, places: np.ndarray, words: int) -> np.ndarray:
        out = np.zeros(len(places), np.uint64)
        for k in range(words):
            out = mixed(out * _STEP + self.hashes[places + k])
        return out


def _letters(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    _, places, letters = strings.cast(pa.large_string()).buffers()
    places = np.frombuffer(places, np.int64)[:len(strings) + 1]
    return np.frombuffer(letters or b"", np.uint8)[:places[-1]], places


def _frequent(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes % np.uint64(BITS)
    return (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _single(chunks: Chunks, _: np.ndarray) -> Iterator[pa.RecordBatch | None]:
    places = np.flatnonzero(chunks.owned)
    yield chunks.counted(places, chunks.lang[places] * chunks.words.distinct + chunks.words.ids[places], 1)


def _pairs(chunks: Chunks, bits: np.ndarray) -> Iterator[pa.RecordBatch | None]:
    """Hashes of the pairs of frequent words with the sum of their times; which are frequent is settled later, by the words."""
    known = _frequent(bits, chunks.hash_of(np.arange(len(chunks.hashes)), 1))
    places = np.flatnonzero((chunks.owned & known & (chunks.room >= 2))[:-1] & known[1:])
    hashes = chunks.hash_of(places, 2)
    order = np.argsort(hashes)
    hashes, times = hashes[order], chunks.times[places[order]]
    heads = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]) if len(hashes) else hashes)
    if len(heads):
        yield pa.RecordBatch.from_arrays([pa.array(hashes[heads].view(np.int64)), pa.array(np.add.reduceat(times, heads))], ["hash", "f"])


def _longer(chunks: Chunks, bits: np.ndarray) -> Iterator[pa.RecordBatch | None]:
    places = np.flatnonzero(chunks.room >= 2)
    places = places[_frequent(bits, chunks.hash_of(places, 2))]
    ids = chunks.words.ids
    names = np.full(len(ids) + 1, -1)
    _, names[places] = np.unique((chunks.lang[places] * chunks.words.distinct + ids[places]) * chunks.words.distinct + ids[places + 1],
                                 return_inverse=True)
    owned = chunks.owned[places]
    yield chunks.counted(places[owned], names[places[owned]], 2)
    for words in range(3, LONGEST + 1):
        # A run has a name if its first and its last words have one; a pair of names is a new name.
        places = places[(names[places + 1] >= 0) & (chunks.room[places] >= words)]
        _, found = np.unique(names[places] * (int(names.max(initial=0)) + 1) + names[places + 1], return_inverse=True)
        names = np.full(len(ids) + 1, -1)
        names[places] = found
        owned = chunks.owned[places]
        yield chunks.counted(places[owned], found[owned], words)


COUNTED = "lang string, phrase string, words int, f long"
HASHED = "hash long, f long"


def _counts(dictionary: DataFrame, work, bits: bytes, schema: str = COUNTED) -> DataFrame:
    """The sums of what ``work`` finds in the dictionary's chunks, ``f`` by all other columns."""
    shared = dictionary.sparkSession.sparkContext.broadcast(bits)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        found = [x for x in work(Chunks(batch), np.frombuffer(shared.value, np.uint8)) if x is not None]
        return pa.Table.from_batches(found).combine_chunks().to_batches()[0] if found else None

    rows = over_batches(dictionary.select("lang", "follows", "times", "chunk"), schema, run, BYTES_AT_ONCE)
    return rows.groupBy(*[c for c in rows.columns if c != "f"]).agg(F.sum("f").alias("f"))


def _hashed(words: DataFrame) -> DataFrame:
    """``hash`` of single words, as ``Chunks.hash_of`` has it.  Made of the frequent alone, it need not be shuffled with all."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            salts = _run_hashes(*_letters(langs.dictionary))[langs.indices.to_numpy()]
            words = _run_hashes(*_letters(pc.binary_join_element_wise(batch.column(1), "", chr(BLANK))))
            yield pa.RecordBatch.from_arrays([pa.array(mixed(mixed(words ^ salts)).view(np.int64))], ["hash"])

    return words.select("lang", "phrase").mapInArrow(run, "hash long")


def _bitmap(frequent: DataFrame) -> bytes:
    """The bits of all frequent phrases: ``BITS`` of them, put together by Spark in pieces of 4 KB."""
    bit = F.col("hash").bitwiseAND(F.lit(BITS - 1))
    bits = frequent.select(bit.alias("bit")).groupBy(F.floor(F.col("bit") / BITS_A_BUCKET).alias("bucket")).agg(
        F.bitmap_construct_agg((F.col("bit") % BITS_A_BUCKET).cast("long")).alias("bits"))
    out = bytearray(BITS // 8)
    for bucket, piece in bits.collect():
        out[bucket * 4096:(bucket + 1) * 4096] = piece
    return bytes(out)


def phrase_counts(docs: DataFrame, *, least: int, text: str = "text", lang: str = "lang", modulus: int = MODULUS) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, words, f`` of all phrases of one to five words that occur ``least`` times, and ``lang, n``."""
    dictionary = chunk_dictionary(docs, text=text, lang=lang, modulus=modulus)
    words = cut_lineage(_counts(dictionary, _single, b""))
    often = F.col("f") >= least
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    # Pairs that share a hash are counted together here, so none that is frequent is missed.
    pairs = cut_lineage(_counts(dictionary, _pairs, _bitmap(_hashed(words.where(often))), HASHED).where(often))
    found = words.where(often).unionByName(cut_lineage(_counts(dictionary, _longer, _bitmap(pairs)).where(often)))
    return found.select("lang", "phrase", "words", "f"), totals


def _whole(number: Column) -> Column:
    return number.cast(T.DecimalType(19, 0))


def collocations(docs: DataFrame, *, least: int = 100, top: int = 2000, text: str = "text", lang: str = "lang",
                 modulus: int = MODULUS) -> DataFrame:
    """Each language's ``top`` phrases: ``lang, rank, phrase, a, l, r, n, score``.

    A phrase has two to five words of one piece of text and occurs ``least`` times.
    ``score`` is floor(1000 * a * n / (l * r)) of the cut with the least of them (ties:
    the first cut), in decimals of 38 digits.  A phrase inside a longer one that
    occurs as often is dropped; it is enough to look at phrases one word longer, since
    all between the two occur as often as both.

    A null text counts as empty, a null language as ``und``.  Repeated rows count as
    often as they stand there; no order of rows matters; other columns are not read.
    Ties of score and count go by the phrase's bytes.  An empty table gives an empty
    table.  A worker holds a slice of texts, the largest a single text.
    """
    return ranked(*phrase_counts(docs, least=least, text=text, lang=lang, modulus=modulus), top)


def ranked(found: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    """``collocations`` of counted phrases (every part of a phrase being among them) and the languages' numbers of words."""
    parts = found.select("lang", F.col("phrase").alias("part"), F.col("f").alias("part_f"))
    candidates = found.where("words > 1")
    split = F.split("phrase", " ")
    cut = F.posexplode(F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda k: F.struct(
        F.array_join(F.slice(split, F.lit(1), k), " ").alias("first"),
        F.array_join(F.slice(split, k + 1, F.col("words") - k), " ").alias("rest")))).alias("k", "cut")
    cuts = candidates.select("lang", "phrase", "f", cut).select("lang", "phrase", "f", "k", "cut.*")
    left = parts.select("lang", F.col("part").alias("first"), F.col("part_f").alias("l"))
    right = parts.select("lang", F.col("part").alias("rest"), F.col("part_f").alias("r"))
    weighed = cuts.join(left.hint("merge"), ["lang", "first"]).join(right.hint("merge"), ["lang", "rest"]).join(totals, "lang")
    scored = weighed.select(
        "lang", "phrase", "f", "n", "k", "l", "r", (_whole(F.col("f") * 1000) * _whole(F.col("n"))).alias("above"),
        (_whole(F.col("l")) * _whole(F.col("r"))).alias("below")).withColumn("score", F.expr("above div below"))
    lowest = scored.groupBy("lang", "phrase", "f", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # The two phrases one word shorter that lie in a candidate, with its count.
    words = F.size(split)
    inner = candidates.where("words > 2").select("lang", F.col("f").alias("outer_f"), F.explode(F.array(
        F.array_join(F.slice(split, F.lit(1), words - 1), " "), F.array_join(F.slice(split, F.lit(2), words - 1), " "))).alias("phrase"))
    outer = inner.groupBy("lang", "phrase").agg(F.max("outer_f").alias("outer_f"))
    kept = lowest.join(outer.hint("merge"), ["lang", "phrase"], "left").where(F.coalesce(F.col("outer_f") * 100 < F.col("f") * 100, F.lit(True)))
    best = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("f"), "phrase")
    return kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score")


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded WHERE len(w) > 0),
runs AS (
  SELECT lang, m AS words, array_to_string(w[i:i + m - 1], ' ') AS phrase
  FROM starts, range(1, 6) AS lengths(m) WHERE i + m - 1 <= len(w)),
counts AS (SELECT lang, words, phrase, count(*) AS f FROM runs GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS n FROM counts WHERE words = 1 GROUP BY lang),
often AS (SELECT * FROM counts WHERE f >= 100),
cuts AS (
  SELECT lang, words, phrase, f, string_split(phrase, ' ') AS w, unnest(range(1, words)) AS k FROM often WHERE words > 1),
scored AS (
  SELECT c.lang, c.phrase, c.f, t.n, c.k, l.f AS l, r.f AS r,
         (1000::HUGEINT * c.f * t.n) // (l.f::HUGEINT * r.f) AS score
  FROM cuts c JOIN totals t ON c.lang = t.lang
  JOIN often l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.k], ' ')
  JOIN often r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.k + 1:], ' ')),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT DISTINCT s.lang, s.phrase FROM often s JOIN often o ON s.lang = o.lang AND o.words > s.words AND 100 * o.f >= 100 * s.f
    AND contains(' ' || o.phrase || ' ', ' ' || s.phrase || ' ') WHERE s.words > 1),
ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, f DESC, phrase) AS rank, phrase, f AS a, l, r, n, score
  FROM lowest ANTI JOIN inside USING (lang, phrase))
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""
