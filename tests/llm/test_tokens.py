import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import public_tokenizers as public
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from recordlens.llm import bpe, token_files
from recordlens.llm.suite import vocabulary
from recordlens.session import scratch_folder

LETTERS = " \t\n\r\x0b\x0c\x1c\x1f\x85\xa0  'sltreABÉ  12٣é́ñ日本😀.,!<|endoftext|>"


@pytest.fixture(scope="module")
def ranks():
    return vocabulary("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=bpe.read_ranks(ranks), special_tokens={})


def texts(count, seed):
    draw = random.Random(seed)
    return ["".join(draw.choice(LETTERS) for _ in range(draw.randint(0, 40))) for _ in range(count)]


def test_rank_queue_equals_tiktoken(ranks, reference):
    codec = bpe.Codec(bpe.read_ranks(ranks), public.PATTERN)
    all_texts = texts(3000, 1) + ["ab" * 4000, "a" * 3001, "x" * 49, " " * 60, "abab " * 50]
    for text, packed in zip(all_texts, codec.encode(all_texts), strict=True):
        assert np.frombuffer(packed, "<u4").tolist() == reference.encode_ordinary(text), text[:50]
        assert codec.decode(packed) == text.encode()


def test_one_piece_queue_equals_the_shared_queue(ranks):
    table = bpe.read_ranks(ranks)
    codec = bpe.Codec(table, public.PATTERN)
    draw = random.Random(2)
    pieces = ["".join(draw.choice("abther ") for _ in range(draw.randint(2, 30))).encode() for _ in range(2000)]
    pieces = [p for p in pieces if p not in table]
    shared = bpe.merge_all(pieces, codec.pairs, codec.single)
    assert [np.frombuffer(s, "<u4").tolist() for s in shared] == [bpe.merge(p, table) for p in pieces]


def test_encode_edges(edge, nothing, ranks, reference):
    coded = bpe.encode(edge, ranks, public.PATTERN, decoded=True)
    assert coded.columns.count("ids") == 1 and "text" not in coded.columns and "key" in coded.columns
    found = sorted((r["n_tokens"], bytes(r["ids"]), bytes(r["decoded"])) for r in coded.collect())
    wanted = []
    for r in edge.select("text").collect():
        ids = reference.encode_ordinary(r[0] or "")
        wanted.append((len(ids), np.array(ids, "<u4").tobytes(), (r[0] or "").encode()))
    assert found == sorted(wanted)
    assert bpe.encode(nothing, ranks, public.PATTERN).count() == 0
    again = bpe.decode(coded.select("doc_id", "ids", "lang"), ranks)
    assert sorted(bytes(r[0]) for r in again.select("decoded").collect()) == sorted(w[2] for w in wanted)


def test_chunks_equal_whole_texts():
    encoder = token_files.Encoder(vocabulary("word_bpe_49k.json").decode())
    whole = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    all_texts = texts(4000, 3) + ["Word. word) ). (word.) A.B. it's. O'Neill's, end", "<|ENDOFTEXT|> A. <|endoftext|>", "é. ñ, —. …, a., b,. '. x.\ny,\nz. "]
    ids, offsets = encoder.encode(all_texts)
    for k, text in enumerate(all_texts):
        assert ids[offsets[k]:offsets[k + 1]].tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(token_files, "REMEMBERED", 50)
    monkeypatch.setattr(token_files, "CHUNKS_AT_ONCE", 7)
    small, large = (token_files.Encoder(vocabulary("word_bpe_49k.json").decode(), 2) for _ in range(2))
    monkeypatch.setattr(token_files, "LONGEST_REMEMBERED", 3)
    for part in ([], [None, ""], texts(30, 5), texts(30, 6), texts(30, 5)):
        a, b = small.encode(part)
        monkeypatch.setattr(token_files, "REMEMBERED", 10**6)
        c, d = large.encode(part)
        monkeypatch.setattr(token_files, "REMEMBERED", 50)
        assert a.tolist() == c.tolist() and b.tolist() == d.tolist()


def test_token_files(spark, edge, nothing):
    whole = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    path = scratch_folder(spark)
    token_files.write_tokens(edge, path, vocabulary("word_bpe_49k.json").decode(), end=2)
    found = token_files.id_checksums(token_files.read_tokens(spark, path)).orderBy("start").collect()
    rows = edge.select("doc_id", F.xxhash64("text").alias("tie"), "text").collect()
    rows.sort(key=lambda r: (r[0] is not None, r[0], r[1]))
    start = 0
    for row, got in zip(rows, found, strict=True):
        ids = [*whole.encode(row["text"] or "", add_special_tokens=False).ids, 2]
        assert (got["doc_id"], got["start"], got["n_tokens"]) == (row["doc_id"], start, len(ids))
        assert got["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    empty = scratch_folder(spark)
    token_files.write_tokens(nothing, empty, vocabulary("word_bpe_49k.json").decode())
    assert token_files.read_tokens(spark, empty).count() == 0


def test_files_have_small_pages_and_encodings(spark, edge):
    import glob

    import pyarrow.parquet as pq

    path = scratch_folder(spark)
    token_files.write_tokens(edge, path, vocabulary("word_bpe_49k.json").decode(), end=2)
    meta = [pq.ParquetFile(f).metadata for f in glob.glob(f"{path.removeprefix('file:')}/*.parquet")]
    for group in (m.row_group(0) for m in meta if m.num_rows):
        columns = {group.column(k).path_in_schema: group.column(k) for k in range(group.num_columns)}
        assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
        assert any("DICTIONARY" in e for e in columns["ids.list.element"].encodings)
        assert all(c.has_offset_index and c.has_column_index for c in columns.values())


def test_digest_of_query(spark, ranks, reference):
    docs = spark.createDataFrame([(1, "hello there")], "doc_id long, text string")
    row = bpe.encode(docs, ranks, public.PATTERN).select(F.sha2("ids", 256)).first()
    assert row[0] == hashlib.sha256(np.array(reference.encode_ordinary("hello there"), "<u4").tobytes()).hexdigest()


def test_new_words_are_given_to_the_tokenizer_together():
    words = [a + b + c for a in "bcdfghäé" for b in "aeiouö" for c in ("rt", "nge", "st,&&&", "lß.")]
    text = "  ".join(words) + " 10-20 x's naïve,\tİ ﬁ"
    encoder = token_files.Encoder(vocabulary("word_bpe_49k.json").decode(), 2)
    real, given = encoder.tokenizer, []

    class Counting:
        def encode_batch_fast(self, texts, **options):
            given.extend(texts)
            return real.encode_batch_fast(texts, **options)

    encoder.tokenizer = Counting()
    ids, offsets = encoder.encode([text, None, text])
    whole = [*real.encode(text, add_special_tokens=False).ids, 2]
    assert ids.tolist() == [*whole, 2, *whole] and offsets.tolist() == [0, len(whole), len(whole) + 1, 2 * len(whole) + 1]
    assert len(given) <= len(words) / 16


def test_the_shared_queue_holds_little(ranks):
    """Every byte of a slice's new pre-tokens has a place in the queue, so what a place takes is a worker's memory."""
    codec, draw = bpe.Codec(bpe.read_ranks(ranks), public.PATTERN), random.Random(5)
    pieces = [bytes(draw.choices(b"etaoinshrdlu", k=draw.randint(5, 14))) for _ in range(20_000)]
    tracemalloc.start()
    bpe.merge_all(pieces, codec.pairs, codec.single)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60 * sum(map(len, pieces))


def test_marks_of_a_whole_slice_are_cut_at_once():
    mark = re.compile(r"(?<=[A-Za-z0-9])([.,;:!?])(?=[ \t-\r])")
    odd = ["", None, "a", ".", "a.", " b", ". c", "a. b", "1; 2: x!\ty?\nz", "a.. b", "\u00e9. b", "a.\x1c", "\u65e5\u672c. a, b"]
    every = [*texts(500, 7), *odd, *reversed(odd)]
    for column in (pa.array(every, pa.string()), pa.array(every, pa.string()).slice(3, 509), pa.array([], pa.string()), pa.array([""])):
        cut = token_files.marks_apart(column.fill_null("")).to_pylist()
        assert cut == [mark.sub(r" \1", text or "") for text in column.to_pylist()]
    assert token_files.lower_case(pa.array(["A<|B", "AB\u00c9"])).to_pylist() == ["A<|B", "ab\u00c9"]


def test_a_column_is_encoded_as_a_list_is():
    every = [*texts(200, 8), None, "", " \t"]
    one, other = (token_files.Encoder(vocabulary("word_bpe_49k.json").decode(), 2) for _ in range(2))
    for found, wanted in zip(one.encode(pa.array(every, pa.string())), other.encode(every), strict=True):
        assert found.tolist() == wanted.tolist()
