"""Operator 13: SentencePiece encoding by tables of distinct marked words, and decoding."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table
from .kernels import chunks

#: The whitespace marker of SentencePiece; spaces become markers, and a text gets one in front.
MARK = "▁"
#: Bytes of text that are cut into words at once (a longer text is taken whole).
WORD_CHUNK = 1 << 20
#: Distinct words, and code points of them, beyond which a task's table starts anew.
TABLE_WORDS = 250_000
TABLE_CHARS = 1 << 23


def model_bytes(path: str | None = None) -> bytes:
    """The model file, read on the driver; tasks get the bytes, so executors need no file."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return Path(path).read_bytes()


def cuts_at_marks(model) -> bool:
    """Whether texts may be cut before every run of markers: no piece may hold a marker behind another character.

    Pieces then never cross such a place, so what merges on one side does not depend on the other. ValueError for models
    that change texts other than by markers, as words of the raw text are then not those of the model.
    """
    probe = " a  b\t\nÅﬁｆ "
    if model.normalize(probe) != MARK + probe.replace(" ", MARK):
        raise ValueError("only models without text normalization and with a leading marker are supported")
    return not any(MARK in model.id_to_piece(i).lstrip(MARK) for i in range(model.get_piece_size()))


def marked_words(data: np.ndarray, offsets: np.ndarray, apart: bool = True) -> tuple[pa.Array, np.ndarray]:
    """The marked words of the rows of a chunk, and the words before each row.

    Every row that is not empty gets a space in front; a word is a run of spaces and markers with what follows up to the
    next one. With ``apart`` false a row is one word. Words are slices of one buffer, in order.
    """
    full = np.diff(offsets) > 0
    data = np.insert(data, offsets[:-1][full], 32)
    row_at = offsets + np.concatenate(([0], np.cumsum(full)))
    begins = np.zeros(len(data) + 1, bool)
    begins[row_at] = True
    if apart and len(data) > 2:
        mark = (data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)
        inside = data == 32
        inside[:-2] |= mark
        starts = inside.copy()
        inside[1:-1] |= mark
        inside[2:] |= mark
        begins[1:-1] |= starts[1:] & ~inside[:-1]
    begins[-1] = True
    at = np.flatnonzero(begins)
    words = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data))
    return words, np.searchsorted(at, row_at)


class WordTable:
    """Ids of distinct marked words; each is segmented by the library once, unless the table had to start anew."""

    def __init__(self, model):
        self.model, self.ids, self.held = model, {}, 0

    def of(self, words: list[str]) -> list[list[int]]:
        new = [w for w in words if w not in self.ids]
        found = self.model.encode([w[1:] for w in new], num_threads=1)
        for i, w in enumerate(new):
            if w in (" ", MARK):  # the library puts no marker before an empty text
                found[i] = [self.model.piece_to_id(MARK)]
        self.ids.update(zip(new, found, strict=True))
        self.held += sum(map(len, new))
        out = [self.ids[w] for w in words]
        if len(self.ids) > TABLE_WORDS or self.held > TABLE_CHARS:
            self.ids, self.held = {}, 0
        return out


def encoded(texts: pa.Array, words: WordTable, apart: bool) -> Iterator[pa.Array]:
    """Ids of the texts, a list array a chunk: the distinct words of the chunk are looked up, their ids go back by position."""
    for row, end, data, offsets in chunks(texts, WORD_CHUNK):
        found, row_words = marked_words(data, offsets, apart)
        distinct = found.dictionary_encode()
        ids = words.of(distinct.dictionary.to_pylist())
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int32, int(size.sum()))
        first = np.concatenate(([0], np.cumsum(size)))[:-1]
        which = distinct.indices.to_numpy(zero_copy_only=False)
        ends = np.concatenate(([0], np.cumsum(size[which])))
        place = np.arange(ends[-1]) + np.repeat(first[which] - ends[:-1], size[which])
        yield pa.ListArray.from_arrays(pa.array(ends[row_words].astype(np.int32)), pa.array(flat[place]))


def encode(df: DataFrame, text: str = "text", name: str = "ids", model: bytes | None = None) -> DataFrame:
    """``df`` with the ids of every whole text, as the library encodes it without begin or end ids.

    No piece crosses the start of a run of whitespace markers, so texts are cut there, the distinct marked words of a
    chunk of texts are segmented once and kept in a table of the task, and ids are joined back by position. Where pieces
    do cross them, each whole text counts as one word. The tables need no shuffle: neither the size of a word's group nor
    copies matter. Null and empty texts have no ids; equal texts have equal ids; a column called ``name`` is replaced,
    all others stay. No rows, no rows.
    """
    proto = model or model_bytes()

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import sentencepiece

        made = sentencepiece.SentencePieceProcessor(model_proto=proto)
        words, apart = WordTable(made), cuts_at_marks(made)
        for texts in batches:
            parts = list(encoded(texts, words, apart))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return df.withColumn(name, ids(F.col(text).cast("string")))


def decode(df: DataFrame, ids: str = "ids", name: str = "decoded", model: bytes | None = None) -> DataFrame:
    """``df`` with the text that the library decodes from all ids of a row; null and empty lists give the empty text."""
    proto = model or model_bytes()

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import sentencepiece

        made = sentencepiece.SentencePieceProcessor(model_proto=proto)
        for lists in batches:
            yield pa.array([made.decode(x.as_py() or []) for x in lists], pa.string())

    return df.withColumn(name, text(F.col(ids)))


def op13_piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digest of every document's ids, and the digest of the text decoded from them.

    The digests are written as a table, in small Arrow batches, and read again.
    """
    out = decode(encode(table(spark, sf_dir, "documents").select("doc_id", "text")))
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    out = out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
    return materialize(out, "piece-digests")
