"""Packing token sequences: concatenate and cut.

Pass 1 tokenises every document once and writes its ids, with the running token
count inside its partition. The partition totals, one number each, are summed up
on the driver; pass 2 adds them to place each document on one global token axis
and cuts that axis every ``length`` tokens. A document that crosses a boundary
gives one record per window it touches. No shuffle moves tokens, and a document
of any length is cut independently of all others.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from basalt.llm import caches
from basalt.plans.durable import written

CACHED_WORDS = 400_000
CACHED_LENGTH = 64
#: str.split() takes these as white space, the tokenizer doesn't.
ODD_SPACES = "\x1c\x1d\x1e\x1f"
#: Marks that are tokens of their own after a letter at a word's end.
TAIL = ".,;:!?"

_loaded: dict[str, "WordIds"] = {}
caches.register("packing", _loaded.clear)


def _byte_letters() -> dict[int, str]:
    """Latin-1 character of a byte -> the letter that byte-level tokenizers write for it."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(256 + k) for k, b in enumerate(rest)}


class WordIds(dict):
    """The ids of each word, as little-endian unsigned integers of ``dtype``.

    The tokenizer cuts at white space and drops it, and no control string holds any, so
    a text's ids are those of its words in order. A word of Latin letters alone is one unit of its model,
    whatever its case, and a mark after it is another; other words go through the
    whole tokenizer. Words not met for a while leave the table, which changes no result.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.old: dict[str, bytes] = {}
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def unit(self, word: str) -> bytes:
        """A lower-case word of letters before U+0180, which are composed already."""
        text = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return np.array([t.id for t in self.model.tokenize(text)], self.dtype).tobytes()

    def __missing__(self, word: str) -> bytes:
        out = self.old.get(word)
        if out is None:
            if len(word) > CACHED_LENGTH:
                return self.whole(word)
            rest = word[:-1] if word[-1] in TAIL else word
            # others may be letters whose normal form has marks or ends in one
            plain = rest.isalpha() and max(rest) < "\u0180" and "\u0130" not in rest
            if plain and rest is not word:
                out = self[rest] + self[word[-1]]
            elif plain:
                low = word.lower()
                out = self.unit(word) if low == word else self[low]
            else:
                out = self.whole(word)
        if len(self) >= CACHED_WORDS:
            self.old = dict(self)
            self.clear()
        self[word] = out
        return out

    def of(self, text: str) -> bytes:
        if any(c in text for c in ODD_SPACES):
            return self.whole(text)
        return b"".join(map(self.__getitem__, text.split()))


def word_ids(path: str) -> WordIds:
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


def tokenize(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, part, before, tokens, width, ids): ids end with ``end_id``; ``before`` counts tokens in the same partition.

    Rows of one ``part`` come from one attempt of one task, so ``before`` fits them only
    once this is written; ``pack`` does that.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches.use("packing")
        table, before, part = word_ids(tokenizer), 0, TaskContext.get().partitionId()
        end = np.array([end_id], table.dtype).tobytes()
        for batch in batches:
            ids = [table.of(t or "") + end for t in batch.column(1).to_pylist()]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // table.dtype.itemsize
            starts = before + np.cumsum(sizes) - sizes
            before += int(sizes.sum())
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(n, part, np.int32)), pa.array(starts), pa.array(sizes), pa.array(np.full(n, table.dtype.itemsize, np.int32)), pa.array(ids, pa.binary())],
                ["doc_id", "part", "before", "tokens", "width", "ids"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, part int, before bigint, tokens bigint, width int, ids binary"
    )


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, length: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids.

    ``start`` counts the document's ids before the piece, ``offset`` the sequence's;
    ``ids`` are little-endian unsigned 32-bit. Sequences 0, 1, ... are all ``length``
    long but the last, which alone needs padding. Null and empty texts are the end
    id alone. Repeated rows are documents of their own, a null id is carried along;
    an empty table gives no rows, and other columns are ignored.
    """
    done = written(tokenize(docs, tokenizer, end_id, id_col, text_col), "tokens")
    # one row per partition of pass 1
    totals = sorted((r["part"], r["n"]) for r in done.groupBy("part").agg(F.sum("tokens").alias("n")).collect())
    base = dict(zip((p for p, _ in totals), itertools.accumulate((n for _, n in totals), initial=0)))
    bases = docs.sparkSession.sparkContext.broadcast(base)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = bases.value
        for batch in batches:
            tokens = batch.column(3).to_numpy()
            if not len(tokens):
                continue
            first = np.fromiter(map(base.__getitem__, batch.column(1).to_pylist()), np.int64, len(tokens)) + batch.column(2).to_numpy()
            seq0, seq1 = first // length, (first + tokens - 1) // length
            n = seq1 - seq0 + 1
            row = np.repeat(np.arange(len(tokens)), n)
            seq = seq0[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            begin = np.maximum(first[row], seq * length)
            end = np.minimum((first + tokens)[row], (seq + 1) * length)
            ids, width = batch.column(5).to_pylist(), batch.column(4)[0].as_py()
            rel, size = begin - first[row], end - begin
            cuts = [np.frombuffer(ids[r], f"<u{width}", s, a * width).astype("<u4").tobytes() for r, a, s in zip(row.tolist(), rel.tolist(), size.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(rel), pa.array(size), pa.array(tokens[row]), pa.array(seq), pa.array(begin - seq * length), pa.array(cuts, pa.binary())],
                ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )

    kind = done.schema["doc_id"].dataType.simpleString()
    return done.mapInArrow(cut, f"doc_id {kind}, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary")
