"""Operator 4, packing: concatenate all documents and cut the stream into fixed windows.

Two-pass prefix sums: the first pass tokenizes and stores each document with its place in its scan
task; the token totals of the tasks (one number each) are summed to global offsets; the second pass
adds them and cuts at every multiple of the window. A document that crosses a boundary gives a
record on either side of it, so only the last sequence is padded.

Defined results: a null or empty text is the end mark alone; a null doc_id and repeated rows are
packed like any other; an empty table gives no pieces; extra columns are not read. Documents lie in
scan order.
"""

import struct
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from poolwatch.llm.common import documents, in_small_batches, stored

WINDOW = 4096
END = 2
# Words kept from batch to batch, in each of two generations; others are tokenized again.
KEPT_WORDS = 250_000

TOKENS = "doc_id long, n long, ids binary, part int, place long"
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
)
# Latin text, on which the file's normalizer is plain lower-casing of each character: NFC leaves it as it is.
_LATIN = regex.compile("[!-~¡-įı-ž]+")
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

_encoders: dict[str, "Encoder"] = {}


class Encoder:
    """Token ids by the tokenizer of a file, a blank-separated word at a time.

    The tokenizer drops white space before it splits, so the ids of a text are those of its words
    in turn, and frequent words are looked up. Words of Latin letters go straight to the
    tokenizer's model; any other word through the whole tokenizer.
    """

    def __init__(self, path: str, kept: int = KEPT_WORDS):
        import json

        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.whole.get_vocab_size() < 1 << 16 else "<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.model = self.whole.model if self._plain(json.loads(open(path, encoding="utf-8").read())) else None
        self.bytes = _byte_letters()
        self.kept = kept
        self.forget()

    def forget(self) -> None:
        """Drop the words looked up so far."""
        self.new, self.old, self.parts = {"": b""}, {}, {}

    @staticmethod
    def _plain(file: dict) -> bool:
        steps = [x["type"] for x in (file.get("normalizer") or {}).get("normalizers", [])]
        cut = (file.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        marked = all(t["content"].startswith("<|") for t in file.get("added_tokens", []))
        return steps == ["NFC", "Replace", "Lowercase"] and marked and cut[0].get("pattern", {}).get("Regex") == _PIECES.pattern

    def _packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def _piece(self, piece: str) -> bytes:
        got = self.parts.get(piece)
        if got is None:
            shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.bytes)
            got = self._packed([t.id for t in self.model.tokenize(shown)])
            if len(self.parts) >= self.kept:
                self.parts.clear()
            self.parts[piece] = got
        return got

    def _word(self, word: str) -> bytes:
        if not (word.isascii() and word.isprintable() or _LATIN.fullmatch(word)) or "<|" in word:
            return self._packed(self.whole.encode(word, add_special_tokens=False).ids)
        word = word.lower()
        if word.isalpha():
            return self._piece(word)
        if word[-1] in ".,!" and word[:-1].isalpha():
            return self._piece(word[:-1]) + self._piece(word[-1])
        return b"".join(map(self._piece, _PIECES.findall(word)))

    def ids(self, text: str) -> bytes:
        if self.model is None:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.kind).tobytes()
        words = text.replace("\n", " ").split(" ")
        for word in set(words).difference(self.new):
            got = self.old.get(word)
            self.new[word] = self._word(word) if got is None else got
        out = b"".join(map(self.new.__getitem__, words))
        if len(self.new) > self.kept:
            self.old, self.new = self.new, {"": b""}
        return out


def _byte_letters() -> dict[int, int]:
    """The printable letter that byte-level tokenizers write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: b for b in shown}
    letters |= {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in letters)}
    return letters


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def tokenized(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """Ids of each document with its scan task (part) and the tokens before it in that task."""

    def run(batches):
        coder, part, place = encoder(path), TaskContext.get().partitionId(), 0
        mark = np.array([end], coder.kind).tobytes()
        size = coder.kind.itemsize
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    rows = batch.slice(at, 256)
                    ids = [coder.ids(t or "") + mark for t in rows.column(1).to_pylist()]
                    n = np.array([len(x) // size for x in ids], np.int64)
                    places = place + np.cumsum(n) - n
                    place += int(n.sum())
                    yield pa.RecordBatch.from_arrays(
                        [rows.column(0), pa.array(n), pa.array(ids, pa.binary()),
                         pa.array(np.full(len(n), part, np.int32)), pa.array(places)],
                        names=["doc_id", "n", "ids", "part", "place"],
                    )
        finally:
            coder.forget()  # the worker goes on to other tasks

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, TOKENS)


def pack(docs: DataFrame, path: str, end: int = END, window: int = WINDOW) -> DataFrame:
    """Pieces of all documents; `ids` holds a piece's ids as unsigned little-endian 32-bit numbers."""
    tokens = stored(tokenized(in_small_batches(docs), path, end), "tokens")
    # One row for each task of the first pass, whatever the number of documents.
    totals = sorted(tuple(r) for r in tokens.groupBy("part").agg(F.max(F.col("place") + F.col("n"))).collect())
    before, base = 0, []
    for part, total in totals:
        base.append((part, before))
        before += total
    bases = tokens.sparkSession.createDataFrame(base, "part int, before long")

    def cut(batches):
        for batch in batches:
            out = [[] for _ in range(8)]
            for doc, n, ids, begin in zip(*(batch.column(i).to_pylist() for i in range(4))):
                wide = np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4").astype("<u4")
                at = 0
                while at < n:
                    where = begin + at
                    length = min(n - at, window - where % window)
                    piece = wide[at : at + length].tobytes()
                    row = (doc, at, length, zlib.crc32(piece), n, where // window, where % window, piece)
                    for column, value in zip(out, row):
                        column.append(value)
                    at += length
            kinds = [pa.int64()] * 7 + [pa.binary()]
            names = [x.split()[0] for x in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    placed = tokens.join(F.broadcast(bases), "part").select("doc_id", "n", "ids", F.col("place") + F.col("before"))
    return placed.mapInArrow(cut, PIECES)


def sequences(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per sequence with its ids and the boundaries of its pieces. A sequence holds at most
    `window` tokens, so a group is small."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids")))
    full = F.sum("length")
    return pieces.groupBy("sequence_id").agg(parts.alias("parts"), full.alias("n_tokens")).select(
        "sequence_id", "n_tokens",
        # A last sequence as long as a power of two stays so; others are padded to the window.
        F.when(F.expr("bit_count(n_tokens) = 1"), 0).otherwise(window - F.col("n_tokens")).alias("padding"),
        F.expr("aggregate(parts, binary(''), (a, p) -> concat(a, p.ids))").alias("ids"),
        F.expr("transform(parts, p -> struct(p.doc_id, p.start, p.offset, p.length))").alias("boundaries"),
    )


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_packing(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    return pack(documents(spark, sf_dir), path or vocabulary()).drop("ids")
