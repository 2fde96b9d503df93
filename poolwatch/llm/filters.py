"""A filter of fixed size over ids, which grows with no table: it says of an id that it may be in a set, never that
it is not when it is."""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

_CHUNK_BITS = 16


class Filter:
    """A bit for every value of an id's lowest bits."""

    def __init__(self, chunks: list[tuple[int, bytes]], bits: int):
        self.mask = (1 << bits) - 1
        self.held = np.zeros(1 << bits, bool)
        for chunk, packed in chunks:
            part = np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8))
            self.held[chunk << _CHUNK_BITS : (chunk << _CHUNK_BITS) + part.size] = part.view(bool)

    def __contains__(self, i: int) -> bool:
        return bool(self.held[i & self.mask])

    def has(self, ids: np.ndarray) -> np.ndarray:
        return self.held[ids & self.mask]

    def keep(self, ids: np.ndarray) -> np.ndarray:
        """The ids, 0 for those that are not in the set."""
        return np.where(self.has(ids), ids, 0)


def id_filter(ids: DataFrame, bits: int) -> Filter:
    """The filter over the first column of `ids`, 64-bit numbers whose lowest bits are spread evenly."""

    def fill(batches):
        held = {}
        for batch in batches:
            place = batch.column(0).to_numpy()
            for chunk in np.unique(place >> _CHUNK_BITS).tolist():
                if chunk not in held:
                    held[chunk] = np.zeros(1 << min(_CHUNK_BITS, bits), bool)
                held[chunk][place[place >> _CHUNK_BITS == chunk] & ((1 << _CHUNK_BITS) - 1)] = True
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.int32()), pa.array([zlib.compress(np.packbits(x).tobytes(), 1) for x in held.values()], pa.binary())],
            names=["chunk", "bits"])

    places = ids.select(F.col(ids.columns[0]).bitwiseAND((1 << bits) - 1).alias("place")).distinct()
    dealt = places.repartition(F.shiftright("place", _CHUNK_BITS)).mapInArrow(fill, "chunk int, bits binary")
    return Filter([(c, bytes(b)) for c, b in dealt.collect()], bits)
