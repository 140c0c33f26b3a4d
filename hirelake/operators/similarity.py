"""Similarities of two skill lists per row, as products over blocks of rows.

A row holds skill names only.  Rows are dealt into blocks, and each block is
sent the vector of every distinct skill in it once, ahead of its rows; a
distinct pair of skills of a batch is multiplied once.  So a vector crosses
the shuffle and Arrow once per block, whatever the number of rows that list
its skill, and a very popular job or resume is spread over all blocks.  A
task holds the vectors of one block and some rows of a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.entities import parts
from .skew import written

#: Products of so many pairs are held at once, and rows of so many cells (wanted times own skills) are judged at once, one row at least.
PAIRS, CELLS = 1 << 15, 1 << 20
#: Rows of a block.
ROWS = 1 << 17


class Vectors:
    """Unit vectors of named skills; a skill without one is a row of zeros."""

    def __init__(self, names: list[pa.Array], lists: list[pa.Array]) -> None:
        self.names = pa.concat_arrays(names) if names else pa.array([], pa.string())
        rows = [np.asarray(v, np.float64) for a in lists for v in a.to_pylist()]
        width = max((len(r) for r in rows), default=1)
        self.unit = np.zeros((len(rows) + 1, width))
        for i, r in enumerate(rows):
            norm = np.sqrt((r * r).sum())
            self.unit[i, :len(r)] = r / norm if norm > 0 else 0.0

    def places(self, skills: pa.Array) -> np.ndarray:
        at = pc.index_in(skills, value_set=self.names)
        return pc.fill_null(at, len(self.names)).to_numpy(zero_copy_only=False)

    def products(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Cosines of the pairs of places, each distinct pair multiplied once."""
        pairs, where = np.unique(a.astype(np.int64) * len(self.unit) + b, return_inverse=True)
        out = np.empty(len(pairs))
        for i in range(0, len(pairs), PAIRS):
            left, right = np.divmod(pairs[i:i + PAIRS], len(self.unit))
            out[i:i + PAIRS] = np.einsum("ij,ij->i", self.unit[left], self.unit[right])
        return out[where]


class Cells:
    """All (wanted, own) pairs of the rows of a batch, wanted skill by wanted skill.

    ``group`` is the flat place of the wanted skill, ``own`` that of the other
    one, ``k`` its place in its list; ``sim`` is 1 for equal names.
    """

    def __init__(self, wanted: pa.ListArray, own: pa.ListArray, vectors: Vectors) -> None:
        self.offsets = wanted.offsets.to_numpy() - wanted.offsets[0].as_py()
        starts = own.offsets.to_numpy() - own.offsets[0].as_py()
        names = pa.concat_arrays([wanted.flatten(), own.flatten().field("skill")]).dictionary_encode()
        codes, places = names.indices.to_numpy(zero_copy_only=False), vectors.places(names.dictionary)
        n = self.offsets[-1]
        row = np.repeat(np.arange(len(wanted)), np.diff(self.offsets))
        many = np.diff(starts)[row]
        self.group = np.repeat(np.arange(n), many)
        self.k = np.arange(len(self.group)) - np.repeat(np.cumsum(many) - many, many)
        self.own = starts[row][self.group] + self.k if n else self.k
        a, b = codes[:n][self.group], codes[n:][self.own]
        self.same = a == b
        self.sim = np.where(self.same, 1.0, vectors.products(places[a], places[b]))

    def firsts(self, keep: np.ndarray, *order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Kept cells sorted by group, then ``order``, and where each group present begins."""
        at = np.flatnonzero(keep)
        at = at[np.lexsort((*[o[at] for o in reversed(order)], self.group[at]))]
        return at, np.flatnonzero(np.r_[True, np.diff(self.group[at]) != 0]) if len(at) else at


def slices(batch: pa.RecordBatch, wanted: str, own: str) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``CELLS`` cells."""
    cells = np.cumsum(pc.multiply(pc.list_value_length(batch.column(wanted)), pc.list_value_length(batch.column(own))).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = np.flatnonzero(np.r_[True, np.diff(cells // CELLS) != 0, True])
    yield from (batch.slice(lo, hi - lo) for lo, hi in zip(cuts, cuts[1:]))


def map_blocks(rows: DataFrame, key: str, wanted: str, own: str, vectors: DataFrame, judge: Callable[[pa.RecordBatch, Vectors], pa.Array],
               out: str, kind: T.DataType, blocks: int | None = None) -> DataFrame:
    """Add column ``out``: ``judge`` of each batch of rows and the vectors of its block.

    ``wanted`` is an array of names, ``own`` an array of structs with a ``skill``;
    ``vectors(skill, embedding)``; rows are dealt by ``key`` into blocks of about
    ``ROWS`` rows, a task each.  The rows are written once, as both the skills of a
    block and its rows are read from them.
    """
    cols = rows.columns
    rows = written(rows, "blocks")
    blocks = blocks or parts(rows, ROWS)
    rows = rows.withColumn("_b", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))
    skills = rows.select("_b", F.explode(F.concat(wanted, F.col(own)["skill"])).alias("skill")).where("skill IS NOT NULL").distinct()
    sent = skills.join(vectors.select("skill", "embedding"), "skill")
    first = sent.select(*[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in cols], "_b", F.col("skill").alias("_skill"), F.col("embedding").alias("_vec"))
    both = first.unionByName(rows.withColumns({"_skill": F.lit(None).cast("string"), "_vec": F.lit(None).cast(first.schema["_vec"].dataType)}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, names, lists, ready = None, [], [], None
        for b in batches:
            number, is_row = b.column("_b").to_numpy(zero_copy_only=False), b.column("_skill").is_null().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.r_[True, (np.diff(number) != 0) | (np.diff(is_row.astype(int)) != 0), True])
            for lo, hi in zip(cuts, cuts[1:]):
                part = b.slice(lo, hi - lo)
                if number[lo] != block:
                    block, names, lists, ready = number[lo], [], [], None
                if not is_row[lo]:
                    names.append(part.column("_skill"))
                    lists.append(part.column("_vec"))
                    continue
                ready = ready or Vectors(names, lists)
                for mine in slices(part.select(cols), wanted, own):
                    yield pa.RecordBatch.from_arrays([*mine.columns, judge(mine, ready)], names=[*cols, out])

    dealt = both.repartitionById(blocks, "_b").sortWithinPartitions("_b", F.col("_skill").asc_nulls_last())
    return dealt.mapInArrow(run, T.StructType([*[rows.schema[c] for c in cols], T.StructField(out, kind)]))
