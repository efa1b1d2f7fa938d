"""Vector bin packing of token sequences: simultaneous limits on tokens, segments and
loss-bearing tokens.

Every partition packs its own examples while they stream through, so there is no shuffle and
no large state: a pool holds at most ``pool`` examples.  An example longer than a sequence
first gives off full sequences; its rest joins the pool.  A sequence is filled by the
dot-product heuristic: among the examples that fit in what is left of all three limits, take
the one with the largest weighted dot product of its demand and the remaining capacity; a
dimension weighs as much as the pool's mean demand for it.  When nothing fits and cutting
is allowed, the example with the largest product is cut to fill the gap.

The last sequence of a partition would be short.  With cutting allowed it is split into
sequences whose lengths are powers of two, which need no padding, so many partitions cost
no padding either.

Defined results: a null text is empty; an example without ids yields no piece; repeated rows
and ids are packed row by row; an empty table gives no rows; other columns are ignored.
Without cutting, an example that breaks a limit on its own raises an error instead of
being dropped.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.tokens import text_encoder, text_slices

MAX_TOKENS = 1024
MAX_SEGMENTS = 256
POOL = 2048
MIN_PIECE = 8


@dataclass
class Limits:
    tokens: int = MAX_TOKENS
    segments: int = MAX_SEGMENTS
    loss: int = MAX_TOKENS
    cut: bool = True
    min_piece: int = MIN_PIECE
    pool: int = POOL


class VectorPacker:
    """Streaming packer of one partition.  Examples are (id, ids, mask): ids as a uint32
    array, mask a boolean array of loss-bearing tokens.  Pieces come out as
    (id, start, ids, n_all, n_loss, sequence, offset)."""

    def __init__(self, limits: Limits, first_sequence: int = 0):
        import numpy as np

        self.np, self.lim = np, limits
        self.cap = np.array([limits.tokens, limits.segments, limits.loss], dtype=float)
        self.seq = first_sequence
        self.items: list = [None] * limits.pool
        self.need = np.zeros((limits.pool, 3))  # tokens, segments, loss; 0 tokens: free slot
        self.free = list(range(limits.pool))

    def _put(self, item) -> None:
        slot = self.free.pop()
        self.items[slot] = item
        self.need[slot] = (len(item[2]), 1, item[3].sum())

    def _take(self, slot: int):
        item, self.items[slot] = self.items[slot], None
        self.need[slot] = 0
        self.free.append(slot)
        return item

    def _emit(self, pieces: list) -> Iterator[tuple]:
        offset = 0
        for doc, start, ids, mask, total in pieces:
            yield doc, start, ids, total, int(mask.sum()), self.seq, offset
            offset += len(ids)
        self.seq += 1

    def _prefix(self, mask, room_tokens: int, room_loss: int) -> int:
        """Longest prefix within both rooms."""
        n = min(room_tokens, len(mask))
        if mask[:n].sum() <= room_loss:
            return n
        return int(self.np.searchsorted(self.np.cumsum(mask[:n]), room_loss, side="right"))

    def add(self, doc, ids, mask) -> Iterator[tuple]:
        total, start, lim = len(ids), 0, self.lim
        if not lim.cut and (total > lim.tokens or mask.sum() > lim.loss):
            raise ValueError(f"example {doc!r} breaks a limit on its own and cutting is off")
        while total - start >= lim.tokens or mask[start:].sum() > lim.loss:
            n = self._prefix(mask[start:], lim.tokens, lim.loss)
            if not n:
                raise ValueError("the limit on loss-bearing tokens must be at least 1")
            yield from self._emit([(doc, start, ids[start : start + n], mask[start : start + n], total)])
            start += n
        if start < total:
            self._put((doc, start, ids[start:], mask[start:], total))
            if len(self.free) <= 1:
                while len(self.free) < lim.pool // 2:
                    yield from self._emit(self._fill())

    def _fill(self) -> list:
        """The pieces of one sequence, taken from the pool."""
        np, need, lim = self.np, self.need, self.lim
        used = need[:, 0] > 0
        weight = need[used].mean(axis=0) / self.cap
        room, pieces = self.cap.copy(), []
        score_of = need * (weight / self.cap**2)
        while room[0] > 0 and room[1] > 0:
            fits = used & (need <= room).all(axis=1)
            if fits.any():
                slot = int(np.where(fits, score_of @ room, -1.0).argmax())
                used[slot] = False
                item = self._take(slot)
                room -= (len(item[2]), 1, item[3].sum())
                pieces.append((item[0], item[1], item[2], item[3], item[4]))
                continue
            if not lim.cut or room[0] < lim.min_piece or not used.any():
                break
            slot = int(np.where(used, score_of @ room, -1.0).argmax())
            doc, start, ids, mask, total = self.items[slot]
            n = self._prefix(mask, int(room[0]), int(room[2]))
            if not n:
                break
            used[slot] = False
            self._take(slot)
            pieces.append((doc, start, ids[:n], mask[:n], total))
            self._put((doc, start + n, ids[n:], mask[n:], total))
            room -= (n, 1, mask[:n].sum())
        return pieces

    def finish(self) -> Iterator[tuple]:
        lim = self.lim
        while (self.need[:, 0] > 0).any():
            pieces = self._fill()
            size = sum(len(p[2]) for p in pieces)
            if not lim.cut or size == lim.tokens or (self.need[:, 0] > 0).any():
                yield from self._emit(pieces)
                continue
            for bit in reversed(range(size.bit_length())):
                if not size >> bit & 1:
                    continue
                room, part = 1 << bit, []
                while room:
                    doc, start, ids, mask, total = pieces[0]
                    n = min(room, len(ids))
                    part.append((doc, start, ids[:n], mask[:n], total))
                    room -= n
                    if n == len(ids):
                        pieces.pop(0)
                    else:
                        pieces[0] = (doc, start + n, ids[n:], mask[n:], total)
                yield from self._emit(part)


def _first_sequence() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId() << 33


def _pieces_out(pieces: Iterable[tuple], id_type, rows: int = 2048) -> Iterator:
    import pyarrow as pa

    kinds = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    names = [c.split()[0] for c in _COLUMNS.split(", ")]

    def batch(part):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), kinds)], names)

    part: list[tuple] = []
    for doc, start, ids, total, n_loss, seq, offset in pieces:
        part.append((doc, start, len(ids), ids.tobytes(), total, n_loss, seq, offset))
        if len(part) == rows:
            yield batch(part)
            part = []
    if part:
        yield batch(part)


_COLUMNS = "id {id}, start long, length long, ids binary, doc_tokens long, n_loss long, sequence_id long, offset long"


def pack_examples(
    examples: DataFrame, id_col: str, ids_col: str, loss_col: str | None = None, limits: Limits | None = None
) -> DataFrame:
    """Pack rows of token ids (array<int>).  ``loss_col`` (array<boolean>, as long as the
    ids) marks loss-bearing tokens; without it, or where it is null, all are.  Instruction
    data sets it to true on answers only."""
    limits = limits or Limits()
    loss = F.col(loss_col) if loss_col else F.lit(None).cast("array<boolean>")
    source = examples.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"), loss.alias("loss"))
    id_type = source.schema["id"].dataType.simpleString()

    def pack(batches):
        import numpy as np

        packer = VectorPacker(limits, _first_sequence())

        def pieces():
            for batch in batches:
                for r in batch.to_pylist():
                    ids = np.array(r["ids"] or [], dtype="<u4")
                    mask = np.ones(len(ids), dtype=bool) if r["loss"] is None else np.array(r["loss"], dtype=bool)
                    if len(mask) != len(ids):
                        raise ValueError(f"example {r['id']!r}: the loss mask is not as long as its ids")
                    yield from packer.add(r["id"], ids, mask)
            yield from packer.finish()

        from pyspark.sql.pandas.types import to_arrow_type

        yield from _pieces_out(pieces(), to_arrow_type(source_id_type))

    source_id_type = source.schema["id"].dataType
    return source.mapInArrow(pack, _COLUMNS.format(id=id_type)).withColumnRenamed("id", id_col)


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    limits: Limits | None = None,
) -> DataFrame:
    """Encode whole texts, close each with ``end_id`` and pack them in the same pass.
    Every id but the closing one bears loss."""
    limits = limits or Limits()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    source_id_type = source.schema["id"].dataType

    def pack(batches):
        import numpy as np
        from pyspark.sql.pandas.types import to_arrow_type

        encoder, packer = text_encoder(tokenizer_path), VectorPacker(limits, _first_sequence())
        end = np.array([end_id], dtype="<u4").tobytes()

        def pieces():
            for batch in batches:
                for lo, part in text_slices(batch.column("text")):
                    names = batch.column("id").slice(lo, len(part)).to_pylist()
                    for doc, raw in zip(names, encoder.encode(part)):
                        ids = np.frombuffer(raw + end, dtype="<u4")
                        mask = np.ones(len(ids), dtype=bool)
                        mask[-1] = False
                        yield from packer.add(doc, ids, mask)
            yield from packer.finish()

        yield from _pieces_out(pieces(), to_arrow_type(source_id_type))

    return source.mapInArrow(pack, _COLUMNS.format(id=source_id_type.simpleString())).withColumnRenamed("id", id_col)
