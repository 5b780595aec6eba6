"""Token counts of whole texts (operator 2): lengths only, from batches that hold about the same number of bytes.

Texts are cut at safe boundaries: before a blank that follows another character. No piece of the model has a
blank behind another character (``safe`` checks this when the model is read), so no merge spans such a place,
and a text's count is the sum of its units' counts. A unit is a run of blanks and what follows up to the next blank.
Units that a worker has counted before are looked up; the others go to the library together, each batch about as
many bytes, so one very long text is as little trouble as many short ones.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topspin.llm.shared import by_bytes

BLANK = "▁"
_UNITS = re.compile("[ ▁]+[^ ▁]*")


class UnitCounter:
    """Counts for a model; ``room`` bounds the units that are kept, ``batch_bytes`` what goes to the library at once."""

    def __init__(self, path: str, room: int = 400_000, batch_bytes: int = 1 << 18):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.room, self.batch_bytes = room, batch_bytes
        size = self.model.get_piece_size()
        self.safe = not any(BLANK in self.model.id_to_piece(i).lstrip(BLANK) for i in range(size)) and len(self._ids("  a ")) == len(self._ids("  a")) + 1
        self._kept: dict[str, int] = {}
        self._older: dict[str, int] = {}

    def _ids(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)

    def units(self, text: str) -> list[str]:
        """``text`` cut before each blank that follows another character; each unit without the blank that the model itself puts first."""
        if "  " in text or BLANK in text or text[0] == " " or text[-1] == " ":
            return [u[1:].replace(BLANK, " ") for u in _UNITS.findall(" " + text)]
        return text.split(" ")

    def _library(self, units: Iterable[str]) -> Iterator[tuple[str, int]]:
        batch: list[str] = []
        held = 0
        for u in units:
            batch.append(u)
            held += len(u) if u.isascii() else len(u.encode(errors="replace"))
            if held >= self.batch_bytes:
                yield from zip(batch, map(len, self.model.encode(batch, num_threads=1)), strict=True)
                batch, held = [], 0
        if batch:
            yield from zip(batch, map(len, self.model.encode(batch, num_threads=1)), strict=True)

    def counts(self, texts: list[str]) -> list[int]:
        if not self.safe:
            return [len(self._ids(t)) for t in texts]
        cut = [self.units(t) if t else [] for t in texts]
        now = self._kept
        new = {u for units in cut for u in units if u not in now}
        found = {u: n for u in new if (n := self._older.get(u)) is not None}
        found |= self._library(sorted(new - found.keys()))
        if "" in found:
            found[""] = 1  # a blank at a text's end; the library leaves out the blank that it puts first if nothing follows
        if len(now) + len(found) > self.room and now:
            self._older, self._kept = now, {}
            found |= {u: n for units in cut for u in units if (n := now.get(u)) is not None}
        self._kept |= found
        get = self._kept.__getitem__
        return [sum(map(get, units)) for units in cut]


@functools.lru_cache(2)
def counter(path: str) -> UnitCounter:
    return UnitCounter(path)


def count_tokens(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id_column, n_bytes, n_tokens)`` of every whole text, by the SentencePiece model at ``path``.

    One row for each row of ``docs``; a null text counts as empty (0 bytes, 0 tokens). No begin or end tokens;
    strings of control symbols in a text are ordinary text, as is the library's default. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            sizes = pc.binary_length(batch.column("text")).fill_null(0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("key"), sizes, pa.array(counter(path).counts(texts), pa.int64())], names=["key", "n_bytes", "n_tokens"])

    source = docs.select(F.col(id_column).alias("key"), F.col(text_column).cast("string").alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, n_bytes long, n_tokens long").withColumnRenamed("key", id_column)
