"""Byte-pair encoding by a deterministic automaton (operator 1).

The automaton is compiled from the ranked merges by successive merge gadgets. It starts with one state
that loops on every base symbol, so it accepts every sequence of base symbols. The gadget of the merge
``(u, v) -> w`` changes it so that it accepts exactly the sequences in which no ``u v`` is left:

* wherever an arc ``u`` leads to a state with an arc ``v``, an arc ``w`` is added that ends where ``v`` ends;
* the state after ``u`` is split off (if other tokens end in it) and loses its arc ``v`` (and ``w`` where ``u``
  is ``v``, since merges go from left to right).

All arcs with one label end in one state, so the automaton is a table: a row for each state, a column for
each class of labels that may be read in the same states. Rows and columns are shared until a gadget has to
tell two of them apart, and the table holds one bit for each pair.

Every prefix of a word has one accepted path, which ends with exactly one token. ``encode`` therefore
walks the word once and keeps the last token of each prefix; a transition is one look-up of the table.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topspin.llm.shared import by_bytes

#: White space as the tokenizer's normaliser has it; Python's str.split() also cuts at U+001C..U+001F.
_SPACE = regex.compile(r"[\t-\r \x85\xa0  -     　]+")
#: Stands for the end of a word; a private code point, which byte-level letters never are.
_END = "\ue000"
_ODD_SPACE = regex.compile(r"[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 bytes stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class MergeAutomaton:
    """The automaton of ranked merges.

    ``vocab`` maps labels to ids and ``merges`` lists pairs of labels by rank. ``suffix`` is the mark of a
    word's end, which belongs to the last base symbol of a word. Two merges that make the same label are
    refused, since labels wouldn't be unique then.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        size = max(vocab.values(), default=-1) + 1
        pairs = [(vocab[u], vocab[v], vocab[u + v]) for u, v in merges]
        if len({w for *_, w in pairs}) < len(pairs):
            raise ValueError("two merges make the same label")
        made = {w for *_, w in pairs}
        # bits[c, r] tells that state r lacks the arcs of class c, packed along r. A gadget splits one row and one column at most.
        bits = np.zeros((len(pairs) + 1 + sum(u == v for u, v, _ in pairs), len(pairs) // 8 + 1), np.uint8)
        row, column = np.zeros(size, np.int64), np.zeros(size, np.int64)
        row_users, column_users = [size - len(made)], [size - len(made)]
        column[list(made)] = -1
        for u, v, w in pairs:
            cu, cv, ru = column[u], column[v], row[u]
            if cu < 0 or cv < 0 or bits[cv, ru >> 3] >> (ru & 7) & 1:
                continue  # no path has u before v: the gadget changes nothing
            column[w], row[w] = cu, row[v]
            column_users[cu] += 1
            row_users[row[v]] += 1
            if row_users[ru] > 1:
                new = len(row_users)
                at, to = ru >> 3, new >> 3
                bits[: len(column_users), to] |= (bits[: len(column_users), at] >> np.uint8(ru & 7) & 1) << np.uint8(new & 7)
                row_users[ru] -= 1
                row_users.append(1)
                row[u] = ru = new
            # u u u becomes w u, not u w: equal labels lose the arc w after u as well
            for lost in (v,) if u != v else (v, w):
                c = column[lost]
                if column_users[c] > 1:
                    new = len(column_users)
                    bits[new] = bits[c]
                    column_users[c] -= 1
                    column_users.append(1)
                    column[lost] = c = new
                bits[c, ru >> 3] |= np.uint8(1 << (ru & 7))
        self.shape = (len(row_users), len(column_users))
        bits = bits[: len(column_users), : (len(row_users) + 7) // 8].copy()
        self._stride = bits.shape[1]
        self._table = memoryview(bits.reshape(-1))
        self._row, self._column = row.tolist(), column.tolist()
        self.labels = {i: s for s, i in vocab.items()}
        #: Finds the labels that end at each place of a word, the longest first; the end of a word counts as a letter.
        self._arcs = ahocorasick.Automaton()
        for label, i in vocab.items():
            if column[i] >= 0:
                final = suffix and label.endswith(suffix)
                key = label.removesuffix(suffix) + _END if final else label
                self._arcs.add_word(key, (i, len(key)))
        self._arcs.make_automaton()
        self._end = _END if suffix else ""

    def step(self, a: int, b: int) -> bool:
        """Whether the state after token ``a`` has an arc ``b``."""
        r = self._row[a]
        return not self._table[self._column[b] * self._stride + (r >> 3)] >> (r & 7) & 1

    def encode(self, word: str) -> list[int]:
        """The ids of one pre-split word. A word with a symbol that the vocabulary lacks raises KeyError."""
        if not word:
            return []
        n = len(word) + len(self._end)
        row, column, stride, table = self._row, self._column, self._stride, self._table
        last, size = [-1] * (n + 1), [0] * (n + 1)
        for end, (token, length) in self._arcs.iter(word + self._end):
            end += 1
            if last[end] >= 0:
                continue
            start = end - length
            if start:
                before = last[start]
                if before < 0:
                    continue
                r = row[before]
                if table[column[token] * stride + (r >> 3)] >> (r & 7) & 1:
                    continue
            last[end], size[end] = token, length
        if last[n] < 0:
            raise KeyError(word)
        out, end = [], n
        while end:
            out.append(last[end])
            end -= size[end]
        out.reverse()
        return out

    def decode(self, ids: list[int]) -> list[str]:
        """The arc labels of a path."""
        return [self.labels[i] for i in ids]


class WordTokenizer:
    """Reads a tokenizer file of the byte-level kind with word ends and applies it to whole texts.

    Normalisation is NFC, white space to blanks, lower case by code point; words come from the file's
    pattern; strings of added tokens in a text become their ids. White space always ends a word, so texts
    are cut there and each piece is encoded once and kept, as long as there is room.
    """

    ROOM = 200_000

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = MergeAutomaton(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.automaton.labels |= {i: s for s, i in self.added.items()}
        self._added = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) or r"(?!)")
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self._words = regex.compile(pattern)
        self._letters = byte_letters()
        self._kept: dict[str, tuple[bytes, str]] = {}
        self._older: dict[str, tuple[bytes, str]] = {}

    def _piece(self, piece: str) -> tuple[bytes, str]:
        done = self._older.get(piece)
        if done is None:
            ids: list[int] = []
            for word in self._words.findall(piece):
                ids += self.automaton.encode(word if word.isascii() and word.isprintable() else "".join([self._letters[b] for b in word.encode("utf-8", "replace")]))
            done = array("i", ids).tobytes(), " ".join(self.automaton.decode(ids))
        if len(self._kept) >= self.ROOM:  # what was used since the last turn stays
            self._kept, self._older = {}, self._kept
        self._kept[piece] = done
        return done

    def _plain(self, text: str) -> list[tuple[bytes, str]]:
        text = unicodedata.normalize("NFC", text)
        text = (text.replace("Σ", "σ") if "Σ" in text else text).lower()
        pieces = _SPACE.split(text) if _ODD_SPACE.search(text) else text.split()
        make = self._piece
        return [self._kept.get(p) or make(p) for p in pieces if p]

    def encode(self, text: str) -> tuple[bytes, str]:
        """The ids of a text as 32-bit integers, and its decoded text (the labels, joined by blanks)."""
        if "<" in text and self._added.search(text):
            parts, at = [], 0
            for m in self._added.finditer(text):
                parts += self._plain(text[at : m.start()])
                parts.append((np.int32(self.added[m[0]]).tobytes(), m[0]))
                at = m.end()
            parts += self._plain(text[at:])
        else:
            parts = self._plain(text)
        return b"".join([p[0] for p in parts]), " ".join([p[1] for p in parts if p[1]])


@functools.lru_cache(2)
def tokenizer(path: str) -> WordTokenizer:
    """One for each worker process; compiling takes a second or two."""
    return WordTokenizer(path)


def encode_documents(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encode and decode every whole text: ``(id_column, ids array<int>, decoded string)``.

    One row for each row of ``docs``, repeated rows included; other columns are left out. A null or empty
    text, and one of white space only, gives no ids and an empty decoded text. Nothing is shuffled: a task
    streams through its part of the input in batches that are bounded by bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(path)
        for batch in by_bytes(batches, "text", 1 << 20):
            done = [coder.encode(t) if t else (b"", "") for t in batch.column("text").to_pylist()]
            offsets = np.cumsum([0, *(len(d[0]) // 4 for d in done)], dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join([d[0] for d in done]), np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("key"), ids, pa.array([d[1] for d in done], pa.string())], names=["key", "ids", "decoded"])

    source = docs.select(F.col(id_column).alias("key"), F.col(text_column).cast("string").alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, ids array<int>, decoded string").withColumnRenamed("key", id_column)


def digests(encoded: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Number of tokens, and SHA-256 of the decimal ids joined by blanks and of the decoded text."""
    return encoded.select(
        id_column,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
