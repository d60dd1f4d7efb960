"""Corpus encoding with a public byte-level BPE tokenizer by prefix dynamic programming.

For every byte prefix of a piece of text exactly one token can end the prefix's encoding; the table of
these last tokens is filled from left to right. A token may follow the last token of the prefix before it
only if no merge across their seam would come first, which depends on the two tokens alone and is kept.
Appending continues the table; an edit fills it in from the changed byte to the end of its piece and keeps
all other pieces. Work is linear in the text, also for very long pieces.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from calorgrid.runtime import spread

#: Entries that a worker keeps of encoded pieces and of judged token pairs before it starts afresh.
CACHE = 400_000


def default_path() -> str:
    """Where byte_bpe_50k lies; a parameter everywhere else."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and the seam test of one byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters, vocab = _byte_letters(), model["vocab"]
        self.byte = [0] * 256
        for letter, b in letters.items():
            self.byte[b] = vocab[letter]
        self.pair: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.ends: dict[bytes, int] = {}  # every prefix of a token; -1 if it is no token itself
        self.length: dict[int, int] = {t: 1 for t in self.byte}
        for b, t in enumerate(self.byte):
            self.ends[bytes([b])] = t
        text = {t: bytes([b]) for b, t in enumerate(self.byte)}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            a, b, t = vocab[left], vocab[right], vocab[left + right]
            self.pair[a, b] = t
            self.rank[t] = rank
            self.parts.setdefault(t, (a, b))
            whole = text[t] = text[a] + text[b]
            self.ends[whole] = t
            self.length[t] = len(whole)
            for k in range(1, len(whole)):
                self.ends.setdefault(whole[:k], -1)
        self.longest = max(self.length.values())
        self._apart: dict[tuple[int, int], bool] = {}

    def apart(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are when their bytes are encoded together.

        The tokens at the seam at any time are a node of the left token's right edge and one of the right
        token's left edge. A merge of two such nodes happens if it ranks before the merges that would
        absorb either of them; of equal merges the left one comes first.
        """
        known = self._apart.get((left, right))
        if known is None:
            known, a, until_a = True, left, 1 << 60
            while known:
                b, until_b = right, 1 << 60
                while True:
                    across = self.pair.get((a, b))
                    if across is not None:
                        r = self.rank[across]
                        if r < until_a and r <= until_b:
                            known = False
                            break
                    if b not in self.parts:
                        break
                    until_b, b = self.rank[b], self.parts[b][0]
                if a not in self.parts:
                    break
                until_a, a = self.rank[a], self.parts[a][1]
            if len(self._apart) >= CACHE:
                self._apart.clear()
            self._apart[left, right] = known
        return known

    def extend(self, data: bytes, last: list[int]) -> None:
        """Fills ``last``, the last token of each prefix, from the prefixes it has to the whole of ``data``."""
        ends, apart, n = self.ends, self.apart, len(data)
        known = len(last) - 1
        last.extend([-1] * (n - known))
        # tokens that end behind the known prefixes may start up to one longest token before
        for start in range(max(0, known - self.longest), n):
            before = last[start]
            for stop in range(start + 1, n + 1):
                token = ends.get(data[start:stop])
                if token is None:
                    break
                if token >= 0 and stop > known and last[stop] < 0 and (start == 0 or apart(before, token)):
                    last[stop] = token

    def read(self, last: list[int]) -> list[int]:
        out, at = [], len(last) - 1
        while at:
            out.append(last[at])
            at -= self.length[last[at]]
        out.reverse()
        return out


class Encoder:
    """Encodes texts; keeps the encodings of pieces that recur."""

    def __init__(self, path: str, pattern: str):
        self.vocabulary = Vocabulary(path)
        self.split = regex.compile(pattern).findall
        self.finditer = regex.compile(pattern).finditer
        self._pieces: dict[str, list[int]] = {}

    def piece(self, text: str) -> list[int]:
        data = text.encode("utf-8")
        token = self.vocabulary.ends.get(data, -1)
        if token >= 0:
            return [token]
        last = [0]
        self.vocabulary.extend(data, last)
        return self.vocabulary.read(last)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text without special tokens; no ids for a null or empty text."""
        out: list[int] = []
        if not text:
            return out
        pieces, grow = self._pieces, out.extend
        for p in self.split(text):
            ids = pieces.get(p)
            if ids is None:
                ids = self.piece(p)
                if len(p) <= 64:
                    if len(pieces) >= CACHE:
                        pieces.clear()
                    pieces[p] = ids
            grow(ids)
        return out


class PrefixTable:
    """A text with the last token of every prefix of its pieces, open to exact appends and edits.

    After a change the text is split again from two pieces before it (a piece's end depends on at most one
    character behind it) until a border falls on an old one; what lies behind keeps its pieces. A new piece
    takes over the table of the old piece at its place as far as their bytes agree, so appending a letter to
    a long piece fills in one entry. ``touched`` counts the entries filled in so far.
    """

    def __init__(self, encoder: Encoder, text: str = ""):
        self.encoder, self.text, self.touched = encoder, "", 0
        self.starts: list[int] = []
        self.pieces: list[tuple[bytes, list[int]]] = []  # bytes of the piece, last tokens of its prefixes
        self.append(text)

    def _piece(self, data: bytes, old: tuple[bytes, list[int]] | None) -> tuple[bytes, list[int]]:
        last = [0]
        if old is not None:
            was, table = old
            common = min(len(was), len(data))
            if was[:common] != data[:common]:
                low, high = 0, common  # the agreeing prefix by halving
                while low < high:
                    mid = (low + high + 1) // 2
                    low, high = (mid, high) if was[:mid] == data[:mid] else (low, mid - 1)
                common = low
            last = table[: common + 1]
        self.touched += len(data) + 1 - len(last)
        self.encoder.vocabulary.extend(data, last)
        return data, last

    def _replace(self, start: int, stop: int, new: str) -> None:
        text = self.text[:start] + new + self.text[stop:]
        moved, settled = len(new) - (stop - start), start + len(new)
        keep = max(0, bisect_right(self.starts, start) - 3)
        at = self.starts[keep] if keep < len(self.starts) else 0
        old_starts, old = self.starts[keep:], self.pieces[keep:]
        place = {s: k for k, s in enumerate(old_starts)}
        del self.starts[keep:], self.pieces[keep:]
        self.text = text
        for m in self.encoder.finditer(text, at):
            s = m.start()
            k = place.get(s - moved) if s >= settled else None
            if k is not None:  # from here on nothing has changed but the places
                self.starts.extend(x + moved for x in old_starts[k:])
                self.pieces.extend(old[k:])
                return
            k = place.get(s) if s <= start else None
            self.starts.append(s)
            self.pieces.append(self._piece(m.group().encode("utf-8"), None if k is None else old[k]))

    def append(self, more: str) -> None:
        """Appends text."""
        self._replace(len(self.text), len(self.text), more)

    def edit(self, start: int, stop: int, new: str) -> None:
        """Replaces ``text[start:stop]``."""
        self._replace(start, stop, new)

    @property
    def ids(self) -> list[int]:
        return [i for _, last in self.pieces for i in self.encoder.vocabulary.read(last)]


def encoder(path: str, pattern: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    import sys

    held = sys.modules.setdefault("_calorgrid_encoders", type(sys)("_calorgrid_encoders")).__dict__
    key = f"{path}|{pattern}"
    if key not in held:
        held[key] = Encoder(path, pattern)
    return held[key]


def _runner(path: str, pattern: str, counts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                encoded = [enc.encode(t) for t in batch.column(1).to_pylist()]
                lengths = np.fromiter(map(len, encoded), dtype="int64", count=len(encoded))
                if counts:
                    yield pa.record_batch([batch.column(0), pa.array(lengths)], names=["key", "n"])
                    continue
                flat = np.fromiter((i for ids in encoded for i in ids), dtype="int32", count=int(lengths.sum()))
                offsets = np.concatenate([[0], np.cumsum(lengths)]).astype("int32")
                yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["key", "ids"])

    return run


def token_ids(df: DataFrame, doc_id: str, text: str, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``doc_id, ids``: the ids of each text without special tokens; ``[]`` for null and empty texts.

    Special tokens' strings are ordinary text. Rows stay as they are (null ids and repeated rows too);
    other columns are not read; an empty table gives no rows. No shuffle unless the scan has fewer
    partitions than cores.
    """
    rows = spread(df.select(df[doc_id].cast("long").alias("key"), df[text].alias("text")), "key")
    out = rows.mapInArrow(_runner(path or default_path(), pattern or default_pattern(), False), "key long, ids array<int>")
    return out.withColumnRenamed("key", doc_id)


def token_counts(df: DataFrame, doc_id: str, text: str, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``doc_id, n``: the number of ids of each text, as :func:`token_ids`."""
    rows = spread(df.select(df[doc_id].cast("long").alias("key"), df[text].alias("text")), "key")
    out = rows.mapInArrow(_runner(path or default_path(), pattern or default_pattern(), True), "key long, n long")
    return out.withColumnRenamed("key", doc_id)
