"""Online packing by the sum of squares: every document goes to the fill level that keeps the squared counts of open windows least."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters encoded at once: a longer text is taken in stretches that end before white space, where a token ends too.
CHARS_AT_ONCE = 1 << 19
#: A task's open windows: beyond so many they are settled, so that their ids take bounded memory.
MOST_OPEN = 2_048
#: Pieces of one batch of the result.
ROWS_TOGETHER = 20_000
#: Cuts of the vocabulary's kind: contractions, letters, digits, others (each after a space, if any), and white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A text that shows whether the vocabulary file cuts and merges as PATTERN and ranks do.
_PROBE = "It's we'll  don't\n\n x-1 a1b22 ÀÉß 漢字 ¿qué?\t\t http://a.b/c_d?e=f#g !!! ²½ \U0001f600 end  "
_BREAK = re.compile(r"(?<=\S)\s")
_encoders: dict[str, ByteEncoder] = {}
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class ByteEncoder:
    """Ids of a text for a byte-level BPE vocabulary file: by a faster library, and by the file's own where a text holds a special token's string or the probe shows other rules."""

    def __init__(self, path: str, same: bool | None = None) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.path, self._own = path, None
        self.special = [t["content"] for t in file["added_tokens"]]
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        shown = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in plain)}
        taken = {*self.special}
        ranks = {bytes(shown[c] for c in t): i for t, i in file["model"]["vocab"].items() if t not in taken}
        self.fast = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.same = self._plain(_PROBE).tobytes() == self._whole(_PROBE).tobytes() if same is None else same

    def _whole(self, text: str) -> np.ndarray:
        if self._own is None:
            from tokenizers import Tokenizer

            self._own = Tokenizer.from_file(self.path)
        return np.array(self._own.encode(text, add_special_tokens=False).ids, "<u4")

    def _plain(self, text: str) -> np.ndarray:
        parts, at = [], 0
        while at < len(text):
            cut = _BREAK.search(text, at + CHARS_AT_ONCE) if len(text) - at > CHARS_AT_ONCE else None
            to = cut.start() if cut else len(text)
            parts.append(np.array(self.fast.encode_ordinary(text[at:to]), "<u4"))
            at = to
        return np.concatenate(parts) if parts else np.empty(0, "<u4")

    def encode(self, text: str) -> np.ndarray:
        text = text if text.isascii() else text.encode("utf-8", "replace").decode()
        return self._plain(text) if self.same and not any(s in text for s in self.special) else self._whole(text)


def _encoder(path: str, same: bool) -> ByteEncoder:
    if path not in _encoders:
        _encoders[path] = ByteEncoder(path, same)
    return _encoders[path]


class Levels:
    """Open windows by how full they are, and the level array that says where the next piece goes.

    A piece of size s that goes to level h (0: a new window) makes one window fewer at h and one
    more at h + s. Of all levels that are open, that with the least sum of squared counts after it
    is taken (full windows don't count), the fullest of equal ones.
    """

    def __init__(self, limit: int) -> None:
        self.limit = limit
        self.open: list[list[list]] = [[] for _ in range(limit)]
        self.count = 0
        self.leave = np.full(limit, np.inf)  # what the sum changes by when a window leaves the level
        self.leave[0] = 0
        self.enter = np.ones(limit + 1)  # and when one enters it
        self.enter[limit] = 0

    def _counted(self, level: int) -> None:
        n = len(self.open[level])
        self.leave[level] = 1 - 2 * n if n else np.inf
        self.enter[level] = 1 + 2 * n

    def put(self, size: int, piece: tuple) -> list | None:
        """Places a piece; returns its window's pieces if that is full now."""
        last = self.limit - size
        cost = self.leave[: last + 1] + self.enter[size:]
        level = last - int(np.argmin(cost[::-1]))
        window = self.open[level].pop() if level else []
        window.append(piece)
        if level:
            self.count -= 1
            self._counted(level)
        if level + size == self.limit:
            return window
        self.open[level + size].append(window)
        self.count += 1
        self._counted(level + size)
        return None

    def drain(self) -> Iterator[tuple[int, list]]:
        """All open windows, the fullest first; none is open afterwards."""
        for level in range(self.limit - 1, 0, -1):
            for w in self.open[level]:
                yield level, w
            self.open[level] = []
            self._counted(level)
        self.count = 0


def _settled(windows: list[tuple[int, list]], limit: int) -> Iterator[tuple[int, list]]:
    """Fills the gaps of the fullest windows with the pieces of the emptiest, cutting a piece where a gap ends: all are full but the last."""
    front, back, stock = 0, len(windows) - 1, []
    while front < back or (front == back and not stock):
        level, pieces = windows[front]
        front += 1
        while level < limit and (stock or front <= back):
            if not stock:
                stock = windows[back][1][::-1]
                back -= 1
            doc, start, ids = stock.pop()
            room = limit - level
            if len(ids) > room:
                stock.append((doc, start + room, ids[room:]))
            pieces.append((doc, start, ids[:room]))
            level += len(pieces[-1][2])
        yield level, pieces
    if stock:
        yield sum(len(ids) for _, _, ids in stock), stock[::-1]


def _whole_powers(pieces: list) -> Iterator[list]:
    """The ids of some pieces in sequences whose lengths are powers of two, the largest first: none needs padding."""
    left, rest = sum(len(ids) for _, _, ids in pieces), list(pieces)[::-1]
    while left:
        size, out = 1 << (left.bit_length() - 1), []
        left -= size
        while size:
            doc, start, ids = rest.pop()
            if len(ids) > size:
                rest.append((doc, start + size, ids[size:]))
            out.append((doc, start, ids[:size]))
            size -= len(out[-1][2])
        yield out


def pack(docs: DataFrame, vocabulary: str, limit: int = 2048, end_id: int = 1) -> DataFrame:
    """Packs all documents, each followed by end_id, into sequences of at most limit tokens; one row for each piece.

    Each task packs the rows of its partition as they come: of a document longer than a sequence,
    full sequences are cut off its front; what is left is placed whole by the sum of squares (see
    Levels). When the rows end, or more than 2,048 windows are open, the open ones are settled: the
    emptiest are cut up to fill the fullest, so that all are full but one. A task's last window,
    which is not full, is cut into sequences of 2**k tokens, which count as unpadded; so nothing is
    padded if limit is itself a power of two. No row moves between tasks, and a task that runs
    again makes the same sequences.

    Null and empty texts are one piece of the end id; repeated rows are packed each; a null doc_id
    stays null; other columns are ignored; no documents, no rows.
    """
    same = ByteEncoder(vocabulary).same
    end = np.array([end_id], "<u4")
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, levels, rows = _encoder(vocabulary, same).encode, Levels(limit), []
        number = TaskContext.get().partitionId() << 40

        def close(pieces: list) -> None:
            nonlocal number
            at = 0
            for (doc, tokens), start, ids in pieces:
                rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), tokens, number, at))
                at += len(ids)
            number += 1

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)
            rows.clear()
            return out

        def settle(last: bool) -> None:
            for level, pieces in _settled(list(levels.drain()), limit):
                if level == limit:
                    close(pieces)
                elif last:
                    for some in _whole_powers(pieces):
                        close(some)
                else:
                    levels.open[level].append(pieces)
                    levels.count += 1
                    levels._counted(level)

        for b in batches:
            for doc, text in zip(b.column(0), b.column(1), strict=True):
                ids = np.concatenate([encode(text.as_py() or ""), end])
                key, whole = (doc.as_py(), len(ids)), len(ids) // limit * limit
                for a in range(0, whole, limit):
                    close([(key, a, ids[a : a + limit])])
                if whole < len(ids):
                    full = levels.put(len(ids) - whole, (key, whole, ids[whole:].copy()))
                    if full:
                        close(full)
                if levels.count > MOST_OPEN:
                    settle(last=False)
                if len(rows) >= ROWS_TOGETHER:
                    yield batch()
        settle(last=True)
        if rows:
            yield batch()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)
