"""Packing token pieces into windows by best-fit decreasing.

One pass over the texts makes the token ids, cuts every document into full
windows and a remainder, and keeps a small row per piece (length and CRC of
its ids).  Pieces are dealt evenly into bins of about ``BIN_PIECES``; in each
bin the pieces go, longest first, into the open window with the least room
that still holds them.  A segment tree over the remaining capacities 0..window
finds that window in log2(window) steps.  Full windows fill a sequence each.
Bins are independent, so the work grows with the cluster; what a bin wastes is
at most its last few open windows.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import batches_of, table
from rivulet.session import materialize

WINDOW = 2048
END_ID = 1
BIN_PIECES = 60000
# words whose ids a task remembers, and bytes of text looked up together
CACHE_WORDS = 800_000
RUN_BYTES = 2 << 20
# unknown words tokenised in one call; the tokenizer slows down on longer texts
JOINED = 128
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


class WordIds(dict):
    """Ids of a white-space-separated word as little-endian 32-bit integers.

    The tokenizer drops white space and never joins across it, so a text's ids
    are those of its words, and words repeat.  Words are cut at ASCII white
    space only; what else counts as white space is left to the tokenizer.  It
    lower-cases, so that is done before, which leaves fewer different words.
    (A text that may hold a special token, which is matched as it stands, is
    not touched.)
    """

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)

    def learn(self, words: set[bytes]) -> None:
        """Make sure of all ``words``: those not known go through the tokenizer as one text."""
        new = list(words.difference(self))
        if len(self) + len(new) > CACHE_WORDS:
            self.clear()
            new = list(words)
        for k in range(0, len(new), JOINED):
            self._learn(new[k:k + JOINED])

    def _learn(self, new: list[bytes]) -> None:
        texts = [w.decode("utf-8", "replace") for w in new]
        found = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        # a token belongs to the word that its first character lies in
        at = np.array([o[0] for o in found.offsets], dtype=np.int64)
        ends = 4 * np.cumsum(np.bincount(np.searchsorted(begins, at, side="right") - 1, minlength=len(new)))
        ids, start = np.array(found.ids, dtype="<u4").tobytes(), 0
        for word, end in zip(new, ends.tolist()):
            self[word] = ids[start:end]
            start = end

    def texts(self, raws: list[bytes]):
        words = [(r if b"<|" in r else r.lower()).split() for r in raws]
        self.learn(set().union(*words))
        for w in words:
            yield b"".join(map(self.__getitem__, w))


def _cut(window: int, path: str):
    end = struct.pack("<I", END_ID)

    def run(batches):
        ids = WordIds(path)
        for batch in batches:
            out: list[tuple] = []
            raws = [(t.as_py() or "").encode("utf-8", "replace") for t in batch.column(1)]
            for doc_ids, part in batches_of([batch.column(0).to_pylist(), raws], RUN_BYTES):
                for doc_id, data in zip(doc_ids, ids.texts(part)):
                    data += end
                    n = len(data) // 4
                    for start in range(0, n, window):
                        piece = data[4 * start:4 * (start + window)]
                        out.append((doc_id, start, len(piece) // 4, zlib.crc32(piece), n))
            cols = list(zip(*out)) or [[]] * 5
            yield pa.record_batch([pa.array(c, pa.int64()) for c in cols],
                                  names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
    return run


class OpenWindows:
    """Open windows by remaining capacity, under a segment tree of 'any window here'."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, room: int, win: int) -> None:
        self.at[room].append(win)
        node = room + self.leaves
        while node:
            self.count[node] += 1
            node >>= 1

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Take out the window with the least room that is at least ``need``."""
        count, node = self.count, need + self.leaves
        if not count[node]:
            # up to the first ancestor with something to the right, then down its left edge
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node *= 2
                if not count[node]:
                    node += 1
        room = node - self.leaves
        win = self.at[room].pop()
        while node:
            count[node] -= 1
            node >>= 1
        return room, win


def best_fit_decreasing(lengths, window: int) -> tuple[list[int], list[int]]:
    """Window number and offset for each length; ``lengths`` come longest first, none above ``window``."""
    open_windows, wins, offsets, made = OpenWindows(window), [], [], 0
    for n in lengths:
        found = open_windows.tightest(n) if n < window else None
        if found is None:
            room, win, made = window, made, made + 1
        else:
            room, win = found
        wins.append(win)
        offsets.append(window - room)
        if room > n:
            open_windows.add(room - n, win)
    return wins, offsets


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
         path: str | None = None, bin_pieces: int = BIN_PIECES) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is its end id alone.  Rows that repeat an id are
    packed like any others; a null id stays null.  A text of any length is cut
    into as many windows as it fills.  Remainders of equal length go in the
    order of their rows; any order wastes the same.  Other columns of ``docs``
    are not read.  An empty table gives no piece.
    """
    spark = docs.sparkSession
    cut = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")) \
        .mapInArrow(_cut(window, path or tokenizer_path()), _PIECES)
    pieces = materialize(cut.withColumn("_row", F.monotonically_increasing_id()), "pack-pieces")
    bins = max(1, -(-pieces.count() // bin_pieces))

    def fill(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("_row", "ascending")])
        wins, offsets = best_fit_decreasing(group["length"].to_pylist(), window)
        first = (group["_bin"][0].as_py() << 32) if len(group) else 0
        return group.drop_columns(["_row", "_bin"]).append_column(
            "sequence_id", pa.array([first + w for w in wins], pa.int64())).append_column(
            "offset", pa.array(offsets, pa.int64()))

    # rows were numbered when written, so a lost task deals them the same way again
    dealt = pieces.withColumn("_bin", F.pmod(F.xxhash64("_row"), F.lit(bins)))
    out = dealt.groupBy("_bin").applyInArrow(fill, _PIECES + ", sequence_id long, offset long")
    return out.withColumnRenamed("doc_id", id_col) if id_col != "doc_id" else out


def op3_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
