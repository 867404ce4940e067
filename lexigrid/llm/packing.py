"""Hierarchical multi-length packing: tiers of context sizes, gaps of long windows filled from shorter tiers, balanced steps."""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_right, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import slices

#: Tokens of the longest window; documents and rests wait in a pool of POOL pieces at most before half of them are packed.
WINDOW, SMALLEST, POOL = 1024, 64, 4096
#: In a window of WINDOW tokens, gaps shorter than this are padded rather than filled by cutting a document.
LEAST_CUT = 8
#: Window tokens of a step group: as many sequences of one tier as hold so many tokens.
STEP = 8 * WINDOW
END_ID = 0
#: Characters for which both tokenizer libraries are known to split alike; texts with any other go through `tokenizers`.
USUAL = re.compile("[\t\n\r\x20-\x7e¡-¬®-ſ‐-‧€]*")


def default_tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=4)
def _tokenizers(path: str, ranks: str | None):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path)
    fast = None
    if ranks:
        import tiktoken
        from public_tokenizers import PATTERN

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        fast = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return exact, fast, [t.content for t in exact.get_added_tokens_decoder().values()]


def token_ids(text: str | None, path: str, ranks: str | None = None) -> np.ndarray:
    """The ids that `tokenizers` gives with the file `path`, special tokens in the text included, then END_ID.

    `ranks` may name the same vocabulary as a rank file: then texts of USUAL characters without special tokens take
    the faster library, which gives the same ids for them (a test compares the two).
    """
    exact, fast, special = _tokenizers(path, ranks)
    text = text or ""
    if fast is not None and USUAL.fullmatch(text) and not any(s in text for s in special):
        ids = fast.encode_ordinary(text)
    else:
        ids = exact.encode(text, add_special_tokens=False).ids
    return np.array([*ids, END_ID], dtype="<u4")


class Packer:
    """Packs pieces of one partition; a piece is (length, serial, document, start), document being (doc_id, ids, number of
    its first id, ids of the whole document): in the pool a piece holds its own ids only, whatever its document holds.

    Full windows of a long document are sequences at once. Its rest, or a short document, is routed by its length to
    the tier of the next power of two (SMALLEST to WINDOW). Longest first, a piece opens a window of its tier; the gap
    takes the longest pieces that fit, all from its own or shorter tiers; what then is left of the gap is cut off the
    longest piece in the pool. Only a window for which the pool has run out ends short: it is cut into powers of two.
    """

    def __init__(self, partition: int, window: int = WINDOW):
        self.base, self.window, self.pool, self.rows, self.serial, self.sequences = partition << 40, window, [], [], 0, 0
        self.steps: dict[int, int] = {}

    def add(self, doc_id, ids: np.ndarray) -> None:
        document, n, start = (doc_id, ids, 0, len(ids)), len(ids), 0
        while n - start >= self.window:
            self.emit([(self.window, document, start)], self.window)
            start += self.window
        if n > start:
            self.put(n - start, document, start)
        if len(self.pool) >= POOL:
            self.pack(POOL // 2)

    def put(self, length: int, document, start: int) -> None:
        self.serial += 1
        doc_id, ids, first, total = document
        if len(ids) > 2 * length:
            document = (doc_id, ids[start - first : start - first + length].copy(), start, total)
        insort(self.pool, (length, self.serial, document, start), key=lambda p: p[:2])

    def fitting(self, gap: int) -> int:
        """The place of the longest piece in the pool that fits the gap, or -1."""
        return bisect_right(self.pool, gap, key=lambda p: p[0]) - 1

    def pack(self, leave: int) -> None:
        """Pack until `leave` pieces are in the pool."""
        while len(self.pool) > leave:
            length, _, document, start = self.pool.pop()
            size = SMALLEST
            while size < length:
                size *= 2
            size = min(size, self.window)
            members, gap = [(length, document, start)], size - length
            while gap and (at := self.fitting(gap)) >= 0:
                length, _, document, start = self.pool.pop(at)
                members.append((length, document, start))
                gap -= length
            if self.pool and gap and (gap >= LEAST_CUT or size < self.window):
                length, _, document, start = self.pool.pop()
                members.append((gap, document, start))
                self.put(length - gap, document, start + gap)
                gap = 0
            if not gap or self.pool:
                self.emit(members, size if not gap else self.window)
            else:
                self.in_powers(members)

    def in_powers(self, members: list[tuple]) -> None:
        """Sequences of falling powers of two that hold the members' ids; nothing is padded."""
        total = sum(m[0] for m in members)
        while total:
            size = 1 << (total.bit_length() - 1)
            own, left = [], size
            while left:
                length, document, start = members.pop(0)
                if length > left:
                    members.insert(0, (length - left, document, start + left))
                    length = left
                own.append((length, document, start))
                left -= length
            self.emit(own, size)
            total -= size

    def emit(self, members: list[tuple], tier: int) -> None:
        """`tier` is the window that the sequence takes in training: its length, or WINDOW if it is padded."""
        sequence, offset = self.base | self.sequences, 0
        self.sequences += 1
        nth = self.steps.get(tier, 0)
        self.steps[tier] = nth + 1
        step = self.base | (tier.bit_length() << 32) | (nth * tier // STEP)
        for length, (doc_id, ids, first, total), start in members:
            crc = zlib.crc32(ids[start - first : start - first + length].tobytes())
            self.rows.append((doc_id, start, length, crc, total, sequence, offset, tier, step))
            offset += length

    def taken(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


FIELDS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def _pack(path: str, ranks: str | None, window: int):
    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=list(FIELDS))

    def run(batches):
        context = TaskContext.get()
        packer = Packer(context.partitionId() if context else 0, window)
        for batch in batches:
            for part in slices(batch, "text"):
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    packer.add(doc_id, token_ids(text, path, ranks))
                if rows := packer.taken():
                    yield batch_of(rows)
        packer.pack(0)
        if rows := packer.taken():
            yield batch_of(rows)

    return run


def pack(docs: DataFrame, *, tokenizer: tuple[str, str | None] | None = None, window: int = WINDOW) -> DataFrame:
    """One row for each piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group.

    Every partition of `docs` is packed on its own, without a shuffle; partition and number make the sequence_id, so a
    task that is run again after a loss gives the same rows. Pieces of a sequence follow each other from offset 0.
    Sequences of one tier make step groups of equal window tokens.

    A null text counts as empty: its one id is END_ID. Repeated rows are packed each for itself (their pieces can't be
    told apart by doc_id); a null doc_id stays null; ties in length go by arrival. A very long text is tokenized whole
    and cut into windows. An empty table gives no rows. Other columns aren't read.
    """
    path, ranks = tokenizer or default_tokenizer()
    kinds = ", ".join(f"{f} long" for f in FIELDS)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(_pack(path, ranks, window), kinds)
