"""Suffix-array dedup: front-coded runs of sorted suffixes are exchanged and merged by loser trees that know common prefixes."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Bytes of a match; bytes of the gram by which a window's anchor is chosen.
WINDOW, GRAM = 50, 16
SPREAD = WINDOW - GRAM
#: Bytes of text of a run and of what a bucket answers for, about; positions that are hashed at once.
RUN_BYTES, BUCKET_BYTES, BLOCK = 8 << 20, 16 << 20, 1 << 15
#: How many parts a sender's messages have at most in each level of the exchange.
FAN = 64
#: Grams at more anchors than this aren't merged as suffixes but window by window, each window in a bucket of its own hash.
HOT = 1 << 14
#: Bits of a position in a block, of a gram's code, of the codes of its neighbours.
LOW, OWN, SIDE = np.uint64((1 << 16) - 1), 40, 20
ODD = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
SUFFIXES, COVERS, WINDOWS = 0, 1, 2


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * ODD[2]
    return x ^ (x >> np.uint64(32))


def _words(data: np.ndarray, low: int, high: int) -> np.ndarray:
    """The eight bytes from each place in [low, high) as a number; data must hold eight bytes beyond."""
    out = np.empty(high - low, dtype=np.uint64)
    for s in range(min(8, high - low)):
        n = (high - low - s + 7) // 8
        out[s::8] = np.frombuffer(data[low + s : low + s + 8 * n].tobytes(), dtype="<u8")
    return out


def _gram_hash(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return _mix(low * ODD[0] ^ _mix(high * ODD[1]))


def gram_hashes(data: np.ndarray, low: int, high: int) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each place in [low, high)."""
    words = _words(data, low, high + 8)
    return _gram_hash(words[:-8], words[8:])


def _own(hashes: np.ndarray) -> np.ndarray:
    """A gram's code. Anchors have small hashes, so these are mixed once more before their top bits deal out buckets."""
    return _mix(hashes * ODD[1]) >> np.uint64(64 - OWN)


class Shape:
    """How many runs and buckets there are, and by which nodes messages go from the ones to the others.

    Buckets cut the range of grams' codes. With more than `fan` of them messages go through levels of nodes: a node of
    level l takes the l first digits (to the base `fan`) of a bucket from `fan` ** l runs, merges what comes and sends it
    on by the next digit. So a level has about runs * fan messages, in proportion to the input.
    """

    def __init__(self, runs: int, buckets: int, fan: int):
        self.runs, self.buckets, self.fan, self.levels = runs, buckets, fan, 1
        while fan**self.levels < buckets:
            self.levels += 1

    def codes(self, own: np.ndarray, level: int) -> np.ndarray:
        bucket = (own * np.uint64(self.buckets)) >> np.uint64(OWN)
        return (bucket // np.uint64(self.fan ** (self.levels - level))).astype(np.int64)

    def node(self, code: int, group: int, level: int) -> int:
        """The node of `level` with this code that takes in the senders' group `group` of the level before."""
        return code << 32 | (group // self.fan if level < self.levels else 0)

    def spare(self, group: int, code: int | None, level: int) -> int:
        """The code of a node of `level` (below `code`, if given) that any message may take; groups are dealt evenly."""
        n = -(-self.buckets // self.fan ** (self.levels - level))
        if code is None:
            return group % n
        child = code * self.fan + group % self.fan
        return child if child < n else code * self.fan

    def back(self, run: int, bucket: int, hop: int) -> int:
        """Where covers for a run go from a bucket: hop by hop the group of runs gets smaller, that of buckets larger."""
        if hop == self.levels - 1:
            return run
        return (run // self.fan ** (self.levels - 1 - hop)) << 32 | bucket // self.fan ** (hop + 1)


def parts_of(codes: np.ndarray):
    """(code, start, end) of each range of equal codes."""
    if len(codes):
        edges = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
        for a, b in zip(edges, edges[1:]):
            yield int(codes[a]), a, b


class Run:
    """The documents of one run, equal texts once, as one array of bytes, and the anchors of their windows.

    Texts are numbered by (least doc_id, first row); `place` has each row's text (-1: too short, or no doc_id), `ids` each
    text's least doc_id. Of the grams in a window the one with the least hash, the leftmost of equal ones, is its anchor:
    equal windows have equal anchors at equal places, and neighbouring windows mostly share theirs. A record is an anchor
    with consecutive windows that have it: from byte `first` to byte `last` (starts). All of them contain the anchor.
    """

    def __init__(self, ids: list, texts: pa.ChunkedArray | pa.Array):
        raw = [x.as_py() or b"" for x in texts.cast(pa.large_binary())]
        number: dict[bytes, int] = {}
        self.ids, self.place = [], [-1] * len(ids)
        for i in sorted((i for i in range(len(ids)) if ids[i] is not None and len(raw[i]) >= WINDOW), key=lambda i: (ids[i], i)):
            if raw[i] not in number:
                number[raw[i]] = len(self.ids)
                self.ids.append(ids[i])
            self.place[i] = number[raw[i]]
        self.raw, sizes = raw, np.array([len(t) for t in number], dtype=np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.size = int(sizes.sum())
        self.bytes = b"".join(number)

    def records(self) -> dict[str, np.ndarray]:
        """Arrays: anchor, first, last (places in the bytes), text, own (code of the anchor's gram), x (codes of the grams before and after it)."""
        data = np.frombuffer(bytes(GRAM) + self.bytes + bytes(2 * GRAM + WINDOW + 64), dtype=np.uint8)
        crossing = np.zeros(max(self.size, 1), dtype=bool)
        crossing[(self.ends[:, None] - np.arange(1, WINDOW)).ravel()] = True  # windows that end in another document don't count
        found: list[tuple] = []
        for low in range(0, self.size - WINDOW + 1, BLOCK):
            high = min(low + BLOCK, self.size - WINDOW + 1)  # windows that start in [low, high)
            hashes = gram_hashes(data, low, high + SPREAD + 2 * GRAM)  # hashes[j] is that of the gram at low - GRAM + j
            keys = (hashes[GRAM : GRAM + high - low + SPREAD] & ~LOW) | np.arange(high - low + SPREAD, dtype=np.uint64)
            width = 1
            while 2 * width <= SPREAD + 1:
                keys, width = np.minimum(keys[:-width], keys[width:]), 2 * width
            rest = SPREAD + 1 - width
            keys = np.minimum(keys[: len(keys) - rest], keys[rest:])[: high - low] if rest else keys[: high - low]
            at = (keys & LOW).astype(np.int64)
            starts = np.flatnonzero(~crossing[low:high])
            at = at[starts]
            if len(starts):
                new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (np.diff(starts) != 1)]))
                a = at[new]
                side = np.uint64(64 - SIDE)
                x = (hashes[a] >> side) << np.uint64(SIDE) | (hashes[a + 2 * GRAM] >> side)
                found.append((a + low, starts[new] + low, starts[np.concatenate([new[1:], [len(starts)]]) - 1] + low, _own(hashes[a + GRAM]), x))
        if not found:
            found = [(np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2]
        out = dict(zip(("anchor", "first", "last", "own", "x"), (np.concatenate(c) for c in zip(*found))))
        return out | {"text": np.searchsorted(self.ends, out["anchor"], side="right")}


def _distinct(own: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places of the distinct (own, x), sorted, and for each row which of them it is, and how many rows each has."""
    order = np.lexsort((x, own))
    a, b = own[order], x[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    which = np.empty(len(order), dtype=np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which, np.diff(np.concatenate([np.flatnonzero(new), [len(order)]]))


def _keys_blob(own: np.ndarray, x: np.ndarray, n: np.ndarray) -> bytes:
    """Keys as bytes: five each for both codes, one for how often they occur (fourths of a binary logarithm, rounded up)."""
    five = lambda c: np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
    return five(own) + five(x) + np.minimum(np.ceil(4 * np.log2(n)), 255).astype(np.uint8).tobytes()


def _keys_of(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """own, x and numbers of all the blobs' keys, one after the other, and where each blob begins."""
    sizes = [len(b) // 11 for b in blobs]
    five = np.zeros((2, sum(sizes), 8), dtype=np.uint8)
    n = np.empty(sum(sizes), dtype=np.uint8)
    edges = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    for b, size, at in zip(blobs, sizes, edges.tolist()):
        raw = np.frombuffer(b, dtype=np.uint8)
        for k in (0, 1):
            five[k, at : at + size, :5] = raw[5 * size * k : 5 * size * (k + 1)].reshape(-1, 5)
        n[at : at + size] = raw[10 * size :]
    return five[0].view("<u8").ravel(), five[1].view("<u8").ravel(), np.exp2(n / 4.0), edges


def _mask(kind: np.ndarray) -> bytes:
    return zlib.compress(np.packbits(kind > 0).tobytes() + np.packbits(kind > 1).tobytes(), 1)


def _unmasked(blob: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(blob), np.uint8)
    half = len(raw) // 2
    return np.unpackbits(raw[:half], count=n) + np.unpackbits(raw[half:], count=n)


def _table(rows, names, kinds) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=list(names))


KEYS = (("node", "sender", "blob"), (pa.int64(), pa.int64(), pa.binary()))
MASKS = (("node", "code", "blob"), (pa.int64(), pa.int64(), pa.binary()))
SENT = (("node", "kind", "blob"), (pa.int64(), pa.int64(), pa.binary()))
BACK = (("node", "blob"), (pa.int64(), pa.binary()))


def _ddl(fields) -> str:
    return ", ".join(f"{n} {'long' if t == pa.int64() else 'string' if t == pa.string() else 'binary'}" for n, t in zip(*fields))


def _group_of(table: pa.Table) -> tuple[int, int]:
    """The code and the group of the node whose rows these are."""
    node = table.column("node")[0].as_py()
    return node >> 32, node & 0xFFFFFFFF


def _announce(shape: Shape):
    """A run's documents to messages for the first level: the distinct keys of its anchors."""

    def work(table: pa.Table) -> pa.Table:
        run = table.column("node")[0].as_py()
        r = Run(table.column("doc_id").to_pylist(), table.column("text")).records()
        at, _, n = _distinct(r["own"], r["x"])
        own, x = r["own"][at], r["x"][at]
        rows = [(shape.node(c, run, 1), run, _keys_blob(own[a:b], x[a:b], n[a:b])) for c, a, b in parts_of(shape.codes(own, 1))]
        return _table(rows, *KEYS)

    return work


def _combine(shape: Shape, level: int):
    """A node's keys to messages for the next level."""

    def work(table: pa.Table) -> pa.Table:
        _, group = _group_of(table)
        own, x, n, _ = _keys_of(table.column("blob").to_pylist())
        at, which, _ = _distinct(own, x)
        own, x, n = own[at], x[at], np.bincount(which, weights=n, minlength=len(at))
        rows = [(shape.node(c, group, level), table.column("node")[0].as_py(), _keys_blob(own[a:b], x[a:b], n[a:b])) for c, a, b in parts_of(shape.codes(own, level))]
        return _table(rows, *KEYS)

    return work


def _select(hot: int):
    """A bucket's keys to answers for their senders: bits for the keys that have a second place, and for those of grams at more than `hot` places.

    A match of WINDOW bytes takes in the gram before the anchor or the one after it, so both places share one of them.
    """

    def work(table: pa.Table) -> pa.Table:
        own, x, n, edges = _keys_of(table.column("blob").to_pylist())
        kind = (n > 1).astype(np.uint8)
        for side in (x >> np.uint64(SIDE), x & np.uint64((1 << SIDE) - 1)):
            key = own << np.uint64(SIDE) | side
            order = np.argsort(key, kind="stable")
            same = key[order][1:] == key[order][:-1]
            kind[order[1:][same]] = 1
            kind[order[:-1][same]] = 1
        kept = np.flatnonzero(kind)
        grams, which = np.unique(own[kept], return_inverse=True)
        kind[kept] += (np.bincount(which, weights=n[kept], minlength=len(grams)) > hot)[which].astype(np.uint8)
        code, _ = _group_of(table)
        senders = table.column("sender").to_pylist()
        return _table([(s, code, _mask(kind[a:b])) for s, a, b in zip(senders, edges[:-1], edges[1:]) if kind[a:b].any()], *MASKS)

    return work


def _distribute(shape: Shape, level: int):
    """A node's keys and the answers it got to answers for its own senders."""

    def work(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows or not answers.num_rows:
            return _table([], *MASKS)
        code, _ = _group_of(table)
        own, x, _, edges = _keys_of(table.column("blob").to_pylist())
        at, which, _ = _distinct(own, x)
        kind = _kinds(shape, level + 1, own[at], answers)[which]
        senders = table.column("sender").to_pylist()
        return _table([(s, code, _mask(kind[a:b])) for s, a, b in zip(senders, edges[:-1], edges[1:]) if kind[a:b].any()], *MASKS)

    return work


def _kinds(shape: Shape, level: int, own: np.ndarray, answers: pa.Table) -> np.ndarray:
    """What the answers of nodes of `level` say of the sorted keys with the codes `own`: 0 nothing, 1 a second place, 2 hot."""
    of = dict(zip(answers.column("code").to_pylist(), answers.column("blob").to_pylist()))
    kind = np.zeros(len(own), dtype=np.uint8)
    for c, a, b in parts_of(shape.codes(own, level)):
        if c in of:
            kind[a:b] = _unmasked(of[c], b - a)
    return kind


def _common(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix, `at` bytes being known."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[at:n], "big") ^ int.from_bytes(b[at:n], "big")
    return n - (differ.bit_length() + 7) // 8


def front_coded(items: list[tuple[bytes, bytes, list]]) -> bytes:
    """Sorted items (suffix, left, places) as bytes: each suffix without the prefix that it shares with the one before.

    A place is (doc_id, run, text, byte in the text).
    """
    head, text, where, before = bytearray(), [], [], b""
    for suffix, left, places in items:
        shared = _common(before, suffix)
        head += bytes((shared, len(suffix), len(left))) + len(places).to_bytes(4, "little")
        text += (suffix[shared:], left)
        where += places
        before = suffix
    doc, run, number, at = zip(*where)
    planes = np.array(doc, "<i8").tobytes() + b"".join(np.array(c, "<u4").tobytes() for c in (run, number, at))
    return zlib.compress(b"".join((len(items).to_bytes(4, "little"), len(where).to_bytes(4, "little"), bytes(head), planes, *text)), 1)


def decoded(blob: bytes):
    """The items of front_coded(), one after the other: (suffix, left, places, prefix shared with the one before)."""
    blob = zlib.decompress(blob)
    n, m = int.from_bytes(blob[:4], "little"), int.from_bytes(blob[4:8], "little")
    head = np.frombuffer(blob, dtype=np.dtype([("s", "u1"), ("n", "u1"), ("l", "u1"), ("p", "<u4")]), count=n, offset=8)
    at = 8 + 7 * n
    doc = np.frombuffer(blob, "<i8", m, at).tolist()
    places = list(zip(doc, *(np.frombuffer(blob, "<u4", m, at + 8 * m + 4 * m * k).tolist() for k in range(3))))
    at, upto, before = at + 20 * m, 0, b""
    for shared, size, left, count in head.tolist():
        end = at + size - shared
        before = before[:shared] + blob[at:end]
        at = end + left
        yield before, blob[end:at], places[upto : upto + count], shared
        upto += count


class LoserTree:
    """Merges sorted runs of (suffix, left, places, prefix shared with the one before); iterates over them with `shared`
    being the prefix shared with the item put out before, and the run's number.

    Every contender knows its common prefix with the last item put out. Of two contenders the one that shares more is
    the smaller, without a look at the bytes; only if they share equally much are they compared, from there on. The loser
    keeps its common prefix with the winner, which is what it will share with the item put out next.
    """

    def __init__(self, runs: list):
        self.runs = [iter(r) for r in runs]
        self.k = 1
        while self.k < max(1, len(runs)):
            self.k *= 2
        self.now = [next(r, None) for r in self.runs] + [None] * (self.k - len(runs))
        self.shared = [0] * self.k
        self.losers = [-1] * self.k
        self.winner = self._build(1)

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """The winner and the loser of two contenders."""
        x, y = self.now[a], self.now[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if self.shared[a] != self.shared[b]:
            return (a, b) if self.shared[a] > self.shared[b] else (b, a)
        s, t = x[0], y[0]
        at = _common(s, t, self.shared[a])
        first = at == len(s) or (at < len(t) and s[at] < t[at])
        winner, loser = (a, b) if first else (b, a)
        self.shared[loser] = at
        return winner, loser

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        winner, self.losers[node] = self._play(self._build(2 * node), self._build(2 * node + 1))
        return winner

    def __iter__(self):
        now, shared, losers, play = self.now, self.shared, self.losers, self._play
        while (item := now[self.winner]) is not None:
            w = self.winner
            yield item[0], item[1], item[2], shared[w], w
            now[w] = following = next(self.runs[w], None)
            shared[w] = following[3] if following else 0
            node = (w + self.k) // 2
            while node:
                w, losers[node] = play(w, losers[node])
                node //= 2
            self.winner = w


def _pruned(suffix: bytes, left: bytes, places: list, covers: list) -> list:
    """Of a context's places those with the least doc_id; the others go whole, whatever other contexts there are."""
    least = min(p[0] for p in places)
    stay = [p for p in places if p[0] == least]
    if len(stay) < len(places):
        for doc, run, number, at in places:
            if doc > least:
                covers += (run, number, at - len(left), at + len(suffix))
    return stay


def _covers_blob(covers: list | np.ndarray) -> bytes:
    """Covers, flat (run, text, start, end), as bytes."""
    rows = np.asarray(covers, dtype="<u4").reshape(-1, 4)
    return zlib.compress(np.ascontiguousarray(rows.T).tobytes(), 1)


def _covers_of(blobs) -> np.ndarray:
    parts = [np.frombuffer(zlib.decompress(b), "<u4").reshape(4, -1).T for b in blobs]
    return np.concatenate(parts) if parts else np.empty((0, 4), "<u4")


def _windows_blob(text: np.ndarray, doc: np.ndarray, where: np.ndarray) -> bytes:
    return zlib.compress(len(doc).to_bytes(4, "little") + text.tobytes() + doc.astype("<i8").tobytes() + where.astype("<u4").tobytes(), 1)


def _windows_of(blobs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of hot grams: their bytes, doc_ids and (run, text, start)."""
    text, doc, where = [np.empty(0, f"V{WINDOW}")], [np.empty(0, "<i8")], [np.empty((0, 3), "<u4")]
    for b in map(zlib.decompress, blobs):
        n = int.from_bytes(b[:4], "little")
        text.append(np.frombuffer(b, f"V{WINDOW}", n, 4))
        doc.append(np.frombuffer(b, "<i8", n, 4 + WINDOW * n))
        where.append(np.frombuffer(b, "<u4", 3 * n, 4 + (WINDOW + 8) * n).reshape(-1, 3))
    return np.concatenate(text), np.concatenate(doc), np.concatenate(where)


def _least_windows(text: np.ndarray, doc: np.ndarray, where: np.ndarray, covers: list):
    """Windows without those of which an earlier document has an equal one; these go."""
    _, which = np.unique(text, return_inverse=True)
    least = np.full(which.max(initial=-1) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, which, doc)
    late = doc > least[which]
    gone = where[late].astype(np.int64)
    covers += np.column_stack([gone, gone[:, 2] + WINDOW]).ravel().tolist()
    return text[~late], doc[~late], where[~late]


def _window_messages(shape: Shape, level: int, group: int, text: np.ndarray, doc: np.ndarray, where: np.ndarray):
    """Rows of WINDOWS for the nodes of `level`, dealt by a hash of all bytes of a window."""
    if len(text):
        padded = np.zeros((len(text), 56), dtype=np.uint8)
        padded[:, :WINDOW] = np.frombuffer(text.tobytes(), np.uint8).reshape(-1, WINDOW)
        h = np.zeros(len(text), dtype=np.uint64)
        for word in padded.view("<u8").T:
            h = _mix((h ^ word) * ODD[0])
        codes = shape.codes(_own(h), level)
        order = np.argsort(codes, kind="stable")
        for c, a, b in parts_of(codes[order]):
            yield shape.node(c, group, level), WINDOWS, _windows_blob(text[order[a:b]], doc[order[a:b]], where[order[a:b]])


def _suffixes(shape: Shape):
    """A run's documents and the answers it got to messages for the first level: sorted suffixes, equal contexts once, front-coded."""

    def work(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows or not answers.num_rows:
            return _table([], *SENT)
        number = table.column("node")[0].as_py()
        run = Run(table.column("doc_id").to_pylist(), table.column("text"))
        run.raw = None
        r = run.records()
        at, which, _ = _distinct(r["own"], r["x"])
        kind = _kinds(shape, 1, r["own"][at], answers)[which]
        ids, starts, data = run.ids, run.starts, run.bytes
        rows, covers = [], []
        chosen = np.flatnonzero(kind == 1)
        codes = shape.codes(r["own"][chosen], 1)
        order = np.argsort(codes, kind="stable")
        for code, a, b in parts_of(codes[order]):
            part = chosen[order[a:b]]
            items: dict[tuple[bytes, bytes], list] = defaultdict(list)
            text = r["text"][part]
            for anchor, low, high, t, start in zip(r["anchor"][part].tolist(), r["first"][part].tolist(), r["last"][part].tolist(), text.tolist(), starts[text].tolist()):
                items[data[anchor : high + WINDOW], data[low:anchor]].append((ids[t], number, t, anchor - start))
            blob = front_coded([(s, left, _pruned(s, left, places, covers) if len(places) > 1 else places) for (s, left), places in sorted(items.items())])
            rows.append((shape.node(code, number, 1), SUFFIXES, blob))
        hot = np.flatnonzero(kind == 2)
        if len(hot):
            many = r["last"][hot] - r["first"][hot] + 1
            begin = np.repeat(r["first"][hot] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
            text = np.repeat(r["text"][hot], many)
            raw = np.frombuffer(data, np.uint8)
            windows = np.concatenate([np.ascontiguousarray(raw[begin[i : i + BLOCK, None] + np.arange(WINDOW)]).view(f"V{WINDOW}").ravel() for i in range(0, len(begin), BLOCK)])
            where = np.column_stack([np.full(len(text), number), text, begin - starts[text]])
            rows += _window_messages(shape, 1, number, *_least_windows(windows, np.array(ids)[text], where, covers))
        if covers:
            rows.append((shape.node(shape.spare(number, None, 1), number, 1), COVERS, _covers_blob(covers)))
        return _table(rows, *SENT)

    return work


def _by_kind(table: pa.Table) -> dict[int, list[bytes]]:
    out: dict[int, list[bytes]] = defaultdict(list)
    for kind, blob in zip(table.column("kind").to_pylist(), table.column("blob").to_pylist()):
        out[kind].append(blob)
    return out


def _resend(shape: Shape, level: int):
    """A node's runs, merged into one with equal contexts once, to messages for the next level."""

    def work(table: pa.Table) -> pa.Table:
        code, group = _group_of(table)
        of, rows, covers = _by_kind(table), [], []
        merged: list[tuple[bytes, bytes, list]] = []
        same: dict[bytes, list] = {}
        suffix = None

        def settle():
            merged.extend((suffix, left, _pruned(suffix, left, places, covers)) for left, places in sorted(same.items()))

        for s, left, places, shared, _ in LoserTree([decoded(b) for b in of[SUFFIXES]]):
            if suffix is not None and not (shared == len(s) == len(suffix)):
                settle()
                same = {}
            suffix = s
            same[left] = same.get(left, []) + places
        if suffix is not None:
            settle()
            grams = np.frombuffer(b"".join(m[0][:GRAM] for m in merged), "<u8").reshape(-1, 2)
            codes = shape.codes(_own(_gram_hash(grams[:, 0], grams[:, 1])), level)
            order = np.argsort(codes, kind="stable")
            for c, a, b in parts_of(codes[order]):
                rows.append((shape.node(c, group, level), SUFFIXES, front_coded([merged[i] for i in order[a:b]])))
        rows += _window_messages(shape, level, group, *_least_windows(*_windows_of(of[WINDOWS]), covers))
        old = _covers_of(of[COVERS])
        if covers or len(old):
            every = np.concatenate([old, np.asarray(covers, "<u4").reshape(-1, 4)])
            rows.append((shape.node(shape.spare(group, code, level), group, level), COVERS, _covers_blob(every)))
        return _table(rows, *SENT)

    return work


def _covers(group: list[tuple], covers: list) -> None:
    """Of items (suffix, left, places, shared) with one gram at their anchors, all places of an item in one document: what goes.

    A window of an item goes, in documents other than the first that has it. Its windows all contain the anchor, so
    the first and the last of them that go span all bytes that go.
    """
    firsts = [places[0][0] for _, _, places, _ in group]
    ranges: list[tuple[int, int] | None] = [None] * len(group)
    if len(group) == 2:
        (s, left, _, _), (t, other, _, shared) = group
        n = min(len(left), len(other))
        differ = int.from_bytes(left[len(left) - n :], "little") ^ int.from_bytes(other[len(other) - n :], "little")
        back = n - (differ.bit_length() + 7) // 8
        low = max(WINDOW - shared, WINDOW - len(s), WINDOW - len(t))
        if low <= back and firsts[0] != firsts[1]:
            ranges[int(firsts[1] > firsts[0])] = (low, back)
    else:
        least: dict[tuple[int, bytes], int] = {}
        for (s, left, _, _), first in zip(group, firsts):
            for back in range(WINDOW - len(s), len(left) + 1):
                key = (back, left[len(left) - back :] + s[: WINDOW - back])
                if least.get(key, first) >= first:
                    least[key] = first
        for i, ((s, left, _, _), first) in enumerate(zip(group, firsts)):
            gone = [back for back in range(WINDOW - len(s), len(left) + 1) if least[back, left[len(left) - back :] + s[: WINDOW - back]] < first]
            if gone:
                ranges[i] = (gone[0], gone[-1])
    for (_, _, places, _), span in zip(group, ranges):
        if span:
            for _, run, number, at in places:
                covers += (run, number, at - span[1], at - span[0] + WINDOW)


def _back(shape: Shape, hop: int, bucket: int, covers: np.ndarray) -> pa.Table:
    """Covers to rows for the next hop."""
    to = covers[:, 0].astype(np.int64) // shape.fan ** (shape.levels - 1 - hop)
    order = np.argsort(to, kind="stable")
    rows = [(shape.back(int(covers[order[a], 0]), bucket, hop), _covers_blob(covers[order[a:b]])) for _, a, b in parts_of(to[order])]
    return _table(rows, *BACK)


def _merge(shape: Shape):
    """A bucket's runs, merged, to what goes."""

    def work(table: pa.Table) -> pa.Table:
        of, covers = _by_kind(table), []
        group: list[tuple] = []
        for s, left, places, shared, _ in LoserTree([decoded(b) for b in of[SUFFIXES]]):
            if group and shared < GRAM:
                if len(group) > 1:
                    _covers(group, covers)
                group = []
            group.append((s, left, places, shared))
        if len(group) > 1:
            _covers(group, covers)
        _least_windows(*_windows_of(of[WINDOWS]), covers)
        every = np.concatenate([_covers_of(of[COVERS]), np.asarray(covers, "<u4").reshape(-1, 4)])
        return _back(shape, 0, _group_of(table)[0], every)

    return work


def _forward(shape: Shape, hop: int):
    """Covers of a group of runs to smaller groups."""

    def work(table: pa.Table) -> pa.Table:
        _, group = _group_of(table)
        return _back(shape, hop, group * shape.fan**hop, _covers_of(table.column("blob").to_pylist()))

    return work


OUT = (("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"), (pa.int64(),) * 4 + (pa.string(), pa.binary()))


def _cut(with_kept: bool):
    """A run's documents and covers to the result rows."""

    def work(table: pa.Table, covers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _table([], *OUT)
        ids = table.column("doc_id").to_pylist()
        run = Run(ids, table.column("text"))
        rows_of = _covers_of(covers.column("blob").to_pylist() if covers.num_rows else [])
        rows_of = rows_of[np.lexsort((rows_of[:, 2], rows_of[:, 1]))].astype(np.int64)
        spans: dict[int, list[tuple[int, int]]] = {}
        for text, a, b in parts_of(rows_of[:, 1]):
            starts, ends = rows_of[a:b, 2], np.maximum.accumulate(rows_of[a:b, 3])
            new = np.flatnonzero(np.concatenate([[True], starts[1:] > ends[:-1]]))
            spans[text] = list(zip(starts[new].tolist(), ends[np.concatenate([new[1:], [b - a]]) - 1].tolist()))
        rows = []
        for doc, raw, place in zip(ids, run.raw, run.place):
            own = () if place < 0 else [(0, len(raw))] if run.ids[place] < doc else spans.get(place, ())
            parts, at = [], 0
            for start, end in own:
                parts.append(raw[at:start])
                at = end
            parts.append(raw[at:])
            kept = b"".join(parts)
            rows.append((doc, len(raw), len(raw) - len(kept), len(own), hashlib.sha256(kept).hexdigest(), kept if with_kept else None))
        return _table(rows, *OUT)

    return work


def suffix_dedup(docs: DataFrame, *, run_bytes: int = RUN_BYTES, bucket_bytes: int = BUCKET_BYTES, fan: int = FAN, hot: int = HOT, with_kept: bool = False) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes that stay, if asked for).

    A byte goes if a string of WINDOW bytes covers it that also starts in a document with a smaller doc_id.

    Rows are dealt to runs. 1. Each run announces keys of its anchors (one in some 18 places, see Run) to the buckets of
    their grams, a key once however often the run has it. 2. Each bucket answers which keys have a second place. 3. Each
    run sorts the suffixes at those anchors and sends them front-coded. 4. Each bucket merges its runs with a loser tree
    on known common prefixes; neighbours in that order share their grams, and of each group the windows that start in an
    earlier document are settled. 5. Each run cuts its texts. Messages pass the levels of Shape, so their number is in
    proportion to the input; texts are shuffled once, and the three steps that read them share that exchange.

    Of a context that many documents share each run sends the place with the least doc_id only (the others go in any
    case), and so does each node. A gram at more than `hot` anchors is settled window by window, by hashes of whole windows.

    A null text is empty; texts of under WINDOW bytes stay. Rows with one doc_id, equal or different, are no smaller than
    each other; each is cut by itself. A row with a null doc_id stays whole and cuts nothing. Ties can't arise. An empty
    table gives no rows. Other columns aren't read. A run holds whole documents, so memory follows the longest one.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shape = Shape(max(1, -(-int(total) // run_bytes)), max(1, -(-int(total) // bucket_bytes)), fan)
    rows = docs.select(F.pmod(F.xxhash64(F.lit("run"), "doc_id", "text"), F.lit(shape.runs)).alias("node"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    by_run = rows.groupBy("node")
    inboxes = [by_run.applyInArrow(_announce(shape), _ddl(KEYS)).groupBy("node")]
    for level in range(2, shape.levels + 1):
        inboxes.append(inboxes[-1].applyInArrow(_combine(shape, level), _ddl(KEYS)).groupBy("node"))
    answers = inboxes[-1].applyInArrow(_select(hot), _ddl(MASKS)).groupBy("node")
    for level in range(shape.levels - 1, 0, -1):
        answers = inboxes[level - 1].cogroup(answers).applyInArrow(_distribute(shape, level), _ddl(MASKS)).groupBy("node")
    sent = by_run.cogroup(answers).applyInArrow(_suffixes(shape), _ddl(SENT)).groupBy("node")
    for level in range(2, shape.levels + 1):
        sent = sent.applyInArrow(_resend(shape, level), _ddl(SENT)).groupBy("node")
    covers = sent.applyInArrow(_merge(shape), _ddl(BACK)).groupBy("node")
    for hop in range(1, shape.levels):
        covers = covers.applyInArrow(_forward(shape, hop), _ddl(BACK)).groupBy("node")
    found = by_run.cogroup(covers).applyInArrow(_cut(with_kept), _ddl(OUT))
    return found if with_kept else found.drop("kept")
