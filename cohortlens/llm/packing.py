"""Packing token sequences into windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import gc
import heapq
import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortlens.llm.common import hold_memory, tokenizer_bytes

#: Words, and pieces of words, whose ids a worker remembers in each of two generations.
_REMEMBERED = 300_000
#: Pieces that go to the library at once, which bounds the memory of its results.
_AT_ONCE = 8192
#: Texts that are encoded together.
_SLICE = 1000
#: A separate token of one id between words that are encoded together.
_MARK = "\x01"
#: What ends the last token of every pre-token.
_WORD_END = "</w>"
#: Pre-tokens of plain words: runs of ASCII and Latin-1 letters, single digits, runs of ASCII marks.
_LETTERS = rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+"
_MARKS = rb"[!-&(-/:-@\[-`{-~]+"
_SIMPLE = re.compile(rb"(%s)(%s)?" % (_LETTERS, _MARKS))
_PLAIN = re.compile(rb"(?:%s|[0-9]|%s)+" % (_LETTERS, _MARKS))
_PIECES = re.compile(rb"%s|[0-9]|%s" % (_LETTERS, _MARKS))


class _Remembered:
    """Ids of what was seen lately: two generations, so what recurs stays and the rest goes."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.young: dict[bytes, bytes] = {}
        self._old: dict[bytes, bytes] = {}

    def unknown(self, keys: set[bytes]) -> list[bytes]:
        """Keys that neither generation has; those of the old one come over to the young one."""
        known = keys & self._old.keys()
        self.young.update(zip(known, map(self._old.__getitem__, known)))
        return list(keys - known)

    def grow_old(self) -> None:
        if len(self.young) > self.most:
            self._old, self.young = self.young, {}


class WordEncoder:
    """Ids of texts for a tokenizer that drops white space and never joins across it.

    The ids of a text are those of its words in order, kept as little-endian bytes. White space
    here is the ASCII kind, so words may still hold other spaces, which the library treats as in the
    whole text. ASCII capitals are lowered first, as the library does itself, unless the text may
    hold a special string. A word of ASCII and Latin-1 letters, digits and marks (no apostrophe,
    which starts endings of its own) falls into the library's pre-tokens by plain rules; each of
    them goes to the library once per slice of texts at most, and ends where a token with the
    end-of-word sign does. Other words go to the library whole.
    """

    def __init__(self, definition: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self._library = Tokenizer.from_str(definition.decode("utf-8"))
        self._mark = self._library.encode(_MARK, add_special_tokens=False).ids
        self._specials = [t.content.encode() for t in self._library.get_added_tokens_decoder().values()]
        names = self._library.get_vocab()
        self._ends = np.zeros(max(names.values()) + 1, bool)
        self._ends[[i for t, i in names.items() if t.endswith(_WORD_END)]] = True
        self._words = _Remembered(_REMEMBERED)
        self._pieces = _Remembered(_REMEMBERED)

    def _split_ids(self, group: list[bytes], ids: np.ndarray, ends: np.ndarray, gap: int) -> dict[bytes, bytes]:
        data = ids.tobytes()
        starts = [0, *(4 * (ends[:-1] + 1)).tolist()]
        return {w: data[s:e] for w, s, e in zip(group, starts, (4 * (ends + 1 - gap)).tolist())}

    def _encode_pieces(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Ids of single pre-tokens, many in one text."""
        groups = [pieces[i : i + 256] for i in range(0, len(pieces), 256)]
        texts = [b" ".join(g).decode("utf-8") for g in groups]
        found: dict[bytes, bytes] = {}
        for group, encoding in zip(groups, self._library.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(encoding.ids, "<u4")
            ends = np.flatnonzero(self._ends[ids])
            if len(ends) == len(group) and ends[-1] == len(ids) - 1:
                found.update(self._split_ids(group, ids, ends, 0))
            else:
                found.update((w, self._alone(w)) for w in group)
        return found

    def _encode_whole(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words of any kind, many in one text with marks between them."""
        plain = [w for w in words if _MARK.encode() not in w]
        joined = f" {_MARK} "
        groups = [plain[i : i + 256] for i in range(0, len(plain), 256)]
        texts = [joined.join(w.decode("utf-8", "surrogatepass") for w in g) for g in groups]
        found: dict[bytes, bytes] = {}
        for group, encoding in zip(groups, self._library.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(encoding.ids, "<u4")
            ends = np.append(np.flatnonzero(ids == self._mark[0]), len(ids))
            if len(self._mark) != 1 or len(ends) != len(group):
                found.update((w, self._alone(w)) for w in group)
            else:
                found.update(self._split_ids(group, ids, ends, 1))
        found.update((w, self._alone(w)) for w in words if _MARK.encode() in w)
        return found

    def _alone(self, word: bytes) -> bytes:
        return np.array(self._library.encode(word.decode("utf-8", "surrogatepass"), add_special_tokens=False).ids, "<u4").tobytes()

    def _encode_words(self, words: list[bytes]) -> dict[bytes, bytes]:
        simple: list[tuple[bytes, bytes | None, bytes]] = []
        mixed: dict[bytes, list[bytes]] = {}
        other = []
        together = b" ".join(words)
        special = any(s in together for s in self._specials)
        match = _SIMPLE.fullmatch
        for w in words:
            m = match(w)
            if special and any(s in w for s in self._specials):
                other.append(w)
            elif m is not None:
                simple.append((m[1], m[2], w))
            elif _PLAIN.fullmatch(w):
                mixed[w] = _PIECES.findall(w)
            else:
                other.append(w)
        pieces = self._pieces
        distinct = {x[0] for x in simple}.union((x[1] for x in simple if x[1]), *mixed.values())
        unknown = pieces.unknown(distinct.difference(pieces.young))
        for i in range(0, len(unknown), _AT_ONCE):
            pieces.young.update(self._encode_pieces(unknown[i : i + _AT_ONCE]))
        get = pieces.young.__getitem__
        found = {w: get(letters) + get(marks) if marks else get(letters) for letters, marks, w in simple}
        found.update((w, b"".join(map(get, parts))) for w, parts in mixed.items())
        pieces.grow_old()
        for i in range(0, len(other), _AT_ONCE):
            found.update(self._encode_whole(other[i : i + _AT_ONCE]))
        return found

    def _lowered(self, text: str | bytes) -> list[bytes]:
        raw = text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")
        lowered = raw.lower()
        # A special string is one only as it is written.
        return (raw if any(s in lowered for s in self._specials) else lowered).split()

    def __call__(self, texts: list[str | bytes]) -> list[np.ndarray]:
        # Nothing here refers to itself; collecting would only walk over all that is remembered.
        collecting = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode(self, texts: list[str | bytes]) -> list[np.ndarray]:
        split = [self._lowered(t) for t in texts]
        words = self._words
        missing = set().union(*split).difference(words.young)
        if missing:
            words.young.update(self._encode_words(words.unknown(missing)))
        get = words.young.__getitem__
        result = [np.frombuffer(b"".join(map(get, ws)), "<u4") for ws in split]
        words.grow_old()
        return result


@cache
def word_encoder(definition: bytes) -> WordEncoder:
    return WordEncoder(definition)


def differencing(lengths: np.ndarray, windows: int) -> np.ndarray:
    """Window of each piece so that window sums are nearly equal.

    Every piece starts as a partial partition with one filled place. The two partial partitions
    with the largest spread are merged, the fullest place of one with the emptiest of the other,
    until one is left; then places are followed back to the pieces.
    """
    n = len(lengths)
    if windows == 1 or n == 0:
        return np.zeros(n, np.int64)
    merges: list[tuple[int, int, np.ndarray]] = []
    heap, sums = [], {}
    for i, length in enumerate(lengths.tolist()):
        heap.append((-length, i))
        first = np.zeros(windows, np.int64)
        first[0] = length
        sums[i] = first
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        both = sums.pop(a) + sums.pop(b)[::-1]
        order = np.argsort(-both, kind="stable")
        both = both[order]
        both -= both[-1]
        node = n + len(merges)
        merges.append((a, b, order))
        sums[node] = both
        heapq.heappush(heap, (-int(both[0]), node))
    window_of = np.zeros(n, np.int64)
    places: dict[int, np.ndarray] = {heap[0][1]: np.arange(windows)}
    for node in range(n + len(merges) - 1, n - 1, -1):
        a, b, order = merges[node - n]
        back = np.empty(windows, np.int64)
        back[order] = places.pop(node)
        places[a], places[b] = back, back[::-1]
    for i in range(n):
        window_of[i] = places[i][0]
    return window_of


def _cut(lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut each length into equal parts of at most ``most``: owner, start and length of each part."""
    parts = -(-lengths // most)
    owner = np.repeat(np.arange(len(lengths)), parts)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    low = k * lengths[owner] // parts[owner]
    high = (k + 1) * lengths[owner] // parts[owner]
    return owner, low, high - low


def near_equal_windows(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Owner, start, length and window of pieces, no window over ``capacity``.

    Pieces are at most a quarter of a window, because with few pieces a window differencing
    cannot level them. The windows are as few as the total needs; while one of them exceeds
    capacity, their number rises.
    """
    owner, start, part = _cut(lengths, max(1, capacity // 4))
    windows = max(1, -(-int(lengths.sum()) // capacity))
    while True:
        window = differencing(part, windows)
        if np.bincount(window, weights=part, minlength=windows).max() <= capacity:
            return owner, start, part, window
        windows += 1


class _Packer:
    """Collects the documents of one partition and hands out packed pieces, a group at a time."""

    def __init__(self, capacity: int, windows: int, spare: int, first_sequence: int) -> None:
        self.capacity, self.spare = capacity, spare
        self.target = windows * (capacity - spare)
        self.sequence = first_sequence
        self.waiting: list[tuple[int, int, int]] = []  # document, start, length
        self.total = 0
        self.documents: list[tuple[object, np.ndarray]] = []

    def add(self, doc_id: object, ids: np.ndarray) -> None:
        self.documents.append((doc_id, ids))
        self.waiting.append((len(self.documents) - 1, 0, len(ids)))
        self.total += len(ids)

    def _rows(self, pieces: list[tuple[int, int, int]], sequence: int) -> list[tuple]:
        rows, offset = [], 0
        for d, start, length in pieces:
            doc_id, ids = self.documents[d]
            rows.append((doc_id, start, length, ids[start : start + length].astype("<u4").tobytes(), len(ids), sequence, offset))
            offset += length
        return rows

    def _take(self, amount: int) -> list[tuple[int, int, int]]:
        """The next pieces in order with exactly ``amount`` tokens; the last one may be cut."""
        taken, used = [], 0
        while amount:
            d, start, length = self.waiting[used]
            part = min(length, amount)
            taken.append((d, start, part))
            amount -= part
            if part == length:
                used += 1
            else:
                self.waiting[used] = (d, start + part, length - part)
        del self.waiting[:used]
        self.total -= sum(p[2] for p in taken)
        return taken

    def _full_windows(self, pieces: list[tuple[int, int, int]]) -> tuple[list[tuple], list[tuple[int, int, int]]]:
        """Parts of long documents that fill a window each, and what is left of all pieces."""
        rows, rest = [], []
        for d, start, length in pieces:
            while length >= self.capacity:
                rows += self._rows([(d, start, self.capacity)], self._next())
                start, length = start + self.capacity, length - self.capacity
            if length:
                rest.append((d, start, length))
        return rows, rest

    def _next(self) -> int:
        self.sequence += 1
        return self.sequence - 1

    def _pack(self, pieces: list[tuple[int, int, int]]) -> list[tuple]:
        rows, pieces = self._full_windows(pieces)
        if not pieces:
            return rows
        owner, start, part, window = near_equal_windows(np.array([p[2] for p in pieces], np.int64), self.capacity)
        order = np.lexsort((start, owner, window))
        cuts = np.flatnonzero(np.diff(window[order])) + 1
        for members in np.split(order, cuts):
            chosen = [(pieces[owner[i]][0], pieces[owner[i]][1] + int(start[i]), int(part[i])) for i in members]
            rows += self._rows(chosen, self._next())
        return rows

    def _forget(self) -> None:
        used = {d for d, _, _ in self.waiting}
        names = {d: i for i, d in enumerate(sorted(used))}
        self.documents = [self.documents[d] for d in sorted(used)]
        self.waiting = [(names[d], s, n) for d, s, n in self.waiting]

    def groups(self) -> Iterator[list[tuple]]:
        while self.total >= self.target:
            rows = self._pack(self._take(self.target))
            self._forget()
            yield rows

    def last(self) -> list[tuple]:
        """What is left: near-equal windows as far as they fill, the rest in powers of two."""
        rows = []
        whole = self.total // self.capacity * (self.capacity - self.spare)
        if whole:
            rows += self._pack(self._take(whole))
        while self.total:
            size = min(self.capacity, 1 << (self.total.bit_length() - 1))
            rows += self._rows(self._take(size), self._next())
        return rows


_COLUMNS = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]


def pack_documents(docs: DataFrame, id_column: str = "doc_id", text: str = "text", tokenizer: str = "word_bpe_49k.json", end_id: int = 2, capacity: int = 4096, windows: int = 256, spare: int = 16) -> DataFrame:
    """Pieces of documents with the sequence and offset where they lie, and their ids.

    Each task packs the rows of its own partition in groups of ``windows`` windows, so nothing is
    shuffled, a task holds one group at a time, and a lost task repeats with the same result.
    Sequence ids are the partition number times 2^33 plus a count. A group is filled to
    ``spare`` tokens a window below capacity, which leaves differencing room for its imbalance;
    the last tokens of a partition go to windows of power-of-two length, which need no padding.
    Windows that are cut whole from one long document, and those last ones, do not meet differencing.
    Null and empty texts are a document with the end id alone; repeated rows are packed each; an
    empty table gives no row; other columns are not read. ``ids`` holds little-endian unsigned
    32-bit numbers.
    """
    definition = tokenizer_bytes(tokenizer)
    id_type = docs.schema[id_column].dataType.simpleString()
    source = docs.select(F.col(f"`{id_column}`").cast("string").alias("doc_id"), F.col(f"`{text}`").cast("string").cast("binary").alias("text"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hold_memory("packing", word_encoder.cache_clear)
        encode = word_encoder(definition)
        packer = _Packer(capacity, windows, spare, TaskContext.get().partitionId() << 33)
        end = np.array([end_id], np.uint32)

        def frame(rows: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=_COLUMNS).astype({"doc_id": object})

        for batch in batches:
            texts = [t if isinstance(t, bytes) else b"" for t in batch["text"]]
            names = [d if isinstance(d, str) else None for d in batch["doc_id"]]
            for i in range(0, len(texts), _SLICE):
                for doc_id, tokens in zip(names[i : i + _SLICE], encode(texts[i : i + _SLICE])):
                    packer.add(doc_id, np.concatenate([tokens, end]))
                for rows in packer.groups():
                    yield frame(rows)
        rows = packer.last()
        if rows:
            yield frame(rows)

    schema = "doc_id string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return source.mapInPandas(pack, schema).withColumn("doc_id", F.col("doc_id").cast(id_type))


def packed_pieces(docs: DataFrame) -> DataFrame:
    """The pieces of :func:`pack_documents` in windows of 4096 tokens, their ids as a checksum.

    Null and empty texts are a document of one id; repeated rows are packed each; no documents
    give no rows; columns other than ``doc_id`` and ``text`` are not read.
    """
    pieces = pack_documents(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
