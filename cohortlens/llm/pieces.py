"""SentencePiece BPE encoding by vectorised merge rounds, and decoding by table lookups."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from cohortlens.llm.common import hold_memory, tokenizer_bytes

_SPACE = "▁"
_NEVER = np.iinfo(np.int32).max
#: Characters of text that are encoded together.
_CHUNK = 4_000_000
#: Distinct words whose ids a worker remembers; later ones are merged once per chunk of texts.
_REMEMBERED = 500_000


class PieceTable:
    """Pieces of a BPE model as arrays; the library is used to read the model file only."""

    def __init__(self, model: bytes) -> None:
        reader = SentencePieceProcessor(model_proto=model)
        size = reader.get_piece_size()
        self.pieces = [reader.id_to_piece(i) for i in range(size)]
        self.begin, self.end, self.unknown = reader.bos_id(), reader.eos_id(), reader.unk_id()
        normal = [i for i in range(size) if not (reader.is_control(i) or reader.is_byte(i) or reader.is_unknown(i) or reader.is_unused(i))]
        id_of = {self.pieces[i]: i for i in normal}
        if any(_SPACE in p.lstrip(_SPACE) or p.startswith(2 * _SPACE) and p.strip(_SPACE) for p in id_of):
            raise ValueError("a piece goes across the start of a word")
        self.byte_id = np.array([reader.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        self.space = id_of[_SPACE]
        self.symbol_of = np.full(0x110000, -1, np.int32)
        for p, i in id_of.items():
            if len(p) == 1:
                self.symbol_of[ord(p)] = i
        scores = np.array([reader.get_score(i) for i in range(size)])
        rank = np.zeros(size, np.int32)
        rank[normal] = np.unique(-scores[normal], return_inverse=True)[1]
        pairs = [(id_of[p[:k]] * size + id_of[p[k:]], i) for p, i in id_of.items() for k in range(1, len(p)) if p[:k] in id_of and p[k:] in id_of]
        pairs.sort()
        self.size = size
        self.pair_key = np.array([k for k, _ in pairs] or [-1], np.int64)
        self.pair_id = np.array([i for _, i in pairs] or [0], np.int32)
        self.pair_rank = rank[self.pair_id]
        # A merge result that can merge on at once, before its equals further right do.
        self.hasty = np.zeros(size, bool)
        for key, merged in pairs:
            for part in divmod(key, size):
                if rank[part] >= rank[merged]:
                    self.hasty[part] = True
        self.runs = {len(p): i for p, i in id_of.items() if not p.strip(_SPACE)}
        text = [b"" if reader.is_control(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        text[self.unknown] = " ⁇ ".encode()
        for b, i in enumerate(self.byte_id.tolist()):
            text[i] = bytes([b])
        self.bytes_length = np.array([len(t) for t in text], np.int64)
        self.bytes_start = np.cumsum(self.bytes_length) - self.bytes_length
        self.bytes_pool = np.frombuffer(b"".join(text), np.uint8)
        self._run_ids: dict[int, bytes] = {}
        self._known: dict[str, bytes] = {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair, or never, and the piece that it becomes."""
        key = left.astype(np.int64) * self.size + right
        key[(left < 0) | (right < 0)] = -2
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        found = self.pair_key[at] == key
        return np.where(found, self.pair_rank[at], _NEVER), self.pair_id[at]

    def merge_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Final symbols of all words in order, and the number of symbols of each word.

        Symbols are piece ids, or -1 - code point for a character without a piece. In each round
        every word that still has a pair merges its pair of smallest rank wherever it occurs,
        leftmost first; words without pairs leave the arrays.
        """
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        symbol = self.symbol_of[points]
        symbol = np.where(symbol < 0, -1 - points, symbol).astype(np.int32)
        word = np.repeat(np.arange(len(words)), lengths)
        rank = np.full(len(symbol), _NEVER, np.int32)
        merged = np.zeros(len(symbol), np.int32)
        inner = np.flatnonzero(word[:-1] == word[1:])
        rank[inner], merged[inner] = self._rank(symbol[inner], symbol[inner + 1])
        done_word, done_symbol = [], []
        while len(symbol):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            sizes = np.diff(np.append(starts, len(word)))
            least = np.repeat(np.minimum.reduceat(rank, starts), sizes)
            active = least < _NEVER
            if not active.all():
                done_word.append(word[~active])
                done_symbol.append(symbol[~active])
                symbol, word, rank, merged, least = (x[active] for x in (symbol, word, rank, merged, least))
                if not len(symbol):
                    break
            place = np.flatnonzero(rank == least)
            fresh = np.concatenate([[True], (np.diff(place) > 1) | (np.diff(word[place]) > 0)])
            run_start = np.maximum.accumulate(np.where(fresh, place, 0))
            first_of_word = np.concatenate([[True], np.diff(word[place]) > 0])
            hasty_word = np.zeros(word[-1] + 1, bool)
            hasty_word[word[place[self.hasty[merged[place]]]]] = True
            chosen = np.where(hasty_word[word[place]], first_of_word, (place - run_start) % 2 == 0)
            place = place[chosen]
            symbol[place] = merged[place]
            keep = np.ones(len(symbol), bool)
            keep[place + 1] = False
            rank[place] = _NEVER
            at = np.cumsum(keep)[place] - 1
            symbol, word, rank, merged = symbol[keep], word[keep], rank[keep], merged[keep]
            touched = np.zeros(len(symbol) + 1, bool)
            touched[at], touched[at - 1] = True, True  # -1 is the spare last place
            around = np.flatnonzero(touched[:-1])
            rank[around] = _NEVER
            around = around[around < len(symbol) - 1]
            around = around[word[around] == word[around + 1]]
            rank[around], merged[around] = self._rank(symbol[around], symbol[around + 1])
        if not done_word:
            return symbol, np.zeros(len(words), np.int64)
        all_words, all_symbols = np.concatenate(done_word), np.concatenate(done_symbol)
        order = np.argsort(all_words, kind="stable")
        return all_symbols[order], np.bincount(all_words, minlength=len(words))

    def _spelt(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Replace characters without a piece by the ids of their bytes."""
        if not (symbols < 0).any():
            return symbols.astype(np.int64), counts
        word = np.repeat(np.arange(len(counts)), counts)
        ids, of = [], []
        for s, w in zip(symbols.tolist(), word.tolist()):
            spelt = [s] if s >= 0 else self.byte_id[list(chr(-1 - s).encode("utf-8", "surrogatepass"))].tolist()
            ids += spelt
            of += [w] * len(spelt)
        return np.array(ids, np.int64), np.bincount(of, minlength=len(counts))

    def _run(self, n: int) -> bytes:
        """Ids of n spaces alone: equal scores merge from the left."""
        if n not in self._run_ids:
            sizes, i = [1] * n, 0
            while i + 1 < len(sizes):
                if sizes[i] + sizes[i + 1] in self.runs:
                    sizes[i : i + 2] = [sizes[i] + sizes[i + 1]]
                    i = max(i - 1, 0)
                else:
                    i += 1
            if len(self._run_ids) > 1000:
                self._run_ids.clear()
            self._run_ids[n] = np.array([self.runs[s] for s in sizes], "<u4").tobytes()
        return self._run_ids[n]

    def _word_ids(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words with a space in front, as little-endian bytes."""
        ids, counts = self._spelt(*self.merge_words([_SPACE + w for w in words]))
        data, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
        return {w: data[start:end] for w, start, end in zip(words, [0, *ends], ends)}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text between the begin and the end id."""
        known = self._known
        units = [t.replace(_SPACE, " ").split(" ") if t else [] for t in texts]
        unknown = [w for w in set().union(*units) if w not in known]
        room = max(0, _REMEMBERED - len(known))
        known.update(self._word_ids(unknown))
        begin, end = (np.array([i], "<u4").tobytes() for i in (self.begin, self.end))
        result = []
        for words in units:
            inner = self._with_runs(words) if "" in words else b"".join(map(known.__getitem__, words))
            result.append(np.frombuffer(begin + inner + end, "<u4"))
        for word in unknown[room:]:
            del known[word]
        return result

    def _with_runs(self, words: list[str]) -> bytes:
        """Ids of a text with several spaces in a row; an empty word is one more space."""
        out, spaces, space = [], 0, np.array([self.space], "<u4").tobytes()
        for w in words:
            spaces += 1
            if w:
                own = self._known[w]
                if own.startswith(space):
                    out.append(self._run(spaces))
                    own = own[len(space) :]
                elif spaces > 1:
                    out.append(self._run(spaces - 1))
                out.append(own)
                spaces = 0
        if spaces:
            out.append(self._run(spaces))
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        """Text of one id sequence; the space that encoding puts in front goes."""
        ids = ids.astype(np.int64)
        lengths = self.bytes_length[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        data = self.bytes_pool[np.arange(total) + np.repeat(self.bytes_start[ids] - (ends - lengths), lengths)].tobytes()
        spoken = np.flatnonzero(lengths)
        first = int(ids[spoken[0]]) if len(spoken) else -1
        if first >= 0 and self.pieces[first].startswith(_SPACE):
            data = data[1:]
        try:
            return data.decode("utf-8")
        except UnicodeDecodeError:
            return self._decode_broken(ids)

    def _decode_broken(self, ids: np.ndarray) -> str:
        """Byte ids that are no UTF-8 become one replacement character each."""
        out, run, begun = [], bytearray(), False
        byte_of = {int(i): b for b, i in enumerate(self.byte_id)}

        def flush() -> None:
            i = 0
            while i < len(run):
                for width in (1, 2, 3, 4):
                    try:
                        out.append(run[i : i + width].decode("utf-8"))
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    width = 1
                    out.append("�")
                i += width
            run.clear()

        for i in ids.tolist():
            if i in byte_of:
                run.append(byte_of[i])
                begun = True
                continue
            flush()
            piece = self.bytes_pool[self.bytes_start[i] : self.bytes_start[i] + self.bytes_length[i]].tobytes().decode()
            if not begun and piece and self.pieces[i].startswith(_SPACE):
                piece = piece[1:]
            begun = begun or bool(self.bytes_length[i])
            out.append(piece)
        flush()
        return "".join(out)


@cache
def piece_table(model: bytes) -> PieceTable:
    return PieceTable(model)


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    chunk, size = [], 0
    for t in texts:
        if chunk and size + len(t) > _CHUNK:
            yield chunk
            chunk, size = [], 0
        chunk.append(t)
        size += len(t)
    if chunk:
        yield chunk


def encode_column(text: Column, model: str = "piece_bpe_32k.model") -> Column:
    """Ids of each whole text with begin and end id, as little-endian unsigned 32-bit numbers.

    A null or empty text gives begin and end id alone. Words of a batch are encoded once each;
    there is no shuffle, and repeated rows get equal ids.
    """
    definition = tokenizer_bytes(model)

    @F.pandas_udf("binary")
    def encode(texts: pd.Series) -> pd.Series:
        hold_memory("pieces", piece_table.cache_clear)
        pieces = piece_table(definition)
        rows = [t if isinstance(t, str) else "" for t in texts]
        return pd.Series([x.astype("<u4").tobytes() for chunk in _chunks(rows) for x in pieces.encode(chunk)], dtype=object)

    return encode(text)


def decode_column(ids: Column, model: str = "piece_bpe_32k.model") -> Column:
    """Text of ids as :func:`encode_column` writes them; null gives the empty text."""
    definition = tokenizer_bytes(model)

    @F.pandas_udf("string")
    def decode(rows: pd.Series) -> pd.Series:
        hold_memory("pieces", piece_table.cache_clear)
        pieces = piece_table(definition)
        return pd.Series([pieces.decode(np.frombuffer(x or b"", "<u4")) for x in rows], dtype=object)

    return decode(ids)
