"""Token ids by the tokenizers library, with a bounded memory of word pieces for each Python worker.

A byte-level tokenizer of this family never joins two words across a single space, and the
space goes with the word behind it. A text cut before its single spaces therefore encodes
piece by piece to the same ids, and most pieces come again and again. A new piece is split by
the family's published pattern, and the library's model turns each part into ids; pieces
with characters beyond the Latin ones go through the library's own splitting. Texts are also cut
before line breaks, if none of them touches other white space. Pieces that touch
other white space are not cut: a text that holds one is encoded whole. So is a text with the string of an added
token, which the library takes for that token, and any text of a tokenizer file with other settings.
"""

from __future__ import annotations

import gc
import json
import os
import re
from array import array

import numpy as np
import regex

from tachyline.llm.common import held
from tachyline.llm.hashing import by_bytes, mixed, run_of_bytes

MOST_PIECES = 1_000_000

#: The published splitting pattern of the tokenizer's family (a fixed value).
_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
_NEAR_BREAK = re.compile(r"\s\n|\n\s").search
_KIND = np.uint64(0x9E6C63D0676A9A99)
#: Settings of a tokenizer file under which pieces may be cut.
_SPLITTING = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
_MODEL = {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "ignore_merges": False}
#: Bytes that may be or begin white space, ASCII letters, marks that are a part of their own behind a
#: letter and before a blank, and blanks.
_ODD = np.array([byte <= 32 or byte >= 128 for byte in range(256)])
_LETTER = np.array([chr(byte).isalpha() and byte < 128 for byte in range(256)])
_MARK, _BLANK = np.isin(np.arange(256), [44, 46]), np.isin(np.arange(256), [10, 32])
_LATIN = re.compile(r"[\x21-\x7E\n¡-ɏ]*\Z").match


def _byte_characters() -> dict[int, str]:
    """The character that stands for each byte in the vocabulary: itself if it shows, else one above 255."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [byte for byte in range(256) if byte not in shown]
    return {byte: chr(byte) for byte in shown} | {byte: chr(256 + i) for i, byte in enumerate(hidden)}


_CHARACTERS = _byte_characters()


class Pieces(dict):
    """Parts and their ids, learned when first asked for; a full young generation replaces the old one."""

    def __init__(self, learn, most: int):
        super().__init__()
        self.learn, self.most, self.old = learn, most, {}

    def __missing__(self, piece: str) -> bytes | None:
        ids = self.old.get(piece) or self.learn(piece)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class Known:
    """Hashes of pieces and where their ids are in one flat array: open addressing, looked up for many at once.

    Once ``most`` pieces are held it starts afresh, so its memory is bounded. -1 as a length marks a
    piece that may not be cut off.
    """

    def __init__(self, most: int):
        self.most = most
        self.slots = 1 << max(4, (2 * most - 1).bit_length())
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(self.slots, np.uint64)
        self.place = np.zeros(self.slots, np.int64)
        self.length = np.zeros(self.slots, np.int32)
        self.ids = np.empty(1 << 12, np.uint32)
        self.used = self.held = 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hash, or -1."""
        slot = (hashes & np.uint64(self.slots - 1)).astype(np.int64)
        out = np.full(len(hashes), -1, np.int64)
        open_ = np.arange(len(hashes))
        while len(open_):
            found = self.keys[slot[open_]]
            hit = found == hashes[open_]
            out[open_[hit]] = slot[open_[hit]]
            open_ = open_[~hit & (found != 0)]
            slot[open_] = (slot[open_] + 1) & (self.slots - 1)
        return out

    def add(self, keys: np.ndarray, lists: list[list[int] | None]) -> None:
        """Take in different new keys with their ids; None: may not be cut off."""
        length = np.array([-1 if ids is None else len(ids) for ids in lists], np.int32)
        count = np.maximum(length, 0).astype(np.int64)
        place = self.used + np.cumsum(count) - count
        if self.used + int(count.sum()) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty(max(len(self.ids), int(count.sum())), np.uint32)])
        flat = [number for ids in lists if ids for number in ids]
        self.ids[self.used : self.used + len(flat)] = flat
        self.used, self.held = self.used + len(flat), self.held + len(keys)
        slot = (keys & np.uint64(self.slots - 1)).astype(np.int64)
        open_ = np.arange(len(keys))
        while len(open_):
            free = open_[self.keys[slot[open_]] == 0]
            free = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[free]], self.place[slot[free]], self.length[slot[free]] = keys[free], place[free], length[free]
            open_ = open_[self.keys[slot[open_]] != keys[open_]]
            slot[open_] = (slot[open_] + 1) & (self.slots - 1)


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids, each text followed by ``end_id``.

    All pieces of many texts are cut, hashed and looked up at once; Python sees those it hasn't
    met. A piece is known by a 64-bit hash of its bytes and of what stood before it.
    """

    def __init__(self, path: str, end_id: int, most_pieces: int = MOST_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        # Pieces are strings and bytes, which form no cycles: looking for some in between is in vain.
        gc.set_threshold(500_000, 10, 10)
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            settings = json.load(file)
        #: Whether pieces may be cut as described above; texts of any other tokenizer are encoded whole.
        self.cuts = (
            settings.get("normalizer") is None
            and {name: (settings.get("pre_tokenizer") or {}).get(name) for name in _SPLITTING} == _SPLITTING
            and settings.get("post_processor") is None
            and {name: settings["model"].get(name) for name in _MODEL} == _MODEL
        )
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.tokenize = self.tokenizer.model.tokenize
        self.end_id, self.end = end_id, array("I", [end_id]).tobytes()
        self.known = Known(most_pieces)
        self.parts = Pieces(self._part, most_pieces // 20)
        self.words = Pieces(self._later, most_pieces // 5)

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        encoded = [text.encode() for text in texts]
        for low, high in by_bytes(encoded):
            out += self._some(texts[low:high], encoded[low:high])
        return out

    def _some(self, texts: list[str], encoded: list[bytes]) -> list[bytes]:
        whole = np.array([not self.cuts or any(token in text for token in self.added) for text in texts], bool)
        joined = b" ".join(encoded) + b" "
        data = np.frombuffer(joined, np.uint8)
        lengths = np.array([len(each) for each in encoded], np.int64)
        begin = np.cumsum(lengths + 1) - (lengths + 1)
        # Texts are cut at line breaks if no break touches white space; only a look at odd neighbours costs a search.
        breaks, odd = np.ones(len(texts), bool), _ODD[data]
        near = np.flatnonzero(data == 10)
        near = near[odd[np.maximum(near - 1, 0)] | odd[near + 1]]
        for i in np.unique(np.searchsorted(begin, near, "right") - 1).tolist():
            breaks[i] = _NEAR_BREAK(texts[i]) is None
        # Pieces begin at the text (0), behind a space (1), at a line break (2) and at a mark that ends a word (3).
        spaces, lines = np.flatnonzero(data[:-1] == 32), np.flatnonzero(data == 10)
        spaces = spaces[~np.isin(spaces, begin[1:] - 1, assume_unique=True)]
        lines = lines[breaks[np.searchsorted(begin, lines, "right") - 1]] if len(lines) else lines
        marks = np.flatnonzero(_MARK[data[1:-1]] & _LETTER[data[:-2]] & _BLANK[data[2:]]) + 1
        starts = np.concatenate([begin, spaces + 1, lines, marks])
        kind = np.repeat(np.arange(4), [len(begin), len(spaces), len(lines), len(marks)])
        text = np.searchsorted(begin, np.concatenate([begin, spaces, lines, marks]), "right") - 1
        order = np.lexsort((kind, starts, text))
        starts, kind, text = starts[order], kind[order], text[order]
        last = np.append(text[1:] != text[:-1], True)
        ends = np.where(last, (begin + lengths)[text], np.append(starts[1:] - (kind[1:] == 1), 0))
        hashes = mixed(run_of_bytes(data, starts, ends) + kind.astype(np.uint64) * _KIND)
        hashes |= (hashes == 0).astype(np.uint64)
        slots = self.known.find(hashes)
        if (slots < 0).any():
            new = np.flatnonzero(slots < 0)
            new = new[np.unique(hashes[new], return_index=True)[1]]
            if self.known.held + len(new) > self.known.most:
                self.known.clear()
                new = np.unique(hashes, return_index=True)[1]
            if len(new) > self.known.most:  # more than can be held at once: the library takes these texts
                whole[:], new = True, new[:0]
            self.known.add(hashes[new], [
                self._learn(joined[low:high], of) for low, high, of in zip(starts[new].tolist(), ends[new].tolist(), kind[new].tolist())
            ])
            slots = np.maximum(self.known.find(hashes), 0)
        length = self.known.length[slots].astype(np.int64)
        whole[text[length < 0]] = True
        length = np.where(whole[text], 0, length)
        at = np.cumsum(length) - length + text  # behind each text comes its end
        ids = np.full(int(length.sum()) + len(texts), self.end_id, np.uint32)
        step = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        ids[np.repeat(at, length) + step] = self.known.ids[np.repeat(self.known.place[slots], length) + step]
        bounds = np.cumsum(np.bincount(text, length, len(texts)).astype(np.int64) + 1) * 4
        held = ids.astype("<u4").tobytes()
        return [
            self._whole(texts[i]) + self.end if alone else held[low:high]
            for i, (alone, low, high) in enumerate(zip(whole.tolist(), [0, *bounds.tolist()], bounds.tolist()))
        ]

    def _learn(self, piece: bytes, kind: int) -> list[int] | None:
        if kind == 1 and piece.isalpha():  # a run of ASCII letters behind a space is one part
            return [token.id for token in self.tokenize("\u0120" + piece.decode())]
        ids = (self._first, self._later, self._line, self._line)[kind](piece.decode())
        return None if ids is None else array("I", ids).tolist()

    def _first(self, piece: str) -> bytes | None:
        return self._ids(piece) if not piece[-1:].isspace() else None

    def _line(self, piece: str) -> bytes | None:
        return self._ids(piece) if len(piece) == 1 or not piece[-1].isspace() else None

    def _later(self, piece: str) -> bytes | None:
        if not piece or piece[0].isspace() or piece[-1].isspace():
            return None
        if piece.isalpha() and _LATIN(piece):  # a run of letters is one part
            return self._part(" " + piece)
        if piece[-1] in ",." and piece[:-1].isalpha() and _LATIN(piece):
            return self.words[piece[:-1]] + self.parts[piece[-1]]
        return self._ids(" " + piece)

    def _ids(self, text: str) -> bytes:
        if not _LATIN(text.removeprefix(" ")):
            return self._whole(text)
        parts, words = self.parts, self.words
        return b"".join(
            words[part[1:]] if part[0] == " " and part[1:].isalpha() and part.isascii() else parts[part]
            for part in _PARTS(text)
        )

    def _part(self, part: str) -> bytes:
        if part.isascii() and part[1:].isalpha() and part[0] == " ":
            shown = "\u0120" + part[1:]
        else:
            shown = part.encode().decode("latin-1").translate(_CHARACTERS)
        return array("I", [token.id for token in self.tokenize(shown)]).tobytes()

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


def shared_encoder(path: str | None, end_id: int) -> Encoder:
    """One encoder a Python worker: tasks that follow each other know the same pieces."""
    path = path or default_tokenizer()
    return held(("encoder", path, end_id), lambda: Encoder(path, end_id))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
