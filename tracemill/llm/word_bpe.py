"""Token ids of a lower-casing word BPE vocabulary, exactly as the library gives them.

A vocabulary string that ends a word and *encodes alone as one token* needs no merging: that is
proved once per process by encoding every such string (:func:`whole_tokens`). Words in the proved
set are counted directly; only the rest run the library's merges.

The vocabulary drops white space and never joins text across it, and special strings hold none. So
a column of texts is cut at ASCII white space, the distinct pieces of a block are looked up once,
and their ids are gathered for all places at once. A piece with a character for which plain
lower-casing and splitting are not proved to be what the library does (checked for each character
when a vocabulary is loaded) goes through the library's own normaliser and splitter.
"""

from __future__ import annotations

import functools
import json
import re
import string
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

from tracemill.llm.common import text_blocks

#: Pieces and merged words up to this length are remembered, so many at a time.
CACHED_CHARS = 48
CACHED_PIECES = 300_000
CACHED_WORDS = 200_000
#: Larger blocks have fewer distinct pieces a byte, smaller ones need less memory.
BLOCK_BYTES = 8 << 20

#: Characters that the direct way may meet: Latin letters and common marks.
_PLAIN_RANGES = ((0x21, 0x7E), (0xA1, 0x24F), (0x2010, 0x2027), (0x20AC, 0x20AC))


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(others)}


def whole_tokens(tokenizer: Tokenizer, word_end: str) -> dict[str, int]:
    """Words (as byte letters) that encode alone as one token, with the token's id.

    Proved by encoding each candidate of the vocabulary with the model, not taken from its spelling:
    a string of the vocabulary need not be what the merges arrive at.
    """
    proved, tokenize = {}, tokenizer.model.tokenize
    for string, number in tokenizer.get_vocab(with_added_tokens=False).items():
        if string.endswith(word_end) and (word := string[: -len(word_end)]):
            tokens = tokenize(word)
            if len(tokens) == 1 and tokens[0].id == number:
                proved[word] = number
    return proved


class WordBpe:
    """Counts and ids of texts for one vocabulary file (``tokenizers`` JSON)."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self._find = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self._letters = _byte_letters()
        self._tokenize = self.tokenizer.model.tokenize
        whole = whole_tokens(self.tokenizer, spec["model"]["end_of_word_suffix"])
        self._special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        marks = "|".join(re.escape(s) for s in sorted(self._special, key=len, reverse=True))
        self._marks = re.compile(f"({marks})") if marks else None
        chars = (chr(c) for lo, hi in _PLAIN_RANGES for c in range(lo, hi + 1))
        self._odd = re.compile("[^" + "".join(re.escape(c) for c in chars if self._is_plain(c)) + "]")
        #: Proved words by their text, as packed ids.
        back = {letter: byte for byte, letter in self._letters.items()}
        self._whole = {
            bytes(back[c] for c in word).decode("utf-8", "replace"): struct.pack("<I", number)
            for word, number in whole.items()
        }
        #: Marks that may end a word of ASCII letters and are split off it; none if such letters are not all plain.
        self._tails = {
            c for c in string.punctuation if self._find(f"a{c}") == ["a", c] and not self._odd.search(f"{c}{string.ascii_letters}")
        }
        self._words: dict[str, bytes] = dict(self._whole)
        self._pieces: dict[str, bytes] = {}

    def _spelled(self, word: str) -> str:
        if word.isascii() and word.isalpha():  # such bytes stand for themselves
            return word
        return word.encode().decode("latin-1").translate(self._letters)

    def _is_plain(self, c: str) -> bool:
        """Whether lower-casing and splitting ``c`` directly is what the library does."""
        library = self.tokenizer.normalizer.normalize_str(c)
        pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str(f"a{library}1{library}")
        direct = self._find(f"a{c.lower()}1{c.lower()}")
        return (
            library == c.lower()
            and [p[0] for p in pieces] == [self._spelled(w) for w in direct]
            and (not c.isalpha() or len(direct) == 3)
        )

    def _merge(self, spelled: str) -> bytes:
        ids = [t.id for t in self._tokenize(spelled)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        """Packed ids of one plain lower-case word: proved, merged before, or merged now."""
        packed = self._words.get(word)
        if packed is None:
            packed = self._merge(self._spelled(word))
            if len(word) <= CACHED_CHARS:
                if len(self._words) >= CACHED_WORDS + len(self._whole):
                    self._words = dict(self._whole)
                self._words[word] = packed
        return packed

    def _odd_piece(self, piece: str) -> bytes:
        """A piece that may hold special strings or characters left to the library."""
        out = []
        for part in self._marks.split(piece) if self._marks else [piece]:
            if part in self._special:
                out.append(struct.pack("<I", self._special[part]))
            elif part:
                normal = self.tokenizer.normalizer.normalize_str(part)
                out += [self._merge(w) for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]
        return b"".join(out)

    def _piece(self, piece: str) -> bytes:
        """Packed ids of a piece without ASCII white space."""
        if self._tails and piece.isascii() and piece.isalpha():
            return self._word(piece.lower())
        if self._odd.search(piece) or (self._marks and "|" in piece and self._marks.search(piece)):
            return self._odd_piece(piece)
        lower = piece.lower()
        if lower.isalpha():
            return self._word(lower)
        if lower[-1:] in self._tails and lower[:-1].isalpha():
            return self._word(lower[:-1]) + self._word(lower[-1])
        return b"".join([self._word(w) for w in self._find(lower)])

    def pieces(self, pieces: list[str]) -> list[bytes]:
        """Packed ids of each piece."""
        known = self._pieces
        packed = list(map(known.get, pieces))
        missing = [i for i, p in enumerate(packed) if p is None]
        if len(known) + len(missing) > CACHED_PIECES:
            known.clear()
        room = CACHED_PIECES - len(known)
        for i in missing:
            packed[i] = found = self._piece(pieces[i])
            if room > 0 and len(pieces[i]) <= CACHED_CHARS:
                known[pieces[i]] = found
                room -= 1
        return packed

    def _looked_up(self, texts: pa.Array):
        """(places per text, numbers of the distinct pieces, their packed ids)."""
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        packed = self.pieces(coded.dictionary.to_pylist())
        places = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        return places, coded.indices.to_numpy(zero_copy_only=False), packed

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text; a null counts as empty."""
        found = [np.zeros(0, np.int64)]
        for block in text_blocks(texts, BLOCK_BYTES):
            places, at, packed = self._looked_up(block)
            sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
            ends = np.concatenate([[0], np.cumsum(sizes[at])])
            last = np.cumsum(places)
            found.append(ends[last] - ends[last - places])
        return np.concatenate(found)

    def ids(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text, as unsigned 32-bit little-endian numbers."""
        for block in text_blocks(texts, BLOCK_BYTES):
            places, at, packed = self._looked_up(block)
            sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
            firsts = np.cumsum(sizes) - sizes
            pool = np.frombuffer(b"".join(packed), "<u4")
            ends = np.concatenate([[0], np.cumsum(sizes[at])])
            where = np.repeat(firsts[at] - ends[:-1], sizes[at])
            where += np.arange(len(where))
            data = pool[where].tobytes()
            last = np.cumsum(places)
            for a, b in zip((ends[last - places] * 4).tolist(), (ends[last] * 4).tolist(), strict=True):
                yield data[a:b]


@functools.lru_cache(maxsize=4)
def load(path: str) -> WordBpe:
    """The vocabulary at ``path``, loaded and proved once per process."""
    return WordBpe(path)
