"""Token ids of whole texts with a public tokenizer, inside Spark tasks.

A text is cut where the tokenizer itself always cuts (at the strings of its special tokens, before
the last space of white space, or at white space where the vocabulary drops it, and between an ASCII
letter and punctuation), so the ids of a text are the joined ids of its chunks. Strings of special
tokens in a text become their ids, as the library has it; with ``plain`` they are ordinary text.

A worker keeps the ids of short chunks: of ``NEW`` that came once, and of ``OFTEN`` that came again;
either set starts anew when it is full. Chunks of Latin letters only are one word for the library's
pre-tokenizer and go straight to its model; all others go through the whole library.
"""

from __future__ import annotations

import array
import functools
import os
import re
from collections.abc import Iterator

import pyarrow as pa

NEW = 400_000
OFTEN = 400_000
LONG = 64
#: White space in Unicode's sense, as the tokenizers see it.
SPACE = "\t-\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_SIGNS = r"!-/:-@\[-`{-~"
#: No punctuation up to an ASCII letter, or whatever comes if it doesn't end there.
_HEAD = f"[^{SPACE}{_SIGNS}]+(?:(?<=[A-Za-z])|[^{SPACE}]*)"
#: With spaces kept (byte-level vocabularies), or dropped (vocabularies with word ends).
KEPT = f" ?{_HEAD}| ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
DROPPED = f"{_HEAD}|[^{SPACE}]+"
#: Letters that no normalizer composes, and that lower-case one by one.
_LETTERS = re.compile("(?P<space> ?)[A-Za-zÀ-ÖØ-öø-ÿ]+")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it is visible, else one from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class ChunkIds(dict):
    """Ids of chunks as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, pattern: str, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.chunks = re.compile(pattern).findall
        self.new: dict[str, bytes] = {}
        added = {} if plain else self.tokenizer.get_added_tokens_decoder()
        self.special = {t.content: array.array("I", [i]).tobytes() for i, t in added.items()}
        #: Special tokens that also take space around them, or part of words only, are left to the library.
        self.odd = any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values())
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.lower = "Lowercase" in str(self.tokenizer.normalizer)
        self.letters, self.model, self.direct = _byte_letters(), self.tokenizer.model, True
        for probe in ("Ab", "é", *([" ab", " ÿÀ"] if pattern == KEPT else [])):  # is it the kind of vocabulary that is meant?
            self.direct = self.direct and self._word(probe) == self._whole(probe)

    def _word(self, chunk: str) -> list[int]:
        """Ids of a chunk of letters: lower-cased and spelt in bytes for the model."""
        if self.lower:
            chunk = chunk.lower()
        if chunk.isascii():
            chunk = chunk.replace(" ", self.letters[32])
        else:
            chunk = chunk.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.model.tokenize(chunk)]

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def __missing__(self, chunk: str) -> bytes:
        ids = self.new.pop(chunk, None)
        if ids is not None:
            if len(self) >= OFTEN:
                self.clear()
            self[chunk] = ids
            return ids
        found = self._word(chunk) if self.direct and len(chunk) <= LONG and _LETTERS.fullmatch(chunk) else self._whole(chunk)
        ids = array.array("I", found).tobytes()
        if len(chunk) <= LONG:
            if len(self.new) >= NEW:
                self.new.clear()
            self.new[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if self.special and any(s in text for s in self.special):
            if self.odd:
                return array.array("I", self._whole(text)).tobytes()
            parts = self.at_special.split(text)  # text, special, text, ...
            return b"".join(self.special[p] if i % 2 else self._plain(p) for i, p in enumerate(parts))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.chunks(text)))


@functools.lru_cache(maxsize=4)
def chunk_ids(path: str, pattern: str, plain: bool = False) -> ChunkIds:
    """One for each worker process."""
    return ChunkIds(path, pattern, plain)


def pieces_of(batch: pa.RecordBatch, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batch in slices of so many rows, so that what is built from one stays small."""
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)
