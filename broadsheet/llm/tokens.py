"""Token ids of whole texts by the tokenizers library, fast for repeated words and exact for all.

Both public vocabularies cut a text into pieces by a pattern and merge each piece by itself, so
the ids of a text are those of its pieces in a row. The ids of pieces met before come from a
dictionary as bytes (little-endian unsigned 32-bit); new ones go to the tokenizer's merge model.
The patterns below are those of the vocabularies for Latin-1; texts with other characters,
control characters, or the string of a special token go to the tokenizer as a whole. Where pieces hold no white space
('word'), words between it are looked up first, and only those not met before are cut into pieces.
"""

from __future__ import annotations

import functools
import os
import re
import struct
from collections.abc import Callable, Iterable, Iterator

#: Characters beyond those of which the classes are settled here.
NOT_PLAIN = re.compile(r"[^\t\n\r\x20-\x7e\xa1-\xff]")
LETTER, NUMBER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
#: 'byte' keeps white space in the ids, 'word' drops it and all case.
PIECES = {
    "byte": re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^\s{LETTER}{NUMBER}]+|\s+(?!\S)|\s+"),
    "word": re.compile(rf"'(?:[stmd]|re|ve|ll)|[{LETTER}]+|[{NUMBER}]|[^\s{LETTER}{NUMBER}]+"),
}
#: Entries of the dictionary before it starts anew: about 200 MB. Characters above which a word or piece is no entry.
KEPT, LONGEST = 1_000_000, 64


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Known(dict):
    """A piece, or a word of pieces that find cuts, -> its ids as bytes; those not met yet are cut and merged when they are asked for."""

    def __init__(self, tokenizer, kept: int = KEPT, find: Callable[[str], list[str]] | None = None):
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__()
        self.kept, self.find = kept, find
        as_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {i: as_bytes.pre_tokenize_str(chr(i))[0][0] for i in range(256)}
        self.merge = tokenizer.model.tokenize

    def __missing__(self, word: str) -> bytes:
        pieces = self.find(word) if self.find else ()
        if len(pieces) > 1:
            found = b"".join(map(self.__getitem__, pieces))
        else:
            ids = [t.id for t in self.merge(word.translate(self.letters))]
            found = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= LONGEST:
            if len(self) >= self.kept:
                self.clear()
            self[word] = found
        return found


class Encoder:
    """kind: a key of PIECES. Every text gets the end id. kept: entries of the dictionary before it starts anew."""

    def __init__(self, path: str, kind: str, end_id: int, kept: int = KEPT):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end = struct.pack("<I", end_id)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.find, self.fold = PIECES[kind].findall, kind == "word"
        self.known = Known(self.tokenizer, kept, self.find if self.fold else None)

    def whole(self, text: str) -> bytes:
        """The tokenizer's own way."""
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text and the end id, in order."""
        get = self.known.__getitem__
        for text in texts:
            if not text:
                yield self.end
            elif NOT_PLAIN.search(text) or any(s in text for s in self.special):
                yield self.whole(text) + self.end
            else:
                yield b"".join(map(get, text.lower().split() if self.fold else self.find(text))) + self.end


@functools.lru_cache(maxsize=2)
def encoder(path: str, kind: str, end_id: int, kept: int = KEPT) -> Encoder:
    """One for each worker process."""
    return Encoder(path, kind, end_id, kept)
