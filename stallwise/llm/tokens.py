"""Token ids of whole texts under a published byte-level vocabulary."""

from __future__ import annotations

import base64
from array import array

# Words remembered by one Python worker; the memory is emptied when it is full.
REMEMBERED = 300_000


class ByteTokens:
    """Ids as little-endian unsigned 32-bit integers.

    A text is cut before every space that a non-space follows: no token crosses such a place,
    so a word with its space can be encoded alone and remembered.
    """

    def __init__(self, ranks_path: str, pattern: str, specials: dict[str, int]):
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encode_ordinary = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.specials = specials
        self.words: dict[str, bytes] = {}

    def _plain(self, text: str) -> bytes:
        return array("I", self.encode_ordinary(text)).tobytes()

    def _segment(self, text: str) -> bytes:
        if not text:
            return b""
        head, *words = text.split(" ")
        known = self.words
        out = [self._plain(head)]
        for word in words:
            ids = known.get(word)
            if ids is None:
                if not word or word[0].isspace():
                    return self._plain(text)
                if len(known) >= REMEMBERED:
                    known.clear()
                ids = self._plain(" " + word)
                if len(word) <= 64:
                    known[word] = ids
            out.append(ids)
        if words and head.endswith(tuple(" \t")):
            return self._plain(text)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        for special, number in self.specials.items():
            if special in text:
                mark = array("I", [number]).tobytes()
                return mark.join(self.encode(part) for part in text.split(special))
        return self._segment(text)
