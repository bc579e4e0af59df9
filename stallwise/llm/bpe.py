"""Byte-pair encoding as a streaming transducer, and decoding by a state machine.

Whether a token is final depends on a bounded stretch of text to its right: a merge can only
be prevented by an earlier rule that takes its right part, which an earlier rule still can
prevent in turn, and so on along a chain of ever earlier rules. :func:`sufficient_lookahead`
finds the longest such chain of a merge list. The encoder holds that many symbols and a step,
emits every token that ends before them, and forgets it.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

# Pieces remembered by one task, none longer than SHORT; the memory is emptied when it is full.
REMEMBERED = 500_000
SHORT = 64
SEGMENT = 1 << 16
STEP = 64
# White space as the Unicode property has it; str.split also cuts at these four.
SPACES = "\t-\r \x85\xa0  -     　"
SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in shown}
    for n, b in enumerate(b for b in range(256) if b not in names):
        names[b] = chr(256 + n)
    return [names[b] for b in range(256)]


def sufficient_lookahead(rules: list[tuple[int, int, int]], lengths: dict[int, int]) -> int:
    """How many symbols after a token's end can still change it.

    ``rules`` are (left, right, result), first rule first. ``taken[t]`` is how far to the
    right one must see to know whether a rule met so far takes ``t`` as its left part;
    ``inner[t]`` the same for the right ends from which ``t`` was made, each against the rules
    before the one that used it up.
    """
    taken: dict[int, int] = {}
    inner: dict[int, int] = {}
    for _ in range(2):  # a token that two rules make may have been used before the second
        taken.clear()
        for left, right, result in rules:
            behind = max(taken.get(right, 0), inner.get(right, 0))
            taken[left] = max(taken.get(left, 0), lengths[right] + behind)
            inner[result] = max(inner.get(result, 0), behind)
    return max([0, *taken.values(), *inner.values()])


class Merges:
    """A merge list over numbered symbols."""

    def __init__(self, rules: list[tuple[int, int, int]], lengths: dict[int, int]):
        self.width = max([2, *lengths]).bit_length()
        # A pair's rule as one number: its rank, then the symbol it makes.
        self.rules = {(a, b): rank << self.width | c for rank, (a, b, c) in reversed(list(enumerate(rules)))}
        self.none = (len(rules) + 1) << self.width
        self.lengths = lengths
        self.lookahead = sufficient_lookahead(rules, lengths)
        self.step = max([STEP, *lengths.values()])

    def merged(self, symbols: list[int]) -> list[int]:
        """All merges, earliest rule first and leftmost among equals."""
        none, made = self.none, (1 << self.width) - 1
        get = self.rules.get
        tokens = list(symbols)
        found = [get(p, none) for p in zip(tokens, tokens[1:], strict=False)]
        while found:
            best = min(found)
            if best == none:
                break
            i = found.index(best)
            token = best & made
            tokens[i : i + 2] = (token,)
            del found[i]
            if i:
                found[i - 1] = get((tokens[i - 1], token), none)
            if i < len(found):
                found[i] = get((token, tokens[i + 1]), none)
        return tokens

    def stream(self, symbols: Iterable[int]) -> Iterator[int]:
        """Tokens as soon as they are final; holds the lookahead, a step and one token at most."""
        held: list[int] = []
        for symbol in symbols:
            held.append(symbol)
            if len(held) >= self.lookahead + self.step:
                end, last = 0, len(held) - self.lookahead
                for token in self.merged(held):
                    if end + self.lengths[token] > last:
                        break
                    yield token
                    end += self.lengths[token]
                del held[:end]
        yield from self.merged(held)


class WordPieces:
    """Encoder and decoder of a tokenizer file with word ends, lower case and no white space."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocabulary = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        self.names = {i: name for name, i in vocabulary.items()}
        signs = byte_symbols()
        self.inside = [vocabulary[s] for s in signs]
        self.ends = [vocabulary[s + suffix] for s in signs]
        lengths = dict.fromkeys([*self.inside, *self.ends], 1)
        rules = []
        for left, right in model["merges"]:
            a, b, c = vocabulary[left], vocabulary[right], vocabulary[left + right]
            lengths[c] = lengths[a] + lengths[b]
            rules.append((a, b, c))
        self.merges = Merges(rules, lengths)
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.names.update({i: name for name, i in self.added.items()})
        self.bytewise = (spec["decoder"] or {}).get("type") == "ByteLevel"
        self.cut_added = regex.compile("(" + "|".join(regex.escape(x) for x in self.added) + ")") if self.added else None
        words = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^" + SPACES + r"\p{L}\p{N}]+"
        self.words = regex.compile(words)
        self.blank = regex.compile(f"[{SPACES}]+")
        self.known: dict[str, bytes] = {}

    def symbols(self, word: str) -> Iterator[int]:
        data = word.encode()
        for b in data[:-1]:
            yield self.inside[b]
        yield self.ends[data[-1]]

    def piece(self, piece: str) -> bytes:
        """Ids of a text without white space, as little-endian unsigned 32-bit numbers."""
        out = array("I")
        for part in self.cut_added.split(piece) if self.cut_added and any(x in piece for x in self.added) else [piece]:
            if part in self.added:
                out.append(self.added[part])
            elif part:
                # Lower case letter by letter: a final sigma is not told apart.
                plain = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                for word in self.words.findall(plain):
                    out.extend(self.merges.stream(self.symbols(word)))
        return out.tobytes()

    def segments(self, text: str) -> Iterator[str]:
        """``text`` in stretches of bounded length, cut at white space."""
        at = 0
        while len(text) - at > SEGMENT:
            cut = self.blank.search(text, at + SEGMENT)
            if cut is None:
                break
            yield text[at : cut.start()]
            at = cut.end()
        yield text[at:]

    def encode(self, text: str) -> Iterator[bytes]:
        """Ids of ``text``, a stretch at a time."""
        known = self.known
        for segment in self.segments(text):
            odd = any(x in segment for x in SEPARATORS)
            out = []
            for piece in self.blank.split(segment) if odd else segment.split():
                ids = known.get(piece)
                if ids is None:
                    ids = self.piece(piece)
                    if len(piece) <= SHORT:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        known[piece] = ids
                out.append(ids)
            yield b"".join(out)

    def decoder(self) -> Decoder:
        return Decoder(self.names, self.bytewise)


class Decoder:
    """Text from ids, a stretch at a time.

    With a byte-level decoder the state is what is begun of a character; without one, tokens
    are written out with a space between them, and the state is whether one came before.
    """

    def __init__(self, names: dict[int, str], bytewise: bool):
        self.names, self.bytewise, self.begun = names, bytewise, False
        self.values = {c: b for b, c in enumerate(byte_symbols())}
        self.utf8 = codecs.getincrementaldecoder("utf-8")(errors="replace")

    def feed(self, ids: bytes) -> str:
        names = list(map(self.names.__getitem__, array("I", ids)))
        if self.bytewise:
            return self.utf8.decode(bytes(self.values[c] for name in names for c in name))
        if not names:
            return ""
        lead = " " if self.begun else ""
        self.begun = True
        return lead + " ".join(names)

    def finish(self) -> str:
        return self.utf8.decode(b"", final=True) if self.bytewise else ""


def coding(make: Callable[[], WordPieces]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = make()
        for batch in batches:
            ids, texts = [], []
            for text in batch.column("text"):
                decoder, parts, shown = words.decoder(), [], []
                for part in words.encode(text.as_py() or ""):
                    parts.append(part)
                    shown.append(decoder.feed(part))
                ids.append(b"".join(parts))
                texts.append("".join([*shown, decoder.finish()]))
            columns = [batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"])

    return run


def digesting(make: Callable[[], WordPieces]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = make()
        for batch in batches:
            counts, ids, texts = [], [], []
            for text in batch.column("text"):
                decoder, n, id_hash, text_hash = words.decoder(), 0, hashlib.sha256(), hashlib.sha256()
                for part in words.encode(text.as_py() or ""):
                    n += len(part) // 4
                    id_hash.update(part)
                    text_hash.update(decoder.feed(part).encode())
                text_hash.update(decoder.finish().encode())
                counts.append(n)
                ids.append(id_hash.hexdigest())
                texts.append(text_hash.hexdigest())
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def round_trip_digests(docs: DataFrame, make: Callable[[], WordPieces]) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row, as :func:`round_trip` would give them.

    The hashes take in ids and text as they come out, so that neither is held whole.
    """
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(digesting(make), schema)


def round_trip(docs: DataFrame, make: Callable[[], WordPieces]) -> DataFrame:
    """(doc_id, ids, decoded) of every row: the ids of its text and the text they decode to.

    ``ids`` are little-endian unsigned 32-bit numbers. A null or empty text has no ids and
    decodes to the empty text. Columns other than doc_id and text are ignored.
    """
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, ids binary, decoded string"
    return docs.select("doc_id", "text").mapInArrow(coding(make), schema)
