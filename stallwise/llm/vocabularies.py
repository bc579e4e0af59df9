"""Published vocabularies by name; the folder is a parameter of the installed package."""

from __future__ import annotations

import json

from stallwise.llm.bpe import WordPieces
from stallwise.llm.tokens import ByteTokens


def byte_tokens() -> ByteTokens:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    return ByteTokens(
        public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, {x["content"]: x["id"] for x in added}
    )


def word_pieces() -> WordPieces:
    import public_tokenizers

    return WordPieces(public_tokenizers.path("word_bpe_49k.json"))
