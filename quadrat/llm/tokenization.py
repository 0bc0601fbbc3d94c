"""Byte-level BPE of a public vocabulary file; loaded once in each worker."""

from __future__ import annotations

import base64
from functools import lru_cache

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The id that follows each document, if the vocabulary leaves it free.
END_OF_TEXT = 50256


@lru_cache(maxsize=2)
def encoder(path: str = VOCABULARY):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def end_of_text(path: str = VOCABULARY) -> int:
    """END_OF_TEXT, or the first id after the vocabulary's if that is a token's."""
    coder = encoder(path)
    try:
        coder.decode_single_token_bytes(END_OF_TEXT)
    except KeyError:
        return END_OF_TEXT
    return coder.max_token_value + 1
