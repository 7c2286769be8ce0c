"""Public tokenizer files, given by path and read once in each Python process."""

from __future__ import annotations

import base64
from functools import lru_cache

VOCAB_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published split pattern of the 50k byte-level vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def ranks(path: str = VOCAB_PATH) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def encoding(path: str = VOCAB_PATH, pattern: str = PATTERN):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})
