"""Public tokenizer vocabularies, loaded once a worker from a path that is a parameter."""

from __future__ import annotations

import base64
from functools import lru_cache

#: Where the vocabulary is read from unless another path is given; it is never copied.
DEFAULT_VOCAB = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how byte-level BPE of this vocabulary splits a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoding(path: str = DEFAULT_VOCAB):
    """The byte-level BPE encoding of a vocabulary file of lines 'base64 rank'."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(text: str, path: str = DEFAULT_VOCAB) -> int:
    """Number of tokens of the whole text; special tokens' strings are ordinary text."""
    return len(encoding(path).encode_ordinary(text))
