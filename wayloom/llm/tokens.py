"""Token counts with a public tokenizer whose vocabulary file is named by path."""

from __future__ import annotations

import base64
from functools import lru_cache

import tiktoken

#: Vocabulary used unless another path is given; the file must lie at the same place on all workers.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the public pattern that cuts text into words before byte-pair encoding.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def tokenizer(vocabulary: str = VOCABULARY) -> tiktoken.Encoding:
    """The encoder of a rank file (base64 token and rank on each line)."""
    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("wayloom", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(texts: list[str | None], vocabulary: str = VOCABULARY) -> list[list[int]]:
    """Token ids of each text; none for null. Strings of special tokens are ordinary text."""
    encoder = tokenizer(vocabulary)
    return [encoder.encode_ordinary(t) if t else [] for t in texts]
