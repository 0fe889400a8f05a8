"""Token counts of texts under a public tokenizer, whose file is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame

#: Rank file of the byte-level vocabulary and the pattern it splits texts with; executors read it from their own disk.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the splitting pattern published with that vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(path: str):
    """The encoder of a rank file."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}
    return tiktoken.Encoding(Path(path).stem, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(df: DataFrame, keep: list[str], text: str, path: str = TOKENIZER) -> DataFrame:
    """``keep`` and ``n_tokens`` of the whole text; null and empty texts have none. Special tokens count as ordinary text."""
    schema = df.select(*keep).schema.simpleString()[len("struct<") : -1].replace(":", " ")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(path)
        for pdf in batches:
            counts = [len(enc.encode_ordinary(t)) if isinstance(t, str) and t else 0 for t in pdf[text]]
            yield pdf[keep].assign(n_tokens=counts)

    return df.select(*keep, text).mapInPandas(work, f"{schema}, n_tokens long")
