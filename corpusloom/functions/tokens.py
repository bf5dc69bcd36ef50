"""Default tokenizers and the hashing embedder."""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Plain ASCII classes: \w and \s differ between regex engines for other letters.
CODE_TOKEN = r"[A-Za-z0-9_]+|[^A-Za-z0-9_\s]"
EMBEDDING_TOKEN = r"[a-z0-9_]+"
WORD_TOKEN = r"[a-z]+"
STREAM_TOKEN = r"\S+|\s+"


def regex_tokens(text: Column, pattern: str = CODE_TOKEN) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def lower_words(text: Column) -> Column:
    return regex_tokens(F.lower(text), WORD_TOKEN)


def _hash_code(token: str, dim: int) -> int:
    """2 * bucket, plus 1 for a negative sign."""
    digest = hashlib.md5(token.encode()).hexdigest()
    return int(digest[:8], 16) % dim * 2 + int(digest[8:16], 16) % 2


def hash_embedding(text: Column, dim: int = 64) -> Column:
    """array<float> of length ``dim``: signed token counts per hash bucket, scaled to length 1.

    A text without tokens, or whose counts cancel out, gives the zero vector. Components are rounded
    to 6 places. Counting with numpy per Arrow batch costs a fifth of the same sum over JVM arrays,
    which has to pass over all tokens once per bucket.
    """

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        find = re.compile(EMBEDDING_TOKEN).findall
        code = functools.lru_cache(maxsize=1_000_000)(lambda token: _hash_code(token, dim))
        for texts in batches:
            vectors = np.zeros((len(texts), dim))
            for i, one in enumerate(texts):
                codes = [code(token) for token in find(one.lower())] if one else []
                if codes:
                    counts = np.bincount(codes, minlength=2 * dim)
                    vectors[i] = counts[0::2] - counts[1::2]
            norm = np.linalg.norm(vectors, axis=1, keepdims=True)
            unit = np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0)
            yield pd.Series(list(np.round(unit, 6).astype(np.float32)), index=texts.index)

    return embed(text)
