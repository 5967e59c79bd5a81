"""Models behind an interface, addressed by URIs; deterministic offline defaults."""

from __future__ import annotations

import hashlib
import math
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import wraps
from urllib.parse import parse_qsl

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .errors import ConfigError, InvalidInput
from .workers import importable


@dataclass(frozen=True)
class Address:
    """provider/model, or provider@base:model?name=value; ~ as base means the default."""

    provider: str
    model: str
    base: str | None = None
    params: dict[str, str] = field(default_factory=dict)

    def __str__(self) -> str:
        if self.base is None and not self.params:
            return f"{self.provider}/{self.model}"
        query = "&".join(f"{k}={v}" for k, v in self.params.items())
        return f"{self.provider}@{self.base or '~'}:{self.model}" + (f"?{query}" if query else "")


def parse_address(uri: str) -> Address:
    """Reads either form; a base may have a port, the model follows the last colon before any query."""
    if not uri or not uri.strip():
        raise ConfigError("empty address")
    if "@" not in uri:
        provider, slash, model = uri.partition("/")
        if not (provider and slash and model) or "?" in uri:
            raise ConfigError(f"not provider/model: {uri!r}")
        return Address(provider.lower(), model)
    provider, _, rest = uri.partition("@")
    rest, _, query = rest.partition("?")
    base, colon, model = rest.rpartition(":")
    if not (provider and colon and base and model):
        raise ConfigError(f"not provider@base:model: {uri!r}")
    return Address(provider.lower(), model, None if base == "~" else base, dict(parse_qsl(query)))


class _Codes(dict):
    """Places of words in sums of added and of subtracted ones, worked out when a word is first asked for; of limited size."""

    MOST = 1 << 18

    def __init__(self, dimension: int):
        super().__init__()
        self.dimension = dimension

    def __missing__(self, word: str) -> int:
        if len(self) >= self.MOST:
            self.clear()
        h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
        self[word] = code = h % self.dimension + (0 if h >> 63 else self.dimension)
        return code


class HashedWords:
    """The offline embedder: words hashed with signs into a vector of length 1; equal texts have equal vectors.

    ``most_tokens`` is a provider's limit of input, of which None is none: whole texts are embedded.
    """

    most_tokens: int | None = None
    codes: _Codes | None = None

    def __init__(self, address: Address):
        self.dimension = int(address.params.get("dim", 64))

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension))
        codes = _Codes(self.dimension) if self.codes is None else self.codes
        self.codes = codes
        for i, t in enumerate(texts):
            words = re.findall(r"\w+", t.lower())
            n = np.bincount(np.fromiter(map(codes.__getitem__, words), np.int64, len(words)), minlength=2 * self.dimension)
            out[i] = n[: self.dimension] - n[self.dimension :]
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).astype(np.float32)


EMBEDDERS: dict[str, Callable[[Address], object]] = {"offline": HashedWords}


def register(name: str, make: Callable[[Address], object]) -> None:
    EMBEDDERS[name.lower()] = make


def provider(uri: str):
    a = parse_address(uri)
    if a.provider not in EMBEDDERS:
        raise ConfigError(f"unknown provider {a.provider!r}; there are {sorted(EMBEDDERS)}")
    return EMBEDDERS[a.provider](a)


def batches(tokens: list[int], most_tokens: int = 200_000, most: int = 2048) -> list[list[int]]:
    """Places of texts in requests of limited tokens and inputs, in order."""
    out: list[list[int]] = []
    used = 0
    for i, n in enumerate(tokens):
        if not out or len(out[-1]) >= most or used + n > most_tokens:
            out.append([])
            used = 0
        out[-1].append(i)
        used += n
    return out


def within_limit(model, texts: list[str]) -> list[str]:
    """The texts cut to the model's ``most_tokens`` words separated by blanks; whole if it has none."""
    most = getattr(model, "most_tokens", None)
    return texts if most is None else [" ".join(t.split(" ")[:most]) for t in texts]


def embed(units: DataFrame, uri: str = "offline/words", text: str = "content") -> DataFrame:
    """Adds ``embedding``; each distinct text is embedded once, by a provider made once a worker, and joined back.

    ``embedding_content``, where there is one, is embedded instead of the text.  Only for a
    provider with ``most_tokens`` are texts cut, to so many words separated by blanks.
    """
    importable(units.sparkSession)
    source = F.coalesce(F.nullif("embedding_content", F.lit("")), F.col(text)) if "embedding_content" in units.columns else F.col(text)
    keyed = units.withColumn("_text", F.coalesce(source, F.lit(""))).withColumn("_key", F.sha2("_text", 256))

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = provider(uri)
        for s in parts:
            cut = within_limit(model, list(s))
            out = [v for b in batches([math.ceil(len(t) / 4) for t in cut]) for v in model.embed([cut[i] for i in b])]
            yield pd.Series(out, index=s.index)

    vectors = keyed.select("_key", "_text").dropDuplicates(["_key"]).select("_key", run("_text").alias("embedding"))
    return keyed.drop("_text", "embedding").join(vectors, "_key").drop("_key")


def retried(times: int = 3, delay: float = 1.0, factor: float = 1.5, most: float = 60.0, on: tuple[type[Exception], ...] = (Exception,)):
    """Calls again after errors, ``times`` in all, waiting delay * factor^n, ``most`` at most."""
    if times < 1:
        raise InvalidInput("times must be at least 1")

    def around(f):
        @wraps(f)
        def call(*a, **k):
            for n in range(times):
                try:
                    return f(*a, **k)
                except on:
                    if n == times - 1:
                        raise
                    time.sleep(min(delay * factor**n, most))

        return call

    return around


def dimension(uri: str) -> int:
    """Length of a provider's vectors: what it says, or that of one text embedded."""
    model = provider(uri)
    return getattr(model, "dimension", None) or len(model.embed(["probe"])[0])


def embed_by_type(units: DataFrame, uris: dict[str, str], default: str | None = None, text: str = "content") -> DataFrame:
    """Embeds each unit by the provider of its ``unit_type``; others by ``default``, and without one they have no vector."""
    known = list(uris)
    parts = [embed(units.where(F.col("unit_type") == k), u, text) for k, u in uris.items()]
    rest = units.where(F.col("unit_type").isNull() | ~F.col("unit_type").isin(known)) if known else units
    parts.append(embed(rest, default, text) if default else rest.withColumn("embedding", F.lit(None).cast("array<float>")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


RERANKERS: dict[str, Callable[[Address], Callable]] = {}


def register_reranker(name: str, make: Callable[[Address], Callable]) -> None:
    """Adds a provider: from an address to a function of the columns query and text."""
    RERANKERS[name.lower()] = make


def reranker(uri: str) -> Callable:
    """The scoring function of an address of the same forms as an embedder's; "offline/terms" is the share of the query's terms."""
    from .operators.post import lexical_score

    a = parse_address(uri)
    if a.provider == "offline":
        return lexical_score
    if a.provider not in RERANKERS:
        raise ConfigError(f"unknown provider {a.provider!r}; there are {sorted([*RERANKERS, 'offline'])}")
    return RERANKERS[a.provider](a)
