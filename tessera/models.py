"""Embedding models by name: their width and what is put before queries.

Only what is public of a model is kept here, no weights; vectors come from a callable given to the
engine. ``hashing`` is the embedder of this library.
"""

from __future__ import annotations

import re
from dataclasses import dataclass


class UnknownModel(LookupError):
    """Neither a known name nor a repository of the form owner/name."""


@dataclass(frozen=True)
class Model:
    """``width`` 0: any, given by whoever uses it; ``longest``: tokens it takes."""

    name: str
    repository: str
    width: int = 0
    query_prefix: str = ""
    longest: int = 512
    known: bool = False


#: Public models and their query prefixes.
MODELS = (
    Model("bge-small-en-v1.5", "BAAI/bge-small-en-v1.5", 384, "Represent this sentence for searching relevant passages: ", known=True),
    Model("all-MiniLM-L6-v2", "sentence-transformers/all-MiniLM-L6-v2", 384, known=True),
    Model("hashing", "", known=True),
)


def lookup(name: str) -> Model:
    """A model by name or repository; the first by default. Another repository gives an entry
    without a width; anything else is unknown, so that a slip is told at once."""
    name = name.strip() or MODELS[0].name
    for m in MODELS:
        if name in (m.name, m.repository):
            return m
    owner, _, rest = name.partition("/")
    if not all(re.fullmatch(r"[A-Za-z0-9._-]+", part) and part not in (".", "..") for part in (owner, rest)):
        raise UnknownModel(f"{name!r}: known are {', '.join(m.name for m in MODELS)}, or a repository as owner/name")
    return Model("", name)
