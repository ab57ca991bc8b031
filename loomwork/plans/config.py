"""Settings of a domain: per-domain value, else environment, else default."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace

# Setting -> (per-domain key, environment variable).
KEYS = {
    "delay_ms": ("lda.delay", "LDA_EVENT_DELAY"),
    "vocabulary_size": ("lda.vocabulary.size", "LDA_VOCABULARY_SIZE"),
    "optimizer": ("lda.optimizer", "LDA_OPTIMIZER"),
    "max_evaluations": ("lda.max.evaluations", "LDA_MAX_EVALUATIONS"),
    "max_iterations": ("lda.max.iterations", "LDA_MAX_ITERATIONS"),
    "topics": ("lda.topics", "LDA_NUM_TOPICS"),
    "alpha": ("lda.alpha", "LDA_ALPHA"),
    "beta": ("lda.beta", "LDA_BETA"),
    "features": ("lda.features", "LDA_FEATURES"),
    "stopwords": ("lda.stopwords", "LDA_STOPWORDS"),
    "words_per_topic": ("lda.words.per.topic", "LDA_WORDS_PER_TOPIC"),
    "max_pending_shapes": ("lda.max.pending.shapes", "LDA_MAX_PENDING_SHAPES"),
}


@dataclass(frozen=True)
class Config:
    delay_ms: int = 30_000
    vocabulary_size: int = 10_000
    optimizer: str = "basic"
    max_evaluations: int = 100
    max_iterations: int = 10
    topics: int = 2
    alpha: float = -1.0  # negative: automatic
    beta: float = -1.0
    features: str = "TF"
    stopwords: str = ""
    words_per_topic: int = 100
    max_pending_shapes: int = 1000
    sector_size: int = 1000
    seed: int = 42


@dataclass(frozen=True)
class Criteria:
    """What a query returns: at most `max` rows, from `threshold` up, of the given types."""

    max: int = 10
    threshold: float = 0.0
    types: tuple[str, ...] = ()


def resolve(own: dict[str, str] | None = None, environment: dict[str, str] | None = None) -> Config:
    """The settings of a domain with the parameters `own`."""
    environment = dict(os.environ) if environment is None else environment
    kinds = {f.name: type(f.default) for f in fields(Config)}
    found = {}
    for name, (key, variable) in KEYS.items():
        value = (own or {}).get(key, environment.get(variable))
        if value is not None:
            found[name] = kinds[name](value)
    return replace(Config(), **found)
