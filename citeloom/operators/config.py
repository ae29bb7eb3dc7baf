"""Retrieval settings with their checks, metric names, run discovery."""

from __future__ import annotations

from dataclasses import dataclass

#: Other names of measures.
METRIC_ALIASES = {"hit": "recall", "hits": "recall", "map": "ap", "mean_average_precision": "ap", "f1": "f1_1", "mrr5": "mrr_5", "mrr": "mrr_5"}

#: By the beginning of an encoder's name, whether it gives all three signals, its query prefix and its input length (None: its own).
ENCODERS = (
    ("baai/bge-m3", True, "", 1024),
    ("baai/bge", False, "Represent this sentence for searching relevant passages: ", None),
)


@dataclass(frozen=True)
class EncoderRule:
    """How texts go into an encoder."""

    mode: str
    query_prefix: str
    max_length: int | None


def encoder_rule(name: str, mode: str = "auto", query_prefix: str | None = None, max_length: int | None = None) -> EncoderRule:
    """Mode, prefix and length for an encoder: what the caller gives, else what its family asks for."""
    if max_length is not None and max_length < 1:
        raise ValueError("max_length must be positive")
    family = next((x[1:] for x in ENCODERS if name.lower().startswith(x[0])), (False, "", None))
    wanted = {"multivector": "hybrid", "auto": "hybrid" if family[0] else "dense"}.get(mode, mode)
    return EncoderRule(wanted, family[1] if query_prefix is None else query_prefix, family[2] if max_length is None else max_length)


@dataclass(frozen=True)
class RetrievalConfig:
    """Hybrid retrieval: mode, depth, pool factor and weights."""

    mode: str = "hybrid"
    top_k: int = 2000
    candidate_multiplier: int = 3
    dense_weight: float = 0.5
    sparse_weight: float = 0.15
    late_weight: float = 0.35
    max_queries: int | None = None
    query_prefix: str = ""

    def __post_init__(self) -> None:
        if self.mode not in ("auto", "dense", "hybrid", "multivector"):
            raise ValueError(f"unknown mode {self.mode}")
        if self.top_k < 1 or self.candidate_multiplier < 1 or (self.max_queries is not None and self.max_queries < 1):
            raise ValueError("top_k, candidate_multiplier and max_queries must be positive")
        if min(self.weights) < 0 or not any(self.weights):
            raise ValueError("weights must not be negative, and not all 0")

    @property
    def weights(self) -> tuple[float, float, float]:
        return self.dense_weight, self.sparse_weight, self.late_weight

    def pool(self, documents: int) -> int:
        """Candidates taken from the dense search."""
        return min(documents, max(self.top_k, self.top_k * self.candidate_multiplier))

    def resolved_mode(self, multi_signal_encoder: bool) -> str:
        """``auto`` means hybrid for an encoder that gives all three signals, else dense."""
        return self.mode if self.mode != "auto" else "hybrid" if multi_signal_encoder else "dense"


def canonical_metric(name: str) -> str:
    """The engine's name of a measure such as ``hit@10``."""
    base, _, depth = name.lower().replace("@", "_").rpartition("_")
    if not base or not depth.isdigit():
        return METRIC_ALIASES.get(name.lower(), name.lower())
    return f"{METRIC_ALIASES.get(base, base)}_{depth}"


def usable_run(path: str, include_archive: bool = False) -> bool:
    """Whether a run file counts: archives only on request."""
    return include_archive or not any(part in ("archive", "old", "backup") for part in path.lower().split("/"))
