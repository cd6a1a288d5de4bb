"""Settings of the engine, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    #: Tokens of a chunk and of its overlap, depths, rank constant of fusion, seed.
    chunk_size: int = 512
    chunk_overlap: int = 64
    retrieve_depth: int = 50
    rerank_depth: int = 20
    rrf_k: int = 60
    seed: int = 42

    def __post_init__(self) -> None:
        """Each field lies in a range that may depend on the others."""
        ranges = {"chunk_size": (1, None), "chunk_overlap": (0, self.chunk_size - 1), "rerank_depth": (1, self.retrieve_depth), "rrf_k": (1, None)}
        for name, (low, high) in ranges.items():
            value = getattr(self, name)
            if value < low or (high is not None and value > high):
                raise ValueError(f"{name} = {value} is outside of {low} to {'any' if high is None else high}")


class EngineError(RuntimeError):
    """A check that an operator makes on its input has failed."""


class LeakageError(EngineError):
    """Training data holds what belongs to the test split."""


class SlugCollision(EngineError):
    """Two sources have one slug."""
