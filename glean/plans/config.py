"""The pipeline's parameters; every choice that changes results is spelled out."""

from __future__ import annotations

from dataclasses import asdict, dataclass


@dataclass(frozen=True)
class PipelineConfig:
    chunk_seconds: int = 60
    alpha: float = 0.4
    aggregation: str = "top2_mean"
    threshold: float = 0.4
    #: ``name`` or ``name+description``: what a concept's text is (S14).
    concept_text_mode: str = "name+description"
    #: ``half_even`` or ``half_up``.
    round_mode: str = "half_up"
    #: ``all`` or ``train``: what the models are fitted on (S15).
    fit_scope: str = "all"

    def as_dict(self) -> dict:
        return asdict(self)


PILOT = PipelineConfig()
LOCKED = PipelineConfig(chunk_seconds=180, alpha=0.0, aggregation="max", threshold=0.5, concept_text_mode="name", round_mode="half_even", fit_scope="train")
