"""Parameters of the analysis, with the study's defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    """Defaults that operators take unless told otherwise."""

    min_m: int = 3
    top_k: int = 1000
    confidence: float = 0.70
    tie_delta: float = 0.02
    cosine_gate: float = 0.85
    concept_gate: float = 0.72
    contradiction_gate: float = 0.72
    grammar_gate: float = 0.50
    edit_low: float = 0.05
    edit_high: float = 0.60
    entity_gate: float = 0.92
    alpha: float = 0.05
    rank_biserial_gate: float = 0.10
    entailment: float = 0.72
    bootstrap: int = 20_000
    block_size: int = 8000
    mesh_unstable: float = 0.5
    #: Coverage falls from 1.00 to 0.10 in 19 steps.
    grid_steps: int = 19
    grid_step: float = 0.05


DEFAULT = Params()
UNASSIGNED = "UNASSIGNED"
