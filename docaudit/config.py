"""Settings of the analyses, checked when made, and their YAML readers."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass
from pathlib import Path


def _need(condition: bool, message: str) -> None:
    if not condition:
        raise ValueError(message)


@dataclass(frozen=True)
class TextCompare:
    medium: float = 0.60
    high: float = 0.85
    min_chars: int = 20
    max_chars: int = 6000
    ngram_min: int = 2
    ngram_max: int = 4
    recall_ngram: int = 2
    max_candidates: int = 30
    min_shared: int = 2
    top_matches: int = 3
    downweight: float = 0.70
    #: From this cosine or containment on the sequence ratio is computed.
    sequence_gate: float = 0.35
    max_documents: int = 5

    def __post_init__(self):
        _need(0 <= self.medium <= self.high <= 1, "0 <= medium <= high <= 1")
        _need(self.min_chars >= 1 and self.recall_ngram >= 1 and self.max_candidates >= 1 and self.top_matches >= 1, "counts begin at 1")
        _need(1 <= self.ngram_min <= self.ngram_max, "1 <= ngram_min <= ngram_max")
        _need(0 < self.downweight <= 1, "0 < downweight <= 1")


@dataclass(frozen=True)
class ImageCompare:
    exact_distance: int = 5
    near_distance: int = 15
    max_aspect_delta: float = 0.25
    min_colour: float = 0.55
    min_pixels: int = 8

    def __post_init__(self):
        _need(0 <= self.exact_distance <= self.near_distance <= 64, "0 <= exact <= near <= 64")
        _need(self.max_aspect_delta >= 0 and 0 <= self.min_colour <= 1 and self.min_pixels >= 1, "image limits")


@dataclass(frozen=True)
class FormatCheck:
    dominant_ratio: float = 0.70
    size_tolerance: float = 0.5
    margin_tolerance: float = 0.3


@dataclass(frozen=True)
class Style:
    min_chars: int = 80
    medium: float = 0.55
    high: float = 0.75
    min_confidence: float = 0.35
    downweight: float = 0.70
    sentence_weight: float = 0.30
    transition_weight: float = 0.25
    generic_weight: float = 0.20
    repeated_weight: float = 0.15
    punctuation_weight: float = 0.10

    def __post_init__(self):
        _need(self.min_chars >= 20, "min_chars >= 20")
        _need(0 <= self.medium < self.high <= 1, "0 <= medium < high <= 1")
        _need(0 <= self.min_confidence <= 1 and 0 < self.downweight <= 1, "shares lie in [0, 1]")
        _need(self.total > 0, "weights sum to more than 0")

    @property
    def total(self) -> float:
        return self.sentence_weight + self.transition_weight + self.generic_weight + self.repeated_weight + self.punctuation_weight


@dataclass(frozen=True)
class Scoring:
    text: float = 0.40
    image: float = 0.20
    ai: float = 0.15
    format: float = 0.25
    low: float = 0.20
    medium: float = 0.40
    high: float = 0.65
    critical: float = 0.85

    def __post_init__(self):
        _need(min(self.text, self.image, self.ai, self.format) >= 0 and self.text + self.image + self.ai + self.format > 0, "weights")
        _need(0 <= self.low <= self.medium <= self.high <= self.critical <= 1, "0 <= low <= medium <= high <= critical <= 1")


@dataclass(frozen=True)
class Annotation:
    min_severity: str = "low"
    max_comments: int = 500
    include_evidence: bool = True
    max_evidence_chars: int = 500

    def __post_init__(self):
        _need(self.min_severity in ("info", "low", "medium", "high", "critical"), "unknown severity")
        _need(self.max_comments >= 1 and self.max_evidence_chars >= 0, "comment limits")


def from_yaml(kind: type, path: str | Path, section: str | None = None):
    """Settings of a kind from a YAML file (or a section of it); keys that are missing keep their defaults."""
    import yaml

    data = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    data = data.get(section, {}) if section else data
    known = {f.name for f in dataclasses.fields(kind)}
    return kind(**{k: v for k, v in data.items() if k in known})
