"""Settings of the scoring engine, passed explicitly; nothing is read from the environment or the session."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class ExtractConfig:
    text_layer_least: int = 120  # letters on a page that count as a text layer
    audit_least: int = 200  # the same in an audit, per page


@dataclass(frozen=True)
class ChunkConfig:
    size: int = 2400
    overlap: int = 250
    keep: int = 6
    least: int = 60
    single_pass: int = 9000


@dataclass(frozen=True)
class ScoreConfig:
    weight_keyword: float = 0.40
    weight_judge: float = 0.60
    gain: float = 1.7
    cap: float = 100.0
    bonus_per_year: float = 1.2
    bonus_years: float = 8.0
    must_have_penalty: float = 6.0
    degree_penalty: float = 5.0
    disagreement: float = 25.0
    years_disagreement: float = 4.0
    strong: float = 75.0
    moderate: float = 58.0


@dataclass(frozen=True)
class JudgeConfig:
    partitions: int = 0  # tasks that ask at a time; 0: as many as a shuffle has
    at_once: int = 4  # calls that a task has under way
    attempts: int = 3
    backoff_s: float = 1.5
    map_context: int = 4096
    reduce_context: int = 8192
    map_tokens: int = 320
    reduce_tokens: int = 420


@dataclass(frozen=True)
class Config:
    extract: ExtractConfig = field(default_factory=ExtractConfig)
    chunk: ChunkConfig = field(default_factory=ChunkConfig)
    score: ScoreConfig = field(default_factory=ScoreConfig)
    judge: JudgeConfig = field(default_factory=JudgeConfig)
    as_of_year: int = 2024  # what "present" means; the clock is never read
    top: int = 10
