"""Parameters of the operators, as frozen records that are passed explicitly."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field


@dataclass(frozen=True)
class ChapterFilter:
    """Least size of a chapter and the paragraph that serves as its title."""

    min_chars: int = 1000
    min_paragraphs: int = 10
    title_index: int = 1
    header_paragraphs: int = 2


@dataclass(frozen=True)
class ChunkProfile:
    """Bounds of the semantic chunker, in tokens."""

    max_tokens: int = 500
    min_tokens: int = 240
    overlap_tokens: int = 0
    similarity_threshold: float = 0.80
    tiny_tokens: int = 50
    base_unit: str = "sentence"


PARAGRAPH_PROFILE = ChunkProfile(4000, 750, 0, 0.72, 75, "paragraph")


@dataclass(frozen=True)
class SceneProfile:
    """Thresholds of the scene detector; ``strategy`` is fixed, conservative, moderate or aggressive."""

    threshold: float = 0.87
    min_drop: float = 0.02
    strong_drop: float = 0.04
    recovery: float = 0.05
    strategy: str = "aggressive"
    drop_short: bool = True


@dataclass(frozen=True)
class DedupParams:
    """Entity resolution: least ratio for long, middle and short names."""

    ratio: int = 85
    ratio_middle: int = 90
    ratio_short: int = 95
    short_length: int = 5
    middle_length: int = 10
    canonical: str = "longest"


@dataclass(frozen=True)
class ExtractionParams:
    """Model calls of entity extraction."""

    use_semantic_chunks: bool = True
    slice_chars: int = 5000
    max_retries: int = 2
    context_filter: bool = True
    context_limit: int = 200
    alias_limit: int = 30
    merge_before_structure: bool = True


@dataclass(frozen=True)
class Params:
    """All parameters of the book pipeline."""

    chapters: ChapterFilter = field(default_factory=ChapterFilter)
    chunks: ChunkProfile = field(default_factory=ChunkProfile)
    scenes: SceneProfile = field(default_factory=SceneProfile)
    dedup: DedupParams = field(default_factory=DedupParams)
    extraction: ExtractionParams = field(default_factory=ExtractionParams)


def describe(parameters: object, indent: int = 0) -> str:
    """The parameters as indented lines of name and value."""
    values = parameters if isinstance(parameters, dict) else asdict(parameters)
    lines = []
    for name, value in values.items():
        if isinstance(value, dict):
            lines += [f"{' ' * indent}{name}:", describe(value, indent + 2)]
        else:
            lines.append(f"{' ' * indent}{name}: {value}")
    return "\n".join(lines)
