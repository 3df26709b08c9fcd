"""Validated settings; every constant of the formulas has its one place here."""

from __future__ import annotations

from dataclasses import dataclass, field

EPS = 1e-6
ALIGN_TOLERANCE = 10.0
FAR_DISTANCE = 300.0
COLUMN_GAP_SHARE = 0.15
MIN_CLUSTER = 3
PAGE_HEIGHT = 800.0


@dataclass(frozen=True)
class Weights:
    """Weights of the production score; they sum to 1 and caption has the largest share."""

    caption: float = 0.4
    spatial: float = 0.3
    semantic: float = 0.15
    layout: float = 0.1
    proximity: float = 0.05

    def __post_init__(self) -> None:
        parts = (self.caption, self.spatial, self.semantic, self.layout, self.proximity)
        if any(not 0 <= p <= 1 for p in parts):
            raise ValueError("weights must lie between 0 and 1")
        if abs(sum(parts) - 1) > 1e-6:
            raise ValueError("weights must sum to 1")
        if self.caption < max(parts):
            raise ValueError("caption must have the largest weight")


# Weights by kind of use.
PROFILES = {
    "general": Weights(),
    "academic": Weights(0.5, 0.25, 0.15, 0.08, 0.02),
    "technical": Weights(0.45, 0.3, 0.15, 0.08, 0.02),
}


@dataclass(frozen=True)
class Pruning:
    """Limits and boosts of association pruning."""

    min_score: float = 0.4
    per_image: int = 5
    total: int = 100
    caption_min: float = 0.5
    caption_boost: float = 1.2
    quality_boost: float = 1.1
    boost_quality: bool = True
    excellent: float = 0.8
    good: float = 0.6
    fair: float = 0.4

    def __post_init__(self) -> None:
        if self.per_image < 1 or self.total < 1:
            raise ValueError("limits must be at least 1")


STRICT = Pruning(min_score=0.5, per_image=3, total=50, caption_min=0.6)
BALANCED = Pruning()
LENIENT = Pruning(min_score=0.3, per_image=8, total=200, caption_min=0.4, boost_quality=False)


@dataclass(frozen=True)
class Pattern:
    """A caption pattern: regular expression (case-insensitive, line-wise), kind and base confidence."""

    regex: str
    kind: str
    base: float
    language: str = "mixed"

    def __post_init__(self) -> None:
        import re

        re.compile(self.regex)
        if not 0 <= self.base <= 1:
            raise ValueError("base must lie between 0 and 1")


# The caption patterns.
CAPTION_PATTERNS = (
    Pattern(r"^(圖|圖片|Figure|Fig\.?)\s*[：:]*\s*(\d+)", "figure_number", 0.95),
    Pattern(r"^(表|表格|Table|Tab\.?)\s*[：:]*\s*(\d+)", "table_number", 0.95),
    Pattern(r"^(Chart|Diagram|Image|Graph|Plot)\s*[：:]*\s*(\d+)", "chart_diagram", 0.9, "en"),
    Pattern(r"(如圖\s*\d+|見圖\s*\d+|參見圖\s*\d+)", "reference", 0.9, "zh"),
    Pattern(r"(see\s+figure\s*\d+|as\s+shown\s+in\s+figure\s*\d+|figure\s*\d+\s+shows)", "reference", 0.85, "en"),
    Pattern(r"(顯示了|表明|說明|展示|描述|示意圖|流程圖)", "description", 0.7, "zh"),
    Pattern(r"(shows|displays|illustrates|demonstrates|depicts|represents)", "description", 0.7, "en"),
    Pattern(r"^.{5,50}$", "title", 0.6),
    Pattern(r"(公式\s*\d+|equation\s*\d+|formula\s*\d+)", "reference", 0.8),
    Pattern(r"(附圖\s*\d+|appendix\s+figure\s*\d+|附表\s*\d+)", "figure_number", 0.85),
)

# Signs that a text is a caption for certain.
STRONG_INDICATORS = (
    r"下列?圖\w*", r"如圖\s*\d*所示", r"見圖\s*\d+", r"圖\s*\d+[\.:：]", r"表\s*\d+[\.:：]", r"圖表\s*\d*[\.:：]", r"示意圖[\.:：]", r"流程圖[\.:：]",
    r"(下|以下)(圖|表|圖表)[\.:：]", r"Figure\s+\d+[\.:：]", r"Table\s+\d+[\.:：]", r"Chart\s+\d+[\.:：]", r"Diagram\s+\d+[\.:：]",
)

# Factors of a match by the pattern's kind and by where the text stands.
TYPE_FACTORS = {"figure_number": 1.0, "table_number": 1.0, "chart_diagram": 0.95, "reference": 0.9, "title": 0.85, "description": 0.8}
POSITION_FACTORS = {"above": 1.1, "below": 1.2, "left": 0.9, "right": 0.9, "inside": 0.8, "distant": 0.6}

# Vertical, horizontal, distance, alignment, caption boost by type of document.
DOCUMENT_WEIGHTS = {
    "default": (0.40, 0.25, 0.20, 0.10, 1.0),
    "report": (0.40, 0.25, 0.20, 0.10, 1.0),
    "unknown": (0.40, 0.25, 0.20, 0.10, 1.0),
    "academic_paper": (0.45, 0.30, 0.20, 0.10, 1.2),
    "technical_manual": (0.35, 0.25, 0.25, 0.10, 1.0),
    "presentation": (0.30, 0.20, 0.30, 0.20, 1.0),
    "magazine": (0.30, 0.20, 0.20, 0.20, 1.0),
    "book": (0.50, 0.30, 0.20, 0.10, 1.1),
}


def ranker_weights(kind: str) -> tuple[float, float, float]:
    """Normalised (spatial, caption, semantic) of the candidate ranker for a type of document."""
    v, h, d, a, boost = DOCUMENT_WEIGHTS.get(kind, DOCUMENT_WEIGHTS["default"])
    parts = (min(0.6, max(0.2, v + h + d + a)), 0.4 * boost, 0.25)
    total = sum(parts)
    return parts[0] / total, parts[1] / total, parts[2] / total


# Stop words.
STOP_WORDS_EN = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "that", "the", "to", "was", "will", "with", "this", "but", "they", "have", "had", "what", "said", "each", "which", "she", "do", "how", "their")
STOP_WORDS_ZH = ("的", "了", "在", "是", "我", "有", "和", "就", "不", "人", "都", "一", "一個", "上", "也", "很", "到", "說", "要", "去", "你", "會", "著", "沒有", "看", "好", "自己", "這", "那", "裡", "把", "被")


@dataclass(frozen=True)
class Index:
    """A knowledge-base index."""

    name: str = "documents"
    vector_dimension: int = 64
    max_content: int = 10_000
    association_weight: float = 0.3
    facets: tuple[str, ...] = field(default=("file_format", "status"))


def request_weights(weights: dict[str, float]) -> dict[str, float]:
    """The weights a request may set: caption, spatial and semantic must be there and sum to 1, within 0.01; others aren't looked at."""
    needed = ("caption_weight", "spatial_weight", "semantic_weight")
    if missing := [k for k in needed if k not in weights]:
        raise ValueError(f"missing weights: {missing}")
    if abs(sum(weights[k] for k in needed) - 1) > 0.01:
        raise ValueError("caption, spatial and semantic weight must sum to 1")
    return weights
