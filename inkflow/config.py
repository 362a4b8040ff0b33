"""Parameters of the engine and their checks."""

from __future__ import annotations

from dataclasses import dataclass, field

VERSIONS, LIMITS, SCORE_MODES = ("v4", "v5"), ("min", "max"), ("fast", "slow")

#: Class input shapes (channels, height, width) by model version.
CLS_SHAPES = {"v4": (3, 48, 192), "v5": (3, 80, 160)}


def _one_of(name: str, value: str, allowed: tuple[str, ...]) -> None:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}, not {value!r}")


@dataclass(frozen=True)
class Detector:
    """Detection: input size, normalisation and turning the map into boxes."""

    limit_side_len: int = 736
    limit_type: str = "min"
    mean: tuple[float, float, float] = (0.5, 0.5, 0.5)
    std: tuple[float, float, float] = (0.5, 0.5, 0.5)
    thresh: float = 0.3
    box_thresh: float = 0.5
    max_candidates: int = 1000
    unclip_ratio: float = 1.6
    use_dilation: bool = True
    score_mode: str = "fast"
    min_side: int = 3
    line_gap: float = 10.0

    def __post_init__(self):
        _one_of("limit_type", self.limit_type, LIMITS)
        _one_of("score_mode", self.score_mode, SCORE_MODES)


@dataclass(frozen=True)
class Classifier:
    """Orientation of lines."""

    batch_num: int = 6
    thresh: float = 0.9
    labels: tuple[str, ...] = ("0", "180")


@dataclass(frozen=True)
class Recognizer:
    """Reading of lines."""

    shape: tuple[int, int, int] = (3, 48, 320)
    batch_num: int = 6
    text_score: float = 0.5


@dataclass(frozen=True)
class Config:
    """All parameters; ``batch_pool_size`` bounds the files of a streaming batch."""

    version: str = "v5"
    min_height: int = 30
    width_height_ratio: float = 8.0
    max_side_len: int = 2000
    min_side_len: int = 30
    return_word_box: bool = False
    return_single_char_box: bool = False
    batch_pool_size: int = 30
    detector: Detector = field(default_factory=Detector)
    classifier: Classifier = field(default_factory=Classifier)
    recognizer: Recognizer = field(default_factory=Recognizer)

    def __post_init__(self):
        _one_of("version", self.version, VERSIONS)
        if not 1 <= self.batch_pool_size <= 100:
            raise ValueError("batch_pool_size must be from 1 to 100")
        if self.classifier.batch_num < 1 or self.recognizer.batch_num < 1:
            raise ValueError("batch sizes must be positive")

    @property
    def cls_shape(self) -> tuple[int, int, int]:
        """Input shape of the orientation model."""
        return CLS_SHAPES[self.version]
