"""Settings of a training run, with the checks that make a wrong one fail early."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields, replace

FLIPS = ("none", "flip", "both")
SUBSAMPLING = ("classUniform", "pixelUniform")
#: What may differ between two trees of one forest.
NOT_COMPARED = ("random_seed", "device_ids", "image_cache_size", "max_samples_per_batch")


@dataclass(frozen=True)
class TrainingConfig:
    """How trees are sampled and grown."""

    trees: int = 1
    samples_per_image: int = 100
    feature_count: int = 50
    min_sample_count: int = 8
    max_depth: int = 5
    box_radius: int = 20
    region_size: int = 8
    thresholds: int = 10
    random_seed: int = 4711
    max_images: int = 0
    image_cache_size: int = 0
    max_samples_per_batch: int = 50_000
    subsampling_type: str = "classUniform"
    use_cielab: bool = True
    use_depth_filling: bool = False
    use_depth_images: bool = True
    horizontal_flipping: bool = False
    ignored_colors: tuple[str, ...] = field(default_factory=tuple)
    device_ids: tuple[int, ...] = (0,)
    acceleration_mode: str = "cpu"

    def __post_init__(self):
        if self.subsampling_type not in SUBSAMPLING:
            raise ValueError(f"unknown type of subsampling: {self.subsampling_type!r}")
        if any(not c for c in self.ignored_colors):
            raise ValueError("an ignored colour is empty")
        if 0 < self.max_images < self.image_cache_size:
            raise ValueError("max_images is smaller than the image cache")
        for name in ("trees", "samples_per_image", "feature_count", "max_depth", "box_radius", "region_size", "thresholds"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")
        if self.samples_per_image // self.trees < 1:
            raise ValueError("fewer samples for each image than trees")

    @property
    def samples_per_tree(self) -> int:
        """Samples of each image for one tree: the trees share them."""
        return self.samples_per_image // self.trees

    def equals(self, other: TrainingConfig, strict: bool = True) -> bool:
        same = {f.name for f in fields(self)} - (set() if strict else set(NOT_COMPARED))
        return all(getattr(self, n) == getattr(other, n) for n in same)

    def with_(self, **changes) -> TrainingConfig:
        return replace(self, **changes)

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, values: dict) -> TrainingConfig:
        known = {f.name: f for f in fields(cls)}
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items() if k in known})

    def __str__(self) -> str:
        return "\n".join(f"{k}: {v}" for k, v in self.to_dict().items())


def check_prediction(histogram_bias: float, write_probabilities: bool = False, output: str | None = None) -> None:
    """The limits of the settings of a prediction."""
    if not 0 <= histogram_bias < 1:
        raise ValueError(f"histogram bias {histogram_bias} is not from 0 up to 1")
    if write_probabilities and not output:
        raise ValueError("probability images need an output folder")
