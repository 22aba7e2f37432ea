"""What an index is made of, fixed at its creation."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class IndexConfig:
    index_fields: tuple[str, ...]
    filter_fields: tuple[str, ...] = ()
    k: int = 100
    stop_words: tuple[str, ...] = ("a", "the", "and")
    #: "accumulate": all texts of an id in one batch count for its last version; "last": that version's alone.
    duplicate_policy: str = "accumulate"
    go_float_format: bool = False
    single_prefixes: int = 3
    single_fuzzy: int = 3
    multi_prefixes: int = 40
    multi_fuzzy: int = 10
    prefix_cap: int = 400
    fuzzy_length: int = field(default=4)  # shorter terms have no fuzzy neighbours

    def __post_init__(self):
        if self.k < 0:
            raise ValueError("k is negative")
        if self.duplicate_policy not in ("accumulate", "last"):
            raise ValueError(f"duplicate_policy {self.duplicate_policy!r}")
        for name in ("index_fields", "filter_fields", "stop_words"):
            object.__setattr__(self, name, tuple(getattr(self, name)))
