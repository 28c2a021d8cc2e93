"""One frozen set of thresholds and caps, handed to every operator."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class MatchConfig:
    semantic: float = 0.75
    partial: float = 0.60
    required: float = 0.88
    additional: float = 0.60
    clustering: float = 0.78
    domain_bonus_max: int = 8
    additional_bonus_max: int = 10
    shortlist: int = 80
    batch_size: int = 25
    top_k: int = 5
    max_pages: int = 5
    min_text_chars: int = 300
    max_files: int = 100
    max_file_bytes: int = 10 * 1024 * 1024
    as_of: str = "2024-01"  # what "Present" means; always explicit so that reruns agree
    rank_bucket: int = 100_000  # ids per bucket when one huge group has to be ordered

    @property
    def floor(self) -> float:
        """Smallest similarity that can still round up to a configured threshold at three digits."""
        return min(self.semantic, self.partial, self.required, self.additional) - 0.0005

    @property
    def as_of_index(self) -> int:
        year, month = self.as_of.split("-")
        return int(year) * 12 + int(month)


DEFAULT = MatchConfig()
