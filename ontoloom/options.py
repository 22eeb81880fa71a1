"""What a caller can choose. Flags shape the plan; they never become data."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from .errors import InvalidOptions, UnsupportedProfile

# Names of the profile, of options and of their choices.
PROFILE = "mowl-d993536-v1"
CHOICES = {
    "duplicates": ("preserve", "unique"),
    "order": ("canonical", "encounter"),
    "compatibility_state": ("isolated", "scala-instance"),
    "backend": ("auto", "native", "python"),
}


@dataclass(frozen=True)
class Options:
    """``backend`` is taken for the sake of existing callers; every choice of it runs on Spark."""

    profile: str = PROFILE
    bidirectional_taxonomy: bool = False
    only_taxonomy: bool = False
    include_literals: bool = False
    duplicates: str = "preserve"
    order: str = "canonical"
    compatibility_state: str = "isolated"
    backend: str = "auto"

    def __post_init__(self):
        if self.profile != PROFILE:
            raise UnsupportedProfile(f"no such profile: {self.profile!r}", profile=repr(self.profile))
        for name in ("bidirectional_taxonomy", "only_taxonomy", "include_literals"):
            if type(getattr(self, name)) is not bool:
                raise InvalidOptions(f"{name} must be a bool, not {getattr(self, name)!r}")
        for name, allowed in CHOICES.items():
            if not isinstance(getattr(self, name), str) or getattr(self, name) not in allowed:
                raise InvalidOptions(f"{name} must be one of {', '.join(allowed)}, not {getattr(self, name)!r}")

    def to_dict(self) -> dict:
        return asdict(self)

    def semantic(self) -> dict:
        """What results depend on: all but the backend."""
        return {k: v for k, v in asdict(self).items() if k != "backend"}
