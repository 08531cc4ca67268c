"""What a table's columns mean: kinds and roles, declared or derived."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class TableSpec:
    """Column kinds and roles of one table."""

    continuous: list[str] = field(default_factory=list)
    discrete: list[str] = field(default_factory=list)
    binary: list[str] = field(default_factory=list)
    target: str | None = None
    keys: list[str] = field(default_factory=list)
    sensitive: list[str] = field(default_factory=list)
    mixed: dict[str, list[float]] = field(default_factory=dict)
    id_col: str | None = None

    def kind(self, column: str) -> str:
        for name in ("continuous", "discrete", "binary"):
            if column in getattr(self, name):
                return name
        return "mixed" if column in self.mixed else "unknown"

    @property
    def columns(self) -> list[str]:
        return [*self.continuous, *self.discrete, *self.binary]

    @classmethod
    def positional(cls, names: list[str], continuous: int, discrete: int) -> "TableSpec":
        """First the continuous columns, then the discrete ones, the last column is the target."""
        return cls(names[:continuous], names[continuous : continuous + discrete], target=names[-1])
