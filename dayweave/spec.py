"""Names of the columns that play each role, so the operators run on any table."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Measure:
    """One score: its column, the column of its daily mean, its label in series names."""

    column: str
    mean: str
    label: str


@dataclass(frozen=True)
class PanelSpec:
    """Which columns hold the panel keys, the account, the time, the day and the scores.

    An account is identified by (panel, account): the same name may occur in several
    panels and is a different series in each.
    """

    panel: tuple[str, ...]
    account: str
    time: str
    measures: tuple[Measure, ...]
    day: str = "day"

    @property
    def series(self) -> list[str]:
        return [*self.panel, self.account]

    @property
    def account_day(self) -> list[str]:
        return [*self.panel, self.account, self.day]

    @property
    def means(self) -> list[str]:
        return [m.mean for m in self.measures]

    def measure(self, label: str) -> Measure:
        return next(m for m in self.measures if m.label == label)

    def only(self, *labels: str) -> PanelSpec:
        """The same roles with only the scores of these labels."""
        return replace(self, measures=tuple(m for m in self.measures if m.label in labels))


SCORED_POSTS = PanelSpec(
    panel=("CountryElection", "type_of_account"),
    account="user_name",
    time="created_at_seconds",
    day="created_at_seconds2",
    measures=(
        Measure("Authenticity", "mean_Auth", "Spon"),
        Measure("Analytic", "mean_An", "An"),
    ),
)
