"""Feature specification carried beside a DataFrame."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .operators.shape import numeric_cols


@dataclass(frozen=True)
class FeatureSpec:
    """``label ~ .`` minus id columns: which columns are label, ids and predictors."""

    label: str
    ids: tuple[str, ...] = ()
    features: tuple[str, ...] = field(default_factory=tuple)
    nominal: tuple[str, ...] = ()

    @classmethod
    def from_df(cls, df: DataFrame, label: str, ids: Sequence[str] = (), exclude: Sequence[str] = ()) -> "FeatureSpec":
        """Schema set difference (no job): numeric columns are features, other non-id columns nominal."""
        skip = {label, *ids, *exclude}
        num = [c for c in numeric_cols(df) if c not in skip]
        nom = [c for c in df.columns if c not in skip and c not in num]
        return cls(label=label, ids=tuple(ids), features=tuple(num), nominal=tuple(nom))

    def select(self, df: DataFrame) -> DataFrame:
        return df.select(*self.ids, self.label, *self.features, *self.nominal)
