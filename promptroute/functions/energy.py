"""Energy and carbon figures as column expressions (kWh and kg)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from promptroute.settings import BASELINE_KWH, CO2_KG_PER_KWH, ENERGY_PER_GB_KWH


def energy_kwh(size_gb: Column) -> Column:
    return size_gb * F.lit(ENERGY_PER_GB_KWH)


def co2_kg(energy: Column) -> Column:
    return energy * F.lit(CO2_KG_PER_KWH)


def _baseline(base: Column | None) -> Column:
    return F.lit(BASELINE_KWH) if base is None else base


def _if_known(energy: Column, value: Column) -> Column:
    """``greatest`` and ``least`` skip NULL, so an unknown energy must be kept unknown."""
    return F.when(energy.isNotNull(), value)


def saved_kwh(energy: Column, base: Column | None = None) -> Column:
    """Energy saved against the baseline, never negative."""
    return _if_known(energy, F.greatest(F.lit(0.0), _baseline(base) - energy))


def saved_pct(energy: Column, base: Column | None = None) -> Column:
    """Share of the baseline saved, in percent; 0 if there is no baseline."""
    b = _baseline(base)
    share = F.when(b > 0, (b - energy) / F.nullif(b, F.lit(0.0)) * 100).otherwise(0.0)
    return _if_known(energy, F.greatest(F.lit(0.0), share))


def green_score(energy: Column, base: Column | None = None) -> Column:
    """0-100, higher is better, rounded half to even; 0 if there is no baseline."""
    b = _baseline(base)
    raw = F.bround(F.lit(100.0) * (1 - energy / F.nullif(b, F.lit(0.0))))
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)).cast("int")
    return _if_known(energy, F.when(b > 0, score).otherwise(0))


def energy_report(size_gb: Column, base_size_gb: Column) -> Column:
    """All figures of one model against any baseline model, percent to one digit."""
    energy, base = energy_kwh(size_gb), energy_kwh(base_size_gb)
    kwh = saved_kwh(energy, base)
    pct = F.when(base > 0, F.bround(kwh / F.nullif(base, F.lit(0.0)) * 100, 1)).otherwise(0.0)
    return F.struct(
        energy.alias("energy_kwh"),
        co2_kg(energy).alias("co2_kg"),
        green_score(energy, base).alias("green_score"),
        _if_known(energy, pct).alias("energy_saved_pct"),
        kwh.alias("energy_saved_kwh"),
    )


def confidence_band(confidence: Column) -> Column:
    return F.when(confidence > 0.9, "High").when(confidence > 0.7, "Medium").otherwise("Low")


def green_band(score: Column) -> Column:
    return F.when(score > 75, "Excellent").when(score > 50, "Good").otherwise("Fair")
