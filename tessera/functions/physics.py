"""Physical properties of plates, slabs and scores as column expressions. NULL in gives NULL out."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.sphere import clip

# Fixed values of the model.
RHO_WATER = 1020.0
SURFACE_POROSITY, POROSITY_DECAY_M = 0.66, 1333.0
BOUND_FRACTION, RHO_SEDIMENT = 0.07, 1700.0
LAYERS_M = (300.0, 300.0, 1400.0, 5000.0)
#: A and b of a / (half rate + b), fitted beforehand to the low and to the high published
#: water contents of the mantle lithosphere by spreading rate.
MANTLE_LOW, MANTLE_HIGH = (362099.0448, 1.1506428), (273166.6559, 0.8576631)
ARC_DEPTH_KM = 125.0
MOHO_PRESSURE_BAR = 125e3 * 9.81 * 3500e3 * 1e-8


def carbon_density(carbonate_m: Column, crustal: Column) -> tuple[Column, Column]:
    """Carbonate and total carbon in t/m2."""
    carbonate = carbonate_m * 0.7 * 0.41 * 2710.0 * (12.0 / 100.1) * 1e-3
    return carbonate, carbonate + crustal


def slab_flux(rate_cm: Column, thickness_m: Column) -> Column:
    return rate_cm * 0.01 * thickness_m


def material_flux(quantity: Column, rate_cm: Column) -> Column:
    return clip(quantity * rate_cm * 0.01, 0)


def sedimentary_water(thickness_m: Column) -> tuple[Column, Column]:
    """Pore and bound water in m."""
    pore = clip(POROSITY_DECAY_M * SURFACE_POROSITY * (1 - F.exp(-thickness_m / POROSITY_DECAY_M)), 0)
    return pore, clip(BOUND_FRACTION * (thickness_m - pore) * RHO_SEDIMENT / RHO_WATER, 0)


def _layers(age: Column) -> list[tuple[Column, Column]]:
    """Porosity and grain density of the four crustal layers at a sea-floor age."""
    # fixed values: published fits of porosity (%) and grain density (g/cm3) by layer to the crust's age
    macro, log = 13.01 - 5.625 * F.log10(age), F.log10(age)
    porosity = [7.8 + macro, 5.1 + macro / 2, F.lit(2.2 + 0.84), F.lit(0.7)]
    grain = [3.01 - 0.0631 * log, 3.01 - 0.5 * 0.0631 * log, F.lit(2.98), F.lit(2.99)]
    return list(zip(porosity, grain))


def _bulk(porosity: Column, grain: Column, fixed: bool) -> Column:
    """Bulk density. ``fixed`` mixes water and grains by porosity; the observed form swaps the two."""
    part, rest = (porosity, grain) if fixed else (grain, porosity)
    return 0.01 * part * 1.02 + (1 - 0.01 * part) * rest


def crustal_pore_water(age: Column, fixed: bool = False) -> Column:
    total = F.lit(0.0)
    for (porosity, grain), height in zip(_layers(age), LAYERS_M):
        bulk = _bulk(porosity, grain, fixed)
        total = total + porosity * 1.02 / bulk / 100 * bulk * 1e3 * height
    return clip(total / RHO_WATER, 0)


def crustal_bound_water(age: Column, fixed: bool = False) -> Column:
    # fixed values: published bound water (%) by layer
    macro = 13.01 - 5.625 * F.log10(age)
    total = F.lit(0.0)
    for i, ((porosity, grain), height) in enumerate(zip(_layers(age), LAYERS_M)):
        bulk = _bulk(porosity, grain, fixed)
        own = [103.1 - 34.27 * grain + 0.17 * (1.031 - macro / (1 + i)), F.lit(1.76), F.lit(0.79)][max(0, i - 1)]
        total = total + own * (1 - 0.01 * (porosity * 1.02 / bulk)) / 100 * bulk * 1e3 * height
    return clip(total / RHO_WATER, 0)


def mantle_lithosphere_water(half_rate: Column) -> Column:
    curves = [a / F.nullif(half_rate + b, F.lit(0.0)) for a, b in (MANTLE_LOW, MANTLE_HIGH)]
    return clip(0.5 * (curves[0] + curves[1]) / RHO_WATER, 0)


def base_lithosphere_water(half_rate: Column) -> Column:
    # fixed values: a published line of serpentinised mantle by spreading rate
    u = F.abs(half_rate)
    return clip((0.8807 + 0.262 * (u - 3.0)) / F.nullif(u * 1e-2, F.lit(0.0)) * 1e3 / RHO_WATER, 0)


def water_thickness(sediment_m: Column, age: Column, spreading_km_myr: Column) -> dict[str, Column]:
    """Six parts in m, and their sum over those that are known."""
    half = spreading_km_myr * 0.05
    pore, bound = sedimentary_water(sediment_m)
    parts = {
        "sedimentary_pore": pore, "sedimentary_bound": bound, "crustal_pore": crustal_pore_water(age), "crustal_bound": crustal_bound_water(age),
        "mantle_lithosphere": mantle_lithosphere_water(half), "base_lithosphere": base_lithosphere_water(half),
    }
    total = F.lit(0.0)
    for c in parts.values():
        total = total + F.coalesce(c, F.lit(0.0))
    return parts | {"total": total}


def plate_density(thickness_m: Column) -> Column:
    """Mean density of 7 km crust, 43 km spinel field and the rest, over 105 km."""
    crust = F.least(thickness_m, F.lit(7e3))
    spinel = F.least(thickness_m - crust, F.lit(43e3))
    garnet = thickness_m - crust - spinel
    rho = 0.5 * (3370 + garnet * (3340 - 3370) / 55e3 + 3340)
    return F.when(thickness_m.isNotNull(), (2900 * crust + 3330 * spinel + rho * garnet) / 105e3)


def slab_dip_predictors(d: dict[str, Column]) -> dict[str, Column]:
    """Nine predictors from obliquity, rates in cm/yr, spreading in km/Myr, age and thickness."""
    vel, trench = d["conv_rate_orth"] * 1e-2, d["trench_vel_orth"] * 1e-2
    ratio = (vel + trench) / (vel + 1e-22)
    ratio = clip(F.when(d["plate_vel"] < 0, -ratio).otherwise(ratio), 0, 1)
    return {
        "angle": d["obliquity"], "total_vel": d["conv_rate"] * 1e-2, "vel": vel, "trench_vel": trench, "vratio": ratio,
        "slab_age": d["age"], "slab_thickness": d["thickness"], "spreading_rate": d["spreading"] * 1e-3, "density": plate_density(d["thickness"]),
    }


def arc_trench_distance(dip_deg: Column) -> Column:
    return ARC_DEPTH_KM / F.tan(F.radians(dip_deg))


def thermal_parameter(age: Column, velocity: Column, dip_deg: Column) -> Column:
    return age * 1e6 * velocity * 1e-5 * F.sin(F.radians(dip_deg))


def slab_temperatures(phi: Column) -> tuple[Column, Column, Column]:
    """Sediments, volcanics and Moho in degrees Celsius."""
    # fixed values: published fits to the thermal parameter
    return 1331.0 - 58.6 * F.log(phi), 1303.0 - 60.23 * F.log(phi), 1622.0 - 132.5 * F.log(phi)


def stored(capacity: Column, incoming: Column) -> tuple[Column, Column]:
    """What stays in the slab, and what leaves it."""
    known = capacity.isNotNull() & incoming.isNotNull()
    remaining = F.when(known, F.least(capacity, incoming))
    return remaining, clip(incoming - remaining, 0)


def outflux(value: Column, rate_cm: Column) -> Column:
    return value * clip(rate_cm, 0) * 1e6


def entropy_bits(p: Column) -> Column:
    q = clip(p, 1e-15, 1 - 1e-15)
    return -(q * F.log2(q) + (1 - q) * F.log2(1 - q))


def uncertainty(entropy_norm: Column, variance_norm: Column) -> Column:
    return 0.5 * entropy_norm + 0.5 * variance_norm


def max_shear(d11: Column, d12: Column, d21: Column, d22: Column, azimuths: int = 100) -> Column:
    """Largest shear rate over evenly spaced azimuths in [0, pi]."""
    step = math.pi / (azimuths - 1)

    def at(i: Column) -> Column:
        c, s = F.cos(i * step), F.sin(i * step)
        return -(c * (d12 * c - d11 * s) + s * (d22 * c - d21 * s))

    return F.array_max(F.transform(F.sequence(F.lit(0), F.lit(azimuths - 1)), at))


def strain_scale(rate: Column) -> Column:
    return rate * 1e15


def preserved(p: Column, score: Column) -> Column:
    return p * score


def display_name(name: Column) -> Column:
    """Underscores to blanks, first letter in upper and the rest of the first word as it is."""
    s = F.regexp_replace(name, "_", " ")
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 1 << 20))


def clean_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, r"\s*\(.*?\)", ""))
