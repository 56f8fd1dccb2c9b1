"""What subducting plates carry down and release: water, carbon and melt at trench samples.

Trench samples have ``seafloor_age_myr``, ``conv_rate_orth_cm_yr``, ``slab_dip_deg`` and ``sediment_m``,
the plate's ``thickness_m`` and ``brittle_m`` (see :func:`plate_thickness`), and what comes in with the
plate, in Mt/m2: ``water_`` and ``carbon_`` with the names of the reservoirs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import physics as P
from tessera.functions.sphere import clip
from tessera.operators.spatial import lookup_nearest

c = F.col
# Fixed values of the model: by reservoir the lookup table, the temperature it is read at (sediments,
# volcanics, Moho), kg/m3 of one per cent; carbon's share of carbon dioxide.
WATER = {"lithosphere": (3, 2, 35.0), "crust": (1, 1, 30.0), "sediment": (0, 0, 17.0)}
CARBON = {"lithosphere": (7, 2, 35.0), "crust": (7, 2, 35.0), "serpentinite": (5, 1, 35.0), "sediment": (4, 0, 35.0), "organic_sediments": (4, 0, 35.0)}
CARBON_SHARE = 12.0107 / 44.0095
CRUST_M, INTRUSIVE_M, VOLCANIC_M = 7e3, 12e3, 450.0
MANTLE_DENSITY, ARC_DEPTH_M = 3300.0, 125e3


def plate_thickness(df: DataFrame, isotherm: float = 1150.0, age: str = "seafloor_age_myr", out: str = "thickness_m") -> DataFrame:
    """Depth of an isotherm below sea floor of an age, by the plate-cooling series, in a table of two
    million years by a kilometre that is interpolated by age. Older floor takes the last row."""
    spark, plate, top, base = df.sparkSession, 125e3, 0.0, 1350.0
    nodes = spark.range(0, 183, 2).select(c("id").cast("double").alias("_age")).crossJoin(spark.range(0, 126).select((c("id") * 1000.0).alias("z")))  # the table's axes
    decay = lambda n: F.exp(-0.804e-6 * (n * n) * (math.pi**2) * c("_age") * 3.15576e13 / plate**2)
    series = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.lit(0.0), lambda s, n: s + 2 / (n * math.pi) * F.sin(n * math.pi * c("z") / plate) * decay(n))
    heat = top + (base - top) * (c("z") / plate + series)
    table = nodes.withColumn("heat", heat).where(c("heat") >= isotherm).groupBy("_age").agg(F.min("z").alias("_depth"))
    low = F.least(F.floor(c(age) / 2), F.lit(90)) * 2.0
    one = df.withColumn("_age", low).join(F.broadcast(table), "_age", "left").withColumnsRenamed({"_age": "_low", "_depth": "_d0"})
    two = one.withColumn("_age", c("_low") + 2).join(F.broadcast(table), "_age", "left")
    w = F.least((c(age) - c("_low")) / 2, F.lit(1.0))
    return two.withColumn(out, c("_d0") + w * (F.coalesce("_depth", "_d0") - c("_d0"))).drop("_low", "_d0", "_age", "_depth")


def bending_serpentinite_water(brittle_m: Column, dip: Column) -> Column:
    """Water in Mt/m2 of the mantle that is hydrated where the plate bends."""
    return (brittle_m - 8e3) * (0.13 * (clip(dip, 0, 90) / 9 / 100)) * 2900 * 1e-9


def _capacities(df: DataFrame, lookup: DataFrame, kinds: dict[str, tuple[int, int, float]], sizes: dict[str, Column]) -> DataFrame:
    """``_c_`` columns: what each reservoir can hold at the arc's depth, in Mt/m2."""
    phi = P.thermal_parameter(c("seafloor_age_myr"), clip(c("conv_rate_orth_cm_yr"), 0) * 100, clip(c("slab_dip_deg"), 1, 90))
    temperatures = P.slab_temperatures(phi + 1e-12)
    read: dict[tuple[int, int], str] = {}
    out = df
    for table, at, _ in kinds.values():
        if (table, at) not in read:
            read[table, at] = f"_wt{table}_{at}"
            out = lookup_nearest(out, lookup, table, F.lit(P.MOHO_PRESSURE_BAR), temperatures[at] + 273.14, read[table, at])
    out = out.withColumns({f"_c_{k}": c(read[table, at]) * per * sizes[k] * 1e-9 for k, (table, at, per) in kinds.items()})
    return out.drop(*read.values())


def _released(df: DataFrame, what: str, incoming: dict[str, Column]) -> DataFrame:
    new = {}
    for k, value in incoming.items():
        new[f"subduction_{what}_flux_{k}"] = value
        new[f"slab_{what}_outflux_{k}"] = P.stored(c(f"_c_{k}"), value)[1]
    total = None
    for k in incoming:
        total = new[f"slab_{what}_outflux_{k}"] if total is None else total + new[f"slab_{what}_outflux_{k}"]
    return df.withColumns(new | {f"total_slab_{what}_outflux": total}).drop(*[f"_c_{k}" for k in incoming])


def slab_water_storage(df: DataFrame, lookup: DataFrame) -> DataFrame:
    """Adds for each water reservoir what is subducted and what leaves the slab, in Mt/m2, and the total
    that leaves; NULL where something that a value needs is unknown."""
    sizes = {"lithosphere": c("thickness_m") - CRUST_M, "crust": F.lit(CRUST_M), "sediment": c("sediment_m")}
    bent = bending_serpentinite_water(c("brittle_m"), clip(c("slab_dip_deg"), 1, 90))
    incoming = {"lithosphere": c("water_lithosphere") + bent, "crust": c("water_crust"), "sediment": c("water_sediment")}
    return _released(_capacities(df, lookup, WATER, sizes), "water", incoming)


def slab_carbon_storage(df: DataFrame, lookup: DataFrame) -> DataFrame:
    """The same for the five carbon reservoirs, carbon dioxide counted as carbon."""
    sizes = {
        "lithosphere": c("thickness_m") - c("sediment_m") - CRUST_M, "crust": F.lit(INTRUSIVE_M), "serpentinite": F.lit(VOLCANIC_M),
        "sediment": c("sediment_m"), "organic_sediments": c("sediment_m"),
    }
    held = _capacities(df, lookup, CARBON, {k: v * CARBON_SHARE for k, v in sizes.items()})
    return _released(held, "carbon", {k: c(f"carbon_{k}") for k in CARBON})


def melting_rate(df: DataFrame, melt: DataFrame, water: str = "total_slab_water_outflux") -> DataFrame:
    """``melting_rate`` in Mt/m2: the mean melt fraction, over the pressures of ``melt`` (p_idx, t_idx,
    value in per cent), at the water content that leaves the slab for the mantle wedge.

    ``t_idx`` numbers steps of 1/80 per cent of water; beyond the table its last step holds. The table
    stands for the melting solver, has one row a pressure and step, and is averaged before the join.
    """
    per_cent = 100 * c(water) * 1e6 / (MANTLE_DENSITY * ARC_DEPTH_M * 1e-3)
    mean = melt.groupBy(c("t_idx").alias("_step")).agg(F.avg("value").alias("_melt"))
    last = F.lit(melt.agg(F.max("t_idx").alias("n")).first()["n"] or 0)
    step = F.when(per_cent.isNotNull(), F.least(F.greatest(F.floor(per_cent * 80 + 0.5), F.lit(0)), last)).cast("int")
    found = df.withColumn("_step", step).join(mean, "_step", "left")
    return found.withColumn("melting_rate", c("_melt") / 100 * MANTLE_DENSITY * ARC_DEPTH_M * 1e-9).drop("_step", "_melt")


#: The columns of :func:`outflux_features`, in t/m/yr.
FLUXES = [f"{a}_water_{b}_{k}" for k in WATER for a, b in (("subduction", "flux"), ("slab", "outflux"))] + ["total_slab_water_outflux", "melting_rate"]
FLUXES += [f"{a}_carbon_{b}_{k}" for k in CARBON for a, b in (("subduction", "flux"), ("slab", "outflux"))] + ["total_slab_carbon_outflux"]


def outflux_features(df: DataFrame, lookup: DataFrame, melt: DataFrame) -> DataFrame:
    """All water, carbon and melt fluxes of trench samples in t/m/yr: Mt/m2 times the convergence rate."""
    out = slab_carbon_storage(melting_rate(slab_water_storage(df, lookup), melt), lookup)
    return out.withColumns({k: P.outflux(c(k), c("conv_rate_orth_cm_yr")) for k in FLUXES})
