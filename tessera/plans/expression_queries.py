"""Queries of the column expressions (S*) and of small row-wise operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import physics as P
from tessera.functions import sphere as S
from tessera.plans.registry import query

c = F.col


def _out(df: DataFrame, key: str, places: int = 6, **columns) -> DataFrame:
    return df.select(key, *[(F.round(v, places) if not str(k).startswith("s_") else v).alias(k) for k, v in columns.items()])


CLIP = "CASE WHEN ({0}) IS NULL THEN NULL ELSE greatest(({0}), 0.0) END"


def _clip(x: str) -> str:
    return CLIP.format(x)


@query("s01_names", "fx_segment", sql="""
WITH n AS (SELECT segment_id, lower(replace(type, ' ', '_')) || ' (' || name || ') rate (cm/yr)' AS f FROM fx_segment)
SELECT segment_id, upper(substr(replace(f, '_', ' '), 1, 1)) || substr(replace(f, '_', ' '), 2) AS display_name,
  trim(regexp_replace(f, '\\s*\\(.*?\\)', '', 'g')) AS clean_name FROM n""")
def s01_names(seg):
    f = F.concat(F.lower(F.replace("type", F.lit(" "), F.lit("_"))), F.lit(" ("), c("name"), F.lit(") rate (cm/yr)"))
    return seg.select("segment_id", P.display_name(f).alias("display_name"), P.clean_name(f).alias("clean_name"))


HAV = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))))"


@query("s02_haversine", "fx_segment", sql=f"SELECT segment_id, round({HAV.format(lon1='lon1', lat1='lat1', lon2='lon2', lat2='lat2')}, 3) AS km FROM fx_segment")
def s02_haversine(seg):
    return _out(seg, "segment_id", 3, km=S.haversine_km(c("lon1"), c("lat1"), c("lon2"), c("lat2")))


@query("s03_xyz", "fx_point", sql="""
WITH v AS (SELECT point_id, cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y, sin(radians(lat)) AS z FROM fx_point)
SELECT point_id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, round(degrees(atan2(y, x)), 6) AS lon, round(degrees(asin(z)), 6) AS lat FROM v""")
def s03_xyz(p):
    x, y, z = S.xyz(c("lon"), c("lat"))
    lon, lat = S.lonlat(x, y, z)
    return _out(p, "point_id", x=x, y=y, z=z, lon=lon, lat=lat)


@query("s04_arc_km", "fx_trench", sql="SELECT trench_id, round(radians(arc_len_deg) * 6371.0, 6) AS arc_len_km FROM fx_trench")
def s04_arc_km(t):
    return _out(t, "trench_id", arc_len_km=S.arc_degrees_to_km(c("arc_len_deg")))


@query("s05_carbon_density", "fx_trench", sql="""
SELECT trench_id, round(sediment_m * 0.7 * 0.41 * 2710.0 * (12.0 / 100.1) * 1e-3, 6) AS carbonate,
  round(sediment_m * 0.7 * 0.41 * 2710.0 * (12.0 / 100.1) * 1e-3 + slab_dip_deg, 6) AS total FROM fx_trench""")
def s05_carbon_density(t):
    carbonate, total = P.carbon_density(c("sediment_m"), c("slab_dip_deg"))
    return _out(t, "trench_id", carbonate=carbonate, total=total)


@query("s06_slab_flux", "fx_trench", sql="SELECT trench_id, round(conv_rate_orth_cm_yr * 0.01 * (seafloor_age_myr * 500), 6) AS slab_flux FROM fx_trench")
def s06_slab_flux(t):
    return _out(t, "trench_id", slab_flux=P.slab_flux(c("conv_rate_orth_cm_yr"), c("seafloor_age_myr") * 500))


@query("s07_material_fluxes", "fx_trench", sql=f"""
SELECT trench_id, round({_clip('sediment_m * conv_rate_orth_cm_yr * 0.01')}, 6) AS sediment,
  round({_clip('seafloor_age_myr * conv_rate_orth_cm_yr * 0.01')}, 6) AS crustal_carbon,
  round({_clip('slab_dip_deg * conv_rate_orth_cm_yr * 0.01')}, 6) AS carbonate_carbon,
  round({_clip('(seafloor_age_myr + slab_dip_deg) * conv_rate_orth_cm_yr * 0.01')}, 6) AS total_carbon,
  round({_clip('spreading_km_myr * conv_rate_orth_cm_yr * 0.01')}, 6) AS water FROM fx_trench""")
def s07_material_fluxes(t):
    rate = c("conv_rate_orth_cm_yr")
    of = {"sediment": c("sediment_m"), "crustal_carbon": c("seafloor_age_myr"), "carbonate_carbon": c("slab_dip_deg"), "total_carbon": c("seafloor_age_myr") + c("slab_dip_deg"), "water": c("spreading_km_myr")}
    return _out(t, "trench_id", **{k: P.material_flux(v, rate) for k, v in of.items()})


PORE = _clip("1333.0 * 0.66 * (1 - exp(-sediment_m / 1333.0))")
BOUND = _clip(f"0.07 * (sediment_m - ({PORE})) * 1700.0 / 1020.0")
MACRO = "(13.01 - 5.625 * log10(seafloor_age_myr))"
PHI = [f"(7.8 + {MACRO})", f"(5.1 + {MACRO} / 2)", "3.04", "0.7"]
GRAIN = ["(3.01 - 0.0631 * log10(seafloor_age_myr))", "(3.01 - 0.5 * 0.0631 * log10(seafloor_age_myr))", "2.98", "2.99"]
HEIGHT = ["300.0", "300.0", "1400.0", "5000.0"]
BULK = [f"(0.01 * {g} * 1.02 + (1 - 0.01 * {g}) * {p})" for g, p in zip(GRAIN, PHI)]
OWN = [f"(103.1 - 34.27 * {GRAIN[0]} + 0.17 * (1.031 - {MACRO}))", f"(103.1 - 34.27 * {GRAIN[1]} + 0.17 * (1.031 - {MACRO} / 2))", "1.76", "0.79"]
CRUST_PORE = _clip("(" + " + ".join(f"{p} * 1.02 / 100 * 1e3 * {h}" for p, h in zip(PHI, HEIGHT)) + ") / 1020.0")
CRUST_BOUND = _clip("(" + " + ".join(f"{o} * (1 - 0.01 * ({p} * 1.02 / {b})) / 100 * {b} * 1e3 * {h}" for o, p, b, h in zip(OWN, PHI, BULK, HEIGHT)) + ") / 1020.0")
HALF = "(spreading_km_myr * 0.05)"
MANTLE = _clip(f"0.5 * (362099.0448 / ({HALF} + 1.1506428) + 273166.6559 / ({HALF} + 0.8576631)) / 1020.0")
BASE = _clip(f"(0.8807 + 0.262 * (abs({HALF}) - 3.0)) / nullif(abs({HALF}) * 1e-2, 0) * 1e3 / 1020.0")


@query("s09_sedimentary_water", "fx_trench", sql=f"SELECT trench_id, round({PORE}, 6) AS pore, round({BOUND}, 6) AS bound FROM fx_trench")
def s09_sedimentary_water(t):
    pore, bound = P.sedimentary_water(c("sediment_m"))
    return _out(t, "trench_id", pore=pore, bound=bound)


@query("s10_crustal_pore_water", "fx_trench", sql=f"SELECT trench_id, round({CRUST_PORE}, 5) AS water_m FROM fx_trench")
def s10_crustal_pore_water(t):
    return _out(t, "trench_id", 5, water_m=P.crustal_pore_water(c("seafloor_age_myr")))


@query("s11_crustal_bound_water", "fx_trench", sql=f"SELECT trench_id, round({CRUST_BOUND}, 5) AS water_m FROM fx_trench")
def s11_crustal_bound_water(t):
    return _out(t, "trench_id", 5, water_m=P.crustal_bound_water(c("seafloor_age_myr")))


@query("s12_mantle_water", "fx_trench", sql=f"SELECT trench_id, round({MANTLE}, 6) AS water_m FROM fx_trench")
def s12_mantle_water(t):
    return _out(t, "trench_id", water_m=P.mantle_lithosphere_water(c("spreading_km_myr") * 0.05))


@query("s13_base_water", "fx_trench", sql=f"SELECT trench_id, round({BASE}, 6) AS water_m FROM fx_trench")
def s13_base_water(t):
    return _out(t, "trench_id", water_m=P.base_lithosphere_water(c("spreading_km_myr") * 0.05))


@query("s14_water_thickness", "fx_trench", sql="SELECT trench_id, round(" + " + ".join(f"coalesce({x}, 0.0)" for x in (PORE, BOUND, CRUST_PORE, CRUST_BOUND, MANTLE, BASE)) + ", 5) AS total FROM fx_trench")
def s14_water_thickness(t):
    return _out(t, "trench_id", 5, total=P.water_thickness(c("sediment_m"), c("seafloor_age_myr"), c("spreading_km_myr"))["total"])


THICK = "(seafloor_age_myr * 700)"
DENSITY = f"((2900 * least({THICK}, 7e3) + 3330 * least({THICK} - least({THICK}, 7e3), 43e3) + 0.5 * (3370 + ({THICK} - least({THICK}, 7e3) - least({THICK} - least({THICK}, 7e3), 43e3)) * (3340 - 3370) / 55e3 + 3340) * ({THICK} - least({THICK}, 7e3) - least({THICK} - least({THICK}, 7e3), 43e3))) / 105e3)"
VRATIO = "(conv_rate_orth_cm_yr * 1e-2 + (slab_dip_deg - 40) * 1e-2) / (conv_rate_orth_cm_yr * 1e-2 + 1e-22)"


@query("s15_slab_dip_predictors", "fx_trench", sql=f"""
SELECT trench_id, obliquity_deg AS angle, round(conv_rate_cm_yr * 1e-2, 6) AS total_vel, round(conv_rate_orth_cm_yr * 1e-2, 6) AS vel,
  round((slab_dip_deg - 40) * 1e-2, 6) AS trench_vel,
  round(least(greatest(CASE WHEN obliquity_deg < 0 THEN -({VRATIO}) ELSE {VRATIO} END, 0.0), 1.0), 6) AS vratio,
  seafloor_age_myr AS slab_age, {THICK} AS slab_thickness, round(spreading_km_myr * 1e-3, 6) AS spreading_rate, round({DENSITY}, 5) AS density FROM fx_trench""")
def s15_slab_dip_predictors(t):
    d = {"obliquity": c("obliquity_deg"), "conv_rate": c("conv_rate_cm_yr"), "conv_rate_orth": c("conv_rate_orth_cm_yr"), "trench_vel_orth": c("slab_dip_deg") - 40, "plate_vel": c("obliquity_deg"), "spreading": c("spreading_km_myr"), "age": c("seafloor_age_myr"), "thickness": c("seafloor_age_myr") * 700}
    return t.select("trench_id", *[F.round(v, 5 if k == "density" else 6).alias(k) for k, v in P.slab_dip_predictors(d).items()])


@query("s16_plate_density", "fx_trench", sql=f"SELECT trench_id, round({DENSITY}, 5) AS density FROM fx_trench")
def s16_plate_density(t):
    return _out(t, "trench_id", 5, density=P.plate_density(c("seafloor_age_myr") * 700))


@query("s17_arc_trench_distance", "fx_trench", sql="SELECT trench_id, round(125.0 / tan(radians(slab_dip_deg)), 6) AS km FROM fx_trench")
def s17_arc_trench_distance(t):
    return _out(t, "trench_id", km=P.arc_trench_distance(c("slab_dip_deg")))


PHI_SQL = "(seafloor_age_myr * 1e6 * (CASE WHEN conv_rate_orth_cm_yr < 0 THEN 0 ELSE conv_rate_orth_cm_yr END * 100) * 1e-5 * sin(radians(slab_dip_deg)))"


@query("s18_thermal_parameter", "fx_trench", sql=f"SELECT trench_id, round({PHI_SQL}, 5) AS phi FROM fx_trench")
def s18_thermal_parameter(t):
    return _out(t, "trench_id", 5, phi=P.thermal_parameter(c("seafloor_age_myr"), S.clip(c("conv_rate_orth_cm_yr"), 0) * 100, c("slab_dip_deg")))


@query("s19_slab_temperatures", "fx_trench", sql=f"""
SELECT trench_id, round(1331.0 - 58.6 * ln({PHI_SQL} + 1e-12), 5) AS sediments, round(1303.0 - 60.23 * ln({PHI_SQL} + 1e-12), 5) AS volcanics,
  round(1622.0 - 132.5 * ln({PHI_SQL} + 1e-12), 5) AS moho FROM fx_trench""")
def s19_slab_temperatures(t):
    phi = P.thermal_parameter(c("seafloor_age_myr"), S.clip(c("conv_rate_orth_cm_yr"), 0) * 100, c("slab_dip_deg"))
    sediments, volcanics, moho = P.slab_temperatures(phi + 1e-12)
    return _out(t, "trench_id", 5, sediments=sediments, volcanics=volcanics, moho=moho)


@query("s22_total_outflux", "fx_trench", sql="SELECT trench_id, round(sediment_m + seafloor_age_myr + slab_dip_deg, 6) AS water, round(sediment_m + seafloor_age_myr + slab_dip_deg + spreading_km_myr + arc_len_deg, 6) AS carbon FROM fx_trench")
def s22_total_outflux(t):
    return _out(t, "trench_id", water=c("sediment_m") + c("seafloor_age_myr") + c("slab_dip_deg"), carbon=c("sediment_m") + c("seafloor_age_myr") + c("slab_dip_deg") + c("spreading_km_myr") + c("arc_len_deg"))


FLUXES = ["sediment_m", "seafloor_age_myr", "slab_dip_deg", "spreading_km_myr", "arc_len_deg"]


@query("s24_outflux_units", "fx_trench", sql="SELECT trench_id, " + ", ".join(f"round({k} * greatest(conv_rate_orth_cm_yr, 0.0) * 1e6, 3) AS {k}" for k in FLUXES) + " FROM fx_trench")
def s24_outflux_units(t):
    return _out(t, "trench_id", 3, **{k: P.outflux(c(k), c("conv_rate_orth_cm_yr")) for k in FLUXES})


Q = "least(greatest(probability, 1e-15), 1 - 1e-15)"
ENTROPY = f"(-({Q} * log2({Q}) + (1 - {Q}) * log2(1 - {Q})))"


@query("s25_entropy_bits", "fx_score", sql=f"SELECT point_id, round({ENTROPY}, 6) AS entropy FROM fx_score")
def s25_entropy_bits(s):
    return _out(s, "point_id", entropy=P.entropy_bits(c("probability")))


@query("s26_uncertainty", "fx_score", sql="""
SELECT point_id, round(0.5 * probability + 0.5 * erosion_m / 997, 6) AS uncertainty,
  round(probability * (1 - (0.5 * probability + 0.5 * erosion_m / 997)), 6) AS adjusted FROM fx_score""")
def s26_uncertainty(s):
    u = P.uncertainty(c("probability"), c("erosion_m") / 997)
    return _out(s, "point_id", uncertainty=u, adjusted=c("probability") * (1 - u))


@query("s27_preserved", "fx_score", sql="SELECT point_id, round(probability * (erosion_m / 997), 6) AS preserved FROM fx_score")
def s27_preserved(s):
    return _out(s, "point_id", preserved=P.preserved(c("probability"), c("erosion_m") / 997))


@query("s28_max_shear", "fx_trench", sql="""
WITH a AS (SELECT i * pi() / 99 AS az FROM range(100) t(i)),
d AS (SELECT trench_id, conv_rate_cm_yr AS d11, obliquity_deg AS d12, slab_dip_deg AS d21, arc_len_deg AS d22 FROM fx_trench)
SELECT trench_id, round(max(-(cos(az) * (d12 * cos(az) - d11 * sin(az)) + sin(az) * (d22 * cos(az) - d21 * sin(az)))), 6) AS shear FROM d CROSS JOIN a GROUP BY trench_id""")
def s28_max_shear(t):
    return _out(t, "trench_id", shear=P.max_shear(c("conv_rate_cm_yr"), c("obliquity_deg"), c("slab_dip_deg"), c("arc_len_deg")))


@query("s29_strain_scale", "fx_trench", sql="SELECT trench_id, round(conv_rate_orth_cm_yr / 1e15 * 1e15, 6) AS rate, round(least(greatest(conv_rate_orth_cm_yr, -1.0), 1.0), 6) AS style FROM fx_trench")
def s29_strain_scale(t):
    return _out(t, "trench_id", rate=P.strain_scale(c("conv_rate_orth_cm_yr") / 1e15), style=S.clip(c("conv_rate_orth_cm_yr"), -1, 1))


@query("s30_unscale", "fx_point", sql="""
WITH m AS (SELECT median(f1) AS center, quantile_cont(f1, 0.75) - quantile_cont(f1, 0.25) AS scale FROM fx_point)
SELECT point_id, round((f1 - center) / scale * scale + center, 5) AS f1 FROM fx_point CROSS JOIN m""")
def s30_unscale(p):
    from tessera.operators.prepare import apply_scale, robust_scale, unscale

    fit = robust_scale(p, ["f1"])
    return _out(unscale(apply_scale(p, fit), fit), "point_id", 5, f1=c("f1"))
