"""Energy loss of particles through layers by tabled stopping power, and the dose that follows.

The tables are small reference data (tens of points a material) and are handed to the executors as arrays; contexts are
rows, and each context's layers come as one array in order. Stepping runs in an aggregate() over a fixed sequence, inside
the JVM.

Defined results: null energies, fluences or layers give null; energies outside the table take its ends; a particle that
stops deposits nothing further; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

JOULE_PER_MEV = 1.602176634e-13
#: Gy for each MeV cm2/mg and particle per cm2.
GY = 1.602176634e-7
STEPS = 200


def log_log(x: Column, table: Column, value: str) -> Column:
    """value at x from table, an array of structs (energy, value, ...) in order of energy, straight in both logarithms."""
    last = F.size(table)
    below = F.size(F.filter(table, lambda p: p["energy"] <= x))
    lo = F.element_at(table, F.least(F.greatest(below, F.lit(1)), last).cast("int"))
    hi = F.element_at(table, F.least(F.greatest(below + 1, F.lit(1)), last).cast("int"))
    span = F.log(hi["energy"]) - F.log(lo["energy"])
    w = F.when(span > 0, (F.log(x) - F.log(lo["energy"])) / span).otherwise(0.0)
    return F.when(x.isNotNull(), F.exp(F.log(lo[value]) + F.greatest(F.lit(0.0), F.least(F.lit(1.0), w)) * (F.log(hi[value]) - F.log(lo[value]))))


def after_layer(energy: Column, thickness_um: Column, density: Column, table: Column, steps: int = STEPS) -> Column:
    """Energy left in MeV after a layer, from steps of constant loss (stopping power in MeV cm2/mg)."""
    mg = thickness_um * 1e-4 * density * 1000 / steps  # mg/cm2 of a step
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), energy.cast("double"), lambda e, _: F.when(e > 0, F.greatest(F.lit(0.0), e - log_log(e, table, "total") * mg)).otherwise(F.lit(0.0)))


def through_layers(contexts: DataFrame, layers: DataFrame, stopping: DataFrame) -> DataFrame:
    """(context_id, layer_order, energy_in, energy_out, deposited_mev, joule, gray) for every layer that a context's
    particles meet; layers are (layer_order, thickness_um, density, area_cm2), stopping is (energy, total)."""
    fields = {"table": (stopping, ("energy", "total")), "stack": (layers, ("layer_order", "thickness_um", "density", "area_cm2"))}
    c = contexts.select("context_id", "energy_mev", "fluence")
    for name, (df, cols) in fields.items():  # reference data of tens of rows
        rows = sorted(tuple(r) for r in df.select(*cols).dropna().collect())
        c = c.withColumn(name, F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(cols, r))) for r in rows)))
    if not (stopping.head(1) and layers.head(1)):
        c = c.limit(0)

    def step(acc, layer):
        left = F.when(F.size(acc) == 0, F.col("energy_mev")).otherwise(F.element_at(acc, -1)["energy_out"])
        out = after_layer(left, layer["thickness_um"], layer["density"], F.col("table"))
        return F.concat(acc, F.array(F.struct(layer["layer_order"].alias("layer_order"), left.cast("double").alias("energy_in"), out.alias("energy_out"), layer["thickness_um"].alias("t"), layer["density"].alias("d"), layer["area_cm2"].alias("a"))))

    kind = "array<struct<layer_order:int,energy_in:double,energy_out:double,t:double,d:double,a:double>>"
    flat = c.withColumn("x", F.explode(F.aggregate("stack", F.array().cast(kind), step)))
    lost = F.col("x.energy_in") - F.col("x.energy_out")
    joule = lost * F.col("fluence") * F.col("x.a") * JOULE_PER_MEV
    mass = F.col("x.t") * 1e-4 * F.col("x.a") * F.col("x.d") / 1000  # kg
    return flat.select("context_id", "x.layer_order", "x.energy_in", "x.energy_out", lost.alias("deposited_mev"), joule.alias("joule"), F.try_divide(joule, mass).alias("gray"), mass.alias("mass_kg"))


def total_dose(components: DataFrame) -> DataFrame:
    """(context_id, joule, gray): the mass-weighted sum over layers."""
    return components.groupBy("context_id").agg(F.sum("joule").alias("joule"), F.try_divide(F.sum("joule"), F.sum("mass_kg")).alias("gray"))
