"""Expressions of depletion physics and deposited dose. Constants in cm, F, C, J."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 8.8541878128e-14 * 9.7
CHARGE = 1.602176634e-19


def doping(rated_v: Column, width_cm: Column) -> Column:
    return F.try_divide(2 * EPSILON * rated_v, CHARGE * width_cm * width_cm)


def depletion_width(v: Column, n: Column) -> Column:
    return F.sqrt(F.try_divide(2 * EPSILON * v, CHARGE * n))


def peak_field(v: Column, width: Column) -> Column:
    return F.try_divide(2 * v, width)


def stored_energy(v: Column, n: Column) -> Column:
    """J/cm2 in the depletion region."""
    return F.sqrt(2 * EPSILON * CHARGE * n * F.pow(v, F.lit(3.0))) / 3


def critical_voltage(energy: Column, n: Column) -> Column:
    """The voltage at which the stored energy reaches energy."""
    return F.pow(F.try_divide(F.pow(3 * energy, F.lit(2.0)), 2 * EPSILON * CHARGE * n), F.lit(1.0 / 3))


def dose_gray(fluence: Column, let: Column) -> Column:
    """Gy of particles/cm2 at a linear energy transfer in MeV cm2/mg."""
    return fluence * let * 1.602176634e-7
