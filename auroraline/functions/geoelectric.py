"""Layered-earth response, in complex arithmetic that SQL does not have."""

from __future__ import annotations

import cmath
import math

MU0 = 4e-7 * math.pi


def surface_impedance(frequency: float, conductivity: tuple[float, ...], thickness: tuple[float, ...]) -> complex:
    """Wait's recursion from the lowest half-space up; one thickness less than layers."""
    omega = 2 * math.pi * frequency
    root = [cmath.sqrt(1j * omega * MU0 * s) for s in conductivity]
    z = 1j * omega * MU0 / root[-1]
    for k, d in zip(reversed(root[:-1]), reversed(thickness), strict=True):
        own = 1j * omega * MU0 / k
        t = cmath.tanh(k * d)
        z = own * (z + own * t) / (own + z * t)
    return z
