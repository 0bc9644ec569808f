"""Catalog objects, propagation, ground tracks, passes and catalog search."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from perigee.functions import geo
from perigee.functions.clock import SECOND

#: Fixed constants of the WGS72 gravity model of the propagation papers.
_MU, _RE, _J2, _J3, _J4 = 398600.8, 6378.135, 0.001082616, -0.00000253881, -0.00000165597
_XKE = 60.0 / np.sqrt(_RE**3 / _MU)
#: Orbits of this period in minutes or more have deep-space terms.
DEEP_MINUTES = 225.0
ECCENTRIC, MOTION, PERTURBED, LATUS, DECAYED = 1, 2, 3, 4, 6
ELEMENTS = ("epoch_ns", "mean_motion", "eccentricity", "inclination", "raan", "arg_perigee", "mean_anomaly", "bstar")
TWO_PI = 2 * np.pi

# Fixed constants of the deep-space theory, by the names of its papers.
#: Eccentricity, mean motion (rad/min) and strength of the sun and of the moon; the sun's inclination and perigee.
_SUN, _MOON = (0.01675, 1.19459e-5, 2.9864797e-6), (0.05490, 1.5835218e-4, 4.7968065e-7)
_SUN_PLANE = {"zcosg": 0.1945905, "zsing": -0.98088458, "zcosi": 0.91744867, "zsini": 0.39785416}
#: The Earth's turn, rad/min, and the phases of the resonances.
_TURN = 4.37526908801129966e-3
_DAY_PHASES = (0.13130908, 2.8843198, 0.37448087)
_G22, _G32, _G44, _G52, _G54 = 5.7686396, 0.95240898, 1.8014998, 1.0508330, 4.4108898
_Q22, _Q31, _Q33 = 1.7891679e-6, 2.1460748e-6, 2.2123015e-7
_ROOT22, _ROOT32, _ROOT44, _ROOT52, _ROOT54 = 1.7891679e-6, 3.7393792e-7, 7.3636953e-9, 1.1428639e-7, 2.1765803e-9
#: Step of the resonance integrator in minutes, and below which inclination nodes are taken as in the plane (rad).
_STEP, _FLAT, _LOW = 720.0, 5.2359877e-2, 0.2
#: Half-day resonance: polynomials in the eccentricity (constant, first, second, third power) by range.
_G211 = ((3.616, -13.2470, 16.2900, 0.0), (-72.099, 331.819, -508.738, 266.724))
_G310 = ((-19.302, 117.3900, -228.4190, 156.5910), (-346.844, 1582.851, -2415.925, 1246.113))
_G322 = ((-18.9068, 109.7927, -214.6334, 146.5816), (-342.585, 1554.908, -2366.899, 1215.972))
_G410 = ((-41.122, 242.6940, -471.0940, 313.9530), (-1052.797, 4758.686, -7193.992, 3651.957))
_G422 = ((-146.407, 841.8800, -1629.014, 1083.4350), (-3581.690, 16178.110, -24462.770, 12422.520))
_G520 = ((-532.114, 3017.977, -5740.032, 3708.2760), (1464.74, -4664.75, 3763.64, 0.0), (-5149.66, 29936.92, -54087.36, 31324.56))
_G533 = ((-919.22770, 4988.6100, -9064.7700, 5542.21), (-37995.780, 161616.52, -229838.20, 109377.94))
_G521 = ((-822.71072, 4568.6173, -8491.4146, 5337.524), (-51752.104, 218913.95, -309468.16, 146349.42))
_G532 = ((-853.66600, 4690.2500, -8624.7700, 5341.4), (-40023.880, 170470.89, -242699.48, 115605.82))


def _third_body(o: dict, plane: dict, strength: float) -> dict:
    """What the sun or the moon does to an orbit: s1 to s7 and the z of the papers."""
    ci, si, co, so, e2 = o["c"], o["s"], o["cos_argp"], o["sin_argp"], o["ecc"] ** 2
    cg, sg, ch, sh, c, s = plane["zcosg"], plane["zsing"], plane["zcosh"], plane["zsinh"], plane["zcosi"], plane["zsini"]
    a1, a3, a7, a8 = cg * ch + sg * c * sh, -sg * ch + cg * c * sh, -cg * sh + sg * c * ch, sg * s
    a9, a10 = sg * sh + cg * c * ch, cg * s
    a2, a4, a5, a6 = ci * a7 + si * a8, ci * a9 + si * a10, -si * a7 + ci * a8, -si * a9 + ci * a10
    x1, x2, x3, x4 = a1 * co + a2 * so, a3 * co + a4 * so, -a1 * so + a2 * co, -a3 * so + a4 * co
    x5, x6, x7, x8 = a5 * so, a6 * so, a5 * co, a6 * co
    z31, z32, z33 = 12 * x1 * x1 - 3 * x3 * x3, 24 * x1 * x2 - 6 * x3 * x4, 12 * x2 * x2 - 3 * x4 * x4
    beta2 = 1 - e2
    s3 = strength / o["n"]
    s4 = s3 * np.sqrt(beta2)
    return {
        "z31": z31, "z32": z32, "z33": z33,
        "z1": 2 * (3 * (a1 * a1 + a2 * a2) + z31 * e2) + beta2 * z31, "z2": 2 * (6 * (a1 * a3 + a2 * a4) + z32 * e2) + beta2 * z32, "z3": 2 * (3 * (a3 * a3 + a4 * a4) + z33 * e2) + beta2 * z33,
        "z11": -6 * a1 * a5 + e2 * (-24 * x1 * x7 - 6 * x3 * x5), "z12": -6 * (a1 * a6 + a3 * a5) + e2 * (-24 * (x2 * x7 + x1 * x8) - 6 * (x3 * x6 + x4 * x5)), "z13": -6 * a3 * a6 + e2 * (-24 * x2 * x8 - 6 * x4 * x6),
        "z21": 6 * a2 * a5 + e2 * (24 * x1 * x5 - 6 * x3 * x7), "z22": 6 * (a4 * a5 + a2 * a6) + e2 * (24 * (x2 * x5 + x1 * x6) - 6 * (x4 * x7 + x3 * x8)), "z23": 6 * a4 * a6 + e2 * (24 * x2 * x6 - 6 * x4 * x8),
        "s1": -15 * o["ecc"] * s4, "s2": -0.5 * s3 / np.sqrt(beta2), "s3": s3, "s4": s4, "s5": x1 * x3 + x2 * x4, "s6": x2 * x3 + x1 * x4, "s7": x2 * x4 - x1 * x3}


def _swing(b: dict, body: tuple, phase: np.ndarray, t: np.ndarray, e2: np.ndarray) -> tuple:
    """Periodic changes by one body: eccentricity, inclination, mean anomaly, perigee and node (before division)."""
    zecc, zn, _ = body
    m = phase + zn * t
    f = m + 2 * zecc * np.sin(m)
    sf = np.sin(f)
    f2, f3 = 0.5 * sf * sf - 0.25, -0.5 * sf * np.cos(f)
    e = 2 * b["s1"] * (b["s6"] * f2 + b["s7"] * f3)
    i = 2 * b["s2"] * (b["z12"] * f2 + (b["z13"] - b["z11"]) * f3)
    l = -2 * b["s3"] * (b["z2"] * f2 + (b["z3"] - b["z1"]) * f3 + (-21 - 9 * e2) * zecc * sf)
    g = 2 * b["s4"] * (b["z32"] * f2 + (b["z33"] - b["z31"]) * f3 - 9 * zecc * sf)
    h = -2 * b["s2"] * (b["z22"] * f2 + (b["z23"] - b["z21"]) * f3)
    return e, i, l, g, h


def _drift(b: dict, zn: float, e2: np.ndarray) -> tuple:
    """Secular rates by one body, in the same order."""
    return (b["s1"] * zn * b["s5"], b["s2"] * zn * (b["z11"] + b["z13"]), -zn * b["s3"] * (b["z1"] + b["z3"] - 14 - 6 * e2), b["s4"] * zn * (b["z31"] + b["z33"] - 6), -zn * b["s2"] * (b["z21"] + b["z23"]))


class _Deep:
    """Sun, moon and resonances for orbits of 225 minutes and more; ``o`` has the mean elements at the epoch."""

    def __init__(self, o: dict):
        self.o = o
        day = o["epoch_ns"] / 8.64e13 + 7306.0 + 18261.5  # since 1900
        node = np.fmod(4.5236020 - 9.2422029e-4 * day, TWO_PI)
        sn, cn = np.sin(node), np.cos(node)
        ci = 0.91375164 - 0.03568096 * cn
        si = np.sqrt(1 - ci * ci)
        sh = 0.089683511 * sn / si
        ch = np.sqrt(1 - sh * sh)
        gam = 5.8351514 + 0.0019443680 * day
        turn = gam + np.arctan2(_SUN_PLANE["zsini"] * sn / si, ch * cn + _SUN_PLANE["zcosi"] * sh * sn) - node
        on, sn0 = np.cos(o["node"]), np.sin(o["node"])
        self.sun = _third_body(o, _SUN_PLANE | {"zcosh": on, "zsinh": sn0}, _SUN[2])
        self.moon = _third_body(o, {"zcosg": np.cos(turn), "zsing": np.sin(turn), "zcosi": ci, "zsini": si, "zcosh": ch * on + sh * sn0, "zsinh": sn0 * ch - on * sh}, _MOON[2])
        self.moon_phase = np.fmod(4.7199672 + 0.22997150 * day - gam, TWO_PI)
        self.sun_phase = np.fmod(6.2565837 + 0.017201977 * day, TWO_PI)
        self.e2 = o["ecc"] ** 2
        de, di, dm, dg, dh = (a + b for a, b in zip(_drift(self.sun, _SUN[1], self.e2), _drift(self.moon, _MOON[1], self.e2)))
        dh = np.where((o["inc"] < _FLAT) | (o["inc"] > np.pi - _FLAT), 0.0, dh) / np.where(o["s"] == 0, 1.0, o["s"])
        self.rates = {"e": de, "i": di, "m": dm, "argp": dg - o["c"] * dh, "node": dh}
        self._resonance()

    def _resonance(self) -> None:
        o, n, e, e2, c, s = self.o, self.o["n"], self.o["ecc"], self.e2, self.o["c"], self.o["s"]
        self.daily = (n > 0.0034906585) & (n < 0.0052359877)
        self.half = (n >= 8.26e-3) & (n <= 9.24e-3) & (e >= 0.5)
        jd = o["epoch_ns"] / 8.64e13 + 2440587.5
        tu = (jd - 2451545.0) / 36525.0
        seconds = -6.2e-6 * tu**3 + 0.093104 * tu * tu + (876600.0 * 3600 + 8640184.812866) * tu + 67310.54841
        self.theta = np.mod(np.radians(seconds) / 240.0, TWO_PI)
        a = (n / _XKE) ** (2 / 3)  # the inverse axis
        # daily: three terms
        f311 = 0.9375 * s * s * (1 + 3 * c) - 0.75 * (1 + c)
        d = 3 * n * n * a * a
        self.day_terms = (d * f311 * (1 + 2 * e2) * _Q31 * a, 2 * d * 0.75 * (1 + c) ** 2 * (1 + e2 * (-2.5 + 0.8125 * e2)) * _Q22, 3 * d * 1.875 * (1 + c) ** 3 * (1 + e2 * (-6 + 6.60937 * e2)) * _Q33 * a)
        # twice a day: ten terms
        powers = (np.ones_like(e), e, e2, e * e2)

        def g(table, *edges):
            out = sum(k * p for k, p in zip(table[0], powers))
            for edge, row in zip(edges, table[1:]):
                out = np.where(edge, sum(k * p for k, p in zip(row, powers)), out)
            return out

        far, farther = e > 0.65, e >= 0.7
        g201 = -0.306 - (e - 0.64) * 0.440
        g520 = g(_G520, far, far & (e > 0.715))
        s2, c2 = s * s, c * c
        f220, f221 = 0.75 * (1 + 2 * c + c2), 1.5 * s2
        f321, f322 = 1.875 * s * (1 - 2 * c - 3 * c2), -1.875 * s * (1 + 2 * c - 3 * c2)
        f441, f442 = 35 * s2 * f220, 39.3750 * s2 * s2
        f522 = 9.84375 * s * (s2 * (1 - 2 * c - 5 * c2) + 0.33333333 * (-2 + 4 * c + 6 * c2))
        f523 = s * (4.92187512 * s2 * (-2 - 4 * c + 10 * c2) + 6.56250012 * (1 + 2 * c - 3 * c2))
        f542 = 29.53125 * s * (2 - 8 * c + c2 * (-12 + 8 * c + 10 * c2))
        f543 = 29.53125 * s * (-2 - 8 * c + c2 * (12 + 8 * c - 10 * c2))
        d2 = 3 * n * n * a * a
        d3, d4, d5 = d2 * a, d2 * a * a, d2 * a**3
        # strength, multiples of the perigee and of the resonant angle, and phase
        self.half_terms = (
            (d2 * _ROOT22 * f220 * g201, 2, 1, _G22), (d2 * _ROOT22 * f221 * g(_G211, far), 0, 1, _G22),
            (d3 * _ROOT32 * f321 * g(_G310, far), 1, 1, _G32), (d3 * _ROOT32 * f322 * g(_G322, far), -1, 1, _G32),
            (2 * d4 * _ROOT44 * f441 * g(_G410, far), 2, 2, _G44), (2 * d4 * _ROOT44 * f442 * g(_G422, far), 0, 2, _G44),
            (d5 * _ROOT52 * f522 * g520, 1, 1, _G52), (d5 * _ROOT52 * f523 * g(_G532, farther), -1, 1, _G52),
            (2 * d5 * _ROOT54 * f542 * g(_G521, farther), 1, 2, _G54), (2 * d5 * _ROOT54 * f543 * g(_G533, farther), -1, 2, _G54))
        r = self.rates
        self.lam = np.where(self.half, o["m"] + 2 * o["node"] - 2 * self.theta, o["m"] + o["node"] + o["argp"] - self.theta)
        self.lam_rate = np.where(self.half, o["mdot"] + r["m"] + 2 * (o["ndot"] + r["node"] - _TURN) - n, o["mdot"] + o["adot"] + o["ndot"] - _TURN + r["m"] + r["argp"] + r["node"] - n)

    def _pull(self, lam: np.ndarray, n: np.ndarray, at: np.ndarray) -> tuple:
        """Rate of the resonant angle, and first and second derivative of the mean motion."""
        lam_dot = n + self.lam_rate
        one = sum(k * np.sin(m * (lam - p)) for m, (k, p) in enumerate(zip(self.day_terms, _DAY_PHASES), 1))
        two = sum(m * k * np.cos(m * (lam - p)) for m, (k, p) in enumerate(zip(self.day_terms, _DAY_PHASES), 1))
        if self.half.any():
            argp = self.o["argp"] + self.o["adot"] * at
            angle = [(k, j, i * argp + j * lam - p) for k, i, j, p in self.half_terms]
            one = np.where(self.half, sum(k * np.sin(x) for k, _, x in angle), one)
            two = np.where(self.half, sum(j * k * np.cos(x) for k, j, x in angle), two)
        return lam_dot, one, two * lam_dot

    def secular(self, t: np.ndarray, m, argp, node) -> tuple:
        """Mean motion, eccentricity, inclination, mean anomaly, perigee and node at ``t`` minutes."""
        o, r = self.o, self.rates
        ecc, inc = o["ecc"] + r["e"] * t, o["inc"] + r["i"] * t
        argp, node, m = argp + r["argp"] * t, node + r["node"] * t, m + r["m"] * t
        n = np.broadcast_to(o["n"], t.shape)
        either = np.broadcast_to(self.daily | self.half, t.shape)
        if either.any():
            at, lam, now = np.zeros(t.shape), np.broadcast_to(self.lam, t.shape).copy(), n.copy()
            while True:
                lam_dot, dn, ddn = self._pull(lam, now, at)
                far = np.abs(t - at) >= _STEP
                if not (far & either).any():
                    break
                step = np.where(far, np.copysign(_STEP, t), 0.0)
                lam, now, at = lam + lam_dot * step + dn * step * step / 2, now + dn * step + ddn * step * step / 2, at + step
            left = t - at
            now = now + dn * left + ddn * left * left * 0.5
            lam = lam + lam_dot * left + dn * left * left * 0.5
            theta = np.mod(self.theta + t * _TURN, TWO_PI)
            m = np.where(either, np.where(self.half, lam - 2 * node + 2 * theta, lam - node - argp + theta), m)
            n = np.where(either, now, n)
        return n, ecc, inc, m, argp, node

    def periodic(self, t: np.ndarray, ecc, inc, m, argp, node) -> tuple:
        """Elements with the periodic terms of sun and moon."""
        pe, pi, pl, pg, ph = (a + b for a, b in zip(_swing(self.sun, _SUN, self.sun_phase, t, self.e2), _swing(self.moon, _MOON, self.moon_phase, t, self.e2)))
        inc, ecc = inc + pi, ecc + pe
        s, c = np.sin(inc), np.cos(inc)
        # away from the equator
        h = ph / np.where(inc >= _LOW, s, 1.0)
        high = (node + h, argp + pg - c * h)
        # near it the node is found from its direction
        sn, cn = np.sin(node), np.cos(node)
        x, y = s * sn + ph * cn + pi * c * sn, s * cn - ph * sn + pi * c * cn
        longitude = m + argp + c * node + pl + pg - pi * node * s
        turned = np.arctan2(x, y)
        turned = turned + np.where(np.abs(node - turned) > np.pi, np.where(turned < node, TWO_PI, -TWO_PI), 0.0)
        m = m + pl
        node, argp = (np.where(inc >= _LOW, a, b) for a, b in zip(high, (turned, longitude - m - c * turned)))
        below = inc < 0
        return ecc, np.abs(inc), m, np.where(below, argp - np.pi, argp), np.where(below, node + np.pi, node)


def sgp4(e: dict[str, np.ndarray], minutes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Propagation of mean elements: error codes, positions (km) and velocities (km/s), inertial.

    Elements are arrays by object: ``epoch_ns``, revolutions a day, degrees, and the drag term. ``minutes``
    since the epoch has a row an object, and as many columns as wanted or none. Orbits of 225 minutes and more
    get the deep-space terms. Errors are 1 for an eccentricity out of range, 2 for a lost mean motion, 3 for
    perturbed elements out of range, 4 for a negative latus rectum and 6 for decay.
    """
    t = np.asarray(minutes, float)
    grid = t if t.ndim == 2 else t[:, None]
    deep = _unkozai(e)[0] <= TWO_PI / DEEP_MINUTES
    error, r, v = np.zeros(grid.shape, np.int64), np.zeros((*grid.shape, 3)), np.zeros((*grid.shape, 3))
    for some, kind in ((np.flatnonzero(~deep), False), (np.flatnonzero(deep), True)):
        if len(some):
            error[some], r[some], v[some] = _propagated({k: x[some] for k, x in e.items()}, grid[some], kind)
    return (error, r, v) if t.ndim == 2 else (error[:, 0], r[:, 0], v[:, 0])


def _unkozai(e: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Mean motion (rad/min) and axis (Earth radii) without the averaging of the element sets."""
    with np.errstate(all="ignore"):
        n0, ecc, c = e["mean_motion"] * TWO_PI / 1440, e["eccentricity"], np.cos(np.radians(e["inclination"]))
        beta2 = 1 - ecc * ecc
        d1 = 0.75 * _J2 * (3 * c * c - 1) / (np.sqrt(beta2) * beta2)
        a = (_XKE / n0) ** (2 / 3)
        d = d1 / a**2
        a = a * (1 - d * d - d * (1 / 3 + 134 * d * d / 81))
        n = n0 / (1 + d1 / a**2)
        return n, (_XKE / n) ** (2 / 3)


def _propagated(e: dict[str, np.ndarray], t: np.ndarray, deep: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    with np.errstate(all="ignore"):
        n, a = (x[:, None] for x in _unkozai(e))
        e = {k: np.asarray(x, float)[:, None] for k, x in e.items()}
        ecc = e["eccentricity"]
        inc, node0, argp0, m0 = (np.radians(e[k]) for k in ("inclination", "raan", "arg_perigee", "mean_anomaly"))
        drag = e["bstar"]
        c, s = np.cos(inc), np.sin(inc)
        c2, beta2 = c * c, 1 - ecc * ecc
        beta = np.sqrt(beta2)
        con42, p2 = 1 - 5 * c2, (a * beta2) ** 2
        con41, perigee = -con42 - 2 * c2, a * (1 - ecc)
        simple = (perigee < 220 / _RE + 1) | deep
        height = (perigee - 1) * _RE
        floor = np.where(height < 98, 20.0, np.where(height < 156, height - 78, 78.0))
        q4, s4 = ((120 - floor) / _RE) ** 4, floor / _RE + 1
        tsi = 1 / (a - s4)
        eta = a * ecc * tsi
        eta2, eeta = eta * eta, ecc * eta
        psi = np.abs(1 - eta2)
        coef = q4 * tsi**4
        coef1 = coef / psi**3.5
        cc2 = coef1 * n * (a * (1 + 1.5 * eta2 + eeta * (4 + eta2)) + 0.375 * _J2 * tsi / psi * con41 * (8 + 3 * eta2 * (8 + eta2)))
        cc1 = drag * cc2
        ratio = _J3 / _J2
        round_orbit = ecc <= 1e-4
        cc3 = np.where(round_orbit, 0.0, -2 * coef * tsi * ratio * n * s / np.where(round_orbit, 1.0, ecc))
        x1 = 1 - c2
        cc4 = 2 * n * coef1 * a * beta2 * (eta * (2 + 0.5 * eta2) + ecc * (0.5 + 2 * eta2) - _J2 * tsi / (a * psi) * (-3 * con41 * (1 - 2 * eeta + eta2 * (1.5 - 0.5 * eeta)) + 0.75 * x1 * (2 * eta2 - eeta * (1 + eta2)) * np.cos(2 * argp0)))
        cc5 = 2 * coef1 * a * beta2 * (1 + 2.75 * (eta2 + eeta) + eeta * eta2)
        t1 = 1.5 * _J2 / p2 * n
        t2 = 0.5 * t1 * _J2 / p2
        t3 = -0.46875 * _J4 / p2**2 * n
        mdot = n + 0.5 * t1 * beta * con41 + 0.0625 * t2 * beta * (13 - 78 * c2 + 137 * c2 * c2)
        adot = -0.5 * t1 * con42 + 0.0625 * t2 * (7 - 114 * c2 + 395 * c2 * c2) + t3 * (3 - 36 * c2 + 49 * c2 * c2)
        h1 = -t1 * c
        ndot = h1 + (0.5 * t2 * (4 - 19 * c2) + 2 * t3 * (3 - 7 * c2)) * c
        # secular terms at the time
        m, argp, node = m0 + mdot * t, argp0 + adot * t, node0 + ndot * t + 3.5 * beta2 * h1 * cc1 * t * t
        ta, te, tl = 1 - cc1 * t, drag * cc4 * t, 1.5 * cc1 * t * t
        nm, em, im, error = n, ecc, inc, np.zeros(t.shape, np.int64)
        if deep:
            body = _Deep({"epoch_ns": e["epoch_ns"], "n": n, "ecc": ecc, "inc": inc, "c": c, "s": s, "node": node0, "argp": argp0, "m": m0, "cos_argp": np.cos(argp0), "sin_argp": np.sin(argp0), "mdot": mdot, "adot": adot, "ndot": ndot})
            nm, em, im, m, argp, node = body.secular(t, m, argp, node)
            error = np.where(nm <= 0, MOTION, error)
        else:
            omg, xm = drag * cc3 * np.cos(argp0), np.where(round_orbit, 0.0, -2 / 3 * coef * drag / np.where(round_orbit, 1.0, eeta))
            shift = omg * t + xm * ((1 + eta * np.cos(m)) ** 3 - (1 + eta * np.cos(m0)) ** 3)
            cc1sq = cc1 * cc1
            d2 = 4 * a * tsi * cc1sq
            tt = d2 * tsi * cc1 / 3
            d3, d4 = (17 * a + s4) * tt, 0.5 * tt * a * tsi * (221 * a + 31 * s4) * cc1
            l3, l4 = d2 + 2 * cc1sq, 0.25 * (3 * d3 + cc1 * (12 * d2 + 10 * cc1sq))
            l5 = 0.2 * (3 * d4 + 12 * cc1 * d3 + 6 * d2 * d2 + 15 * cc1sq * (2 * d2 + cc1sq))
            m = np.where(simple, m, m + shift)
            argp = np.where(simple, argp, argp - shift)
            ta = np.where(simple, ta, ta - d2 * t**2 - d3 * t**3 - d4 * t**4)
            te = np.where(simple, te, te + drag * cc5 * (np.sin(m) - np.sin(m0)))
            tl = np.where(simple, tl, tl + l3 * t**3 + t**4 * (l4 + t * l5))
        am = (_XKE / nm) ** (2 / 3) * ta * ta
        nm, em = _XKE / am**1.5, em - te
        error = np.where((error == 0) & ((em >= 1) | (em < -0.001) | (am < 0.95)), ECCENTRIC, error)
        em = np.maximum(em, 1e-6)
        m = m + n * tl
        xl = np.fmod(m + argp + node, TWO_PI)
        argp, node = np.fmod(argp, TWO_PI), np.fmod(node, TWO_PI)
        m = np.fmod(xl - argp - node, TWO_PI)
        if deep:
            em, im, m, argp, node = body.periodic(t, em, im, m, argp, node)
            error = np.where((error == 0) & ((em < 0) | (em > 1)), PERTURBED, error)
            c, s = np.cos(im), np.sin(im)
            c2 = c * c
            con41, x1 = 3 * c2 - 1, 1 - c2
        lcof = -0.25 * ratio * s * (3 + 5 * c) / np.where(np.abs(1 + c) > 1.5e-12, 1 + c, 1.5e-12)
        ycof = -0.5 * ratio * s
        # long-period terms and Kepler's equation
        ax = em * np.cos(argp)
        inv = 1 / (am * (1 - em * em))
        ay = em * np.sin(argp) + inv * ycof
        u = np.mod(m + argp + inv * lcof * ax, TWO_PI)
        big = u.copy()
        for _ in range(10):
            sb, cb = np.sin(big), np.cos(big)
            big = big + np.clip((u - ay * cb + ax * sb - big) / (1 - cb * ax - sb * ay), -0.95, 0.95)
        sb, cb = np.sin(big), np.cos(big)
        ec, es, el2 = ax * cb + ay * sb, ax * sb - ay * cb, ax * ax + ay * ay
        pl = am * (1 - el2)
        error = np.where((error == 0) & (pl < 0), LATUS, error)
        rl = am * (1 - ec)
        rd, rv, bl = np.sqrt(am) * es / rl, np.sqrt(np.abs(pl)) / rl, np.sqrt(np.abs(1 - el2))
        k = es / (1 + bl)
        su, cu = am / rl * (sb - ay - ax * k), am / rl * (cb - ax + ay * k)
        angle, s2u, c2u = np.arctan2(su, cu), 2 * cu * su, 1 - 2 * su * su
        k1 = 0.5 * _J2 / pl
        k2 = k1 / pl
        r = rl * (1 - 1.5 * k2 * bl * con41) + 0.5 * k1 * x1 * c2u
        angle = angle - 0.25 * k2 * (7 * c2 - 1) * s2u
        nd, ii = node + 1.5 * k2 * c * s2u, im + 1.5 * k2 * c * s * c2u
        vr, vt = rd - nm * k1 * x1 * s2u / _XKE, rv + nm * k1 * (x1 * c2u + 1.5 * con41) / _XKE
        sa, ca, sn, cn, si, ci = np.sin(angle), np.cos(angle), np.sin(nd), np.cos(nd), np.sin(ii), np.cos(ii)
        ux = np.stack([-sn * ci * sa + cn * ca, cn * ci * sa + sn * ca, si * sa], axis=-1)
        vx = np.stack([-sn * ci * ca - cn * sa, cn * ci * ca - sn * sa, si * ca], axis=-1)
        error = np.where((error == 0) & (r < 1), DECAYED, error)
        return error, r[..., None] * ux * _RE, (vr[..., None] * ux + vt[..., None] * vx) * (_RE * _XKE / 60)


#: Objects that one step holds at all their moments.
AT_ONCE = 64


def spread(objects: DataFrame) -> DataFrame:
    """Objects over all cores, a few tasks each: their rows are short, so a file holds very many in one split."""
    return objects.repartition(4 * objects.sparkSession.sparkContext.defaultParallelism)


def propagate(objects: DataFrame, at_ns: Column | str = "at_ns") -> DataFrame:
    """Adds ``error, x, y, z, vx, vy, vz`` at ``at_ns``; positions are null where ``error`` isn't 0.

    Rows are independent, so objects times moments spread over all tasks.
    """
    x = objects.withColumn("__min", (F.col(at_ns) if isinstance(at_ns, str) else at_ns) - F.col("epoch_ns")).withColumn("__min", F.col("__min") / 6e10)

    @F.pandas_udf("error int, x double, y double, z double, vx double, vy double, vz double")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for b in batches:
            e = {k: v.to_numpy(float) for k, v in zip(ELEMENTS, b)}
            error, r, v = sgp4(e, b[-1].to_numpy(float))
            r, v = np.where(error[:, None] == 0, r, np.nan), np.where(error[:, None] == 0, v, np.nan)
            out = pd.DataFrame(np.concatenate([r, v], axis=1), columns=["x", "y", "z", "vx", "vy", "vz"])
            out.insert(0, "error", error.astype("int32"))
            yield out

    x = x.withColumn("__s", run(*[F.col(c).cast("double") for c in ELEMENTS], F.col("__min")))
    names = ["x", "y", "z", "vx", "vy", "vz"]
    return x.select(*objects.columns, F.col("__s.error").alias("error"), *[F.when(F.col("__s.error") == 0, F.col(f"__s.{n}")).alias(n) for n in names])


def states(propagated: DataFrame, at_ns: str = "at_ns") -> DataFrame:
    """Adds sub-point and speed."""
    jd = F.col(at_ns) / 8.64e13 + 2440587.5
    p = geo.sub_point("x", "y", "z", jd)
    speed = F.sqrt(F.col("vx") ** 2 + F.col("vy") ** 2 + F.col("vz") ** 2)
    return propagated.withColumns({**p, "speed_kms": speed})


def propagate_grid(objects: DataFrame, now_ns: int, minutes: Sequence[int]) -> DataFrame:
    """Every object at every moment ``now_ns`` plus so many minutes: ``minute, at_ns`` and what ``propagate`` adds.

    An object's orbit is set up once for all its moments.
    """
    steps = np.asarray(minutes, np.int32)
    moments = now_ns + steps.astype(np.int64) * 60 * SECOND
    x = spread(objects).withColumns({k: F.col(k).cast("double" if k != "epoch_ns" else "long") for k in ELEMENTS})
    added = StructType.fromDDL("minute int, at_ns long, error int, x double, y double, z double, vx double, vy double, vz double")
    schema, more = StructType([*x.schema.fields, *added.fields]), added.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), AT_ONCE):
                b = whole.slice(at, AT_ONCE)
                e = {k: b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False).astype(float) for k in ELEMENTS}
                since = (moments[None] - b.column(b.schema.get_field_index("epoch_ns")).to_numpy(zero_copy_only=False).astype(np.int64)[:, None]) / 6e10
                error, r, v = sgp4(e, since)
                error = error.ravel()
                rows = pa.array(np.repeat(np.arange(len(b)), len(steps)))
                state = np.concatenate([r, v], axis=-1).reshape(-1, 6)
                tiled = [np.tile(steps, len(b)), np.tile(moments, len(b)), error.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*[c.take(rows) for c in b.columns], *map(pa.array, tiled), *[pa.array(state[:, i], mask=error != 0) for i in range(6)]], [*b.schema.names, *more])

    return x.mapInArrow(run, schema)


def ground_track(objects: DataFrame, now_ns: int, back_minutes: int = 45, ahead_minutes: int = 90, step_minutes: int = 3) -> DataFrame:
    """States from before now (without it) and from now on, a row per object and moment."""
    x = propagate_grid(objects, now_ns, range(-back_minutes, ahead_minutes + 1, step_minutes))
    return states(x).withColumn("part", F.when(F.col("minute") < 0, "past").otherwise("future"))


def elevation(station: tuple[float, float, float], r: np.ndarray, at_ns: np.ndarray) -> np.ndarray:
    """Elevations in degrees of inertial positions over a station; the same as ``geo.view`` of ``geo.sub_point``."""
    d = at_ns / 8.64e13 + 2440587.5 - 2451545.0
    c = d / 36525.0
    spin = 280.46061837 + 360.98564736629 * d + 0.000387933 * c * c - c**3 / 38710000.0
    x, y, z = np.moveaxis(r, -1, 0)
    lat, lon, alt = np.arctan2(z, np.hypot(x, y)), np.arctan2(y, x) - np.radians(np.mod(spin, 360.0)), np.sqrt(x * x + y * y + z * z) - geo.RADIUS
    e2 = geo.WGS84_F * (2 - geo.WGS84_F)

    def ecef(la, lo, h):
        n = geo.WGS84_A / np.sqrt(1 - e2 * np.sin(la) ** 2)
        return np.stack([(n + h) * np.cos(la) * np.cos(lo), (n + h) * np.cos(la) * np.sin(lo), (n * (1 - e2) + h) * np.sin(la)], axis=-1)

    la, lo = np.radians(station[0]), np.radians(station[1])
    off = ecef(lat, lon, alt) - ecef(la, lo, station[2])
    up = off @ np.array([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)])
    return np.degrees(np.arcsin(np.clip(up / np.linalg.norm(off, axis=-1), -1, 1)))


def first_passes(up: np.ndarray, height: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By row of a grid: the first moment that is up, the first after it that isn't, and the largest height between.

    Rows whose first pass doesn't begin or doesn't end have -1 as their end.
    """
    steps = np.arange(up.shape[1])
    aos = np.where(up.any(axis=1), up.argmax(axis=1), up.shape[1])
    down = ~up & (steps > aos[:, None])
    los = np.where(down.any(axis=1), down.argmax(axis=1), -1)
    inside = (steps >= aos[:, None]) & (steps < los[:, None])
    return aos, los, np.where(inside, height, -np.inf).max(axis=1)


def next_passes(objects: DataFrame, station: tuple[float, float, float], now_ns: int, hours: int = 12, least_elevation: float = 5.0, fallback: bool = True) -> DataFrame:
    """The first whole pass of each object over a station on a one-minute grid.

    Without one, ``status`` is ESTIMATED_ORBITAL_PASS and the times are a fixed guess, or null with
    ``fallback=False``. An object's whole grid is one step of a vectorised batch; only objects are shuffled, to spread them.
    """
    moments = now_ns + np.arange(hours * 60, dtype=np.int64) * 60 * SECOND

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), AT_ONCE):
                b = whole.iloc[at : at + AT_ONCE]
                e = {k: b[k].to_numpy(float) for k in ELEMENTS}
                since = (moments[None] - b["epoch_ns"].to_numpy(np.int64)[:, None]) / 6e10
                error, r, _ = sgp4(e, since)
                height = np.where(error == 0, elevation(station, r, moments), -np.inf)
                aos, los, top = first_passes(height >= least_elevation, height)
                found = los >= 0
                pick = lambda i: pd.array(np.where(found, moments[np.clip(i, 0, len(moments) - 1)], 0), dtype="Int64").copy()  # noqa: B023,E731
                begin, end = pick(aos), pick(los)
                begin[~found], end[~found] = pd.NA, pd.NA
                yield pd.DataFrame({"object_id": b["object_id"].to_numpy(), "aos_ns": begin, "los_ns": end, "top": np.where(found, top, np.nan)})

    kind = objects.schema["object_id"].dataType.simpleString()
    x = spread(objects).select("object_id", *[F.col(k).cast("double" if k != "epoch_ns" else "long").alias(k) for k in ELEMENTS])
    out = x.mapInPandas(run, f"object_id {kind}, aos_ns long, los_ns long, top double")
    return _described(out, now_ns, fallback)


def grid_passes(grid: DataFrame, now_ns: int, least_elevation: float = 5.0, fallback: bool = True) -> DataFrame:
    """As ``next_passes``, from a stored grid of ``object_id, at_ns, elevation_deg``; null elevations are below. One shuffle, by object."""
    own = Window.partitionBy("object_id")  # an object's moments, which the horizon bounds
    x = grid.select("object_id", "at_ns", "elevation_deg", F.coalesce(F.col("elevation_deg") >= least_elevation, F.lit(False)).alias("up"))
    x = x.withColumn("aos_ns", F.min(F.when(F.col("up"), F.col("at_ns"))).over(own))
    x = x.withColumn("los_ns", F.min(F.when(~F.col("up") & (F.col("at_ns") > F.col("aos_ns")), F.col("at_ns"))).over(own))
    inside = (F.col("at_ns") >= F.col("aos_ns")) & (F.col("at_ns") < F.col("los_ns"))
    out = x.groupBy("object_id").agg(F.max("aos_ns").alias("aos_ns"), F.max("los_ns").alias("los_ns"), F.max(F.when(inside, F.col("elevation_deg"))).alias("top"))
    return _described(out.withColumn("aos_ns", F.when(F.col("los_ns").isNotNull(), F.col("aos_ns"))), now_ns, fallback)


def _described(passes: DataFrame, now_ns: int, fallback: bool) -> DataFrame:
    found = F.col("los_ns").isNotNull()
    guess = lambda real, other: F.when(found, real).otherwise(other if fallback else F.lit(None))
    aos = now_ns + 135 * 60 * SECOND
    return passes.select(
        "object_id", guess(F.col("aos_ns"), F.lit(aos)).alias("aos_ns"), guess(F.col("los_ns"), F.lit(aos + 660 * SECOND)).alias("los_ns"),
        guess(F.round("top", 2), F.lit(48.5)).alias("max_elevation_deg"),
        guess(((F.col("los_ns") - F.col("aos_ns")) / SECOND).cast("long"), F.lit(660).cast("long")).alias("duration_s"),
        F.when(found, "PASS_PREDICTED").otherwise("ESTIMATED_ORBITAL_PASS").alias("status"))


def derived(objects: DataFrame) -> DataFrame:
    """Period, axis, apogee and perigee to 2 decimals, and regime."""
    mm, ecc = "mean_motion", "eccentricity"
    return objects.withColumns({"period_min": F.round(geo.period_minutes(mm), 2), "semi_major_km": F.round(geo.semi_major_km(mm), 2), "apogee_km": F.round(geo.apogee_km(mm, ecc), 2), "perigee_km": F.round(geo.perigee_km(mm, ecc), 2), "regime": geo.regime(mm)})


def search(objects: DataFrame, text: str, most: int = 100, alt: str = "alt_id", starts: bool = True) -> DataFrame:
    """Matches in tiers: id, other id, name, start of the name, part of the name; catalog order inside a tier.

    Without ``starts`` there are four tiers: a name's start counts as any part of it.
    """
    q = text.strip().lower()
    name = F.lower("name")
    tier = F.when(F.col("object_id").cast("string") == q, 0).when(F.lower(alt) == q, 1).when(name == q, 2)
    tier = (tier.when(name.startswith(q), 3) if starts else tier).when(name.contains(q), 4)
    return objects.withColumn("tier", tier).where("tier is not null").orderBy("tier", "ordinal").limit(most)


def deduplicated(objects: DataFrame) -> DataFrame:
    """Catalog rows with a positive id, the last of each id."""
    last = Window.partitionBy("object_id").orderBy(F.desc("ordinal"))
    return objects.where("object_id > 0").withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")


def filtered(objects: DataFrame, regime: str | None = None, kind: str | None = None, authorized: bool | None = None) -> DataFrame:
    for column, value in (("regime", regime), ("object_type", kind), ("authorized", authorized)):
        if value is not None:
            objects = objects.where(F.col(column) == value)
    return objects


def counts(objects: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Objects by value, 0 where there are none."""
    known = objects.sparkSession.createDataFrame([(x,) for x in values], f"{column} string")
    n = objects.groupBy(column).agg(F.count("*").alias("n"))
    return known.join(n, column, "left").fillna(0, ["n"])


def freshest(updates: DataFrame) -> DataFrame:
    """``object_id, freshest_ns``: the last update of every object."""
    return updates.groupBy("object_id").agg(F.max("ts_ns").alias("freshest_ns"))


def stacked(*catalogs: DataFrame) -> DataFrame:
    """Catalogs one after the other: rows of an earlier one come first, whatever their ordinals."""
    out = None
    for i, c in enumerate(catalogs):
        x = c.withColumn("tier", F.lit(i))
        out = x if out is None else out.unionByName(x)
    return out.orderBy("tier", "ordinal").drop("tier")


def nearest_point(points: DataFrame, x: float, y: float, radius: float) -> DataFrame:
    """The visible point nearest to a place within a radius, none or one row."""
    far = F.sqrt((F.col("x") - x) ** 2 + (F.col("y") - y) ** 2)
    near = points.where("visible").withColumn("distance", far).where(F.col("distance") <= radius)
    return near.agg(F.min_by(F.struct("object_id", "distance"), F.struct("distance", "object_id")).alias("p")).where("p is not null").select("p.*")


def synthetic(spark, n: int, epoch_ns: int) -> DataFrame:
    """Low orbits for benchmarks, from expressions on their number alone."""
    i = F.col("id")
    return spark.range(n).select(
        (i + 40000).alias("object_id"), F.concat(F.lit("SYNTHETIC-"), i.cast("string")).alias("name"), F.lit(epoch_ns).alias("epoch_ns"), (15.0 + (i % 10) / 10.0).alias("mean_motion"), (0.0001 + (i % 20) / 10000.0).alias("eccentricity"),
        (40.0 + (i % 60)).cast("double").alias("inclination"), ((i * 37) % 360).cast("double").alias("raan"), ((i * 13) % 360).cast("double").alias("arg_perigee"), ((i * 71) % 360).cast("double").alias("mean_anomaly"), F.lit(0.00002).alias("bstar"))
