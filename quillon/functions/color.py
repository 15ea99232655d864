"""Colour conversions as triples of column expressions, by the published formulas of each space."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Triple = tuple[Column, Column, Column]

# The D65 white point, and the sRGB matrices in each direction.
WHITE = (0.950456, 1.0, 1.088754)
RGB_TO_XYZ = (
    (0.4123955889674142161, 0.3575834307637148171, 0.1804926473817015735),
    (0.2125862307855955516, 0.7151703037034108499, 0.07220049864333622685),
    (0.01929721549174694484, 0.1191838645808485318, 0.9504971251315797660),
)
XYZ_TO_RGB = ((3.2406, -1.5372, -0.4986), (-0.9689, 1.8758, 0.0415), (0.0557, -0.2040, 1.0570))
# Luma-chroma matrices (rows of the transform from R'G'B'), with offsets.
YUV = ((0.299, 0.587, 0.114), (-0.147, -0.289, 0.436), (0.615, -0.515, -0.100))
YIQ = ((0.299, 0.587, 0.114), (0.595716, -0.274453, -0.321263), (0.211456, -0.522591, 0.311135))
YPBPR = ((0.299, 0.587, 0.114), (-0.1687367, -0.331264, 0.5), (0.5, -0.418688, -0.081312))
YDBDR = ((0.299, 0.587, 0.114), (-0.450, -0.883, 1.333), (-1.333, 1.116, 0.217))
CAT02 = ((0.7328, 0.4296, -0.1624), (-0.7036, 1.6975, 0.0061), (0.0030, 0.0136, 0.9834))


def _times(m, v: Triple) -> Triple:
    return tuple(row[0] * v[0] + row[1] * v[1] + row[2] * v[2] for row in m)  # type: ignore[return-value]


def _inverse(m):
    (a, b, c), (d, e, f), (g, h, i) = m
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    return (
        ((e * i - f * h) / det, (c * h - b * i) / det, (b * f - c * e) / det),
        ((f * g - d * i) / det, (a * i - c * g) / det, (c * d - a * f) / det),
        ((d * h - e * g) / det, (b * g - a * h) / det, (a * e - b * d) / det),
    )


def _linear(t: Column) -> Column:
    return F.when(t <= 0.0404482362771076, t / 12.92).otherwise(F.pow((t + 0.055) / 1.055, F.lit(2.4)))


def _gamma(t: Column) -> Column:
    return F.when(t <= 0.0031306684425005883, 12.92 * t).otherwise(1.055 * F.pow(F.greatest(t, F.lit(0.0)), F.lit(1 / 2.4)) - 0.055)


def rgb_to_xyz(v: Triple) -> Triple:
    return _times(RGB_TO_XYZ, tuple(_linear(x) for x in v))


def xyz_to_rgb(v: Triple) -> Triple:
    """Negative linear parts are shifted up by the smallest before the gamma curve."""
    raw = _times(XYZ_TO_RGB, v)
    low = F.least(F.lit(0.0), *raw)
    return tuple(_gamma(x - low) for x in raw)  # type: ignore[return-value]


def _f(t: Column) -> Column:
    return F.when(t >= (6 / 29) ** 3, F.pow(F.greatest(t, F.lit(0.0)), F.lit(1 / 3))).otherwise(841.0 / 108.0 * t + 4.0 / 29.0)


def _f_inverse(t: Column) -> Column:
    return F.when(t >= 6 / 29, t * t * t).otherwise(108.0 / 841.0 * (t - 4.0 / 29.0))


def xyz_to_lab(v: Triple) -> Triple:
    x, y, z = (_f(c / w) for c, w in zip(v, WHITE, strict=True))
    return 116 * y - 16, 500 * (x - y), 200 * (y - z)


def lab_to_xyz(v: Triple) -> Triple:
    y = (v[0] + 16) / 116
    x, z = y + v[1] / 500, y - v[2] / 200
    return tuple(w * _f_inverse(c) for c, w in zip((x, y, z), WHITE, strict=True))  # type: ignore[return-value]


def rgb_to_lab(v: Triple) -> Triple:
    return xyz_to_lab(rgb_to_xyz(v))


def lab_to_rgb(v: Triple) -> Triple:
    return xyz_to_rgb(lab_to_xyz(v))


_U, _V = (4 * WHITE[0] / (WHITE[0] + 15 * WHITE[1] + 3 * WHITE[2]), 9 * WHITE[1] / (WHITE[0] + 15 * WHITE[1] + 3 * WHITE[2]))


def xyz_to_luv(v: Triple) -> Triple:
    x, y, z = v
    d = F.when(x + 15 * y + 3 * z != 0, x + 15 * y + 3 * z)
    light = 116 * _f(y / WHITE[1]) - 16
    u, w = F.coalesce(4 * x / d, F.lit(_U)), F.coalesce(9 * y / d, F.lit(_V))
    return light, 13 * light * (u - _U), 13 * light * (w - _V)


def luv_to_xyz(v: Triple) -> Triple:
    light, u, w = v
    safe = F.when(light != 0, 13 * light)
    up, vp = F.coalesce(u / safe, F.lit(0.0)) + _U, F.coalesce(w / safe, F.lit(0.0)) + _V
    y = WHITE[1] * _f_inverse((light + 16) / 116)
    x = F.coalesce(y * 9 * up / F.when(vp != 0, 4 * vp), F.lit(0.0))
    z = F.coalesce(y * (12 - 3 * up - 20 * vp) / F.when(vp != 0, 4 * vp), F.lit(0.0))
    return x, y, z


def lab_to_lch(v: Triple) -> Triple:
    hue = F.degrees(F.atan2(v[2], v[1]))
    return v[0], F.sqrt(v[1] * v[1] + v[2] * v[2]), F.when(hue < 0, hue + 360).otherwise(hue)


def lch_to_lab(v: Triple) -> Triple:
    return v[0], v[1] * F.cos(F.radians(v[2])), v[1] * F.sin(F.radians(v[2]))


def _hue(v: Triple, high: Column, spread: Column) -> Column:
    r, g, b = v
    d = F.when(spread != 0, spread)
    h = F.when(high == r, (g - b) / d).when(high == g, 2 + (b - r) / d).otherwise(4 + (r - g) / d) * 60
    return F.coalesce(F.when(h < 0, h + 360).otherwise(h), F.lit(0.0))


def rgb_to_hsv(v: Triple) -> Triple:
    high, low = F.greatest(*v), F.least(*v)
    return _hue(v, high, high - low), F.coalesce((high - low) / F.when(high != 0, high), F.lit(0.0)), high


def _sector(h: Column, chroma: Column, low: Column) -> Triple:
    h = F.pmod(h, F.lit(360.0)) / 60
    x = chroma * (1 - F.abs(F.pmod(h, F.lit(2.0)) - 1))
    zero = F.lit(0.0)

    def pick(*parts: Column) -> Column:
        out = F.when(h < 1, parts[0])
        for i, p in enumerate(parts[1:5], 2):
            out = out.when(h < i, p)
        return out.otherwise(parts[5]) + low

    return pick(chroma, x, zero, zero, x, chroma), pick(x, chroma, chroma, x, zero, zero), pick(zero, zero, x, chroma, chroma, x)


def hsv_to_rgb(v: Triple) -> Triple:
    c = v[1] * v[2]
    return _sector(v[0], c, v[2] - c)


def rgb_to_hsl(v: Triple) -> Triple:
    high, low = F.greatest(*v), F.least(*v)
    light = (high + low) / 2
    room = 1 - F.abs(2 * light - 1)
    return _hue(v, high, high - low), F.coalesce((high - low) / F.when(room > 1e-15, room), F.lit(0.0)), light


def hsl_to_rgb(v: Triple) -> Triple:
    c = (1 - F.abs(2 * v[2] - 1)) * v[1]
    return _sector(v[0], c, v[2] - c / 2)


def rgb_to_hsi(v: Triple) -> Triple:
    r, g, b = v
    mean = (r + g + b) / 3
    hue = F.degrees(F.atan2(math.sqrt(3.0) * (g - b), 2 * r - g - b))
    return F.when(hue < 0, hue + 360).otherwise(hue), F.when(mean > 0, 1 - F.least(r, g, b) / F.when(mean > 0, mean)).otherwise(0.0), mean


def hsi_to_rgb(v: Triple) -> Triple:
    h, s, i = v
    turn = F.pmod(h, F.lit(120.0))
    main = i * (1 + s * F.cos(F.radians(turn)) / F.cos(F.radians(60 - turn)))
    least = i * (1 - s)
    rest = 3 * i - main - least
    sector = F.floor(F.pmod(h, F.lit(360.0)) / 120)

    def pick(a: Column, b: Column, c: Column) -> Column:
        return F.when(sector == 0, a).when(sector == 1, b).otherwise(c)

    return pick(main, least, rest), pick(rest, main, least), pick(least, rest, main)


def _offset(m, scale: float, shift: tuple[float, float, float]):
    def there(v: Triple) -> Triple:
        return tuple(scale * x + s for x, s in zip(_times(m, v), shift, strict=True))  # type: ignore[return-value]

    back_m = _inverse(m)

    def back(v: Triple) -> Triple:
        return _times(back_m, tuple((x - s) / scale for x, s in zip(v, shift, strict=True)))

    return there, back


rgb_to_yuv, yuv_to_rgb = _offset(YUV, 1.0, (0.0, 0.0, 0.0))
rgb_to_yiq, yiq_to_rgb = _offset(YIQ, 1.0, (0.0, 0.0, 0.0))
rgb_to_ypbpr, ypbpr_to_rgb = _offset(YPBPR, 1.0, (0.0, 0.0, 0.0))
rgb_to_ydbdr, ydbdr_to_rgb = _offset(YDBDR, 1.0, (0.0, 0.0, 0.0))
rgb_to_jpegycbcr, jpegycbcr_to_rgb = _offset(YPBPR, 1.0, (0.0, 0.5, 0.5))
xyz_to_cat02lms, cat02lms_to_xyz = _offset(CAT02, 1.0, (0.0, 0.0, 0.0))


def rgb_to_ycbcr(v: Triple) -> Triple:
    """Studio swing: 219 steps of luma from 16 and 224 of chroma around 128."""
    y, pb, pr = rgb_to_ypbpr(v)
    return 16 + 219 * y, 128 + 224 * pb, 128 + 224 * pr


def ycbcr_to_rgb(v: Triple) -> Triple:
    return ypbpr_to_rgb(((v[0] - 16) / 219, (v[1] - 128) / 224, (v[2] - 128) / 224))


#: How each space is reached from and leads to its neighbour nearer sRGB.
_STEPS = {
    "yuv": ("rgb", rgb_to_yuv, yuv_to_rgb), "yiq": ("rgb", rgb_to_yiq, yiq_to_rgb), "ypbpr": ("rgb", rgb_to_ypbpr, ypbpr_to_rgb),
    "ydbdr": ("rgb", rgb_to_ydbdr, ydbdr_to_rgb), "ycbcr": ("rgb", rgb_to_ycbcr, ycbcr_to_rgb), "jpegycbcr": ("rgb", rgb_to_jpegycbcr, jpegycbcr_to_rgb),
    "hsv": ("rgb", rgb_to_hsv, hsv_to_rgb), "hsl": ("rgb", rgb_to_hsl, hsl_to_rgb), "hsi": ("rgb", rgb_to_hsi, hsi_to_rgb),
    "xyz": ("rgb", rgb_to_xyz, xyz_to_rgb), "lab": ("xyz", xyz_to_lab, lab_to_xyz), "luv": ("xyz", xyz_to_luv, luv_to_xyz),
    "lch": ("lab", lab_to_lch, lch_to_lab), "cat02lms": ("xyz", xyz_to_cat02lms, cat02lms_to_xyz),
}


def convert(v: Triple, transform: str) -> Triple:
    """Any conversion by name, such as ``rgb->lab`` or ``lch<-hsv``; names are not case-sensitive."""
    text = transform.replace(" ", "").lower()
    source, target = text.split("->") if "->" in text else reversed(text.split("<-"))

    def chain(space: str) -> list[str]:
        out = [space]
        while out[-1] != "rgb":
            if out[-1] not in _STEPS:
                raise ValueError(f"unknown colour space {space!r}")
            out.append(_STEPS[out[-1]][0])
        return out

    down, up = chain(source), chain(target)
    while len(down) > 1 and len(up) > 1 and down[-2] == up[-2]:
        down.pop(), up.pop()
    for space in down[:-1]:
        v = _STEPS[space][2](v)
    for space in reversed(up[:-1]):
        v = _STEPS[space][1](v)
    return v


def hex_color(v: Triple) -> Column:
    parts = [F.lpad(F.hex(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)) * 255).cast("int")), 2, "0") for x in v]
    return F.concat(F.lit("#"), *parts)
