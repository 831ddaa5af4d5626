"""GeoHash as Catalyst expressions: quantised coordinates, interleaved bits, base 32."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The GeoHash alphabet, and the digits that conv() uses for base 32.
ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
LENGTH = 12
def _let(value: Column, fn) -> Column:
    """fn(value) with value computed once: keeps nested expressions of linear size."""
    return F.transform(F.array(value), fn)[0]


def _pairs() -> Column:
    """The two characters for five bits of longitude and five of latitude, which alternate from a longitude's on."""
    mixed = [sum(((lon >> i & 1) << (2 * i + 1)) | ((lat >> i & 1) << 2 * i) for i in range(5)) for lon in range(32) for lat in range(32)]
    return F.split(F.lit(" ".join(ALPHABET[m >> 5] + ALPHABET[m & 31] for m in mixed)), " ")  # folded to a constant array


def encode(x: Column, y: Column) -> Column:
    """Twelve characters for longitude x and latitude y; an error outside +-180 and +-90, null for null."""
    cell = lambda v, span: F.least(F.floor((v / span + 0.5) * (1 << 30)).cast("long"), F.lit((1 << 30) - 1))
    lon, lat, pairs = cell(x, 360.0), cell(y, 180.0), _pairs()
    five = lambda v, k: F.shiftright(v, k).bitwiseAND(F.lit(31))
    text = F.concat(*[F.get(pairs, (five(lon, k) * 32 + five(lat, k)).cast("int")) for k in range(25, -1, -5)])
    bad = (F.abs(x) > 180) | (F.abs(y) > 90) | F.isnan(x) | F.isnan(y)
    return F.when(x.isNull() | y.isNull(), F.lit(None).cast("string")).when(bad, F.raise_error(F.lit("coordinates are outside the GeoHash range")).cast("string")).otherwise(text)


def _compact(v: Column) -> Column:
    """Every second bit, the lowest first: digits in base 4 read as binary ones."""
    return F.conv(F.conv(v.bitwiseAND(F.lit(0x5555555555555555)).cast("string"), 10, 4), 2, 10).cast("long")


def decode_box(h: Column) -> Column:
    """struct(xmin, ymin, xmax, ymax) of the cell; an error for characters outside the alphabet or over 12 of them."""
    return _let(h, _decode)


def _decode(h: Column) -> Column:
    n = F.length(h) * 5
    wx, wy = F.lit(360.0) / F.pow(F.lit(2.0), F.floor((n + 1) / 2).cast("double")), F.lit(180.0) / F.pow(F.lit(2.0), F.floor(n / 2).cast("double"))

    def cell(v: Column) -> Column:
        # with an odd number of bits the lowest one is a longitude's
        up = F.shiftright(v, 1)
        lon, lat = F.when(n % 2 == 0, up).otherwise(v), F.when(n % 2 == 0, v).otherwise(up)
        x, y = _compact(lon).cast("double"), _compact(lat).cast("double")
        return _let(
            F.struct((x * wx - 180).alias("x"), (y * wy - 90).alias("y")),
            lambda c: F.struct(c["x"].alias("xmin"), c["y"].alias("ymin"), (c["x"] + wx).alias("xmax"), (c["y"] + wy).alias("ymax")),
        )

    box = _let(F.conv(F.translate(h, ALPHABET, DIGITS), 32, 10).cast("long"), cell)
    kind = "struct<xmin:double,ymin:double,xmax:double,ymax:double>"
    bad = ~h.rlike(f"^[{ALPHABET}]{{1,{LENGTH}}}$")
    whole = F.struct(F.lit(-180.0).alias("xmin"), F.lit(-90.0).alias("ymin"), F.lit(180.0).alias("xmax"), F.lit(90.0).alias("ymax"))
    return F.when(h.isNull(), F.lit(None).cast(kind)).when(F.length(h) == 0, whole).when(bad, F.raise_error(F.lit("not a GeoHash")).cast(kind)).otherwise(box)
