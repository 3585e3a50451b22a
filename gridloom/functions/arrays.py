"""Array columns: band selection, embeddings, dense token maps, augmentation on tiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Band order of the optical and radar stacks, and the named subsets.
S2_BANDS = ("B01", "B02", "B03", "B04", "B05", "B06", "B07", "B08", "B8A", "B09", "B11", "B12")
S1_BANDS = ("VV_dB", "VH_dB", "VV_minus_VH_dB")
S2_SETS = {"all": S2_BANDS, "rgb": ("B04", "B03", "B02"), "rgb_nir": ("B04", "B03", "B02", "B08")}
S1_SETS = {"all": S1_BANDS, "vv_vh": ("VV_dB", "VH_dB"), "vv": ("VV_dB",), "vh": ("VH_dB",), "vvdiff": ("VV_minus_VH_dB",)}

# Augmentation names in the order they are handed out.
AUGMENTATIONS = (
    "none", "rot90", "rot180", "rot270", "hflip", "vflip", "hflip_rot90", "vflip_rot90", "gain_up", "gain_down",
    "s1_gain_up", "s1_gain_down", "s2_gain_up", "s2_gain_down", "rot90_gain_up", "rot90_gain_down", "hflip_gain_up",
    "hflip_gain_down",
)
GEOMETRIES = ("none", "rot90", "rot180", "rot270", "hflip", "vflip", "hflip_rot90", "vflip_rot90")
GAINS = (None, *(f"{bands}gain_{way}" for bands in ("", "s1_", "s2_") for way in ("up", "down")))
#: Geometry and gain of every name that joins the two; "none" is only written where both are absent.
AUGMENTATION_PARTS = {"_".join(p for p in (g if g != "none" or not a else "", a) if p): (g, a) for g in GEOMETRIES for a in GAINS}


def select_bands(bands: Column, names: Sequence[str], order: Sequence[str]) -> Column:
    """Sub-array of the named bands, in the order of `names`."""
    return F.array(*[bands[list(order).index(n)] for n in names])


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, eps: float = 1e-12) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(eps))



def tokens_to_chw(flat: Column, tokens: int, channels: int, channels_first: bool = False, drop_class_token: bool = True) -> tuple[Column, int]:
    """Flat (tokens, C) or (C, tokens) values to flat (C, h, w), with the square side.

    The class token (the first one) goes when the rest forms a square.
    """
    rest = tokens - 1
    skip = 1 if drop_class_token and tokens > 1 and round(rest**0.5) ** 2 == rest else 0
    kept = tokens - skip
    side = round(kept**0.5)
    if side * side != kept:
        raise ValueError(f"{tokens} tokens do not form a square grid")
    t, c = (tokens, channels)

    def at(i: Column) -> Column:
        channel, token = F.floor(i / kept).cast("int"), (i % kept) + skip
        source = channel * t + token if channels_first else token * c + channel
        return F.get(flat, source.cast("int"))

    return F.transform(F.sequence(F.lit(0), F.lit(kept * channels - 1)), at), side


def hwc_to_chw(flat: Column, h: int, w: int, channels: int) -> Column:
    def at(i: Column) -> Column:
        cell = i % (h * w)
        return F.get(flat, (cell * channels + F.floor(i / (h * w))).cast("int"))

    return F.transform(F.sequence(F.lit(0), F.lit(h * w * channels - 1)), at)


def augmented_cell(r: Column, c: Column, size: int, geometry: str) -> tuple[Column, Column]:
    """Where a cell of a square patch lands under a flip and then a counter-clockwise quarter turn."""
    last = size - 1
    for step in [] if geometry == "none" else geometry.split("_"):
        if step == "hflip":
            c = last - c
        elif step == "vflip":
            r = last - r
        else:
            for _ in range(int(step.removeprefix("rot")) // 90):
                r, c = last - c, r
    return r, c


def gained(band: str, value: Column, gain: str | None, limit: float = 6.0) -> Column:
    """Radiometric gain on all, radar or optical bands, clipped to +-limit; no gain leaves the value as it is."""
    if gain is None:
        return value
    factor = 1.10 if gain.endswith("_up") else 0.90
    radar = band.startswith("s1")
    hit = gain.startswith("gain") or (gain.startswith("s1") and radar) or (gain.startswith("s2") and not radar)
    scaled = value * F.lit(factor) if hit else value
    return F.least(F.greatest(scaled, F.lit(-limit)), F.lit(limit))


def augmented(px: DataFrame, names: Sequence[str], size: int, bands: Mapping[str, str]) -> DataFrame:
    """Cells of square patches under every named augmentation, from one scan: `augmentation`, moved r and c, gained bands.

    `bands` maps a band's name (which tells radar from optical) to its column; other columns are repeated.
    """
    variants = []
    for name in names:
        geometry, gain = AUGMENTATION_PARTS[name]
        r, c = augmented_cell(F.col("r"), F.col("c"), size, geometry)
        values = [gained(band, F.col(column), gain).alias(column) for band, column in bands.items()]
        variants.append(F.struct(F.lit(name).alias("augmentation"), r.alias("r"), c.alias("c"), *values))
    rest = [x for x in px.columns if x not in ("r", "c", *bands.values())]
    return px.select(*rest, F.inline(F.array(*variants)))
