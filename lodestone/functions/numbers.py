"""Rounding, costs, image sizes, client addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..defaults import Settings


def round_half_up(x: Column, places: int) -> Column:
    """To the nearest, halves towards positive infinity (F.round takes halves away from zero)."""
    scale = F.lit(10.0**places)
    return F.floor(x * scale + F.lit(0.5)) / scale


def estimate_usd(input_tokens: Column, output_tokens: Column, important: Column, settings: Settings | None = None) -> Column:
    """Cost of a generation, to 9 places; null if either count is null. An important rate counts only above zero."""
    s = settings or Settings()
    rate = lambda high, low: F.when(important, F.lit(high)).otherwise(F.lit(low)) if high > 0 else F.lit(low)
    million = F.lit(1_000_000.0)
    cost = input_tokens / million * rate(s.important_input_rate, s.input_rate) + output_tokens / million * rate(s.important_output_rate, s.output_rate)
    return round_half_up(cost, 9)


def effective_model(important: Column, model: Column, important_model: Column) -> Column:
    return F.when(important & (F.trim(important_model) != ""), important_model).otherwise(model)


def upscaled(width: Column, height: Column, min_long_side: int) -> Column:
    """struct(width, height) after enlarging a small image so that its long side is min_long_side; both round up."""
    long_side = F.greatest(width, height)
    scale = F.lit(float(min_long_side)) / F.greatest(long_side, F.lit(1))
    grown = F.struct(F.greatest(F.lit(1), F.ceil(width * scale).cast("int")).alias("width"), F.greatest(F.lit(1), F.ceil(height * scale).cast("int")).alias("height"))
    return F.when(long_side >= min_long_side, F.struct(width.cast("int").alias("width"), height.cast("int").alias("height"))).otherwise(grown)


#: Profiles, the long side that each wants, other names.
PROFILES = {"none": 0, "basic": 1600, "document_scan": 1800, "poster_safe": 1800}
PROFILE_ALIASES = {"raw": "none", "grayscale": "document_scan", "light_denoise": "document_scan"}


def normalized_profile(profile: Column) -> Column:
    out = profile
    for a, b in PROFILE_ALIASES.items():
        out = F.when(profile == a, F.lit(b)).otherwise(out)
    return F.when(out.isin(*PROFILES), out).otherwise(F.raise_error(F.concat(F.lit("unsupported profile: "), profile)).cast("string"))


def preprocess_plan(width: Column, height: Column, profile: Column) -> Column:
    """struct(operations, warnings, width, height): what preparing an image for recognition does, without its pixels."""
    p = normalized_profile(profile)
    long_side = F.greatest(width, height)
    size = upscaled(width, height, 1800)
    size = F.when(p == "none", F.struct(width.cast("int").alias("width"), height.cast("int").alias("height"))).when(p == "basic", upscaled(width, height, 1600)).otherwise(size)
    least = F.when(p == "basic", 1600).otherwise(1800)
    resize = F.when(long_side >= least, F.concat(F.lit("resize_skipped_long_side_"), long_side.cast("string"))).otherwise(F.concat(F.lit("upscale_long_side_to_"), least.cast("string")))
    first = F.array(F.lit("orientation_checked_no_rotation"), resize)
    ops = F.when(p == "none", F.array(F.lit("use_original_image"))).when(p == "basic", first)
    ops = ops.when(p == "poster_safe", F.concat(first, F.array(F.lit("mild_sharpen_color_preserved"))))
    ops = ops.otherwise(F.concat(first, F.array(*map(F.lit, ("grayscale", "autocontrast", "median_denoise_size_3")))))
    warn = F.when(p == "poster_safe", F.array(F.lit("thresholding_skipped_to_preserve_colored_poster_text")))
    warn = warn.when(p == "document_scan", F.array(F.lit("deskew_skipped_cv2_not_installed"), F.lit("hard_thresholding_skipped_to_avoid_text_loss"))).otherwise(F.array().cast("array<string>"))
    return F.struct(ops.alias("operations"), warn.alias("warnings"), size["width"].alias("width"), size["height"].alias("height"))


def normal_address(address: Column) -> Column:
    a = F.trim(address)
    a = F.when(a.startswith("::ffff:"), F.substring(a, 8, 1000)).otherwise(a)
    return F.when(F.coalesce(F.trim(address), F.lit("")) == "", F.lit(None).cast("string")).when(a == "0:0:0:0:0:0:0:1", F.lit("::1")).otherwise(a)


def client_ip(remote: Column, forwarded_for: Column, real_ip: Column, trusted: list[str], trust_headers: bool = True) -> Column:
    """The request's address: forwarded headers count only from a trusted proxy (`*` trusts all)."""
    own = normal_address(remote)
    if not trust_headers:
        return own
    known = F.array(*[normal_address(F.lit(t)) for t in trusted if t != "*"]) if [t for t in trusted if t != "*"] else F.array().cast("array<string>")
    is_trusted = own.isNotNull() & (F.lit("*" in trusted) | F.coalesce(F.array_contains(known, own), F.lit(False)))
    first = F.trim(F.element_at(F.split(forwarded_for, ","), 1))
    return F.when(~is_trusted | is_trusted.isNull(), own).otherwise(F.coalesce(normal_address(first), normal_address(real_ip), own))


def clamped(c: Column, low: int, high: int) -> Column:
    """c, or the bound that it lies beyond; a null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))
