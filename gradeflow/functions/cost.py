"""Token counts and cost rules.

Prices are per million tokens.  Costs are computed in whole units of 10^-12
dollar on BIGINT and become DECIMAL once, at the end: that is exact, sums do
not depend on row order, and the generated code stays small.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gradeflow.functions.text import as_col, whole_div
from gradeflow.schemas import MONEY

# Fixed values of the provider rules.
TOKEN_PROVIDERS = ("openai", "anthropic")  # image tokens are part of the input tokens
IMAGE_PROVIDERS = ("gemini", "vertex")  # images are priced apart
PROVIDERS = TOKEN_PROVIDERS + IMAGE_PROVIDERS
CHARS_PER_TOKEN = 4
TILE_BASE, TILE_COST, TILE_SIDE, TILE_FIT, TILE_SHORT = 85, 170, 512, 2048, 768
AREA_PER_TOKEN = 750
FALLBACK_IMAGE_TOKENS = {"openai": 765, "anthropic": 1600, "gemini": 258, "vertex": 258}
ESTIMATE_INPUT_TOKENS, ESTIMATE_OUTPUT_TOKENS = 1000, 200


def text_tokens(text: Column | str) -> Column:
    """A quarter of the number of characters, rounded down; 0 for no text."""
    return F.coalesce(F.floor(F.char_length(as_col(text)) / CHARS_PER_TOKEN), F.lit(0)).cast("bigint")


def tile_tokens(width: Column | str, height: Column | str, detail: str = "high") -> Column:
    """Image tokens counted in tiles, after the image is scaled down twice."""
    if detail == "low":
        return F.lit(TILE_BASE).cast("bigint")
    w, h = as_col(width).cast("double"), as_col(height).cast("double")
    ratio = F.when(F.greatest(w, h) > TILE_FIT, F.least(TILE_FIT / w, TILE_FIT / h))
    w1 = F.coalesce(F.floor(w * ratio).cast("double"), w)
    h1 = F.coalesce(F.floor(h * ratio).cast("double"), h)
    short, long = F.least(w1, h1), F.greatest(w1, h1)
    over = short > TILE_SHORT
    short2 = F.when(over, F.lit(float(TILE_SHORT))).otherwise(short)
    long2 = F.when(over, F.floor(long * (TILE_SHORT / short)).cast("double")).otherwise(long)
    tiles = F.ceil(short2 / TILE_SIDE) * F.ceil(long2 / TILE_SIDE)
    return (tiles * TILE_COST + TILE_BASE).cast("bigint")


def area_tokens(width: Column | str, height: Column | str) -> Column:
    """Image tokens counted by area."""
    pixels = as_col(width).cast("bigint") * as_col(height).cast("bigint")
    return F.ceil(pixels / AREA_PER_TOKEN).cast("bigint")


def image_tokens(provider: Column | str, width: Column, height: Column) -> Column:
    """Image tokens by provider rule; an unreadable image (NULL size) gets the fallback."""
    provider = as_col(provider)
    tokens = F.when(provider == "openai", tile_tokens(width, height)).when(
        provider == "anthropic", area_tokens(width, height)
    )
    fallback = F.lit(None).cast("bigint")
    for name, value in FALLBACK_IMAGE_TOKENS.items():
        fallback = F.when(provider == name, F.lit(value).cast("bigint")).otherwise(fallback)
    return F.coalesce(tokens, fallback)


_UNITS_PER_MICRO = 1_000_000  # units of 10^-12 dollar in a millionth of a dollar


def _price_units(price: Column) -> Column:
    """A price as whole millionths of a dollar; times tokens that is units of 10^-12 dollar."""
    return F.coalesce(F.rint(price.cast("double") * 1e6).cast("bigint"), F.lit(0).cast("bigint"))


def _priced(*parts: tuple[Column, Column]) -> Column:
    """Sum of tokens x price, in units."""
    units = None
    for tokens, price in parts:
        part = tokens.cast("bigint") * _price_units(price)
        units = part if units is None else units + part
    return units


def _discounted(units: Column, pricing: Column) -> Column:
    """Less the discount, to the nearest unit.  Split in two, so that it cannot overflow."""
    off = F.greatest(F.coalesce(pricing["discount_percent"].cast("double"), F.lit(0.0)), F.lit(0.0))
    keep = F.lit(10_000).cast("bigint") - F.rint(off * 100).cast("bigint")
    head = whole_div(units, 10_000) * keep
    tail = whole_div((units % 10_000) * keep * 2 + 10_000, 20_000)
    return head + tail


def money(units: Column) -> Column:
    """Units of 10^-12 dollar as DECIMAL dollars."""
    return (units.cast("decimal(19,0)") * F.lit("0.000000000001").cast("decimal(12,12)")).cast(MONEY)


def sum_money(units: Column) -> Column:
    """Exact sum of units as DECIMAL dollars: two BIGINT sums, joined once per group."""
    high = F.sum(whole_div(units, _UNITS_PER_MICRO)).cast("decimal(19,0)")
    low = F.sum(units % _UNITS_PER_MICRO).cast("decimal(19,0)")
    total = (high * F.lit(_UNITS_PER_MICRO).cast("decimal(7,0)") + low).cast("decimal(25,0)")
    return (total * F.lit("0.000000000001").cast("decimal(12,12)")).cast("decimal(38,12)")


def _image_units(pricing: Column) -> Column:
    return _price_units(pricing["image_price_val"]) * F.lit(_UNITS_PER_MICRO).cast("bigint")


def _per_image(pricing: Column) -> Column:
    return F.coalesce(pricing["image_price_mode"], F.lit("per_image")) == "per_image"


def estimate_cost(
    provider: Column | str,
    input_tokens: Column,
    output_tokens: Column,
    image_token_total: Column,
    image_count: Column,
    pricing: Column | str,
) -> Column:
    """Expected cost of one request by provider rule; unknown provider gives NULL."""
    provider, pricing = as_col(provider), as_col(pricing)
    in_price, out_price = pricing["input_price_per_1m"], pricing["output_price_per_1m"]
    apart = provider.isin(*IMAGE_PROVIDERS)
    # Images are tokens of the input, or a price of their own.
    as_tokens = F.when(provider.isin(*TOKEN_PROVIDERS), image_token_total).when(
        apart & ~_per_image(pricing), image_count * FALLBACK_IMAGE_TOKENS["gemini"]
    ).when(apart, F.lit(0).cast("bigint"))
    images = F.when(apart & _per_image(pricing), image_count * _image_units(pricing)).otherwise(0)
    units = _priced((input_tokens + as_tokens, in_price), (output_tokens, out_price)) + images
    return money(_discounted(units, pricing))


def actual_cost_units(
    provider: Column | str,
    prompt_tokens: Column,
    completion_tokens: Column,
    pricing: Column | str,
    has_image: Column | bool = False,
) -> Column:
    """Cost of one finished request in units of 10^-12 dollar, as BIGINT."""
    provider, pricing = as_col(provider), as_col(pricing)
    has_image = F.lit(has_image) if isinstance(has_image, bool) else has_image
    by_image = has_image & provider.isin(*IMAGE_PROVIDERS) & _per_image(pricing)
    units = _priced(
        (prompt_tokens, pricing["input_price_per_1m"]), (completion_tokens, pricing["output_price_per_1m"])
    ) + F.when(by_image, _image_units(pricing)).otherwise(0)
    # One provider rounds every request to a millionth of a dollar.
    grain = F.when(provider == "vertex", _UNITS_PER_MICRO).otherwise(1).cast("bigint")
    rounded = whole_div(_discounted(units, pricing) * 2 + grain, grain * 2) * grain
    known = provider.isin(*PROVIDERS) & pricing.isNotNull()
    return F.when(known, F.coalesce(rounded, F.lit(0))).otherwise(0).cast("bigint")


def actual_cost(
    provider: Column | str,
    prompt_tokens: Column,
    completion_tokens: Column,
    pricing: Column | str,
    has_image: Column | bool = False,
) -> Column:
    """Cost of one finished request; 0 without pricing or for an unknown provider."""
    return money(actual_cost_units(provider, prompt_tokens, completion_tokens, pricing, has_image))


def rough_estimate(pricing: Column | str, image_count: Column) -> Column:
    """The fixed-size estimate: 1000 input and 200 output tokens per image.

    Kept under its own name because it divides the image price by a million,
    unlike :func:`actual_cost`.
    """
    pricing = as_col(pricing)
    units = _priced(
        (F.lit(ESTIMATE_INPUT_TOKENS), pricing["input_price_per_1m"]),
        (F.lit(ESTIMATE_OUTPUT_TOKENS), pricing["output_price_per_1m"]),
    ) + _price_units(pricing["image_price_val"])
    per_image = money(_discounted(units, pricing))
    total = (per_image * image_count.cast("decimal(14,0)")).cast("decimal(38,12)")
    return F.struct(
        F.round(total, 6).alias("estimated_cost"),
        image_count.cast("bigint").alias("image_count"),
        F.round(per_image, 6).alias("avg_cost_per_image"),
    )


_RAW_RESPONSE = (
    "struct<"
    "choices: array<struct<message: struct<content: string>>>,"
    "content: array<struct<text: string>>,"
    "candidates: array<struct<content: struct<parts: array<struct<text: string>>>>>,"
    "usage: struct<prompt_tokens: bigint, completion_tokens: bigint, total_tokens: bigint,"
    " input_tokens: bigint, output_tokens: bigint>,"
    "usageMetadata: struct<promptTokenCount: bigint, candidatesTokenCount: bigint, totalTokenCount: bigint>"
    ">"
)


def read_response(provider: Column | str, raw_json: Column | str) -> Column:
    """Stored provider reply to (text, prompt_tokens, completion_tokens, total_tokens).

    The reply is parsed once, with one schema that covers every provider.
    """
    provider = as_col(provider)
    reply = F.from_json(as_col(raw_json), _RAW_RESPONSE)
    first = F.lit(0)
    usage, meta = reply["usage"], reply["usageMetadata"]
    text = (
        F.when(provider == "openai", F.get(reply["choices"], first)["message"]["content"])
        .when(provider == "anthropic", F.get(reply["content"], first)["text"])
        .when(
            provider.isin(*IMAGE_PROVIDERS),
            F.get(F.get(reply["candidates"], first)["content"]["parts"], first)["text"],
        )
    )

    def number(openai: Column, anthropic: Column, google: Column) -> Column:
        value = (
            F.when(provider == "openai", openai)
            .when(provider == "anthropic", anthropic)
            .when(provider.isin(*IMAGE_PROVIDERS), google)
        )
        return F.coalesce(value, F.lit(0).cast("bigint"))

    zero = F.lit(0).cast("bigint")
    both = F.coalesce(usage["input_tokens"], zero) + F.coalesce(usage["output_tokens"], zero)
    return F.struct(
        F.coalesce(text, F.lit("")).alias("text"),
        number(usage["prompt_tokens"], usage["input_tokens"], meta["promptTokenCount"]).alias("prompt_tokens"),
        number(usage["completion_tokens"], usage["output_tokens"], meta["candidatesTokenCount"]).alias(
            "completion_tokens"
        ),
        number(usage["total_tokens"], both, meta["totalTokenCount"]).alias("total_tokens"),
    )
