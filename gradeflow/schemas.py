"""Column types shared by the operators."""

from __future__ import annotations

# One answer, kept typed so that filters and statistics work on it.  Counts are
# DECIMAL(38,0): a model may answer with more digits than a BIGINT holds.
ANSWER = "struct<value_bool: boolean, value_count: decimal(38,0), value_str: string>"
PARSED = "struct<value_bool: boolean, value_count: decimal(38,0), value_str: string, raw: string>"

MONEY = "decimal(24,12)"

PRICING = (
    "struct<input_price_per_1m: decimal(12,6), output_price_per_1m: decimal(12,6),"
    " image_price_mode: string, image_price_val: decimal(12,6), discount_percent: decimal(5,2)>"
)

STEP = (
    "struct<step_number: int, raw_output: string, latency_ms: bigint, prompt_tokens: bigint,"
    " completion_tokens: bigint, attempts: int, error: string>"
)
STEPS = f"array<{STEP}>"

PROMPT_CHAIN = "array<struct<step_number: int, system_message: string, prompt: string>>"

# Question types and dataset states.
QUESTION_TYPES = ("binary", "multiple_choice", "text", "count")
READY_STATES = ("ready", "completed")
