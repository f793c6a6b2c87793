"""Answer parsing, rewards and small scalar functions, as column expressions."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

E = F.expr

# Answer patterns, markers of transient errors, sentinels of missing labels, size limits.
BLOCK = r"""\\{[^{}]*"points"\\s*:\\s*\\[\\s*(-?\\d+)\\s*\\][^{}]*\\}"""
MARKERS = ("temporarily unavailable", "timed out", "timeout", "connection reset", "rate limit", "try again")
NAMES = ("timeout", "connection", "connecterror")
UNAVAILABLE = ("", "x", "na", "n/a", "none", "null")
LONG, SHORT = 2000, 768


def parse_cell(text: str) -> Column:
    """The integer of the last answer block that has exactly one; else null."""
    return E(f"try_cast(try_element_at(regexp_extract_all({text}, '{BLOCK}', 1), -1) as int)")


def parse_point_first(text: str) -> Column:
    """The first number of the first block, spaces and newlines aside; -1 if there is none."""
    return E(f"""coalesce(try_cast(nullif(regexp_extract(replace(replace({text}, ' ', ''), '\\n', ''), '\\\\{{"points":\\\\[(-?[0-9]+)', 1), '') as int), -1)""")


def parse_event(text: str) -> Column:
    return F.initcap(F.nullif(F.regexp_extract(text, r"(?i)Event:\s*(Contact|Separation|Neither|None)", 1), F.lit("")))


def parse_frame(text: str) -> Column:
    return E(f"coalesce(try_cast(nullif(regexp_extract({text}, 'Frame:\\\\s*(-?\\\\d+)', 1), '') as int), -1)")


def cell_rewards(gt: str, sigma: float = 1.0, cells: int = 9) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(cells)), lambda c: F.exp(-((c - F.col(gt)) * (c - F.col(gt))) / (2.0 * sigma * sigma)))


def gaussian_reward(cell: str, gt: str, sigma: float = 1.0, cells: int = 9, invalid: float = 0.0) -> Column:
    far = F.col(cell) - F.col(gt)
    return F.when(F.col(cell).between(1, cells), F.exp(-(far * far) / (2.0 * sigma * sigma))).otherwise(invalid)


def reward_lookup(rewards: str, cell: str, invalid: float = 0.0) -> Column:
    return E(f"case when {cell} between 1 and size({rewards}) then {rewards}[{cell} - 1] else {invalid}D end")


def parse_label(text: str) -> Column:
    clean = F.lower(F.trim(text))
    return F.when(~clean.isin(*UNAVAILABLE), F.expr(f"try_cast(trim({text}) as int)"))


def redact(text: str, secret: str) -> Column:
    return F.substring(F.replace(F.col(text), F.lit(secret), F.lit("[REDACTED]")), 1, 4000)


def transient(status: str, name: str, message: str) -> Column:
    """408, 429 and 500 on are transient; without a status, names and messages of timeouts and lost connections."""
    named = F.lower(name).rlike("|".join(NAMES))
    said = F.lower(message).rlike("|".join(MARKERS))
    return F.when(F.col(status).isNotNull(), F.col(status).isin(408, 429) | (F.col(status) >= 500)).otherwise(F.coalesce(named | said, F.lit(False)))


def backoff(attempt: str, base: float = 1.0) -> Column:
    return F.lit(base) * F.pow(F.lit(2.0), F.col(attempt) - 1)


def result_key(episode: str, task: str, mode: str, trial: str) -> Column:
    return F.concat_ws("|", F.lpad(F.col(episode).cast("string"), 6, "0"), task, mode, F.col(trial).cast("string"))


def safe_name(text: str) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}]", "_"), "^_+|_+$", ""))


def stage_name(anchor: str, frame: str, flag: str) -> Column:
    suffix = F.when(F.col(frame).isNull(), "initial").when(F.col(flag) == "feedback", "visual_feedback").when(F.col(flag) == "speed", "speed_feedback").when(F.col(flag) == "fault", "missing_hand_speed").otherwise("resample")
    return F.concat_ws("_", F.col(anchor), suffix)


def clean_ints(values: str, distinct: bool = True) -> Column:
    kept = f"filter(transform({values}, v -> try_cast(v as int)), v -> v is not null)"
    return E(f"array_distinct({kept})" if distinct else kept)


def resized(width: str, height: str) -> Column:
    """struct<w, h>: long side at most LONG, short side at most SHORT; divisions cut off."""
    return E(f"""case when {width} > {height} then
      if(cast(least({width}, {LONG}) / ({width} / {height}) as int) > {SHORT}, named_struct('w', cast({SHORT} * ({width} / {height}) as int), 'h', {SHORT}), named_struct('w', cast(least({width}, {LONG}) as int), 'h', cast(least({width}, {LONG}) / ({width} / {height}) as int)))
      else if(cast(least({height}, {LONG}) * ({width} / {height}) as int) > {SHORT}, named_struct('w', {SHORT}, 'h', cast({SHORT} / ({width} / {height}) as int)), named_struct('w', cast(least({height}, {LONG}) * ({width} / {height}) as int), 'h', cast(least({height}, {LONG}) as int))) end""")


def parse_point_many(text: str) -> Column:
    """struct<point, many>: as parse_point_first, and whether the block names several numbers."""
    block = f"""regexp_extract(replace(replace({text}, ' ', ''), '\\n', ''), '\\\\{{"points":\\\\[([^\\\\]}}]*)', 1)"""
    return F.struct(parse_point_first(text).alias("point"), E(f"contains({block}, ',')").alias("many"))


def weighted_reward(*rewards: str, weights: tuple[float, ...] = (1.0, 0.0, 0.0)) -> Column:
    """Reward columns summed by weight; a missing reward counts as 0."""
    return sum((F.coalesce(F.col(r), F.lit(0.0)) * w for r, w in zip(rewards, weights, strict=True)), F.lit(0.0))


def conversational(text: str) -> Column:
    """A prompt as one user turn of an image part and a text part."""
    part = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.cast("string").alias("text"))
    return F.array(F.struct(F.lit("user").alias("role"), F.array(part("image", F.lit(None)), part("text", F.col(text))).alias("content")))


def _content(value: object) -> str:
    if value is None:
        return ""
    if isinstance(value, list):
        return "".join(map(_content, value))
    if isinstance(value, dict):
        if "text" in value:
            text = value["text"]
            return _content(text["value"] if isinstance(text, dict) and "value" in text else text)
        return _content(value.get("content", value.get("value")))
    return str(value)


def content_text(column: str) -> Column:
    """The text of an answer's content given as JSON, nested as it may be: strings and numbers, lists of parts, objects with text, content or value.

    Parts are joined without a separator, other objects and null give nothing; what is not JSON is taken as it is.
    An Arrow batch at a time, as SQL has no recursion over a value.
    """

    @F.pandas_udf("string")
    def flat(values: pd.Series) -> pd.Series:
        def one(text: str | None) -> str:
            try:
                return "" if text is None else _content(json.loads(text))
            except ValueError:
                return text

        return values.map(one, na_action=None)

    return flat(F.col(column))


def choices(values: list[str] | None, allowed: tuple, label: str = "choice") -> list:
    """The choices of comma-separated values, each once and in order; None chooses all, an unknown one is an error."""
    if values is None:
        return list(allowed)
    tokens = [t.strip() for v in values for t in str(v).split(",") if t.strip()]
    known = {str(a): a for a in allowed}
    if unknown := [t for t in tokens if t not in known]:
        raise ValueError(f"unknown {label}: {unknown}; known are {list(allowed)}")
    return list(dict.fromkeys(known[t] for t in tokens))
