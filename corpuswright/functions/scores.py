"""Column builders over score vectors and scalar scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C


def f32(x: float) -> Column:
    """A threshold as the float that a float column holds."""
    return F.lit(x).cast("float")


def max_score(ts: Column) -> Column:
    return F.array_max(ts)


def stem_core(ts: Column) -> Column:
    return F.greatest(*[F.get(ts, i) for i in C.STEM_CORE])


def active_labels(ts: Column, threshold: float = C.TOPIC_THRESHOLD) -> Column:
    return F.size(F.filter(ts, lambda x: x >= f32(threshold)))


def multi_label_bonus(n: Column) -> Column:
    return F.least(n * F.lit(0.05), F.lit(0.15))


def web_relevance(ts: Column, complexity: Column, threshold: float = C.TOPIC_THRESHOLD) -> Column:
    """Stem core, plus a bonus for several labels, plus a tenth of complexity (in single precision, as stored)."""
    return stem_core(ts).cast("double") + multi_label_bonus(active_labels(ts, threshold)) + (complexity * f32(0.1)).cast("double")


def code_relevance(structured_data: Column, quality: Column) -> Column:
    return (structured_data / f32(3.0)).cast("float").cast("double") + F.when(quality >= f32(C.QUALITY_BOOST), 0.1).otherwise(0.0)


def in_group(ts: Column, labels: tuple[int, ...], threshold: float = C.TOPIC_THRESHOLD) -> Column:
    return reduce(lambda a, b: a | b, [F.get(ts, i) >= f32(threshold) for i in labels])


def assigned_groups(ts: Column, threshold: float = C.TOPIC_THRESHOLD) -> Column:
    return F.array_compact(F.array(*[F.when(in_group(ts, labels, threshold), F.lit(name)) for name, labels, _, _ in C.GROUPS]))


def _bin(x: Column, bins) -> Column:
    """By lower bounds; what lies below the first, and NaN, is in the first."""
    out = F.lit(bins[0][0])
    for name, low, _, _ in bins[1:]:
        out = F.when((x >= f32(low)) & ~F.isnan(x), name).otherwise(out)
    return out


def complexity_bin(x: Column) -> Column:
    return F.when(F.isnan(x), "L1").when(x >= f32(3.25), "L4").when(x >= f32(2.5), "L3").when(x >= f32(1.75), "L2").otherwise("L1")


def sd_bin(x: Column) -> Column:
    return F.when(F.isnan(x), "SD0").when(x >= f32(2.5), "SD3").when(x >= f32(1.5), "SD2").when(x >= f32(0.5), "SD1").otherwise("SD0")


def lookup(key: Column, table: dict[str, str], default: str | None = None) -> Column:
    """A literal map; null (or the default) where the key is absent."""
    found = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]
    return found if default is None else F.coalesce(found, F.lit(default))


def content_group(content_type: Column) -> Column:
    return lookup(content_type, C.CONTENT_GROUPS, C.LOW_VALUE)


def language_slice(lang: Column) -> Column:
    return lookup(F.lower(lang), C.slice_languages())


def argmax_name(v: Column, names: tuple[str, ...]) -> Column:
    """The first largest."""
    return F.get(F.array(*[F.lit(n) for n in names]), (F.array_position(v, F.array_max(v)) - 1).cast("int"))


def sigmoid(v: Column) -> Column:
    return F.transform(v, lambda x: 1 / (1 + F.exp(-x.cast("double"))))


def approx_complexity(probabilities: Column) -> Column:
    return F.array_max(probabilities) * 4.0


def multi_hot(probabilities: Column, threshold: float = 0.5) -> Column:
    """Strictly above."""
    return F.transform(probabilities, lambda x: x > threshold)


def level(x: Column, low: int, high: int) -> Column:
    """Round half to even, and clip."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.rint(x.cast("double")).cast("int")))


def token_estimate(size: Column) -> Column:
    return F.floor(size / 4).cast("long")


def pad_bucket(n: Column, buckets: tuple[int, ...] = C.PAD_BUCKETS_WEB) -> Column:
    """The least bucket that holds n; beyond all, the largest."""
    out = F.lit(buckets[-1])
    for b in reversed(buckets):
        out = F.when(n <= b, b).otherwise(out)
    return out


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.when(whole > 0, F.round(part * 100.0 / whole, digits)).otherwise(0.0)


def short_number(x: Column) -> Column:
    return F.when(x >= 1_000_000, F.format_string("%.1fM", x / 1e6)).when(x >= 1_000, F.format_string("%.1fK", x / 1e3)).otherwise(x.cast("long").cast("string"))


def cosine_lr(step: Column, peak: float, low: float, warmup: int, steps: int) -> Column:
    progress = (step - warmup) / F.lit(float(steps - warmup))
    return F.when(step < warmup, peak * (step + 1) / warmup).when(step >= steps, low).otherwise(low + (peak - low) * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * progress)))


def perplexity(loss: Column) -> Column:
    return F.exp(F.least(loss, F.lit(20.0)))
