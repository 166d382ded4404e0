"""Cell and image calls: positivity, confidence, gates, verdicts, threshold chains.

Comparisons follow each path's own rule (> or >=); NaN counts as not measured
everywhere, as both engines would otherwise sort it above every number.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def measured(v: Column) -> Column:
    """The value, or null where it is null, NaN or infinite."""
    return F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")), v)


def dab_positive(v: Column, threshold) -> Column:
    """Strictly above the threshold; not measured is negative."""
    return F.coalesce(F.when(~F.isnan(v), v > threshold), F.lit(False))


def ring_positive(ring: Column, threshold, before: Column) -> Column:
    """By the ring mean; a degenerate cell keeps its call."""
    return F.coalesce(measured(ring) > threshold, before)


def complete_membrane(share: Column, share_min, p90: Column | None = None, p90_min=None) -> Column:
    out = share >= share_min
    return out if p90_min is None else out & (p90 > p90_min)


def at_least(v: Column, threshold) -> Column:
    """Same-section rule: at or above the threshold; not measured is negative."""
    return F.coalesce(measured(v) >= threshold, F.lit(False))


def two_marker_category(a: Column, b: Column, ta, tb) -> Column:
    sign = lambda c, t: F.when(at_least(c, t), "+").otherwise("-")
    return F.when(measured(a).isNull() | measured(b).isNull(), "UNMEASURED").otherwise(F.concat(F.lit("A"), sign(a, ta), F.lit("/B"), sign(b, tb)))


def is_positive_class(name: Column) -> Column:
    """Exactly "Positive"."""
    return F.coalesce(name == "Positive", F.lit(False))


def mentions_positive(name: Column) -> Column:
    """"positive" anywhere, in any case."""
    return F.coalesce(F.lower(name).contains("positive"), F.lit(False))


def confidence(total: Column, pct: Column) -> Column:
    return F.when((total < 50) | (pct < 0.1) | (pct > 95), "LOW").otherwise("HIGH")


def cells_per_mm2(total: Column, width: Column, height: Column, px_um: Column) -> Column:
    return F.try_divide(total, width * height * px_um * px_um / 1e6)


def density_warning(density: Column, px_source: Column) -> Column:
    return (px_source == "default") | ~density.between(100, 20000)


def radius_floor(tre: Column, factor: float = 3.0, digits: int = 3) -> Column:
    """Smallest interpretable distance; null where the error is unknown or no error at all."""
    return F.when(measured(tre) >= 0, F.bround(measured(tre) * factor, digits))


def architecture_verdict(scale: Column, bandwidth: float = 75.0) -> Column:
    return F.when(scale.isNull(), "unknown").when(scale >= 2 * bandwidth, "ok").when(scale >= bandwidth, "caution").otherwise("dense_tissue")


def power_grade(n: Column) -> Column:
    return F.when(n >= 30, "adequate").when(n >= 5, "sparse").otherwise("absent")


#: Worst first.
SEVERITY = ["marker_absent", "underpowered_sparse_marker", "unknown", "dense_tissue", "caution", "ok"]


def severity(status: Column) -> Column:
    return F.coalesce(*[F.when(status == s, F.lit(k)) for k, s in enumerate(SEVERITY)], F.lit(len(SEVERITY)))


def registration_status(method: Column, residual_um: Column, overlap: Column, valid_um: float = 5.0, warn_um: float = 10.0, overlap_min: float = 0.5) -> Column:
    """invalid / warning / valid, by the first rule that applies."""
    return (
        F.when(method.isNull() | (method == "identity"), "invalid")
        .when(residual_um.isNull(), "invalid")
        .when(overlap < overlap_min, "invalid")
        .when(residual_um >= warn_um, "invalid")
        .when(residual_um >= valid_um, "warning")
        .otherwise("valid")
    )


def structural_verdict(median_um: Column, region_max_um: Column, overlap: Column) -> Column:
    return F.when(overlap < 0.10, "FAILED").when((median_um <= 5) & (region_max_um <= 15), "CERTIFIED").when(median_um <= 5, "LOCALLY_CERTIFIED").otherwise("NOT_CERTIFIABLE")


def statistics_valid(registration_valid: Column, bandwidth_valid: Column, dense: Column) -> Column:
    return registration_valid & (bandwidth_valid | dense)


def analysable(verdict: Column) -> Column:
    return verdict.isin("CERTIFIED", "LOCALLY_CERTIFIED", "RADIUS_LIMITED")


def robustness(primary_significant: Column, csr_significant: Column) -> Column:
    return F.when(F.coalesce(primary_significant, F.lit(False)), "robust").when(F.coalesce(csr_significant, F.lit(False)), "csr_only").otherwise("none")


def band_verdict(resolvable: Column, significant: Column, direction: Column, csr_significant: Column) -> Column:
    word = F.when(direction == "association", "attraction").when(direction == "segregation", "segregation").otherwise("none")
    return F.when(~resolvable, "not_resolvable").when(F.coalesce(significant, F.lit(False)), word).when(F.coalesce(csr_significant, F.lit(False)), "csr_only").otherwise("none")


def size_verdict(rate: Column, n: Column, nominal: float = 0.05, z: float = 1.96) -> Column:
    """Of a simulated rejection rate, by its Wald interval."""
    half = z * F.sqrt(rate * (1 - rate) / n)
    return F.when(rate + half < nominal, "conservative").when(rate - half > nominal, "anti_conservative").when(rate.between(0.03, 0.07), "pass").otherwise("borderline")


def pixel_size_chain(manual: Column, from_metadata: Column, from_ui: Column, from_name: Column, default: float = 0.5):
    """(pixel size, where it comes from), the first of the sources that is known and above 0."""
    use = lambda c: F.when(measured(c) > 0, c)
    value = F.coalesce(use(manual), use(from_metadata), use(from_ui), use(from_name), F.lit(default))
    source = F.when(use(manual).isNotNull(), "override").when(use(from_metadata).isNotNull(), "metadata").when(use(from_ui).isNotNull(), "ui").when(use(from_name).isNotNull(), "filename").otherwise("default")
    return value, source


def cytoplasm_route(override: Column, listed: Column, name: Column, tokens: list[str]) -> Column:
    """Whether a marker is measured in the cytoplasm: what was set by hand, else by the list, else whether its name holds a token."""
    held = [F.lower(name).contains(t) for t in tokens]
    found = held[0]
    for h in held[1:]:
        found = found | h
    return F.coalesce(override, listed, found, F.lit(False))
