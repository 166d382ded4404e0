"""End-to-end plans: cell quantification, same-section co-expression, spatial association."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calls
from ..operators import aggregates, envelopes, point_pattern, stochastic, windows
from ..operators.scratch import scratch_folder


def quantify(cells: DataFrame, by: list[str], signal: str, threshold: float) -> DataFrame:
    """Counts, percentage and confidence of each image."""
    scored = cells.withColumn("_pos", calls.dab_positive(F.col(signal), threshold))
    out = aggregates.image_counts(scored, by, "_pos")
    return out.withColumn("confidence", calls.confidence(F.col("total"), F.col("pct")))


def coexpression(cells: DataFrame, by: list[str], a: str, b: str, certified: DataFrame | None = None) -> DataFrame:
    """Contingency, exact test and corrected p of each certified sample; samples without a certificate stay, unscored."""
    tables = aggregates.fisher_exact(aggregates.contingency(cells, by, a, b))
    if certified is None:
        tables = tables.withColumn("certified", F.lit(True))
    else:
        tables = tables.join(certified.select(*by, F.lit(True).alias("certified")), by, "left").withColumn("certified", F.coalesce("certified", F.lit(False)))
    tables = tables.withColumn("p", F.when(F.col("certified"), F.col("p_fisher"))).withColumn("ord", F.concat_ws("|", *by)).withColumn("_one", F.lit(1))
    return envelopes.adjust(tables, ["_one"]).drop("_one", "ord")


#: Bands of the global test, in micrometres; the support null's whole band is narrower.
BANDS = {"all": (10.0, 50.0), "coloc": (10.0, 20.0), "coinfil": (20.0, 50.0)}
SUPPORT_BANDS = BANDS | {"all": (10.0, 30.0)}


def _needed(rmax: float, step: float, *bands: dict[str, tuple[float, float]]) -> float:
    """The largest radius that a global test over these bands looks at: curves beyond it change no verdict, and cost most of the pairs.  All radii count where a band holds none."""
    spans = [b for some in bands for b in some.values()]
    held = all(any(lo <= k * step <= hi for k in range(int(rmax // step) + 1)) for lo, hi in spans)
    return min(rmax, max(hi for _, hi in spans)) if held else rmax


def _verdicts(primary: DataFrame, csr: DataFrame, by: list[str], resolvable: Column) -> DataFrame:
    """p, robustness and the two band verdicts of each group, from its global tests under the primary null and CSR."""
    both = primary.select(*by, "band", F.col("p_two").alias("p"), "significant", "direction").join(csr.select(*by, "band", F.col("significant").alias("csr")), [*by, "band"])
    of = lambda band, c: F.max(F.when(F.col("band") == band, c))
    word = lambda seen: calls.band_verdict(seen, F.col("significant"), F.col("direction"), F.col("csr"))
    return both.withColumn("_seen", resolvable).groupBy(*by).agg(
        of("all", F.col("p")).alias("p"), of("all", F.col("direction")).alias("direction"), of("all", calls.robustness(F.col("significant"), F.col("csr"))).alias("robustness"),
        of("coloc", word(F.col("_seen"))).alias("coloc"), of("coinfil", word(F.lit(True))).alias("coinfil"),
    )


def _corrected(tests: DataFrame, by: list[str]) -> DataFrame:
    out = tests.withColumn("ord", F.concat_ws("|", *by)).withColumn("_one", F.lit(1))
    return envelopes.adjust(out, ["_one"]).drop("_one", "ord")


def association(a: DataFrame, b: DataFrame, support: DataFrame, by: list[str], width: float, height: float, n_perm: int, rmax: float, step: float) -> DataFrame:
    """Verdict of each sample for one pair of markers under the support null: by.., n_a, n_b, power, p, robustness, band verdicts and cohort q.

    Samples with an absent marker are routed away before the Monte-Carlo joins and come back as rows without a test.
    """
    sizes = point_pattern.group_sizes(a, b, by).withColumn("power", calls.power_grade(F.least("n_a", "n_b")))
    scratch_folder(a.sparkSession)
    rmax = _needed(rmax, step, BANDS)
    sizes = sizes.checkpoint()
    fit = sizes.where("power <> 'absent'").select(*by)
    # read again and again below, so written once
    a, b, support = (d.select(*by, "pt_id", "x", "y").join(fit, by, "left_semi").checkpoint() for d in (a, b, support))
    observed = point_pattern.cross_k(a, b, by, width * height, rmax, step).select(*by, "r_idx", "r", "k").checkpoint()
    csr = envelopes.global_test(stochastic.csr_null(a, b, by, width, height, n_perm, rmax, step), observed, by, BANDS)
    dense = envelopes.global_test(stochastic.support_null(a, b, support, by, width, height, n_perm, rmax, step), observed, by, BANDS)
    return _corrected(sizes.join(_verdicts(dense, csr, by, F.lit(True)).drop("direction"), by, "left"), by)


def spatial_batch(pts: DataFrame, pairs: DataFrame, found: DataFrame, parts: DataFrame, by: list[str], n_perm: int, rmax: float, step: float, seed: int = 0) -> DataFrame:
    """Association of many pairs of markers, each inside its sample's window and behind its gates; no pair is dropped.

    pairs(by.., a, b, qc, verdict): the markers, the registration's state and the certificate; found and parts as
    `windows.analysis_windows` gives them.  Rows: by.., pair, n_a, n_b, method, area, error, p, direction, robustness,
    coloc, coinfil, q.  A pair has an error and no test where the registration is invalid, where it isn't certified, where
    its window is invalid or missing, or where a marker has fewer than five points in the window, in this order.
    """
    key = [*by, "pair"]
    scratch_folder(pts.sparkSession)
    parts = parts.checkpoint()
    pts = windows.inside(pts, parts, by).checkpoint()
    pairs = pairs.withColumn("pair", F.concat("a", F.lit("__"), "b"))
    side = lambda c: pairs.select(*key, F.col(c).alias("marker")).join(pts, [*by, "marker"]).select(*key, "pt_id", "x", "y")
    a, b = side("a"), side("b")
    table = pairs.join(point_pattern.group_sizes(a, b, key), key, "left").na.fill(0, ["n_a", "n_b"]).join(found.select(*by, "method", "area", F.col("error").alias("_window")), by, "left")
    error = F.when(F.coalesce("qc", F.lit("invalid")) == "invalid", "registration_invalid").when(~F.coalesce(calls.analysable(F.col("verdict")), F.lit(False)), "uncertified").when(F.col("_window").isNotNull(), F.col("_window"))
    error = error.when(F.coalesce("area", F.lit(0.0)) <= 0, "no_window").when(F.least("n_a", "n_b") < 5, "marker_absent")
    table = table.withColumn("error", error).select(*key, "n_a", "n_b", "method", "area", "error").checkpoint()
    fit = table.where("error is null").select(*key, "area")
    a, b = (d.join(fit.select(*key), key, "left_semi").checkpoint() for d in (a, b))
    rmax = _needed(rmax, step, BANDS)
    own = fit.select(*key).join(parts, by)
    seen = point_pattern.cross_k(a, b, key, 1.0, rmax, step).join(fit, key).select(*key, "r_idx", "r", (F.col("k") * F.col("area")).alias("k")).checkpoint()
    csr = envelopes.global_test(windows.csr_null(a, b, fit, own, key, n_perm, rmax, step, seed), seen, key, BANDS)
    support = fit.select(*key).join(pts.select(*by, "pt_id", "x", "y"), by)
    dense = envelopes.global_test(windows.support_null(a, b, support, fit, own, key, n_perm, rmax, step, seed=seed), seen, key, BANDS)
    return _corrected(table.join(_verdicts(dense, csr, key, F.lit(True)), key, "left"), key)


def precheck(pts: DataFrame, by: list[str], markers: list[str], width: float, height: float, bandwidth: float = 75.0) -> DataFrame:
    """State of each marker of each sample before a test: by.., marker, n, n_support, power, scale, status.

    The scale of the tissue's architecture is that of all its points; a marker's own count decides only its power. A
    marker that a sample lacks counts 0.
    """
    tissue = stochastic.architecture_scale(pts, by, width, height).select(*by, F.col("n").alias("n_support"), "scale")
    n = pts.where(F.col("marker").isin(markers)).groupBy(*by, "marker").agg(F.count(F.lit(1)).alias("n"))
    every = tissue.withColumn("marker", F.explode(F.array(*[F.lit(m) for m in markers]))).join(n, [*by, "marker"], "left").na.fill(0, ["n"])
    power = calls.power_grade(F.col("n"))
    status = F.when(power == "absent", "marker_absent").when(power == "sparse", "underpowered_sparse_marker").otherwise(calls.architecture_verdict(F.col("scale"), bandwidth))
    return every.withColumn("power", power).withColumn("status", status).select(*by, "marker", "n", "n_support", "power", "scale", "status")


def null_plan(markers: DataFrame, by: list[str]) -> DataFrame:
    """Which null a sample gets from its markers' states (status, n, n_support, certified, has_window): by.., worst, primary_null, failed.

    The worst state decides: a scale at or above the bandwidth (ok, caution) takes the reweighted null; dense tissue or a
    sparse marker the support null if all its gates hold; an absent marker or an unknown scale fails closed.
    """
    g = markers.groupBy(*by).agg(F.min_by("status", calls.severity(F.col("status"))).alias("worst"), F.min("n").alias("n_min"), F.max("n_support").alias("n_support"), F.min("certified").alias("certified"), F.min("has_window").alias("has_window"))
    floor = F.when(F.col("worst") == "underpowered_sparse_marker", 5).otherwise(30)
    gates = F.filter(F.array(F.when(~F.col("certified"), F.lit("landmark_certified")), F.when(~F.col("has_window"), F.lit("analysis_window")), F.when(F.coalesce("n_support", F.lit(0)) == 0, F.lit("support_csv")), F.when(F.col("n_min") < floor, F.lit("min_positive")), F.when(F.col("n_support") < 500, F.lit("min_support"))), lambda x: x.isNotNull())
    fallback = F.col("worst").isin("dense_tissue", "underpowered_sparse_marker")
    plan = F.when(F.col("worst").isin("ok", "caution"), "reweighted").when(fallback & (F.size("failed") == 0), "dense_morphology").otherwise("none")
    return g.withColumn("failed", gates).withColumn("primary_null", plan).select(*by, "worst", "primary_null", F.array_join("failed", ",").alias("failed"))


def association_pairs(pts: DataFrame, by: list[str], markers: list[str], width: float, height: float, n_perm: int, rmax: float, step: float, certificates: DataFrame | None = None, bandwidth: float = 75.0, seed: int = 0) -> DataFrame:
    """Association of all pairs of markers (in their order) of each sample, each under the null that its plan names.

    pts(by.., marker, pt_id, x, y); certificates(by.., verdict, floor_um), by default all certified without a floor.
    Rows: by.., pair, n_a, n_b, worst, primary_null, floor_um, error, p, direction, robustness, coloc, coinfil, q.

    A pair has an error and no test where a marker is absent (marker_absent), where the registration error leaves no
    radius to read (no_interpretable_radius_band) or where no null holds (null_unavailable).  Close proximity is not
    resolvable where the floor reaches its band.
    """
    key = [*by, "pair"]
    order = [(x, y) for i, x in enumerate(markers) for y in markers[i + 1 :]]
    named = lambda side: F.explode(F.array(*[F.struct(F.lit(p[side]).alias("marker"), F.lit("__".join(p)).alias("pair")) for p in order]))
    pairs = pts.select(*by).distinct().withColumn("pair", F.explode(F.array(*[F.lit("__".join(p)) for p in order])))
    a, b = (pts.join(F.broadcast(pts.sparkSession.range(1).select(named(k).alias("p")).select("p.*")), "marker").select(*key, "pt_id", "x", "y") for k in (0, 1))
    counts = pairs.join(point_pattern.group_sizes(a, b, key), key, "left").na.fill(0, ["n_a", "n_b"])
    states = precheck(pts, by, markers, width, height, bandwidth)
    if certificates is None:
        certificates = pts.select(*by).distinct().withColumn("verdict", F.lit("CERTIFIED")).withColumn("floor_um", F.lit(None).cast("double"))
    states = states.join(certificates.select(*by, calls.analysable(F.col("verdict")).alias("certified")), by, "left").na.fill(False, ["certified"]).withColumn("has_window", F.lit(True))
    table = counts.join(null_plan(states, by).select(*by, "worst", "primary_null"), by).join(certificates.select(*by, "floor_um"), by, "left")
    error = F.when(F.least("n_a", "n_b") < 5, "marker_absent").when(F.col("floor_um") >= rmax, "no_interpretable_radius_band").when(F.col("primary_null") == "none", "null_unavailable")
    scratch_folder(pts.sparkSession)
    table = table.withColumn("error", error).checkpoint()

    rmax = _needed(rmax, step, BANDS, SUPPORT_BANDS)
    tested = []
    # each curve and test is done and written before the next one is planned: the driver plans, watches and broadcasts for one null at a time
    for null, bands in (("reweighted", BANDS), ("dense_morphology", SUPPORT_BANDS)):
        fit = table.where((F.col("primary_null") == null) & F.col("error").isNull()).select(*key, "floor_um")
        p, q = (d.join(fit.select(*key), key, "left_semi").checkpoint() for d in (a, b))
        plain = point_pattern.cross_k(p, q, key, width * height, rmax, step).select(*key, "r_idx", "r", "k").checkpoint()
        csr = envelopes.global_test(stochastic.csr_null(p, q, key, width, height, n_perm, rmax, step, seed), plain, key, bands).checkpoint()
        if null == "reweighted":
            observed = point_pattern.cross_k_inhomogeneous(p, q, key, bandwidth, width * height, rmax, step).checkpoint()
            curves = stochastic.reweighted_null(p, q, key, width, height, n_perm, rmax, step, bandwidth, seed)
        else:
            support = pts.select(*by, "pt_id", "x", "y").join(fit.select(*by).distinct(), by).checkpoint()
            curves, observed = stochastic.support_null(p, q, support, key, width, height, n_perm, rmax, step, seed=seed), plain
        primary = envelopes.global_test(curves, observed, key, bands).checkpoint()
        seen = F.coalesce(F.col("floor_um") < BANDS["coloc"][1], F.lit(True))
        tested.append(_verdicts(primary, csr, key, F.lit(True)).join(fit.select(*key, seen.alias("_seen")), key).withColumn("coloc", F.when(F.col("_seen"), F.col("coloc")).otherwise("not_resolvable")).drop("_seen"))
    return _corrected(table.join(tested[0].unionByName(tested[1]), key, "left"), key)


def worst_status(rows: DataFrame, by: list[str], status: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.min_by(status, calls.severity(F.col(status))).alias("worst"))


def tally(rows: DataFrame, by: list[str], verdict: str, p: str) -> DataFrame:
    """Counts, rate with Wald interval and p summaries of verdicts."""
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(p) <= 0.05).alias("n_significant"), F.avg(p).alias("mean_p"), F.percentile(p, 0.5).alias("median_p"), F.count_if(F.col(verdict) == "robust").alias("n_robust"))
    rate = F.col("n_significant") / F.col("n")
    return out.withColumn("rate", rate).withColumn("size_verdict", calls.size_verdict(rate, F.col("n")))


def running_ids(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """Positional keys for zip joins: 0, 1, .. within each group."""
    return rows.withColumn("cell_idx", F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1)
