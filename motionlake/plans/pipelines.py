"""Composite jobs: each is one lazy plan over all references."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionlake.functions import labels as lab
from motionlake.functions import times
from motionlake.operators import autolabel, corrections, coverage, extraction, intervals, metrics, models, reshape, segments, selection
from motionlake.operators.coverage import FEET
from motionlake.sources import sinks


def label_windows(windows: DataFrame, labels: DataFrame) -> DataFrame:
    """Windows whose center lies in a labelled interval, with its label as mov_type."""
    centers = windows.withColumn("time_center", times.from_micros(F.col("center_us")))
    found = intervals.label_points(centers, labels, time="time_center").where(F.col("label").isin(lab.WALKING, lab.NOT_WALKING))
    return found.withColumnRenamed("label", "mov_type")


def binary_dataset(windows: DataFrame, signals: Sequence[str], feet: Sequence[str] = FEET) -> DataFrame:
    """One row for each labelled center, columns of both feet and all signals, complete rows only, with target."""
    powers = [c for c in windows.columns if c.startswith("p_")]
    names = [f"{f}_{s}" for f in feet for s in signals]
    wide = reshape.to_wide(windows, keys=["reference", "center_us", "mov_type"], name=F.concat_ws("_", "foot", "signal"), names=names, values=powers)
    return lab.with_target(reshape.complete_rows(wide)).withColumn("target", F.col("target").cast("int"))


def main_dataset(samples: DataFrame, windows: DataFrame, labels: DataFrame, *, signals: Sequence[str], **how: object) -> DataFrame:
    """Requested windows with a role in the main dataset, their spectra, labels, the union without repeated rows, and
    the binary table. windows: request_id, reference, start, stop, label, duration_s."""
    asked = selection.assign_roles(windows).where("use_for_main_dataset").select("request_id", "reference", "start", "stop")
    labelled = label_windows(extraction.spectrogram(samples, asked, signals=signals, **how), labels)
    return binary_dataset(labelled.drop("request_id", "completeness", "time_center").distinct(), signals)


def requests_of(labels: DataFrame) -> DataFrame:
    """One request for each reference: from its first labelled start to its last stop."""
    spans = labels.groupBy("reference").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return spans.select(F.col("reference").alias("request_id"), "reference", "start", "stop", F.lit("").alias("label"), times.seconds_between("start", "stop").alias("duration_s"))


def reproduce(samples: DataFrame, labels: DataFrame, path: str, *, signals: Sequence[str], folds: int = 3, trees: int = 300, leaf: int = 10, block_gap_us: int = 2 * intervals.DAY_US, **how: object) -> DataFrame:
    """From labels alone: requests, the main dataset, out-of-fold predictions of a forest, their metrics by fold and the
    summary of the folds; then the final model, saved at `path`, read back and judged on each time block.

    Returns the three tables as one, with `report` (fold, summary or block) first. References are the groups of folds.
    """
    data = main_dataset(samples, requests_of(labels), labels, signals=signals, **how)
    data = sinks.written(data.withColumn("fold", F.pmod(F.xxhash64("reference"), F.lit(folds)).cast("int")), "dataset")  # all fits and scores read it
    features = [c for c in data.columns if c.split("_")[0] in FEET]
    forest = models.random_forest(features, "target", trees=trees, leaf=leaf)
    by_fold = metrics.binary_metrics(models.out_of_fold(data, forest, range(folds)), "target", "prediction", by=["fold"])
    summary = metrics.fold_means(by_fold, ["f1", "accuracy"], by=[], weight="n_rows")
    models.save(forest.fit(data), path)
    judged = models.score(data, models.load(path)).withColumn("time_center", times.from_micros(F.col("center_us")))
    blocks = segments.gap_segments(judged, by=["reference"], time="time_center", gap_us=block_gap_us)
    by_block = metrics.binary_metrics(blocks, "target", "prediction", by=["reference", "segment"])
    return reshape.union_reports({"fold": by_fold, "summary": summary, "block": by_block})


def label_extension(
    samples: DataFrame, base: DataFrame, candidates: DataFrame, *, tile_s: float, least_records: int, most_valid: int, most_scanned: int, window_us: int, least_s: float, feet: int = 2, value: str = "value", zone: str = "UTC"
) -> DataFrame:
    """Labels for new samples: candidates are cut into tiles, tiles are scanned in order until enough have records of
    both feet, valid ones label themselves, accepted suggestions go through a template, and the samples that they label
    join those of the base, which keep their labels.

    samples: event_id, reference, foot, _time, value. base, candidates: label_id, reference, start, stop (base: label).
    """
    tiles = intervals.tile_intervals(candidates.select("label_id", "reference", "start", "stop"), tile_s, zone=zone)
    tiles = tiles.select(F.concat_ws("_", "label_id", "tile").alias("request_id"), "label_id", "tile", "reference", F.col("tile_start").alias("start"), F.col("tile_stop").alias("stop"))
    inside = extraction.requested(samples, tiles.select("request_id", "reference", "start", "stop"))
    counts = coverage.count_records(inside, keys=["request_id"])
    counts = coverage.with_missing(tiles, counts, keys=["request_id"], columns=["left_records", "right_records", "total_records"])
    scanned = coverage.quota_scan(coverage.block_status(counts, least_records), by=["reference"], order=["label_id", "tile"], valid=F.col("status") == "valid", most_valid=most_valid, most_scanned=most_scanned)
    valid = scanned.where("status = 'valid'").select("request_id")
    found = autolabel.suggest(inside.join(valid, "request_id"), block="request_id", value=value, window_us=window_us, least_s=least_s)
    accepted = autolabel.accept(found, least_s, feet).join(tiles.select("request_id", "reference"), "request_id")
    form = "yyyy-MM-dd HH:mm:ss"
    texts = {f"label_{a}_{b}": F.date_format(F.col(c), form) if b == "utc" else F.lit("") for a, c in (("from", "start"), ("until", "stop")) for b in ("utc", "local")}
    template = autolabel.labelling_template(accepted.withColumns(texts).select("reference", "mov_type", "label_quality", "review_notes", *texts))
    new = autolabel.import_template(template, zone=zone).where("valid").select("reference", "start", "stop", "label")
    label = lambda l, how: intervals.label_points(samples, l, overlap=how).where(F.col("label") != lab.NO_LABEL).select("event_id", "reference", "_time", "label")
    return reshape.union_keep_first({"base": label(base, "first"), "auto": label(new, "last")}, keys=["event_id"], tie=["label"])


def correction_audit(dataset: DataFrame, votes: DataFrame, samples: DataFrame, *, key: str, high: float, low: float, top: int, gap_us: int, moving: float, still: float, value: str = "value") -> DataFrame:
    """The dataset with corrected targets and, for each proposal, its decision.

    votes of all models give consensus and proposals; proposals of one direction without a longer gap make runs; only
    those in the largest runs are kept; the signal of each run confirms, rejects or leaves it; windows inside confirmed
    runs are corrected. dataset: key, reference, _time, target, mov_type.
    """
    proposed = corrections.propose(corrections.consensus(votes, keys=[key]), high=high, low=low)
    placed = dataset.select(key, "reference", "_time").join(proposed.select(key, "proposed", "min_probability", "max_probability"), key)
    rows = segments.gap_segments(placed, by=["reference"], time="_time", tie=[key], gap_us=gap_us, change=["proposed"], out="run")
    runs = segments.run_table(rows, by=["reference", "run", "proposed"], time="_time", values=[F.max("max_probability").alias("max_probability")])
    chosen = selection.top_runs(runs, top).select(F.concat_ws("_", "reference", "run").alias("run_id"), "reference", "proposed", F.col("run_start").alias("start"), F.col("run_end").alias("stop"))
    decided = corrections.decide(corrections.signal_review(chosen, samples, key="run_id", value=value), moving=moving, still=still)
    inside = intervals.points_inside(placed, chosen, on=["reference", "proposed"])
    confirmed = intervals.points_inside(inside, decided.where("decision = 'confirm'"), on=["reference", "proposed"])
    judged = inside.select(key, F.col("proposed").alias("asked")).join(confirmed.select(key, F.lit("confirm").alias("_yes")), key, "left")
    fixed = corrections.apply(dataset, confirmed.select(key, "proposed"), keys=[key])
    return fixed.join(judged, key, "left").withColumn("decision", F.when(F.col("asked").isNotNull(), F.coalesce("_yes", F.lit("leave")))).drop("_yes")


def scored(rows: DataFrame, model: PipelineModel, *, threshold: float) -> DataFrame:
    """Rows with the probability and prediction of a model, as sequence_evaluation takes them."""
    return models.score(rows, model, threshold=threshold).withColumnRenamed("walking_probability", "probability")


def sequence_evaluation(predictions: DataFrame, labels: DataFrame, chosen: DataFrame, *, threshold: float, min_run: int, key: str = "event_id", bucket_us: int = segments.BUCKET_US) -> DataFrame:
    """Metrics of each reference before and after smoothing.

    Predictions (key, reference, _time, probability) get the labels around them; those of the chosen segments
    (reference, order_index) are stitched into one sequence, smoothed over each reference's part, and judged.
    """
    rows = intervals.label_points(predictions, labels).where(F.col("label") != lab.NO_LABEL).withColumn("target", lab.target(F.col("label")).cast("int"))
    sequence = segments.stitched(rows, chosen, on=["reference"], order="order_index", time="_time", tie=[key])
    flag: Column = F.col("probability") >= threshold
    kept = segments.min_run(sequence, flag, min_run, by=["reference"], order=["_time", key], out="smoothed", bucket_us=bucket_us)
    stages = F.inline(F.array(F.struct(F.lit("raw").alias("stage"), flag.cast("int").alias("hat")), F.struct(F.lit("smoothed").alias("stage"), F.col("smoothed").alias("hat"))))
    judged = kept.select("reference", "target", "position", stages).groupBy("reference", "stage")
    span = [F.min("position").alias("first_position"), F.max("position").alias("last_position")]
    return metrics.from_counts(judged.agg(F.count(F.lit(1)).alias("n_rows"), *metrics.confusion("target", "hat"), *span))


def hard_negatives(bundle: DataFrame, requests: DataFrame, *, signals: Sequence[str], **how: object) -> DataFrame:
    """Bundle rows to a binary table of one label: windows of both feet with their spectra, wide, with target."""
    return binary_dataset(extraction.bundle_spectrogram(bundle, requests, signals=signals, **how), signals)
