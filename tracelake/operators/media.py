"""Frames: which to take, when they were taken, how good they are, and what analysis may see."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def sample_frames(frames: DataFrame, every: int | None = None, seconds: float | None = None, between: tuple[float, float] | None = None, most: int | None = None) -> DataFrame:
    """Frames (artifact_id, frame_index, pts) by one of three modes: each n-th, the first of every t seconds, a time range; ``most`` caps each artifact."""
    if (every is not None and every <= 0) or (seconds is not None and seconds <= 0) or (between is not None and between[0] > between[1]):
        raise ValueError("a step has to be above zero and a range in order")
    out = frames
    if every is not None:
        out = out.where(F.col("frame_index") % every == 0)
    elif seconds is not None:
        slot = F.floor(F.col("pts") / seconds)
        first = out.withColumn("__n", F.row_number().over(Window.partitionBy("artifact_id", slot).orderBy("frame_index")))
        out = first.where("__n = 1 and pts is not null").drop("__n")
    elif between is not None:
        out = out.where(F.col("pts").between(*between))
    if most is not None:
        out = out.withColumn("__n", F.row_number().over(Window.partitionBy("artifact_id").orderBy("frame_index"))).where(F.col("__n") <= most).drop("__n")
    return out


def frame_timing(frames: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Frames with pts = base + index * step and their wall clock; step from the rate or the interval, else only frame 0 has a time."""
    rows = frames.join(artifacts, "artifact_id")
    step = F.when(F.col("rate") > 0, 1.0 / F.col("rate")).otherwise(F.when(F.col("interval") > 0, F.col("interval")))
    source = F.when(F.col("rate") > 0, "frame rate").when(F.col("interval") > 0, "interval").otherwise("unknown")
    pts = F.when(step.isNotNull(), F.col("base") + F.col("frame_index") * step).when(F.col("frame_index") == 0, F.col("base"))
    return rows.select("artifact_id", "frame_index", pts.alias("pts"), (F.col("recording_start") + pts).alias("wall"), source.alias("source"))


def _pixels(column: pa.Array, width: int) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64).reshape(len(column), -1, width)


def frame_quality(frames: DataFrame, width: int) -> DataFrame:
    """(frame_index, mean, deviation, sharpness, has_tonal_variation) of frames (frame_index, pixels: array of one size).

    sharpness is the variance of the 3 x 3 Laplacian over inner pixels, 0 where there are none.
    """
    def measure(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _pixels(batch.column(1), width)
            inner = 4 * x[:, 1:-1, 1:-1] - x[:, :-2, 1:-1] - x[:, 2:, 1:-1] - x[:, 1:-1, :-2] - x[:, 1:-1, 2:]
            sharp = inner.reshape(len(x), -1).var(axis=1) if inner.size else np.zeros(len(x))
            flat = x.reshape(len(x), -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(flat.mean(axis=1)), pa.array(flat.std(axis=1)), pa.array(sharp), pa.array(flat.max(axis=1) > flat.min(axis=1))], names=["frame_index", "mean", "deviation", "sharpness", "has_tonal_variation"])

    return frames.select(F.col("frame_index").cast("long"), "pixels").mapInArrow(measure, "frame_index long, mean double, deviation double, sharpness double, has_tonal_variation boolean")


#: Weights of red, green and blue in grey.
GREY = (0.299, 0.587, 0.114)


def _shares(n: int, m: int) -> np.ndarray:
    """(m, n): how much of each of n pixels each of m pixels of the same length covers; rows add up to 1."""
    edges = np.arange(m + 1) * n / m
    cover = np.minimum(edges[1:, None], np.arange(1, n + 1)) - np.maximum(edges[:-1, None], np.arange(n))
    return np.maximum(cover, 0) * m / n


def transform_frames(frames: DataFrame, width: int, height: int, plan: list[tuple], channels: int = 1) -> DataFrame:
    """(frame_index, pixels) of frames of one size, channels side by side in each pixel, by the steps of ``plan`` in order.

    ("crop", left, top, width, height): a region, which has to lie in the frame; ("resize", width, height): to any size, each pixel the mean of
    the area that it covers; ("grey",): one channel out of red, green and blue. A step that can't be done is an error ahead of the run.
    Frames without pixels or of another size are left out.
    """
    w, h, n = width, height, channels
    for name, *args in plan:
        if name == "crop":
            left, top, cw, ch = args
            if min(left, top) < 0 or cw <= 0 or ch <= 0 or left + cw > w or top + ch > h:
                raise ValueError("the region has to lie in the frame")
            w, h = cw, ch
        elif name == "resize":
            w, h = args
            if w <= 0 or h <= 0:
                raise ValueError("a size has to be above zero")
        elif name == "grey":
            if n != 3:
                raise ValueError("grey takes three channels")
            n = 1
        else:
            raise ValueError(f"no step {name}")

    def change(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(batch.column(1).to_pylist(), np.float64).reshape(batch.num_rows, height, width, channels)
            for name, *args in plan:
                if name == "crop":
                    left, top, cw, ch = args
                    x = x[:, top : top + ch, left : left + cw]
                elif name == "resize":
                    x = np.einsum("hy,fyxc,wx->fhwc", _shares(x.shape[1], args[1]), x, _shares(x.shape[2], args[0]))
                else:
                    x = (x @ np.array(GREY))[..., None]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x.reshape(len(x), -1).tolist(), pa.list_(pa.float64()))], names=["frame_index", "pixels"])

    sized = frames.where(F.size("pixels") == width * height * channels)
    return sized.select(F.col("frame_index").cast("long"), "pixels").mapInArrow(change, "frame_index long, pixels array<double>")


def crop_and_shrink(frames: DataFrame, width: int, height: int, roi: tuple[int, int, int, int], factor: int) -> DataFrame:
    """(frame_index, pixels) of a region (left, top, width, height) of each frame, shrunk by averaging ``factor`` x ``factor`` pixels."""
    if factor <= 0 or roi[2] % factor or roi[3] % factor:
        raise ValueError("the region has to be a multiple of the factor")
    return transform_frames(frames, width, height, [("crop", *roi), ("resize", roi[2] // factor, roi[3] // factor)])


def eligible(findings: DataFrame) -> DataFrame:
    """Only inputs that passed or are under review may go to analysis."""
    return findings.where(F.col("state").isin("PASS", "REVIEW"))


def stray_observations(observations: DataFrame, submitted: DataFrame) -> DataFrame:
    """Observations of frames that were never submitted."""
    return observations.join(submitted.select("frame_id").distinct(), "frame_id", "left_anti")
