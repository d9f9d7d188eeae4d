"""What the analysis of a set of files needs, against what is there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.dims import MEDIA_AUDIO, MEDIA_IMAGE, MEDIA_VIDEO, PACKAGES, READABLE
from shelfmark.functions.naming import suffix


def _among(ext: Column, names: str) -> Column:
    return ext.isin(*("." + x for x in names.split()))


def kind(name: Column) -> Column:
    """video, audio, image, pdf or document, by extension."""
    ext = F.lower(suffix(name))
    return F.when(_among(ext, MEDIA_VIDEO), "video").when(_among(ext, MEDIA_AUDIO), "audio").when(_among(ext, MEDIA_IMAGE), "image").when(ext == ".pdf", "pdf").otherwise("document")


def route(name: Column, private: Column) -> Column:
    """How a job is worked on: filename-only, document, image, media or unavailable."""
    ext = F.lower(suffix(name))
    media = _among(ext, MEDIA_VIDEO) | _among(ext, MEDIA_AUDIO)
    return F.when(private, "filename-only").when(_among(ext, READABLE), "document").when(_among(ext, MEDIA_IMAGE), "image").when(media, "media").otherwise("unavailable")


def kind_counts(files: DataFrame) -> DataFrame:
    return files.groupBy(kind(F.col("name")).alias("kind")).agg(F.count("*").alias("files"))


def frames_ready(available: dict[str, bool]) -> bool:
    """Frames of a video can be had with ffmpeg and ffprobe, with imageio-ffmpeg, or with the system's own frameworks."""
    return bool(available.get("ffmpeg") and available.get("ffprobe") or available.get("imageio_ffmpeg") or available.get("native"))


def needs(files: DataFrame, available: dict[str, bool]) -> DataFrame:
    """One row: media_kinds, missing, ready; a video is content with speech recognition or with frames."""
    k = kind(F.col("name"))
    asr, ocr = available.get("faster_whisper", False), [x for x in ("paddleocr", "paddle") if not available.get(x)]
    wanted = (
        F.when(F.lit(not asr and not frames_ready(available)) & (k == "video"), F.array(F.lit("keyframes")))
        .when(F.lit(not asr) & (k == "audio"), F.array(F.lit("faster_whisper")))
        .when(k == "image", F.array(*map(F.lit, ocr)).cast("array<string>"))
        .when(F.lit(not available.get("pdftotext") and not available.get("pypdf")) & (k == "pdf"), F.array(F.lit("pdf")))
        .otherwise(F.array().cast("array<string>"))
    )
    one = files.select(k.alias("kind"), wanted.alias("wanted")).groupBy("kind", "wanted").count()
    s = one.agg(F.array_sort(F.collect_set(F.when(F.col("kind").isin("video", "audio", "image"), F.col("kind")))).alias("media_kinds"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("wanted")))).alias("missing"))
    return s.select("media_kinds", "missing", (F.size("missing") == 0).alias("ready"))


def assessment(files: DataFrame, available: dict[str, bool]) -> DataFrame:
    """One row: files, required and conditional packages, and what has to be installed."""
    k = kind(F.col("name"))
    asr, frames = available.get("faster_whisper", False), frames_ready(available)
    image = not (available.get("paddleocr") and available.get("paddle"))
    pdf = not (available.get("pdftotext") or available.get("pypdf"))
    required = F.when((k == "video") & F.lit(not asr and not frames), PACKAGES["imageio_ffmpeg"]).when((k == "audio") & F.lit(not asr), PACKAGES["faster_whisper"]).when((k == "pdf") & F.lit(pdf), PACKAGES["pypdf"])
    conditional = F.when((k == "image") & F.lit(image), PACKAGES["paddleocr"])
    s = files.agg(F.count("*").alias("files"), F.array_sort(F.collect_set(required)).alias("required"), F.array_sort(F.collect_set(conditional)).alias("conditional"))
    everything = F.array_sort(F.array(*map(F.lit, PACKAGES.values())))
    status = F.when((F.size("required") == 0) & (F.size("conditional") == 0), "not-needed").when(F.col("required") == everything, "full-install-required").when(F.size("required") > 0, "minimal-install-required").otherwise("conditional-only")
    return s.select("files", "required", "conditional", status.alias("requirements_status"), (F.size("required") > 0).alias("authorization_required"))


def media_gate(files: DataFrame, available: dict[str, bool], opted_in: bool) -> DataFrame:
    """Whether media may be analysed: installation-required, confirmation-required or open. Documents never wait for it."""
    return needs(files.filter(kind(F.col("name")).isin("video", "audio", "image")), available).select(F.when(F.size("media_kinds") == 0, "open").when(~F.col("ready"), "installation-required").when(F.lit(not opted_in), "confirmation-required").otherwise("open").alias("gate"))
