"""Catalogue tables: schemas, Parquet readers, and the file types that imports know."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IMAGES = (
    "id STRING, sleevePath STRING, originalUri STRING, displayName STRING, fileExtension STRING, fileSizeBytes BIGINT, width INT, height INT, dateAddedEpoch BIGINT,"
    " dateCapturedEpoch BIGINT, rating INT, flag STRING, colorLabel STRING, isRaw BOOLEAN, isVirtualCopy BOOLEAN, parentId STRING, thumbnailPath STRING, currentVersionId STRING,"
    " aiCaption STRING, aiTags STRING, aiScore FLOAT, isHidden BOOLEAN, lensModel STRING, cameraModel STRING, focalLength FLOAT, iso INT, aperture FLOAT, shutterSpeed STRING"
)
ELEMENTS = (
    "id STRING, parentId STRING, name STRING, sleevePath STRING, isFolder BOOLEAN, createdAt BIGINT, modifiedAt BIGINT, imageId STRING, childCount INT, imageCount INT,"
    " isSmartCollection BOOLEAN, smartFilterJson STRING"
)
VERSIONS = (
    "id STRING, imageId STRING, parentId STRING, name STRING, createdAt BIGINT, cumulativeParamsJson STRING, isVirtualCopy BOOLEAN, isActive BOOLEAN, note STRING"
)
TRANSACTIONS = ("id STRING, versionId STRING, timestamp BIGINT, label STRING, paramDeltaJson STRING, maskIds STRING, source STRING")
EMBEDDINGS = ("id STRING, imageId STRING, modelId STRING, dimensions INT, generatedAt BIGINT, norm FLOAT, embeddingBlob BINARY")
RATINGS = (
    "imageId STRING, overallScore FLOAT, technicalScore FLOAT, aestheticScore FLOAT, sharpnessScore FLOAT, exposureScore FLOAT, compositionScore FLOAT, emotionScore FLOAT,"
    " rationale STRING, suggestedRating INT, suggestedFlag STRING, generatedAt BIGINT, modelId STRING, provider STRING, confidence FLOAT"
)
PRESETS = ("id STRING, name STRING, category STRING, adjustmentsJson STRING, isBuiltIn BOOLEAN, isFavorite BOOLEAN, thumbnailPath STRING, createdAt BIGINT")
PIXELS = ("image_id BIGINT, y INT, x INT, r DOUBLE, g DOUBLE, b DOUBLE")

#: Extensions of raw files, and of the other files that imports take.
RAW_EXTENSIONS = ("dng", "cr2", "cr3", "nef", "nrw", "arw", "srf", "sr2", "raf", "orf", "rw2", "pef", "srw", "3fr", "fff", "iiq", "mrw", "x3f", "rwl")
OTHER_EXTENSIONS = ("jpg", "jpeg", "png", "tif", "tiff", "webp", "heic", "heif", "bmp", "avif")

FLAGS = ("NONE", "PICK", "REJECT")
COLOR_LABELS = ("NONE", "RED", "YELLOW", "GREEN", "BLUE", "PURPLE")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table with a declared schema: missing columns are null, extra ones are not read."""
    return spark.read.schema(schema).parquet(path)


def extension(name: Column) -> Column:
    """Lower-case extension of a file name, empty if it has none."""
    return F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1))


def is_raw(name: Column) -> Column:
    return extension(name).isin(*RAW_EXTENSIONS)


def is_supported(name: Column) -> Column:
    return extension(name).isin(*RAW_EXTENSIONS, *OTHER_EXTENSIONS)


def image_type(name: Column) -> Column:
    """``RAW``, ``JPEG``, ``TIFF``, ``PNG``, ``OTHER`` or ``UNKNOWN`` by extension."""
    ext = extension(name)
    return (
        F.when(ext.isin(*RAW_EXTENSIONS), "RAW").when(ext.isin("jpg", "jpeg"), "JPEG").when(ext.isin("tif", "tiff"), "TIFF").when(ext == "png", "PNG")
        .when(ext.isin(*OTHER_EXTENSIONS), "OTHER").otherwise("UNKNOWN")
    )


def known_flag(flag: Column) -> Column:
    """The flag if it is one of the known names, else null."""
    return F.when(flag.isin(*FLAGS), flag)


def known_label(label: Column) -> Column:
    return F.when(label.isin(*COLOR_LABELS), label)


def import_batch(files: DataFrame, folder: str, name_col: str = "name") -> tuple[DataFrame, DataFrame]:
    """Rows to add under ``folder``, with type and normalised path, and the rows refused with a reason."""
    from heliograph.functions.paths import normalised

    judged = files.withColumn(
        "error", F.when(F.col(name_col).isNull() | (F.trim(name_col) == ""), "no name").when(~is_supported(F.col(name_col)), "unsupported type")
    )
    good = judged.where("error is null").drop("error").withColumn("type", image_type(F.col(name_col))).withColumn("path", normalised(F.concat_ws("/", F.lit(folder), name_col)))
    return good, judged.where("error is not null")
