"""Images and frame sequences as rows.

Frames come in the natural order of their names. An unreadable image keeps its row, without a size, as frames count
whether or not they can be read. Names that differ in case only are different frames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frameloom.functions.labels import natural_key

#: Endings of frames, and of enrollment photos, which may also be in capitals.
FRAME_GLOB, PHOTO_GLOB = "*.{jpg,jpeg,png}", "*.{jpg,jpeg,png,JPG,JPEG,PNG}"


def frames(spark: SparkSession, folder: str, pattern: str = FRAME_GLOB) -> DataFrame:
    """video_id (the folder), frame, pos from 0, path and length of the images of folders, by one listing."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "length").distinct()
    named = found.withColumn("video_id", F.element_at(F.split("path", "/"), -2)).withColumn("frame", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1))
    order = Window.partitionBy("video_id").orderBy(natural_key(F.col("frame")), "path")
    return named.withColumn("pos", F.row_number().over(order) - 1)


def photos(spark: SparkSession, folder: str) -> DataFrame:
    """Enrollment photos of folders, also with endings in capitals: in the plain order of their names, with their endings."""
    found = frames(spark, folder, PHOTO_GLOB).withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1))
    return found.withColumn("pos", F.row_number().over(Window.partitionBy("video_id").orderBy("name")) - 1)


def first_size(sized: DataFrame) -> DataFrame:
    """video_id, n (images that can be read), and width and height of the first of them, of images with sizes."""
    good = sized.where("readable")
    return good.groupBy("video_id").agg(F.count("*").alias("n"), F.min_by("width", "pos").alias("width"), F.min_by("height", "pos").alias("height"))


def decoded(spark: SparkSession, folder: str) -> DataFrame:
    """path, width, height and channels of the images that can be read."""
    return spark.read.format("image").option("dropInvalid", True).load(folder).select(F.col("image.origin").alias("path"), "image.width", "image.height", F.col("image.nChannels").alias("channels"))


def with_sizes(listed: DataFrame, read: DataFrame) -> DataFrame:
    """The images that were listed, with the sizes of those that can be read; paths may differ in the slashes behind their
    scheme, as Spark's sources write them."""
    plain = F.regexp_replace("path", r"^(\w+):/+", "$1:/")
    sized = read.withColumn("_path", plain).drop("path")
    return listed.withColumn("_path", plain).join(sized, "_path", "left").drop("_path").withColumn("readable", F.col("width").isNotNull())


def photo_reasons(photos: DataFrame) -> DataFrame:
    """photos (readable, person, embedding norm n) with why each can't be used, or null."""
    reason = F.when(~F.col("readable"), "unreadable").when(F.col("x1").isNull(), "no person").when(~(F.col("n") > 1e-9), "bad embedding")
    return photos.withColumn("reason", reason)


def sampled(df: DataFrame, fps: float, speed: int, first_second: float, last_second: float) -> DataFrame:
    """Every speed-th frame of a stretch of a video, both ends included."""
    if speed < 1 or last_second < first_second:
        raise ValueError("a stretch needs a positive step and an end after its beginning")
    low, high = int(first_second * fps), int(last_second * fps)
    return df.where(F.col("frame_idx").between(low, high) & (F.pmod(F.col("frame_idx") - low, F.lit(speed)) == 0))
