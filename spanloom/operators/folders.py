"""What belongs to a folder, a slot or a search: videos, clips, files of sounds, pictures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import text as T

SLUG = 60


def video_of(folders: DataFrame, folder: str, videos: DataFrame, name: Column, video: str) -> DataFrame:
    """folders, each with the column ``video``: the least of those in videos whose name's slug is the folder's name; null where there is none."""
    first = videos.select(T.slug(name, SLUG).alias("__slug"), F.col(video).alias("__video")).groupBy("__slug").agg(F.min("__video").alias(video))
    return folders.join(first, F.col(folder) == F.col("__slug"), "left").drop("__slug")


def clip_of(folders: DataFrame, key: str, folder: str, clips: DataFrame, order: Sequence[Column]) -> DataFrame:
    """folders, each with a struct ``clip``: the row of clips, of the same key, whose rank (from 1, by order) the folder's name tells (``short-07-any-slug``); null where the name doesn't parse or no clip has that rank."""
    told = folders.withColumn("__rank", F.regexp_extract(folder, r"^short-(\d+)-", 1).try_cast("int"))
    whole = F.struct(*clips.columns).alias("clip")
    ranked = clips.select(F.col(key).alias("__key"), whole, F.row_number().over(Window.partitionBy(key).orderBy(*order)).alias("__of"))
    return told.join(ranked, (F.col(key) == F.col("__key")) & (F.col("__rank") == F.col("__of")), "left").drop("__rank", "__key", "__of")


def pack_files(listed: DataFrame, there: DataFrame, named: DataFrame) -> DataFrame:
    """(pack, slot, file), a row a file. listed: (pack, slot, file), as a pack's list has them; those stay that are in there (file). named: (pack, slot, file, kind), the files that are named after their slots: for a
    pack of which nothing stays, of each slot the one of the least kind. Files listed twice come twice, as in the list."""
    kept = listed.join(there.select("file").distinct(), "file", "left_semi").select("pack", "slot", "file")
    rest = named.join(kept.select("pack").distinct(), "pack", "left_anti").groupBy("pack", "slot").agg(F.min(F.struct("kind", "file")).alias("x"))
    return kept.unionByName(rest.select("pack", "slot", "x.file"))


def usable(pools: Sequence[DataFrame], key: str, picture: str, order: str, fine: Column) -> DataFrame:
    """(key, picture, n): pools, one a search engine and the first engine first, put together; of the candidates that are fine, each picture once, the first by engine and order, and how many there are."""
    pool = None
    for engine, rows in enumerate(pools):
        own = rows.where(fine).select(key, picture, F.struct(F.lit(engine).alias("engine"), F.col(order).alias("order")).alias("place"))
        pool = own if pool is None else pool.unionByName(own)
    once = pool.groupBy(key, picture).agg(F.min("place").alias("place"))
    return once.groupBy(key).agg(F.min_by(picture, F.struct("place", picture)).alias(picture), F.count(F.lit(1)).alias("n"))
