"""Dimensions: items, worlds, data centers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlake.schemas import ITEM_NAMES, WORLD_FILE, WORLD_NAMES

# Fixed value: ids from here on are test servers.
TEST_WORLD_ID = 3000

# Data centers and their worlds.
DATA_CENTERS = {
    "Aether": [
        "Adamantoise",
        "Cactuar",
        "Faerie",
        "Gilgamesh",
        "Jenova",
        "Midgardsormr",
        "Sargatanas",
        "Siren",
    ],
    "Primal": [
        "Behemoth",
        "Excalibur",
        "Exodus",
        "Famfrit",
        "Hyperion",
        "Lamia",
        "Leviathan",
        "Ultros",
    ],
    "Crystal": [
        "Balmung",
        "Brynhildr",
        "Coeurl",
        "Diabolos",
        "Goblin",
        "Malboro",
        "Mateus",
        "Zalera",
    ],
    "Dynamis": [
        "Halicarnassus",
        "Maduin",
        "Marilith",
        "Seraph",
    ],
    "Light": [
        "Alpha",
        "Lich",
        "Odin",
        "Phoenix",
        "Raiden",
        "Shiva",
        "Twintania",
        "Zodiark",
    ],
    "Chaos": [
        "Cerberus",
        "Louisoix",
        "Moogle",
        "Omega",
        "Phantom",
        "Ragnarok",
        "Sagittarius",
        "Spriggan",
    ],
    "Elemental": [
        "Aegis",
        "Atomos",
        "Carbuncle",
        "Garuda",
        "Gungnir",
        "Kujata",
        "Tonberry",
        "Typhon",
    ],
    "Gaia": [
        "Alexander",
        "Bahamut",
        "Durandal",
        "Fenrir",
        "Ifrit",
        "Ridill",
        "Tiamat",
        "Ultima",
    ],
    "Mana": [
        "Anima",
        "Asura",
        "Chocobo",
        "Hades",
        "Ixion",
        "Masamune",
        "Pandaemonium",
        "Titan",
    ],
    "Meteor": [
        "Belias",
        "Mandragora",
        "Ramuh",
        "Shinryu",
        "Unicorn",
        "Valefor",
        "Yojimbo",
        "Zeromus",
    ],
    "Materia": [
        "Bismarck",
        "Ravana",
        "Sephirot",
        "Sophia",
        "Zurvan",
    ],
}


def read_item_names(spark: SparkSession, path: str) -> DataFrame:
    """The item seed: CSV with header (item_id, item_name)."""
    return spark.read.csv(path, header=True, schema=ITEM_NAMES)


def read_world_names(spark: SparkSession, path: str) -> DataFrame:
    """The world seed: CSV with header (world_id, world_name)."""
    return spark.read.csv(path, header=True, schema=WORLD_NAMES)


def read_item_source(spark: SparkSession, path: str) -> DataFrame:
    """The item sheet the seed is made from; columns are found by header name."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"')


def read_world_source(spark: SparkSession, path: str) -> DataFrame:
    """A JSON file with one array of (id, name)."""
    return spark.read.schema(WORLD_FILE).option("multiLine", True).json(path)


def item_names(source: DataFrame, id_column: str = "#", name_column: str = "Name") -> DataFrame:
    """Items with an id other than 0 and a name that is not blank."""
    text = source.select(
        F.col(f"`{id_column}`").cast("string").alias("item_id"),
        F.regexp_replace(F.col(f"`{name_column}`"), r"^\s+|\s+$", "").alias("item_name"),
    )
    kept = text.where(
        (F.col("item_id") != "") & (F.col("item_id") != "0") & (F.col("item_name") != "")
    )
    return kept.select(F.col("item_id").try_cast("bigint").alias("item_id"), "item_name")


def world_names(source: DataFrame) -> DataFrame:
    """Worlds below the test range."""
    return source.where(F.col("id") < TEST_WORLD_ID).select(
        F.col("id").alias("world_id"), F.col("name").alias("world_name")
    )


def data_centers(spark: SparkSession) -> DataFrame:
    """(data_center, center_position, world_name, position) from the fixed map."""
    rows = [(name, i, worlds) for i, (name, worlds) in enumerate(DATA_CENTERS.items())]
    return center_rows(
        spark.createDataFrame(rows, "data_center string, center_position int, worlds array<string>")
    )


def center_rows(source: DataFrame) -> DataFrame:
    """The same from any (data_center, center_position, worlds array of names)."""
    return source.select(
        "data_center",
        "center_position",
        F.posexplode("worlds").alias("position", "world_name"),
    )


def region_worlds(centers: DataFrame, worlds: DataFrame, region: str) -> DataFrame:
    """Names of the worlds that belong to the centers of one region.

    ``centers`` holds (region, worlds array of ids), ``worlds`` (id, name).
    """
    ids = centers.where(F.col("region") == region).select(F.explode("worlds").alias("id"))
    return worlds.join(ids, "id", "left_semi").select(F.col("name").alias("world_name"))
