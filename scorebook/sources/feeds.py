"""Raw game documents: reading, headers, and the versioned store of final and live copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import measures as M
from ..operators.changes import newer_of_two, store_feeds
from . import schemas


def _text(reader, path: str, separator: str | None) -> DataFrame:
    reader = reader.option("lineSep", separator) if separator else reader.option("wholetext", True)
    return reader.format("text").load(path).select(F.col("value").alias("json"), F.col("_metadata.file_path").alias("source"))


def read_documents(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """One row for each landed JSON document, with the file it came from: a file is a document, or several with a separator between them."""
    return _text(spark.read, path, separator)


def stream_documents(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    return _text(spark.readStream, path, separator)


def with_header(documents: DataFrame) -> DataFrame:
    """Key, season, version and state of each document, without parsing the rest of it; ``valid`` tells usable ones."""
    at = lambda path: F.get_json_object("json", path)
    df = documents.withColumns(
        {
            "game_pk": F.expr("try_cast(get_json_object(json, '$.gamePk') AS INT)"),
            "season": F.expr("try_cast(get_json_object(json, '$.gameData.game.season') AS INT)"),
            "feed_ts": at("$.metaData.timeStamp"),
            "is_final": F.coalesce(at("$.gameData.status.codedGameState").isin(*M.COMPLETED_STATES), F.lit(False)),
        }
    )
    return df.withColumn("valid", F.col("game_pk").isNotNull() & F.col("season").isNotNull() & F.col("feed_ts").isNotNull())


def split_valid(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable documents, refused ones with the reason and a hash that names the document).  Headers that are there are taken."""
    df = documents if "valid" in documents.columns else with_header(documents)
    missing = F.concat_ws(", ", *(F.when(F.col(c).isNull(), c) for c in ("game_pk", "season", "feed_ts")))
    broken = F.get_json_object("json", "$").isNull()
    reason = F.when(F.length(F.trim("json")).isNull() | (F.length(F.trim("json")) == 0), "empty").when(broken, "no JSON").otherwise(F.concat(F.lit("no "), missing))
    refused = df.filter("NOT valid").withColumns({"reason": reason, "document": F.sha2(F.coalesce("json", F.lit("")), 256)})
    return df.filter("valid").drop("valid"), refused.drop("valid")


def store(final: DataFrame, live: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(final documents, live documents, stored keys) after a batch of documents with headers."""
    return store_feeds(final, live, incoming, "game_pk", "feed_ts", "is_final")


def current(final: DataFrame, live: DataFrame) -> DataFrame:
    """One copy of each game's document: the final one, unless the live one is as new or newer."""
    return newer_of_two(final, live, "game_pk", "feed_ts")


def document(final: DataFrame, live: DataFrame, game_pk: int) -> DataFrame:
    return current(final, live).filter(F.col("game_pk") == game_pk)


def stored_keys(final: DataFrame) -> DataFrame:
    return final.select("game_pk").orderBy("game_pk")


def parsed(documents: DataFrame) -> DataFrame:
    """Documents with their typed projection ``g``.  Persist it: every derived table reads it."""
    return documents.withColumn("g", F.from_json("json", schemas.FEED)).drop("json")
