"""The page source hook: exported OCR results read by path, as the blocks that the record operators take.

An export has one JSON object a line, ``{"DocumentId": …, "Blocks": […]}``, with blocks named as text recognition
services name them. Files may lie in folders like ``day=2024-01-01``: a filter on such a column reads those
folders only, and columns that are not asked for are not parsed. Any other source of pages or blocks takes the
same place by returning these columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The names of the export.
BLOCK = "struct<Id:string,BlockType:string,Text:string,Confidence:double,Page:int,RowIndex:int,ColumnIndex:int,EntityTypes:array<string>,SelectionStatus:string,Relationships:array<struct<Type:string,Ids:array<string>>>>"
NAMES = {"id": "Id", "block_type": "BlockType", "text": "Text", "confidence": "Confidence", "row_index": "RowIndex", "column_index": "ColumnIndex", "selection_status": "SelectionStatus"}


def scan_blocks(spark: SparkSession, folder: str, folders: str = "", id_type: str = "string") -> DataFrame:
    """(doc_id, page, id, block_type, text, confidence, row_index, column_index, selection_status, entity_types,
    relationships, and the columns ``folders`` names, like ``day date``) of an export.

    Missing lists are empty, a missing page is 1. A line that is no JSON, or has no blocks, gives no rows.
    """
    known = f"DocumentId string, Blocks array<{BLOCK}>{', ' + folders if folders else ''}"
    rows = spark.read.schema(known).json(folder)
    extra = [c for c in rows.columns if c not in ("DocumentId", "Blocks")]
    b = rows.select(F.col("DocumentId").cast(id_type).alias("doc_id"), *extra, F.explode("Blocks").alias("b"))
    related = F.transform("b.Relationships", lambda r: F.struct(r.Type.alias("type"), F.coalesce(r.Ids, F.array().cast("array<string>")).alias("ids")))
    return b.select(
        "doc_id", *extra, F.coalesce("b.Page", F.lit(1)).alias("page"), *(F.col(f"b.{theirs}").alias(ours) for ours, theirs in NAMES.items()),
        F.coalesce("b.EntityTypes", F.array().cast("array<string>")).alias("entity_types"), F.coalesce(related, F.array().cast("array<struct<type:string,ids:array<string>>>")).alias("relationships"),
    )


def write_blocks(blocks: DataFrame, folder: str, folders: list[str], compression: str = "gzip") -> None:
    """The inverse: one line a document, in the folders of ``folders``. A document's blocks are one line, as exports have them.

    Names and ids repeat in every block, so the files are compressed, and read back as they are; blocks that are dealt by
    ``doc_id`` already are not dealt again.
    """
    related = F.transform("relationships", lambda r: F.struct(r.type.alias("Type"), r.ids.alias("Ids")))
    b = F.struct(F.col("page").alias("Page"), *(F.col(ours).alias(theirs) for ours, theirs in NAMES.items() if ours in blocks.columns), F.col("entity_types").alias("EntityTypes"), related.alias("Relationships"))
    rows = blocks.groupBy("doc_id", *folders).agg(F.collect_list(b).alias("Blocks")).select(F.col("doc_id").cast("string").alias("DocumentId"), "Blocks", *folders)
    rows.write.partitionBy(*folders).option("compression", compression).json(folder)
