"""Incremental ingestion: what to skip, upserts, deletes, and the manifest derived from the chunks."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def skip_reasons(incoming: DataFrame, manifest: DataFrame, config_hash: str, skip: bool = True) -> DataFrame:
    """(source_file, skip, reason) of incoming files (source_file, raw_file_hash).

    ``manifest`` has (source_file, raw_file_hash, status, config_hash, markdown_exists). The
    configuration is compared first, for each document, so one document's new index doesn't make
    the others look current; a new document meets a changed configuration where the manifest has
    rows and none of them is of this one.
    """
    current = manifest.agg((F.count(F.lit(1)) > 0).alias("any"), F.coalesce(F.max(F.col("config_hash").eqNullSafe(F.lit(config_hash))), F.lit(False)).alias("same"))
    m = manifest.select("source_file", F.col("raw_file_hash").alias("old_hash"), "status", "config_hash", "markdown_exists", F.lit(True).alias("known"))
    j = incoming.join(m, "source_file", "left").join(F.broadcast(current))  # one row
    if not skip:
        reason = F.lit("skip_disabled")
    else:
        reason = (
            F.when(F.coalesce(F.col("known"), F.lit(False)) & ~F.col("config_hash").eqNullSafe(F.lit(config_hash)) | F.col("known").isNull() & F.col("any") & ~F.col("same"), "index_config_changed").when(F.col("known").isNull(), "new_document").when(~F.col("status").eqNullSafe(F.lit("success")), "previous_index_not_successful")
            .when(~F.col("old_hash").eqNullSafe(F.col("raw_file_hash")), "file_changed").when(~F.coalesce("markdown_exists", F.lit(False)), "markdown_missing").otherwise("unchanged_file")
        )
    return j.select("source_file", (reason == "unchanged_file").alias("skip"), reason.alias("reason"))


def upsert(old: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of the same key; the last of a repeated key counts."""
    if order:
        w = Window.partitionBy(key).orderBy(F.desc(order))
        new = new.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def delete_source(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Rows left when those whose source_file or source is among ``names`` (name) are deleted."""
    n = names.select("name").distinct()
    left = rows.join(n.withColumnRenamed("name", "source_file"), "source_file", "left_anti")
    return left.join(n.withColumnRenamed("name", "source"), "source", "left_anti") if "source" in rows.columns else left


def rollup(children: DataFrame) -> DataFrame:
    """(source_file, page, parent_ids, child_ids): what of the index comes from each page, ids in document order."""
    pages = children.where("page_numbers is not null").select("source_file", "parent_id", "child_id", "chunk_index", F.explode("page_numbers").alias("page"))
    order = lambda c: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("chunk_index", F.lit(2**31 - 1)).alias("i"), F.col("child_id").alias("c"), F.col(c).alias("x")))), lambda x: x["x"]))
    return pages.groupBy("source_file", "page").agg(order("parent_id").alias("parent_ids"), order("child_id").alias("child_ids"))


def batch_summary(decisions: DataFrame) -> DataFrame:
    """(added, skipped, failed) of a batch (status, reason)."""
    return decisions.agg(F.count_if(F.col("status") == "added").alias("added"), F.count_if(F.col("status") == "skipped").alias("skipped"), F.count_if(F.col("status") == "failed").alias("failed"))


def check_dimension(rows: DataFrame, vector: str, dim: int) -> DataFrame:
    """(ok, least, most, n): whether all vectors have the expected number of components."""
    s = F.size(vector)
    return rows.where(F.col(vector).isNotNull()).agg((F.coalesce((F.min(s) == dim) & (F.max(s) == dim), F.lit(True))).alias("ok"), F.min(s).alias("least"), F.max(s).alias("most"), F.count(F.lit(1)).alias("n"))


def stage_log(results: DataFrame) -> DataFrame:
    """A row for each stage of results (source_file, stages array<struct<stage,status,elapsed_ms,error>>)."""
    return results.select("source_file", F.posexplode("stages").alias("stage_no", "s")).select("source_file", "stage_no", "s.*")


def delete_document(tables: dict[str, DataFrame], doc_id: str | None, names: list[str], parent_ids: list[str] | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables left, report): a document taken out of every table that has it.

    A row goes if its doc_id, source_file or source is the document's, or its parent_id is among
    those given. The report has a row for each table with the rows it had and lost; a table of other
    columns is left as it is with an error in its row, and the others are done all the same.
    """
    left, report, spark = {}, None, None
    for name, df in tables.items():
        spark = spark or df.sparkSession
        gone = F.lit(False)
        if doc_id is not None and "doc_id" in df.columns:
            gone = gone | F.coalesce(F.col("doc_id").cast("string") == doc_id, F.lit(False))
        for column, values in (("source_file", names), ("source", names), ("parent_id", parent_ids or [])):
            if column in df.columns and values:
                gone = gone | F.coalesce(F.col(column).isin(values), F.lit(False))
        usable = bool({"doc_id", "source_file", "source", "parent_id"} & set(df.columns))
        left[name] = df.where(~gone) if usable else df
        row = df.agg(F.lit(name).alias("artifact"), F.count(F.lit(1)).alias("rows"), F.count_if(gone).alias("deleted"), F.lit(None if usable else "no key column").alias("error"))
        report = row if report is None else report.unionByName(row)
    return left, report


def collection_stats(parents: DataFrame, children: DataFrame) -> DataFrame:
    """(documents, parents, children, characters) of an index."""
    a = parents.agg(F.count(F.lit(1)).alias("parents"), F.countDistinct("doc_id").alias("documents"), F.coalesce(F.sum(F.length("page_content")), F.lit(0)).alias("characters"))
    return a.join(F.broadcast(children.agg(F.count(F.lit(1)).alias("children"))))  # one row each


def config_hash(config: dict) -> str:
    """A hash of a configuration that its order and spaces don't change."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def selected_pages(pages: DataFrame, chosen: DataFrame, file: str, number: str = "page_number") -> DataFrame:
    """The pages of a rebuild, of ``chosen`` (file, number); a page without number counts as page 1."""
    want = chosen.select(file, F.col(number).alias("__n")).distinct()
    return pages.withColumn("__n", F.coalesce(number, F.lit(1))).join(want, [file, "__n"], "left_semi").drop("__n")
