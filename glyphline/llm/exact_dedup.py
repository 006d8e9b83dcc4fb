"""Exact dedup with an extendible-hash index on shared files (DataFrame functions only).

The key of a text is a 64-bit hash whose leading bits address a directory.  The directory starts
with ``2**min_depth`` buckets and doubles while a bucket holds more than ``capacity`` bytes, down to
``max_depth`` bits, which follow the bytes of the input.  A cell that is overfull even there (copies share a key, so
no split helps) gets overflow pages.  Rows are dealt once by (bucket, page): each owner task sorts its key range, chains
the texts that share a key and compares their bytes.  Its entries are written to the shared folder
as the index; pages of one cell are then merged through their chain heads alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import materialize, named

#: A directory of up to so many bytes is broadcast to the rows; more is joined by a shuffle.
BROADCAST_BYTES = 64 << 20
#: The directory has at most 2**22 cells; texts of more than 2**21 * capacity bytes get larger buckets.
MOST_DEPTH = 22
_ENTRY_BYTES = 64


def _key(text: str):
    return F.xxhash64(F.col(text))


def directory(cells: DataFrame, capacity: int, min_depth: int, max_depth: int) -> DataFrame:
    """cells(cell, bytes) at ``max_depth`` bits -> (cell, bucket, pages).

    ``capacity`` is raised to twice an even share of all bytes where that is more (only at MOST_DEPTH), so that only
    copies can overfill a cell.  A bucket is the shortest prefix of at least ``min_depth`` bits that fits, i.e. where repeated
    doubling stops; at ``max_depth`` what doesn't fit gets ``pages`` overflow pages.
    """
    depths = F.explode(F.sequence(F.lit(min_depth), F.lit(max_depth))).alias("depth")
    prefix = F.expr(f"shiftright(cell, {max_depth} - depth)")
    most = cells.agg(F.greatest(F.lit(capacity), F.ceil(2 * F.sum("bytes") / 2**max_depth)).alias("most"))  # one row
    split = cells.select("cell", "bytes", depths).withColumn("prefix", prefix)
    full = split.groupBy("depth", "prefix").agg(F.sum("bytes").alias("held")).join(F.broadcast(most))
    # a cell's bucket: the first depth at which its prefix isn't overfull
    fits = full.where((F.col("held") <= F.col("most")) | (F.col("depth") == max_depth))
    at = split.join(fits, ["depth", "prefix"]).groupBy("cell").agg(F.min(F.struct("depth", "prefix", "held", "most")).alias("b"))
    return at.select(
        "cell",
        F.expr("shiftleft(1L, b.depth) + b.prefix").alias("bucket"),  # a leading 1 marks the depth
        F.greatest(F.lit(1), F.ceil(F.col("b.held") / F.col("b.most"))).cast("int").alias("pages"),
    )


def depth_for(size: int, capacity: int, min_depth: int) -> int:
    """Bits of the directory for ``size`` bytes: cells of half a bucket on the average."""
    return max(min_depth, min(MOST_DEPTH, (2 * size // capacity).bit_length()))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2 << 20, min_depth: int = 4, max_depth: int | None = None) -> DataFrame:
    """Writes the index and returns it: one entry per row of ``docs``.

    Columns: bucket, page, pages, key, id, text_sha256, page_keep (largest id of the equal texts in
    the page), page_size, head_text (only on one entry of each group, and only in paged buckets).
    Rows are dealt to a cell's pages by their place in the input, so that equal and missing ids are spread as well.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", _key("text")).withColumn("place", F.monotonically_increasing_id())
    size = F.octet_length("text") + 64
    if max_depth is None:
        max_depth = depth_for(rows.agg(F.sum(size)).first()[0] or 0, capacity, min_depth)
    cell = F.shiftrightunsigned("key", 64 - max_depth).alias("cell")
    cells = rows.select(cell, size.alias("n")).groupBy("cell").agg(F.sum("n").alias("bytes"))
    known = materialize(directory(cells, capacity, min_depth, max_depth), "directory")
    if _ENTRY_BYTES * known.count() <= BROADCAST_BYTES:
        known = F.broadcast(known)
    dealt = rows.withColumn("cell", cell).join(known, "cell")
    page = F.pmod(F.xxhash64("place"), F.col("pages")).cast("int")
    dealt = dealt.select("bucket", F.when(F.col("pages") > 1, page).otherwise(0).alias("page"), "pages", "key", "id", "text").repartition("bucket", "page")
    chain = Window.partitionBy("bucket", "page", "key", "text")
    first = F.row_number().over(chain.orderBy(F.desc_nulls_last("id"))) == 1
    entries = dealt.select(
        "bucket", "page", "pages", "key", "id",
        F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"),
        F.max("id").over(chain).alias("page_keep"),
        F.count("*").over(chain).alias("page_size"),
        F.when((F.col("pages") > 1) & first, F.col("text")).alias("head_text"),
    )
    return materialize(entries, "exact-index")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **index) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; a null text counts as empty. Of equal texts the row with
    the largest id stays. Null ids are smaller than all others. Rows with equal id and text are
    all counted in group_size, and all of them carry the same ``kept``. Other columns are ignored. An empty table gives no rows.
    """
    entries = build_index(docs, id_col, text_col, **index)
    single = entries.where("pages = 1").select("id", F.col("page_keep").alias("keep_id"), F.col("page_size").alias("group_size"), "text_sha256")
    paged = entries.where("pages > 1")
    heads = paged.where("head_text is not null").select("bucket", "key", "head_text", "page", "page_keep", "page_size")
    merged = heads.groupBy("bucket", "key", "head_text").agg(F.max("page_keep").alias("keep_id"), F.sum("page_size").alias("group_size"))
    links = heads.join(merged, ["bucket", "key", "head_text"]).select("bucket", "key", "page", "page_keep", "keep_id", "group_size", F.sha2(F.encode("head_text", "UTF-8"), 256).alias("text_sha256"))
    same = [F.col(f"e.{c}").eqNullSafe(F.col(f"l.{c}")) for c in ("bucket", "page", "key", "page_keep", "text_sha256")]
    found = paged.alias("e").join(links.alias("l"), same).select("e.id", "l.keep_id", "l.group_size", "e.text_sha256")
    out = single.unionByName(found)
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **index) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names; of rows equal in id and text, one."""
    kept = exact_dedup(docs, id_col, text_col, **index).where("kept").select(F.col(id_col).alias("keep"), "text_sha256").distinct()
    sha = F.sha2(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8"), 256)
    rows = docs.select(F.struct(*(named(c).alias(c) for c in docs.columns)).alias("row"), F.col(id_col).alias("id"), sha.alias("sha"))
    left = rows.alias("d").join(kept.alias("k"), F.col("d.id").eqNullSafe(F.col("k.keep")) & (F.col("d.sha") == F.col("k.text_sha256")), "left_semi")
    return left.dropDuplicates(["id", "sha"]).select("row.*")
