"""Labelled rows for the classifiers: who is held out, and a bounded sample to fit on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .frames import column, written

#: A text that is longer than this part of the byte bound is passed over where the sample must be cut.
SHARE = 1 / 16


def held_out(id_col: str, folds: int = 5):
    """Every fifth id, by the checksum of its text; ids that are null are not held out."""
    return F.coalesce(F.pmod(F.crc32(column(id_col).cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(False))


def fit_rows(
    documents: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, most: int, most_bytes: int
) -> DataFrame:
    """(text, label) of labelled rows that are not held out: at most ``most`` rows and ``most_bytes`` bytes of text.

    A classifier may be fitted on a bounded sample, and these are its bounds. Rows are taken in the order of the hash of
    their ids; the ids are chosen before any text is read and go to the documents by broadcast. Repeated ids count once,
    with the text of the least hash; contradicting labels count as 1. Where the texts exceed ``most_bytes``, those over ``SHARE`` of it are passed over before
    the sizes are summed. Fails if there are labelled texts but none fits.
    """
    marked = (
        labels.filter(column(label).isNotNull() & column(id_col).isNotNull() & ~held_out(id_col))
        .groupBy(column(id_col).alias("id"))
        .agg(F.max(column(label).cast("int")).alias("label"))
    )
    chosen = marked.orderBy(F.xxhash64("id"), "id").limit(most)
    texts = documents.select(column(id_col).alias("id"), column(text_col).cast("string").alias("text")).filter("text IS NOT NULL")
    first = F.min(F.struct(F.xxhash64("text").alias("hash"), "text"))["text"].alias("text")
    rows = written(texts.join(F.broadcast(chosen), "id").groupBy("id").agg(first, F.max("label").alias("label")), f"fit-{label}")
    if (rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) > most_bytes:
        sized = rows.filter(F.octet_length("text") <= int(SHARE * most_bytes))
        so_far = F.sum(F.octet_length("text").cast("long")).over(Window.orderBy(F.xxhash64("id"), "id"))
        few = sized.select("id", so_far.alias("bytes")).filter(F.col("bytes") <= most_bytes).select("id")
        rows = rows.join(F.broadcast(few), "id", "left_semi")
        if rows.isEmpty():
            raise ValueError(f"every text with a {label} label is longer than {int(SHARE * most_bytes)} bytes")
    return rows.select("text", "label").orderBy(F.xxhash64("id"), "id")
