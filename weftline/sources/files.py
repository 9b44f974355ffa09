"""Readers and writers of whole formats: page dumps, vectors, lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PAGE = "id long, title string, ns int, redirect struct<_title: string>, revision struct<id: long, text: struct<_VALUE: string>>"


def pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of an XML dump: id, revid, title, ns, text, redirect (the target's title, or null)."""
    raw = spark.read.format("xml").option("rowTag", "page").schema(PAGE).load(path)
    return raw.select("id", F.col("revision.id").alias("revid"), "title", "ns", F.col("revision.text._VALUE").alias("text"), F.col("redirect._title").alias("redirect"))


def articles(dump: DataFrame, disambiguation: bool = True) -> DataFrame:
    """Pages of namespace 0 that are no redirects, each id once; without pages of several meanings on demand."""
    kept = dump.where("ns = 0 and redirect is null").dropDuplicates(["id"])
    return kept if disambiguation else kept.where("not text rlike '\\\\{\\\\{disambig'")


def redirects(dump: DataFrame) -> DataFrame:
    return dump.where("redirect is not null").select(F.col("title").alias("from"), F.col("redirect").alias("to"))


def site_info(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", "siteinfo").load(path)


def templates(dump: DataFrame) -> DataFrame:
    return dump.where("ns in (10, 828)").select("title", "text")


def extracted(spark: SparkSession, path: str) -> DataFrame:
    """Extracted documents, one JSON object a line."""
    return spark.read.schema("id string, url string, title string, text string").json(path)


def documents_of(spark: SparkSession, path: str) -> DataFrame:
    """<doc id url title> blocks."""
    raw = spark.read.format("xml").option("rowTag", "doc").schema("_id string, _url string, _title string, _VALUE string").load(path)
    return raw.select(*[F.col(f"_{c}").alias(c) for c in ("id", "url", "title")], F.col("_VALUE").alias("text"))


def vector_bytes(rows: list[tuple[str, list[np.ndarray]]]) -> bytes:
    """"N D" and a line end; then for each item its label, a tab, little-endian float32 values and a line end."""
    d = len(rows[0][1][0]) if rows else 0
    body = b"".join(label.encode() + b"\t" + b"".join(np.asarray(v, "<f4").tobytes() for v in vs) + b"\n" for label, vs in rows)
    return f"{len(rows)} {d}\n".encode() + body


def read_vectors(spark: SparkSession, path: str, arrays: int = 1, vocabulary: DataFrame | None = None, first: int | None = None) -> DataFrame:
    """label, vec (and mu, if arrays is 2) of binary vector files; one file is one task's work."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch["content"].to_pylist():
                head, at = blob.split(b"\n", 1)[0], blob.index(b"\n") + 1
                n, d = map(int, head.split())
                labels, vectors = [], []
                while at < len(blob) and len(labels) < n:
                    stop = min(x for x in (blob.find(b"\t", at), blob.find(b" ", at)) if x >= 0)
                    labels.append(blob[at:stop].decode(errors="replace"))
                    vectors.append(np.frombuffer(blob, "<f4", arrays * d, stop + 1))
                    at = stop + 1 + 4 * arrays * d + 1
                both = np.array(vectors, np.float32).reshape(len(labels), arrays, d)
                lists = [pa.array([list(map(float, v[k])) for v in both], pa.list_(pa.float32())) for k in range(arrays)]
                yield pa.record_batch([pa.array(labels, pa.string()), pa.array(range(len(labels)), pa.int64()), *lists], names=["label", "n", "vec", "mu"][: 2 + arrays])

    schema = "label string, n long, vec array<float>" + (", mu array<float>" if arrays == 2 else "")
    out = spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, schema)
    if first is not None:
        out = out.where(F.col("n") < first)
    return out.join(vocabulary, "label", "left_semi") if vocabulary is not None else out


def write_vectors(df: DataFrame, path: str, arrays: tuple[str, ...] = ("vec",)) -> None:
    """Vectors as Parquet: the format for large sets. vector_bytes() serves tools that want the binary one."""
    df.select("label", *arrays).write.parquet(path)


def tsv_lines(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(F.concat_ws("\t", *columns).alias("value"))


def adjacency_lines(edges: DataFrame, head: str, dst: str) -> DataFrame:
    """head, tab, its distinct targets in order; heads without a target are left out."""
    rows = edges.where(F.col(head).isNotNull() & F.col(dst).isNotNull()).groupBy(head).agg(F.array_sort(F.collect_set(F.col(dst).cast("string"))).alias("d"))
    return rows.select(F.concat_ws("\t", F.col(head).cast("string"), F.concat_ws("\t", "d")).alias("value"))


def page_json(df: DataFrame, least: int = 0, revision: bool = False) -> DataFrame:
    columns = ["id", *(["revid"] if revision else []), "url", "title", "text"]
    return df.where(F.length("text") >= least).select(F.to_json(F.struct(*columns)).alias("value"))


def page_blocks(df: DataFrame, least: int = 0) -> DataFrame:
    block = F.format_string('<doc id="%s" url="%s" title="%s">\n%s\n</doc>', "id", "url", "title", "text")
    return df.where(F.length("text") >= least).select(block.alias("value"))


def parallel_lines(pairs: DataFrame) -> DataFrame:
    """article, entity, sentences of both sides -> the two tagged lines of each pair."""
    side = lambda k, x: F.concat_ws("\t", F.lit(k), F.col(f"article{x}"), F.col(f"entity{x}"), F.concat_ws("\t", f"sentences{x}"))
    both = pairs.where("size(sentences1) > 0 and size(sentences2) > 0")
    return both.select(F.explode(F.array(side("1", 1), side("2", 2))).alias("value"))


def write_text(df: DataFrame, path: str, compression: str | None = None, records: int | None = None) -> None:
    w = df.select("value").write.mode("append")
    w = w.option("compression", compression) if compression else w
    (w.option("maxRecordsPerFile", records) if records else w).text(path)


def cross_link_lines(links: DataFrame, languages: tuple[str, ...]) -> DataFrame:
    """links: a column for each language. n, value: the number of rows, the languages, then the rows (n from 2, equal for all)."""
    head = links.agg(F.count("*").cast("string").alias("value")).select(F.lit(0).alias("n"), "value")
    names = head.select(F.lit(1).alias("n"), F.lit("\t".join(languages)).alias("value"))
    rows = links.select(F.lit(2).alias("n"), F.concat_ws("\t", *[F.coalesce(F.col(x).cast("string"), F.lit("")) for x in languages]).alias("value"))
    return head.union(names).union(rows)


def csv_lines(df: DataFrame, *columns: str) -> DataFrame:
    """Rows without a header; null is empty. write_text() appends them."""
    return df.select(F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias("value"))


def candidate_lines(cands: DataFrame) -> DataFrame:
    """mention, entity -> mention and its distinct entities in order; mentions of one character are left out."""
    rows = cands.where("length(mention) > 1").groupBy("mention").agg(F.array_sort(F.collect_set(F.col("entity").cast("string"))).alias("e"))
    return rows.select(F.concat_ws("\t", "mention", F.concat_ws("\t", "e")).alias("value"))


def attention_lines(words: DataFrame) -> DataFrame:
    """pair, k, word and the weights kg, w, combined -> one line a pair: word(kg\\w\\combined) in order."""
    each = F.format_string("%s(%.5f\\%.5f\\%.5f)", "word", "kg", "w", "combined")
    rows = words.withColumn("s", each).groupBy("pair").agg(F.array_sort(F.collect_list(F.struct("k", "s"))).alias("x"))
    return rows.select("pair", F.concat_ws(" ", F.col("x.s")).alias("value"))


def running_totals(rows: DataFrame, key: str, value: str, width: int = 10_000) -> DataFrame:
    """Adds before: the sum of value over all rows with smaller keys (distinct whole numbers). Sums go by ranges of `width`
    keys, and a row for each range is all that one task sees of the whole."""
    cell = rows.withColumn("_cell", F.floor(F.col(key) / width))
    sums = cell.groupBy("_cell").agg(F.sum(value).alias("_s"))
    earlier = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("_cell", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_base"))
    local = Window.partitionBy("_cell").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    out = cell.withColumn("_local", F.coalesce(F.sum(value).over(local), F.lit(0))).join(bases, "_cell")
    return out.withColumn("before", F.col("_base") + F.col("_local")).drop("_cell", "_local", "_base")


def output_files(rows: DataFrame, key: str, size: str, most: int, per_folder: int = 100) -> DataFrame:
    """Adds path: folders AA, AB, ... of `per_folder` files of about `most` bytes, in the order of key."""
    file = F.floor(F.col("before") / most)
    folder = F.floor(file / per_folder)
    letter = lambda c: F.char(F.lit(65) + c % 26)
    path = F.concat(letter(F.floor(folder / 26)), letter(folder), F.lit("/wiki_"), F.lpad((file % per_folder).cast("string"), 2, "0"))
    return running_totals(rows, key, size).withColumn("path", path)
