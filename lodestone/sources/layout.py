"""What a page layout's lines mean, as relations: furniture, body size, heading levels, tables, continuations.

lines: doc_id, page, n (order on the page), text, size, bold, rel_top, x0, y0, x1, y1. Decoding PDF itself is not done here.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.operators.chunking import ELEMENTS, _whole
from lodestone.sources.elements import LISTED


def outside_tables(lines: DataFrame, boxes: DataFrame) -> DataFrame:
    """Lines whose centre is in no table box (doc_id, page, x0, y0, x1, y1) of their page."""
    b = boxes.select("doc_id", "page", *(F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")))
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    inside = (lines["doc_id"] == b["doc_id"]) & (lines["page"] == b["page"]) & x.between(F.col("_x0"), F.col("_x1")) & y.between(F.col("_y0"), F.col("_y1"))
    return lines.join(b, inside, "left_anti")


def without_furniture(lines: DataFrame) -> DataFrame:
    """Lines but bare page numbers, 'page n' in margins, and margin lines that half the pages (two at least) repeat but for digits."""
    margin = (F.col("rel_top") < 0.1) | (F.col("rel_top") > 0.9)
    key = F.trim(F.regexp_replace(F.regexp_replace(F.lower("text"), r"\d+", "#"), r"\s+", " "))
    pages = lines.groupBy("doc_id").agg(F.countDistinct("page").alias("_pages"))
    kept = lines.withColumn("_margin", margin).withColumn("_key", key)
    kept = kept.where(~F.trim("text").rlike(r"^\d{1,4}$") & ~(F.col("_margin") & F.lower("text").rlike(r"\bpage\s+\d+")))
    often = kept.where("_margin").groupBy("doc_id", "_key").agg(F.countDistinct("page").alias("_on")).join(pages, "doc_id")
    often = often.where(F.col("_on") >= F.greatest(F.lit(2), F.ceil(F.col("_pages") / 2))).select("doc_id", "_key", F.lit(True).alias("_margin"))
    return kept.join(often, ["doc_id", "_key", "_margin"], "left_anti").select(*lines.columns)


def body_size(lines: DataFrame) -> DataFrame:
    """doc_id, body: the size that most characters have (ties: the one seen first)."""
    s = lines.groupBy("doc_id", "size").agg(F.sum(F.length("text")).alias("_c"), F.min(F.struct("page", "n")).alias("_first"))
    order = W.partitionBy("doc_id").orderBy(F.desc("_c"), "_first")
    return s.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("doc_id", F.col("size").alias("body"))


def heading_levels(lines: DataFrame, outline: DataFrame) -> DataFrame:
    """Adds level: an outline entry's (doc_id, page, level, title) of the page, its neighbours, else the rank of a larger or bold line's size."""
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\W+", " "))
    sized = lines.join(body_size(lines), "doc_id")
    big = (F.col("size") >= 1.15 * F.col("body"))
    larger = sized.where(big).select("doc_id", "size").distinct().withColumn("_rank", F.dense_rank().over(W.partitionBy("doc_id").orderBy(F.desc("size"))))
    o = outline.select("doc_id", F.explode(F.array(F.col("page") - 1, F.col("page"), F.col("page") + 1)).alias("page"), norm("title").alias("_t"), F.col("level").alias("_ol"), F.col("page").alias("_op"))
    o = o.groupBy("doc_id", "page", "_t").agg(F.min_by("_ol", F.struct("_op", "_ol")).alias("_ol"))
    met = sized.withColumn("_t", norm("text")).join(o, ["doc_id", "page", "_t"], "left").join(larger, ["doc_id", "size"], "left")
    deepest = F.coalesce(F.max("_rank").over(W.partitionBy("doc_id")), F.lit(0)) + 1
    level = F.coalesce(F.col("_ol"), F.when(big, F.col("_rank")), F.when(F.col("bold"), deepest))
    return met.withColumn("level", F.least(level, F.lit(6)).cast("int")).select(*lines.columns, "level")


def joined_lines(texts):
    """An array of lines as one text: hyphenated ends stay, and what follows in lower case joins them."""
    return F.aggregate(texts, F.lit(""), lambda a, x: F.when(a == "", x).when(a.endswith("-") & x.rlike(r"^\p{Ll}"), F.concat(a, x)).otherwise(F.concat(a, F.lit(" "), x)))


def merge_continuations(elements: list[dict]) -> list[dict]:
    """Elements of one document in order, with what a page break cut joined: unfinished paragraphs, tables of one width."""
    out: list[dict] = []
    width = lambda t: t.split("\n")[0].count("|")
    for e in elements:
        last = out[-1] if out else None
        over = last and last["page"] is not None and e["page"] == last.get("last_page", last["page"]) + 1 and last["kind"] == e["kind"]
        if over and e["kind"] == "paragraph" and not last["text"].rstrip().endswith((".", "!", "?", ":")):
            out[-1] = last | {"text": (last["text"] + ("" if last["text"].endswith("-") else " ") + e["text"]), "last_page": e["page"]}
        elif over and e["kind"] == "table" and width(last["text"]) == width(e["text"]):
            rows = e["text"].split("\n")
            repeated = last["text"].split("\n")[:2] == rows[:2]
            body = rows[2:] if repeated or len(rows) > 1 and set(rows[1]) <= set("|-: ") and not rows[0].strip("| ") else rows
            out[-1] = last | {"text": "\n".join([last["text"], *body]), "last_page": e["page"]}
        else:
            out.append(dict(e))
    return [{k: v for k, v in e.items() if k != "last_page"} for e in out]


@F.pandas_udf(ELEMENTS)
def continued(elements: pd.Series) -> pd.Series:
    """merge_continuations() of each row's elements."""
    return elements.map(lambda es: None if es is None else merge_continuations([_whole(e) for e in es]))


def assembled(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """doc_id, elements from lines (doc_id, page, n, block, y0, text, level) and tables (doc_id, page, y0, text), page by page.

    Lines of one block are one paragraph; a heading that wraps is one heading, over blocks too; bullets of neighbouring
    blocks are one list, and their wrapped lines stay with them. A table stands before the first line that begins below
    its top. What a page's end cut is joined.
    """
    l = lines.select("doc_id", "page", "n", "block", "y0", F.trim("text").alias("text"), "level").where("text <> ''")
    by = W.partitionBy("doc_id", "page").orderBy("n")
    bullet = F.col("text").rlike(LISTED)
    same_block = F.col("block") == F.lag("block").over(by)
    # a line after a bullet in the bullet's block is its wrapped end
    l = l.withColumn("_bullet", bullet).withColumn("_in", F.max(F.when(bullet, F.col("n"))).over(W.partitionBy("doc_id", "page", "block").orderBy("n").rowsBetween(W.unboundedPreceding, 0)))
    kind = F.when(F.col("level").isNotNull(), "heading").when(F.col("_in").isNotNull(), "list").otherwise("paragraph")
    l = l.withColumn("kind", kind)
    alike = (F.col("kind") == F.lag("kind").over(by)) & ((F.col("kind") == "list") | (F.col("kind") == "heading") & (F.col("level") == F.lag("level").over(by)) | same_block)
    l = l.withColumn("_no", F.sum(F.when(F.coalesce(alike, F.lit(False)), 0).otherwise(1)).over(by.rowsBetween(W.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("n", "text", "_bullet")))
    texts = F.transform(F.col("_parts"), lambda x: x["text"])
    items = F.aggregate("_parts", F.lit(""), lambda a, x: F.when(a == "", x["text"]).when(x["_bullet"], F.concat(a, F.lit("\n"), x["text"])).otherwise(F.concat(a, F.lit(" "), x["text"])))
    text = F.when(F.col("kind") == "heading", F.array_join(texts, " ")).when(F.col("kind") == "list", items).otherwise(joined_lines(texts))
    found = l.groupBy("doc_id", "page", "_no", "kind").agg(parts.alias("_parts"), F.first("level").alias("level"), F.min("y0").alias("y0")).withColumn("text", text)
    t = tables.select("doc_id", "page", F.lit(0).alias("_no"), F.lit("table").alias("kind"), F.lit(None).cast("int").alias("level"), "y0", "text")
    first = found.select("doc_id", "page", F.col("_no").alias("_at"), F.col("y0").alias("_y"))
    place = t.join(first, ["doc_id", "page"], "left").groupBy("doc_id", "page", "kind", "level", "y0", "text").agg(F.min(F.when(F.col("_y") >= F.col("y0"), F.col("_at"))).alias("_no"))
    every = found.select("doc_id", "page", "_no", F.lit(1).alias("_z"), "y0", "kind", "text", F.col("level").cast("int").alias("level"))
    every = every.unionByName(place.select("doc_id", "page", F.coalesce(F.col("_no"), F.lit(2**62)).alias("_no"), F.lit(0).alias("_z"), "y0", "kind", "text", "level"))
    listed = every.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("page").alias("_p"), "_no", "_z", "y0", "kind", "text", "level"))).alias("e"))
    return listed.select("doc_id", continued(F.transform("e", lambda x: F.struct(x["kind"].alias("kind"), x["text"].alias("text"), x["level"].alias("level"), x["_p"].cast("int").alias("page")))).alias("elements"))
