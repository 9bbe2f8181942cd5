"""Image logic that needs no pixels: coverage, scores, captions, figure numbers, reading order."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.config import IMAGE_BASE_SCORES
from docweave.operators.folds import fold_rows

#: Figure numbers in captions, references in running text, and phrases that always call for a closer look (fixed patterns).
CAPTION = r"(?:圖|附圖|Figure|Fig\.?)\s*[\.:：]?\s*(\d+(?:[-.]\d+)?)"
REFERENCE = r"(?:如|見|參[見閱]|詳)?(?:上|下)?(?:圖|附圖|Figure|Fig\.?)\s*(\d+(?:[-.]\d+)?)\s*(?:所示|所述|說明|shows|illustrates)?"
BYPASS = r"(如下圖|如上圖|下圖所示|上圖所示|圖\s*\d+\s*(?:所示|說明)|Figure\s*\d+\s*(?:shows|illustrates|below|above))"
AUTO_PREFIX = "自補圖"
#: What stands for images in a text (fixed texts).
NO_TEXT, SEEN, READ, POOR, PAGE_HEAD = "（圖片無可辨識文字內容）", "圖像語義描述（來源: 本地圖理解模型）: ", "圖片 OCR 文字（來源: OCR", "，資訊可能不足", "--- [第 "
IMAGE_HEAD, TITLE, PAGE_TAIL = "[圖片:", "標題: ", " 頁圖片解析] ---\n"
#: The least width and height of an image that counts, in pixels as displayed, and the score from which a model looks at it (fixed values).
SMALLEST, UPGRADE = 40.0, 60.0


def coverage(images: DataFrame, boxes: DataFrame, page: str = "page_id", image: str = "image_id") -> DataFrame:
    """image, coverage (sum of overlaps with text boxes of its page over its area, 1 at most) and covered (0.7 or more; an image without area is covered).
    Boxes meet in the cells of a grid (see box_pairs()); null coordinates overlap nothing."""
    area = F.greatest(F.lit(0.0), F.col("x1") - F.col("x0")) * F.greatest(F.lit(0.0), F.col("y1") - F.col("y0"))
    overlap = F.greatest(F.lit(0.0), F.least("ix1", "x1") - F.greatest("ix0", "x0")) * F.greatest(F.lit(0.0), F.least("iy1", "y1") - F.greatest("iy0", "y0"))
    sums = box_pairs(images, boxes, page, image).select(image, overlap.alias("s")).unionByName(images.select(image, F.lit(0.0).alias("s"))).groupBy(image).agg(F.sum("s").alias("s"))
    areas = images.groupBy(image).agg(F.max(area).alias("area"))
    share = F.when(F.col("area") > 0, F.least(F.lit(1.0), F.col("s") / F.col("area"))).otherwise(1.0)
    return sums.join(areas, image).select(image, share.alias("coverage"), (share >= 0.7).alias("covered"))


#: Boxes of a page for each cell of its grid, about, and cells along each side at most.
CELL_BOXES, MOST_CELLS = 32, 256


def box_pairs(images: DataFrame, texts: DataFrame, page: str = "page_id", image: str = "image_id", reach: float = 0.0) -> DataFrame:
    """image, its coordinates as ix0 to iy1, and the columns of a text of the same page, for every pair whose boxes meet or are at most `reach` apart from top to bottom.
    Pairs that are further apart can be among them, but none is there twice.

    A page is cut into a grid of cells, as many as its boxes call for (one on a page of few), and pairs meet in the cells that both touch. They count in the cell where the later of
    their left edges and the later of their lower edges are. A crowded page so is many groups, and far boxes never meet.
    """
    i = images.select(page, image, *[F.col(c).alias(f"i{c}") for c in ("x0", "y0", "x1", "y1")]).where("ix0 + iy0 + ix1 + iy1 IS NOT NULL")
    t = texts.where("x0 + y0 + x1 + y1 IS NOT NULL")
    low, high = lambda a, b: F.min(F.least(a, b)), lambda a, b: F.max(F.greatest(a, b))
    side = F.least(F.lit(MOST_CELLS), F.greatest(F.lit(1), F.floor(F.sqrt(F.count("*") / CELL_BOXES)))).cast("int")
    grid = t.groupBy(page).agg(low("x0", "x1").alias("gx0"), high("x0", "x1").alias("gx1"), low("y0", "y1").alias("gy0"), high("y0", "y1").alias("gy1"), side.alias("side"))

    def cell(x: Column, axis: str) -> Column:
        a, b = F.col(f"g{axis}0"), F.col(f"g{axis}1")
        at = F.when(b > a, F.floor((x - a) / (b - a) * F.col("side"))).otherwise(F.lit(0))
        return F.greatest(F.lit(0), F.least(F.col("side") - 1, at)).cast("int")

    def touched(axis: str, a: Column, b: Column) -> Column:
        return F.explode(F.sequence(cell(F.least(a, b), axis), cell(F.greatest(a, b), axis)))

    c = F.col
    left = i.join(grid, page).select(i["*"], cell(c("ix0"), "x").alias("ifx"), cell(F.least("iy0", "iy1") - reach, "y").alias("ify"), touched("x", c("ix0"), c("ix1")).alias("cx"), "gy0", "gy1", "side")
    left = left.select("*", touched("y", F.least("iy0", "iy1") - reach, F.greatest("iy0", "iy1") + reach).alias("cy")).drop("gy0", "gy1", "side")
    right = t.join(grid, page).select(t["*"], cell(c("x0"), "x").alias("tfx"), cell(F.least("y0", "y1"), "y").alias("tfy"), touched("x", c("x0"), c("x1")).alias("cx"), "gy0", "gy1", "side")
    right = right.select("*", touched("y", F.least("y0", "y1"), F.greatest("y0", "y1")).alias("cy")).drop("gy0", "gy1", "side")
    met = left.join(right, [page, "cx", "cy"]).where((c("cx") == F.greatest("ifx", "tfx")) & (c("cy") == F.greatest("ify", "tfy")))
    return met.drop("cx", "cy", "ifx", "ify", "tfx", "tfy")


def ocr_score(text: Column, confidence: Column) -> Column:
    base = F.greatest(F.lit(0.0), 100.0 - confidence)
    strong = (F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", "") != "") & (confidence < 30)
    return F.least(F.lit(100.0), F.when(strong, F.greatest(base, F.lit(85.0))).otherwise(base))


def image_score(doc_type: Column, ocr: Column, graphic: Column) -> Column:
    """0.3 document kind + 0.4 OCR + 0.3 graphics, to two places."""
    base = F.coalesce(F.create_map(*[x for k, v in IMAGE_BASE_SCORES.items() for x in (F.lit(k), F.lit(v))])[doc_type], F.lit(25.0))
    return F.round(base * 0.3 + ocr * 0.4 + graphic * 0.3, 2)


def forced(nearby: Column, full: Column, figure_id: Column, id_type: Column) -> Column:
    """Whether text calls for a closer look: near the image, by its own number, or anywhere if it has none of its own."""
    hit = lambda c: F.coalesce(c, F.lit("")).rlike(f"(?i){BYPASS}")
    own = (id_type == "original") & (figure_id != "") & F.lower(F.coalesce(full, F.lit(""))).contains(F.lower(figure_id))
    return hit(nearby) | own | ((id_type == "auto") & hit(full))


def mean_confidence(words: DataFrame, image: str = "image_id") -> DataFrame:
    """image, ocr_text (its words in order) and ocr_confidence (mean of those of 0 and more; 0 without any) from (image, ord, word, confidence). Blank words are left out."""
    seen = words.where(F.trim("word") != "")
    mean = F.avg(F.when(F.col("confidence") >= 0, F.col("confidence")))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", F.trim("word").alias("word")))), lambda x: x["word"]), " ")
    return seen.groupBy(image).agg(text.alias("ocr_text"), F.coalesce(mean, F.lit(0.0)).alias("ocr_confidence"))


def graphic_score(pixels: Column) -> Column:
    """0 to 100: how much of an image is edges and straight lines, from its edge strengths (array of rows of numbers).

    60 parts the share of edge pixels (above 40), 40 parts the share of rows and of columns with more than 30 % of them.
    """
    strong = lambda values: F.aggregate(F.transform(values, lambda v: (v > 40).cast("double")), F.lit(0.0), lambda a, x: a + x)
    mean = lambda values: F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)
    lines = lambda shares: mean(F.transform(shares, lambda s: (s > 0.3).cast("double")))
    rows = F.transform(pixels, lambda r: strong(r) / F.size(r))
    columns = F.transform(F.sequence(F.lit(0), F.size(pixels[0]) - 1), lambda i: strong(F.transform(pixels, lambda r: r[i])) / F.size(pixels))
    score = 100 * (0.6 * mean(rows) + 0.4 * (lines(rows) + lines(columns)) / 2)
    return F.when((F.size(pixels) > 0) & (F.size(pixels[0]) > 0), F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))).otherwise(0.0)


def text_block(figure_id: Column, caption: Column, ocr_text: Column, understanding: Column, score: Column, threshold: float = UPGRADE) -> Column:
    """What stands for an image in the text: its number, its caption, and what a model or the OCR says of it."""
    none = F.lit(NO_TEXT)
    note = F.when(score >= threshold, POOR).otherwise("")
    said = F.coalesce(F.nullif(understanding, F.lit("")), F.lit(""))
    body = F.when(said != "", F.concat(F.lit(SEEN), said)).when(ocr_text != "", F.concat(F.lit(READ), note, F.lit("）: "), ocr_text)).otherwise(none)
    return F.concat_ws("\n", F.concat(F.lit(IMAGE_HEAD), figure_id, F.lit("]")), F.when(caption != "", F.concat(F.lit(TITLE), caption)), body)


def process(images: DataFrame, doc: str = "doc_id", model: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The images of each document that are shown at SMALLEST pixels and more each way, numbered in reading order (by page, from the top), with score, upgraded
    and block.

    images: doc, page, image_id, y1 (page and y1 never null: they are the order), width, height (as displayed, in pixels), doc_type, caption, full_text, ocr_text, ocr_confidence, graphic, force. model gets
    the rows that are upgraded (by their score, or forced) and adds a column `understanding`.
    """
    shown = images.where((F.col("width") >= SMALLEST) & (F.col("height") >= SMALLEST))
    place = F.row_number().over(Window.partitionBy(doc).orderBy("page", F.desc("y1"), "image_id"))
    ordered = shown.withColumn("ord", place)
    numbered = number_figures(ordered, doc, "ord")
    rows = ordered.join(numbered, [doc, "ord"])
    rows = rows.withColumn("score", image_score(F.col("doc_type"), ocr_score(F.col("ocr_text"), F.col("ocr_confidence")), F.col("graphic")))
    call = F.coalesce("force", F.lit(False)) | forced(F.col("caption"), F.col("full_text"), F.col("figure_id"), F.col("id_type"))
    rows = rows.withColumn("upgraded", call | (F.col("score") >= UPGRADE))
    if model is None:
        rows = rows.withColumn("understanding", F.lit(None).cast("string"))
    else:
        rows = model(rows.where("upgraded")).select(*rows.columns, "understanding").unionByName(rows.where("not upgraded").withColumn("understanding", F.lit(None).cast("string")))
    titled = F.when(F.coalesce("caption", F.lit("")).rlike(f"(?i){CAPTION}"), F.regexp_replace("caption", r"(?U)^\s+|\s+$", "")).otherwise("")
    block = text_block(F.col("figure_id"), titled, F.coalesce("ocr_text", F.lit("")), F.col("understanding"), F.col("score"))
    return rows.select(doc, "page", "image_id", "ord", "figure_id", "id_type", "match_source", "score", "upgraded", block.alias("block"))


def page_blocks(processed: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, page and text: the blocks of a page's images, from the top, under a heading."""
    blocks = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "block"))), lambda b: b["block"]), "\n\n")
    return processed.groupBy(doc, "page").agg(blocks.alias("b")).select(doc, "page", F.concat(F.lit(PAGE_HEAD), F.col("page").cast("string"), F.lit(PAGE_TAIL), "b").alias("text"))


def emu_to_px(emu: Column) -> Column:
    return emu / 9525.0


def points_to_px(points: Column) -> Column:
    return points * (96.0 / 72.0)


def nearest_captions(images: DataFrame, texts: DataFrame, page: str = "page_id", image: str = "image_id", max_gap: float = 40.0) -> DataFrame:
    """For each image the text above or below it, overlapping it across, with the smallest gap under max_gap; the first of equals (by ord).
    Only boxes in the band of max_gap around an image meet it (see box_pairs())."""
    gap = F.when(F.col("y1") <= F.col("iy0"), F.col("iy0") - F.col("y1")).when(F.col("y0") >= F.col("iy1"), F.col("y0") - F.col("iy1"))
    near = box_pairs(images, texts, page, image, max_gap).where((F.col("x1") >= F.col("ix0")) & (F.col("x0") <= F.col("ix1"))).withColumn("gap", gap).where(F.col("gap") < max_gap)
    return near.groupBy(image).agg(F.min(F.struct("gap", "ord", "text")).alias("m")).select(image, F.col("m.text").alias("caption"), F.col("m.gap").alias("gap"))


def reading_order(shapes: Column, tolerance: int = 228600) -> Column:
    """Array of struct(top, left, ...) in reading order: sorted by top, cut into rows that begin where a shape is further than
    the tolerance below its row's first, then by left within a row."""
    kind = F.array_sort(shapes, lambda a, b: F.when(a["top"] < b["top"], -1).when(a["top"] > b["top"], 1).otherwise(0))
    first = F.struct(F.lit(-1).alias("row"), F.lit(None).cast("long").alias("anchor"), F.array().cast("array<int>").alias("rows"))

    def step(s: Column, top: Column) -> Column:
        new = s["anchor"].isNull() | (top - s["anchor"] > tolerance)
        row = s["row"] + new.cast("int")
        return F.struct(row.alias("row"), F.when(new, top).otherwise(s["anchor"]).alias("anchor"), F.concat(s["rows"], F.array(row)).alias("rows"))

    def placed(k: Column) -> Column:
        rows = F.aggregate(F.transform(k, lambda x: x["top"].cast("long")), first, step, lambda s: s["rows"])
        return F.transform(F.array_sort(F.zip_with(F.zip_with(k, F.sequence(F.lit(1), F.size(k)), lambda x, i: F.struct(x.alias("shape"), i.alias("i"))), rows,
                           lambda x, r: F.struct(r.alias("row"), x["shape"]["left"].alias("left"), x["i"].alias("i"), x["shape"].alias("shape")))), lambda r: r["shape"])

    return F.when(F.size(shapes) > 0, F.transform(F.array(kind), placed)[0]).otherwise(shapes)


def number_figures(images: DataFrame, doc: str = "doc_id", order: str = "ord") -> DataFrame:
    """figure_id, id_type and match_source of the images of each document, in order: from the caption, the running text,
    the printed text, or else a number of our own. No id is given twice in a document. Documents are independent; a document's images are one ordered fold."""

    caption, reference = re.compile(CAPTION, re.I), re.compile(REFERENCE, re.I)

    def step(state: dict, r) -> tuple:
        tries = [("caption", caption.search(r.caption or "")), *(("inline_reference", m) for m in reference.finditer(r.full_text or "")), ("printed_number", caption.search(r.ocr_text or ""))]
        hit = next(((s, f"圖{m[1]}") for s, m in tries if m and f"圖{m[1]}" not in state["used"]), None)
        if hit is None:
            state["auto"] += 1
            hit = ("none", f"{AUTO_PREFIX}-{state['auto']}")
        state["used"].add(hit[1])
        return getattr(r, doc), getattr(r, order), hit[1], "auto" if hit[0] == "none" else "original", hit[0]

    kind = {c: images.schema[c].dataType.simpleString() for c in (doc, order)}
    schema = f"{doc} {kind[doc]}, {order} {kind[order]}, figure_id string, id_type string, match_source string"
    return fold_rows(images.select(doc, order, "caption", "full_text", "ocr_text"), doc, order, lambda: {"used": set(), "auto": 0}, step, schema)
