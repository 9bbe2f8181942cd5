import random

import pytest
from pyspark.sql import functions as F

from docweave.operators import figures, layout
from docweave.sources import tables


def merged(boxes, width):
    """Three sorted runs merged by hand: before each spanning box what begins above it."""
    runs = {"span": [], "left": [], "right": []}
    for o, x0, x1, y1 in boxes:
        kind = "span" if x1 - x0 > width * 0.65 and x0 < width / 2 < x1 else "left" if (x0 + x1) / 2 < width / 2 else "right"
        runs[kind].append((-y1, o))
    for r in runs.values():
        r.sort()
    out = []
    for y, o in runs["span"]:
        for side in ("left", "right"):
            while runs[side] and runs[side][0][0] < y:
                out.append(runs[side].pop(0)[1])
        out.append(o)
    return out + [o for side in ("left", "right") for _, o in runs[side]]


def test_reading_order_of_pages_equals_merging_by_hand(spark):
    rng, rows, want = random.Random(2), [], {}
    for page in range(40):
        boxes = []
        for o in range(rng.choice([1, 2, 9, 30])):
            x0 = rng.randrange(0, 500, 20)
            boxes.append((o, float(x0), float(x0 + rng.choice([60, 250, 400, 560])), float(rng.randrange(0, 12))))
        want[page] = merged(boxes, 600)
        rows += [(1, page, *b, 600.0, f" {b[0]}\n") for b in boxes]
    frame = spark.createDataFrame(rows, "doc_id int, page int, ord int, x0 double, x1 double, y1 double, page_width double, text string").repartition(3)
    got = {}
    for r in layout.page_order(frame).orderBy("page", "place").collect():
        got.setdefault(r.page, []).append(r.ord)
    assert got == want
    text = layout.document_texts(frame).first().text
    assert text == "\n\n".join("\n".join(map(str, want[p])) for p in sorted(want))
    assert layout.document_texts(frame.limit(0)).collect() == []


def random_boxes(rng, n, size):
    for _ in range(n):
        x, y = rng.uniform(0, 1000), rng.uniform(0, 1400)
        w, h = rng.choice([(5, 5), (80, 30), (size, size / 2), (0, 10), (-20, 5)])
        yield x, y, x + w * rng.random(), y + h * rng.random()


@pytest.mark.parametrize("per_cell", [1, 32])
def test_boxes_meet_as_if_all_pairs_were_made(spark, monkeypatch, per_cell):
    monkeypatch.setattr(figures, "CELL_BOXES", per_cell)
    rng = random.Random(per_cell)
    images = [(p, p * 100 + i, *b) for p in range(6) for i, b in enumerate(random_boxes(rng, 12, 600))] + [(2, 901, None, 1.0, 2.0, 3.0), (77, 902, 0.0, 0.0, 5.0, 5.0)]
    texts = [(p, i, f"t{i}", *b) for p in range(6) for i, b in enumerate(random_boxes(rng, [0, 1, 3, 40, 150, 300][p], 300))] + [(3, 999, "null", None, None, None, None)]
    i_frame = spark.createDataFrame(images, "page_id int, image_id int, x0 double, y0 double, x1 double, y1 double")
    t_frame = spark.createDataFrame(texts, "page_id int, ord int, text string, x0 double, y0 double, x1 double, y1 double")
    cover, near = {}, {}
    for p, i, *b in images:
        area, total, best = 0.0, 0.0, None
        if None not in b:
            area = max(0, b[2] - b[0]) * max(0, b[3] - b[1])
            for q, o, text, *t in texts:
                if q == p and None not in t:
                    total += max(0, min(b[2], t[2]) - max(b[0], t[0])) * max(0, min(b[3], t[3]) - max(b[1], t[1]))
                    gap = b[1] - t[3] if t[3] <= b[1] else t[1] - b[3] if t[1] >= b[3] else None
                    if gap is not None and gap < 40 and t[2] >= b[0] and t[0] <= b[2]:
                        best = min(x for x in (best, (gap, o, text)) if x)
        cover[i] = min(1.0, total / area) if area > 0 else 1.0
        if best:
            near[i] = best[2], best[0]
    got = {r.image_id: r.coverage for r in figures.coverage(i_frame, t_frame).collect()}
    assert got.keys() == cover.keys() and all(abs(got[k] - v) < 1e-9 for k, v in cover.items())
    assert {r.image_id: (r.caption, r.gap) for r in figures.nearest_captions(i_frame, t_frame).collect()} == near and len(near) > 8
    pairs = figures.box_pairs(i_frame, t_frame).select("image_id", "ord")
    assert pairs.count() == pairs.distinct().count()


def test_a_page_of_many_boxes_makes_few_pairs(spark):
    n = 100_000
    boxes = spark.range(n).selectExpr("1 AS page_id", "id AS ord", "'t' || id AS text", "cast(id % 400 AS double) * 3 AS x0", "cast(id div 400 AS double) * 6 AS y0").selectExpr("*", "x0 + 2 AS x1", "y0 + 4 AS y1")
    images = boxes.where("ord % 100 = 0").selectExpr("page_id", "ord AS image_id", "x0", "y0", "x1 + 40 AS x1", "y1 + 40 AS y1")
    assert figures.box_pairs(images, boxes).count() < 0.01 * n * n / 100
    got = figures.coverage(images, boxes)
    assert got.count() == n // 100 and got.where("coverage > 0.3 AND coverage < 0.6").count() > 0.8 * n / 100


def test_a_table_is_replaced_without_a_time_in_which_there_is_none(spark, tmp_path):
    path = str(tmp_path / "tasks")
    row = lambda s: spark.createDataFrame([("k", "s", 1, s)], tables.SCHEMAS["tasks"])
    for status in ("pending", "processing", "failed"):
        tables.write(row(status), path, "tasks", None)
        assert [r.status for r in tables.read(spark, path, "tasks").collect()] == [status]
    assert tables._versions(spark, path) == [2, 3]
    # a driver that is lost while it writes leaves files, but no version
    row("completed").write.parquet(f"{path}/version=00000004")
    (tmp_path / "tasks" / "version=00000004" / "_SUCCESS").unlink()
    assert [r.status for r in tables.read(spark, path, "tasks").collect()] == ["failed"] and tables.readable(spark, path, "tasks")
    tables.write(row("completed").union(row("completed").withColumn("source", F.lit("t"))), path, "tasks", None)
    assert tables.read(spark, path, "tasks").count() == 2
    with pytest.raises(Exception, match="already there"):
        tables.insert(row("pending").limit(0), row("pending").union(row("failed")), ["kg_id", "source", "chunk_index"]).collect()
