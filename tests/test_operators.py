import random
import sys
import zipfile

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from docweave import providers
from docweave.functions import text as T
from docweave.functions import vectors as V
from docweave.operators import classify, clusters, coreference, entities, figures, graph, pool, preparation, resolution, tasks
from docweave.sources import files, tables, web
from docweave.streaming import streams

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the stand-in models below are sent to the tasks


def one(spark, column, **values):
    row = spark.range(1).select(*[v.alias(k) if hasattr(v, "alias") else F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("out")).first()["out"]


@pytest.mark.parametrize(("text", "n"), [
    ("這是第一句。這是第二句！這是第三句？", 3), ("See e.g. this, i.e. that vs. those, at 3.14 。", 1), ("前半句；後半句。", 2), ("", 0), ("One. Two? Three!", 3), ("NASA。next", 1), ("共有35。次", 1), ("a.\nb", 2)])
def test_sentences(spark, text, n):
    parts = one(spark, T.sentences(F.col("t")), t=text)
    assert len(parts) == n and "".join(parts) == text


def fold(parts, size=500, overlap=50):
    """Chunks by hand."""
    done, cur = [], []
    for p in parts:
        if len(p) >= size:
            done += (["".join(cur)] if cur else []) + [p]
            cur = []
        elif sum(map(len, cur)) + len(p) > size:
            done.append("".join(cur))
            while sum(map(len, cur)) > overlap:
                cur = cur[1:]
            cur = [*cur, p]
        else:
            cur = [*cur, p]
    return [c.strip() for c in [*done, "".join(cur)] if c.strip()]


def test_chunks_equal_folding_by_hand(spark):
    rng = np.random.default_rng(1)
    rows = [["x" * int(k) + ". " for k in rng.choice([3, 20, 40, 120, 480, 600], rng.integers(0, 30))] for _ in range(40)] + [["第一句。"] * 200]
    got = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, s array<string>").select("i", T.chunks(F.col("s")).alias("c")).collect()
    for r in got:
        assert r.c == fold(rows[r.i])


@pytest.mark.parametrize(("n", "overlap", "want"), [(11, 2, [(1, 5), (4, 8), (7, 11)]), (7, 0, [(1, 5), (6, 7)]), (0, 2, []), (1, 2, [(1, 1)]), (5, 2, [(1, 5)]), (6, 2, [(1, 5), (4, 6)])])
def test_windows(spark, n, overlap, want):
    made = one(spark, T.windows(F.expr(f"slice(transform(sequence(1, 30), x -> string(x)), 1, {n})"), overlap=overlap))
    assert [(w.sentence_start, w.sentence_end) for w in made] == want and all(len(w.sentences) == w.sentence_end - w.sentence_start + 1 for w in made)


def test_window_arguments():
    with pytest.raises(ValueError):
        T.windows(F.col("x"), size=2, overlap=2)


@pytest.mark.parametrize(("source", "stem"), [("D:/Users/666/Desktop/report.pdf", "report"), ("", "untitled"), ("a b.tar.gz", "a_b.tar"), ("https://x.org/a?b=1", "https___x.org_a_b=1"), ("C:\\dir\\f.txt", "f")])
def test_stems(spark, source, stem):
    assert one(spark, T.safe_stem(F.col("s")), s=source) == stem


def test_names_and_front_matter(spark):
    assert one(spark, T.chunk_filename(F.lit(1), F.lit(1234))) == "chunk-0001-of-1234.md"
    block = one(spark, T.front_matter(source=F.lit('a"b\\c'), chunk_index=F.lit(2)))
    assert block == '---\nsource: "a\\"b\\\\c"\nchunk_index: 2\n---'
    assert one(spark, T.without_front_matter(F.lit(block + "\n\nbody\n---\n"))) == "body\n---\n"


def test_pronouns_codes_and_naming(spark):
    assert one(spark, T.has_pronoun(F.lit("其他公司也跟進了。"))) and not one(spark, T.has_pronoun(F.lit("公司跟進了。")))
    assert one(spark, T.code_mentions(F.lit("I-35 是美國州際公路。"))) == ["I-35"] and one(spark, T.code_mentions(F.lit("公路I-36"))) == []
    name, about = T.naming_reply(F.lit("名稱：圖譜\n描述：說明"))
    assert (one(spark, name), one(spark, about)) == ("圖譜", "說明") and one(spark, T.naming_reply(F.lit("?"))[0]) == "新知識庫"
    assert one(spark, T.table_markdown(F.array(F.array(F.lit("a"), F.lit("b\nc")), F.array(F.lit("x"), F.lit("x"))))) == "| a | b<br>c |\n| --- | --- |\n| x |  |"


def test_cosine_and_means(spark):
    arr = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    assert one(spark, V.cosine(arr(1, 0), arr(0, 0))) == 0.0 and abs(one(spark, V.cosine(arr(1, 0), arr(0.6, 0.8, 5))) - 0.6 / 26**0.5) < 1e-12
    assert one(spark, V.updated_mean(arr(0, 0), F.lit(2), arr(3, 3))) == [1.0, 1.0] and one(spark, V.updated_mean(F.lit(None).cast("array<double>"), F.lit(0), arr(3, 3))) == [3.0, 3.0]
    rows = spark.createDataFrame([("a", [1.0, 0.0, 0.0]), ("a", [0.0, 1.0, 0.0]), ("b", None)], "k string, v array<double>")
    assert [tuple(r) for r in V.mean_vectors(rows, ["k"], "v").collect()] == [("a", [0.5, 0.5, 0.0], 2)]


def test_ranking_and_assignment(spark):
    protos = spark.createDataFrame([("KG-1", [0.6, 0.8], 5), ("KG-2", [1.0, 0.0], 1), ("KG-3", None, 0)], "kg_id string, prototype array<double>, member_count long")
    docs = spark.createDataFrame([("d1", [1.0, 0.0]), ("d2", [1.0, 0.1]), ("d3", None), ("d4", [-1.0, 0.0])], "doc_id string, vector array<double>")
    ranked = classify.candidates(classify.scores(docs, protos), "doc_id")
    assert [(r.kg_id, r.low_confidence) for r in ranked.where("doc_id = 'd1'").orderBy("rank").collect()] == [("KG-2", True), ("KG-1", False)]
    got = [(r.doc_id, r.kg_id, r.assigned) for r in classify.auto_assign(docs, protos).orderBy("doc_id").collect()]
    assert got == [("d1", "KG-2", True), ("d2", "KG-2", True), ("d3", None, False), ("d4", None, False)]
    assigned, moved = classify.assign_round(docs, protos)
    assert {(r.doc_id, r.kg_id) for r in assigned.collect()} == {("d1", "KG-2"), ("d2", "KG-2")}
    after = {r.kg_id: (r.prototype, r.member_count) for r in moved.collect()}
    assert np.allclose(after["KG-2"][0], [1.0, 0.1 / 3]) and after["KG-2"][1] == 3 and after["KG-1"] == ([0.6, 0.8], 5) and after["KG-3"] == (None, 0)


def spanning_tree(x):
    """(a, b, distance) rows of the minimum spanning tree, point by point."""
    n = len(x)
    best, link, left, at, out = np.full(n, np.inf), np.zeros(n, int), np.ones(n, bool), 0, []
    for _ in range(n - 1):
        left[at] = False
        d = np.sqrt(((x - x[at]) ** 2).sum(1))
        closer = left & (d < best)
        best[closer], link[closer] = d[closer], at
        at = int(np.where(left, best, np.inf).argmin())
        out.append((link[at], at, best[at]))
    tree = np.array(out).reshape(-1, 3)
    return tree[np.argsort(tree[:, 2], kind="stable")]


def reduced(x, to):
    centred = x - x.mean(0)
    v = np.linalg.svd(centred, full_matrices=False)[2][:to]
    return centred @ (v * np.sign(v[np.arange(len(v)), np.abs(v).argmax(1)])[:, None]).T


def test_clusters(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = np.concatenate([c + rng.normal(0, 0.1, (n, 2)) for n, c in ((5, (0, 0)), (4, (8, 8)), (3, (-8, 8)))] + [np.array([[30.0, -30.0], [-40.0, -35.0]])])
    labels = clusters.tree_labels(len(x), spanning_tree(x))
    assert [len(set(labels[a:b])) for a, b in ((0, 5), (5, 9), (9, 12))] == [1, 1, 1] and len(set(labels[:12])) == 3 and list(labels[12:]) == [-1, -1]
    assert list(clusters.tree_labels(2, spanning_tree(x[:2]))) == [-1, -1] and list(clusters.tree_labels(3, spanning_tree(x[:3]))) == [0, 0, 0]
    y = np.concatenate([rng.normal(0, 0.3, (30, 7)) + 4 * (i == k) for k, i in ((j, np.arange(7)) for j in range(3))])
    monkeypatch.setattr(clusters, "BLOCK", 9)
    rows = [("p", i, v.tolist()) for i, v in enumerate(x)] + [("p", 99, None), ("one", 5, [1.0])] + [("q", i, v.tolist()) for i, v in enumerate(y)]
    got = {(r.pool, r.i): r.label for r in clusters.cluster_pool(spark.createDataFrame(rows, "pool string, i int, vector array<double>"), "pool", "i").collect()}
    assert [got["p", i] for i in range(14)] == list(labels) and got["p", 99] == got["one", 5] == -1
    want = clusters.tree_labels(len(y), spanning_tree(reduced(y, 5)))
    assert [got["q", i] for i in range(90)] == list(want) and len(set(want)) > 2


def test_registry_and_ratio(spark):
    rows = [("d", 0, "Stone spoke.", ["Stone"]), ("d", 1, "Richard Stone left.", ["Richard Stone"]), ("d", 2, "Stone returned.", ["Stone"]), ("e", 0, "Interstate Highway, IH.", ["Interstate Highway", "IH"])]
    got = {(r.doc_id, r.sentence_idx): r.sentence for r in entities.apply_registry(spark.createDataFrame(rows, "doc_id string, sentence_idx int, sentence string, forms array<string>")).collect()}
    assert got["d", 2] == "Richard Stone returned." and got["d", 0] == "Stone spoke." and got["e", 0] == "Interstate Highway, Interstate Highway."
    assert abs(entities.edit_ratio("台積電", "台積電公司") - 0.75) < 1e-12 and entities.edit_ratio("tide", "diet") != entities.edit_ratio("diet", "tide")
    with pytest.raises(ValueError):
        entities.Registry().resolve(0, " ", "x")
    tagged = F.array(F.struct(F.lit("I-35").alias("text"), F.lit("地點").alias("entity_type")))
    assert [tuple(m) for m in one(spark, entities.mentions_of(F.lit("I-35 and M-1"), tagged))] == [("I-35", "地點"), ("M-1", "概念")]


def test_coreference_sees_earlier_results(spark):
    rows = spark.createDataFrame([("d", i, s) for i, s in enumerate(["台積電擴廠。", "它成長。", "它獲利。", "其次。"])], "doc_id string, sentence_idx int, sentence string")
    seen = []
    got = coreference.resolve(rows, lambda s, before, after: s.replace("它", "台積電") if len(before) <= 4 and len(after) <= 2 else None).orderBy("sentence_idx").collect()
    assert [r.sentence for r in got] == ["台積電擴廠。", "台積電成長。", "台積電獲利。", "其次。"] and seen == []
    failed = coreference.resolve(rows, lambda s, before, after: 1 / 0).orderBy("sentence_idx").collect()
    assert [r.sentence for r in failed] == ["台積電擴廠。", "它成長。", "它獲利。", "其次。"] and [bool(r.error) for r in failed] == [False, True, True, True]


def test_facts_and_traversal(spark):
    columns = "kg_id string, subject string, rel_type string, object string, verb string, confidence int, source_doc_id string, source_svo_chunk_index int, source_sentence_start int, source_sentence_end int"
    rows = [("k", "a", "USES", "b", "uses", 2, "d1", 1, 1, 5), ("k", "a", "USES", "b", "used", 4, "d2", 1, 1, 5), ("k", "b", "CAUSES", "c", "causes", 1, "d1", 2, 4, 8), ("k", "c", "CAUSES", "e", "causes", 1, "d1", 3, 7, 11)]
    facts = graph.merge_facts(spark.createDataFrame(rows, columns))
    edge = {(r.subject, r.object): r for r in graph.latest_citation(facts).collect()}["a", "b"]
    assert len(edge.citations) == 2 and edge.confidence == 4 and edge.last_source_doc_id == "d2"
    seeds = spark.createDataFrame([(" a ",), ("",)], "name string")
    reach = [{(r.subject, r.object) for r in graph.neighbourhood(facts.select("subject", "rel_type", "object"), seeds, h).collect()} for h in (1, 2, 3)]
    assert reach == [{("a", "b")}, {("a", "b"), ("b", "c")}, {("a", "b"), ("b", "c"), ("c", "e")}]
    with pytest.raises(ValueError):
        graph.neighbourhood(facts, seeds, 6)


def test_triples(spark):
    raw = ['```json\n[{"subject": "x", "verb": "v", "object": "y", "rel_type": "CAUSES"}, 3, {"subject": "z"}]\n```', '{"triples": [{"subject": "x", "verb": "v", "object": "y", "rel_type": "NOT_ALLOWED"}]}', "nonsense", None]
    got = graph.parse_triples(spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string")).orderBy("i").collect()
    assert [(r.i, r.rel_type, r.verb, r.subject_type, r.confidence) for r in got] == [(0, "CAUSES", "v", "概念", 1), (1, "RELATED_TO", "v", "概念", 1)]


def test_queue(spark):
    kind = "kg_id string, source string, chunk_index int, status string"
    t = spark.createDataFrame([("k", "s", 1, "completed"), ("k", "s", 2, "processing")], kind)
    t = tasks.enqueue(t, spark.createDataFrame([("k", "s", 1), ("k", "s", 3), ("k", "s", 3)], "kg_id string, source string, chunk_index int"))
    assert sorted((r.chunk_index, r.status) for r in t.collect()) == [(1, "completed"), (2, "processing"), (3, "pending")]
    assert tasks.next_pending(t).first().chunk_index == 3 and tasks.next_pending(tasks.reset_stuck(t), "k").first().chunk_index == 2
    records = spark.createDataFrame([("k", "s", "pending", 0, 9, 3), ("k", "t", "completed", 0, 3, None), ("k", "u", "pending", 3, 3, None)], "kg_id string, source string, extraction_status string, chunk_progress int, total_chunks int, svo_total_chunks int")
    assert sorted(r.chunk_index for r in tasks.rebuild(records).collect()) == [1, 2, 3]
    p = spark.createDataFrame([("s", 5, 0, "pending")], "source string, total_sentences int, normalization_progress int, normalization_status string")
    assert tasks.set_progress(p, spark.createDataFrame([("s", 5)], "source string, progress int")).first().normalization_status == "completed"
    with pytest.raises(Exception, match="out of range"):
        tasks.set_progress(p, spark.createDataFrame([("s", 6)], "source string, progress int")).collect()


def test_figures(spark):
    rows = [("d", 1, "圖1 系統架構圖", "如圖2所示", ""), ("d", 2, "", "如圖2所示", ""), ("d", 3, "圖1", "", "Fig. 7"), ("d", 4, None, None, None)]
    got = figures.number_figures(spark.createDataFrame(rows, "doc_id string, ord int, caption string, full_text string, ocr_text string")).orderBy("ord").collect()
    assert [(r.figure_id, r.id_type, r.match_source) for r in got] == [("圖1", "original", "caption"), ("圖2", "original", "inline_reference"), ("圖7", "original", "printed_number"), ("自補圖-1", "auto", "none")]
    shapes = F.array(*[F.struct(F.lit(t).alias("top"), F.lit(x).alias("left"), F.lit(n).alias("name")) for t, x, n in ((900000, 0, "bottom"), (100000, 500, "right"), (0, 0, "left"))])
    assert [s.name for s in one(spark, figures.reading_order(shapes))] == ["left", "right", "bottom"]


def test_images_are_numbered_after_small_ones_are_dropped(spark):
    kind = "doc_id string, page int, image_id string, y1 double, width double, height double, doc_type string, caption string, full_text string, ocr_text string, ocr_confidence double, graphic double, force boolean"
    rows = [("d", 2, "c", 5.0, 90.0, 90.0, "pptx", "", "", "", 0.0, 0.0, False), ("d", 1, "a", 10.0, 39.0, 90.0, "docx", "圖9", "", "", 0.0, 0.0, False), ("d", 1, "b", 20.0, 40.0, 40.0, "docx", " 圖1 架構 ", "", "flow", 20.0, 10.0, None),
            ("d", 2, "e", 50.0, 90.0, 90.0, "docx", "", "", "plain", 95.0, 0.0, True)]
    images = spark.createDataFrame(rows, kind)
    got = figures.process(images).orderBy("ord").collect()
    assert [(r.image_id, r.figure_id, r.upgraded) for r in got] == [("b", "圖1", False), ("e", "自補圖-1", True), ("c", "自補圖-2", True)]
    assert got[0].block == "[圖片:圖1]\n標題: 圖1 架構\n圖片 OCR 文字（來源: OCR）: flow" and got[2].block == "[圖片:自補圖-2]\n（圖片無可辨識文字內容）"
    seen = figures.process(images, model=lambda df: df.drop("understanding").withColumn("understanding", F.lit("a chart"))).orderBy("ord").collect()
    assert [("a chart" in r.block) for r in seen] == [False, True, True]
    pages = {r.page: r.text for r in figures.page_blocks(figures.process(images)).collect()}
    assert pages[2].startswith("--- [第 2 頁圖片解析] ---\n[圖片:自補圖-1]") and pages[2].count("\n\n") == 1
    pixels = F.array(*[F.array(*[F.lit(float(v)) for v in r]) for r in ((0, 50, 0, 0), (50, 50, 50, 0), (0, 50, 0, 0), (0, 0, 0, 0))])
    assert abs(one(spark, figures.graphic_score(pixels)) - 100 * (0.6 * 5 / 16 + 0.4 * (1 / 4 + 1 / 4) / 2)) < 1e-9


def test_names_resolve_by_ratio_vector_and_answer(spark, monkeypatch):
    def fold(names, vectors, ask=None, edit=0.7):
        known, out = [], {}
        for n in names:
            hit = n if n in known else next((k for k in known if entities.edit_ratio(n, k) >= edit), None)
            if hit is None and vectors:
                cos = lambda a, b: float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))
                scored = [(cos(vectors[n], vectors[k]), k) for k in known]
                best = max(scored, key=lambda x: x[0], default=(0, None))
                if best[0] >= 0.88 or (ask and best[0] >= 0.75 and ask.generate(f"「{n}」和「{best[1]}」") == "是"):
                    hit = best[1]
            if hit is None:
                known.append(n)
            out[n] = hit or n
        return out

    rng = random.Random(2)
    syllables = ["ka", "lo", "mi", "ser", "tan", "vo", "台積", "電", "x"]
    names = list(dict.fromkeys("".join(rng.choice(syllables) for _ in range(rng.randint(1, 6))) for _ in range(150)))
    vectors = {n: np.array([rng.gauss(0, 1) for _ in range(3)]) for n in names}
    rows = [("k", "t", n, i, vectors[n].tolist()) for i, n in enumerate(names)] + [("k", "t", names[0], 999, [0.0] * 3), ("k2", "t", names[5], 0, None), ("k", "t", " ", 3, None), ("k", "t", None, 3, None)]
    mentions = spark.createDataFrame(rows, "kg_id string, entity_type string, name string, ord int, v array<double>")
    get = lambda df: {r.name: r.entity for r in df.where("kg_id = 'k'").collect()}
    plain = fold(names, None)
    assert get(resolution.resolve_names(mentions)) == plain and 5 < sum(k != v for k, v in plain.items()) < len(names) - 20
    assert get(resolution.resolve_names(mentions, vector="v")) == fold(names, vectors)
    monkeypatch.setattr(resolution, "SMALL", 3)  # larger components go by rounds
    assert get(resolution.resolve_names(mentions)) == plain and get(resolution.resolve_names(mentions, vector="v")) == fold(names, vectors)
    model = Yes("ka")
    assert get(resolution.resolve_names(mentions, vector="v", model=model)) == fold(names, vectors, model) != fold(names, vectors)


def test_entities_merge_by_votes(spark):
    kind = "kg_id string, entity string, entity_type string, surface_form string, doc_id string, chunk_index int"
    rows = [("k", "Stone", "人物", f, d, c) for f, d, c in (("Stone", "d1", 1), ("Stone", "d1", 2), ("Richard Stone", "d2", 1), ("Richard Stone", "d3", 1), ("R. Stone", "d1", 3))]
    rows += [("k", "Alone", "概念", "Alone", None, None), ("k", "Tie", "概念", "Eit", "d1", 1), ("k", "Tie", "概念", "Tie", "d1", 1)]
    said = spark.createDataFrame(rows, kind)
    got = {r.entity: r for r in resolution.merge_entities(said).collect()}
    assert (got["Stone"].name, got["Stone"].votes, got["Stone"].aliases) == ("Richard Stone", 2, ["R. Stone", "Richard Stone", "Stone"])
    assert (got["Alone"].name, got["Alone"].votes, got["Alone"].aliases) == ("Alone", 0, []) and got["Tie"].name == "Tie"
    assert resolution.mention_edges(said).count() == 7 and resolution.entities_of(resolution.merge_entities(said), F.lit("k"), F.lit("人物")).count() == 1


def test_registry_can_be_stored_and_gone_on_from(spark):
    rows = [("d", 0, "Stone spoke.", ["Stone"]), ("d", 1, "Richard Stone left.", ["Richard Stone"]), ("d", 2, "Stone returned.", ["Stone"]), ("d", 3, "Stone slept.", ["Stone"]), ("e", 0, "x", None)]
    every = spark.createDataFrame(rows, "doc_id string, sentence_idx int, sentence string, forms array<string>")
    known = entities.registries(every.where("sentence_idx < 2"))
    r = known.first()
    assert known.count() == 1 and (r.position, r.name, r.forms, r.first_seen, r.occurrences) == (0, "Richard Stone", {"Stone": 1, "Richard Stone": 1}, 0, [0, 1])
    rest = entities.resume_registry(every.where("sentence_idx >= 2"), known).orderBy("sentence_idx").collect()
    assert [x.sentence for x in rest] == ["Richard Stone returned.", "Richard Stone slept."]
    asked = entities.apply_registry(spark.createDataFrame([("d", 0, "A spoke.", ["A"]), ("d", 1, "ZZ left.", ["ZZ"]), ("d", 2, "QQ left.", ["QQ"])], every.schema), ask=lambda form, names: names[0] if form == "ZZ" else "NEW")
    assert [x.n_names for x in asked.orderBy("sentence_idx").collect()] == [1, 1, 2]


def test_preparation_extraction_and_assignment(spark):
    sentences = spark.createDataFrame([("s", i, t) for i, t in enumerate(["Stone 來了。", "Richard Stone 說話。", "它很好。", "四。", "五。", "六。"])], "source string, sentence_idx int, sentence string")
    mentions = spark.createDataFrame([("s", 0, ["Stone"]), ("s", 1, ["Richard Stone"])], "source string, sentence_idx int, forms array<string>")
    windows, vectors = preparation.prepare(sentences, lambda s, before, after: s.replace("它", "Stone"), mentions, providers.HashEmbedder(4))
    got = windows.orderBy("chunk_index").collect()
    assert [(w.sentence_start, w.sentence_end) for w in got] == [(1, 5), (4, 6)] and got[0].normalized[2] == "Stone很好。" and got[0].original[2] == "它很好。" and vectors.count() == 6
    records = spark.createDataFrame([("k", "s", 9, None, "pending", 0, None), ("k", "t", 2, None, "pending", 0, None)], "kg_id string, source string, total_chunks int, svo_total_chunks int, extraction_status string, chunk_progress int, document_vector array<double>")
    queue = spark.createDataFrame([], "kg_id string, source string, chunk_index int, status string")
    records, queue = preparation.trigger_extraction(records, windows, queue)
    assert {r.source: r.svo_total_chunks for r in records.collect()} == {"s": 2, "t": None} and sorted(r.chunk_index for r in queue.collect()) == [1, 2]
    kept = tasks.set_vectors(records, spark.createDataFrame([("s", [1.0]), ("z", [2.0])], "source string, vector array<double>"))
    assert {r.source: r.document_vector for r in kept.collect()} == {"s": [1.0], "t": None}
    with pytest.raises(Exception, match="negative"):
        tasks.set_window_total(records, spark.createDataFrame([("s", -1)], "source string, total int")).collect()
    chunks = spark.createDataFrame([(1, "文本"), (2, " "), (3, None)], "i int, text string")
    assert [(t.i, t.subject) for t in preparation.extract_triples(chunks, Triples()).collect()] == [(1, "a")] and preparation.extract_triples(chunks, None).count() == 0
    audited = preparation.audit_pronouns(spark.createDataFrame([("此", "此人來了"), ("人", "此人來了")], "word string, sentence string"), Yes("詞：「此」"))
    assert {r.word: r.accepted for r in audited.collect()} == {"此": True, "人": False}
    assert sorted(r.word for r in preparation.grown_lexicon(spark.createDataFrame([("這",), ("此",)], "word string"), audited).collect()) == ["此", "這"]


class Triples:
    def generate(self, prompt):
        return '{"triples": [{"subject": "a", "verb": "v", "object": "b", "rel_type": "USES"}]}'


def test_pool_analysis(spark):
    rng = np.random.default_rng(3)
    points = [("p", i, (np.array(c) + rng.normal(0, 0.05, 2)).tolist()) for i, c in enumerate([(0, 9)] * 5 + [(9, 0)] * 4 + [(30, -30)])] + [("p", 50, None)]
    rows = spark.createDataFrame(points, "pool string, item int, vector array<double>")
    bodies = spark.createDataFrame([(i, "knowledge graph graph") if i < 5 else (i, "other topic") for i in range(9)], "item int, body string")
    got = sorted(pool.analyze(rows, bodies, model=Named()).collect(), key=lambda r: -len(r.members))
    assert [len(r.members) for r in got] == [5, 4] and got[0].concepts == ["graph", "knowledge"] and got[0].name == "圖譜" and set(got[0].basis) <= set(got[0].members) and got[0].intra_similarity > 0.99
    assert pool.analyze(rows, bodies).first().name == "新知識庫"
    labels = clusters.cluster_pool(rows, "pool", "item")
    assert [r.item for r in pool.unclustered(labels).collect()] == [9, 50]
    prompt = one(spark, pool.naming_prompt(F.array(*[F.lit(f"n{i}") for i in range(12)]), F.array(*[F.lit(f"c{i}") for i in range(25)])))
    assert "- n9" in prompt and "n10" not in prompt and "c19" in prompt and "c20" not in prompt


class Named:
    def generate(self, prompt):
        return "名稱：圖譜\n描述：說明"


def test_stored_tables(spark, tmp_path):
    path = str(tmp_path / "tasks")
    assert tables.read(spark, path, "tasks").count() == 0 and not tables.readable(spark, path, "tasks")
    records = spark.createDataFrame([("k", "s", "pending", 1, 3, None)], "kg_id string, source string, extraction_status string, chunk_progress int, total_chunks int, svo_total_chunks int")
    assert sorted(r.chunk_index for r in tasks.ensure_ready(spark, path, records).collect()) == [2, 3]
    tables.write(spark.createDataFrame([("k", "s", 2, "processing")], tables.SCHEMAS["tasks"]), path, "tasks", None)
    assert [(r.chunk_index, r.status) for r in tasks.ensure_ready(spark, path, records).collect()] == [(2, "pending")]
    where = str(tmp_path / "sentences")
    own = lambda kg, s: spark.createDataFrame([(kg, "x", [s], 1)], tables.SCHEMAS["sentences"])
    tables.write(own("a", "one").union(own("b", "two")), where, "sentences")
    tables.write(own("b", "three"), where, "sentences")
    assert sorted((r.kg_id, r.sentences[0]) for r in tables.read(spark, where, "sentences").collect()) == [("a", "one"), ("b", "three")]
    t = spark.createDataFrame([(1, "a"), (2, "b")], "i int, x string")
    assert sorted(map(tuple, tables.insert(t, spark.createDataFrame([(3, "c")], t.schema), ["i"]).collect())) == [(1, "a"), (2, "b"), (3, "c")]
    with pytest.raises(Exception, match="already there"):
        tables.insert(t, spark.createDataFrame([(2, "c")], t.schema), ["i"]).collect()
    assert [r.x for r in tables.find(tables.update(t, spark.createDataFrame([(2, "z"), (9, "q")], t.schema), ["i"]), i=2).collect()] == ["z"] and tables.delete(t, t.where("i = 1"), ["i"]).count() == 1
    meta = spark.createDataFrame([], "provider string, model string, dim int")
    meta = tasks.check_and_register(meta, "p", "m", 3)
    assert [tuple(r) for r in tasks.check_and_register(meta, "p", "m", 3).collect()] == [("p", "m", 3)]
    with pytest.raises(Exception, match="vectors are from p/m"):
        tasks.check_and_register(meta, "p", "other", 3).collect()


def test_control_marks_and_literal_lexicons(spark):
    parts = one(spark, T.sentences(F.col("t")), t="ab\x01cd. e\x02f。\x03g")
    assert parts == ["ab\x01cd. ", "e\x02f。", "\x03g"]
    assert one(spark, T.has_pronoun(F.lit("a.c"), ("a.c",))) and not one(spark, T.has_pronoun(F.lit("abc"), ("a.c",)))


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("中文".encode("big5"))
    (tmp_path / "b.pdf").write_bytes(b"%PDF")
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(tmp_path / "c.docx", "w") as z:
        cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>head</w:t></w:r></w:p><w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr><w:tr>{cell('x')}{cell('x')}</w:tr></w:tbl></w:body></w:document>")
    (tmp_path / "d.OGG").write_bytes(b"x")
    (tmp_path / "e.avi").write_bytes(b"x")
    (tmp_path / "f.txt").write_bytes(b"x" * (2 << 20))
    a, p = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"', 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
    with zipfile.ZipFile(tmp_path / "g.pptx", "w") as z:
        shape = lambda t, top, left: f'<p:sp><p:spPr><a:xfrm><a:off x="{left}" y="{top}"/></a:xfrm></p:spPr><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>'
        cell = lambda t: f"<a:tc><a:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></a:txBody></a:tc>"
        table = f'<p:graphicFrame><p:xfrm><a:off x="0" y="500000"/></p:xfrm><a:tbl><a:tr>{cell("h")}{cell("i")}</a:tr><a:tr>{cell("1")}{cell("2")}</a:tr></a:tbl></p:graphicFrame>'
        z.writestr("ppt/slides/slide1.xml", f"<p:sld {a} {p}><p:cSld><p:spTree>{shape('last', 900000, 0)}{table}{shape('second', 1000, 700)}{shape('first', 2000, 0)}</p:spTree></p:cSld></p:sld>")
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.error) for r in files.read_files(spark, str(tmp_path), max_mb=1).collect()}
    assert got == {"a.txt": ("中文", None), "b.pdf": (None, "no parser for pdf"), "c.docx": ("head\n\n| a | b |\n| --- | --- |\n| x |  |", None), "d.OGG": (None, "no parser for media"), "e.avi": (None, "no parser for unsupported"),
                   "f.txt": (None, "larger than 1 MB"), "g.pptx": ("--- [Slide 1] ---\nfirst\nsecond\n| h | i |\n| --- | --- |\n| 1 | 2 |\nlast", None)}


def test_pages(spark):
    html = "<html><nav>menu</nav><article><h1>T &amp; U</h1><script>x</script><p>a\n b</p><!-- c --></article></html>"
    assert one(spark, web.main_text(F.lit(html))) == "T & U a b"
    linked = "<body><article><p>See <a class='x' href='https://x.org/a?b=1'>this <b>page</b></a>.</p><table><tr><th>h</th><th>i</th></tr><tr><td>1</td><td>2 &lt; 3</td></tr></table><p>end</p></article></body>"
    assert one(spark, web.main_markdown(F.lit(linked))) == "See [this page](https://x.org/a?b=1).\n| h | i |\n| 1 | 2 < 3 |\nend"
    assert one(spark, web.main_markdown(F.lit("<article> </article><p>outside</p>"))) == "outside"


class Broken:
    def generate(self, prompt):
        raise ValueError("no")


class Capitals:
    def tag(self, sentence):
        return [(w, "X") for w in sentence.split()]


class Yes:
    """Says yes to prompts that hold its word."""

    def __init__(self, word):
        self.word = word

    def generate(self, prompt):
        return "是" if self.word in prompt else "否"


def test_providers(spark):
    rows = spark.createDataFrame([("a b",), (None,), ("b a",)], "t string")
    got = [r.vector for r in providers.embed(rows, "t", providers.HashEmbedder(8)).collect()]
    assert got[1] is None and got[0] == got[2] and abs(sum(x * x for x in got[0]) - 1) < 1e-9
    assert [(r.reply, r.reply_error) for r in providers.generate(rows, "t", providers.Echo()).collect()] == [("a b", None), (None, None), ("b a", None)]
    assert [r.reply_error for r in providers.generate(rows, "t", Broken()).collect()] == ["ValueError: no", None, "ValueError: no"]
    assert providers.create("hash", dim=3).dim == 3 and providers.generate_json(providers.Echo(), '```json\n[1]\n```') == "[1]"
    for wrong in (lambda: providers.create("none"), lambda: providers.generate_json(providers.Echo(), "no json")):
        with pytest.raises((ValueError, providers.ModelError)):
            wrong()
    assert [[tuple(x) for x in r.tagged] for r in providers.tag(rows, "t", Capitals()).collect()] == [[("a", "X"), ("b", "X")], [], [("b", "X"), ("a", "X")]]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("One. Two.")
    streams.run_available(streams.chunk_stream(streams.text_stream(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    assert [r.chunk for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["One. Two."]


def test_staging(spark):
    from docweave.operators import staging

    docs = spark.createDataFrame([("a.txt", "第一句。" * 200), ("", "x"), ("b", " ")], "source string, text string")
    staged = staging.stage(docs)
    got = {r.source: r for r in staged.collect()}
    assert got[""].error == "source is blank" and got["b"].error == "no chunks" and got["a.txt"].total_chunks > 1
    rows = staging.chunk_rows(staged).orderBy("chunk_index").collect()
    assert rows[0].filename == "chunk-001-of-002.md" and rows[0].file.startswith('---\nsource: "a.txt"\nchunk_index: 1\ntotal_chunks: 2\n---\n\n第一句。')
    pairs = spark.createDataFrame([("s", [f"o{i}" for i in range(6)], [f"n{i}" for i in range(6)])], "source string, sentences array<string>, normalized array<string>")
    w = staging.extraction_windows(pairs).orderBy("chunk_index").collect()
    assert [(r.sentence_start, r.sentence_end, r.original[0], r.normalized[-1]) for r in w] == [(1, 5, "o0", "n4"), (4, 6, "o3", "n5")]
    with pytest.raises(Exception, match="differ in number"):
        staging.extraction_windows(pairs.withColumn("normalized", F.array(F.lit("x")))).collect()
    with pytest.raises(Exception, match="unknown relation"):
        spark.range(1).select(staging.strict_relation(F.lit("NOT_ALLOWED"))).collect()
    staging.create_collection(spark, "kg_a")
    assert staging.list_collections(spark) == ["kg_a"]
    staging.drop_collection(spark, "kg_a")
    assert staging.list_collections(spark) == []
