"""Entities across documents as distributed joins: resolution of names, mention edges, merges, facts between entities.

Names are taken in order of their first appearance; each resolves to an entity that is known by then, or becomes one:
the first known name with an edit ratio of at least `edit`, else the known name with the largest cosine if that reaches `same`, else the
one a model confirms if the cosine reaches `ask`. The order makes names depend on earlier ones only; so all names whose earlier
relatives are decided are decided at once, in as many rounds as the longest such chain. Without a model, names of components of few pairs are
settled first, each component by one fold.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave import providers
from docweave.config import DEFAULTS
from docweave.lineage import cut
from docweave.operators import graph
from docweave.operators.components import components
from docweave.operators.entities import edit_ratios
from docweave.operators.similarity import pairs_within

BLOCK = ["kg_id", "entity_type"]
#: Pairs of a component that is settled by one fold.
SMALL = 20_000
ASK = "「{}」和「{}」指的是不是同一個對象？請回答「是」或「否」。"


def entities_of(entities: DataFrame, kg_id: Column, entity_type: Column) -> DataFrame:
    """The known entities of a collection and type."""
    return entities.where((F.col("kg_id") == kg_id) & (F.col("entity_type") == entity_type))


def _characters(name: Column) -> Column:
    """The characters of a name, each with the number of its occurrence, so that common characters can be counted as common elements."""
    every = F.split(name, "")
    return F.filter(F.transform(every, lambda c, i: F.concat(c, F.size(F.filter(F.slice(every, F.lit(1), i + 1), lambda x: x == c)).cast("string"))), lambda t: F.length(t) > 1)


def edit_pairs(names: DataFrame, threshold: float) -> DataFrame:
    """kg_id, entity_type, name, other, other_ord, ratio: earlier names of the block with an edit ratio of at least threshold.

    The ratio is twice the matched characters over both lengths, so a name must share threshold / (2 - threshold) of its characters with any
    partner. Ordered by rarity, the first characters of two such names, all but that share, have one in common: only names
    that do are brought together, and only those whose common characters suffice are compared.
    """
    listed = names.select(*BLOCK, "name", "ord", _characters(F.col("name")).alias("chars")).where(F.size("chars") > 0)
    each = listed.select(*BLOCK, "name", F.explode("chars").alias("c"))
    rarity = each.groupBy("c").agg(F.count("*").alias("n"))
    ranked = each.join(rarity, "c").groupBy(*BLOCK, "name").agg(F.sort_array(F.collect_list(F.struct("n", "c"))).alias("r"))
    need = F.ceil(F.size("r") * (threshold / (2 - threshold)) - 1e-9).cast("int")
    first = cut(ranked.select(*BLOCK, "name", F.explode(F.slice("r", F.lit(1), F.size("r") - need + 1)["c"]).alias("c")).join(listed, [*BLOCK, "name"]), "names")
    b = first.select(*BLOCK, "c", F.col("name").alias("other"), F.col("ord").alias("other_ord"), F.col("chars").alias("other_chars"))
    earlier = (F.col("other_ord") < F.col("ord")) | ((F.col("other_ord") == F.col("ord")) & (F.col("other") < F.col("name")))
    enough = 2 * F.size(F.array_intersect("chars", "other_chars")) >= threshold * (F.size("chars") + F.size("other_chars")) - 1e-9
    met = first.join(b, [*BLOCK, "c"]).where(earlier & enough).select(*BLOCK, "name", "other", "other_ord").distinct()
    return edit_ratios(met, "name", "other").where(F.col("ratio") >= threshold)


def cosine_pairs(names: DataFrame, least: float) -> DataFrame:
    """kg_id, entity_type, name, other, other_ord, cosine: earlier names of the block whose vectors have a cosine of at least `least` (above 0). See similarity.pairs_within()."""
    return pairs_within(names, BLOCK, least)


def best_candidates(scored: DataFrame, keys: list[str], item: str, order: str, score: str = "score") -> DataFrame:
    """The item with the largest score above 0 for each key, the first in order of equals."""
    found = scored.where(F.col(score) > 0).groupBy(*keys).agg(F.max(F.struct(F.col(score).alias("s"), (-F.col(order)).alias("o"), F.col(item).alias("i"))).alias("m"))
    return found.select(*keys, F.col("m.i").alias(item), F.col("m.s").alias(score))


def resolve_names(mentions: DataFrame, order: str = "ord", edit: float = DEFAULTS.edit_ratio, same: float = DEFAULTS.same_cosine, ask: float = DEFAULTS.ask_cosine,
                  vector: str | None = None, model: providers.LanguageModel | None = None) -> DataFrame:
    """kg_id, entity_type, name and entity of each distinct name; blank and null names are left out.

    vector: a column with the names' vectors (of repeated names the first in order counts); without it no cosines are compared. Without a
    model nothing between ask and same is merged. An edit threshold above 1 leaves only equal names.
    """
    named = mentions.where(F.trim("name") != "")
    first = F.min(F.struct(F.col(order).alias("o"), F.col(vector).alias("v") if vector else F.lit(None).cast("array<double>").alias("v"))).alias("f")
    names = cut(named.groupBy(*BLOCK, "name").agg(first).select(*BLOCK, "name", F.col("f.o").alias("ord"), F.col("f.v").alias("vector")), "names")
    schema = [*BLOCK, "name", "ord", "other", "other_ord"]
    close = edit_pairs(names, edit) if edit <= 1 else names.select(*BLOCK, "name", F.col("name").alias("other"), F.col("ord").alias("other_ord")).limit(0)
    ords = names.select(*BLOCK, "name", "ord")
    by_edit = close.join(ords, [*BLOCK, "name"]).select(*schema, F.lit(2).alias("kind"), F.lit(0.0).alias("cosine"))
    pairs = by_edit
    if vector:
        # kinds: 2 by edit ratio, 1 by a cosine that decides, 0 by one that needs an answer
        pairs = by_edit.union(cosine_pairs(names, ask if model else same).join(ords, [*BLOCK, "name"]).select(*schema, (F.col("cosine") >= same).cast("int").alias("kind"), "cosine"))
    pairs = cut(pairs, "pairs")
    own = [*BLOCK, "name"]
    settled = None
    if model is None and not pairs.isEmpty():
        settled, pairs = _settle_small(pairs)
    known = cut(names.select(*own).join(pairs.select(*own).distinct(), own, "left_anti"), "known")
    open_, asked = pairs, None
    while not open_.isEmpty():
        with_known = open_.join(known.withColumn("k", F.lit(True)), (open_["other"] == known["name"]) & (open_["kg_id"].eqNullSafe(known["kg_id"])) & (open_["entity_type"].eqNullSafe(known["entity_type"])), "left")
        state = with_known.select(*[open_[c] for c in open_.columns], F.coalesce("k", F.lit(False)).alias("k"))
        merged = state.where("k and kind > 0").select(*own).distinct()
        # names that wait for nobody any more: all their open pairs are with known names and need an answer
        waits = state.groupBy(*own).agg(F.min("k").alias("ready"), F.max("kind").alias("kind")).where("ready and kind = 0").select(*own)
        if model and not waits.isEmpty():
            best = best_candidates(state.join(waits, own), own, "other", "other_ord", "cosine")
            prompts = best.withColumn("prompt", F.format_string(ASK.replace("{}", "%s"), "name", "other"))
            answers = cut(providers.generate(prompts, "prompt", model).select(*own, "other", F.coalesce(F.trim("reply").startswith("是"), F.lit(False)).alias("yes")), "answers")
            asked = answers.where("yes") if asked is None else asked.union(answers.where("yes"))
            merged = merged.union(answers.where("yes").select(*own))
            waits = waits.join(answers.where("yes"), own, "left_anti")
        merged = cut(merged, "merged")
        decided = merged.union(waits)
        rest = state.drop("k").join(decided, own, "left_anti").join(merged.select(*BLOCK, F.col("name").alias("other")), [*BLOCK, "other"], "left_anti").select(*open_.columns)
        left = cut(rest, "open")
        free = open_.select(*own).distinct().join(merged, own, "left_anti").join(left.select(*own), own, "left_anti")
        known = cut(known.union(free), "known")
        open_ = left
    hits = pairs.where("kind > 0").join(known.select(*BLOCK, F.col("name").alias("other")), [*BLOCK, "other"], "left_semi").join(known, own, "left_anti")
    # by edit ratio the first of them; by cosine the nearest, the first of equals
    pick = F.max(F.struct("kind", F.when(F.col("kind") == 1, F.col("cosine")).otherwise(0.0).alias("c"), (-F.col("other_ord")).alias("o"), F.col("other").alias("entity"))).alias("m")
    chosen = hits.where("kind = 2").groupBy(*own).agg(F.min(F.struct("other_ord", F.col("other").alias("entity"))).alias("m")).select(*own, "m.entity")
    near = hits.where("kind = 1").join(chosen, own, "left_anti").groupBy(*own).agg(pick).select(*own, "m.entity")
    chosen = chosen.union(near)
    if settled is not None:
        chosen = chosen.union(settled)
    if asked is not None:
        chosen = chosen.union(asked.select(*own, F.col("other").alias("entity")).join(chosen, own, "left_anti"))
    return names.select(*own).join(chosen, own, "left").select(*own, F.coalesce("entity", "name").alias("entity"))


def _settle_small(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """kg_id, entity_type, name and entity of the names that merge within components of at most SMALL pairs, and the pairs of larger components.

    Nothing outside a component bears on its names, so that each of the small ones is one ordered fold, streamed with those that share its partition: a chain of names
    of any length up to there takes no rounds.
    """
    spec = {c: pairs.schema[c].dataType.simpleString() for c in [*BLOCK, "name", "other_ord"]}
    node = lambda c: F.struct(*BLOCK, F.col(c).alias("name"))
    roots = components(pairs.select(node("name").alias("a"), node("other").alias("b"))).select("node", "root")
    placed = cut(pairs.withColumn("node", node("name")).join(roots, "node").drop("node"), "placed")
    sizes = placed.groupBy("root").agg(F.count("*").alias("n"))
    sized = placed.join(sizes, "root")
    rows = sized.where(F.col("n") <= SMALL).select(F.xxhash64("root").alias("h"), *BLOCK, "name", "ord", "other", "other_ord", "kind", "cosine")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, merged, at, found = None, set(), None, []

        def decided() -> list[tuple]:
            """The entity of the name whose pairs are in `found`, if any of its partners is one."""
            open_ = [f for f in found if (at[0], at[1], f[0]) not in merged]
            close = [(o, x) for x, o, kind, _ in open_ if kind == 2]
            near = [(c, -o, x) for x, o, kind, c in open_ if kind == 1]
            if not close and not near:
                return []
            merged.add(at)
            return [(*at, min(close)[1] if close else max(near)[2])]

        for f in frames:
            out = []
            for h, kg, kind_, name, _, other, other_ord, kind, cosine in f.itertuples(index=False):
                if at is not None and (kg, kind_, name) != at:
                    out += decided()
                    found = []
                if h != now:
                    now, merged = h, set()
                at = (kg, kind_, name)
                found.append((other, other_ord, kind, cosine))
            yield pd.DataFrame({c: pd.Series([r[i] for r in out], dtype=object) for i, c in enumerate([*BLOCK, "name", "entity"])})
        if at is not None:
            yield pd.DataFrame({c: pd.Series([r[i] for r in decided()], dtype=object) for i, c in enumerate([*BLOCK, "name", "entity"])})

    ordered = rows.repartition("h").sortWithinPartitions("h", "ord", "name", *BLOCK, "other_ord", "other")
    done = ordered.mapInPandas(run, f"kg_id {spec['kg_id']}, entity_type {spec['entity_type']}, name {spec['name']}, entity {spec['name']}")
    return cut(done, "settled"), cut(sized.where(F.col("n") > SMALL).select(*pairs.columns), "pairs")


def mention_edges(mentions: DataFrame) -> DataFrame:
    """The edges from chunks to entities, each once: kg_id, doc_id, chunk_index, entity, surface_form. A mention without a document or chunk makes none."""
    return mentions.where(F.col("doc_id").isNotNull() & F.col("chunk_index").isNotNull()).select("kg_id", "doc_id", "chunk_index", "entity", "surface_form").distinct()


def chunk_entities(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Each edge with the name, type and aliases of its entity."""
    return edges.join(entities.select("kg_id", "entity", "name", "entity_type", "aliases"), ["kg_id", "entity"])


def merge_entities(mentions: DataFrame) -> DataFrame:
    """A row for each (kg_id, entity): entity_type (of its first mention by document and chunk), name, votes, aliases (distinct forms, sorted).

    The name is the form most documents use, of equals the longest; the entity's own name keeps its place against equals, and then the
    first in code-point order. An entity that only mentions without a document or chunk speak of keeps its name and has no aliases.
    """
    edges = mention_edges(mentions)
    votes = edges.groupBy("kg_id", "entity", "surface_form").agg(F.countDistinct("doc_id").alias("votes"))
    by = F.struct("votes", F.length("surface_form").alias("n"), (F.col("surface_form") == F.col("entity")).alias("own"))
    best = Window.partitionBy("kg_id", "entity").orderBy(F.desc(by), "surface_form")
    # the entity's own name takes part even if nobody wrote it
    bare = mentions.select("kg_id", "entity").distinct().select("kg_id", "entity", F.col("entity").alias("surface_form"), F.lit(0).cast("long").alias("votes"))
    every = votes.unionByName(bare).groupBy("kg_id", "entity", "surface_form").agg(F.max("votes").alias("votes"))
    named = every.withColumn("r", F.row_number().over(best)).where("r = 1").select("kg_id", "entity", F.col("surface_form").alias("name"), "votes")
    aliases = votes.groupBy("kg_id", "entity").agg(F.sort_array(F.collect_set("surface_form")).alias("aliases"))
    kinds = mentions.groupBy("kg_id", "entity").agg(F.min_by("entity_type", F.struct(F.col("doc_id").isNull(), "doc_id", "chunk_index", "entity_type")).alias("entity_type"))
    return named.join(kinds, ["kg_id", "entity"]).join(aliases, ["kg_id", "entity"], "left").select("kg_id", "entity", "entity_type", "name", "votes", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))


def merge_facts_resolved(triples: DataFrame, entities: DataFrame, resolved: DataFrame) -> DataFrame:
    """Facts between entities: subjects and objects are looked up by (kg_id, type, name) in resolved and then named as in entities;
    triples that then are equal make one edge, see graph.fact_edges()."""
    names = resolved.join(entities.select("kg_id", "entity", F.col("name").alias("final")), ["kg_id", "entity"]).select("kg_id", "entity_type", "name", "final")
    out = triples
    for side in ("subject", "object"):
        own = names.select("kg_id", F.col("entity_type").alias(f"{side}_type"), F.col("name").alias(side), F.col("final").alias(f"{side}_name"))
        out = out.join(own, ["kg_id", f"{side}_type", side])
    return graph.fact_edges(out.drop("subject", "object").withColumnsRenamed({"subject_name": "subject", "object_name": "object"}))
