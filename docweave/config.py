"""Defaults of the pipeline, as fixed values."""

from __future__ import annotations

from dataclasses import dataclass

#: Closed vocabulary of relations between entities (fixed values).
RELATIONS = (
    "IS_A", "PART_OF", "CONTAINS", "INSTANCE_OF",
    "CAUSES", "PREVENTS", "ENABLES", "IMPROVES", "INHIBITS",
    "USES", "REQUIRES", "PRODUCES", "IMPLEMENTS", "REPLACES", "EXTENDS",
    "CONTRASTS", "SIMILAR_TO", "OUTPERFORMS",
    "DEFINED_AS", "HAS_PROPERTY", "MEASURED_BY", "APPLIES_TO",
    "PRECEDES", "FOLLOWS", "CO_OCCURS",
    "INPUTS", "TRANSFORMS",
    "CREATED_BY", "SOLVES",
    "RELATED_TO",
)
FALLBACK_RELATION = "RELATED_TO"
DEFAULT_ENTITY_TYPE = "概念"

#: Pronouns looked for in sentences (fixed values).
PRONOUNS = ("他", "她", "它", "其", "該", "這家", "這名", "那名", "前者", "後者", "上述", "他們", "她們", "它們")

#: Labels of a named-entity tagger and what they are called here (fixed values).
ENTITY_LABELS = {"PERSON": "人物", "ORG": "組織", "GPE": "地點", "LOC": "地點", "FAC": "地點"}

#: Base score of an image by the kind of its document (fixed values).
IMAGE_BASE_SCORES = {"pptx": 90.0, "pdf_scanned": 55.0, "pdf_native": 25.0, "docx": 25.0}


@dataclass(frozen=True)
class Settings:
    chunk_size: int = 500
    chunk_overlap: int = 50
    window_sentences: int = 5
    window_overlap: int = 2
    context_before: int = 4
    context_after: int = 2
    min_score: float = 0.05
    auto_score: float = 0.30
    cluster_min_size: int = 3
    reduce_from: int = 20
    reduce_to: int = 5
    edit_ratio: float = 0.70
    same_cosine: float = 0.88
    ask_cosine: float = 0.75
    route_kgs: int = 5
    coarse_top_k: int = 100
    max_upload_mb: int = 50
    max_hops: int = 5


DEFAULTS = Settings()
