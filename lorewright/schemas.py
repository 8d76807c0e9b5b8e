"""Schemas of the engine's tables, and its fixed settings.

A knowledge base is a set of tables keyed by video_name; ordinals (seg_ord, node_ord, arrival, ...) state the order in which
rows came, by which ties are decided.
"""

from __future__ import annotations

from dataclasses import dataclass, field

SEP = "<SEP>"
TUPLE, RECORD, COMPLETE = "<|>", "##", "<|COMPLETE|>"

SEGMENTS = "video_name string, seg_ord int, segment_idx string, time string, content string, transcript string, frame_times array<double>"
FRAMES = (
    "video_name string, frame_key string, frame_path string, segment_idx string, segment_name string, frame_idx int, game string, "
    "entities array<string>, transcript string, vlm_output string, main_champ string, partners array<string>"
)
VIDEO_PATHS = "video_name string, path string"
CHUNKS = "video_name string, chunk_id string, chunk_ord int, tokens bigint, content string, chunk_order_index bigint, video_segment_id array<string>, sanitized boolean"
NODES = "video_name string, node_ord bigint, id string, entity_type string, description string, source_id string"
EDGES = "video_name string, edge_ord bigint, src string, dst string, weight double, description string, source_id string, `order` bigint"
VECTORS = "video_name string, namespace string, id string, entity_name string, vector array<float>"
HITS = (
    "query_id string, branch_ord int, arrival bigint, video_name string, chunk_id string, source string, chunk_text string, "
    "segment_ids array<string>, score_semantic double, score_entity double, score_graph double, final_score double"
)
QUARANTINE = "video_name string, stage string, key string, reason string, value string"
CACHE = "hash string, return string, model string"
COMMUNITIES = "level int, cluster string, title string, nodes array<string>, edges array<array<string>>, chunk_ids array<string>, occurrence double, sub_communities array<string>"
EVALUATION = "question string, answer_gold string, context string, rag_answer string, strong_llm_answer string, weak_llm_answer string"

#: Files that make a directory of artefacts complete. Fixed values.
REQUIRED_EXTRACTION = ("kv_store_video_segments.json", "kv_store_video_frames.json", "kv_store_video_path.json")
REQUIRED_BUILD = ("kv_store_text_chunks.json", *REQUIRED_EXTRACTION, "graph_chunk_entity_relation.graphml", "graph_chunk_entity_relation_clean.graphml")
ALLOWED_TYPES = ("PERSON", "GEO", "EVENT", "ORGANIZATION", "UNKNOWN")
EXTRACTED_TYPES = ("ORGANIZATION", "PERSON", "GEO", "EVENT")


@dataclass(frozen=True)
class Profile:
    """How a kind of video is described: a name, how its frames are parsed, and what a prompt may mention."""

    name: str
    parser: str = "generic"
    context_fields: tuple[str, ...] = ()


@dataclass(frozen=True)
class Settings:
    """Depths, weights and budgets of the read path. Fixed values."""

    chunks_k: int = 30
    entities_k: int = 20
    graph_k: int = 30
    frames_k: int = 6
    final_k: int = 14
    weights: dict[str, float] = field(default_factory=lambda: {"semantic": 0.50, "entity": 0.20, "graph": 0.20, "diversity": 0.10})
    context_tokens: int = 10000
    min_evidence: float = 0.18
    min_supported: float = 0.45
    per_video: int = 4
    per_video_cross: int = 3
    verify: bool = False
