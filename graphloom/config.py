"""Constants that define the engine's semantics, and its dimension rows."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

# Sizes, limits and floors whose results depend on them.
CHUNK_SIZE, CHUNK_OVERLAP, MIN_CHUNK_WORDS = 512, 100, 80
TOP_VECTOR, TOP_BM25, TOP_COMMUNITY, TOP_KEYWORD, TOP_CODE = 5, 4, 2, 8, 3
VECTOR_FLOOR, SEARCH_FLOOR, HOPS, MAX_ROOTS = 0.35, 0.3, 2, 6
CONTEXT_CHARS, GRAPH_SHARE, RELS_SHARE = 12000, 0.45, 0.60
TEXT_CLIP, DESCRIPTION_CLIP, MAX_ENTITIES, MAX_SNIPPETS = 1200, 200, 8, 5
COMMUNITY_MIN, COMMUNITY_RESOLUTION, MEMBERS_STORED = 3, 1.0, 50
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25

# Node types by how much they matter in a context.
NODE_PRIORITY = {"Warning": 1.00, "Requirement": 0.97, "Defect": 0.90, "Step": 0.87, "Component": 0.80, "System": 0.75, "Measurement": 0.72, "Tool": 0.65, "Chunk": 0.50, "Community": 0.60}
DEFAULT_PRIORITY = 0.5

# Labels that keep their type; any other type is an Entity.
NODE_LABELS = ["Component", "System", "Tool", "Warning", "Step", "Requirement", "Measurement"]
PROJECTION_EXCLUDES = ["Chunk", "DocumentSection", "Measurement"]
REQUIREMENT_CODES = {"AIRWORTHINESS_LIMITATION": "AWL", "INSPECTION": "INSP", "OPERATIONAL_LIMITATION": "OPS", "PROCEDURE": "PROC", "CERTIFICATION": "CERT"}

# Chapter names of the maintenance standard.
CHAPTERS = {
    "00": "General", "05": "Time Limits", "06": "Dimensions", "07": "Lifting / Shoring", "08": "Levelling", "09": "Towing", "10": "Parking", "11": "Placards", "12": "Servicing",
    "20": "Standard Practices", "21": "Air Conditioning", "22": "Auto Flight", "23": "Communications", "24": "Electrical Power", "25": "Equipment", "26": "Fire Protection",
    "27": "Flight Controls", "28": "Fuel", "29": "Hydraulic", "30": "Ice Protection", "31": "Instruments", "32": "Landing Gear", "33": "Lights", "34": "Navigation", "35": "Oxygen",
    "36": "Pneumatic", "51": "Structures", "52": "Doors", "53": "Fuselage", "54": "Nacelles", "55": "Stabilisers", "56": "Windows", "57": "Wings", "61": "Propeller", "71": "Power Plant",
    "72": "Engine", "73": "Engine Fuel", "74": "Ignition", "75": "Air", "76": "Engine Controls", "77": "Engine Indicating", "78": "Exhaust", "79": "Oil", "80": "Starting",
}


@dataclass
class Settings:
    """Tunable settings, each overridable by the session's graphloom.<name>."""

    encoder_dim: int = 384  # of the hashed encoder
    score_mode: str = "raw"  # or unit: cosines as 0..1
    hops: int = HOPS  # of the graph's part of a context

    @classmethod
    def of(cls, spark: SparkSession) -> Settings:
        given = {f.name: spark.conf.get(f"graphloom.{f.name}", None) for f in fields(cls)}
        return cls(**{k: type(getattr(cls, k))(v) for k, v in given.items() if v is not None})
