"""Declared schemas and the fixed vocabulary of the catalog pipeline.

Every reader names its schema from here; nothing is ever inferred.
"""

from __future__ import annotations

# Stage names in pipeline order.
STAGES = ["concept", "assets", "postprocess", "package", "listing", "review"]

# The artifact each stage produces.
STAGE_OUTPUT = {
    "concept": "concept",
    "assets": "assets",
    "postprocess": "processed",
    "package": "packages",
    "listing": "listings",
    "review": "review",
}

# The artifacts each stage reads, in declared order.
STAGE_INPUTS = {
    "concept": [],
    "assets": ["concept"],
    "postprocess": ["assets"],
    "package": ["concept", "assets"],
    "listing": ["concept", "packages"],
    "review": ["concept", "assets", "packages", "listings"],
}

# Allowed enum members.
NODE_STATUSES = ["pending", "running", "done", "failed"]
SEVERITIES = ["error", "warning"]
VERDICTS = ["pass", "fail"]

# Defaults of a product request and of a pack profile.
DEFAULT_PAGE_COUNT = 30
DEFAULT_LANGUAGES = ["en", "es"]
DEFAULT_FORMATS = ["digital", "print"]
DEFAULT_IMAGE_SIZE = "1024x1024"

# Optional files next to a pack profile.
PACK_AUX_FILES = ["style", "themes", "packaging", "listing", "quality"]


# The columns below and their types are the contract with callers and stored tables.
REQUEST_TEXT = (
    "product_id string, pack string, theme string, page_count int, languages string, "
    "formats string, title_hint string, force boolean"
)

REQUEST = (
    "product_id string, pack string, theme string, page_count int, languages array<string>, "
    "formats array<string>, title_hint string"
)

PACK = (
    "id string, schema_version int, pack_version int, pack_type string, default_language string, "
    "languages array<string>, "
    "formats struct<digital:struct<marketplaces:array<string>>,print:struct<marketplaces:array<string>>>, "
    "page_count int, image_size string, "
    "style variant, themes variant, packaging variant, listing variant, quality variant"
)

ENVELOPE = "schema_version int, artifact variant, provenance variant"

NODE = (
    "struct<name:string,status:string,input_hash:string,output_path:string,cost:double,"
    "error:string,created_at:string,updated_at:string>"
)

STATE = (
    f"product_id string, pack_id string, pack_version int, request variant, nodes map<string,{NODE}>"
)

NODE_STATE = (
    "product_id string, stage string, status string, input_hash string, output_path string, "
    "cost double, error string, created_at timestamp, updated_at timestamp"
)

NODE_RUNS = (
    "product_id string, stage string, run int, status string, input_hash string, output_path string, "
    "cost double, error string, started boolean, ts timestamp"
)

COMPLETION = ["content", "raw", "call_error"]

ISSUE_COLUMNS = ["criterion", "severity", "detail"]

LISTING_COLUMNS = ["marketplace", "language", "title", "description", "tags", "price", "category"]
