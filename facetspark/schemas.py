"""Explicit schemas of the engine's tables; nothing is inferred."""

from __future__ import annotations

VALUATION = (
    "id long, image_hash string, url string, image_format string, width int, height int, channels int, size_bytes long, undecodable_pixels long, "
    "min_value double, max_value double, currency string, standard_name string, standard_version string, llm_model string, description string, "
    "notes array<string>, tool_used boolean, tool_fallback boolean, input_tokens int, output_tokens int, valued_at string, raw_llm_text string"
)
IMAGE_IMPORT = "id long, source_path string, hash string, status string, qdrant_point_id string, text_description string, description_model string, error string, imported_at string, processed_at string"
VECTOR_POINT = "id long, text_vec array<float>, visual_vec array<float>, payload struct<source_path:string,hash:string,description:string>"
SIZE_RULES = "array<struct<min_width:int,max_width:int,min_height:int,max_height:int,multiplier:double>>"
STANDARD = f"name string, description string, version string, currency string, max_value double, image_formats array<string>, tags array<string>, size_correction {SIZE_RULES}, body string, content_hash string, source string, file_path string"
EXIF = "make string, model string, software string, taken string, exposure double, aperture double, iso int, focal_length double, lens string, orientation int, width int, height int, gps struct<latitude:double,longitude:double>"
#: Fixed values.
STATUSES = ["pending", "processing", "embedded", "indexed", "failed"]
IMAGE_FORMATS = ["jpeg", "png", "webp"]
TABLES = {"valuation": VALUATION, "image_import": IMAGE_IMPORT, "vector_point": VECTOR_POINT}
