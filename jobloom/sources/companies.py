"""Company lists: landed batches of an accelerator's directory, and a curated list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.functions.text import has_ai_tag, truthy
from jobloom.schemas import COMPANIES

# The batches that are read.
BATCHES = (
    "winter-2023", "summer-2023", "winter-2024", "summer-2024", "winter-2025", "spring-2025", "summer-2025", "fall-2025",
    "winter-2026", "spring-2026",
)
BATCH_SCHEMA = (
    "id bigint, name string, slug string, website string, small_logo_thumb_url string, logo_url string, one_liner string, "
    "long_description string, batch string, tags array<string>"
)
# The curated companies: slug, name, website, careers page, description.
CURATED = (
    ("astrocade", "Astrocade", "https://astrocade.com", "https://jobs.ashbyhq.com/astrocade", "Social Gaming Universe — AI-powered game creation platform."),
    ("anthropic", "Anthropic", "https://anthropic.com", "https://boards.greenhouse.io/anthropic", "AI safety and research company building Claude, a reliable and steerable AI assistant."),
    ("mistral", "Mistral AI", "https://mistral.ai", "https://jobs.lever.co/mistral", "Building frontier AI models with a focus on efficiency and open innovation."),
    ("cohere", "Cohere", "https://cohere.com", "https://jobs.ashbyhq.com/cohere", "Enterprise AI platform providing language models and retrieval-augmented generation."),
    ("perplexity", "Perplexity AI", "https://perplexity.ai", "https://jobs.ashbyhq.com/Perplexity", "AI-powered answer engine providing accurate, real-time information with citations."),
    ("elevenlabs", "ElevenLabs", "https://elevenlabs.io", "https://jobs.ashbyhq.com/elevenlabs", "AI voice technology platform for natural-sounding text-to-speech and voice cloning."),
    ("runway", "Runway", "https://runwayml.com", "https://jobs.ashbyhq.com/runway", "AI-powered creative tools for video generation, editing, and multimodal content."),
    ("together", "Together AI", "https://together.ai", "https://jobs.ashbyhq.com/together", "Cloud platform for building and deploying generative AI models at scale."),
    ("modal", "Modal", "https://modal.com", "https://jobs.ashbyhq.com/modal", "Serverless platform for running AI workloads and compute-intensive tasks."),
    ("replicate", "Replicate", "https://replicate.com", "https://jobs.ashbyhq.com/replicate", "Platform for running and deploying machine learning models with simple APIs."),
    ("glean", "Glean", "https://glean.com", "https://jobs.ashbyhq.com/glean", "Enterprise AI search platform connecting and understanding company knowledge."),
    ("character-ai", "Character.AI", "https://character.ai", "https://jobs.ashbyhq.com/character", "Platform for creating and conversing with AI-powered characters and assistants."),
)


def read_batches(spark: SparkSession, folder: str, batches: tuple[str, ...] = BATCHES) -> DataFrame:
    """Landed batches `<folder>/<batch>.json`, each a JSON array; those that are not there are left out."""
    rows = spark.read.schema(BATCH_SCHEMA).option("multiLine", True).option("ignoreMissingFiles", True)
    return rows.option("pathGlobFilter", "{" + ",".join(f"{b}.json" for b in batches) + "}").json(folder)


def ai_companies(rows: DataFrame, now_ms: int) -> DataFrame:
    """Companies of a batch that carry one of the tags, as rows of companies."""
    kept = rows.filter(has_ai_tag(F.col("tags")))
    own = {
        "id": F.col("slug"), "slug": F.col("slug"), "name": F.col("name"), "yc_batch": F.col("batch"), "website": F.col("website"),
        "logo_url": F.coalesce(truthy(F.col("small_logo_thumb_url")), truthy(F.col("logo_url"))),
        "description": F.coalesce(truthy(F.col("one_liner")), truthy(F.col("long_description"))), "created_at": F.lit(now_ms),
    }
    return kept.select(*[own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in COMPANIES.fields])


def curated(spark: SparkSession, now_ms: int) -> DataFrame:
    rows = spark.createDataFrame(list(CURATED), "slug string, name string, website string, careers_url string, description string")
    rows = rows.withColumns({"id": F.concat(F.lit("curated-"), "slug"), "created_at": F.lit(now_ms)})
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in COMPANIES.fields])
