"""Declared schemas; nothing is inferred."""

INGREDIENT = "STRUCT<quantity: STRING, unit: STRING, item: STRING, note: STRING>"
INGREDIENTS = f"ARRAY<{INGREDIENT}>"
EXTRACTION = "STRUCT<tiers: ARRAY<STRING>, model: STRING, confidence: DOUBLE, rawText: STRING>"

# Stored form: nested columns are JSON text.
RECIPE_STORED = (
    "id STRING, title STRING, description STRING, sourceUrl STRING, sourcePlatform STRING, "
    "sourceAuthor STRING, heroImagePath STRING, servings STRING, servingsCount INT, "
    "totalMinutes INT, ingredients STRING, steps STRING, notes STRING, tags STRING, "
    "extraction STRING, favorite BOOLEAN, cookedCount INT, lastCookedAt TIMESTAMP, "
    "createdAt TIMESTAMP, updatedAt TIMESTAMP"
)
RECIPE = (
    "id STRING, title STRING, description STRING, sourceUrl STRING, sourcePlatform STRING, "
    "sourceAuthor STRING, heroImagePath STRING, servings STRING, servingsCount INT, "
    f"totalMinutes INT, ingredients {INGREDIENTS}, steps ARRAY<STRING>, notes STRING, "
    f"tags ARRAY<STRING>, extraction {EXTRACTION}, favorite BOOLEAN, cookedCount INT, "
    "lastCookedAt TIMESTAMP, createdAt TIMESTAMP, updatedAt TIMESTAMP"
)
FOLDER = "id STRING, name STRING, emoji STRING, createdAt TIMESTAMP"
FOLDER_RECIPE = "folderId STRING, recipeId STRING"
GROCERY = "id STRING, text STRING, checked BOOLEAN, recipeId STRING, createdAt TIMESTAMP"
IMPORT_JOB = (
    "id STRING, url STRING, status STRING, stage STRING, source STRING, chatId STRING, "
    "messageId INT, error STRING, rawText STRING, suppliedText STRING, attempts INT, "
    "recipeId STRING, createdAt TIMESTAMP, updatedAt TIMESTAMP"
)
OEMBED = "title STRING, author_name STRING, author_url STRING, thumbnail_url STRING"
VIDEO_META = (
    "id STRING, title STRING, description STRING, uploader STRING, uploader_id STRING, "
    "channel STRING, thumbnail STRING, duration DOUBLE, webpage_url STRING, "
    "automatic_captions MAP<STRING, ARRAY<STRUCT<ext: STRING, url: STRING>>>, "
    "subtitles MAP<STRING, ARRAY<STRUCT<ext: STRING, url: STRING>>>"
)

JOB_STATUSES = ("pending", "running", "done", "failed", "not_recipe")
WRITABLE_RECIPE_FIELDS = (
    "title", "description", "servings", "servingsCount", "totalMinutes",
    "ingredients", "steps", "notes", "tags", "favorite", "heroImagePath",
)
