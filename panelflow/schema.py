"""Table schemas and the fixed lookup values of the domain."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D, _I, _L, _B, _TS = (
    T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.TimestampNTZType(),
)


def _table(*columns) -> T.StructType:
    return T.StructType([T.StructField(name, kind, null) for name, kind, null in columns])


POINT = T.StructType([T.StructField("x", _D), T.StructField("y", _D)])
POLYGON = T.ArrayType(POINT)

PROJECTS = _table(
    ("id", _S, False), ("title", _S, False), ("title_original", _S, True), ("author", _S, True),
    ("artist", _S, True), ("description", _S, True), ("cover_image_path", _S, True),
    ("source_language", _S, True), ("target_language", _S, True), ("tags", _S, True),
    ("metadata_json", _S, True), ("created_at", _TS, True), ("updated_at", _TS, True),
)
CHAPTERS = _table(
    ("id", _S, False), ("project_id", _S, False), ("chapter_number", _D, False), ("title", _S, True),
    ("page_count", _I, True), ("is_translated", _B, True), ("metadata_json", _S, True), ("created_at", _TS, True),
)
PAGES = _table(
    ("id", _S, False), ("chapter_id", _S, False), ("page_number", _I, False), ("original_image_path", _S, True),
    ("translated_image_path", _S, True), ("width", _I, True), ("height", _I, True), ("is_translated", _B, True),
    ("processing_time_ms", _D, True), ("metadata_json", _S, True), ("created_at", _TS, True),
)
BUBBLES = _table(
    ("id", _S, False), ("page_id", _S, False), ("bubble_type", _S, True), ("x", _D, True), ("y", _D, True),
    ("width", _D, True), ("height", _D, True), ("polygon_json", _S, True), ("confidence", _D, True),
    ("reading_order", _I, True), ("original_text", _S, True), ("translated_text", _S, True),
    ("is_translated", _B, True), ("rotation", _D, True), ("detector_engine", _S, True),
    ("has_precise_mask", _B, True), ("metadata_json", _S, True), ("created_at", _TS, True),
)
JOBS = _table(
    ("id", _S, False), ("chapter_id", _S, True), ("status", _S, False), ("progress", _D, True),
    ("total_pages", _I, True), ("completed_pages", _I, True), ("failed_pages", _I, True),
    ("error_message", _S, True), ("source_language", _S, True), ("target_language", _S, True),
    ("options_json", _S, True), ("started_at", _TS, True), ("completed_at", _TS, True),
    ("created_at", _TS, True), ("updated_at", _TS, True),
)
SEGMENTS = _table(
    ("id", _S, False), ("job_id", _S, False), ("page_id", _S, False), ("bubble_id", _S, True),
    ("original_text", _S, True), ("translated_text", _S, True), ("ocr_confidence", _D, True),
    ("source_language", _S, True), ("target_language", _S, True), ("status", _S, True),
    ("error_message", _S, True), ("processing_time_ms", _D, True), ("metadata_json", _S, True),
    ("created_at", _TS, True), ("updated_at", _TS, True),
)
CATALOG = {
    "projects": PROJECTS, "chapters": CHAPTERS, "pages": PAGES,
    "bubbles": BUBBLES, "jobs": JOBS, "segments": SEGMENTS,
}

RAW_REGIONS = T.StructType([
    T.StructField("page_id", _L), T.StructField("engine", _S), T.StructField("confidence", _D),
    T.StructField("x", _D), T.StructField("y", _D), T.StructField("w", _D), T.StructField("h", _D),
    T.StructField("polygon", POLYGON), T.StructField("bubble_type", _S), T.StructField("has_mask", _B),
    T.StructField("text_prompt", _S), T.StructField("time_ms", _D),
])
OCR_REGIONS = T.StructType([
    T.StructField("page_id", _L), T.StructField("region_index", _I), T.StructField("engine", _S),
    T.StructField("confidence", _D), T.StructField("x", _D), T.StructField("y", _D), T.StructField("w", _D),
    T.StructField("h", _D), T.StructField("text", _S), T.StructField("language", _S), T.StructField("rotation", _D),
])
PROGRESS_EVENT = T.StructType([
    T.StructField("type", _S), T.StructField("job_id", _S), T.StructField("status", _S),
    T.StructField("progress", _D), T.StructField("current_page", _I), T.StructField("total_pages", _I),
    T.StructField("message", _S), T.StructField("page_id", _S), T.StructField("processing_time_ms", _D),
    T.StructField("total_time_ms", _D), T.StructField("manga_title", _S), T.StructField("chapter_number", _D),
    T.StructField("error_message", _S), T.StructField("page_number", _I), T.StructField("bubbles_detected", _I),
    T.StructField("bubble_index", _I), T.StructField("original_text_preview", _S),
    T.StructField("translated_text_preview", _S), T.StructField("timestamp", T.TimestampType()),
])

# --- Fixed values: these must equal the values the results are compared with ---

JOB_STATUSES = ["pending", "queued", "processing", "paused", "completed", "failed", "cancelled"]
STATUS_ACTIONS = {
    "pending": "created", "queued": "queued", "processing": "started",
    "completed": "completed", "failed": "failed", "cancelled": "cancelled",
}
# (action, status before) -> status after; pairs not listed are refused.
JOB_TRANSITIONS = {
    "stop": {"processing": "paused"},
    "resume": {status: "queued" for status in JOB_STATUSES},
    "cancel": {s: "cancelled" for s in JOB_STATUSES if s not in ("completed", "cancelled")},
    "retry": {"failed": "pending", "cancelled": "pending"},
}
BUBBLE_TYPES = ["speech", "thought", "narration", "sfx", "sign", "title", "poster"]
# Keyword lists tried in this order after the direct match on the type name.
LABEL_KEYWORDS = [
    ("speech", ["speech", "dialogue", "balloon", "bubble"]),
    ("thought", ["thought", "cloud", "thinking"]),
    ("narration", ["narration", "caption", "box"]),
    ("sfx", ["sound", "sfx", "onomatopoeia", "effect"]),
    ("sign", ["sign", "placard", "billboard"]),
    ("title", ["title", "heading"]),
    ("poster", ["poster", "banner"]),
]
DETECTOR_PRIORITY = ["yolo", "groundingdino", "sam2"]
OCR_PRIORITY = ["paddleocr", "easyocr", "tesseract"]
TRANSLATOR_PRIORITY = [
    "openai", "claude", "gemini", "deepl", "google", "libre",
    "ollama", "nllb", "m2m100", "marianmt", "argos",
]
IMAGE_EXTENSIONS = ["jpg", "jpeg", "png", "webp", "bmp", "tiff", "tif"]
MAX_PAGE_BYTES = 50 * 1024 * 1024
MAX_DIMENSION = 10000
MAX_REGIONS_PER_PAGE = 200
MAX_OCR_REGIONS_PER_CALL = 100
UNPROFILED_PATHS = ["/api/v1/health", "/health", "/api/v1/info"]
MIME_TYPES = {
    ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".webp": "image/webp",
    ".bmp": "image/bmp", ".tiff": "image/tiff", ".tif": "image/tiff",
}
EXPORT_FORMATS = {
    # format: (extension, mime type, quality setting, archive, image folder)
    "pdf": (".pdf", "application/pdf", True, False, False),
    "png": (".png", "image/png", False, False, True),
    "jpg": (".jpg", "image/jpeg", True, False, True),
    "jpeg": (".jpeg", "image/jpeg", True, False, True),
    "webp": (".webp", "image/webp", True, False, True),
    "zip": (".zip", "application/zip", True, True, False),
    "cbz": (".cbz", "application/vnd.comicbook+zip", True, True, False),
    "cbr": (".cbr", "application/vnd.comicbook-rar", True, True, False),
}
# Type presets for typesetting: font, smallest and largest size, line height,
# padding ratio, outline, shadow blur, stroke, alignment, weight, italic, uppercase.
STYLE_FIELDS = [
    "font_name", "font_size_min", "font_size_max", "line_height_ratio", "padding_ratio",
    "outline_width", "shadow_blur", "stroke_width", "text_align", "font_weight", "italic", "uppercase",
]
STYLES = {
    "speech": ("manga.ttf", 14, 48, 1.35, 0.08, 2, 2, 0, "center", "normal", False, False),
    "thought": ("manga.ttf", 13, 42, 1.3, 0.08, 2, 2, 0, "center", "normal", True, False),
    "narration": ("manga.ttf", 11, 36, 1.3, 0.1, 1, 1, 0, "left", "normal", False, False),
    "sfx": ("sfx_bold.ttf", 18, 64, 1.1, 0.05, 3, 3, 1, "center", "bold", False, True),
    "sign": ("manga.ttf", 10, 40, 1.3, 0.06, 2, 2, 0, "center", "normal", False, False),
    "title": ("manga_bold.ttf", 20, 64, 1.3, 0.1, 3, 3, 1, "center", "bold", False, False),
    "poster": ("manga_bold.ttf", 24, 72, 1.2, 0.08, 4, 4, 2, "center", "bold", False, False),
    "default": ("default.ttf", 12, 48, 1.35, 0.08, 2, 2, 0, "center", "normal", False, False),
}
OCR_LANGUAGES = {
    "paddleocr": {"ja": "japan", "zh": "ch", "ko": "korean", "en": "en", "ru": "ru", "uz": "uz",
                  "es": "es", "fr": "fr", "ar": "ar", "th": "th", "vi": "vi"},
    "easyocr": {"ja": "ja", "zh": "ch_sim", "ko": "ko", "en": "en", "ru": "ru", "uz": "ch_sim",
                "es": "es", "fr": "fr", "ar": "ar", "th": "th", "vi": "vi"},
    "tesseract": {"ja": "jpn", "zh": "chi_sim", "ko": "kor", "en": "eng", "ru": "rus", "uz": "uzb",
                  "es": "spa", "fr": "fra", "ar": "ara", "th": "tha", "vi": "vie"},
}
TRANSLATOR_LANGUAGES = {
    "nllb": {
        "ja": "jpn_Jpan", "en": "eng_Latn", "zh": "zho_Hans", "ko": "kor_Hang", "fr": "fra_Latn",
        "es": "spa_Latn", "ru": "rus_Cyrl", "de": "deu_Latn", "it": "ita_Latn", "pt": "por_Latn",
        "th": "tha_Thai", "vi": "vie_Latn", "ar": "arb_Arab", "tr": "tur_Latn", "nl": "nld_Latn",
        "pl": "pol_Latn", "sv": "swe_Latn", "da": "dan_Latn", "fi": "fin_Latn", "cs": "ces_Latn",
        "hu": "hun_Latn", "ro": "ron_Latn", "el": "ell_Grek", "he": "heb_Hebr", "hi": "hin_Deva",
        "id": "ind_Latn", "ms": "zsm_Latn", "tl": "tgl_Latn", "mn": "mon_Cyrl", "ne": "npi_Deva",
        "uz": "uzn_Latn", "kk": "kaz_Cyrl", "uk": "ukr_Cyrl",
    },
    # These two use the ISO code itself for every language they know.
    "m2m100": {},
    "argos": {},
    "deepl": {
        "en": "EN-US", "ja": "JA", "zh": "ZH", "ko": "KO", "fr": "FR", "es": "ES", "de": "DE",
        "it": "IT", "pt": "PT-BR", "ru": "RU", "nl": "NL", "pl": "PL", "sv": "SV", "da": "DA",
        "fi": "FI", "cs": "CS", "hu": "HU", "ro": "RO", "el": "EL", "bg": "BG", "lt": "LT",
        "lv": "LV", "et": "ET", "sl": "SL", "sk": "SK", "hr": "HR", "uk": "UK",
    },
}
LANGUAGE_DEFAULTS = {"deepl": "EN-US"}
MARIAN_SOURCES_TO_ENGLISH = ["ja", "zh", "ko", "fr", "es", "ru", "de", "it", "pt", "nl", "th", "vi", "ar", "tr"]
MARIAN_TARGETS_FROM_ENGLISH = ["ja", "zh", "ko", "fr", "es", "ru", "de", "pt"]
MARIAN_OTHER_PAIRS = [("ja", "zh")]
MARIAN_NAME = "Helsinki-NLP/opus-mt-{source}-{target}"
