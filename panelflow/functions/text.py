"""Text expressions: blanks, scripts, file names, keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelflow import schema

# The white space removed at both ends of a text, as a character
# class that both Java's and RE2's regex dialects read the same way.
SPACE = (r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
         r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
# Code-point ranges by script language, and the kana range.
KANA = r"[\x{3040}-\x{309F}\x{30A0}-\x{30FF}]"
SCRIPTS = {
    "zh": r"[\x{4E00}-\x{9FFF}]",
    "ko": r"[\x{AC00}-\x{D7AF}]",
    "ar": r"[\x{0600}-\x{06FF}]",
    "th": r"[\x{0E00}-\x{0E7F}]",
    "vi": r"[\x{1EA0}-\x{1EFF}]",
    "ru": r"[\x{0400}-\x{04FF}]",
}
PRESENCE_ORDER = ["ko", "zh", "ar", "th", "ru"]
LETTER_BEYOND_LATIN = r"[\p{L}&&[^\x{00}-\x{2AF}]]"
# File-name patterns.
CHAPTER_NUMBER = r"(?i)(?:ch|chapter|ch\.|vol|v)[.\s]*(\d+(?:\.\d+)?)"
BRACKETED = r"\s*[\[\(].*?[\]\)]\s*"
CHAPTER_TAIL = r"(?i)(?:ch|chapter|vol|v)\s*\d+.*$"
# Lead-ins dropped from a translation, tried in this order.
LEAD_INS = [
    "Translation:", "Translated text:", "Output:", "Result:",
    "Here is the translation:", "Translated:",
]


def strip(c: Column) -> Column:
    """Remove Unicode white space at both ends."""
    return F.regexp_replace(c, rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def has_text(c: Column) -> Column:
    """True when something other than white space is present; null counts as blank."""
    return F.coalesce(c.rlike(rf"[^{SPACE}]"), F.lit(False))


def script_language(c: Column) -> Column:
    """Language of the script with most characters; the script seen first wins a tie."""
    hits = F.array(*[
        F.struct(
            F.regexp_count(c, F.lit(rx)).alias("n"),
            (-F.regexp_instr(c, F.lit(rx))).alias("first"),
            F.lit(lang).alias("lang"),
        )
        for lang, rx in SCRIPTS.items()
    ])
    scripted = c.rlike("|".join(SCRIPTS.values()))
    return (
        F.when(~has_text(c), "unknown")
        .when(c.rlike(KANA), "ja")
        # Counting is left to texts that have something to count.
        .when(scripted, F.array_max(hits)["lang"])
        .when(c.rlike(LETTER_BEYOND_LATIN), "unknown")
        .otherwise("en")
    )


def script_presence(c: Column) -> Column:
    """Language of the first script present, else English when most characters are ASCII letters."""
    out = F.when(c.isNull(), "unknown").when(c.rlike(KANA), "ja")
    for lang in PRESENCE_ORDER:
        out = out.when(c.rlike(SCRIPTS[lang]), lang)
    letters = F.regexp_count(c, F.lit("[A-Za-z]"))
    return out.when(letters > F.char_length(c) * 0.5, "en").otherwise("unknown")


def retag_language(tag: Column, text: Column) -> Column:
    """Replace an undecided tag by the script language when that is known."""
    found = script_language(text)
    return F.when(tag.isin("unknown", "japan") & (found != "unknown"), found).otherwise(tag)


def natural_key(c: Column) -> Column:
    """Sortable key: text runs lower-cased, digit runs by value whatever their length."""
    runs = F.regexp_extract_all(c, F.lit(r"[^0-9]+[0-9]*|[0-9]+"), F.lit(0))

    def part(run: Column) -> Column:
        digits = F.regexp_replace(F.regexp_extract(run, r"[0-9]+\z", 0), r"^0+(?=[0-9])", "")
        return F.struct(
            F.lower(F.regexp_extract(run, r"^[^0-9]*", 0)).alias("text"),
            F.nullif(F.length(digits), F.lit(0)).alias("digits"),
            digits.alias("number"),
        )

    return F.transform(runs, part)


def basename(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/]*)\z", 1)


def extension(c: Column) -> Column:
    """Last suffix with its dot, lower-cased; '' when the name has none."""
    return F.lower(F.regexp_extract(basename(c), r"(?s)^.+(\.[^.]+)\z", 1))


def stem(c: Column) -> Column:
    return F.regexp_replace(basename(c), r"(?s)^(.+)\.[^.]+\z", "$1")


def detected_chapter(c: Column) -> Column:
    return F.regexp_extract(c, CHAPTER_NUMBER, 1).try_cast("double")


def detected_title(c: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(stem(c), BRACKETED, " "), CHAPTER_TAIL, "")
    return F.nullif(F.regexp_replace(strip(bare), r"^[-_.]+|[-_.]+\z", ""), F.lit(""))


def strip_prefixes(c: Column) -> Column:
    for lead in LEAD_INS:
        c = F.regexp_replace(c, rf"^{lead}[{SPACE}]*", "")
    return strip(c)


def preview(c: Column, n: int = 50) -> Column:
    return F.when(F.char_length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def clip(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def safe_name(title: Column, task_id: Column, file_format: Column) -> Column:
    """Archive name from title, eight characters of the task id and the format's extension."""
    suffix = _lookup({
        k: ("" if image else ext) for k, (ext, _, _, _, image) in schema.EXPORT_FORMATS.items()
    }, file_format)
    return F.concat(F.translate(title, " /", "__"), F.lit("_"), F.substring(task_id, 1, 8),
                    F.coalesce(suffix, F.lit("")))


def _lookup(values: dict, key: Column) -> Column:
    pairs = [F.lit(x) for pair in values.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), key) if pairs else F.lit(None).cast("string")


def mime_type(ext: Column) -> Column:
    return F.coalesce(_lookup(schema.MIME_TYPES, F.lower(ext)), F.lit("application/octet-stream"))


def export_mime(file_format: Column) -> Column:
    return _lookup({k: v[1] for k, v in schema.EXPORT_FORMATS.items()}, F.lower(file_format))


def status_action(c: Column) -> Column:
    return F.coalesce(_lookup(schema.STATUS_ACTIONS, c), F.lit("updated"))


def map_language(engine: Column, iso: Column) -> Column:
    """Engine-specific language code; codes without an entry pass through
    (or become the engine's own default)."""
    out = None
    for name, codes in {**schema.OCR_LANGUAGES, **schema.TRANSLATOR_LANGUAGES}.items():
        fallback = schema.LANGUAGE_DEFAULTS.get(name)
        code = F.coalesce(_lookup(codes, iso), F.lit(fallback) if fallback else iso)
        out = F.when(engine == name, code) if out is None else out.when(engine == name, code)
    return out.otherwise(iso)


def marian_model(source: Column, target: Column) -> Column:
    """Model name of a language pair, null when no model exists for it."""
    known = (
        (target == "en") & source.isin(schema.MARIAN_SOURCES_TO_ENGLISH)
    ) | ((source == "en") & target.isin(schema.MARIAN_TARGETS_FROM_ENGLISH))
    for a, b in schema.MARIAN_OTHER_PAIRS:
        known = known | ((source == a) & (target == b))
    before, _, rest = schema.MARIAN_NAME.partition("{source}")
    between = rest.partition("{target}")[0]
    return F.when(known, F.concat(F.lit(before), source, F.lit(between), target))


def request_key(text: Column, source: Column, target: Column, context: Column | None = None) -> Column:
    key = F.concat(F.lit("trans:"), F.md5(text), F.lit(":"), source, F.lit(":"), target)
    if context is None:
        return key
    tail = F.concat(F.lit(":ctx="), F.substring(F.md5(context), 1, 16))
    return F.concat(key, F.when(F.coalesce(context, F.lit("")) != "", tail).otherwise(""))


def stored_key(key: Column, prefix: str = "") -> Column:
    """Key without line breaks; over 500 characters it becomes the md5 of the original."""
    flat = F.regexp_replace(key, r"[\n\r]", "")
    return F.concat(F.lit(prefix), F.when(F.char_length(flat) > 500, F.md5(key)).otherwise(flat))


def size_estimate(c: Column, kind: str = "string") -> Column:
    """Bytes of a string, a string map (64 more per key) or a string array (8 more per item)."""
    if kind == "string":
        return F.octet_length(c).cast("long")
    items, extra = (F.map_values(c), 64) if kind == "map" else (c, 8)
    total = F.aggregate(items, F.lit(0).cast("long"), lambda acc, v: acc + F.octet_length(v))
    return total + F.size(items) * extra
