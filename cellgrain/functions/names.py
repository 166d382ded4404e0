"""File-name functions: stain markers, pairing keys, magnifications, safe names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: stain markers in file names
STAINS = ["foxp3", "pdl1", "pd-l1", "pd_l1", "cd163", "cd68", "panck", "tim-3", "tim3", "hdab", "cd8", "cd4", "cd3", "ck", "ki67", "ki-67", "prospc", "pro-spc", "cc10", "cd31", "dab", "he", "h&e"]
# fixed values: magnification -> micrometres per pixel
MAGNIFICATIONS = {4: 2.50, 10: 1.00, 20: 0.50, 40: 0.25, 60: 0.165, 100: 0.10}
# fixed values: patterns that find a magnification in a file name, in order of precedence
MAGNIFICATION_PATTERNS = [r"[\-_\s](\d+)x[\-_\s\.]", r"[\-_\s]x(\d+)[\-_\s\.]", r"^(\d+)x[\-_\s\.]", r"[\-_\s](\d+)x$", r"[\-_]x(\d+)[\-_]", r"(\d+)x(?=\D|$)", r"x(\d+)(?=\D|$)"]
# fixed values: image suffixes
IMAGE_SUFFIXES = [".tif", ".tiff", ".svs", ".ndpi", ".png", ".jpg", ".jpeg"]


def by_length(tokens: list[str]) -> list[str]:
    """Longest first; equal lengths keep their order."""
    return sorted(tokens, key=len, reverse=True)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(name: Column) -> Column:
    """Name without its last suffix."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def _words(text: Column) -> Column:
    """The runs of letters and digits of a lower-case name, in order, with the marks between them as words of their own."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+|[^a-z0-9]+)"), F.lit(1)), lambda w: w != "")


def _token_words(token: str) -> list[str]:
    """A marker as the words it is made of: "pd-l1" is pd, -, l1."""
    parts, now = [], ""
    for c in token:
        if now and c.isalnum() != now[-1].isalnum():
            parts.append(now)
            now = ""
        now += c
    return [*parts, now]


def _place_of(words: Column, token: str) -> Column:
    """Where a marker's words first stand in a row in a name's words (from 1), 0 if nowhere."""
    parts = _token_words(token)
    if len(parts) == 1:
        return F.array_position(words, token)
    here = lambda k: F.slice(words, k, len(parts)) == F.array(*[F.lit(p) for p in parts])
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1))), here)
    return F.when(F.size(words) >= len(parts), F.coalesce(F.try_element_at(at, F.lit(1)), F.lit(0))).otherwise(0)


def stain_of(text: Column, tokens: list[str] = STAINS) -> Column:
    """The longest marker whose words stand in a name, the first of equally long ones; null without one."""
    words = _words(text)
    return F.coalesce(*[F.when(_place_of(words, t) > 0, F.lit(t)) for t in by_length(tokens)])


def pairing_key(text: Column, tokens: list[str] = STAINS) -> Column:
    """A name's words in lower case without its marker's, joined by underscores; x10 is written 10x.

    Every occurrence of the marker goes; separators (hyphens, underscores, dots, white space) join words, other marks stay.
    """
    found, words = stain_of(text, tokens), _words(text)
    single = F.filter(words, lambda w: found.isNull() | (w != found))
    bare = single
    for t in tokens:  # a marker of several words: drop each stretch of its words
        if len(parts := _token_words(t)) > 1:
            inside = lambda k, n=len(parts), p=parts: F.exists(F.sequence(F.greatest(k - (n - 1), F.lit(1)), k), lambda at: F.slice(words, at, n) == F.array(*[F.lit(x) for x in p]))
            kept = F.transform(F.filter(F.transform(words, lambda w, k: F.struct(w.alias("w"), (k + 1).alias("k"))), lambda x: ~inside(x["k"])), lambda x: x["w"])  # noqa: B023
            bare = F.when(found == t, kept).otherwise(bare)
    joined = F.regexp_replace(F.array_join(bare, ""), r"[\s_.-]+", "_")
    return F.regexp_replace(F.trim(joined, F.lit("_")), r"(^|[^0-9])x([0-9]+)(?![0-9])", "$1$2x")


def pixel_size_of(name: Column) -> Column:
    """Pixel size by the magnification in a name: the first pattern whose number is known."""
    low = F.lower(name)
    known = F.create_map(*[x for k, v in MAGNIFICATIONS.items() for x in (F.lit(str(k)), F.lit(v))])
    found = [F.regexp_extract(low, p, 1) for p in MAGNIFICATION_PATTERNS]
    return F.coalesce(*[F.try_element_at(known, F.regexp_replace(f, "^0+(?=.)", "")) for f in found])


def is_scale_image(name: Column) -> Column:
    return F.lower(stem(name)).endswith("_scale")


def safe_name(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}\p{N}._\- ]", "")


def short_label(text: Column) -> Column:
    """What stands before the first ' - '."""
    return F.substring_index(text, " - ", 1)


def tissue_of(text: Column) -> Column:
    return F.regexp_replace(text, r"_\d+$", "")


# fixed values: marks that set a log line's level, strongest level first; upper and lower case differ
LOG_LEVELS = [
    ("error", ["ERROR", "FAILED", "TIMEOUT"]),
    ("warn", ["⚠", "WARNING"]),
    ("ok", ["✓", "COMPLETE", "FINISHED", "saved", "exported", "complete"]),
    ("info", ["Running", "Processing", "Detecting", "Rerunning", "QC", "Generating"]),
]


def log_level(line: Column) -> Column:
    """Level of a log line: the strongest one of which it holds a mark, else normal; null for null."""
    holds = [(level, F.greatest(*[line.contains(mark) for mark in marks])) for level, marks in LOG_LEVELS]
    return F.when(line.isNotNull(), F.coalesce(*[F.when(hit, F.lit(level)) for level, hit in holds], F.lit("normal")))


def metrics_json(line: Column) -> Column:
    """The JSON after the metrics mark of a log line, null on other lines."""
    return F.when(line.rlike(r"##METRICS##\s*\{"), F.regexp_extract(line, r"##METRICS##\s*(\{.*\})", 1))


def looks_like_scale_image(name: Column) -> Column:
    """The looser test: "scale" anywhere in the name without its suffix."""
    return F.lower(stem(name)).contains("scale")


def scale_percent(folder: Column) -> Column:
    """The number N of a folder's scale-Npc; null without one."""
    return F.try_to_number(F.nullif(F.regexp_extract(folder, r"scale-([0-9]+)(\.[0-9]+)?pc", 1), F.lit("")), F.lit("999999")).cast("double") + F.coalesce(F.nullif(F.regexp_extract(folder, r"scale-[0-9]+(\.[0-9]+)pc", 1), F.lit("")).cast("double"), F.lit(0.0))


def microns_per_pixel(description: Column) -> Column:
    """The value after MPP = in a slide's description; null without one."""
    return F.nullif(F.regexp_extract(description, r"MPP\s*=\s*([0-9.]+)", 1), F.lit("")).cast("double")


def progress(lines: DataFrame, by: list[str], order: str, line: str, total: str) -> DataFrame:
    """Lines with the percentage shown after each: finished images so far by images in all, of 85."""
    seen = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    done = F.count_if(F.col(line).contains("PIPELINE FINISHED SUCCESSFULLY")).over(seen)
    return lines.withColumn("pct", F.when(F.col(total) > 0, F.floor(done * 85 / F.col(total))).cast("int"))
