"""Text functions: path parts, folder-safe names, document and duplicate tests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that mark a document's file name.
DOCUMENT_KEYWORDS = (
    "cartão", "cartao", "cidadão", "cidadao", "cc_", "passport", "passaporte",
    "nif", "iban", "invoice", "fatura", "receipt", "recibo", "document", "documento",
    "certificado", "contrato", "apolice", "licença", "licenca", "identidade",
)
# Media file suffixes.
MEDIA_EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp", ".heic", ".heif", ".tif", ".tiff", ".mp4", ".mov", ".avi", ".mkv", ".webm")
# Days that are none.
INVALID_DAYS = ("missing", "0000-00-00")

_HAS_SUFFIX = r"^.+\.[^.]+$"


def stem(name: Column) -> Column:
    """The name up to its last dot; a leading or trailing dot begins no suffix."""
    return F.when(name.rlike(_HAS_SUFFIX), F.regexp_extract(name, r"^(.+)\.[^.]+$", 1)).otherwise(name)


def suffix(name: Column) -> Column:
    """The last dot and what follows, or empty."""
    return F.when(name.rlike(_HAS_SUFFIX), F.regexp_extract(name, r"(\.[^.]+)$", 1)).otherwise(F.lit(""))


def is_media(extension: Column) -> Column:
    return F.lower(extension).isin(*MEDIA_EXTENSIONS)


def date_key(value: Column) -> Column:
    """The first ten characters with their first two colons as dashes; empty gives null."""
    key = F.array_join(F.split(F.substring(value, 1, 10), ":", 3), "-")
    return F.when(value != "", key)


def folder_part(value: Column) -> Column:
    """Letters, digits, dashes and underscores; blanks become underscores, others go."""
    kept = F.regexp_replace(F.translate(value, " ", "_"), r"[^\p{L}\p{N}_-]", "")
    trimmed = F.btrim(kept, F.lit("_"))
    return F.when(trimmed == "", F.lit("unknown")).otherwise(trimmed)


def is_document(name: Column) -> Column:
    """Whether the lower-cased name contains a document keyword anywhere."""
    low = F.lower(name)
    return reduce(lambda a, b: a | b, (low.contains(k) for k in DOCUMENT_KEYWORDS))


def duplicate_penalty(name: Column) -> Column:
    """How much a name looks like that of a copy."""
    low, bare = F.lower(name), F.lower(stem(name))
    points = ((low.contains("__dup"), 100), (low.contains(" copy") | low.contains("_copy"), 50), (bare.rlike(r" [0-9]+$"), 20), (bare.rlike(r"\([0-9]+\)$"), 20))
    return reduce(lambda a, b: a + b, (F.when(c, F.lit(n)).otherwise(F.lit(0)) for c, n in points))


def rank(confidence: Column, unknown: int) -> Column:
    """low 0, medium 1, high 2; anything else ``unknown``."""
    return F.when(confidence == "high", 2).when(confidence == "medium", 1).when(confidence == "low", 0).otherwise(F.lit(unknown))


def auto_folder(root: str, day: Column, sequence: Column) -> Column:
    """root/yyyy/mm-dd, with _NN for later clusters of a day."""
    month_day = F.substring(day, 6, 100)
    name = F.when(sequence == 1, month_day).otherwise(F.concat(month_day, F.format_string("_%02d", sequence)))
    return F.concat_ws("/", F.lit(root), F.substring(day, 1, 4), name)
