"""Files as rows: kind by leading bytes, skip rules, text extraction."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import Settings

SNIFF, MAX_DAMAGE = 8192, 0.05
# Leading bytes (hex) at an offset, and the kind they mean.
SIGNATURES = (
    (0, "25504446", "pdf"),
    (0, "89504E470D0A1A0A", "image"),
    (0, "FFD8FF", "image"),
    (0, "474946383761", "image"),
    (0, "474946383961", "image"),
    (0, "424D", "image"),
    (0, "49492A00", "image"),
    (0, "4D4D002A", "image"),
    (8, "57454250", "image"),
    (4, "6674797068656963", "image"),
    (4, "6674797061766966", "image"),
    (0, "504B0304", "binary_unknown"),
    (0, "1F8B", "binary_unknown"),
    (0, "425A68", "binary_unknown"),
    (0, "377ABCAF271C", "binary_unknown"),
    (0, "FD377A585A00", "binary_unknown"),
    (0, "7F454C46", "binary_unknown"),
    (0, "4D5A", "binary_unknown"),
    (0, "494433", "binary_unknown"),
    (4, "66747970", "binary_unknown"),
    (0, "4F676753", "binary_unknown"),
    (0, "53514C69746520666F726D6174203300", "binary_unknown"),
    (0, "526172211A07", "binary_unknown"),
    (0, "28B52FFD", "binary_unknown"),
    (0, "04224D18", "binary_unknown"),
    (0, "4C5A4950", "binary_unknown"),
    (0, "1F9D", "binary_unknown"),
    (257, "7573746172", "binary_unknown"),
    (0, "213C617263683E", "binary_unknown"),
    (0, "EDABEEDB", "binary_unknown"),
    (0, "4D534346", "binary_unknown"),
    (0, "D0CF11E0A1B11AE1", "binary_unknown"),
    (0, "25215053", "binary_unknown"),
    (0, "7B5C727466", "binary_unknown"),
    (0, "0061736D", "binary_unknown"),
    (0, "CAFEBABE", "binary_unknown"),
    (0, "FEEDFACF", "binary_unknown"),
    (0, "CFFAEDFE", "binary_unknown"),
    (0, "664C6143", "binary_unknown"),
    (0, "4D546864", "binary_unknown"),
    (0, "2321414D52", "binary_unknown"),
    (0, "1A45DFA3", "binary_unknown"),
    (0, "464C5601", "binary_unknown"),
    (0, "3026B2758E66CF11A6D9", "binary_unknown"),
    (0, "000001BA", "binary_unknown"),
    (0, "774F464600010000", "binary_unknown"),
    (0, "774F463200010000", "binary_unknown"),
    (0, "0001000000", "binary_unknown"),
    (0, "4F54544F00", "binary_unknown"),
    (0, "38425053", "image"),
    (0, "00000100", "image"),
    (0, "0000000C6A502020", "image"),
)


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, modificationTime, length, content; filters on path and length reach the scan.

    The scan leaves out files of no bytes, which have nothing to redact.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def decoded(content: Column) -> Column:
    """UTF-8 text, with U+FFFD for what is damaged."""
    return F.make_valid_utf8(content.cast("string"))


def damage(text: Column) -> Column:
    """The share of U+FFFD among the characters."""
    return F.when(F.char_length(text) > 0, 1 - F.char_length(F.replace(text, F.lit("�"), F.lit(""))) / F.char_length(text)).otherwise(F.lit(0.0))


def kind(content: Column) -> Column:
    """text, pdf, image or binary_unknown."""
    out = None
    for at, mark, name in SIGNATURES:
        hit = F.substring(content, at + 1, len(mark) // 2) == F.unhex(F.lit(mark))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    head = F.substring(content, 1, SNIFF)
    nul = F.locate("00", F.regexp_replace(F.hex(head), "(..)", "$1 ")) > 0
    return out.when(F.octet_length(content) == 0, "text").when(nul, "binary_unknown").when(damage(decoded(head)) <= MAX_DAMAGE, "text").otherwise("binary_unknown")


def _matches(path: Column, globs: tuple[str, ...]) -> Column:
    """Any glob matches the whole path or its last part; ``*`` crosses slashes."""
    name, out = F.substring_index(path, "/", -1), F.lit(False)
    for g in globs:
        pattern = "(?s)^" + fnmatch.translate(g).removeprefix("(?s:").removesuffix(r")\z").removesuffix(r")\Z") + "$"
        out = out | path.rlike(pattern) | name.rlike(pattern)
    return out


def skip_reason(path: Column, length: Column, settings: Settings) -> Column:
    """Why a file is passed through: always-redact globs come before never-redact and skip globs; the size cap holds for all."""
    denied = _matches(path, settings.deny_globs)
    return (
        F.when(~denied & _matches(path, settings.allow_globs), "allow_globs")
        .when(~denied & _matches(path, settings.skip_globs), "skip_globs")
        .when(length.isNull(), "stat_failed")
        .when(length > settings.max_file_bytes, "max_file_bytes")
    )


def extract_text(files: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """path, length, kind, skip_reason, text, content_hash. Skipped files stay as rows without text."""
    plain = F.regexp_replace("path", "^file:/+", "/")
    routed = files.select("path", "length", "content", skip_reason(plain, F.col("length"), settings).alias("skip_reason"))
    routed = routed.withColumn("kind", F.when(F.col("skip_reason").isNull(), kind(F.col("content"))))
    text = decoded(F.col("content"))
    routed = routed.withColumn("text", F.when(F.col("kind") == "text", text))
    late = F.when((F.col("kind") == "text") & (damage(F.col("text")) > MAX_DAMAGE), "binary_content").when(F.col("kind") != "text", F.concat(F.lit("no_extractor:"), F.col("kind")))
    routed = routed.withColumn("skip_reason", F.coalesce("skip_reason", late))
    return routed.select("path", "length", "kind", "skip_reason", F.when(F.col("skip_reason").isNull(), F.col("text")).alias("text"), F.sha2("content", 256).alias("content_hash"))


def output_name(path: Column, content_hash: Column, fingerprint: str) -> Column:
    """<hash>.<settings>.redacted.<ext>: two settings never write the same file."""
    name = F.substring_index(path, "/", -1)
    ext = F.when(name.rlike(r".\.[^.]+$"), F.substring_index(name, ".", -1)).otherwise("txt")
    return F.concat(F.substring(content_hash, 1, 16), F.lit(f".{fingerprint}.redacted."), ext)
