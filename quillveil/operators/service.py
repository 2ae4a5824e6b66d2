"""Requests answered in bulk: ping, redact (by path), redact_text, shutdown, anything else an error."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import fresh
from ..schema import Settings
from ..sources.files import output_name
from .redact import redact


def respond(requests: DataFrame, settings: Settings = Settings(), files: DataFrame | None = None) -> DataFrame:
    """op, text, path (+ any) -> ok, redacted, redacted_path, found, error.

    ``files`` are rows of :func:`quillveil.sources.files.extract_text`, one a path, that ``redact`` requests look up by
    path. A skipped file is answered as one without findings. A request without its text or path, and a path that is no
    row of ``files``, are errors.
    """
    own, text, hashed, known_path = (fresh(requests.columns, n) for n in ("_asked", "_text", "_hash", "_path"))
    path = F.col("path") if "path" in requests.columns else F.lit(None).cast("string")
    by_path, by_text, quiet = (F.coalesce(F.col("op").isin(*ops), F.lit(False)) for ops in (("redact",), ("redact_text",), ("ping", "shutdown")))
    rows = requests.withColumn(own, F.when(by_path & (path != ""), path))
    if files is None:
        rows = rows.withColumns({c: F.lit(None).cast("string") for c in (known_path, text, hashed)})
    else:
        held = files.select(F.col("path").alias(known_path), F.col("text").alias(text), F.col("content_hash").alias(hashed))
        rows = rows.join(held, F.col(own) == F.col(known_path), "left")
    error = (
        F.when(by_path, F.when(F.col(own).isNull(), "missing path").when(F.col(known_path).isNull(), "no such file"))
        .when(by_text, F.when(F.col("text").isNull(), "missing text"))
        .when(~quiet, F.concat(F.lit("unknown op: "), F.coalesce("op", F.lit("null"))))
    )
    source = F.when(by_text, F.col("text")).when(by_path, F.col(text))
    done = redact(rows.withColumn("error", error).withColumn(own, source), own, settings).drop("spans")
    mine = (by_path | by_text) & F.col("error").isNull()
    name = output_name(F.col(known_path), F.col(hashed), settings.fingerprint())
    return done.withColumns(
        {
            "ok": F.col("error").isNull(),
            "redacted": F.when(mine & F.col(own).isNotNull(), F.col("redacted")),
            "redacted_path": F.when(mine & by_path & (F.col("found") > 0), name),
            "found": F.when(mine, F.col("found")),
        }
    ).drop(own, text, hashed, known_path)


def respond_json(lines: DataFrame, settings: Settings = Settings(), col: str = "value", files: DataFrame | None = None) -> DataFrame:
    """The same over JSON lines; a line that is no JSON object is answered with an error."""
    asked = lines.withColumn("_r", F.from_json(col, "op string, text string, path string")).select("*", *(F.col("_r")[c].alias(c) for c in ("op", "text", "path")))
    out = respond(asked, settings, files)
    body = F.to_json(F.struct("ok", "redacted", "redacted_path", "found", F.when(F.col("_r").isNull(), "not a JSON object").otherwise(F.col("error")).alias("error")))
    return out.select(col, body.alias("response"))
