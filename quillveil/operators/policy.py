"""Decisions on requests, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import fresh
from ..schema import Settings
from .redact import redact
from .rules import RULES, Rule

MAX_TEXT = 200_000
#: What stands for a withheld output: too long, failed.
NOTICES = ("[output withheld: too long to be checked]", "[output withheld: the check failed]")
# What reads a file's contents, what touches only names, and media suffixes.
READERS = (
    "cat head tail less more tac nl fold cut tr fmt col expand unexpand strings xxd od hexdump hd base64 base32 dd "
    "python python3 perl ruby node deno php awk gawk sed grep egrep fgrep rg ag pdftotext pdfinfo pdfimages pdftoppm "
    "mutool qpdf pdffonts tesseract convert magick identify vipsheader exiftool exif gs"
).split()
NAME_ONLY = (
    "ls mv cp rm stat file chmod chown mkdir touch git find basename dirname realpath readlink du ln rsync scp echo "
    "printf test [ which wc cd pwd mktemp cmp"
).split()
MEDIA = r"(?i)[\w./~\-]+\.(?:pdf|png|jpe?g|gif|bmp|tiff?|webp|heic|heif|avif)"


def failure(settings: Settings, reason: Column) -> tuple[Column, Column]:
    """What a failed redaction means: withheld if closed, the original if open."""
    if settings.fail_mode == "open":
        return F.lit("allow"), F.concat(reason, F.lit(" (passed through)"))
    return F.lit("deny"), reason


def read_decision(requests: DataFrame, settings: Settings, cache_root: str) -> DataFrame:
    """tool_name, file_path, is_file, skip_reason, error, found, redacted_path -> decision, served_path, reason."""
    path, done = F.col("file_path"), F.col("redacted_path")
    inside = (path == cache_root) | path.startswith(cache_root.rstrip("/") + "/")
    passes = (
        ~F.col("tool_name").eqNullSafe("Read")
        | path.isNull()
        | ~path.startswith("/")
        | ~F.coalesce("is_file", F.lit(False))
        | inside
        | (F.coalesce("skip_reason", F.lit("")) != "")
    )
    problem = F.coalesce(F.col("error"), F.when(done.isNull() & (F.coalesce("found", F.lit(0)) > 0), F.lit("findings but no redacted copy")))
    verdict, why = failure(settings, problem)
    # a null path is a request without one
    return requests.withColumns(
        {
            "decision": F.when(F.coalesce(passes, F.lit(True)), "allow").when(problem.isNotNull(), verdict).when(done.isNotNull(), "rewrite").otherwise("allow"),
            "served_path": F.when(F.coalesce(passes, F.lit(True)) | problem.isNotNull(), path).otherwise(F.coalesce(done, path)),
            "reason": F.when(F.coalesce(passes, F.lit(True)), F.lit(None).cast("string")).otherwise(F.when(problem.isNotNull(), why)),
        }
    )


def output_decision(redacted: DataFrame, text_col: str = "text", max_text: int = MAX_TEXT) -> DataFrame:
    """A tool's output after ``redact``: withheld when too long whatever the mode, served redacted, or passed."""
    long = F.char_length(F.coalesce(F.col(text_col), F.lit(""))) > max_text
    return redacted.withColumns(
        {
            "decision": F.when(long, "withhold").when(F.col("found") > 0, "rewrite").otherwise("allow"),
            "served": F.when(long, F.lit(None).cast("string")).otherwise(F.col("redacted")),
        }
    )


def tool_output_decision(outputs: DataFrame, settings: Settings = Settings(), rules: tuple[Rule, ...] = RULES, max_text: int = MAX_TEXT) -> DataFrame:
    """tool_name, kind, stdout, stderr, content, error -> decision, served_stdout, served_stderr, served_content.

    A command's two outputs count together against the limit, and findings in either rewrite both. A read counts where
    its ``kind`` is text. Other tools and shapes pass. What is too long is withheld in any mode, what failed (``error``)
    when closed. Withheld texts are replaced by a notice; null texts count as empty. Passed ones are served as they came.
    """
    shell = F.col("tool_name").eqNullSafe("Bash")
    reads = F.col("tool_name").eqNullSafe("Read") & F.col("kind").eqNullSafe("text")
    blank, names = F.lit(""), [fresh(outputs.columns, n) for n in ("_main", "_side", "_own")]
    main, side, own = map(F.col, names)
    rows = outputs.withColumns(
        {
            names[0]: F.when(shell, F.coalesce("stdout", blank)).when(reads, F.coalesce("content", blank)).otherwise(blank),
            names[1]: F.when(shell, F.coalesce("stderr", blank)).otherwise(blank),
            names[2]: F.struct(*outputs.columns),
        }
    ).select(*names)
    long = F.char_length(main) + F.char_length(side) > max_text
    for n in names[:2]:  # what is withheld anyway is not looked into
        done = redact(rows.withColumn("_in", F.when(~long, F.col(n))), "_in", settings, rules)
        rows = done.select(*rows.columns, F.struct("redacted", "found").alias(f"{n}_out"))
    first, second = F.col(f"{names[0]}_out"), F.col(f"{names[1]}_out")
    ours, failed = shell | reads, F.col("error").isNotNull()
    rows = rows.select(f"{names[2]}.*", *names[:2], f"{names[0]}_out", f"{names[1]}_out", long.alias(names[2]))
    shut = own | (failed if settings.fail_mode == "closed" else F.lit(False))
    verdict = F.when(~ours, "allow").when(shut, "withhold").when(~failed & (first["found"] + second["found"] > 0), "rewrite").otherwise("allow")
    notice = F.when(own, NOTICES[0]).otherwise(NOTICES[1])

    def served(mine: Column, col: str, text: Column, held: Column) -> Column:
        return F.when(mine & (F.col("decision") == "withhold"), held).when(mine & (F.col("decision") == "rewrite"), text).otherwise(F.col(col))

    out = rows.withColumn("decision", verdict).withColumns(
        {
            "served_stdout": served(shell, "stdout", first["redacted"], notice),
            "served_stderr": served(shell, "stderr", second["redacted"], blank),
            "served_content": served(reads, "content", first["redacted"], notice),
        }
    )
    return out.drop(*names, f"{names[0]}_out", f"{names[1]}_out")


def command_decision(commands: DataFrame, col: str = "command") -> DataFrame:
    """Denied: a command that names a media file and reads contents, or does not begin with a name-only tool."""
    words = F.transform(F.filter(F.split(F.trim(F.col(col)), r"[\s;|&()]+"), lambda w: w != ""), lambda w: F.substring_index(w, "/", -1))
    media = F.col(col).rlike(MEDIA)
    reads = F.exists(words, lambda w: w.isin(*READERS))
    first = F.coalesce(F.get(words, F.lit(0)), F.lit(""))
    return commands.withColumn("decision", F.when(F.coalesce(media & (reads | ~first.isin(*NAME_ONLY)), F.lit(False)), "deny").otherwise("allow"))
