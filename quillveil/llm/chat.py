"""Chat formatting with typed content parts.

A visitor walks a turn's parts (text, image, audio, document) in order. Text is escaped; every other
part becomes a placeholder, its reference goes to the attachment list, and its placeholder counts as
the tokens the encoder will expand it to. A turn's content is a plain text, whose Markdown image
references ``![alt](ref)`` are media parts (image, audio or document by the suffix), or, where ``typed=True``, a
JSON list of parts ``{"type": ..., "text"/"ref": ..., ...}``. A plain text's media part keeps its source,
so that the text is read back whole.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n``. Wherever one of the control strings below begins in
a text or role, a mark follows its first character, so the output holds no control string of the text's own;
a mark that the text has itself is doubled in kind, and a newline in a role is a marked n. All are undone in one
pass, so every text and role, including one full of control strings, is read back exactly. The loss mask covers
an assistant's texts and the media of its plain texts, not the placeholders of typed parts, which no model says.

Null text and null role count as empty; null conversation ids form a conversation. Turns that tie
are ordered by role, then text; repeated rows are repeated turns. An empty table has no
conversations. Other columns are not read. A turn is formatted on its own, and a conversation is
only ever streamed in turn order, so none of any length is held in memory.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import lean, ship

MARK = "␛"
# Control strings of common templates, and the placeholders.
CONTROL = (
    "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "[INST]", "[/INST]",
    "<<SYS>>", "<</SYS>>", "<|image|>", "<|audio|>", "<|document|>",
)
_STARTS = re.compile("(?=(?:" + "|".join(map(re.escape, CONTROL)) + "))(.)", re.S)
_UNDO = re.compile(MARK + "([ecn])|<\\|(?:image|audio|document)\\|>")
#: A media reference in a plain text, and what its suffix makes it (else an image).
MEDIA = r"!\[[^\]\n]*\]\(([^()\s]+)\)"
SUFFIXES = {"audio": r"(?i)\.(?:wav|mp3|flac|ogg)$", "document": r"(?i)\.(?:pdf|docx?|pptx?)$"}
TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    return _STARTS.sub(lambda m: m[1] + MARK + "c", text.replace(MARK, MARK + "e"))


def unescape(text: str, sources: Iterator[str] = iter(())) -> str:
    """The text; a placeholder becomes the next of ``sources``, the escapes of the text itself what they stand for."""
    return _UNDO.sub(lambda m: next(sources, "") if m[1] is None else {"e": MARK, "c": "", "n": "\n"}[m[1]], text)


def plain_parts(text: str) -> list[dict]:
    """A plain text as typed parts: its media references, and the texts around them."""
    out, at = [], 0
    for m in re.finditer(MEDIA, text):
        out.append({"type": "text", "text": text[at : m.start()]})
        kind = next((k for k, p in SUFFIXES.items() if re.search(p, m[1])), "image")
        out.append({"type": kind, "ref": m[1], "source": m[0]})
        at = m.end()
    return [*out, {"type": "text", "text": text[at:]}]


class Flattener:
    """Visits the parts of a turn. ``attachments`` holds (type, ref, expanded tokens, source) in order."""

    def __init__(self, patch: int = 28, audio_rate: float = 25.0, page_tokens: int = 256):
        self.patch, self.audio_rate, self.page_tokens = patch, audio_rate, page_tokens
        self.attachments: list[tuple[str, str, int, str]] = []

    def visit(self, part: dict) -> str:
        return getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_other)(part)

    def visit_text(self, part: dict) -> str:
        return escape(part.get("text") or "")

    def visit_image(self, part: dict) -> str:
        across, down = (math.ceil((part.get(k) or 448) / self.patch) for k in ("width", "height"))
        return self._place(part, across * down)

    def visit_audio(self, part: dict) -> str:
        return self._place(part, math.ceil((part.get("seconds") or 0) * self.audio_rate))

    def visit_document(self, part: dict) -> str:
        return self._place(part, (part.get("pages") or 1) * self.page_tokens)

    def visit_other(self, part: dict) -> str:
        """A part of unknown type is kept as its escaped JSON."""
        return escape(json.dumps(part, ensure_ascii=False, sort_keys=True))

    def _place(self, part: dict, tokens: int) -> str:
        self.attachments.append((part["type"], str(part.get("ref") or ""), tokens, str(part.get("source") or "")))
        return f"<|{part['type']}|>"


def typed_parts(content: str) -> list[dict] | None:
    """The parts that a JSON list tells; none if the content is anything else."""
    try:
        got = json.loads(content) if content.startswith("[") else None
    except ValueError:  # a text that only looks like JSON
        return None
    return got if isinstance(got, list) and all(isinstance(p, dict) for p in got) else None


def format_turn(role: str | None, content: str | None, typed: bool = False) -> dict:
    """The formatted turn, its loss spans (code points, of assistant text), and its attachments."""
    told = typed_parts(content or "") if typed else None
    v, body = Flattener(), f"<|im_start|>{escape(role or '').replace(chr(10), MARK + 'n')}\n"
    loss: list[dict] = []
    for part in plain_parts(content or "") if told is None else told:
        before, body = len(body), body + v.visit(part)
        said = part.get("type") not in ("image", "audio", "document") or part.get("source")
        if role == "assistant" and said and len(body) > before:
            if loss and loss[-1]["end"] == before:
                loss[-1]["end"] = len(body)
            else:
                loss.append({"start": before, "end": len(body)})
    return {
        "formatted": f"{body}<|im_end|>\n",
        "loss": loss,
        "attachments": [{"type": t, "ref": r, "tokens": n, "source": x} for t, r, n, x in v.attachments],
        "expanded_tokens": sum(n for _, _, n, _ in v.attachments),
    }


FORMATTED = pa.schema(
    [("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("formatted", pa.string()),
     ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
     ("attachments", pa.list_(pa.struct([("type", pa.string()), ("ref", pa.string()), ("tokens", pa.int64()), ("source", pa.string())]))), ("expanded_tokens", pa.int64())]
)


def format_chat(rows: DataFrame, typed: bool = False) -> DataFrame:
    """Every turn of conv_id, turn, role, text with its formatted segment; a conversation's output is
    its segments in (turn, role, text) order."""
    ship(rows.sparkSession)

    def run(batches):
        for b in batches:
            cols = {n: b.column(n).to_pylist() for n in ("conv_id", "turn", "role", "text")}
            out = [format_turn(r, t, typed) for r, t in zip(cols["role"], cols["text"], strict=True)]
            yield pa.RecordBatch.from_pydict(cols | {k: [x[k] for x in out] for k in FORMATTED.names[4:]}, FORMATTED)

    return rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").mapInArrow(
        lean(run), "conv_id long, turn long, role string, text string, formatted string, loss array<struct<start:long,end:long>>, attachments array<struct<type:string,ref:string,tokens:long,source:string>>, expanded_tokens long"
    )


DIGEST = pa.schema(
    [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_attachments", pa.int64()), ("expanded_tokens", pa.int64())]
)


class _Conversation:
    """What has been read back of one conversation."""

    def __init__(self):
        self.turns = self.loss_chars = self.chars = self.attachments = self.tokens = 0
        self.said, self.learned = hashlib.sha256(), hashlib.sha256()

    def add(self, segment: str, loss: list[dict], attachments: list[dict]) -> None:
        for m in TURN.finditer(segment):
            self.turns += 1
            self.said.update(f"{unescape(m[1])}\n{unescape(m[2], iter([a['source'] for a in attachments]))}\n".encode("utf-8", "surrogatepass"))
        sources = iter([a["source"] for a in attachments if a["source"]])
        for span in loss:
            text = unescape(segment[span["start"] : span["end"]], sources)
            self.loss_chars += len(text)
            self.learned.update(text.encode("utf-8", "surrogatepass"))
        self.chars += len(segment)
        self.attachments += len(attachments)
        self.tokens += sum(a["tokens"] for a in attachments)

    def row(self, conv_id: int | None) -> dict:
        told = (conv_id, self.turns, self.said.hexdigest(), self.loss_chars, self.learned.hexdigest(), self.chars, self.attachments, self.tokens)
        return dict(zip(DIGEST.names, told, strict=True))


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, what its output says: parsed turns, text under the loss mask, sizes, attachments."""
    ship(formatted.sparkSession)

    def run(batches):
        at, now = None, None
        for b in batches:
            out = []
            for c, segment, loss, attachments in zip(*(b.column(n).to_pylist() for n in ("conv_id", "formatted", "loss", "attachments")), strict=True):
                if now is None or c != at:
                    if now:
                        out.append(now.row(at))
                    at, now = c, _Conversation()
                now.add(segment, loss, attachments)
            yield pa.RecordBatch.from_pylist(out, DIGEST)
        if now:
            yield pa.RecordBatch.from_pylist([now.row(at)], DIGEST)

    return (
        formatted.repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "formatted", "loss", "attachments")
        .mapInArrow(lean(run), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, expanded_tokens long")
    )
