"""The sequential rule of segments and blocks in plain Python, which the windows must equal."""

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

from quire.functions import text as fx
from quire.operators.structure import AUTHOR_WITHIN, SETTLED, TITLE_BELOW


@dataclass
class Segment:
    text: str
    open_fence: bool = False


def segments(markdown: str) -> Iterator[Segment]:
    """Blank lines part segments; fences and HTML tables stay whole. A closed fence counts as plain text; only one
    that never closes is marked (see the tests)."""
    held: list[str] = []
    inside = ""  # "", "fence" or "table"

    def take(marked: bool) -> Iterator[Segment]:
        text = "\n".join(held).strip()
        held.clear()
        if text:
            yield Segment(text, marked)

    for line in re.split(r"\r\n|\r|\n", markdown):
        if line.lstrip().startswith("```"):
            if inside != "fence":
                if held:
                    yield from take(False)
                held.append(line)
                inside = "fence"
            else:
                held.append(line)
                inside = ""
                yield from take(False)
        elif inside == "fence":
            held.append(line)
        elif inside == "table" or re.search(r"<table[\s>]", line, re.I):
            held.append(line)
            inside = "table"
            if re.search(r"</table>", line, re.I):
                inside = ""
                yield from take(False)
        elif not line.strip():
            yield from take(False)
        else:
            held.append(line)
    yield from take(inside == "fence")


def _is_table(text: str) -> bool:
    rows = [x for x in text.split("\n") if x]
    return bool(re.match(r"<table[\s>]", text, re.I)) or len(rows) > 1 and "|" in rows[0] and "|" in rows[1] and bool(re.match(r"\s*\|?\s*:?-{3,}", rows[1]))


def _is_formula(text: str) -> bool:
    return len(text) > 4 and bool(re.fullmatch(r"\$\$.*\$\$|\\\[.*\\\]", text, re.S))


def _is_author(text: str) -> bool:
    if len(text) > 240 or re.search(r"[.!?]\s*\Z", text):
        return False
    words = re.split(r"\s+", text)
    capital = sum(bool(re.fullmatch(r"[A-Z][A-Za-z'’-]+,?", w)) for w in words)
    return bool(re.search(rf"\b(?:{'|'.join(fx.INSTITUTIONS)})\b", text, re.I | re.A)) or 2 <= len(words) <= 20 and capital >= math.ceil(len(words) / 2)


# What headings, images, captions and openings of lines without content look like.
_HEADING = re.compile(r"(#{1,6})\s+(.+)", re.S)
_IMAGE = re.compile(r"!\[([^\]]*)\]\(([^)]+)\)\s*(.*)", re.S)
_DROPPED = re.compile("|".join(map(re.escape, fx.DROP_STARTS)), re.I)
_CAPTION = re.compile(r"(?:fig(?:ure)?\.?|table)\s+\d+[.:\s]", re.I | re.A)


def find_asset(src: str, assets: list[dict]) -> str | None:
    """Relative path of the first asset whose original path is the source or ends with its file name."""
    wanted = src.replace("\\", "/")
    tail = "/" + wanted.rsplit("/", 1)[-1]
    return next((a["relative_path"] for a in assets if (p := a["original_path"].replace("\\", "/")) == wanted or p.endswith(tail)), None)


def classify(parts: Iterator[Segment], assets: list[dict] = ()) -> list[dict]:
    """Typed blocks of a document's segments, in order."""
    out: list[dict] = []
    titled = listing = False

    def add(kind: str, text: str, status: str = "pending", **more) -> None:
        source = re.sub(r"\\([_~`*\[\]#\\])", r"\1", text).strip()
        out.append({"id": f"b{len(out) + 1:04d}", "type": kind, "source": source, "asset_path": None, "source_asset_path": None, "status": status} | more)

    for part in parts:
        text = part.text
        if m := _HEADING.fullmatch(text):
            depth, name = len(m[1]), m[2].strip()
            listing = bool(re.fullmatch(r"references?", name, re.I))
            first = not titled and depth == 1
            titled |= first
            add("title" if first else "subheading" if depth > 2 else "heading", name)
        elif m := _IMAGE.fullmatch(text):
            src = re.sub(r"^<|>\Z", "", m[2].strip())
            add("image", m[1].strip(), SETTLED, asset_path=find_asset(src, list(assets)), source_asset_path=src)
            if m[3].strip():
                add("caption", m[3].strip())
        elif _DROPPED.match(text):
            add("drop", text, SETTLED)
        elif listing:
            # fixed value: a reference begins with a name and a comma
            for one in re.split(r"\n(?=[A-Z][\w'’.-]+,)", text, flags=re.A):
                add("reference", one.strip(), SETTLED)
        elif part.open_fence or _is_formula(text):
            add("formula", text, SETTLED)
        elif _is_table(text):
            add("table", text)
        elif text.startswith(">"):
            add("quote", re.sub(r"^>\s?", "", text, flags=re.M))
        elif _CAPTION.match(text):
            add("caption", text)
        elif titled and len(out) <= AUTHOR_WITHIN and _is_author(text):
            add("author", text, SETTLED)
        elif not titled and len(text) < TITLE_BELOW:
            titled = True
            add("title", text)
        else:
            add("paragraph", text)
    return out
